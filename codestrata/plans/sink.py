"""Texts as files, one a row, written by executors.

A task writes its files into a folder of its own below ``_staging``, and only a
task that ends reports that folder; the driver then moves the files of the folders
reported into place, each in one step.  A killed or repeated task leaves nothing
but its staging folder, which the end of the job removes.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..ship import ship

STAGING = "_staging"


@dataclass
class Staged(WriterCommitMessage):
    folder: str


def file_name(name: str) -> str:
    """A name that stays one file in its folder: other characters than letters, digits and ``._-`` by their codes, no leading dot."""
    kept = re.sub(r"[^A-Za-z0-9._-]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), name)
    return "%2E" + kept[1:] if kept.startswith(".") else kept or "%"


class TextFilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        self.job = os.path.join(self.folder, STAGING, uuid.uuid4().hex)

    def write(self, rows) -> Staged:
        own = os.path.join(self.job, uuid.uuid4().hex)
        os.makedirs(own)
        for row in rows:
            with open(os.path.join(own, file_name(row.name)), "w", encoding="utf-8") as f:
                f.write(row.body)
        return Staged(own)

    def commit(self, messages) -> None:
        for staged in messages:
            if staged is not None:
                for name in sorted(os.listdir(staged.folder)):
                    os.replace(os.path.join(staged.folder, name), os.path.join(self.folder, name))
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        shutil.rmtree(self.job, ignore_errors=True)
        try:
            os.rmdir(os.path.dirname(self.job))
        except OSError:  # another job stages there
            pass


class TextFiles(DataSource):
    """``rows(name, body).write.format("textfiles").save(folder)``; files of the same name are replaced."""

    @classmethod
    def name(cls) -> str:
        return "textfiles"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"])


def write_files(rows: DataFrame, folder: str) -> None:
    """One file for each row (name, body) in a folder that all executors share; no text reaches the driver."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(TextFiles)
    rows.select("name", F.coalesce("body", F.lit("")).alias("body")).write.format("textfiles").mode("append").save(folder)
