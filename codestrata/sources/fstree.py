"""Project folders as relations: a Python data source and readers built on it.

Spark's file source drops hidden names, empty files and empty folders, so the
walk is our own.  The driver's side of the reader lists folders breadth-first,
at most ``PARTS`` of them for all projects, so that a project under one folder
still makes many partitions; the walks run on executors.  Links are never
followed.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, Not, StringEndsWith

from ..schema import ALIASES, CONFIGS, ENTRIES, SKIP_DIRS, SOURCE_EXTENSIONS, SOURCES
from ..ship import ship


#: Folders that the driver lists, and partitions made of them, about.
PARTS = 256
#: Bytes of files that a reader holds at once; a larger file is held alone.
HELD_BYTES = 16 << 20
#: Rows that a walk hands on at once.
BATCH_ROWS = 4096
ARROW = pa.schema([("project_id", pa.string()), ("rel_path", pa.string()), ("name", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("kind", pa.string()), ("size", pa.int64()), ("readable", pa.bool_())])


class Subtree(InputPartition):
    """A directory to walk, or only to list (``deep`` false)."""

    def __init__(self, project: str, root: str, rel: str, depth: int, deep: bool):
        self.project, self.root, self.rel, self.depth, self.deep = project, root, rel, depth, deep


def _kind(entry: os.DirEntry) -> str:
    if entry.is_dir(follow_symlinks=False):
        return "dir"
    return "file" if entry.is_file(follow_symlinks=False) else "other"


def _size(path: str) -> int | None:
    try:
        return os.stat(path).st_size
    except OSError:
        return None


class Wanted:
    """What the pushed filters leave of a walk.  They only save work: Spark applies them again."""

    def __init__(self):
        self.deepest: int | None = None  # depth of the last folders to list
        self.at_root = False  # only entries of the project's own folder
        self.files = self.folders = True
        self.names: frozenset[str] | None = None
        self.end = ""

    def take(self, f: Filter) -> None:
        column = getattr(f, "attribute", ())
        if isinstance(f, Not):
            inner = f.child
            if isinstance(inner, EqualTo) and inner.attribute == ("kind",) and inner.value == "dir":
                self.folders = False
        elif column == ("depth",) and isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
            most = f.value - isinstance(f, LessThan)
            self.deepest = most if self.deepest is None else min(self.deepest, most)
        elif column == ("parent",) and isinstance(f, EqualTo) and f.value == "":
            self.at_root = True
        elif column == ("kind",) and isinstance(f, EqualTo):
            self.files, self.folders = self.files and f.value != "dir", self.folders and f.value == "dir"
        elif column == ("name",) and isinstance(f, (EqualTo, In)):
            found = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
            self.names = found if self.names is None else self.names & found
        elif column == ("name",) and isinstance(f, StringEndsWith) and len(f.value) > len(self.end):
            self.end = f.value

    def listed(self, depth: int) -> bool:
        """Whether a folder at that depth is listed at all."""
        if self.deepest is not None and depth > self.deepest:
            return False
        return not self.at_root or depth == 0 or depth == 1 and self.folders

    def file(self, depth: int, name: str) -> bool:
        """Whether a file in a folder at that depth may be wanted."""
        return self.files and (not self.at_root or depth == 0) and (self.names is None or name in self.names) and name.endswith(self.end)


def walk(project: str, root: str, rel: str, depth: int, deep: bool, skip: frozenset[str], wanted: Wanted | None = None) -> Iterator[tuple]:
    """Rows of ``entries`` for a directory and what it holds.  An unreadable
    directory gives its own row only.  Explicit stack: depth is unbounded."""
    wanted = wanted or Wanted()
    stack = [(rel, depth)]
    while stack:
        at, d = stack.pop()
        if not wanted.listed(d):
            continue
        full = os.path.join(root, at) if at else root
        name = os.path.basename(at) if at else os.path.basename(os.path.abspath(root))
        parent = None if not at else at.rpartition("/")[0]
        try:
            kids = sorted(os.scandir(full), key=lambda e: e.name)
        except OSError:
            yield project, at, name, parent, d, "dir", None, False
            continue
        yield project, at, name, parent, d, "dir", None, True
        for e in kids:
            path, kind = (f"{at}/{e.name}" if at else e.name), _kind(e)
            if kind != "dir":
                if wanted.file(d, e.name):
                    yield project, path, e.name, at, d, kind, _size(os.path.join(full, e.name)), True
            elif deep and e.name not in skip:
                stack.append((path, d + 1))


class FsTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.projects: dict[str, str] = json.loads(options["projects"])
        self.skip = frozenset(json.loads(options.get("skipdirs", json.dumps(SKIP_DIRS))))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.wanted.take(f)
            yield f

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        todo = deque((project, root, "", 0) for project, root in self.projects.items())
        while todo and len(parts) + len(todo) < PARTS:
            project, root, rel, depth = todo.popleft()
            parts.append(Subtree(project, root, rel, depth, False))
            if not self.wanted.listed(depth + 1):
                continue
            try:
                kids = sorted(e.name for e in os.scandir(os.path.join(root, rel)) if e.is_dir(follow_symlinks=False) and e.name not in self.skip)
            except OSError:
                kids = []
            todo += [(project, root, f"{rel}/{name}" if rel else name, depth + 1) for name in kids]
        return parts + [Subtree(*left, True) for left in todo]

    def read(self, part: Subtree) -> Iterator[pa.RecordBatch]:
        rows = walk(part.project, part.root, part.rel, part.depth, part.deep, self.skip, self.wanted)
        while some := list(islice(rows, BATCH_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), ARROW.types)], schema=ARROW)


class FsTree(DataSource):
    """``spark.read.format("fstree")`` with options ``projects`` (JSON object of
    id to folder) and ``skipDirs`` (JSON list)."""

    @classmethod
    def name(cls) -> str:
        return "fstree"

    def schema(self):
        return ENTRIES

    def reader(self, schema) -> FsTreeReader:
        return FsTreeReader({k.lower(): v for k, v in self.options.items()})


def read_entries(spark: SparkSession, projects: dict[str, str], skip_dirs: tuple[str, ...] = SKIP_DIRS) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader has it, and Spark refuses it otherwise
    spark.dataSource.register(FsTree)
    return spark.read.format("fstree").option("projects", json.dumps(projects)).option("skipDirs", json.dumps(list(skip_dirs))).load()


def source_files(entries: DataFrame) -> DataFrame:
    """Script files by extension, declaration files left out."""
    wanted = F.col("name").rlike("(" + "|".join(re.escape(x) for x in SOURCE_EXTENSIONS) + r")\z") & ~F.col("name").rlike(r"\.d\.ts\z")
    return entries.where(F.col("kind") != "dir").where(wanted)


def _reader(projects: dict[str, str], schema):
    def read(batches):
        for pdf in batches:
            at, rows, held = 0, [], 0
            for n, (project, rel) in enumerate(zip(pdf.project_id, pdf.rel_path), 1):
                try:
                    with open(os.path.join(projects[project], rel), "rb") as f:
                        rows.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    rows.append("")
                held += len(rows[-1])
                if held >= HELD_BYTES or n == len(pdf):
                    yield pdf.iloc[at:n].assign(content=rows)[schema.names]
                    at, rows, held = n, [], 0

    return read


def read_sources(entries: DataFrame, projects: dict[str, str]) -> DataFrame:
    """Whole text of each source file; one that cannot be read is empty."""
    ship(entries.sparkSession)
    spark = entries.sparkSession
    files = source_files(entries).select("project_id", "rel_path")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project_id", "rel_path")  # names only; reading is the work
    return files.mapInPandas(_reader(projects, SOURCES), SOURCES)


def read_configs(entries: DataFrame, projects: dict[str, str]) -> DataFrame:
    """package.json, tsconfig.json and jsconfig.json of each project's root."""
    ship(entries.sparkSession)
    wanted = entries.where("parent = '' AND kind <> 'dir'").where(F.col("name").isin("package.json", "tsconfig.json", "jsconfig.json"))
    return wanted.select("project_id", "rel_path", "name").mapInPandas(_reader(projects, CONFIGS), CONFIGS)


def plain_json(text: str, mode: str) -> str:
    """JSON with comments and trailing commas to plain JSON.

    Parity cuts comments wherever they seem to stand, strings included;
    otherwise strings are left alone."""
    if mode == "parity":  # fixed values: what observed behaviour cuts
        text = re.sub(r"/\*.*?\*/", "", text, flags=re.DOTALL)
        text = re.sub(r"(\A|[^:])//[^\n]*", r"\1", text)
        return re.sub(r",(\s*[}\]])", r"\1", text)
    text = re.sub(r'("(?:\\.|[^"\\])*")|/\*.*?\*/|//[^\n]*', lambda m: m[1] or "", text, flags=re.DOTALL)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)


def fold(path: str) -> str:
    """A path relative to the project root with ``.`` and ``..`` folded."""
    kept: list[str] = []
    for part in path.split("/"):
        if part == "..":
            kept[-1:] = []
        elif part not in ("", "."):
            kept.append(part)
    return "/".join(kept)


def parse_aliases(config: str, mode: str) -> tuple[str, list[dict], int]:
    """(base folder, alias rows, number of aliases) of a configuration; raises if it is not valid."""
    options = json.loads(plain_json(config, mode))
    if options is None:
        raise ValueError("a configuration of null")
    options = (options.get("compilerOptions") if isinstance(options, dict) else None) or {}
    base = options.get("baseUrl")
    base = fold(base) if base is not None else ""
    rows, paths = [], options.get("paths") or {}
    for i, (pattern, targets) in enumerate(paths.items()):
        prefix, star, suffix = pattern.partition("*")
        for j, target in enumerate(targets or []):
            rows.append({"alias_ord": i, "prefix": prefix, "suffix": suffix, "has_star": bool(star), "target_ord": j, "target": fold(f"{base}/{target}")})
    return base, rows, len(paths)


def load_aliases(configs: DataFrame, mode: str = "parity") -> DataFrame:
    """One row per project with a usable tsconfig.json, else jsconfig.json;
    order of aliases and targets as declared, ``*`` kept in targets."""

    names = ("tsconfig.json", "jsconfig.json")

    def run(batches):
        for pdf in batches:
            found = []
            for project, *texts in zip(pdf.project_id, pdf["first"], pdf["second"]):
                for name, text in zip(names, texts):
                    try:
                        base, rows, n = parse_aliases(text, mode)
                    except (ValueError, AttributeError, TypeError):  # absent or not valid: the next one
                        continue
                    found.append((project, name, base, rows, n))
                    break
            yield pd.DataFrame(found, columns=ALIASES.names, dtype=object)

    of = lambda name: F.min(F.when(F.col("name") == name, F.col("content")))
    texts = configs.where(F.col("name").isin(*names)).groupBy("project_id").agg(of(names[0]).alias("first"), of(names[1]).alias("second"))
    ship(configs.sparkSession)
    return texts.mapInPandas(run, ALIASES)
