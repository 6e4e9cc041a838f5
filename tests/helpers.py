"""Small projects on disk and as relations."""

import os

from codestrata.adapters import entries_from_paths
from codestrata.schema import SOURCES


def make_tree(root, files, dirs=()):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8") as f:
            f.write(text)
    for path in dirs:
        os.makedirs(os.path.join(root, path), exist_ok=True)
    return str(root)


def entries(spark, *paths, project="p"):
    return entries_from_paths(spark.createDataFrame([(project, p, 1) for p in paths], "project_id string, path string, size long"))


def sources(spark, files, project="p"):
    return spark.createDataFrame([(project, k, v) for k, v in files.items()], SOURCES)


def files_of(issues):
    return sorted(r.file for r in issues.collect())
