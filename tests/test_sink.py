"""Files written by executors; walks that filters prune; trees as relations."""

import os

import pytest
from codestrata.plans import render
from codestrata.plans.sink import STAGING, Staged, TextFilesWriter, file_name, write_files
from codestrata.sources import fstree
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, LessThanOrEqual, Not, StringEndsWith

from .helpers import entries, make_tree


def test_a_file_a_row_and_no_partial_files(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("a/b "), F.col("id").cast("string"), F.lit(".sh")).alias("name"), F.when(F.col("id") != 7, F.repeat(F.lit("é\n"), F.col("id").cast("int"))).alias("body")).repartition(5)
    write_files(rows, str(tmp_path))
    found = {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)}
    assert found == {f"a%2Fb%20{i}.sh": "" if i == 7 else "é\n" * i for i in range(200)}
    bad = rows.select("name", F.when(F.col("name").contains("150"), F.raise_error(F.lit("stop"))).otherwise(F.lit("new")).alias("body"))
    with pytest.raises(Exception, match="stop"):
        write_files(bad, str(tmp_path))
    assert {n: (tmp_path / n).read_text() for n in os.listdir(tmp_path)} == found


def test_a_killed_task_leaves_only_staged_files(tmp_path):
    writer = TextFilesWriter(str(tmp_path))

    def rows():
        yield Row(name="x", body="half")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        writer.write(rows())
    assert os.listdir(tmp_path) == [STAGING]
    done = writer.write(iter([Row(name="x", body="whole")]))
    assert isinstance(done, Staged)
    writer.commit([done, None])
    assert os.listdir(tmp_path) == ["x"] and (tmp_path / "x").read_text() == "whole"


def test_file_names_stay_in_their_folder():
    assert [file_name(n) for n in ("..", "../x", "a b", "", "é")] == ["%2E.", "%2E.%2Fx", "a%20b", "%", "%C3%A9"]


FILES = {"package.json": "{}", "a.ts": "", "src/b.ts": "", "src/package.json": "{}", "src/deep/c.ts": "", "src/deep/er/d.tsx": "", "lib/e.md": ""}


@pytest.mark.parametrize("filters,lists", [
    ([], 5), ([EqualTo(("parent",), ""), Not(EqualTo(("kind",), "dir")), In(("name",), ("package.json",))], 1), ([LessThanOrEqual(("depth",), 1)], 3), ([EqualTo(("kind",), "dir")], 5),
    ([StringEndsWith(("name",), ".ts"), Not(EqualTo(("kind",), "dir"))], 5), ([EqualTo(("depth",), 0)], 1), ([EqualTo(("parent",), "")], 3),
])
def test_filters_prune_the_walk(tmp_path, monkeypatch, filters, lists):
    root, listed, sized = make_tree(tmp_path, FILES), [], []
    scan, size = os.scandir, fstree._size
    monkeypatch.setattr(fstree.os, "scandir", lambda p: listed.append(str(p)) or scan(p))
    monkeypatch.setattr(fstree, "_size", lambda p: sized.append(p) or size(p))

    def read(pushed):
        reader = fstree.FsTreeReader({"projects": f'{{"p": "{root}"}}'})
        assert list(reader.pushFilters(pushed)) == pushed
        return [tuple(r.values()) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]

    column = {n: i for i, n in enumerate(fstree.ENTRIES.names)}

    def fits(row, f):
        if isinstance(f, Not):
            return not fits(row, f.child)
        value = row[column[f.attribute[0]]]
        return value is not None and (value in f.value if isinstance(f, In) else value.endswith(f.value) if isinstance(f, StringEndsWith) else value <= f.value if isinstance(f, LessThanOrEqual) else value == f.value)

    want = sorted(r for r in read([]) if all(fits(r, f) for f in filters))
    listed.clear(), sized.clear()
    got = read(filters)
    assert sorted(r for r in got if all(fits(r, f) for f in filters)) == want and want
    assert len(set(map(os.path.normpath, listed))) == lists
    if filters and filters[-1] == In(("name",), ("package.json",)):
        assert len(sized) == 1


def test_configurations_come_from_root_folders_only(spark, tmp_path):
    root = make_tree(tmp_path, FILES)
    tree = fstree.read_entries(spark, {"p": root})
    assert [r.content for r in fstree.read_configs(tree, {"p": root}).collect()] == ["{}"]
    assert tree.where("kind <> 'dir'").count() == len(FILES) and tree.where("depth <= 1").count() == 8


def plain_tree(rows, project_id):
    kids = {}
    for r in rows:
        kids.setdefault(r.parent, []).append(r)
    out = [f"{project_id}/"]

    def show(parent, lead):
        own = sorted(kids.get(parent, []), key=lambda r: (r.kind != "dir", r.place))
        if not own and parent:
            out.append(f"{lead}└── (empty)")
        for i, r in enumerate(own):
            last = i == len(own) - 1 and not r.hidden
            out.append(f"{lead}{'└── ' if last else '├── '}{r.name}{'/' if r.kind == 'dir' else ''}{f'  [{", ".join(r.tags)}]' if r.tags else ''}{f'  {r.hint}' if r.hint else ''}")
            if r.kind == "dir":
                show(r.rel_path, lead + ("    " if last else "│   "))
            if r.hidden:
                out.append(f"{lead}└── … {r.hidden} more files")

    show("", "")
    return "\n".join(out)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_trees_as_relations(spark, depth):
    paths = [f"src/{a}/{b}/f{i}.ts" for a in "xyz" for b in ("m", "n") for i in range(8 if b == "m" else 2)] + ["a.ts", "b.ts", "src/k.ts", "lib/q/r/s/t/u.ts"] + [f"many/g{i}.ts" for i in range(9)]
    tags = spark.createDataFrame([("p", "src", ["Fat"]), ("p", "a.ts", ["X", "Y"])], "project_id string, path string, tags array<string>")
    rows = render.tree_rows(entries(spark, *paths), tags, max_depth=depth)
    assert render.render_tree(rows, "p", depth) == plain_tree(rows.collect(), "p") and render.render_tree(rows, "none", depth) == "none/"
