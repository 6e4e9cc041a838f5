"""Command line: scan one or more project folders.

    python -m codestrata.cli PATH... [--json | --tree | --recommend | --scripts DIR] [--depth N] [--mode parity|intended]

Exit codes: 1 for bad arguments, a missing folder or an error; with ``--json`` 1
if there is any issue; else 0.  Nothing is written but what ``--scripts`` names.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.structure import project_stats, structural_issues
from .plans import migration, render, report
from .plans.sink import write_files
from .schema import Limits
from .sources.fstree import read_configs, read_entries, read_sources

VERSION = "1.0.0"


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="codestrata", description="Find structural problems of source projects.")
    p.add_argument("paths", nargs="*", default=["."])
    what = p.add_mutually_exclusive_group()
    what.add_argument("--json", action="store_true", help="the full report as JSON, one document per project")
    what.add_argument("--tree", action="store_true", help="the tree with its issues")
    what.add_argument("--recommend", action="store_true", help="a recommended layout")
    what.add_argument("--scripts", metavar="DIR", help="write a shell, a PowerShell and a Markdown plan there")
    p.add_argument("--depth", type=int, default=4, help="depth of the tree")
    p.add_argument("--mode", choices=("parity", "intended"), default="parity")
    p.add_argument("--no-ai", action="store_true", help="accepted for the sake of old calls; there is no hand-off to skip")
    p.add_argument("--version", "-v", action="version", version=VERSION)
    return p


def text_report(reports, summary) -> list[str]:
    """Score, stack and the first issues of each rule, for each project."""
    out = []
    bars = {r.project_id: r.bar for r in reports.select("project_id", render.progress_bar(F.col("score")).alias("bar")).collect()}
    rows = summary.sort("project_id", "sort_ord", "place").collect()
    for r in reports.drop("issues").collect():
        out += [f"{r.project_id}: {r.score}/100 ({r.grade}) {bars[r.project_id]}", f"  {r.framework.name} · {r.framework.pm}" + "".join(f" · {x}" for x in r.framework.labels)]
        if r.graph_stats:
            out.append(f"  {r.graph_stats.edges} imports, {r.graph_stats.avg_imports} a file, most imported: {r.graph_stats.max_fan_in_file or '-'}")
        for i in (i for i in rows if i.project_id == r.project_id):
            if i.place == 1:
                out.append(f"  [{i.badge}] {i.label} ({i.total})")
            out.append(f"    {i.file}: {i.message}")
            if i.hidden and i.place == 3:
                out.append(f"    … {i.hidden} more")
    return out


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    projects = {p: os.path.abspath(p) for p in args.paths}
    for given, path in projects.items():
        if not os.path.isdir(path):
            print(f"no such folder: {given}", file=sys.stderr)
            return 1
    limits = Limits(mode=args.mode)
    entries = read_entries(spark, projects).persist()
    if args.tree:
        rows = render.tree_rows(entries, report.issue_map(structural_issues(entries, limits)), max_depth=args.depth)
        for project in projects:
            print(render.render_tree(rows, project, args.depth))
        return 0
    if args.recommend:
        flags = render.layout_flags(entries)
        for r in render.recommended_structure(flags).collect():
            print(f"{r.project_id}\n{r.layout}")
        return 0
    if args.scripts:
        issues = structural_issues(entries, limits)
        moves, removes, guidance = migration.plan_moves(entries, issues), migration.plan_removes(issues), migration.plan_guidance(issues)
        os.makedirs(args.scripts, exist_ok=True)
        made = {"sh": render.bash_script(entries, moves, removes, guidance), "ps1": render.powershell_script(entries, moves, removes, guidance), "md": render.markdown_plan(project_stats(entries), moves, removes, guidance)}
        place = F.create_map(*[x for i, p in enumerate(sorted(projects)) for x in (F.lit(p), F.lit(f"migration-{i}."))])
        for end, scripts in made.items():
            write_files(scripts.select(F.concat(F.element_at(place, F.col("project_id")), F.lit(end)).alias("name"), F.concat("script", F.lit("\n")).alias("body")), args.scripts)
            for i in range(len(projects)):
                print(os.path.join(args.scripts, f"migration-{i}.{end}"))
        return 0
    reports = report.report(entries, read_sources(entries, projects), read_configs(entries, projects), limits).persist()
    if args.json:
        for r in report.report_json(reports).collect():
            print(r.json)
        return int(not reports.where("issue_count > 0").isEmpty())
    issues = reports.select("project_id", F.explode("issues").alias("i")).select("project_id", "i.*")
    print("\n".join(text_report(reports, report.issue_summary(issues))))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("codestrata").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
