"""Structural rules over the ``entries`` relation, for any number of projects.

All rules look at one aggregation by (project, directory); folders are keyed by
path, so a large project is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from ..functions.text import basename, detect_style, is_script
from ..schema import BARREL_DIRS, CONCEPTS, ISSUE_COLUMNS, ISSUE_EXTRAS, ISSUE_TYPES, RULE_FACTS, Limits

# Fixed values: (file name, path, target) of misplaced files, the first that fits decides.
MISPLACED = (
    (r"\.(tsx|jsx)\z", r"(?i)/(utils|helpers|lib|hooks|services)/", "components/", "a component belongs with the components"),
    (r"\.(test|spec)\.(ts|tsx|js|jsx)\z", r"^/(src|app|components|pages)/", "a dedicated tests/ or __tests__/ directory", "a test belongs apart from the sources"),
    (r"\.(config|rc)\.(ts|js|mjs|cjs)\z|^(jest|vitest|playwright|eslint|prettier|tailwind|postcss|next)\.config", r"/(src|components|lib|utils)/", "correct directory", "configuration belongs at the project root"),
    (r"\.prisma\z", r"/(src|app|components)/", "prisma/", "a schema belongs in prisma/"),
)
# Names of configuration files, and of sources that may lie at the root.
CONFIG_NAME = r"\.(config|rc)\.(ts|js|mjs|cjs|json)\z|^\.eslintrc|^\.prettierrc|^jest\.config|^vitest\.config"
ROOT_EXEMPT = r"^(index|app|main|server|entry)\.[tj]sx?\z"


def issue_row(rule: str, file: Column, snippet: Column, message: Column, **extras: Column) -> Column:
    """One issue without its project, as a struct."""
    facts = RULE_FACTS[rule]
    own = {
        "rule": F.lit(rule), "type": F.lit(ISSUE_TYPES[rule][0]), "severity": F.lit(facts["severity"]), "file": file, "line": F.lit(1), "snippet": snippet, "message": message, "penalty": F.lit(facts["penalty"]),
        **{k: extras.get(k, F.lit(None)).cast(t) for k, t in ISSUE_EXTRAS.items()},
    }
    return F.struct(*[own[c].alias(c) for c in ISSUE_COLUMNS if c != "project_id"])


def issue(rows: DataFrame, rule: str, file: Column, snippet: Column, message: Column, **extras: Column) -> DataFrame:
    """Rows of the issue relation from rows with project_id."""
    return rows.select("project_id", issue_row(rule, file, snippet, message, **extras).alias("i")).select("project_id", "i.*")


def directories(entries: DataFrame) -> DataFrame:
    """Directories that could be listed."""
    return entries.where("kind = 'dir' AND readable")


def _in_listed(entries: DataFrame) -> DataFrame:
    return entries.where("parent IS NOT NULL")


def dir_stats(entries: DataFrame) -> DataFrame:
    """Per listed directory: direct files and subdirectories, names in order."""
    kids = _in_listed(entries).groupBy("project_id", F.col("parent").alias("rel_path")).agg(
        F.count_if(F.col("kind") != "dir").alias("files"), F.count_if(F.col("kind") == "dir").alias("dirs"),
    )
    stats = directories(entries).select("project_id", "rel_path", "name", "depth").join(kids, ["project_id", "rel_path"], "left")
    return stats.withColumns({"files": F.coalesce("files", F.lit(0)), "dirs": F.coalesce("dirs", F.lit(0))})


def _folder(path: Column) -> Column:
    """File key of a folder; the root is ``./``."""
    return F.concat(F.when(path == "", ".").otherwise(path), F.lit("/"))


#: Styles that count when folders are compared.
STYLES = ("camel", "kebab", "mixed", "pascal", "snake")


def first_names(name: Column, top: int) -> Column:
    """Aggregate: the ``top`` smallest values in order, nulls left out; its state holds no more than these."""
    return F.array_sort(InternalFunction.collect_top_k(name, top, True))


def _which(name: Column, path: Column) -> Column:
    """Number of the first entry of ``MISPLACED`` that fits a file."""
    place, which = F.concat(F.lit("/"), path, F.lit("/")), None
    for i, (pattern, where, _, _) in enumerate(MISPLACED):
        hit = name.rlike(pattern) & place.rlike(where)
        which = F.when(hit, i) if which is None else which.when(hit, i)
    return which


def _nested_config(limits: Limits) -> Column:
    return F.lit(limits.mode != "parity") & (F.col("depth") >= 1) & F.col("name").rlike(CONFIG_NAME)


def folder_facts(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What the rules need to know of each folder, in one aggregation of the listing.

    An entry gives a row to its parent's group (role 0), a folder one to its own
    (role 1), and a file that a rule names by itself one to its path (roles 2 and
    3: no folder has that path).  Counts and the few smallest names are combined
    before the shuffle, so a folder of any size costs a row a task."""
    c = F.col
    row = lambda path, role, when=None: F.when(F.lit(True) if when is None else when, F.struct(path.alias("rel_path"), F.lit(role).alias("role"), F.when(F.lit(role == 2), c("which")).alias("which")))
    seen = entries.withColumn("which", F.when(c("kind") != "dir", _which(c("name"), c("rel_path"))))
    roles = F.array(
        row(c("parent"), 0, c("parent").isNotNull()), row(c("rel_path"), 1, c("kind") == "dir"), row(c("rel_path"), 2, c("which").isNotNull()), row(c("rel_path"), 3, (c("kind") != "dir") & _nested_config(limits)),
    )
    rows = seen.select("project_id", "name", "kind", "depth", "readable", F.explode(F.array_compact(roles)).alias("r")).select("project_id", "r.*", "name", "kind", "depth", "readable")
    child, own = c("role") == 0, c("role") == 1
    folder, script = child & (c("kind") == "dir"), child & (c("kind") != "dir") & is_script(c("name"))
    concepts = F.create_map(*[x for i, group in enumerate(CONCEPTS) for n in group for x in (F.lit(n), F.lit(i))])
    rows = rows.withColumns({
        "style": F.when(folder | script, detect_style(c("name"))), "low": F.when(folder, F.lower("name")), "folder": folder, "script": script,
        "loose": script & (c("kind") == "file") & (c("rel_path") == "") & ~c("name").rlike(ROOT_EXEMPT),
    }).withColumn("concept", F.try_element_at(concepts, c("low")))
    other = c("script") & ~c("style").isin("pascal", "special", "dotted")
    return rows.groupBy("project_id", "rel_path").agg(
        F.count_if(child).alias("kids"), F.count_if(child & (c("kind") != "dir")).alias("files"), F.count_if("script").alias("scripts"),
        F.coalesce(F.bool_or(c("script") & c("name").rlike(r"^index\.[tj]sx?\z")), F.lit(False)).alias("index"),
        F.max(F.when(own, c("readable"))).alias("listed"), F.max(F.when(own, c("depth"))).alias("depth"), F.max(F.when(own | (c("role") > 1), c("name"))).alias("name"),
        F.max("which").alias("which"), F.count_if(c("role") == 3).alias("nested"),
        *[x for s in STYLES for x in (F.count_if(c("folder") & (c("style") == s)).alias("n_" + s), first_names(F.when(c("folder") & (c("style") == s), c("name")), 3).alias("names_" + s))],
        F.count_if(c("script") & (c("style") == "pascal")).alias("pascal"), F.count_if(c("script") & c("style").isin("kebab", "camel")).alias("other"),
        first_names(F.when(c("script") & (c("style") == "pascal"), c("name")), 2).alias("pascal_names"), first_names(F.when(other, c("name")), 2).alias("other_names"),
        F.array_sort(F.collect_list(F.when(c("concept").isNotNull(), F.struct("concept", "low")))).alias("concepts"),  # spellings of 43 words
        F.count_if("loose").alias("loose"), first_names(F.when(c("loose"), c("name")), 5).alias("loose_names"),
    )


def _found(limits: Limits) -> dict[str, Column]:
    """By rule (naming rules: by kind of entry) an array of a folder's issues, from ``folder_facts``."""
    c, path = F.col, F.col("rel_path")
    listed, folder = F.coalesce(c("listed"), F.lit(False)), _folder(path)
    one = lambda when, row: F.array_compact(F.array(F.when(when, row)))
    found = {
        "root-chaos": one(c("loose") > limits.root_files, issue_row(
            "root-chaos", F.lit("."), F.array_join("loose_names", ", "), F.format_string("%d source files lie loose in the project root. Move them into src/.", "loose"), file_count=c("loose"),
        )),
        "duplicate-concept": F.transform(
            F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(CONCEPTS) - 1)), lambda i: F.transform(F.filter("concepts", lambda x: x["concept"] == i), lambda x: x["low"])), lambda d: F.size(d) >= 2),
            lambda d: issue_row("duplicate-concept", folder, F.array_join(d, ", "), F.concat(F.lit("Folders for one purpose side by side: "), F.array_join(d, ", "), F.lit(". Keep one.")), duplicates=d),
        ),
        "deep-nesting": one(listed & (c("depth") > limits.max_depth), issue_row(
            "deep-nesting", path, path, F.format_string("Folder %s lies %d levels deep; import paths through it get long. Flatten it or add a path alias.", path, "depth"), depth=c("depth"),
        )),
        "fat-folder": one(c("files") > F.when(path == "", limits.fat_root).otherwise(limits.fat_folder), issue_row(
            "fat-folder", folder, F.format_string("%d files in one directory", "files"), F.format_string("Folder holds %d files without any grouping. Group them by concern.", "files"), file_count=c("files"),
        )),
        "empty-dir": one(listed & (path != "") & (c("kids") == 0), issue_row("empty-dir", folder, F.lit("(empty)"), F.lit("Folder holds nothing. Delete it."))),
    }
    target, why = (F.element_at(F.array(*[F.lit(m[k]) for m in MISPLACED]), c("which") + 1) for k in (2, 3))
    found["misplaced-file"] = one(c("which").isNotNull(), issue_row("misplaced-file", path, c("name"), F.concat(path, F.lit(": "), why, F.lit(".")), target_dir=target))
    styles = F.array_compact(F.array(*[F.when(c("n_" + s) > 0, F.lit(s)) for s in STYLES]))
    shown = F.array_join(F.array_compact(F.array(*[F.when(c("n_" + s) > 0, F.concat(F.lit(s + ": "), F.array_join("names_" + s, ", "))) for s in STYLES])), "  |  ")
    text = F.concat(F.lit("Subfolders mix naming styles: "), F.array_join(styles, ", "), F.lit(". Choose one."))
    found["naming of folders"] = one((sum(c("n_" + s) for s in STYLES) >= limits.naming_folders) & (F.size(styles) > 1), issue_row("naming-mismatch", folder, shown, text, styles=styles))
    shown = F.concat(F.lit("PascalCase: "), F.array_join("pascal_names", ", "), F.lit("  |  other: "), F.array_join("other_names", ", "))
    text = F.lit("Files mix PascalCase with kebab-case or camelCase. Choose one style by kind of file.")
    found["naming of files"] = one((c("scripts") >= limits.naming_files) & (c("pascal") > 0) & (c("other") > 0), issue_row("naming-mismatch", folder, shown, text))
    barrel = listed & F.lower("name").isin(*BARREL_DIRS) & (c("scripts") >= limits.barrel_files) & ~c("index")
    text = F.format_string("Folder %s has %d source files and no index file to import them through.", "name", "scripts")
    found["missing-barrel"] = one(barrel, issue_row("missing-barrel", F.concat(path, F.lit("/")), F.format_string("%d files, no index.ts", "scripts"), text, source_file_count=c("scripts")))
    text = F.format_string("Configuration file %s is nested; tools look for it at the project root.", "name")
    found["scattered-config"] = one(c("nested") > 0, issue_row("scattered-config", path, c("name"), text, target_dir=basename(path)))
    return found


def _issues(entries: DataFrame, limits: Limits, *rules: str) -> DataFrame:
    found = _found(limits)
    made = F.concat(*[found[r] for r in rules or found])
    return folder_facts(entries, limits).select("project_id", F.explode(made).alias("i")).select("project_id", "i.*")


def structural_issues(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All rules: the listing is read once and shuffled once, by folder."""
    return _issues(entries, limits)


def deep_nesting(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    rows = directories(entries).where(F.col("depth") > limits.max_depth).withColumn("listed", F.lit(True))
    return rows.select("project_id", F.explode(_found(limits)["deep-nesting"]).alias("i")).select("project_id", "i.*")


def fat_folder(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _issues(entries, limits, "fat-folder")


def naming_folders(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _issues(entries, limits, "naming of folders")


def naming_files(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _issues(entries, limits, "naming of files")


def misplaced_files(entries: DataFrame) -> DataFrame:
    rows = entries.where("kind <> 'dir'").withColumn("which", _which(F.col("name"), F.col("rel_path"))).where("which IS NOT NULL")
    return rows.select("project_id", F.explode(_found(Limits())["misplaced-file"]).alias("i")).select("project_id", "i.*")


def missing_barrel(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _issues(entries, limits, "missing-barrel")


def duplicate_concept(entries: DataFrame) -> DataFrame:
    return _issues(entries, Limits(), "duplicate-concept")


def empty_dirs(entries: DataFrame) -> DataFrame:
    return _issues(entries, Limits(), "empty-dir")


def root_chaos(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    return _issues(entries, limits, "root-chaos")


def scattered_config(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Nested configuration files; never reported in parity mode."""
    rows = entries.where("kind <> 'dir'").where(_nested_config(limits)).withColumn("nested", F.lit(1))
    return rows.select("project_id", F.explode(_found(limits)["scattered-config"]).alias("i")).select("project_id", "i.*")


def project_stats(entries: DataFrame) -> DataFrame:
    """Per project: files, directories (without the root), depth and KB (each file rounded half up)."""
    kb = F.floor(F.col("size") / 1024 + 0.5)
    return entries.groupBy("project_id").agg(
        F.count_if(F.col("kind") != "dir").alias("total_files"), F.count_if((F.col("kind") == "dir") & (F.col("rel_path") != "")).alias("total_dirs"),
        F.coalesce(F.max(F.when(F.col("kind") == "dir", F.col("depth"))), F.lit(0)).alias("max_depth"), F.coalesce(F.sum(F.when(F.col("kind") != "dir", kb)), F.lit(0)).cast("long").alias("total_kb"),
    )
