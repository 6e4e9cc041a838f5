"""Column builders over names, paths and source text.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming styles in the order they are tested; the first two look at the full name.
STYLES = (
    ("special", r"^[\[(]"),
    ("dotted", r"^\.[a-z]"),
    ("upper", r"^[A-Z][A-Z0-9_]*\z"),
    ("pascal", r"^[A-Z][a-zA-Z0-9]*\z"),
    ("kebab", r"^[a-z][a-z0-9]*(-[a-z0-9]+)*\z"),
    ("snake", r"^[a-z][a-z0-9]*(_[a-z0-9]+)*\z"),
    ("camel", r"^[a-z][a-zA-Z0-9]*\z"),
)
# Import forms.
_Q = "['\"`]"
IMPORT_FORMS = (
    rf"(?U)(?:import|export)\s[^'\"`]*?\sfrom\s*{_Q}([^'\"`]+){_Q}",
    rf"(?U)import\s*{_Q}([^'\"`]+){_Q}",
    rf"(?U)(?:import|require)\s*\(\s*{_Q}([^'\"`]+){_Q}\s*\)",
)


def detect_style(name: Column) -> Column:
    """Naming style of a file or folder name, up to two extensions left out."""
    base = F.regexp_replace(F.regexp_replace(name, r"\.[^.]+\z", ""), r"\.[^.]+\z", "")
    found = None
    for style, pattern in STYLES:
        hit = (name if style in ("special", "dotted") else base).rlike(pattern)
        found = F.when(hit, style) if found is None else found.when(hit, style)
    return found.otherwise("mixed")


def strip_comments(source: Column) -> Column:
    """Block comments go; line comments go unless a colon or quote precedes them."""
    # Fixed values.
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"(\A|[^:\"'`])//[^\n]*", "$1")


def import_specs(source: Column) -> Column:
    """Distinct import specifiers: by form, then by place."""
    return stripped_specs(strip_comments(source))


def stripped_specs(clean: Column) -> Column:
    """``import_specs`` of a source without comments."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(clean, F.lit(p), F.lit(1)) for p in IMPORT_FORMS]))


def deep_segments(spec: Column) -> Column:
    """Number of leading ``../``."""
    return (F.length(F.regexp_extract(spec, r"^((?:\.\./)+)", 1)) / 3).cast("int")


def normalize_path(path: Column) -> Column:
    """Folds ``.``, ``..`` and empty segments; clamps at the start."""
    start = F.array().cast("array<string>")
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc)
        .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def line_count(content: Column) -> Column:
    return F.when(content == "", 0).otherwise(F.size(F.split(content, "\n"))).cast("int")


def exports_something(content: Column) -> Column:
    return content.rlike(r"(?U)(?:\A|[\n;])\s*export\b")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.locate("/", path) > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise("")


def is_script(name: Column) -> Column:
    return name.rlike(r"\.[tj]sx?\z")


def first_number(text: Column) -> Column:
    """A blank and the first run of digits, or nothing: the version suffix of a label."""
    digits = F.regexp_extract(text, "([0-9]+)", 1)
    return F.when(digits != "", F.concat(F.lit(" "), digits)).otherwise("")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 65, "C").when(score >= 50, "D").otherwise("F")
