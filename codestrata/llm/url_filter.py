"""URL filters by given rules and, where none fits, by mined association rules.

DataFrame operations only.

* ``with_rules`` splits a url into host and path and finds the longest given
  rule that fits: a rule ``host/path`` fits its host and all subdomains if the
  url's path starts with the rule's.
* ``mine`` runs Spark's FP-growth over the tokens of labelled urls and their
  label, and keeps rules tokens -> label by confidence and support; a
  rule is dropped if a rule of fewer of its tokens says the same at least as
  surely.
* ``judge`` matches rules by an inverted index token -> rules.  A url's tokens
  are cut to the indexed ones, so many urls share one signature; only distinct
  signatures are matched.  The surest matching rule decides, then the one with
  more support, fewer tokens, and the first in order.

What is collected is bounded by support: at most (tokens of a url) / support
tokens can be in a rule.

Cases: a null url or one without ``://`` has empty host and path, no rule and no
token, and gets the default verdict; a url of any length and with any
characters (blanks too) is taken whole; repeated urls are judged alike; of rules
that tie the first in order decides; without labelled urls nothing is mined and
the default stands; an empty table gives an empty result; input columns named
like an output column are replaced, others are carried whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import ROW, column, rest_of
from .session import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MADE = ("host", "path", "rule", "verdict", "evidence")
#: Before a label among the items, which no token begins with.
_LABEL = "label="


@dataclass(frozen=True)
class UrlRule:
    pattern: str  # host/path
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        own, _, rest = self.pattern.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)


#: The rules of the registered query.
RULES = (
    UrlRule("org/", "allow"),
    UrlRule("example.org/es/", "block"),
    UrlRule("example.org/en/1", "block"),
    UrlRule("com/fr/", "allow"),
    UrlRule("com/de/", "block"),
)


def _rest(url: Column) -> Column:
    """What follows the first ://, else empty."""
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host labels, path segments (numbers by first
    digit and length), file extension, query keys, fragment."""
    rest = _rest(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    pieces = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    numbers = F.filter(pieces, lambda s: s.rlike("^[0-9]"))
    names = F.filter(pieces, lambda s: ~s.rlike("^[0-9]"))
    extension = F.regexp_extract(path_of(url), r"\.([a-z0-9]+)$", 1)
    none = F.array().cast("array<string>")
    found = F.concat(
        F.array(F.concat(F.lit("scheme="), F.translate(F.regexp_extract(url, "^([A-Za-z]*)://", 1), UPPER, LOWER))),
        F.transform(F.filter(F.split(host_of(url), r"\."), lambda s: s != ""), lambda s: F.concat(F.lit("host="), s)),
        F.transform(names, lambda s: F.concat(F.lit("seg="), s)),
        F.transform(numbers, lambda s: F.concat(F.lit("lead="), F.substr(s, F.lit(1), F.lit(1)))),
        F.transform(numbers, lambda s: F.concat(F.lit("digits="), F.length(F.regexp_extract(s, "^[0-9]+", 0)).cast("string"))),
        F.when(extension != "", F.array(F.concat(F.lit("ext="), extension))).otherwise(none),
        F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query="), F.regexp_extract(s, "^[^=]*", 0))),
        F.when(F.locate("#", rest) > 0, F.array(F.lit("fragment"))).otherwise(none),
    )
    return F.when(F.coalesce(F.locate("://", url), F.lit(0)) > 0, F.array_distinct(found)).otherwise(none)


def with_rules(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """``pages`` with host, path, rule and the rule's verdict (else null)."""
    pages = rest_of(pages, *MADE).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.pattern)):
        fits = r.fits(F.col("host"), F.col("path"))
        rule = F.when(fits, r.pattern) if rule is None else rule.when(fits, r.pattern)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return pages.withColumn("rule", rule if rules else F.lit(None).cast("string")).withColumn("verdict", verdict if rules else F.lit(None).cast("string"))


def _alike(scratch: Scratch, rows: DataFrame, least: float) -> DataFrame:
    """(first, tokens): frequent tokens by the rows they are in; those of exactly the same rows go together."""
    each = rows.select(F.explode("tokens").alias("token"), F.xxhash64("id").cast("decimal(38,0)").alias("h"))
    each = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).where(F.col("n") >= least)
    return scratch.keep(each.groupBy("n", "h").agg(F.min("token").alias("first"), F.array_sort(F.collect_list("token")).alias("tokens")), "alike")


def mine(scratch: Scratch, labelled: DataFrame, min_support: float = 0.02, min_confidence: float = 0.8, max_tokens: int | None = None) -> DataFrame:
    """Rules (key, tokens, label, support, confidence) from rows of tokens and label.

    ``key`` is the sorted tokens joined by a blank, to be read only; ``support``
    counts rows.  Of tokens that are in exactly the same rows only the first is
    mined, and its rules are copied for the others: a rule with two of them is
    never shorter than it could be."""
    rows = scratch.keep(labelled.select(F.monotonically_increasing_id().alias("id"), F.array_distinct("tokens").alias("tokens"), "label"), "labelled")
    alike = _alike(scratch, rows, min_support * rows.count())
    firsts = F.array(*[F.lit(r[0]) for r in alike.select("first").sort("first").collect()]).cast("array<string>")  # bounded by support
    items = rows.select(F.concat(F.array_intersect("tokens", firsts), F.array(F.concat(F.lit(_LABEL), "label"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(items).freqItemsets
    labels = F.filter("items", lambda x: x.startswith(_LABEL))
    rest = F.array_sort(F.filter("items", lambda x: ~x.startswith(_LABEL)))
    sets = sets.select(F.get(labels, F.lit(0)).alias("label"), rest.alias("tokens"), "freq").where((F.size("tokens") >= 1) & (F.size("tokens") <= (max_tokens or F.size("tokens"))))
    sets = scratch.keep(sets, "sets")
    whole = sets.where("label IS NULL").select("tokens", F.col("freq").alias("n"))
    rules = sets.where("label IS NOT NULL").join(whole, "tokens").select("tokens", F.expr(f"substring(label, {len(_LABEL) + 1})").alias("label"), F.col("freq").alias("support"), (F.col("freq") / F.col("n")).alias("confidence"))
    rules = scratch.keep(rules.where(F.col("confidence") >= min_confidence), "rules")
    # every proper subset of a rule's tokens: drop one token, and from those one more, ...
    smaller = rules.select("label", "confidence", "tokens", F.col("tokens").alias("part"))
    parts = None
    longest = rules.agg(F.max(F.size("tokens"))).first()[0] or 1
    for _ in range(longest - 1):
        smaller = smaller.where(F.size("part") > 1).select("tokens", "label", "confidence", F.explode(F.transform("part", lambda t: F.array_remove(F.col("part"), t))).alias("part")).distinct()
        parts = smaller if parts is None else parts.unionByName(smaller)
    if parts is not None:
        simple = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("_confidence"))
        needless = parts.join(simple, ["part", "label"]).where("_confidence >= confidence")
        rules = rules.join(needless.select("tokens", "label").distinct(), ["tokens", "label"], "left_anti")
    rules = scratch.keep(rules, "pruned")
    other = rules.select("label", "support", "confidence", F.col("tokens").alias("mined"), F.posexplode("tokens").alias("at", "first")).join(alike.select("first", F.col("tokens").alias("same")), "first")
    other = other.groupBy("label", "support", "confidence", "mined").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "same"))), lambda x: x.same).alias("choices"))
    every = F.expr("explode(aggregate(choices, array(cast(array() as array<string>)), (made, same) -> flatten(transform(made, x -> transform(same, y -> concat(x, array(y)))))))")
    rules = other.select(every.alias("tokens"), "label", "support", "confidence").withColumn("tokens", F.array_sort("tokens"))
    return scratch.keep(rules.select(F.array_join("tokens", " ").alias("key"), "tokens", "label", "support", "confidence"), "all_rules")


def judge(scratch: Scratch, pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` (with a verdict column) with each null verdict filled by the
    surest matching mined rule, whose key is ``evidence``, else by ``default``."""
    indexed = [r[0] for r in rules.select(F.explode("tokens").alias("t")).distinct().sort("t").collect()]  # bounded by support
    known = F.array(*[F.lit(t) for t in indexed]).cast("array<string>")
    decided = pages.where("verdict IS NOT NULL").withColumn("evidence", F.lit(None).cast("string"))
    open_ = pages.where("verdict IS NULL").select(F.struct(*[column(c) for c in pages.columns]).alias(ROW), F.array_sort(F.array_intersect(tokens(column(url)), known)).alias("_signature"))
    postings = rules.select(F.explode("tokens").alias("token"), F.col("tokens").alias("rule"), "key", "label", "support", "confidence", F.size("tokens").alias("size"))
    wanted = open_.select(F.col("_signature").alias("signature")).where(F.size("signature") > 0).distinct()
    hits = wanted.select("signature", F.explode("signature").alias("token")).join(postings, "token")
    full = hits.groupBy("signature", "rule", "key", "label", "support", "confidence", "size").agg(F.count(F.lit(1)).alias("n")).where("n = size")
    best = full.groupBy("signature").agg(F.min_by(F.struct("label", "key"), F.struct(-F.col("confidence"), -F.col("support"), "size", "key", "rule", "label")).alias("best"))
    best = scratch.keep(best.select(F.col("signature").alias("_signature"), F.col("best.label").alias("_label"), F.col("best.key").alias("_evidence")), "judged")
    done = open_.join(best, "_signature", "left")
    given = [F.coalesce(F.col("_label"), F.lit(default)).alias(c) if c == "verdict" else F.col(ROW).getField(c).alias(c) for c in pages.columns]
    return decided.unionByName(done.select(*given, F.col("_evidence").alias("evidence")))


def filter_urls(pages: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES, labelled: DataFrame | None = None, min_support: float = 0.02, min_confidence: float = 0.8, max_tokens: int | None = None, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict and evidence.

    ``labelled``: rows (url, label) to mine; by default the pages on which a
    given rule decides, with its verdict."""
    scratch = Scratch(pages.sparkSession, "urls")
    pages = rest_of(pages, *MADE)
    rows = pages.select(column(url).alias("url"), F.struct(*[column(c) for c in pages.columns]).alias("page"))
    ruled = with_rules(rows, "url", rules)
    if labelled is None:
        labelled = ruled.where("verdict IS NOT NULL").select("url", F.col("verdict").alias("label"))
    labelled = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(tokens(F.col("url")).alias("tokens"), "label")
    done = judge(scratch, ruled, mine(scratch, labelled, min_support, min_confidence, max_tokens), "url", default)
    return done.select(*[F.col("page").getField(c).alias(c) for c in pages.columns], *MADE)
