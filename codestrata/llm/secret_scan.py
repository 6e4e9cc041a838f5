"""Secret scan: candidates by pattern, false positives removed by a random forest.

DataFrame operations and Spark ML only.

A candidate is a run of 16 or more letters, digits and ``_+/-`` that has a
letter and a digit (access key ids need no digit; the lines of a key block are
such runs), inside a word (words are split at blanks); or a token of parts with
dots between them that begins like one (``DOTTED``); or the password of a url's
``user:password@``; or the value, of any length and alphabet up to a blank or
quote, after a name such as password or api_key and = or : (in the same word or
the word before).  A run inside such a value is not a candidate of its own.  Its
features are length, character transitions, dictionary coverage, character
classes, the path it was found in and the words on both sides of its own place.
A random forest, trained on labelled findings with the same features, gives each
candidate a score.

``labelled_findings`` makes findings of known kind (keys and passwords in use;
hashes, identifiers, placeholders and the like) from numbers by hash functions,
for want of a public labelled table; ``fit`` takes any table of its shape.

Nothing is shuffled or collected in a scan; texts without a candidate are
dropped by one pattern before they are split into words.

Cases: null and empty texts give no row; a text of any length is split whole;
each candidate of a word gives a row with its own surroundings, repeats
included; a score of exactly the threshold is a secret; a null path counts as
empty; an empty table gives an empty result; columns other than the key, text
and path are not carried, so none can clash.
"""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import Scratch

_RUN = "[A-Za-z0-9_+/-]"
CANDIDATE = rf"(?<!{_RUN})(?:(?=[0-9_+/-]*[A-Za-z])(?=[A-Za-z_+/-]*[0-9]){_RUN}{{16,}}={{0,2}}|A[KS]IA[A-Z0-9]{{16}}(?!{_RUN}))"
#: Tokens of several parts, and passwords in urls.
DOTTED = rf"(?<!{_RUN})(?:eyJ[A-Za-z0-9_-]{{5,}}\.[A-Za-z0-9_-]{{5,}}(?:\.[A-Za-z0-9_-]+)?|SG\.[A-Za-z0-9_-]{{16,}}\.[A-Za-z0-9_-]{{16,}}|ya29\.[A-Za-z0-9_-]{{16,}})"
IN_URL = r"://[^\s/:@\"'`]*:([^\s/@\"'`]+)@"
#: Names that a secret is assigned to, and the value of any length and alphabet after one.
_NAME = r"(?:passw(?:or)?d|passphrase|pwd|token|secret|credentials?|(?<![A-Za-z])(?:[A-Za-z0-9]*[_-])?(?:api|access|private|signing|auth|secret)?key)s?[0-9]*[\"'`\])]*"
_SIGN = r"(?::=|=>|==?|:)"
# possessive: nothing follows it, and a plain + would recurse at each change between basic and supplementary characters
_VALUE = r"(?:(?!&\w+=)[^\s\"'`])++"
ASSIGNED = rf"(?i){_NAME}{_SIGN}[\"'`]?({_VALUE})"
#: The end of the words before, where the value is a word of its own; and where any text may hold such a value.
ANNOUNCED = rf"(?i)(?:{_NAME}\s?{_SIGN}|(?:passw(?:or)?d|passphrase|pwd|token|secret) is)$"
HOLDS_VALUE = rf"(?i)(?:{_NAME}[\x20\x09-\x0D]*{_SIGN}|(?:passw(?:or)?d|passphrase|pwd|token|secret)[\x20\x09-\x0D]+is[\x20\x09-\x0D])"
#: Characters of a candidate's surroundings that are looked at, in its word and in the words on either side.
AROUND = 256
PIECE = 1024
BLANKS = r"[\x20\x09-\x0D]+"
#: Words that make a string look written by a person.
DICTIONARY = (
    "access account action address admin alpha article backup basic beta blank block board branch build button cache category change "
    "class client cloud column commit config content control count create current daily data date default delete demo detail device "
    "document domain draft dummy email empty entry error event example export feature field file final folder foobar form format front "
    "gallery general global google group guide handler header home html http image import index info input internal item join label large "
    "latest layout level library license line link list local login logo main manager media member menu message method model module month "
    "name network node normal note number object option order output package page panel parent password path photo placeholder plan "
    "player plugin point policy post price primary print private process product profile project public query random read record redacted "
    "region release report request resource response result root sample schema screen script search section secret select server service "
    "session setting simple site size small source start state static status stream string style summary support system table target task "
    "template test text theme thumb title token total type update upload user value version video view volume week widget window world year your"
).split()
CUES = "token|secret|passw|passwd|pwd|apikey|api_key|api-key|auth|bearer|credential|private|access_key|accesskey|signing"
AGAINST = "example|sample|dummy|test|placeholder|sha1|sha256|sha512|md5|checksum|digest|commit|revision|uuid|guid|etag|hash|isbn|version|build|file|image|slug|trace|span"
PREFIX = "^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|sk-|rk_live_|xox[abps]-|AIza|eyJ|SG_|hf_|npm_)"
FEATURES = (
    "length transitions consonant_vowel coverage digit_share upper_share hex_share distinct_share longest_repeat known_prefix "
    "cue_near against_near cue_after against_after key_block in_url assigned quoted path_test path_config path_depth"
).split()


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def with_features(found: DataFrame) -> DataFrame:
    """Features of rows with candidate, ahead and behind (what its word has on
    either side), before and after (words, joined by a blank) and path; of each
    the nearest ``AROUND`` characters."""
    c = F.col("candidate")
    ahead = F.col("ahead")
    near = F.lower(F.concat_ws(" ", "before", ahead))
    next_ = F.lower(F.concat_ws(" ", "behind", "after"))
    path = F.lower(F.coalesce("path", F.lit("")))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    change = "(?<=[a-z])(?=[A-Z0-9_+/=-])|(?<=[A-Z])(?=[a-z0-9_+/=-])|(?<=[0-9])(?=[A-Za-z_+/=-])|(?<=[_+/=-])(?=[A-Za-z0-9])"
    left = F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    made = {
        "length": F.length(c).cast("double"),
        "transitions": F.regexp_count(c, F.lit(change)) / F.greatest(F.length(c) - 1, F.lit(1)),
        "consonant_vowel": _share(F.lower(c), "[bcdfghjklmnpqrstvwxz][aeiouy]"),
        "coverage": 1 - left / F.length(c),
        "digit_share": _share(c, "[0-9]"),
        "upper_share": _share(c, "[A-Z]"),
        "hex_share": _share(c, "[0-9a-f]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(36)),
        "longest_repeat": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(.)\1+"), F.lit(0)), F.length)), F.lit(1)).cast("double"),
        "known_prefix": flag(c.rlike(PREFIX)),
        "cue_near": flag(near.rlike(CUES)),
        "against_near": flag(near.rlike(AGAINST)),
        "cue_after": flag(next_.rlike(CUES)),
        "against_after": flag(next_.rlike(AGAINST)),
        "key_block": flag(near.rlike("key-----|(^| )[a-z0-9+/]{60,}$|(^| )[a-z0-9+/]{60,} $")),
        "in_url": flag(ahead.rlike("://[^/@]*:$") & F.col("behind").startswith("@")),
        "assigned": flag(near.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(ahead.rlike("[\"'`]$")),
        "path_test": flag(path.rlike("test|example|sample|fixture|mock|doc|spec")),
        "path_config": flag(path.rlike("config|env|secret|deploy|credential|settings")),
        "path_depth": F.length(F.regexp_replace(path, "[^/]", "")).cast("double"),
    }
    return found.withColumns(made)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a column that a lambda function refers to may be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(found: str, pattern: str) -> Column:
    """The strings of an array column, all matches of ``pattern`` in ``word``, with
    their places: running sums of the lengths of matches and of what lies between."""
    between = F.transform(F.split("word", pattern, -1), F.length)
    sizes = F.zip_with(F.col(found), between, lambda x, gap: F.struct(F.coalesce(F.length(x), F.lit(0)).alias("size"), gap.alias("gap")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("places"))
    step = lambda made, x: F.struct((made["next"] + x["gap"] + x["size"]).alias("next"), F.array_append(made["places"], made["next"] + x["gap"]).alias("places"))
    places = F.aggregate(sizes, start, step, lambda made: made["places"])
    placed = F.zip_with(F.col(found), F.slice(places, 1, F.size(found)), lambda x, at: F.struct(x.alias("c"), at.alias("at")))
    return F.when(F.size(found) == 0, F.array().cast("array<struct<c:string,at:int>>")).otherwise(placed)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", context: int = 3) -> DataFrame:
    """(key, path, word_no, candidate, ahead, behind, before, after) of every candidate."""
    # plain strings that the costly patterns cannot do without are looked for first
    has = lambda *parts: functools.reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in parts])
    named = functools.reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(x)) for x in ("pass", "pwd", "token", "secret", "credential", "key")])
    holds = F.col(text).rlike(CANDIDATE) | (named & F.col(text).rlike(HOLDS_VALUE)) | (has("eyJ", "SG.", "ya29.") & F.col(text).rlike(DOTTED)) | (has("://") & F.col(text).rlike(IN_URL))
    rows = docs.where(holds).select(F.col(key), F.col(path).cast("string").alias("path"), F.split(text, BLANKS).alias("_words"))
    back = lambda i, n: F.when(i >= n, F.get("_words", i - n)).otherwise("")
    announced = lambda i: back(i, 1).rlike(r"[:=>]$|^is$") & F.concat_ws(" ", back(i, 2), back(i, 1)).rlike(ANNOUNCED)
    hit = F.filter(F.transform("_words", lambda w, i: F.when(w.rlike(CANDIDATE) | w.rlike(ASSIGNED) | w.rlike(DOTTED) | w.rlike(IN_URL) | announced(i), i)), lambda i: i.isNotNull())
    rows = rows.select("*", F.explode(hit).alias("word_no"))
    first = F.greatest(F.col("word_no") - context, F.lit(0))
    before = F.right(F.array_join(F.slice("_words", first + 1, F.col("word_no") - first), " "), F.lit(AROUND))
    after = F.left(F.array_join(F.slice("_words", F.col("word_no") + 2, F.lit(context)), " "), F.lit(AROUND))
    rows = rows.select(key, "path", "word_no", F.get("_words", F.col("word_no")).alias("word"), before.alias("before"), after.alias("after"))
    whole = F.regexp_extract("word", rf"^[\"'`]?({_VALUE})", 1)
    last = F.element_at(F.split("before", " "), -1)
    told = last.rlike(r"[:=>]$|^is$") & F.col("before").rlike(ANNOUNCED)
    extract = lambda pattern, group: F.regexp_extract_all("word", F.lit(pattern), F.lit(group))
    rows = rows.withColumns({"_runs": extract(CANDIDATE, 0), "_dotted": extract(DOTTED, 0), "_sets": extract(ASSIGNED, 0), "_values": extract(ASSIGNED, 1), "_urls": extract(IN_URL, 0), "_inner": extract(IN_URL, 1)})
    rows = rows.withColumns({c: _placed(c, p) for c, p in (("_runs", CANDIDATE), ("_dotted", DOTTED), ("_sets", ASSIGNED), ("_urls", IN_URL))})
    # a value is the end of what its pattern matched; punctuation after it is none of its own
    value = F.expr("zip_with(_sets, _values, (s, v) -> struct(v as c, s.at + length(s.c) - length(v) as at))")
    inner = F.expr("zip_with(_urls, _inner, (s, v) -> struct(v as c, s.at + length(s.c) - length(v) - 1 as at))")
    kind = "array<struct<c:string,at:int>>"
    opened = F.length(F.regexp_extract("word", "^[\"'`]?", 0)) + 1
    alone = F.when(told & (F.size("_values") == 0), F.array(F.struct(whole.alias("c"), opened.alias("at")))).otherwise(F.array().cast(kind))
    rows = rows.withColumn("_told", F.concat(value.cast(kind), alone.cast(kind)))
    rows = rows.withColumn("_told", F.filter(F.transform("_told", lambda x: F.struct(F.regexp_replace(x.c, r"[,;.)\]}>]+$", "").alias("c"), x.at.alias("at"))), lambda x: x.c.rlike("[A-Za-z0-9]")))
    # surroundings come from the pieces of the word around them, and the word itself is left behind: neither grows with it
    pieces = F.regexp_extract_all("word", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    inside = lambda x, held: F.exists(held, lambda v: (v["at"] <= x["at"]) & (x["at"] + F.length(x["c"]) <= v["at"] + F.length(v["c"])))

    def surrounded(x: Column, cut: Column) -> Column:
        near = lambda at: F.array_join(F.slice(cut, F.greatest(F.floor((at - 1) / PIECE).cast("int"), F.lit(1)), F.lit(3)), "")
        local = lambda at: at - F.greatest(F.floor((at - 1) / PIECE).cast("int") - 1, F.lit(0)) * PIECE
        end = x["at"] + F.length(x["c"])
        ahead = F.right(F.substring(near(x["at"]), F.lit(1), local(x["at"]) - 1), F.lit(AROUND))
        return F.struct(x["c"].alias("candidate"), ahead.alias("ahead"), F.substring(near(end), local(end), F.lit(AROUND)).alias("behind"))

    def joined(v: Column) -> Column:
        told = F.concat(v["told"], F.filter(v["more"], lambda x: ~inside(x, v["told"])))
        return _once(F.struct(told.alias("told"), v["runs"].alias("runs"), v["cut"].alias("cut")), lambda u: F.transform(
            F.concat(F.filter(u["runs"], lambda x: ~inside(x, u["told"])), u["told"]), lambda x: surrounded(x, u["cut"]),
        ))

    more = F.concat(inner.cast(kind), F.col("_dotted").cast(kind))
    parts = F.struct(F.col("_told").cast(kind).alias("told"), more.alias("more"), F.col("_runs").cast(kind).alias("runs"), pieces.alias("cut"))
    rows = rows.select(key, "path", "word_no", F.explode(_once(parts, joined)).alias("_m"), "before", "after")
    return rows.select(key, "path", "word_no", "_m.candidate", "_m.ahead", "_m.behind", "before", "after")


def labelled_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """``rows`` findings of known kind, the same in every run: candidate, ahead,
    behind, before, after, path and label (1: a secret)."""
    drawn = spark.range(0, rows, 1, 4)

    def once(value: Column) -> Column:
        """What many kinds use is a column of its own, computed once a row."""
        nonlocal drawn
        name = f"_{len(drawn.columns)}"
        drawn = drawn.withColumn(name, value)
        return F.col(name)

    h = once(F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256))
    part = lambda lo, n: F.conv(F.substring(h, lo, n), 16, 10).cast("long")
    pick = lambda lo, *values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (part(lo, 4) % len(values) + 1).cast("int"))
    base64 = once(F.regexp_replace(F.base64(F.unhex(F.sha2(h, 256))), "=", ""))
    base32 = once(F.translate(F.upper(F.sha2(F.concat(h, F.lit("b")), 256)), "0189BD", "QXZWKM"))
    names = F.array(*[F.lit(w) for w in DICTIONARY])
    word = lambda lo: F.element_at(names, (part(lo, 5) % len(DICTIONARY) + 1).cast("int"))
    made_up = once(F.substring(F.translate(F.sha2(F.concat(h, F.lit("w")), 256), "0123456789", "aeioutnsrl"), 1, 6))
    plain = once(pick(50, "the", "of und that", "les de la", "to be with", "que el", made_up, F.concat_ws(" ", word(40), word(45))))
    cue = once(pick(54, "token =", "api_key:", "secret =", "password is", "export AUTH_TOKEN", "bearer", "private key", "credential"))
    against = once(pick(58, "commit", "sha256", "md5 checksum", "uuid", "image file", "build version", "example token =", "trace id", "etag hash"))
    hexed = once(F.substring(h, 1, (part(60, 4) % 33 + 16).cast("int")))
    uuid = once(F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)))
    slug = once(F.concat_ws("-", word(5), word(10), word(15), (part(20, 3) % 2030).cast("string"), word(25)))
    snake = once(F.concat_ws("_", word(5), word(10), made_up, (part(20, 3) % 100).cast("string"), word(30)))
    fake = once(F.concat_ws("_", F.lit("your"), word(5), pick(8, "token", "secret", "key", "password"), F.lit("here"), (part(20, 3) % 100).cast("string")))
    flat = once(F.concat(F.repeat(pick(9, "x", "0", "a", "ab12", "A"), 20), F.lit("1a")))
    said = once(pick(62, "password:", "pwd:", "the password is", "passwd =", "secret =", "db_password:", "token:"))
    set_to = once(pick(7, "password=", "pwd=", "passwd:", "DB_PASSWORD=", "secret=", "token="))
    cased = once(F.concat(F.upper(F.substring(made_up, 1, 1)), F.substring(made_up, 2, 4)))
    number = once((part(20, 3) % 2030).cast("string"))
    mixed = once(F.substring(base64, 1, (part(24, 4) % 8 + 8).cast("int")))
    marked = once(F.concat(F.translate(cased, "aeiost", "@31057"), number, pick(28, "!", "#", "$x", "%", "?!", "*")))
    letters = once(F.substring(F.translate(F.sha2(F.concat(h, F.lit("l")), 256), "0123456789", "ghjkmnpqrs"), 1, (part(24, 4) % 20 + 8).cast("int")))
    simple = once(F.concat(F.substring(made_up, 1, (part(32, 2) % 3 + 4).cast("int")), (part(20, 3) % 1000).cast("string")))
    empty = once(pick(28, "null", "none", "true", "false", "required", "changeme", "***x***", "<password>", "${PASSWORD}", "xxxxxxxx", "string", "str", "os.environ['KEY']", "get_password()", "optional"))
    said_after = once(pick(3, "is the token", "as api key", "is my password", "(secret)", "is the access_key to"))
    told_after = once(pick(3, "is the commit", "(sha256)", "checksum of it", "as trace id", "is the image hash", "of this build"))
    jwt = once(F.concat(F.lit("eyJ"), F.substring(base64, 1, 12), F.lit("."), F.substring(base64, 13, (part(24, 2) % 20 + 8).cast("int")), F.lit("."), F.substring(hexed, 1, 14)))
    line = once(F.concat(base64, F.substring(F.base64(F.unhex(F.sha2(F.concat(h, F.lit("k")), 256))), 1, 21)))
    at_host = once(pick(7, "postgres://app:", "https://user:", "amqp://guest:", "mongodb+srv://svc:"))
    # written between steps: the expressions of all kinds are too long for one generated function
    scratch = Scratch(spark, "findings")
    word5, word10, word15, word33 = (once(word(lo)) for lo in (5, 10, 15, 33))
    kinds = [  # label, candidate, text before it in its word, words before; for some also the words after
        (1, hexed, F.lit(""), plain, said_after), (1, base64, F.lit(""), plain, said_after), (0, hexed, F.lit(""), plain, told_after), (0, base64, F.lit(""), plain, told_after),
        (1, jwt, pick(7, "", "Bearer", '"'), pick(11, plain, cue)), (1, line, F.lit(""), F.lit("RSA PRIVATE KEY-----")), (1, line, F.lit(""), F.concat_ws(" ", F.reverse(line), line)),
        (1, mixed, at_host, plain), (1, marked, at_host, plain), (1, letters, at_host, plain), (0, empty, at_host, plain), (0, F.lit("password"), at_host, plain),
        (1, hexed, F.lit('"'), cue), (1, hexed, pick(7, "password=", "token=", "secret:", "pwd="), plain), (1, base64, F.lit('"'), cue),
        (1, base64, pick(7, "password=", "token=", "apikey="), plain), (1, F.concat(F.lit("AKIA"), F.substring(base32, 1, 16)), F.lit(""), plain),
        (1, F.concat(pick(7, "ghp_", "sk_live_", "xoxb-", "AIza", "hf_"), F.substring(base64, 1, 36)), F.lit(""), plain),
        (0, hexed, F.lit(""), against), (0, hexed, F.lit(""), plain), (0, uuid, F.lit(""), pick(7, against, plain)), (0, slug, pick(7, "", "/", '"'), pick(11, plain, cue)),
        (0, snake, pick(7, "", "=", '"'), pick(11, plain, cue)), (0, fake, pick(7, "token=", '"', "password="), pick(11, plain, cue)), (0, flat, pick(7, "", "token=", '"'), pick(11, plain, cue, against)),
        (1, mixed, set_to, plain), (1, mixed, F.lit('"'), said), (1, marked, set_to, plain), (1, marked, pick(7, "", '"'), said), (1, letters, set_to, plain), (1, letters, pick(7, "", '"'), said),
        (1, simple, set_to, plain), (1, simple, pick(7, "", '"'), said), (0, empty, set_to, plain), (0, empty, pick(7, "", '"'), said), (0, word5, set_to, plain), (0, word5, pick(7, "", '"'), said),
        (0, F.concat_ws("_", word5, word10), set_to, plain), (0, F.concat_ws(".", word5, word10, word15), pick(7, "", set_to), said), (0, pick(32, "the", "a", "not", "stored", "expired", "wrong", "sent", "valid", "in", "that", "to", "used", "hashed", "optional"), F.lit(""), said),
    ]
    n = F.col("id") % len(kinds)
    choose = lambda k: F.element_at(F.array(*[kind[k] for kind in kinds]), (n + 1).cast("int"))
    label = F.element_at(F.array(*[F.lit(float(kind[0])) for kind in kinds]), (n + 1).cast("int"))
    after = F.element_at(F.array(*[kind[4] if len(kind) > 4 else pick(55, made_up, plain, word33, told_after if kind[0] else plain) for kind in kinds]), (n + 1).cast("int"))
    path = pick(21, "src0", "app/config/settings.env", "tests/fixtures/a.txt", "docs/example.md", "deploy/secrets.yml", "src/main.py", "")
    rows_ = scratch.keep(drawn, "pieces").select("id", choose(1).alias("candidate"), choose(2).alias("ahead"), choose(3).alias("before"), after.alias("after"), path.alias("path"), label.alias("label"))
    rows_ = scratch.keep(rows_, "rows").withColumn("behind", F.when(F.col("ahead").contains("://"), "@db.internal/x").otherwise('"'))
    word_ = F.concat("ahead", "candidate", "behind")
    assigned = word_.rlike(ASSIGNED) | word_.rlike(IN_URL) | F.col("before").rlike(ANNOUNCED)
    return rows_.where(F.col("candidate").rlike(CANDIDATE) | F.col("candidate").rlike(DOTTED) | assigned)


def fit(findings: DataFrame, trees: int = 20, depth: int = 9, seed: int = 7) -> PipelineModel:
    """A random forest over labelled findings (columns as in ``labelled_findings``)."""
    made = Scratch(findings.sparkSession, "features").keep(with_features(findings), "rows")  # read by every level of the trees
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", featuresCol="features", labelCol="label")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(made)


def scan(docs: DataFrame, model: PipelineModel, key: str = "doc_id", text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: key, path, word_no, candidate, score (0 to 1) and is_secret."""
    scored = model.transform(with_features(candidates(docs, key, text, path)))
    scored = scored.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(key, "path", "word_no", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))
