"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, bpe, decontaminate, embedding_dedup, hard_negatives, langid, license_scan, line_dedup, quality, secret_scan, simhash, token_counts, url_filter
from .session import table


#: Labelled rows that the quality classifier is fitted on, about.
QUALITY_ROWS = 8000


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return done.select("page_id", "host", "path", "rule", "verdict", "evidence")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secret_scan.scan(docs, secret_scan.fit(secret_scan.labelled_findings(spark)))
    masked = F.concat(F.substring("candidate", 1, 4), F.lit("..."), F.length("candidate").cast("string"))
    return found.select("doc_id", "word_no", masked.alias("masked"), F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "is_secret")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_passages(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.*")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, tokenizer_file(), packed=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold_of("doc_id", 4) == 2, F.lit(True))
    model = langid.fit(docs.select("doc_id", "text", "lang"), ~held_out)
    done = langid.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.dedup_lines(docs, repeated_ids=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(langid.fold_of("doc_id", 5) == 0, F.lit(True))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    chosen = langid.sampled(labels.where(~held_out & F.col("quality").isNotNull()).distinct(), ["doc_id"], QUALITY_ROWS, "quality")
    model = quality.fit(docs.join(F.broadcast(chosen), "doc_id"), sample_rows=QUALITY_ROWS)  # two numbers a row, each row once
    done = quality.score(docs, model)
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", moved))


OP2_SQL = r"""
WITH base AS (
  SELECT page_id, url, coalesce(instr(url, '://'), 0) > 0 AS ok,
         CASE WHEN coalesce(instr(url, '://'), 0) > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, url, ok, rest,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM base),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split),
tokens AS (
  SELECT DISTINCT page_id, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS label, unnest(list_concat(
    ['scheme=' || lower(regexp_extract(url, '^([A-Za-z]*)://', 1))],
    list_transform(list_filter(string_split(host, '.'), lambda s: s <> ''), lambda s: 'host=' || s),
    list_transform(list_filter(string_split(path, '/'), lambda s: s <> '' AND NOT regexp_matches(s, '^[0-9]')), lambda s: 'seg=' || s),
    list_transform(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^[0-9]')), lambda s: 'lead=' || s[1]),
    list_transform(list_filter(string_split(path, '/'), lambda s: regexp_matches(s, '^[0-9]')), lambda s: 'digits=' || length(regexp_extract(s, '^[0-9]+', 0))),
    CASE WHEN regexp_extract(path, '\.([a-z0-9]+)$', 1) <> '' THEN ['ext=' || regexp_extract(path, '\.([a-z0-9]+)$', 1)] ELSE [] END,
    list_transform(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: 'query=' || regexp_extract(s, '^[^=]*', 0)),
    CASE WHEN instr(rest, '#') > 0 THEN ['fragment'] ELSE [] END)) AS token
  FROM ruled WHERE ok),
labelled AS (SELECT page_id, label, token FROM tokens WHERE label IS NOT NULL),
least AS (SELECT ceil(0.02 * count(*)) AS n FROM ruled WHERE ok AND rule IS NOT NULL),
sets AS (
  SELECT label, token AS t1, NULL AS t2, NULL AS t3, 1 AS size FROM labelled
  UNION ALL SELECT a.label, a.token, b.token, NULL, 2 FROM labelled a JOIN labelled b ON a.page_id = b.page_id AND a.token < b.token
  UNION ALL SELECT a.label, a.token, b.token, c.token, 3 FROM labelled a JOIN labelled b ON a.page_id = b.page_id AND a.token < b.token
    JOIN labelled c ON b.page_id = c.page_id AND b.token < c.token),
counted AS (SELECT label, t1, t2, t3, size, concat_ws(' ', t1, t2, t3) AS key, count(*) AS support FROM sets GROUP BY ALL),
rules AS (
  SELECT * FROM (SELECT *, support / sum(support) OVER (PARTITION BY key) AS confidence FROM counted)
  WHERE support >= (SELECT n FROM least) AND confidence >= 0.8),
pruned AS (
  SELECT r.* FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules s WHERE s.label = r.label AND s.confidence >= r.confidence AND s.size < r.size
      AND list_has_all([r.t1, r.t2, r.t3], list_filter([s.t1, s.t2, s.t3], lambda x: x IS NOT NULL)))),
postings AS (SELECT key, label, size, support, confidence, unnest(list_filter([t1, t2, t3], lambda x: x IS NOT NULL)) AS token FROM pruned),
hits AS (
  SELECT t.page_id, p.key, p.label, p.size, p.support, p.confidence FROM tokens t JOIN postings p USING (token)
  WHERE t.rule IS NULL GROUP BY ALL HAVING count(*) = p.size),
best AS (
  SELECT page_id, label, key FROM hits
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, support DESC, size, key, label) = 1)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN r.rule IN ('org/', 'com/fr/') THEN 'allow' WHEN r.rule IS NOT NULL THEN 'block' ELSE coalesce(b.label, 'allow') END AS verdict,
       b.key AS evidence
FROM ruled r LEFT JOIN best b ON r.page_id = b.page_id
"""

OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings
  UNION SELECT reach.node, links.b FROM reach JOIN links ON reach.other = links.a),
named AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, n.component_id, e.vec_id = n.component_id AS kept
FROM embeddings e JOIN named n ON e.vec_id = n.node LEFT JOIN counted c ON e.vec_id = c.a
"""

OP9_SQL = r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM parts),
hot AS (
  SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (
  SELECT keyed.*, hot.k IS NOT NULL AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Ten rounds, one common table expression each: clusters a, distances, centroids c.
OP11_SQL = """
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT row_number() OVER () AS r, vec_id, e FROM kept),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, e) - 1 AS INT) AS c, e AS m FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h NULLS LAST, e LIMIT 8)),
""" + "".join(f"""
a{i} AS MATERIALIZED (SELECT r, vec_id, e, unnest(best) FROM (
  SELECT r, vec_id, any_value(e) AS e, min({{'d': CAST(list_sum(list_transform(list_zip(e, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c}}) AS best
  FROM v, c{i} GROUP BY r, vec_id)),
n{i} AS (SELECT c, n, list((s - ((s % n) + n) % n) // n ORDER BY k) AS m FROM (
  SELECT c, k, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS k FROM a{i}) GROUP BY c, k) GROUP BY c, n),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} ON c{i}.c = n{i}.c),
""" for i in range(11)) + """
done AS (SELECT vec_id, c, d, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia FROM a10)
SELECT vec_id, c AS cluster, d AS distance, cluster_inertia, inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM done JOIN c10 USING (c)
"""

OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT ar, anchor_id, br, id AS positive_id, score AS positive_score FROM scored WHERE same AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY score DESC, id) AS rank, id AS negative_id, positive_score, score AS negative_score
  FROM positives p JOIN scored s ON p.ar = s.ar AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_url_filter": op2_url_filter,
        "op3_secret_scan": op3_secret_scan,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_decontamination": op5_decontamination,
        "op6_bpe": op6_bpe,
        "op7_simhash": op7_simhash,
        "op8_language_id": op8_language_id,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality": op10_quality,
        "op11_ball_kmeans": op11_ball_kmeans,
        "op12_token_counts": op12_token_counts,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_embedding_dedup": OP4_SQL, "op9_line_dedup": OP9_SQL, "op11_ball_kmeans": OP11_SQL, "op13_hard_negatives": OP13_SQL}
