"""Ball k-means, token counts by chunks, hard negatives: against plain versions of their rules."""

import hashlib
import random

import numpy as np
import pytest
from codestrata.llm import ball_kmeans, hard_negatives, queries, token_counts
from pyspark.sql import functions as F

VECTORS = "vec_id long, embedding array<float>, label int"


def random_vectors(n, dim=64, seed=0, spread=0.2):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((6, dim))
    x = heads[rng.integers(0, 6, n)] + spread * rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def messy_vectors(spark, dim, n=400, extra=""):
    """Copies (a third of all rows), repeated ids, nulls in every column, wrong lengths, non-finite and huge components."""
    x = random_vectors(n, dim).tolist()
    rows = [(i, v if i % 3 else x[0], i % 4) for i, v in enumerate(x)] + [(5, x[5], 1), (5, x[6], 1), (None, x[7], 2), (9_000, None, 1), (9_001, x[8], None)]
    rows += [(9_002, [], 1), (9_003, x[9][:-1], 1), (9_004, [float("nan")] + x[9][1:], 1), (9_005, [float("inf")] + x[9][1:], 1), (9_006, [None] + x[9][1:], 1), (9_007, [0.0] * dim, 1), (9_008, [3e37] + x[9][1:], 1), (9_100, x[10], 3)]
    return spark.createDataFrame([r + ("clash",) * extra.count(" string") for r in rows], VECTORS + extra)


# --- 11 ball k-means ------------------------------------------------------------------------------


def plain_kmeans(rows, k, rounds, dim, scale=1024, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [max(-ball_kmeans.LARGEST, min(ball_kmeans.LARGEST, int(np.floor(scale * float(c))))) for c in v], [float(c) for c in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[2]))
    centroids = [r[1] for r in order[:k]]
    for turn in range(rounds + 1):
        found = []
        for _, x, _ in kept:
            found.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)))
        if turn < rounds:
            for j in range(len(centroids)):
                own = [x for (_, x, _), (_, c) in zip(kept, found) if c == j]
                if own:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    inertia = [sum(d for d, c in found if c == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, inertia[c], sum(inertia), names[c]) for (i, _, _), (d, c) in zip(kept, found)], key=repr)


@pytest.mark.parametrize("k,rounds", [(8, 10), (3, 1), (40, 4)])
def test_clusters_equal_plain_kmeans(spark, k, rounds):
    vectors = messy_vectors(spark, 8, 300, ", cluster string, Distance string")
    got = sorted(map(tuple, ball_kmeans.cluster_vectors(vectors.repartition(3), k=k, rounds=rounds, dim=8).collect()), key=repr)
    assert got == plain_kmeans([(r.vec_id, r.embedding) for r in vectors.collect()], k, rounds, 8)


def test_clusters_of_few_none_and_equal_vectors(spark):
    one = [0.5, -0.25]
    same = spark.createDataFrame([(i, one, 0) for i in range(50)], VECTORS)
    got = ball_kmeans.cluster_vectors(same, dim=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 50
    assert ball_kmeans.cluster_vectors(same.limit(2), dim=2).count() == 2
    none = ball_kmeans.cluster_vectors(same, dim=64)
    assert none.count() == 0 and none.columns == ball_kmeans.cluster_vectors(same, dim=2).columns


def test_balls_leave_most_comparisons_out_and_agree_with_all():
    x = ball_kmeans.quantised(random_vectors(5000, 16, 1, 0.05), 1024)
    centroids = np.stack([x[:200][np.linalg.norm(x[:200] - x[i], axis=1).argmin()] for i in range(0, 120)]).astype(np.int64)
    cluster, near = ball_kmeans.nearest(x, centroids)
    totals = ball_kmeans.Totals(len(centroids), 16)
    totals.add(x, cluster, near)
    compared = []
    for _ in range(6):
        centroids, radii = ball_kmeans._moved(centroids, totals.kept)
        cluster, near, n = ball_kmeans.reassign(x, cluster, centroids, ball_kmeans.between(centroids), radii)
        whole, least = ball_kmeans.nearest(x, centroids)
        assert (cluster == whole).all() and (near == least).all()
        totals = ball_kmeans.Totals(len(centroids), 16)
        totals.add(x, cluster, near)
        compared.append(n)
    assert max(compared) < 5000 * 120 / 3


# --- 12 token counts ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return token_counts.bpe_model(queries.tokenizer_file("piece_bpe_32k.model"))


def test_splices_are_exact_wherever_chunks_are_cut(model):
    rng = random.Random(4)
    parts = ["y", "yy", " ", "  ", "ab", "日本", "é", "\n", "<s>", "▁", "the ", "x", " \t", "　", "ing", "\U0001f600"]
    joined = 0
    for _ in range(400):
        text = "".join(rng.choice(parts[: rng.randint(1, len(parts))]) for _ in range(rng.randint(20, 500)))
        normal, overlap = model.normal(text), rng.choice([8, 16, 32])
        pieces = [token_counts.encode_chunk(model, normal[a:b], a, c, d, overlap) for a, b, c, d in token_counts.chunks_of(normal, 4 * overlap, overlap)]
        n = token_counts.splice(pieces)
        assert n in (None, len(model.whole.encode(text)))
        joined += n is not None and len(pieces) > 1
    assert joined > 100


def test_counts_of_messy_texts_by_small_chunks(spark, messy, model):
    runs = ["ab " * 900 + "y" * n + " é日" * 300 for n in (10, 401, 3000)] + [" " * 5000, "é" * 3001, "\U0001f600" * 999]
    docs = messy.unionByName(spark.createDataFrame([(50 + i, t) for i, t in enumerate(runs * 2)], "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumn("Over_Limit", F.lit("clash")).withColumn("h1", F.lit("kept")).repartition(3)
    got = token_counts.count_tokens(docs, queries.tokenizer_file("piece_bpe_32k.model"), limit=500, chunk_bytes=128, overlap_bytes=16)
    want = [(r.doc_id, len((r.text or "").encode()), len(model.whole.encode(r.text or "")), r.h1) for r in docs.collect()]
    want = sorted([(*w[:3], w[2] > 500, w[3]) for w in want], key=repr)
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.h1) for r in got.collect()], key=repr) == want
    assert "text" not in got.columns and "lang" in got.columns


def test_counts_of_no_documents_and_of_other_models(spark, empty_docs, tmp_path):
    assert token_counts.count_tokens(empty_docs, queries.tokenizer_file("piece_bpe_32k.model")).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(empty_docs, "x", chunk_bytes=100, overlap_bytes=50)


def test_counts_query_equals_the_library(spark, model):
    docs = {r.doc_id: r.text for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = queries.op12_token_counts(spark, "/root/testdata/sf0.01").collect()
    want = {(i, len((t or "").encode()), len(model.whole.encode(t or ""))) for i, t in docs.items()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in got} == want and len(got) == len(docs)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)


# --- 13 hard negatives ----------------------------------------------------------------------------


def plain_negatives(rows, every, k, m, low, scale):
    kept = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [max(-hard_negatives.LARGEST, min(hard_negatives.LARGEST, int(np.floor(scale * float(c))))) for c in v], label))
    out = []
    for i, x, label in kept:
        if i % every:
            continue
        scored = sorted([(-sum(a * b for a, b in zip(x, y)), j, other) for j, y, other in kept if len(y) == len(x)])
        for p, j, _ in [s for s in scored if s[2] == label and s[1] != i][:k]:
            fits = [(s, n) for s, n, other in scored if other != label and low * -p <= 100 * -s <= 100 * -p]
            out += [(i, j, rank + 1, n, -p, -s) for rank, (s, n) in enumerate(fits[:m])]
    return sorted(out)


@pytest.mark.parametrize("every,k,m,low,anchors", [(100, 5, 5, 80, 4096), (7, 3, 2, 50, 10), (1, 1, 40, 0, 100)])
def test_negatives_equal_plain_ranking(spark, every, k, m, low, anchors):
    vectors = messy_vectors(spark, 8, 300, ", rank string, W string")
    got = hard_negatives.mine_hard_negatives(vectors.repartition(3), every=every, positives=k, negatives=m, low=low, pass_anchors=anchors)
    want = plain_negatives([(r.vec_id, r.embedding, r.label) for r in vectors.collect()], every, k, m, low, 256)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_negatives_that_tie_in_thousands(spark):
    rows = [(i, [1.0, 0.5], i % 2) for i in range(3000)] + [(i, [-1.0, 0.25 * (i % 5)], i % 3) for i in range(3000, 3300)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(4)
    got = hard_negatives.mine_hard_negatives(vectors, every=500)
    assert sorted(map(tuple, got.collect())) == plain_negatives([(a, b, c) for a, b, c in rows], 500, 5, 5, 80, 256)


def test_radix_search_goes_on_digit_by_digit(monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLACK", 0)
    rng = np.random.default_rng(8)
    scores = rng.integers(-(1 << 40), 1 << 40, 5000)
    windows = hard_negatives.Windows(np.zeros(3, np.int64), np.array([-(1 << 41), 0, 5]), np.array([1 << 41, 1 << 39, 4]), 7)
    turns = 0
    while not windows.settled.all():
        turns += 1
        found = []
        for w in np.flatnonzero(~windows.settled).tolist():
            own = scores[(scores <= windows.hi[w]) & (scores >= max(windows.lo[w], windows.hi[w] - (1 << int(windows.shift[w]) + 8) + 1))]
            bucket, n = np.unique(windows.hi[w] - own >> windows.shift[w], return_counts=True)
            at = int(np.searchsorted(np.cumsum(n), windows.need[w]))
            if at < len(n):
                found.append((w, int(bucket[at]), int(n[at]), int(np.cumsum(n)[at])))
        windows.locate(found)
    ranked = np.sort(scores)[::-1]
    for w, hi in ((0, 1 << 41), (1, 1 << 39)):
        own = ranked[(ranked <= hi) & (ranked >= windows.lo[w])]
        assert (own >= windows.least[w]).sum() == 7
    assert turns > 1 and windows.least[2] > windows.top[2]


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine_hard_negatives(none).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], VECTORS)
    assert hard_negatives.mine_hard_negatives(lone).count() == 0
