"""Hot groups, very long texts, rare classes, and that the named index does the work."""

import resource
import subprocess
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from codestrata.llm import decontaminate, embedding_dedup, langid, line_dedup, near_copies, quality, simhash
from codestrata.llm.components import brute_components
from codestrata.llm.session import Scratch, filter_words, without
from pyspark.sql import functions as F

from .conftest import prose


def codes_around(rng, n, flips=5):
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    codes = np.unique(base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (flips, 2 * n), dtype=np.uint64), axis=0))
    return rng.permutation(codes)[:n]


def test_every_link_comes_from_the_gray_index(monkeypatch):
    rng = np.random.default_rng(1)
    made = []

    class Counted(simhash.GrayIndex):
        def search(self, *args, **options):
            for x, y in super().search(*args, **options):
                made.append(len(x))
                yield x, y

    monkeypatch.setattr(simhash, "GrayIndex", Counted)
    codes = np.concatenate([codes_around(rng, 3) for _ in range(40)] + [rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    batch = pa.RecordBatch.from_pydict({"key": np.repeat(np.arange(20), 11)[: len(codes)], "bi": np.zeros(len(codes), int), "bj": np.zeros(len(codes), int), "code": codes.view(np.int64), "rep": np.arange(len(codes))})
    out = pa.Table.from_batches(list(simhash.indexed_links(["code"], 6)(iter([batch]))))
    key = batch.column("key").to_numpy()
    near = (np.bitwise_count(codes[:, None] ^ codes) <= 6) & (key[:, None] == key)
    want = {k: v for k, v in brute_components(pd.DataFrame(np.argwhere(near))).items() if v != k}
    assert dict(zip(out["u"].to_pylist(), out["v"].to_pylist())) == want and want and sum(made) >= near.sum()


def test_two_word_codes_with_an_exact_word():
    rng = np.random.default_rng(2)
    codes = np.stack([rng.integers(0, 5, 600, dtype=np.uint64), np.concatenate([codes_around(rng, 30) for _ in range(20)]), np.concatenate([codes_around(rng, 30) for _ in range(20)])], 1)
    found = set()
    for x, y in simhash.GrayIndex(codes, exact=1).search(codes, 12):
        found |= set(zip(x.tolist(), y.tolist()))
    near = (np.bitwise_count(codes[:, None, 1:] ^ codes[None, :, 1:]).sum(2) <= 12) & (codes[:, None, 0] == codes[None, :, 0])
    assert found == set(map(tuple, np.argwhere(near).tolist())) and len(found) > 600
    assert list(simhash.GrayIndex(codes[:0], exact=1).search(codes, 12)) == []


def test_hot_key_of_ten_thousand_fingerprints(spark):
    rng = np.random.default_rng(3)
    codes = codes_around(rng, 10_000, 4)
    rows = spark.createDataFrame(pd.DataFrame({"key": 7, "code": codes.view(np.int64), "rep": np.arange(len(codes))}))
    scratch = Scratch(spark, "t")
    dealt = simhash.deal(scratch, scratch.keep(rows, "rows"), ["code"], 3, 1000)
    sizes = dealt.groupBy("bi", "bj").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rep").alias("d")).toPandas()
    assert sizes.n.max() <= 2 * 1400 and len(sizes) > 10 and (sizes.n == sizes.d).all()
    met = dealt.select("rep", "bi", "bj").toPandas()
    groups = met.groupby("rep").apply(lambda g: set(zip(g.bi, g.bj)), include_groups=False)
    for a, b in rng.integers(0, len(codes), (3000, 2)):
        if int(codes[a] ^ codes[b]).bit_count() <= 3:
            assert groups[a] & groups[b]


def test_keys_of_near_copies_grow_slowly():
    small, large = near_copies.key_plan(200_000), near_copies.key_plan(50_000_000_000)
    assert small.shape == (64, 12) and large.shape[1] == 28 and 64 < len(large) < 900 and all(len(set(k)) == 28 for k in large.tolist())
    keys = pa.Table.from_batches(list(near_copies._keys(near_copies.key_plan(1 << 40))(iter([pa.RecordBatch.from_pydict({"rep": [1, 2], "_a": [5, 5], "_b": [-7, -7]})]))))
    assert keys["key"].to_pylist()[: len(keys) // 2] == keys["key"].to_pylist()[len(keys) // 2 :] and len(set(keys["key"].to_pylist())) == len(keys) // 2


def test_without_drops_exactly(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(500)] + [(None, "n"), (3, "again")], "doc_id long, text string")
    scratch = Scratch(spark, "t")
    gone = scratch.keep(rows.where("doc_id % 7 = 3").select("doc_id").distinct(), "gone")
    left = without(scratch, rows, "doc_id", gone).collect()
    assert sorted(r.text for r in left) == sorted([str(i) for i in range(500) if i % 7 != 3] + ["n"])


def test_filters_grow_with_their_keys():
    sizes = [2 ** filter_words(n) * 64 for n in (0, 1000, 10**6, 3 * 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == 1 << 18 and sizes[-1] == 1 << 28
    assert all(8 * n <= s for n, s in zip((0, 1000, 10**6, 3 * 10**7), sizes))


LONG = """
import resource, sys, time
import numpy as np
from codestrata.llm import decontaminate as d
rng = np.random.default_rng(1)
words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(60)]
item = " ".join(words).encode()
index = d.ItemIndex([(1, item), (2, b" ".join(item.split()[:20]))], 0.8, d.RADIUS)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
plain = " ".join(np.array(["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(5000)])[rng.integers(0, 5000, 2_700_000)]).encode()
text = plain + b" " + (item + b" ") * (1_000_000 // len(item))
assert len(text) > 19_000_000
found = index.search([text, b"x" * 5_000_000, item])
assert sorted(p["item_id"] for p in found[0]) == [1, 2] and not found[1] and found[0][0]["similarity"] == 1.0 and max(p["end_byte"] for p in found[2]) == len(item)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_passages_of_a_text_of_twenty_megabytes():
    done = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) < 900


def test_windows_with_counts():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n, own = int(rng.integers(1, 60)), int(rng.integers(1, 20))
        own = min(own, n)
        hits = np.flatnonzero(rng.random(n) < rng.random())
        need = int(rng.integers(1, own + 1))
        want = [a for a in range(n - own + 1) if ((hits >= a) & (hits < a + own)).sum() >= need]
        assert decontaminate.windows_with(hits, need, own, n).tolist() == want


def test_share_of_random_pairs_that_the_blocks_let_through():
    rng = np.random.default_rng(5)
    words = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(30)) for _ in range(400)]
    index = decontaminate.ItemIndex([(i, w.encode()) for i, w in enumerate(words[:200])], 0.8, decontaminate.RADIUS)
    other = decontaminate.ItemIndex([(i, w.encode()) for i, w in enumerate(words[200:])], 0.8, decontaminate.RADIUS)
    apart = index.prints[:, None] ^ other.prints[None]
    passed = (np.bitwise_count(apart) <= decontaminate.LISTED + decontaminate.LOOKED_UP).any(2).mean()
    assert 0.1 < passed < 0.22 and not len(index.candidates(30, other.prints)[0])


def cone(rng, n, dim, cosine):
    x = rng.standard_normal((n, dim))
    x = np.sqrt(1 - cosine) * x / np.linalg.norm(x, axis=1, keepdims=True)
    return x + np.sqrt(cosine) * np.eye(dim)[0]


def test_rows_of_a_vector_in_a_cone():
    rng = np.random.default_rng(6)
    x = embedding_dedup.unit_rows(cone(rng, 100_000, 64, 0.9))
    depth = np.full(len(x), int(np.ceil(np.log2(len(x) / embedding_dedup.LEAF_ROWS))))
    rest = ((x - x.mean(0)) ** 2).sum() / len(x)
    tree = embedding_dedup.Tree(0, x[:4096], 64, 0.8 * 0.2 / 8)
    rows, _ = tree.leaves(x, depth)
    assert len(rows) / len(x) <= 10 and embedding_dedup.trees_for(depth[:1], 0.2 / np.sqrt(rest), 3e-5)[0] <= 5


def test_embeddings_of_a_cone_match_brute_force(spark):
    rng = np.random.default_rng(7)
    x = cone(rng, 2500, 24, 0.9)
    x = np.concatenate([x, x[:500] + 0.02 * rng.standard_normal((500, 24))]).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x.tolist()), "label": 1}), "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.near_duplicates(frame, leaf_rows=100).toPandas().set_index("vec_id").sort_index()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    assert near.sum() > 900 and (got.n_links.to_numpy() == near.sum(1)).mean() > 0.999


def test_rare_languages_are_learned(spark):
    rng = np.random.default_rng(8)
    common = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 8)) for _ in range(50)]
    rows = [(i, common[i % 50], "aa") for i in range(30_000)]
    rare = {f"l{k:02}": ["".join(rng.choice(list("stuvwxyz"), 5)) for _ in range(12)] for k in range(40)}
    rows += [(40_000 + 10 * k + j, " ".join(rng.choice(words, 10)), lang) for k, (lang, words) in enumerate(rare.items()) for j in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, F.lit(True), sample_rows=1000)
    assert set(model.languages) == {"aa", *rare}
    labelled = spark.createDataFrame([(i, common[i % 50], int(i >= 20_000 - 6)) for i in range(20_000)], "doc_id long, text string, quality int")
    some = langid.sampled(labelled, ["doc_id"], 500, "quality").groupBy("quality").count().collect()
    assert {r.quality: r["count"] for r in some}[1] == 6 and 300 < {r.quality: r["count"] for r in some}[0] < 800


def test_documents_that_repeat_an_id_are_one(spark):
    rows = [(1, "same line\nother")] * 12 + [(i, "same line\ncommon") for i in range(2, 11)] + [(None, "common\nnull")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = line_dedup.dedup_lines(docs, min_docs=10, repeated_ids=True)
    for options in ({}, {"broadcast_bytes": 0}):
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs, min_docs=10, repeated_ids=True, **options).collect()}
        assert got[1] == "other" and got[2] == "" and got[None] == "null"
    assert by_id.where("doc_id = 1").count() == 12
    assert {r.text for r in line_dedup.dedup_lines(docs, min_docs=13).where("doc_id = 1").collect()} == {"other"}
    assert {r.text for r in line_dedup.dedup_lines(docs, min_docs=12, repeated_ids=True).where("doc_id = 1").collect()} == {"same line\nother"}


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_clashing_names_of_line_dedup(spark, limit):
    docs = spark.createDataFrame([(i, "a\nb", "x", "y", "z") for i in range(12)], "doc_id long, text string, _hits string, id string, _text string")
    got = line_dedup.dedup_lines(docs, min_docs=10, broadcast_bytes=limit)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"] and {tuple(r)[1:] for r in got.collect()} == {("", "x", "y", "z", 2, 2)}


def test_clashing_names_of_simhash(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "a b c", "x", "y")], "doc_id long, text string, _print string, _key string")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "_print", "_key", "simhash", "component_id"] and {(r._print, r._key, r.component_id) for r in got.collect()} == {("x", "y", 1)}


def test_long_texts(spark):
    rng = np.random.default_rng(9)
    body = prose(rng, 400_000)
    words = body.encode().split()
    assert simhash.simhash_text(body.encode()) == simhash.simhash_text(b"\t".join(words)) != 0
    whole = sum((np.unpackbits(np.frombuffer(simhash._digests(words, 3), np.uint8).reshape(-1, 8), axis=1).astype(np.int64).sum(0) * 2 > len(words) - 2) * (1 << np.arange(63, -1, -1, dtype=object)))
    assert simhash.simhash_text(body.encode()) == whole
    frame = spark.createDataFrame([(1, body), (2, body + " end")], "doc_id long, text string")
    assert {r.component_id for r in near_copies.near_copies(frame).collect()} == {1}
    assert quality.features([body.encode()]).shape == (1, quality.N_FEATURES)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss > 0
