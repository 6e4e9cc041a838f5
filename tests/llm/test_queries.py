"""The registered queries: against DuckDB, brute force or held-out rows."""

import hashlib
import os
import re
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from codestrata.llm import decontaminate, queries
from codestrata.llm.components import brute_components

from .test_operators import plain_simhash

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no shared tables")


def run(spark, name, sf=SMALL):
    return queries.queries()[name](spark, sf).toPandas()


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SMALL):
        duck.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{SMALL}/{file}'")
    got, want = run(spark, name), duck.execute(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda f: f[columns].astype(object).where(f[columns].notna(), None).astype(str).sort_values(columns).values.tolist()
    assert plain(got) == plain(want)


def test_licenses(spark, docs):
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    want = Counter((d, name) for d, t in zip(docs.doc_id, docs.text) for notice, name in notices.items() for _ in range(t.count(notice)))
    got = run(spark, "op1_license_scan")
    assert Counter(zip(got.doc_id, got.license)) == want and want


def test_secrets(spark):
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    want = {(d, hashlib.sha256(m[1].encode()).hexdigest()) for d, t in zip(docs.doc_id, docs.text) for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    got = run(spark, "op3_secret_scan", LARGER)
    assert want <= set(zip(got.doc_id[got.is_secret], got.candidate_sha256[got.is_secret])) and want


def test_decontamination(spark, docs):
    bench = pd.read_parquet(f"{SMALL}/benchmark.parquet")
    items = [(i, decontaminate.words_of(t.encode())) for i, t in zip(bench.item_id, bench.text)]
    sets = [(i, len(w), decontaminate.shingles_of(w)) for i, w in items]
    want = set()
    for d, t in zip(docs.doc_id, docs.text):
        words = decontaminate.words_of(t.encode())
        own = decontaminate.shingles_of(words)
        for i, n, s in sets:
            if s & own and any(decontaminate.weighted_jaccard(decontaminate.shingles_of(words[a : a + n]), s) >= 0.8 for a in range(max(1, len(words) - n + 1))):
                want.add((d, i))
    got = run(spark, "op5_decontamination")
    assert set(zip(got.doc_id, got.item_id)) == want and want


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    library.no_truncation()
    library.no_padding()
    want = {}
    for d, t in zip(docs.doc_id, docs.text):
        ids = library.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = run(spark, "op6_bpe")
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()} == want


def test_simhash(spark):
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    prints = {d: plain_simhash(t) for d, t in zip(docs.doc_id, docs.text)}
    codes = np.array(list(prints.values()), np.uint64)
    near = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3)
    comp = brute_components(pd.DataFrame(np.array(list(prints))[near]))
    got = run(spark, "op7_simhash", LARGER)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {d: (f"{p:016x}", comp[d]) for d, p in prints.items()}


def test_language(spark):
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    got = run(spark, "op8_language_id", LARGER).merge(docs[["doc_id", "lang"]])
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in got.doc_id]).all() and len(got) == len(docs)
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and got.score.between(0, 1).all() and got.rejected.mean() < 0.01


def test_quality(spark):
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    got = run(spark, "op10_quality", LARGER)
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all() and len(got) == len(docs)
    held = got.merge(pd.read_parquet(f"{LARGER}/labels.parquet"))
    held = held[held.held_out]
    assert (held.predicted == held.quality).mean() > 0.95 and ((got.score >= 0.3) == got.predicted).all()
