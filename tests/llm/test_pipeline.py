"""The pipeline against a brute-force version, and its stages on awkward rows."""

import hashlib
import os
from array import array
from collections import Counter

import corpus_pipeline
import pandas as pd
import pytest
from codestrata.llm import decontaminate, langid, line_dedup, queries
from codestrata.llm.components import brute_components

from .test_near_copies import jaccard
from .test_operators import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")
def test_run_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    frame = spark.createDataFrame(docs)
    model = langid.fit(frame, langid.fold_of("doc_id", 4) != 2)
    rejected = model.predict([t.encode() for t in docs.text])[2]
    kept = dict(zip(docs.doc_id[~rejected], docs.text[~rejected]))
    kept = dict(zip(kept, brute_lines(kept.values(), 10)))
    # the near-dedup stage's own rule: five words, similarity 0.8 or more
    fold = {i: t.encode().lower().decode() for i, t in kept.items()}
    ids = list(kept)
    comp = brute_components(pd.DataFrame([(a, b) for n, a in enumerate(ids) for b in ids[n:] if a == b or jaccard(fold[a], fold[b]) >= 0.8]))
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    items = [decontaminate.words_of(t.encode()) for t in bench.text]
    sets = [(len(w), decontaminate.shingles_of(w)) for w in items]

    def clean(text):
        words = decontaminate.words_of(text.encode())
        own = decontaminate.shingles_of(words)
        for n, s in sets:
            if not (s & own):
                continue
            if any(decontaminate.weighted_jaccard(decontaminate.shingles_of(words[a : a + n]), s) >= 0.8 for a in range(max(1, len(words) - n + 1))):
                return False
        return True

    kept = {i: t for i, t in kept.items() if clean(t)}
    library = Tokenizer.from_file(queries.tokenizer_file())
    want = {}
    for i, t in kept.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(want) < len(docs)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_rows(spark, messy, empty_docs, name, stage):
    docs = messy.withColumnRenamed("passages", "_passages")
    got = stage(spark, docs, SF)
    if name != "bpe_encoding":
        assert got.columns == docs.columns and got.where("N_LINES <> 'clash' OR Lang_Pred <> 'clash' OR simhash <> 'clash' OR _passages <> 'clash'").count() == 0
    # language ID has no training row that shares a trigram with document 7
    left = Counter(r.doc_id for r in got.select("doc_id").collect())
    every = Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert left == every - {"language_id": Counter([3, 4, 5, 7, 9]), "simhash_near_dedup": Counter([2, 4, 5])}.get(name, Counter())
    assert stage(spark, empty_docs, SF).count() == 0


def test_key_of_lines_is_shared_with_brute_force():
    assert line_dedup.line_key(b" \tAbC\xc3\x89 \r") == b"abc\xc3\x89"
