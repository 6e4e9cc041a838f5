"""The pipeline's near-copy stage against exact five-word similarity of all pairs."""

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from codestrata.llm import near_copies
from codestrata.llm.components import brute_components

from .conftest import DOC, prose


def jaccard(s, t):
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((x or "").split() for x in (s, t))]
    return len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) if shingles[0] | shingles[1] else 1.0


@pytest.fixture(scope="module")
def edited():
    rng = np.random.default_rng(11)
    texts = []
    for n, edits in ((100, 1), (100, 2), (300, 3), (300, 6), (1000, 20), (200, 9), (200, 12)):
        for _ in range(6):
            words = prose(rng, n).split()
            copy = list(words)
            for at in rng.choice(n, edits, replace=False):
                copy[at] = "edit"
            texts += [" ".join(words), " ".join(copy)]
    hub = prose(rng, 200).split()
    for _ in range(40):
        copy = list(hub)
        copy[rng.integers(0, 200)] = "edit"
        texts.append(" ".join(copy))
    return list(enumerate([*texts, None, "", texts[0], "one", "one two"]))


@pytest.mark.parametrize("limits", [{}, {"block": 8, "pair_rows": 8}])
def test_near_copies_match_all_pairs(spark, edited, limits):
    pairs = [(i, j) for i, s in edited for j, t in edited if i <= j and jaccard(s, t) >= 0.8]
    want = brute_components(pd.DataFrame(pairs))
    got = near_copies.near_copies(spark.createDataFrame(edited, "doc_id long, text string"), **limits)
    assert {r.doc_id: r.component_id for r in got.collect()} == want and len(set(want.values())) < len(want) - 60


def test_stage_drops_near_copies_below_three_bits(spark, edited):
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in edited if i < 12], DOC)
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left) == [0, 2, 4, 6, 8, 10]
