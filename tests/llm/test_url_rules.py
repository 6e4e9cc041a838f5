"""Mined rules of any length against brute-force mining."""

from collections import Counter
from itertools import combinations

from codestrata.llm import url_filter
from codestrata.llm.session import Scratch


def test_rules_of_four_and_five_tokens(spark):
    rows = [(["a", "b", "c", "d"], "block")] * 10 + [(["f", "g", "h", "i", "j"], "block")] * 10
    for whole in ("abcd", "fghij"):
        rows += [([t for t in whole if t != gone], "allow") for gone in whole] * 10
    sets = Counter((part, label) for tokens, label in rows for n in range(1, 6) for part in combinations(tokens, n))
    every = Counter()
    for (part, _), n in sets.items():
        every[part] += n
    sure = {(part, label): n / every[part] for (part, label), n in sets.items() if n >= 0.02 * len(rows) and n / every[part] >= 0.8}
    want = {(" ".join(p), label, sets[p, label]) for (p, label), c in sure.items() if not any(set(q) < set(p) and m == label and d >= c for (q, m), d in sure.items())}
    got = url_filter.mine(Scratch(spark, "t"), spark.createDataFrame(rows, "tokens array<string>, label string")).collect()
    assert {(r.key, r.label, r.support) for r in got} == want and {len(k.split()) for k, label, _ in want if label == "block"} == {4, 5}
