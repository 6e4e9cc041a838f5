import numpy as np
import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and very long texts, repeats, clashing extra columns."""
    rng = np.random.default_rng(3)
    same = prose(rng, 40)
    rows = [
        (1, same, "en", "a", 1), (1, same, "en", "a", 1), (2, same, "fr", None, None), (3, None, None, None, None), (4, "", "en", "b", 0), (5, "\n\n", None, "b", 2),
        (None, "a line\nof text with ÉÄ and 日本", "de", "c", 5), (6, "x", "en", "c", 1), (7, "word " * 60_000, "en", "c", 300_000), (8, "y" * 200_000, "en", "c", 200_000), (9, "£ 12 !!", "en", "d", 5),
    ]
    extra = ", N_LINES string, n_dropped string, simhash string, component_id string, passages string, n_tokens string, ids string, decoded string, Lang_Pred string, score string, rejected string, host string, verdict string"
    n = extra.count(" string")
    return spark.createDataFrame([r + tuple(["clash"] * n) for r in rows], DOC + extra)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOC)
