"""Language identification: nearest of several clustered centroids per language.

A text becomes a normalised TF-IDF vector of hashed byte trigrams (A-Z
lower-cased, runs of ASCII non-letters as blanks), tf = 1 + log(count).  For
each language, spherical k-means clusters the training vectors into up to
``per_language`` centroids; a text gets the language of the centroid of largest
cosine, which is also its score.  Distance-based rejection: a text is rejected
(column ``rejected``) if its cosine is below ``slack`` times the smallest of any
training text with about as many distinct trigrams, as short texts lie far from
every centroid.  A text without a letter has language ``und``, score 0 and is
rejected.

The model is fitted on a bounded sample: of the training rows with a language,
about ``sample_rows`` by the hash of their id and text, the same ones in every
run, and of every language about ``LEAST_ROWS`` or all it has; each is used
whole.  Prediction reads nothing but the text.

Cases: null and empty texts have no letter; ties between centroids go to the
first in order of language; repeated rows train once and are judged alike; a
very long text is one vector of its counts; an empty table gives an empty
result; without any training row every text is ``und`` with score 0 and
rejected; input columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, map_docs, rest_of, texts

#: Hashed trigrams.
BINS = 1 << 13
UNKNOWN = "und"
#: Rejection floors are learned for texts of fewer distinct trigrams than each of these, and for the rest.
BANDS = (8, 32, 128, 512)
#: Rows of a sample that every language (or label) gets, if it has them.
LEAST_ROWS = 100
MADE = ("lang_pred", "score", "rejected")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


def trigram_counts(bodies: list[bytes]):
    """Yield (bins, counts) of each text."""
    flat = np.frombuffer(b"\n" + b"\n\n".join(bodies) + b"\n", np.uint8)
    folded = _FOLD[flat].astype(np.uint32)
    ink = (folded != 32).astype(np.int8)
    hashed = (folded[:-2] | folded[1:-1] << np.uint32(8) | folded[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(32 - 13)
    real = 2 * ink[1:-1] + ink[:-2] + ink[2:] >= 2
    lo = 0
    for body in bodies:
        hi = lo + len(body)
        counts = np.bincount(hashed[lo:hi][real[lo:hi]], minlength=BINS)
        bins = np.flatnonzero(counts)
        yield bins, counts[bins]
        lo = hi + 2


def has_letter(body: bytes) -> bool:
    flat = np.frombuffer(body, np.uint8)
    if _LETTERS[flat].any():
        return True
    return bool((flat >= 128).any()) and any(map(str.isalpha, body.decode("utf-8", "replace")))


@dataclass(frozen=True)
class LangModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # (centroids, BINS), unit rows
    idf: np.ndarray
    floors: np.ndarray  # for each band, the cosine below which a text is rejected

    def predict(self, bodies: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, rejected = [], np.zeros(len(bodies)), np.ones(len(bodies), bool)
        by_bin = np.ascontiguousarray(self.centroids.T)
        for i, (bins, counts) in enumerate(trigram_counts(bodies)):
            lang.append(UNKNOWN)
            if not self.languages or not has_letter(bodies[i]):
                continue
            v = (1 + np.log(counts)) * self.idf[bins]
            near = v @ by_bin[bins] / max(np.sqrt(v @ v), 1e-12)
            best = int(np.argmax(near))
            lang[i] = self.languages[best]
            score[i] = min(1.0, max(0.0, float(near[best])))
            rejected[i] = near[best] < self.floors[np.searchsorted(BANDS, len(bins), side="right")]
        return lang, score, rejected


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and the label of each row; starts spread by farthest-first."""
    picks = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picks[-1]])
    centres = x[picks]
    label = None
    for _ in range(rounds):
        new = np.argmax(x @ centres.T, 1)
        if label is not None and (new == label).all():
            break
        label = new
        own = (label[None, :] == np.arange(len(centres))[:, None]).astype(np.float32)
        sums = np.where(own.any(1)[:, None], own @ x, centres)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, label


def _train(rows: pd.DataFrame, per_language: int, slack: float) -> LangModel:
    """From one row per sampled text: lang, bins (uint16 bytes), counts (float32 bytes).

    Holds one dense float32 matrix of the sample, filled row by row."""
    rows = rows.sort_values(["lang", "at"], kind="stable").reset_index(drop=True)
    bins = [np.frombuffer(b, np.uint16) for b in rows.bins]
    idf = np.log((1 + len(rows)) / (1 + np.bincount(np.concatenate(bins), minlength=BINS))) + 1
    band = np.searchsorted(BANDS, [len(b) for b in bins], side="right")
    x = np.zeros((len(rows), BINS), np.float32)
    for row, at, counts in zip(x, bins, rows.counts):
        v = (1 + np.log(np.frombuffer(counts, np.float32))) * idf[at]
        row[at] = v / max(np.sqrt(v @ v), 1e-12)
    languages, centroids, nearest = [], [], np.ones(len(rows))
    for lang, own in rows.groupby("lang", sort=True):
        lo, hi = own.index[0], own.index[-1] + 1
        centres, label = spherical_kmeans(x[lo:hi], per_language)
        for c in range(len(centres)):
            mine = lo + np.flatnonzero(label == c)
            nearest[mine] = x[lo:hi].dot(centres[c])[mine - lo]
            languages.append(lang)
            centroids.append(centres[c])
    floors = [slack * nearest[band == b].min(initial=1) if (band == b).sum() >= 20 else 0 for b in range(len(BANDS) + 1)]
    return LangModel(languages, np.array(centroids, np.float32), idf, np.maximum(floors, 1e-4))


def sampled(rows: DataFrame, keys: list[str], expect: int, group: str, least: int = LEAST_ROWS) -> DataFrame:
    """About ``expect`` rows by the hash of their keys, the same in every run, and
    of every value of ``group`` at least about ``least`` or all it has: so no
    value is lost for being rare.  A count for each value is collected."""
    counts = {r[0]: r[1] for r in rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1))).collect()}
    share = expect / max(1, sum(counts.values()))
    whole = [value for value, n in counts.items() if n <= least or share >= 1]
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    keep = F.col(group).isin(whole) if whole else F.lit(False)
    for value, n in counts.items():
        if value not in whole and share < least / n:
            keep |= (F.col(group) == F.lit(value)) & (place < F.lit(int((1 << 40) * least / n)))
    return rows.where(F.col(group).isNotNull() & (keep | (place < F.lit(min(1 << 40, int((1 << 40) * share))))))


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 4, sample_rows: int = 3000, slack: float = 0.25) -> LangModel:
    """Learn from the rows where ``train`` holds and ``lang`` is not null.  The
    model is small and fixed in size: languages x per_language x BINS floats."""
    rows = sampled(docs.where(train & F.col(lang).isNotNull()), [key, text], sample_rows, lang)

    def count(batches):
        for batch in batches:
            made = [(b.astype(np.uint16).tobytes(), c.astype(np.float32).tobytes()) for b, c in trigram_counts(texts(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([b for b, _ in made], pa.binary()), pa.array([c for _, c in made], pa.binary())], ["lang", "at", "bins", "counts"])

    counts = map_arrow(rows.select(text, F.col(lang).cast("string").alias("lang"), F.xxhash64(key).alias("at")), count, "lang string, at long, bins binary, counts binary")

    def train_one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _train(pdf, per_language, slack)
        return pd.DataFrame({"languages": [m.languages], "centroids": [m.centroids.tobytes()], "idf": [m.idf.astype(np.float64).tobytes()], "floors": [m.floors.tobytes()]})

    made = counts.distinct().groupBy().applyInPandas(train_one, "languages array<string>, centroids binary, idf binary, floors binary").collect()
    if not made:
        return LangModel([], np.zeros((0, BINS), np.float32), np.ones(BINS), np.ones(len(BANDS) + 1))
    row = made[0]
    return LangModel(list(row.languages), np.frombuffer(row.centroids, np.float32).reshape(-1, BINS), np.frombuffer(row.idf), np.frombuffer(row.floors))


def identify(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""

    def work(part):
        lang, score, rejected = model.predict(texts(part.column(text)))
        return [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return map_docs(rest_of(docs, *MADE), text, fields, work)


def fold_of(key: str, folds: int) -> Column:
    """crc32 of a key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % folds
