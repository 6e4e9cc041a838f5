"""Quality classifier: histogram gradient-boosted trees over document statistics.

``features``: byte-class shares, word and line statistics and repetition of each
whole text.  ``fit`` bins every feature at quantiles and grows trees level by
level on gradient histograms (logistic loss).  The trees are complete and
flattened into arrays (feature, threshold, leaf value by node number), so
scoring walks all texts of a batch through one level of a tree at a time.

The model is fitted on a bounded sample: about ``sample_rows`` of the labelled
training rows by the hash of their id and text, and of every label at least
about ``langid.LEAST_ROWS`` or all it has, each used whole.  A score reads
nothing but the text.

Cases: null and empty texts have all-zero features and a score like any other;
equal texts tie in score; a very long text is one row of statistics; repeated
rows train once, a document with several labels once with each; null labels are left out;
with no training row or a single class every score is the class share (0.5
without rows); an empty table gives an empty result; input columns named like
an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import map_arrow, map_docs, rest_of, texts
from .langid import sampled

#: Bytes whose share is a feature of its own.
MARKS = b".,!?|#$%&*;:\"'()[]{}<>-_/=@~^+\\"
_CLASSES = np.zeros((256, 6 + len(MARKS)))
for _i, _own in enumerate((range(65, 91), range(97, 123), range(48, 58), range(192, 256), (32, 9), (10,))):
    _CLASSES[list(_own), _i] = 1
for _i, _b in enumerate(MARKS):
    _CLASSES[_b, 6 + _i] = 1
N_FEATURES = 6 + len(MARKS) + 16


def features(bodies: list[bytes]) -> np.ndarray:
    """(texts, N_FEATURES) statistics of whole texts."""
    out = np.zeros((len(bodies), N_FEATURES))
    for row, body in zip(out, bodies):
        if not body:
            continue
        n = len(body)
        row[: len(_CLASSES[0])] = np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ _CLASSES / n
        words = body.split()
        lines = body.split(b"\n")
        w = max(1, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        often = [c for _, c in Counter(words).most_common(3)] + [0, 0, 0]
        filled = [x for x in lines if x]
        row[len(_CLASSES[0]) :] = (
            np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
            sizes.mean(), sizes.std(), sizes.max(), (sizes <= 3).mean(),
            len(set(words)) / w, sum(map(eq, words, words[1:])) / w, often[0] / w, sum(often[:3]) / w,
            len(set(filled)) / max(1, len(filled)), len(words) / max(1, len(lines)),
            sum(x[-1:] in b".!?" for x in filled) / max(1, len(filled)),
            sum(x.upper() == x for x in words) / w, sum(x[-1] < 48 or 58 <= x[-1] < 65 or 91 <= x[-1] < 97 or 123 <= x[-1] < 128 for x in words) / w,
        )
    return out


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: node i has children 2i+1 and 2i+2."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray  # (trees, leaves)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1])) if self.value.size else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 10) -> Forest:
    """Histogram gradient boosting with logistic loss; deterministic."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # bin > b  <=>  x > edges[b]
    flat = binned + np.arange(f) * bins
    total = np.full(n, base)
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            at = node - (2**d - 1)
            cell = (at[:, None] * (f * bins) + flat).ravel()
            size = 2**d * f * bins
            g, h, c = (np.bincount(cell, np.repeat(v, f), size).reshape(2**d, f, bins).cumsum(2) for v in (grad, hess, np.ones(n)))
            gt, ht, ct = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + l2) + (gt - g) ** 2 / (ht - h + l2) - gt**2 / (ht + l2)
            gain[(c < least) | (ct - c < least)] = 0
            flat_gain = gain.reshape(2**d, -1)
            best = flat_gain.argmax(1)
            for i, k in enumerate(best.tolist()):
                j, b = divmod(k, bins)
                if flat_gain[i, k] > 1e-9 and b < len(edges[j]):
                    feature[t, 2**d - 1 + i], threshold[t, 2**d - 1 + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value[t] = -rate * g / (h + l2)
        total += value[t, leaf]
    return Forest(feature, threshold, value, base)


def fit(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample_rows: int = 8000, **options) -> Forest:
    """Learn from rows with text and a 0/1 label; the model's size is fixed."""
    rows = sampled(labelled.where(F.col(label).isNotNull()), [key, text], sample_rows, label)

    def count(batches):
        for batch in batches:
            x = features(texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "at", "x"])

    counts = map_arrow(rows.select(text, F.col(label).cast("double").alias("y"), F.xxhash64(key).alias("at")), count, "y double, at long, x binary")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "y"], kind="stable")
        m = boost(np.frombuffer(b"".join(pdf.x)).reshape(-1, N_FEATURES), pdf.y.to_numpy(), **options)
        return pd.DataFrame({"feature": [m.feature.tobytes()], "threshold": [m.threshold.tobytes()], "value": [m.value.tobytes()], "shape": [list(m.feature.shape)], "base": [m.base]})

    made = counts.distinct().groupBy().applyInPandas(train, "feature binary, threshold binary, value binary, shape array<long>, base double").collect()
    if not made:
        return boost(np.zeros((0, N_FEATURES)), np.zeros(0), **options)
    row = made[0]
    shape = tuple(row.shape)
    return Forest(np.frombuffer(row.feature, np.int64).reshape(shape), np.frombuffer(row.threshold).reshape(shape), np.frombuffer(row.value).reshape(shape[0], shape[1] + 1), row.base)


def score(docs: DataFrame, model: Forest, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1."""

    def work(part):
        return [pa.array(model.score(features(texts(part.column(text)))))]

    return map_docs(rest_of(docs, column), text, [T.StructField(column, T.DoubleType())], work)
