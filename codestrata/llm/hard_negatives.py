"""Hard-negative mining by distributed radix selection.

A row's score is its integer inner product with an anchor, from components
floor(scale * x).  An anchor's positives are its best other rows of the same label;
for each, the negatives are the best rows of other labels in the window
low * positive <= 100 * score <= 100 * positive (``low`` per cent).

Both are the same search: the best k rows, by (score downwards, id), of a window of
scores [lo, hi] on rows that pass a test of the label.  All windows are searched
together, digit by digit:

* every task scores its rows against the anchors in blocks and counts, per window,
  the rows in each bucket of the window's current digit; counts are added up before
  and after the shuffle;
* running sums from the highest bucket down locate the bucket of the kth score; a
  window in which few more than k rows reach it is settled, others go on with the
  next digit inside that bucket, until a digit is a single score;
* a last pass gathers only rows at or beyond a settled score.  Rows that tie at the
  kth score may be many (copies), so a task keeps the best k of a window, which by
  the same order hold all of the final k that it has.

Anchors go through in passes of up to ``pass_anchors`` rows and ``pass_bytes`` of
vectors, one at a time, so what is broadcast and what the driver holds of windows
is bounded at any size; the number of passes grows with the anchors, rows are
never shuffled.  A pass reads the rows once for each digit.

Cases: rows with a null id, label or vector, or any null or non-finite component,
take no part.  Vectors of different length never meet.  Rows with an anchor's id
are not its positives; otherwise repeated rows and ids count as rows of their own
(a repeated positive gives its window twice, in neighbouring ranks of its anchor).
An anchor without positives, and a positive without negatives (such as any with a
score below 0), give no row.  Components beyond +-2^24 after scaling are taken as
+-2^24, so that scores fit a long.  An empty table gives an empty result.  Columns
other than the id, vector and label are not carried, so none can clash.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_arrow
from .session import Scratch

DIGIT_BITS = 8
PASS_ANCHORS, PASS_BYTES = 4096, 8 << 20
LARGEST = 1 << 24
#: Scores looked at in one go, by a task.
TILE_SCORES = 1 << 20
#: A window is settled when so many more rows than asked for reach its bucket, or fewer.
SLACK = 32
EXACT_FLOAT = 1 << 53


class Anchors:
    """The anchors of one pass: ids, labels and vectors of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.largest = int(np.abs(x).max(initial=0))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Exact scores, a row for each anchor; by floats where all sums are exact in them."""
        if x.shape[1] * self.largest * int(np.abs(x).max(initial=0)) < EXACT_FLOAT:
            return (self.x.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
        return self.x @ x.T


class Windows:
    """Windows of scores, several to an anchor: the kth best score of each is looked for.

    ``hi`` and ``shift`` name the bucket range under search: buckets of 2^shift
    scores down from ``hi``.  ``above`` rows are known to be better than ``hi``."""

    def __init__(self, anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
        self.anchor, self.lo, self.top, self.hi, self.k = anchor, lo, hi.copy(), hi.copy(), k
        width = np.maximum(hi - lo, 0)
        bits = np.array([int(w).bit_length() for w in width], np.int64)
        self.shift = np.maximum(0, bits - DIGIT_BITS)
        self.above = np.zeros(len(anchor), np.int64)
        self.least = np.where(lo <= hi, lo, hi + 1)  # rows from here on are gathered, once settled
        self.settled = lo > hi

    @property
    def need(self) -> np.ndarray:
        """Rows still to be found, from ``hi`` down."""
        return self.k - self.above

    def locate(self, found: list[tuple[int, int, int, int]]) -> None:
        """Take (window, bucket that holds the kth score, its rows, rows up to its end); open windows without one have fewer than k rows in all."""
        open_ = ~self.settled
        self.settled |= open_
        for w, bucket, n, upto in found:
            top = int(self.hi[w]) - (bucket << int(self.shift[w]))
            self.least[w] = max(int(self.lo[w]), top - (1 << int(self.shift[w])) + 1)
            if not self.shift[w] or upto <= self.need[w] + SLACK:
                continue
            self.above[w] += upto - n
            self.hi[w] = top
            self.shift[w] = max(0, int(self.shift[w]) - DIGIT_BITS)
            self.settled[w] = False


def _tiles(batches, anchors: Anchors, same: bool):
    """(anchor, row, score) of the pairs whose labels fit, and the batch's ids; a tile at a time."""
    dim = anchors.x.shape[1]
    for batch in batches:
        cells = batch.column("comps").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if dim else np.zeros((batch.num_rows, 0), np.int64)
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy()
        step = max(1, TILE_SCORES // max(1, len(anchors.ids)))
        for at in range(0, batch.num_rows, step):
            some = slice(at, at + step)
            yield anchors.scores(cells[some].astype(np.int64)), (anchors.labels[:, None] == labels[None, some]) == same, ids[some]


def _pairs(batches, anchors: Anchors, windows: Windows, same: bool, floor: np.ndarray, ceiling: np.ndarray, chosen: np.ndarray):
    """(window, score, id) of the rows between a floor and a ceiling of each chosen window."""
    n = len(anchors.ids)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, windows.anchor[chosen], floor[chosen])
    np.maximum.at(high, windows.anchor[chosen], ceiling[chosen])
    order = chosen[np.argsort(windows.anchor[chosen], kind="stable")]
    first = np.searchsorted(windows.anchor[order], np.arange(n + 1))
    most = int(np.diff(first).max(initial=0))
    for scores, fits, ids in _tiles(batches, anchors, same):
        fits &= (scores >= low[:, None]) & (scores <= high[:, None])
        a, r = np.nonzero(fits)
        if same:
            other = anchors.ids[a] != ids[r]
            a, r = a[other], r[other]
        for slot in range(most):
            own = first[a] + slot < first[a + 1]
            w = order[np.where(own, first[a] + slot, 0)]
            value = scores[a, r]
            hit = own & (value >= floor[w]) & (value <= ceiling[w])
            if hit.any():
                yield w[hit], value[hit], ids[r[hit]]


def _histogram(anchors: Anchors, windows: Windows, same: bool):
    """Rows of each (window, bucket) of the open windows, summed in the task."""

    def run(batches):
        chosen = np.flatnonzero(~windows.settled)
        floor = np.maximum(windows.lo, windows.hi - (np.int64(1) << (windows.shift + DIGIT_BITS)) + 1)
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        for w, value, _ in _pairs(batches, anchors, windows, same, floor, windows.hi, chosen):
            key, count = np.unique(w << DIGIT_BITS | windows.hi[w] - value >> windows.shift[w], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, key]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, count])).astype(np.int64)
        w = keys >> DIGIT_BITS
        made = [pa.array(x, pa.int64()) for x in (w, keys & (1 << DIGIT_BITS) - 1, windows.need[w], sums)]
        yield pa.RecordBatch.from_arrays(made, ["w", "bucket", "need", "n"])

    return run


def _best(w: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int):
    """The best ``k`` of each window."""
    order = np.lexsort((ids, -score, w))
    w, score, ids = w[order], score[order], ids[order]
    start = np.searchsorted(w, w)
    keep = np.arange(len(w)) - start < k
    return w[keep], score[keep], ids[keep]


def _gather(anchors: Anchors, windows: Windows, same: bool):
    """Rows at or beyond each window's settled score, at most k of a window from a task."""

    def run(batches):
        held = tuple(np.empty(0, np.int64) for _ in range(3))
        for found in _pairs(batches, anchors, windows, same, windows.least, windows.top, np.arange(len(windows.anchor))):
            held = _best(*(np.concatenate(x) for x in zip(held, found)), windows.k)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], ["w", "score", "id"])

    return run


def _select(rows: DataFrame, anchors: Anchors, windows: Windows, same: bool) -> DataFrame:
    """w, score, id and rank of the best k rows of each window."""
    down = Window.partitionBy("w").orderBy("bucket")
    while not windows.settled.all():
        counts = map_arrow(rows, _histogram(anchors, windows, same), "w long, bucket long, need long, n long")
        sums = counts.groupBy("w", "bucket").agg(F.first("need").alias("need"), F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
        reached = sums.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
        windows.locate([tuple(r) for r in reached.select("w", "bucket", "n", "upto").collect()])  # at most a row for each window of the pass
    best = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    found = map_arrow(rows, _gather(anchors, windows, same), "w long, score long, id long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= windows.k)


def participants(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """id, label and integer components of the rows that take part."""
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.col("vector").isNotNull() & fine, F.lit(False)))
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return rows.select("id", "label", F.transform("vector", whole).alias("comps"))


def _passes(scratch: Scratch, rows: DataFrame, every: int, pass_anchors: int, pass_bytes: int):
    """Anchors in passes of bounded size; of one pass all vectors have one length."""
    anchors = rows.where(F.col("id") % every == 0).withColumn("dim", F.size("comps"))
    lengths = sorted(tuple(r) for r in anchors.groupBy("dim").count().collect())
    for dim, n in lengths:
        each = max(1, min(pass_anchors, pass_bytes // (8 * max(1, dim))))
        groups = -(-n // each)
        # groups by hash vary in size, so one that outgrows the bound is read in turns of ``each``
        own = anchors.where(F.col("dim") == dim).withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(groups)))
        own = scratch.keep(own.repartition("turn").sortWithinPartitions("turn"), f"anchors_{dim}") if groups > 1 else own
        for g in range(groups):
            held = []
            for r in own.where(F.col("turn") == g).select("id", "label", "comps").toLocalIterator():
                held.append(r)
                if len(held) == each:
                    yield dim, held
                    held = []
            if held:
                yield dim, held
        if groups > 1:
            scratch.drop(f"anchors_{dim}")


def mine_hard_negatives(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, pass_anchors: int = PASS_ANCHORS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``."""
    scratch = Scratch(vectors.sparkSession, "negatives")
    spark = scratch.spark
    rows = scratch.keep(participants(vectors, key, vector, label, scale), "rows")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    done = []
    for step, (dim, held) in enumerate(_passes(scratch, rows, every, pass_anchors, pass_bytes)):
        held.sort(key=lambda r: (r.id, r.label, r.comps))
        anchors = Anchors(np.array([r.id for r in held], np.int64), np.array([r.label for r in held], np.int64), np.array([r.comps for r in held], np.int64).reshape(len(held), dim))
        own = rows.where(F.size("comps") == dim)
        longest = own.agg(F.max(F.aggregate("comps", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x))).first()[0] or 0
        reach = np.array([isqrt(sum(v * v for v in r.comps) * longest) + 1 for r in held], np.int64)
        windows = Windows(np.arange(len(held)), -reach, reach, positives)
        near = _select(own, anchors, windows, True).orderBy("w", "rank").collect()  # ``positives`` an anchor of the pass
        if not near:
            continue
        a, score, ids = (np.array([r[c] for r in near], np.int64) for c in ("w", "score", "id"))
        windows = Windows(a, -(-low * score // 100), score, negatives)
        names = list(zip(anchors.ids[a].tolist(), ids.tolist(), score.tolist()))
        found = _select(own, anchors, windows, False)

        def name(batches, names=names):
            for batch in batches:
                w = batch.column("w").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i][0] for i in w], pa.int64()), pa.array([names[i][1] for i in w], pa.int64()), batch.column("rank").cast(pa.int32()), batch.column("id"), pa.array([names[i][2] for i in w], pa.int64()), batch.column("score")],
                    ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
                )

        scratch.keep(map_arrow(found, name, schema), f"found/step={step}")
        done.append(step)
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{scratch.root}/found/step={s}" for s in done])
