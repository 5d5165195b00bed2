"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

The rows are dealt at random into blocks; a block holds, for each dimension, its rows in order
of that component. An anchor goes down all lists at once, from the high end where its own
component is positive and from the low end where it is negative (a zero component's list
says nothing). Each row met is scored by its whole integer inner product. What no list has
shown yet cannot score more than the anchor's product with the components last seen: once
that threshold is strictly below the kth score of every window asked for (or below the window itself), the
rest of the block is left unseen. Equal scores go by id, hence strictly.

First the positives: each anchor's best rows of its own label, in lists of that label. Their
scores give the windows in which the negatives must lie. Each block answers for itself,
with at most k rows for each window, and the blocks' answers are merged by Spark. Both
sides of a task are bounded: ``block`` rows and ``block`` anchors.

Defined results: rows without an id, label or vector, or with any null or non-finite component, take
no part. Rows of one id are one row, the least by label and vector. Of vectors that differ in
length the shorter one counts as padded with zeros. Scores are exact integers; components
so large that a score could leave 64 bits raise an error. No anchors or rows: no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.staging import staged

BLOCK = 8192
FIRST_DEPTH, DEEPER = 64, 4
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
SCALE = 256


def vectors(df: DataFrame, label: Column, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, label, ints): the rows that take part, components as floor(scale * x)."""
    x = F.col(embedding)
    sound = F.col(vec_id).isNotNull() & label.isNotNull() & x.isNotNull() & F.forall(
        x, lambda e: F.coalesce(F.abs(e.cast("double")) < float("inf"), F.lit(False)))
    ints = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    rows = df.where(sound).select(F.col(vec_id).alias("id"), label.alias("label"), ints.alias("ints"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "ints")).alias("row")).select("id", "row.label", "row.ints")


class SortedLists:
    """Rows of a block with, for each dimension, their places in ascending order of that component."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray):
        self.ids, self.ints = ids, ints
        self.order = np.ascontiguousarray(np.argsort(ints, axis=0, kind="stable").T)
        self.values = np.ascontiguousarray(np.sort(ints, axis=0).T)
        # Products and sums below 2^53 are exact as floating point, and fast; others stay integers.
        self.most = int(np.abs(ints).max(initial=0))
        self.exact = ints.astype(np.float64) if self.most < 1 << 26 else None

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        bound = self.most * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor))
        if bound >= 1 << 63:
            raise ValueError("components too large for scores of 64 bits")
        if self.exact is not None and bound < 1 << 53:
            return (self.exact[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.ints[rows] @ anchor

    def search(self, anchor: np.ndarray, able: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list[np.ndarray], int]:
        """For each window (lowest, highest score) the first k of the ``able`` rows in it, as rows (score, id), best
        first; and how many rows were scored."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        best = [np.zeros((0, 2), np.int64) for _ in windows]
        open_ = [w for w, (low, high) in enumerate(windows) if low <= high]
        start, stop = 0, min(FIRST_DEPTH, n)
        while open_ and start < n:
            met = np.zeros(n, bool)
            met[self.order[up, n - stop:n - start].ravel()] = True
            met[self.order[down, start:stop].ravel()] = True
            if not len(up) and not len(down):
                met[:] = True  # every score is 0
                stop = n
            fresh = np.flatnonzero(met & ~seen)
            seen |= met
            fresh = fresh[able[fresh]]
            score = self.scores(fresh, anchor)
            bound = int(anchor[up] @ self.values[up, n - stop]) + int(anchor[down] @ self.values[down, stop - 1])
            still = []
            for w in open_:
                low, high = windows[w]
                inside = (score >= low) & (score <= high)
                found = np.concatenate([best[w], np.stack([score[inside], self.ids[fresh[inside]]], 1)])
                best[w] = found[np.lexsort((found[:, 1], -found[:, 0]))[:k]]
                kth = best[w][-1, 0] if len(best[w]) == k else low
                if bound >= kth:
                    still.append(w)
            open_ = still
            start, stop = stop, min(n, stop * DEEPER)
        return best, int(seen.sum())


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks() if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(lists), width), np.int64)
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lists)), lengths), at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _both(rows: pa.Table, anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of both tables, padded to one length."""
    width = max(pc.max(pc.list_value_length(t.column("ints"))).as_py() or 0 for t in (rows, anchors))
    return _matrix(rows.column("ints"), width), _matrix(anchors.column("ints"), width)


def _table(names: list[str], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names)


def _positives(k: int):
    names = ["anchor_id", "positive_id", "positive_score"]

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _table(names, [])
        ints, wanted = _both(rows, anchors)
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        own = anchors.column("label").to_numpy()
        out: list[tuple] = []
        everything = (-(1 << 63), (1 << 63) - 1)
        for label in np.unique(own):
            held = np.flatnonzero(labels == label)
            lists = SortedLists(ids[held], ints[held])
            for i in np.flatnonzero(own == label):
                anchor = anchors.column("id")[int(i)].as_py()
                found, _ = lists.search(wanted[i], lists.ids != anchor, [everything], k)
                out += [(anchor, int(b), int(s)) for s, b in found[0]]
        return _table(names, out)

    return find, "anchor_id long, positive_id long, positive_score long"


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and greatest negative score with low * score <= 100 * negative <= high * score."""
    return -(-low * score // 100), high * score // 100


def _negatives(k: int, low: int, high: int):
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def find(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return _table(names, [])
        ints, wanted = _both(rows, anchors)
        lists, labels = SortedLists(rows.column("id").to_numpy(), ints), rows.column("label").to_numpy()
        out: list[tuple] = []
        for i, (anchor, label, positives) in enumerate(zip(*(anchors.column(c).to_pylist() for c in ("id", "label", "positives")), strict=True)):
            windows = [window_of(p["positive_score"], low, high) for p in positives]
            found, _ = lists.search(wanted[i], labels != label, windows, k)
            for p, best in zip(positives, found, strict=True):
                out += [(anchor, p["positive_id"], p["positive_score"], int(b), int(s)) for s, b in best]
        return _table(names, out)

    return find, ", ".join(f"{x} long" for x in names)


def _by_blocks(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int, find, schema: str) -> DataFrame:
    """``find`` for every block of rows with every chunk of anchors."""
    left = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of their own: both sides come from one stage
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(find, schema)


def mined(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
          block: int = BLOCK) -> DataFrame:
    """Hard negatives of the rows for which ``anchors`` holds: for each of an anchor's first ``positives`` rows of its
    label the first ``negatives`` rows of other labels that score between ``low`` and ``high`` per cent of it.

    ``rows`` as from ``vectors``, of unique ids.
    """
    kept = staged(rows.select("id", F.col("label").cast("long").alias("label"), "ints"), "vectors")
    counts = kept.agg(F.count("*"), F.count_if(anchors)).first()
    blocks, chunks = (max(1, -(-n // block)) for n in counts)
    dealt = kept.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "id"), F.lit(blocks)).cast("int"))
    asked = kept.where(anchors).withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "id"), F.lit(chunks)).cast("int"))
    near = _by_blocks(dealt, asked, blocks, chunks, *_positives(positives))
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    near = staged(near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "positives")
    with_windows = asked.join(near, asked["id"] == near["anchor_id"]).drop("anchor_id")
    far = _by_blocks(dealt, with_windows, blocks, chunks, *_negatives(negatives, low, high))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
