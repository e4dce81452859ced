"""Hard-negative mining by a vertical scan (BOND).

Vectors hold integers, so scores are exact. Rows are dealt into blocks by a hash of the id, and each
block is stored dimension by dimension with the smallest and largest value of each. A block meets a
stretch of anchors in one task: for each anchor the dimensions are read in descending magnitude of its
own components, and what the unread dimensions can still add at least and at most bounds every row. A
bitmap keeps the rows that may still belong to the result:

* positives (nearest rows of the anchor's label): rows whose upper bound reaches the k-th best lower bound;
* negatives (rows of other labels whose score lies in a window below a positive's): rows whose bounds
  still meet some window, and within it reach the k-th best row that surely lies inside.

Each block gives at most k rows per anchor (and positive); the best of all blocks are merged.

Defined results: rows with a null id, null label, null vector or any null or non-finite component take
no part, nor do vectors of another length than most; zero vectors do; of rows that repeat an id the
smallest label and vector count; ties go to the smaller id; no positive or an empty window gives no
row; an empty table gives an empty result; components so large that a score could leave 64 bits are an
error; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.llm.common import stored

BLOCK = 16384  # rows of a block, on average
STRETCH = 16384  # anchors that meet a block at once, on average
STEP = 4  # dimensions read between two looks at the bounds
EVERY = 100
POSITIVES = 5
NEGATIVES = 5
WINDOW = (80, 100)  # percent of the positive's score
SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def integer_vectors(table: DataFrame, scale: float, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label") -> DataFrame:
    """(vec_id, label, v): the rows that take part, each component as floor(scale * x)."""
    name = F.col(label) if isinstance(label, str) else label
    wide = F.col(embedding).cast("array<double>")
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), name.cast("bigint").alias("label"), wide.alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    rows = rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * scale).cast("bigint")).alias("v"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v")


def _by_dimension(block: pa.Table) -> pa.Table:
    """One row: the rows of a block by label, and their components dimension by dimension."""
    labels, ids = (block.column(c).to_numpy() for c in ("label", "vec_id"))
    order = np.lexsort((ids, labels))
    v = block.column("v").combine_chunks()
    matrix = np.asarray(v.flatten()).reshape(len(v), -1)[order]
    columns = np.ascontiguousarray(matrix.T)
    return pa.table(
        {
            "block": pa.array([block.column("block")[0].as_py()], pa.int64()),
            "ids": pa.array([ids[order]], pa.list_(pa.int64())),
            "labels": pa.array([labels[order]], pa.list_(pa.int64())),
            "low": pa.array([columns.min(axis=1)], pa.list_(pa.int64())),
            "high": pa.array([columns.max(axis=1)], pa.list_(pa.int64())),
            "columns": pa.array([list(columns)], pa.list_(pa.list_(pa.int64()))),
        }
    )


def vertical_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    schema = "block bigint, ids array<bigint>, labels array<bigint>, low array<bigint>, high array<bigint>, columns array<array<bigint>>"
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(_by_dimension, schema)


def vertical_scan(columns: np.ndarray, low: np.ndarray, high: np.ndarray, anchor: np.ndarray, alive: np.ndarray, shrink: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows that ``shrink`` never gave up, and their exact scores.

    ``alive`` is the bitmap of candidates; ``shrink(lower, upper)`` says which of the rows with these
    bounds may still belong to the result.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[anchor[order] != 0]
    ends = np.stack([anchor[order] * low[order], anchor[order] * high[order]])
    least, most = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0)))  # of the dimensions from each on
    rows, scores = None, np.zeros(columns.shape[1], columns.dtype)
    for at in range(0, len(order), STEP):
        for d in order[at : at + STEP]:
            scores += anchor[d] * (columns[d] if rows is None else columns[d].take(rows))
        unread = min(at + STEP, len(order))
        if rows is None:
            alive = alive & shrink(scores + least[unread], scores + most[unread], alive)
            if 2 * np.count_nonzero(alive) <= len(alive):
                rows = np.flatnonzero(alive)
                scores = scores[rows]
        else:
            keep = shrink(scores + least[unread], scores + most[unread], None)
            rows, scores = rows[keep], scores[keep]
        if rows is not None and not len(rows):
            break
    if rows is None:
        rows = np.flatnonzero(alive)
        scores = scores[rows]
    return rows, scores


def _reach(lower: np.ndarray, k: int):
    """The k-th best lower bound; none if there are fewer rows."""
    return np.partition(lower, -k)[-k] if len(lower) >= k else None


def nearest_rule(k: int) -> Callable:
    def shrink(lower, upper, alive):
        bound = _reach(lower if alive is None else lower[alive], k)
        return np.ones(len(lower), bool) if bound is None else upper >= bound

    return shrink


def windows_rule(windows: Sequence[tuple[int, int]], k: int) -> Callable:
    """Rows that may be among the k best of some window (least and largest score)."""

    def shrink(lower, upper, alive):
        keep = np.zeros(len(lower), bool)
        width = upper[0] - lower[0] if len(lower) else 0  # the same for all rows
        for least, largest in windows:
            bound = least
            if width <= largest - least:
                inside = (lower >= least) & (upper <= largest)
                if alive is not None:
                    inside &= alive
                best = _reach(lower[inside], k)
                bound = least if best is None else max(least, best)
            keep |= (upper >= bound) & (lower <= largest)
        return keep

    return shrink


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids[rows], -scores))[:k]


class _Block:
    """A stored block in a task: in doubles where every sum is exact, else in long integers."""

    def __init__(self, table: pa.Table):
        row = {c: table.column(c).combine_chunks()[0].values for c in ("ids", "labels", "low", "high", "columns")}
        self.ids, self.labels, self.low, self.high = (row[c].to_numpy() for c in ("ids", "labels", "low", "high"))
        self.columns = np.asarray(row["columns"].flatten()).reshape(-1, len(self.ids))
        self.largest = np.maximum(np.abs(self.low), np.abs(self.high))

    def exact_for(self, anchors: np.ndarray) -> tuple:
        kind = np.float64 if (np.abs(anchors).max(axis=0, initial=0) * self.largest.astype(float)).sum() < 2.0**52 else np.int64
        return tuple(x.astype(kind) for x in (self.columns, self.low, self.high, anchors))


def _positives(k: int) -> Callable:
    def run(key, block: pa.Table, asked: pa.Table) -> pa.Table:
        found = [[], [], []]
        if block.num_rows and asked.num_rows:
            rows_of = _Block(block)
            own, labels = (asked.column(c).to_numpy() for c in ("vec_id", "label"))
            v = asked.column("v").combine_chunks()
            columns, low, high, anchors = rows_of.exact_for(np.asarray(v.flatten()).reshape(len(v), -1))
            rule = nearest_rule(k)
            for i, anchor in enumerate(anchors):
                # Rows lie by label: one slice holds the candidates.
                first, last = np.searchsorted(rows_of.labels, [labels[i], labels[i] + 1])
                ids = rows_of.ids[first:last]
                rows, scores = vertical_scan(columns[:, first:last], low, high, anchor, ids != own[i], rule)
                best = _best(rows, scores, ids, k)
                found[0].append(np.full(len(best), own[i]))
                found[1].append(ids[rows[best]])
                found[2].append(scores[best])
        columns = [pa.array(np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64)) for f in found]
        return pa.table(columns, ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(k: int, window: tuple[int, int]) -> Callable:
    def run(key, block: pa.Table, asked: pa.Table) -> pa.Table:
        found = [[] for _ in range(5)]
        if block.num_rows and asked.num_rows:
            rows_of = _Block(block)
            own, labels = (asked.column(c).to_numpy() for c in ("vec_id", "label"))
            v = asked.column("v").combine_chunks()
            columns, low, high, anchors = rows_of.exact_for(np.asarray(v.flatten()).reshape(len(v), -1))
            for i, (anchor, positives) in enumerate(zip(anchors, asked.column("positives").to_pylist())):
                # Smallest and largest integer score of each window.
                spans = {p["score"]: (-(-window[0] * p["score"] // 100), window[1] * p["score"] // 100) for p in positives}
                open_ones = [s for s in spans.values() if s[0] <= s[1]]
                if not open_ones:
                    continue
                rows, scores = vertical_scan(columns, low, high, anchor, rows_of.labels != labels[i], windows_rule(open_ones, k))
                for p in positives:
                    least, largest = spans[p["score"]]
                    inside = np.flatnonzero((scores >= least) & (scores <= largest))
                    best = inside[_best(rows[inside], scores[inside], rows_of.ids, k)]
                    for out, value in zip(found, (own[i], p["id"], rows_of.ids[rows[best]], p["score"], scores[best])):
                        out.append(np.broadcast_to(value, len(best)))
        columns = [pa.array(np.concatenate(f).astype(np.int64) if f else np.zeros(0, np.int64)) for f in found]
        return pa.table(columns, ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def _top(found: DataFrame, keys: Sequence[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The k best rows per key; Spark keeps k per key and task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), vec_id))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    block: int = BLOCK,
    stretch: int = STRETCH,
) -> DataFrame:
    """The hard negatives of each anchor (rows whose id is divisible by ``every``) and positive.

    Takes ``integer_vectors``. A negative has another label and a score between the two percentages of
    ``window`` of the positive's score.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors, "integer-vectors")
    size = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None or not size.n:
        return spark.createDataFrame([], SCHEMA)
    vectors = vectors.filter(F.size("v") == size.n)
    largest = vectors.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()[0]
    if largest**2 * size.n >= 2.0**62:
        raise ValueError("components are too large for scores of 64 bits")
    asked = vectors.filter(F.col("vec_id") % every == 0)
    n_blocks, n_stretches = max(1, -(-size["count"] // block)), max(1, -(-asked.count() // stretch))
    blocks = stored(vertical_blocks(vectors, n_blocks), "vertical-blocks")
    meet = ["block", "stretch"]
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    blocks = blocks.withColumn("stretch", numbers(n_stretches))
    asked = asked.withColumn("stretch", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_stretches)))

    def scan(anchors: DataFrame, fn: Callable, schema: str) -> DataFrame:
        spread = anchors.withColumn("block", numbers(n_blocks))
        return blocks.groupBy(*meet).cogroup(spread.groupBy(*meet)).applyInArrow(fn, schema)

    near = scan(asked, _positives(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = stored(_top(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("positives")
    )
    hard = scan(
        asked.join(lists, "vec_id"),
        _negatives(negatives, window),
        "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint",
    )
    best = _top(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
