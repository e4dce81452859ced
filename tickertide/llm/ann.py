"""Approximate nearest neighbours by shifted space-filling curves.

Every vector gets a key on several curves: a seeded random projection to ``DIMS`` dimensions, a seeded
shift, a grid, and its Hilbert order. Rows are range-partitioned by key in Spark, which gives each
its rank on each curve; the candidates of a query are the rows at most ``width`` ranks away on some
curve. Windows are read in cells of ``CELL`` ranks, each with a bounded number of queries; a cell
returns the nearest of its rows, and the windows of all curves are merged and reranked.

All rows are indexed. ``fit_width`` measures the share of rows a window needs: for at most
``SAMPLE`` queries (smallest hash of the id) the true nearest rows of the whole table are found, and the
width is what finds ``recall`` of them. Data without structure need wide windows, clustered data narrow ones.

Defined results: vectors that are null, zero, of another length than most, or hold a null or
non-finite component, and rows without an id, take no part; of rows repeating an id the smallest
vector does; ties go to the smaller id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tickertide.llm.common import ordered_positions, stored

CURVES = 8
DIMS = 12
BITS = 4
CELL = 8192
SAMPLE = 128
RECALL = 0.95
SEED = 7
EVERY = 20
NEIGHBOURS = 20


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of grid points (rows; coordinates of ``bits`` bits), by undoing rotations bit by bit."""
    x = grid.T.astype(np.int64).copy()
    dims, high = len(x), 1 << (bits - 1)
    bit = high
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            flip = (x[i] & bit) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros_like(x[0]), high
    while bit > 1:
        turn ^= np.where(x[dims - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, length)


def clean_vectors(table: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and the length of their vectors."""
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = sizes[0] if sizes else 0
    return rows.filter(F.size("v") == length), length


def _nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed, k: int):
    """For each query its k nearest allowed rows: (query index, row index, score), ties to smaller ids."""
    found = []
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        scores = block @ rows.T
        scores[~allowed(at, at + len(block))] = -np.inf
        bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(block), -np.inf)
        for i, row in enumerate(scores):
            near = np.flatnonzero((row >= bound[i] - 1e-9 * (1 + abs(bound[i]))) & (row > -np.inf)) if bound[i] > -np.inf else np.flatnonzero(row > -np.inf)
            exact = (rows[near] * block[i]).sum(axis=1)  # the same sum for equal vectors, wherever they stand
            best = np.lexsort((ids[near], -exact))[:k]
            found.append((np.full(len(best), at + i), near[best], exact[best]))
    return [np.concatenate(x) if found else np.zeros(0) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def exact_neighbours(vectors: DataFrame, length: int, queries: Sequence[tuple[int, list[float]]], k: int) -> DataFrame:
    """The true nearest rows of a few given queries: one pass over all rows."""
    own = np.array([q for q, _ in queries], np.int64)
    sought = np.array([v for _, v in queries], np.float64).reshape(-1, length)

    def run(batches):
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(), _matrix(batch.column("v"), length)
            q, r, s = _nearest(sought, rows, ids, lambda a, b: ids[None, :] != own[a:b, None], k)
            yield pa.RecordBatch.from_arrays([pa.array(own[q.astype(np.int64)]), pa.array(ids[r.astype(np.int64)]), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return _merged(vectors.select("vec_id", "v").mapInArrow(run, "query_id bigint, vec_id bigint, score double"), k)


def curve_ranks(vectors: DataFrame, length: int, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """(curve, vec_id, rank): the place of every row on every curve."""
    draw = np.random.default_rng(seed)
    dims = min(dims, length)
    turns = [np.linalg.qr(draw.normal(size=(length, dims)))[0] for _ in range(curves)]
    shifts = draw.uniform(0, 0.1, size=(curves, dims))
    together = np.concatenate(turns, axis=1)

    def moments(batches):
        n, first, second = 0, np.zeros(together.shape[1]), np.zeros(together.shape[1])
        for batch in batches:
            z = _matrix(batch.column("v"), length) @ together
            n, first, second = n + len(z), first + z.sum(0), second + (z * z).sum(0)
        columns = [pa.array(np.arange(len(first))), pa.array(np.full(len(first), n)), pa.array(first), pa.array(second)]
        yield pa.RecordBatch.from_arrays(columns, ["axis", "n", "first", "second"])

    sums = vectors.select("v").mapInArrow(moments, "axis bigint, n bigint, first double, second double")
    sums = sums.groupBy("axis").agg(F.sum("n"), F.sum("first"), F.sum("second")).orderBy("axis").collect()
    n, first, second = (np.array([r[i] for r in sums], np.float64) for i in (1, 2, 3))
    mean = first / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(second / np.maximum(n, 1) - mean**2, 1e-30))

    def keys(batches):
        for batch in batches:
            z = (_matrix(batch.column("v"), length) @ together - mean) / spread
            u = 0.9 / (1 + np.exp(-np.clip(1.7 * z, -40, 40)))
            out = []
            for c in range(curves):
                grid = ((u[:, c * dims : (c + 1) * dims] + shifts[c]) * (1 << bits)).astype(np.int64)
                out.append(hilbert_keys(np.clip(grid, 0, (1 << bits) - 1), bits))
            at = np.arange(len(z) + 1, dtype=np.int32) * curves
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.stack(out, 1).ravel() if len(z) else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists], ["vec_id", "keys"])

    rows = vectors.select("vec_id", "v").mapInArrow(keys, "vec_id bigint, keys array<bigint>").select("vec_id", F.posexplode("keys").alias("curve", "key"))
    order = [F.col("curve"), F.col("key"), F.col("vec_id")]
    placed = ordered_positions(rows, order, {"position": F.lit(1).cast("bigint")}, "curves")
    total = vectors.count()
    return placed.select("curve", "vec_id", (F.col("position") - 1 - F.col("curve").cast("bigint") * total).alias("rank"))


def fit_width(vectors: DataFrame, length: int, ranks: DataFrame, every: int, k: int, recall: float = RECALL, sample: int = SAMPLE) -> int:
    """The window width, in ranks, that finds ``recall`` of the true nearest rows of sampled queries."""
    asked = vectors.filter(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not asked:
        return 1
    truth = exact_neighbours(vectors, length, [(r.vec_id, r.v) for r in asked], k).select("query_id", "vec_id")
    of_query = ranks.select("curve", F.col("vec_id").alias("query_id"), F.col("rank").alias("at"))
    far = truth.join(of_query, "query_id").join(ranks, ["curve", "vec_id"])
    far = far.groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("rank") - F.col("at"))).alias("gap"))
    gaps = sorted(r.gap for r in far.select("gap").collect())  # at most sample * k rows
    return max(gaps[min(len(gaps) - 1, int(recall * len(gaps)))] if gaps else 1, 2 * k)


def neighbours(
    table: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    every: int = EVERY,
    k: int = NEIGHBOURS,
    curves: int = CURVES,
    dims: int = DIMS,
    width: int | None = None,
    recall: float = RECALL,
    cell: int = CELL,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` its nearest rows found."""
    vectors, length = clean_vectors(table, vec_id, embedding)
    vectors = stored(vectors, "vectors")
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not length:
        return table.sparkSession.createDataFrame([], empty)
    ranks = stored(curve_ranks(vectors, length, curves, dims), "ranks")
    width = width or fit_width(vectors, length, ranks, every, k, recall)

    placed = ranks.join(vectors, "vec_id").withColumns({"cell": F.expr(f"rank div {cell}"), "wide": F.expr(f"rank div {cell * every}")})
    asks = placed.filter(F.col("vec_id") % every == 0).withColumn("asks", F.lit(True))
    first, last = (f"greatest(rank - {width}, 0) div {cell}", f"(rank + {width}) div {cell}")
    asks = asks.withColumn("cell", F.explode(F.sequence(F.expr(first), F.expr(last))))
    # A cell of rows goes to every stretch of queries that can reach it.
    low, high = F.expr(f"greatest(cell * {cell} - {width}, 0) div {cell * every}"), F.expr(f"((cell + 1) * {cell} + {width}) div {cell * every}")
    rows = placed.withColumn("asks", F.lit(False)).withColumn("wide", F.explode(F.sequence(low, high)))
    columns = ["curve", "cell", "wide", "asks", "vec_id", "rank", "v"]

    def search(unit: pa.Table) -> pa.Table:
        asked = np.array(unit.column("asks").to_pylist(), bool)
        ids, at = unit.column("vec_id").to_numpy(), unit.column("rank").to_numpy()
        v = _matrix(unit.column("v").combine_chunks(), length)
        own, own_at = ids[asked], at[asked]
        ids, at = ids[~asked], at[~asked]
        near = lambda a, b: (np.abs(at[None, :] - own_at[a:b, None]) <= width) & (ids[None, :] != own[a:b, None])
        q, r, s = _nearest(v[asked], v[~asked], ids, near, k) if len(own) and len(ids) else [np.zeros(0, np.int64)] * 3
        return pa.table({"query_id": pa.array(own[q.astype(np.int64)], pa.int64()), "vec_id": pa.array(ids[r.astype(np.int64)], pa.int64()), "score": pa.array(s, pa.float64())})

    units = asks.select(columns).unionByName(rows.select(columns))
    found = units.groupBy("curve", "cell", "wide").applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    return _merged(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
