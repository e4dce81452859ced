"""Linear models from cross products: one pass over the rows serves any number of models.

Means and centred cross products of a vector column are taken per task in Arrow batches and merged by
Spark, a row per task and pair of components, so what comes to the driver depends on the number of features and
keys alone. A model is then a small system of equations, and its error on any split follows from the
moments of that split without predicting a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.operators.fit import configurations, pooled
from tickertide.operators.windows import ROUNDING, feature_set
from tickertide.session import shared_dir

MAX_FEATURES = 2000  # a system of this size is solved on the driver in seconds


@dataclass
class Moments:
    """Rows, means and centred cross products of a vector whose last component is the target."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    def of(self, features: Sequence[int]) -> Moments:
        """The same for some of the features and the target."""
        some = [*features, len(self.mean) - 1]
        return Moments(self.n, self.mean[some], self.cross[np.ix_(some, some)])


def complete_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector and components are neither null nor NaN."""
    return rows.filter(F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v)))


def cross_products(rows: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """(keys, i, j, n, mean_i, mean_j, cross) of the components of ``vector``, i up to j.

    Vectors of one key have one length. Rows with a missing component are left out.
    """
    keys = list(keys)
    kept = complete_vectors(rows, vector).select(*keys, F.col(vector).cast("array<double>").alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches: Iterable[pa.RecordBatch]):
        held: dict[tuple, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            named = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            group = np.fromiter((number.setdefault(k, len(number)) for k in named), np.int64, len(named))
            lists = batch.column("vector")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            for key, g in number.items():
                at = np.flatnonzero(group == g)
                size = int(ends[at[0] + 1] - ends[at[0]])
                z = flat[ends[at][:, None] + np.arange(size)]
                mean = z.mean(axis=0)
                centred = z - mean
                new = [len(z), mean, centred.T @ centred]
                held[key] = _merged(held[key], new) if key in held else new
        for key, (n, mean, cross) in held.items():
            i, j = np.triu_indices(len(mean))
            columns = [pa.array([k] * len(i), pa_kind) for k, pa_kind in zip(key, key_kinds)]
            columns += [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n))]
            columns += [pa.array(mean[i]), pa.array(mean[j]), pa.array(cross[i, j])]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "i", "j", "n", "mean_i", "mean_j", "cross"])

    key_kinds = [pa.string() if kinds[k] == "string" else pa.float64() if kinds[k] == "double" else pa.int64() if kinds[k] == "bigint" else pa.int32() for k in keys]
    schema = "".join(f"`{k}` {kinds[k]}, " for k in keys) + "i int, j int, n bigint, mean_i double, mean_j double, cross double"
    parts = kept.mapInArrow(run, schema)
    # Products of deviations from the common mean, so that large means cost no digits.
    cell = [*keys, "i", "j"]
    w = Window.partitionBy(*cell)
    total = F.sum("n").over(w)
    common = {f"all_{c}": F.sum(F.col("n") * F.col(f"mean_{c}")).over(w) / total for c in ("i", "j")}
    away = F.col("n") * (F.col("mean_i") - F.col("all_i")) * (F.col("mean_j") - F.col("all_j"))
    return parts.withColumns(common).groupBy(*cell).agg(
        F.sum("n").alias("n"), F.first("all_i").alias("mean_i"), F.first("all_j").alias("mean_j"), F.sum(F.col("cross") + away).alias("cross")
    )


def _merged(a: list, b: list) -> list:
    n = a[0] + b[0]
    away = b[1] - a[1]
    return [n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)]


def collected(products: DataFrame, keys: Sequence[str]) -> dict[tuple, Moments]:
    """The moments of every key: as many numbers as pairs of components, whatever the number of rows."""
    rows: dict[tuple, list] = {}
    for r in products.collect():
        rows.setdefault(tuple(r[k] for k in keys), []).append(r)
    out = {}
    for key, cells in rows.items():
        size = max(c.j for c in cells) + 1
        cross, mean = np.zeros((size, size)), np.zeros(size)
        for c in cells:
            cross[c.i, c.j] = cross[c.j, c.i] = c.cross
            mean[c.i] = c.mean_i
            mean[c.j] = c.mean_j
        out[key] = Moments(int(cells[0].n), mean, cross)
    return out


def ridge(train: Moments, l2: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and slopes of least squares with an l2 penalty, as ``fit_regressor`` defines it.

    The penalty applies to slopes of standardised features and is divided by the deviation
    of the target (population deviations). A feature with one value gets slope 0.
    """
    if l2 < 0:
        raise ValueError("l2 must not be negative")
    p = len(train.mean) - 1
    if p > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    if train.n < 2:
        raise ValueError("too few rows to fit")
    spread = train.cross.diagonal() / train.n
    moving = np.flatnonzero(spread[:p] > (np.abs(train.mean[:p]) * ROUNDING) ** 2)
    scale = np.sqrt(spread[moving])
    square = train.cross[np.ix_(moving, moving)] / train.n / np.outer(scale, scale)
    if l2 and spread[p] > 0:
        square = square + np.eye(len(moving)) * (l2 / math.sqrt(spread[p]))
    if len(moving) and np.linalg.cond(square) > 1e12:
        raise ValueError("the features are linearly dependent")
    slopes = np.zeros(p)
    slopes[moving] = np.linalg.solve(square, train.cross[moving, p] / train.n / scale) / scale
    return float(train.mean[p] - slopes @ train.mean[:p]), slopes


def measures(tested: Moments, intercept: float, slopes: np.ndarray) -> dict[str, float]:
    """Measures of a linear model that depend on moments only."""
    p, n = len(slopes), tested.n
    z, y = tested.mean[:p], float(tested.mean[p])
    zz, zy, yy = tested.cross[:p, :p], tested.cross[:p, p], float(tested.cross[p, p])
    mean_pred, square_pred = intercept + float(slopes @ z), max(float(slopes @ zz @ slopes), 0.0)
    squares = max(float(yy - 2 * slopes @ zy + square_pred), 0.0) + n * (mean_pred - y) ** 2
    ratio = lambda mean, square: float(mean / math.sqrt(square / n)) if square > 0 else 0.0
    return {
        "n": n,
        "mse": squares / n,
        "rmse": math.sqrt(squares / n),
        "r2": float(1 - squares / yy) if n > 1 and yy > 0 else (0.0 if n > 1 else None),
        "sharpe_pred": ratio(mean_pred, square_pred),
        "sharpe_true": ratio(y, yy),
    }


# ---- sweeps ---------------------------------------------------------------------

RUNS = (
    "run_id string, seq_len int, feature_set string, pool string, l2 double, status string, error string, "
    "n bigint, mse double, rmse double, r2 double, sharpe_pred double, sharpe_true double"
)


def linear_sweep(windows: DataFrame, grid: Mapping[str, Iterable], columns: Sequence[str], split: str = "val") -> DataFrame:
    """Fit a linear model per configuration on the train windows; its measures on ``split``.

    ``windows`` has ``seq_len``, ``split``, ``x`` (steps of ``columns``) and ``y`` (see
    ``length_windows``). The grid lists seq_len, feature_set, pool and l2. The windows are read once:
    moments of all columns are taken per length and pool, a feature set is a part of them and an l2 value
    one more solution. A configuration that can't be fitted is a row with its error.
    """
    names = list(columns)
    pools = list(dict.fromkeys(grid["pool"]))
    known = [p for p in pools if _pool_error(p) is None]
    y = F.array(F.col("y").cast("double"))
    made = [F.struct(F.lit(p).alias("pool"), F.concat(pooled("x", len(names), p), y).alias("vector")) for p in known]
    found = {}
    if made:
        rows = windows.filter(F.col("split").isin("train", split) & F.col("seq_len").isin(list(grid["seq_len"])))
        rows = rows.select(F.col("seq_len").cast("int").alias("seq_len"), "split", F.explode(F.array(*made)).alias("m"))
        keys = ["seq_len", "pool", "split"]
        found = collected(cross_products(rows.select("seq_len", "split", "m.pool", "m.vector"), keys), keys)

    def fitted(config: dict) -> dict:
        problem = _pool_error(config["pool"])
        if problem:
            raise ValueError(problem)
        chosen = [names.index(c) for c in feature_set(config["feature_set"])]
        parts = []
        for s in ("train", split):
            if (config["seq_len"], config["pool"], s) not in found:
                raise ValueError(f"no {s} windows")
            moments = found[config["seq_len"], config["pool"], s]
            steps = (len(moments.mean) - 1) // len(names)  # more than one where windows are flattened
            parts.append(moments.of([k * len(names) + c for k in range(steps) for c in chosen]))
        return measures(parts[1], *ridge(parts[0], config["l2"]))

    records = []
    for config in configurations(grid):
        try:
            records.append({**config, "status": "done", "error": None, **fitted(config)})
        except ValueError as error:
            records.append({**config, "status": "failed", "error": str(error)})
    fields = [f.split()[0] for f in RUNS.split(", ")]
    rows = [tuple(float(r[f]) if f == "l2" else r.get(f) for f in fields) for r in records]
    return windows.sparkSession.createDataFrame(rows, RUNS)


def _pool_error(pool: str) -> str | None:
    try:
        pooled("x", 1, pool)
    except ValueError as error:
        return str(error)
    return None


# ---- ticker effects ----------------------------------------------------------------

def _dot(slopes: Sequence[float], z: Column) -> Column:
    return sum((F.lit(float(b)) * F.element_at(z, k + 1) for k, b in enumerate(slopes)), F.lit(0.0))


FEW_COMPONENTS = 6  # features and target whose products are columns of one aggregate


def _per_ticker(train: DataFrame, size: int) -> tuple[DataFrame, Moments]:
    """Means per ticker, and the moments of the deviations from them: one pass, its rows (one per ticker) stored."""
    value = lambda k: F.element_at("vector", k + 1)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    spread = [F.covar_pop(value(i), value(j)) * F.count("*") for i, j in pairs]
    means = F.array(*[F.avg(value(k)) for k in range(size)]).alias("mean")
    sums = train.groupBy("ticker").agg(means, F.count("*").alias("n"), F.array(*spread).alias("cross"), F.max(F.size("vector")).alias("size"))
    path = shared_dir(train.sparkSession, "ticker-moments")
    sums.write.parquet(path)
    stored = train.sparkSession.read.schema(sums.schema).parquet(path)
    total = stored.agg(F.sum("n"), F.max("size"), *[F.sum(F.get("cross", F.lit(k))) for k in range(len(pairs))]).first()
    if total[1] != size:
        raise ValueError("vectors differ in length")
    cross = np.zeros((size, size))
    for (i, j), together in zip(pairs, total[2:]):
        cross[i, j] = cross[j, i] = together
    return stored.select("ticker", "mean", "n"), Moments(int(total[0]), np.zeros(size), cross)


def fit_ticker_effects(windows: DataFrame, z: Column, l2: float = 0.0) -> tuple[np.ndarray, DataFrame]:
    """Common slopes and a level per ticker, on the train windows: (slopes, (ticker, effect, n)).

    ``z`` is an array of features. The levels are partialled out: features and target lose their ticker
    means, the slopes are fitted to what is left, and the level of a ticker is its mean target less the
    slopes times its mean features. Nothing is as wide as the list of tickers; the levels stay a table.
    A penalty applies to the slopes only.
    """
    train = complete_vectors(
        windows.filter(F.col("split") == "train").select("ticker", F.concat(z, F.array(F.col("y").cast("double"))).alias("vector"))
    )
    any_row = train.select(F.size("vector")).first()
    if any_row is None:
        raise ValueError("no train windows")
    size = any_row[0]
    if size <= FEW_COMPONENTS:
        means, within = _per_ticker(train, size)
    else:
        means = train.groupBy("ticker").agg(F.array(*[F.avg(F.element_at("vector", k + 1)) for k in range(size)]).alias("mean"), F.count("*").alias("n"))
        levels = means.withColumnRenamed("ticker", "_ticker").select("_ticker", "mean")
        centred = train.join(levels, F.col("ticker").eqNullSafe(F.col("_ticker")))
        centred = centred.select(F.zip_with("vector", "mean", lambda v, m: v - m).alias("vector"))
        within = collected(cross_products(centred, []), [])[()]
    _, slopes = ridge(within, l2)
    effect = F.element_at("mean", size) - _dot(slopes, F.col("mean"))
    return slopes, means.select("ticker", effect.alias("effect"), "n")


def predict_with_effects(windows: DataFrame, z: Column, slopes: Sequence[float], effects: DataFrame, splits: Iterable[str] = ("val", "test")) -> DataFrame:
    """Add ``pred``; a ticker without train windows gets the mean level of the train windows."""
    usual = effects.agg(F.sum(F.col("effect") * F.col("n")) / F.sum("n")).scalar()
    known = effects.select(F.col("ticker").alias("_ticker"), "effect")
    joined = windows.filter(F.col("split").isin(list(splits))).join(known, F.col("ticker").eqNullSafe(F.col("_ticker")), "left")
    return joined.withColumn("pred", F.coalesce("effect", usual) + _dot(slopes, z)).drop("_ticker", "effect")
