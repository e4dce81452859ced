"""Queries over predictions: baselines, measures, comparisons of runs, studies."""

from functools import partial

from pyspark.sql import functions as F

from tickertide.operators import features as feats
from tickertide.operators import metrics as ops
from tickertide.operators import studies
from tickertide.operators import windows as win
from tickertide.plans import feature_queries as fq
from tickertide.plans import fixtures as fx
from tickertide.plans import registry
from tickertide.plans.registry import s
from tickertide.session import shared_dir
from tickertide.sources import writers

# Sums of squares reach millions, so measures are compared to four decimals.
DIGITS = 4
r = partial(registry.r, digits=DIGITS)
query = partial(registry.query, digits=DIGITS)

# (run, hidden size, layers, shrink, shift): a prediction is last return * shrink + shift.
RUNS = [
    ("run_0", 32, 1, 0.50, 0.0),
    ("run_1", 64, 1, -0.10, 0.01),
    ("run_2", 64, 2, 0.05, 0.50),
    ("run_3", 128, 2, -0.40, -0.02),
]
# (feature set, weight of the last sentiment, weight of the last price)
SETS = [
    ("price_only", 0.0, 1.0),
    ("price_volume", 0.0, 0.9),
    ("price_volume_sentiment", 0.2, 0.8),
    ("all_features", -0.1, 0.85),
    ("sentiment_only", 0.5, 0.7),
]


def _values(rows) -> str:
    cells = lambda row: ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}" + ("e0" if isinstance(v, float) else "") for v in row)
    return "(VALUES " + ", ".join(f"({cells(row)})" for row in rows) + ")"


def measures_sql(
    pred: str = "pred", true: str = "y", short: bool = False, prefix: str = ""
) -> str:
    e = f"({pred} - {true})"
    cols = {
        "mse": f"avg({e} * {e})",
        "mae": f"avg(abs({e}))",
        "rmse": f"sqrt(avg({e} * {e}))",
        "dir_acc": f"avg(CAST(sign({pred}) = sign({true}) AS DOUBLE))",
    }
    if not short:
        cols["r2"] = (
            f"CASE WHEN count(*) > 1 THEN coalesce(1 - sum({e} * {e}) / nullif(var_pop({true}) * count(*), 0), 0) END"
        )
        cols["sharpe_pred"] = f"coalesce(avg({pred}) / nullif(stddev_pop({pred}), 0), 0)"
        cols["sharpe_true"] = f"coalesce(avg({true}) / nullif(stddev_pop({true}), 0), 0)"
    return ", ".join(f"{r(v)} AS {prefix}{k}" for k, v in cols.items())


fx.CTES["fx_pred"] = (
    "SELECT ticker, date, split, y, last_return AS base_pred, last_return * -0.3e0 + 0.8e0 AS pred, last_close "
    "FROM fx_windows WHERE split IS NOT NULL"
)
fx.CTES["fx_runs"] = (
    "SELECT run_id, hidden_size, num_layers, ticker, date, split, y, base_pred, base_pred * shrink + shift AS pred "
    f"FROM fx_pred CROSS JOIN {_values(RUNS)} t(run_id, hidden_size, num_layers, shrink, shift)"
)


def samples(spark, folder):
    sets = fq.split_windows(spark, folder)
    return sets.select(
        "ticker", "date", "split", "y", F.col("last_return").alias("base_pred"),
        (F.col("last_return") * -0.3 + 0.8).alias("pred"), "last_close",
    )


def configs(spark):
    schema = "run_id string, hidden_size int, num_layers int, shrink double, shift double"
    return spark.createDataFrame(RUNS, schema)


def _each(values, names, value=None):
    """One copy of every row per item of a short fixed list."""
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in values]))


def run_predictions(rows):
    rows = rows.drop("pred", "last_close")
    rows = rows.withColumn("c", _each(RUNS, ["run_id", "hidden_size", "num_layers", "shrink", "shift"]))
    pred = F.col("base_pred") * F.col("c.shrink") + F.col("c.shift")
    return rows.select("c.run_id", "ticker", "date", "split", "y", "base_pred", pred.alias("pred"))


# ---- baselines --------------------------------------------------------------------

@query("persistence_per_ticker__i1_i7", "SELECT ticker, count(*) AS n, " + measures_sql("last_return")
       + " FROM fx_all_windows GROUP BY 1")
def _(spark, folder):
    """Bars with sentiment, features, windows and next-day target; persistence per ticker."""
    return ops.regression_metrics(ops.persistence(fq.targets(spark, folder)), ["ticker"])


@query("persistence_close__i1_i8", "SELECT split, count(*) AS n, "
       + measures_sql("last_close", "next_close", short=True)
       + " FROM (SELECT w.split, w.last_close, f.next_close FROM fx_windows w JOIN fx_feat f ON f.ticker = w.ticker "
       "AND f.rn = w.rn WHERE w.split IS NOT NULL) GROUP BY 1")
def _(spark, folder):
    close = win.sliding_windows(*fq.inputs(spark, folder), seq_len=fq.SEQ, target_kind="close").drop("x")
    stored = writers.load_or_build(spark, shared_dir(spark, "closes"), lambda: close)
    sets = win.calendar_split(stored, fq.TRAIN, fq.TEST)
    return ops.regression_metrics(ops.persistence(sets, "close"), ["split"], short=True)


@query("persistence_scaled__i1_c9", f"SELECT ticker, {s('date')} AS date, {r('p_scaled')} AS pred FROM fx_yscaled")
def _(spark, folder):
    sets = fq.split_windows(spark, folder)
    out = ops.persistence(sets, "return", fq.target_scalers(sets))
    return out.select("ticker", "date", "pred")


@query("persistence_from_cells__i2", f"SELECT ticker, {s('date')} AS date, {r('last_return')} AS pred FROM fx_all_windows")
def _(spark, folder):
    out = ops.persistence_from_cells(fq.windows(spark, folder), feats.FEATURES)
    return out.select("ticker", "date", "pred")


_BASE = {
    "naive": "(x_last + 1) * y_base",
    "mean": "((x_1 + x_2 + x_3 + x_4 + x_5) / 5 + 1) * y_base",
    "momentum": "(x_1 + (x_1 - x_5) / 4 + 1) * y_base",
}


@query("price_baselines__i3_i4_i5", "SELECT ticker, split, split_pos, "
       + ", ".join(f"{r(e, digits=5)} AS {n}" for n, e in _BASE.items()) + " FROM fx_horizon", digits=5)
def _(spark, folder):
    out = fq.price_windows(spark, folder)
    for name, fn in (("naive", ops.naive_price), ("mean", ops.moving_average_price), ("momentum", ops.momentum_price)):
        out = fn(out).withColumn(name, F.col("pred_price"))
    return out.select("ticker", "split", "split_pos", *_BASE)


@query("direction_baselines__i6", f"SELECT {r('greatest(avg(CAST(y = 1 AS DOUBLE)), avg(CAST(y = 0 AS DOUBLE)))')} AS majority, "
       "0.5e0 AS random FROM fx_direction")
def _(spark, folder):
    return ops.direction_baselines(fx.directions(spark, folder))


# ---- measures ------------------------------------------------------------------------

@query("regression_metrics__i7", "SELECT ticker, split, count(*) AS n, " + measures_sql() + " FROM fx_pred GROUP BY 1, 2")
def _(spark, folder):
    return ops.regression_metrics(samples(spark, folder), ["ticker", "split"])


@query("baseline_metrics__i8", "SELECT split, count(*) AS n, " + measures_sql("base_pred", short=True) + " FROM fx_pred GROUP BY 1")
def _(spark, folder):
    return ops.regression_metrics(samples(spark, folder), ["split"], pred="base_pred", short=True)


_PRICE_PRED = "(x_last * 0.9e0 + 0.01e0)"


def price_measures_sql(pred: str, rounded: bool = True) -> str:
    t, p, n = "target_price", f"(({pred} + 1) * y_base)", "((x_last + 1) * y_base)"
    y = "(target_price / y_base - 1)"
    pct = lambda v: f"avg(abs(({t} - {v}) / {t})) * 100"
    cols = {
        "mae": f"avg(abs({t} - {p}))",
        "rmse": f"sqrt(avg(({t} - {p}) * ({t} - {p})))",
        "r2": f"1 - sum(({t} - {p}) * ({t} - {p})) / (var_pop({t}) * count(*))",
        "mape": pct(p),
        "naive_mape": pct(n),
        "mape_vs_naive": f"{pct(p)} - {pct(n)}",
        "direction_accuracy": f"avg(CAST(({pred} > x_last) = ({y} > x_last) AS DOUBLE)) * 100",
    }
    return "count(*) AS n, " + ", ".join(f"{r(v) if rounded else v} AS {k}" for k, v in cols.items())


def price_predictions(spark, folder, horizon=1):
    rows = fq.price_windows(spark, folder, horizon)
    return rows.withColumn("pred", ops.last_move(rows) * 0.9 + 0.01)


@query("price_metrics__i9", f"SELECT split, {price_measures_sql(_PRICE_PRED)} FROM fx_horizon GROUP BY 1")
def _(spark, folder):
    return ops.price_metrics(price_predictions(spark, folder), ["split"])


@query("price_direction__i10", f"SELECT ticker, split, split_pos, CAST({_PRICE_PRED} > x_last AS BIGINT) AS pred_up, "
       "CAST(target_price / y_base - 1 > x_last AS BIGINT) AS true_up FROM fx_horizon")
def _(spark, folder):
    out = ops.with_price_direction(price_predictions(spark, folder))
    return out.select("ticker", "split", "split_pos", "pred_up", "true_up")


def _direction_sql(source: str, by: str = "", threshold: float = 0.5) -> str:
    """Measures by their definitions; the ROC area by comparing score groups pairwise."""
    c = f"CAST(p >= {threshold}e0 AS INTEGER)"
    cnt = lambda y, k: f"count(*) FILTER (y = {y} AND {c} = {k})"
    share = lambda a, b: f"coalesce(({a}) * 100.0e0 / nullif({b}, 0), 0)"
    tp, fp, fn, tn = cnt(1, 1), cnt(0, 1), cnt(1, 0), cnt(0, 0)
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    match = f"a.{by} = b.{by} AND " if by else ""
    accuracy = share(f"{tp} + {tn}", "count(*)")
    majority = "greatest(avg(CAST(y = 1 AS DOUBLE)), avg(CAST(y = 0 AS DOUBLE))) * 100"
    grouped = f"SELECT {key}p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY {key}p"
    auc = (
        f"SELECT {'a.' + by + ', ' if by else ''}coalesce(sum(a.pos * b.neg * CASE WHEN a.p > b.p THEN 1.0e0 WHEN a.p = b.p THEN 0.5e0 ELSE 0 END) "
        f"/ nullif(sum(a.pos * b.neg), 0), 0.5) * 100 AS auc FROM ({grouped}) a JOIN ({grouped}) b ON {match}true "
        + (f"GROUP BY a.{by}" if by else "")
    )
    return (
        f"SELECT {'m.' + by + ', ' if by else ''}tp, fp, fn, tn, {r('accuracy')} AS accuracy, {r('prec')} AS precision, {r('recall')} AS recall, "
        f"{r('f1')} AS f1, {r('accuracy - 50')} AS vs_random, {r('auc')} AS auc, {r('majority')} AS baseline_accuracy, "
        f"{r('accuracy - majority')} AS vs_baseline FROM (SELECT {key}{tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn, "
        f"{accuracy} AS accuracy, {share(tp, f'{tp} + {fp}')} AS prec, {share(tp, f'{tp} + {fn}')} AS recall, "
        f"{share(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, {majority} AS majority FROM {source} {group}) m "
        f"JOIN ({auc}) u ON {f'm.{by} = u.{by}' if by else 'true'}"
    )


@query("direction_metrics__i11_i12", _direction_sql("fx_direction"))
def _(spark, folder):
    return ops.direction_metrics(fx.directions(spark, folder))


@query("direction_metrics_by_group__i11_i12", _direction_sql("fx_direction", "grp", 0.7))
def _(spark, folder):
    return ops.direction_metrics(fx.directions(spark, folder), ["grp"], 0.7)


fx.CTES["fx_scored"] = (
    "SELECT split, CASE WHEN y > 0 THEN 1 ELSE 0 END AS y, 1 / (1 + exp(-last_return)) AS p FROM fx_windows WHERE split IS NOT NULL"
)
_AUC = (
    "SELECT split, (sum(CASE WHEN y = 1 THEN mid END) - sum(y) * (sum(y) + 1) / 2.0e0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)) * 100 "
    "AS auc FROM (SELECT *, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0e0 AS mid "
    "FROM fx_scored) GROUP BY 1"
)


@query("roc_area_of_windows__i11", f"SELECT split, {r('auc')} AS auc FROM ({_AUC})")
def _(spark, folder):
    rows = fq.split_windows(spark, folder).select(
        "split", (F.col("y") > 0).cast("int").alias("y"), (1 / (1 + F.exp(-F.col("last_return")))).alias("p")
    )
    return ops.roc_auc(rows, ["split"])


@query("classes_at_threshold__i26", "SELECT grp, CAST(p >= 0.3e0 AS BIGINT) AS pred_class, count(*) AS n FROM fx_direction GROUP BY 1, 2")
def _(spark, folder):
    out = ops.classify(fx.directions(spark, folder), 0.3)
    return out.groupBy("grp", "pred_class").agg(F.count("*").alias("n"))


fx.CTES["fx_pscaled"] = (
    "SELECT ticker, date, split, y_scaled AS y, p_scaled * 0.5e0 AS pred, coalesce(y_scaled * y_scale + y_mean, y_scaled) AS y_raw, "
    "coalesce(p_scaled * 0.5e0 * y_scale + y_mean, p_scaled * 0.5e0) AS pred_raw FROM fx_yscaled"
)


def scaled_predictions(spark, folder):
    sets = fq.split_windows(spark, folder)
    scalers = fq.target_scalers(sets)
    base = ops.persistence(win.scale_targets(sets, scalers), "return", scalers)
    out = base.select("ticker", "date", "split", F.col("y_scaled").alias("y"), (F.col("pred") * 0.5).alias("pred"))
    return out, scalers


@query("unscaled_metrics__i13_g12", "SELECT ticker, count(*) AS n, " + measures_sql("pred_raw", "y_raw") + " FROM fx_pscaled GROUP BY 1")
def _(spark, folder):
    rows, scalers = scaled_predictions(spark, folder)
    return ops.unscaled_metrics(rows, scalers, ["ticker"])


@query("both_scales__i14", "SELECT split, count(*) AS n, "
       f"{r('avg((pred - y) * (pred - y))')} AS mse_scaled, {r('avg(abs(pred - y))')} AS mae_scaled, "
       f"{r('sqrt(avg((pred - y) * (pred - y)))')} AS rmse_scaled, " + measures_sql("pred_raw", "y_raw") + " FROM fx_pscaled GROUP BY 1")
def _(spark, folder):
    rows, scalers = scaled_predictions(spark, folder)
    return ops.both_scales(rows, scalers, ["split"])


_HUBER = "CASE WHEN abs(pred - y) <= 1 THEN 0.5e0 * (pred - y) * (pred - y) ELSE abs(pred - y) - 0.5e0 END"


@query("losses__i25", f"SELECT split, count(*) AS n, {r('avg((pred - y) * (pred - y))')} AS mse_loss, "
       f"{r('avg(abs(pred - y))')} AS mae_loss, {r(f'avg({_HUBER})')} AS huber_loss FROM fx_pred GROUP BY 1")
def _(spark, folder):
    return ops.losses(samples(spark, folder), ["split"])


# ---- runs ---------------------------------------------------------------------------------

fx.CTES["fx_analysis"] = (
    "SELECT ticker, count(*) AS n, " + measures_sql() + ", " + measures_sql("base_pred", short=True, prefix="base_")
    + " FROM fx_pred GROUP BY 1"
)


@query("ticker_analysis__i15", "SELECT * FROM fx_analysis")
def _(spark, folder):
    return studies.ticker_analysis(samples(spark, folder))


@query("ticker_series__i15", f"SELECT {s('date')} AS date, {r('y')} AS y, {r('pred')} AS pred, {r('base_pred')} AS base_pred "
       "FROM fx_pred WHERE ticker = 'S000000003'")
def _(spark, folder):
    return studies.ticker_series(samples(spark, folder), "S000000003")


_RAW = {
    "mse": "avg(({p} - y) * ({p} - y))", "mae": "avg(abs({p} - y))", "rmse": "sqrt(avg(({p} - y) * ({p} - y)))",
    "dir_acc": "avg(CAST(sign({p}) = sign(y) AS DOUBLE))",
}
_TABLE = " UNION ALL ".join(
    f"SELECT ticker, '{m}' AS metric, {r(e.format(p='pred'))} AS model, {r(e.format(p='base_pred'))} AS baseline, "
    + r(f"({e.format(p='pred')} - {e.format(p='base_pred')}) * 100" if m == "dir_acc"
        else f"(1 - {e.format(p='pred')} / {e.format(p='base_pred')}) * 100")
    + " AS improvement FROM fx_pred GROUP BY 1"
    for m, e in _RAW.items()
)


@query("comparison_table__i16", _TABLE)
def _(spark, folder):
    return studies.comparison_table(studies.ticker_analysis(samples(spark, folder)), ["ticker"])


fx.CTES["fx_run_metrics"] = (
    "SELECT run_id, count(*) AS n, " + measures_sql() + " FROM fx_runs GROUP BY 1 UNION ALL "
    "SELECT 'persistence' AS run_id, count(*) AS n, " + measures_sql("base_pred") + " FROM fx_pred"
)


def run_metrics(spark, folder):
    rows = samples(spark, folder)
    return studies.all_runs(run_predictions(rows), rows)


@query("all_runs__i19_k3", "SELECT * FROM fx_run_metrics")
def _(spark, folder):
    return run_metrics(spark, folder)


@query("run_summary__i17_i27", "SELECT m.*, hidden_size, num_layers FROM fx_run_metrics m LEFT JOIN "
       f"{_values(RUNS)} t(run_id, hidden_size, num_layers, shrink, shift) ON m.run_id = t.run_id")
def _(spark, folder):
    return studies.run_summary(run_metrics(spark, folder), configs(spark).drop("shrink", "shift"))


@query("best_run__i18_i27", "SELECT * FROM fx_run_metrics WHERE run_id <> 'persistence' ORDER BY mse, run_id LIMIT 1")
def _(spark, folder):
    return studies.best_run(run_metrics(spark, folder))


_METRICS = ["n", "mse", "mae", "rmse", "dir_acc", "r2", "sharpe_pred", "sharpe_true"]


@query("metric_records_sink__a23", " UNION ALL ".join(
    f"SELECT run_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM fx_run_metrics" for m in _METRICS))
def _(spark, folder):
    path = shared_dir(spark, "run-metrics")
    writers.write_run_metrics(studies.metric_records(run_metrics(spark, folder), ["run_id"]), path)
    return writers.read_run_metrics(spark, path)


@query("report_sink__a17", "SELECT * FROM fx_run_metrics WHERE run_id = 'run_0'")
def _(spark, folder):
    path = shared_dir(spark, "report")
    metrics = run_metrics(spark, folder).filter("run_id = 'run_0'").withColumn("history", F.array(F.lit(1), F.lit(2)))
    writers.write_report(metrics, f"{path}/json", f"{path}/csv", studies.flat_metrics(metrics))
    schema = "run_id string, n bigint, " + ", ".join(f"{m} double" for m in _METRICS[1:])
    return spark.read.schema(schema).option("header", True).csv(f"{path}/csv")


# ---- studies ----------------------------------------------------------------------------------

fx.CTES["fx_ablation"] = (
    "SELECT feature_set, " + price_measures_sql("(x_last * pw + s_last * sw)") + " FROM fx_horizon CROSS JOIN "
    f"{_values(SETS)} t(feature_set, sw, pw) WHERE split = 'test' GROUP BY 1"
)


fx.CTES["fx_ablation_raw"] = fx.CTES["fx_ablation"].replace(
    price_measures_sql("(x_last * pw + s_last * sw)"), price_measures_sql("(x_last * pw + s_last * sw)", rounded=False)
)


def ablation(spark, folder):
    last = F.element_at("x", -1)
    rows = fq.price_windows(spark, folder).filter("split = 'test'")
    rows = rows.withColumn("c", _each(SETS, ["feature_set", "sw", "pw"]))
    pred = F.element_at(last, 1) * F.col("c.pw") + F.element_at(last, 3) * F.col("c.sw")
    rows = rows.withColumns({"pred": pred, "feature_set": F.col("c.feature_set")})
    return ops.price_metrics(rows, ["feature_set"])


@query("ablation_summary__i20", "SELECT feature_set, mape, mape_vs_naive, direction_accuracy, "
       "CAST(mape = min(mape) OVER () AS BIGINT) AS is_best FROM fx_ablation")
def _(spark, folder):
    return studies.ablation_summary(ablation(spark, folder))


HORIZONS = (1, 3, 5, 10)
for _h in (3, 10):
    fx.CTES[f"fx_horizon{_h}"] = fq.horizon_sql(_h)


@query("horizon_summary__i21", " UNION ALL ".join(
    f"SELECT {h} AS horizon, mape, naive_mape, mape_vs_naive, direction_accuracy FROM (SELECT "
    f"{price_measures_sql(_PRICE_PRED)} FROM fx_horizon{'' if h == 1 else h} WHERE split = 'test')" for h in HORIZONS))
def _(spark, folder):
    rows = win.many_horizons(fq.split_rows(spark, folder).filter("split = 'test'"), fq.LONG, HORIZONS)
    last = F.element_at(F.element_at("x", -1), 1)
    return studies.horizon_summary(ops.price_metrics(rows.withColumn("pred", last * 0.9 + 0.01), ["horizon"]))


fx.CTES["fx_dir_groups"] = (
    "SELECT grp, avg(CAST((p >= 0.5e0) = (y = 1) AS DOUBLE)) * 100 - greatest(avg(CAST(y = 1 AS DOUBLE)), "
    "avg(CAST(y = 0 AS DOUBLE))) * 100 AS vs_baseline FROM fx_direction GROUP BY 1"
)


@query("suite_findings__i22",
       f"SELECT {r('gain')} AS sentiment_gain, best AS best_feature_set, {r('vs')} AS best_vs_baseline, "
       "CAST(vs > 2 AS BIGINT) AS direction_beats_baseline, CAST(gain > 0.1 AS BIGINT) AS sentiment_helps FROM (SELECT "
       "max(mape) FILTER (feature_set = 'price_only') - max(mape) FILTER (feature_set = 'price_volume_sentiment') AS gain, "
       "arg_min(feature_set, mape) AS best, (SELECT max(vs_baseline) FROM fx_dir_groups) AS vs FROM fx_ablation_raw)")
def _(spark, folder):
    direction = ops.direction_metrics(fx.directions(spark, folder), ["grp"])
    return studies.suite_findings(ablation(spark, folder), direction)


fx.CTES["fx_price_total"] = f"SELECT {price_measures_sql(_PRICE_PRED)} FROM fx_horizon WHERE split = 'test'"


def price_total(spark, folder):
    return ops.price_metrics(price_predictions(spark, folder).filter("split = 'test'"))


@query("price_baseline_comparison__i23", "SELECT 'model' AS model, mape, r2 FROM fx_price_total UNION ALL "
       "SELECT 'naive', naive_mape, 0 FROM fx_price_total")
def _(spark, folder):
    return studies.baseline_comparison(price_total(spark, folder))


@query("direction_baseline_comparison__i23",
       "SELECT 'model' AS model, accuracy, vs_baseline FROM (" + _direction_sql("fx_direction") + ") UNION ALL "
       "SELECT 'majority', baseline_accuracy, 0 FROM (" + _direction_sql("fx_direction") + ")")
def _(spark, folder):
    return studies.baseline_comparison(ops.direction_metrics(fx.directions(spark, folder)), "direction")


@query("rating_bands__i24", "SELECT feature_set, CASE WHEN r2 > 0.95 THEN 'excellent' WHEN r2 > 0.8 THEN 'good' "
       "WHEN r2 > 0.5 THEN 'ok' ELSE 'poor' END AS fit_rating, CASE WHEN direction_accuracy > 60 THEN 'good' "
       "WHEN direction_accuracy > 55 THEN 'ok' ELSE 'poor' END AS direction_rating, CASE WHEN mape_vs_naive < -2 THEN "
       "'significant improvement' WHEN mape_vs_naive < 0 THEN 'improvement' ELSE 'no improvement' END AS naive_rating FROM fx_ablation")
def _(spark, folder):
    out = studies.rating_bands(ablation(spark, folder))
    return out.select("feature_set", "fit_rating", "direction_rating", "naive_rating")
