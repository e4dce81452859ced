"""Baselines and quality measures of predictions. Every measure is one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickertide.operators.series import null_safe_join, running_total
from tickertide.operators.windows import denormalise, unscale

# Fixed value: share of right directions expected from guessing.
RANDOM_DIRECTION = 0.5
HUBER_DELTA = 1.0


# ---- baselines -------------------------------------------------------------------

def persistence(windows: DataFrame, target_kind: str = "return", scalers: DataFrame | None = None) -> DataFrame:
    """Add ``pred``: the last return or the last close, scaled like the target when asked."""
    if target_kind not in ("return", "close"):
        raise ValueError("target_kind must be 'return' or 'close'")
    last = "last_return" if target_kind == "return" else "last_close"
    out = windows.withColumn("pred", F.col(last))
    if scalers is None:
        return out
    scaled = F.coalesce((F.col("pred") - F.col("y_mean")) / F.col("y_scale"), F.col("pred"))
    return out.join(scalers, "ticker", "left").withColumn("pred", scaled).drop("y_mean", "y_scale")


def persistence_from_cells(windows: DataFrame, columns: Sequence[str], cell: str = "return") -> DataFrame:
    """The same from the last step of the window; the first feature if the name is absent."""
    at = list(columns).index(cell) if cell in columns else 0
    return windows.withColumn("pred", F.element_at(F.element_at("x", -1), at + 1))


def _step_price(position: int) -> Column:
    return F.element_at(F.element_at("x", position), 1)


def last_move(windows: DataFrame) -> Column:
    """Relative price of the last step; windows that have it as a column need not be stacked for it."""
    return F.col("last_move") if "last_move" in windows.columns else _step_price(-1)


def naive_price(windows: DataFrame) -> DataFrame:
    """Last price in the window. Relative windows leave out their last step, so it is the one before."""
    return windows.withColumn("pred_price", denormalise(last_move(windows), F.col("y_base")))


def moving_average_price(windows: DataFrame, steps: int = 5) -> DataFrame:
    first = F.greatest(F.size("x") - (steps - 1), F.lit(1))
    recent = F.transform(F.slice("x", first, F.lit(steps)), lambda s: F.element_at(s, 1))
    mean = F.aggregate(recent, F.lit(0.0), lambda a, v: a + v) / F.size(recent)
    return windows.withColumn("pred_price", denormalise(mean, F.col("y_base")))


def momentum_price(windows: DataFrame) -> DataFrame:
    """Last price plus the mean daily change over the last five steps."""
    trend = (_step_price(-1) - _step_price(-5)) / 4
    return windows.withColumn("pred_price", denormalise(_step_price(-1) + trend, F.col("y_base")))


def direction_baselines(windows: DataFrame) -> DataFrame:
    """Accuracy of always naming the larger class, and of guessing."""
    share = lambda v: F.avg((F.col("y") == v).cast("double"))
    return windows.agg(
        F.greatest(share(1), share(0)).alias("majority"), F.lit(RANDOM_DIRECTION).alias("random")
    )


# ---- regression --------------------------------------------------------------------

def _mean_over_spread(value: Column) -> Column:
    spread = F.stddev_pop(value)
    return F.coalesce(F.avg(value) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))


def regression_columns(pred: str, true: str, short: bool = False) -> list[Column]:
    p, t = F.col(pred), F.col(true)
    e = p - t
    hit = (F.signum(p) == F.signum(t)).cast("double")
    out = [
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(hit).alias("dir_acc"),
    ]
    if short:
        return out
    spread = F.var_pop(t) * F.count(t)
    r2 = F.coalesce(1 - F.sum(e * e) / F.nullif(spread, F.lit(0.0)), F.lit(0.0))
    return out + [
        F.when(F.count(t) > 1, r2).alias("r2"),
        _mean_over_spread(p).alias("sharpe_pred"),
        _mean_over_spread(t).alias("sharpe_true"),
    ]


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), pred: str = "pred", true: str = "y", short: bool = False
) -> DataFrame:
    """Error, direction, fit and mean-to-spread measures, per group."""
    count = F.count("*").alias("n")
    return df.groupBy(*by).agg(count, *regression_columns(pred, true, short))


def losses(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", true: str = "y") -> DataFrame:
    """Mean squared, absolute and Huber loss over samples."""
    e = F.abs(F.col(pred) - F.col(true))
    huber = F.when(e <= HUBER_DELTA, 0.5 * e * e).otherwise(HUBER_DELTA * (e - 0.5 * HUBER_DELTA))
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(e * e).alias("mse_loss"),
        F.avg(e).alias("mae_loss"),
        F.avg(huber).alias("huber_loss"),
    )


def unscaled_metrics(df: DataFrame, scalers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Regression measures after undoing the target scaling of each ticker."""
    return regression_metrics(unscale(df, scalers, ["pred", "y"]), by)


def both_scales(df: DataFrame, scalers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Measures on scaled values (``*_scaled``) and on unscaled ones, side by side."""
    marked = df.withColumns({"_p": F.col("pred"), "_t": F.col("y")})
    back = unscale(marked, scalers, ["_p", "_t"])
    scaled = [
        F.avg((F.col("pred") - F.col("y")) ** 2).alias("mse_scaled"),
        F.avg(F.abs(F.col("pred") - F.col("y"))).alias("mae_scaled"),
        F.sqrt(F.avg((F.col("pred") - F.col("y")) ** 2)).alias("rmse_scaled"),
    ]
    return back.groupBy(*by).agg(F.count("*").alias("n"), *scaled, *regression_columns("_p", "_t"))


# ---- prices ---------------------------------------------------------------------------

def with_price_direction(df: DataFrame) -> DataFrame:
    """Up or not, predicted and true, against the last price of the window (relative values)."""
    last = last_move(df)
    return df.withColumns(
        {"pred_up": (F.col("pred") > last).cast("int"), "true_up": (F.col("y") > last).cast("int")}
    )


def price_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Price errors after de-normalising, against the naive price, and direction accuracy in %."""
    base = F.col("y_base")
    priced = with_price_direction(df).withColumns(
        {
            "_true": denormalise(F.col("y"), base),
            "_pred": denormalise(F.col("pred"), base),
            "_naive": denormalise(last_move(df), base),
        }
    )
    t, p, naive = F.col("_true"), F.col("_pred"), F.col("_naive")
    pct = lambda v: F.avg(F.abs((t - v) / F.nullif(t, F.lit(0.0)))) * 100
    spread = F.nullif(F.var_pop(t) * F.count(t), F.lit(0.0))
    hit = (F.col("pred_up") == F.col("true_up")).cast("double")
    return priced.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(F.avg((t - p) ** 2)).alias("rmse"),
        F.coalesce(1 - F.sum((t - p) ** 2) / spread, F.lit(0.0)).alias("r2"),
        pct(p).alias("mape"),
        pct(naive).alias("naive_mape"),
        (pct(p) - pct(naive)).alias("mape_vs_naive"),
        (F.avg(hit) * 100).alias("direction_accuracy"),
    )


# ---- direction ---------------------------------------------------------------------------

def classify(df: DataFrame, threshold: float = 0.5, proba: str = "p") -> DataFrame:
    return df.withColumn("pred_class", (F.col(proba) >= threshold).cast("int"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), y: str = "y", proba: str = "p") -> DataFrame:
    """Area under the ROC curve in percent, ties at half; 50 where one class is missing.

    Equal scores are merged first. The count of lower-scored negatives is a running total over
    ever finer ranges between the smallest and the largest score, so no task ranks all predictions.
    Rows without a label or a score are left out, as in all measures of direction.
    """
    by = list(by)
    df = df.filter(F.col(y).isNotNull() & F.col(proba).isNotNull())
    positive = F.sum(F.when(F.col(y) == 1, 1).otherwise(0))
    scores = df.groupBy(*by, proba).agg(
        positive.alias("_pos"), (F.count("*") - positive).alias("_neg")
    )
    low, high = (scores.agg(f(proba).cast("double")).scalar() for f in (F.min, F.max))
    share = F.coalesce((F.col(proba) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    ranges = [F.floor(share * 2.0**bits) for bits in (10, 20, 30)]
    ranked = running_total(scores, proba, ranges, F.col("_neg"), by, "_below")
    wins = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    area = F.coalesce(wins / F.nullif(pairs, F.lit(0.0)), F.lit(0.5)) * 100
    return ranked.groupBy(*by).agg(area.alias("auc"))


def confusion_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Confusion counts and the measures built on them in percent; 0 where undefined."""
    hit = lambda y, c: F.count_if((F.col("y") == y) & (F.col("pred_class") == c))
    counts = classify(df, threshold).groupBy(*by).agg(
        hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)) * 100
    accuracy = share(tp + tn, tp + fp + fn + tn)
    return counts.withColumns(
        {
            "accuracy": accuracy,
            "precision": share(tp, tp + fp),
            "recall": share(tp, tp + fn),
            "f1": share(2 * tp, 2 * tp + fp + fn),
            "vs_random": accuracy - 50.0,
        }
    )


def direction_metrics(df: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Confusion measures, ROC area, majority accuracy and the gain over it.

    Rows without a label or a score are left out (``count_unscored`` tells how many).
    """
    by = list(by)
    df = df.filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    share = lambda v: F.avg((F.col("y") == v).cast("double"))
    majority = df.groupBy(*by).agg((F.greatest(share(1), share(0)) * 100).alias("baseline_accuracy"))
    parts = [confusion_metrics(df, by, threshold), roc_auc(df, by), majority]
    if by:
        out = null_safe_join(null_safe_join(parts[0], parts[1], by), parts[2], by)
    else:
        one = lambda d, c: d.select(c).scalar().alias(c)
        out = parts[0].select("*", one(parts[1], "auc"), one(parts[2], "baseline_accuracy"))
    return out.withColumn("vs_baseline", F.col("accuracy") - F.col("baseline_accuracy"))


def count_unscored(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows without a label or a score, which the measures of direction leave out."""
    missing = F.col("y").isNull() | F.col("p").isNull()
    return df.groupBy(*by).agg(F.count_if(missing).alias("n_unscored"))
