"""Reports over many runs: comparisons, best runs, studies by feature set and horizon."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickertide.operators.metrics import regression_metrics

ERRORS = ("mse", "mae", "rmse")
BASELINE_RUN = "persistence"


def ticker_analysis(predictions: DataFrame) -> DataFrame:
    """Model and persistence measures of every ticker at once, with sample counts."""
    model = regression_metrics(predictions, ["ticker"])
    base = regression_metrics(predictions, ["ticker"], pred="base_pred", short=True).drop("n")
    renamed = base.withColumnsRenamed({c: f"base_{c}" for c in (*ERRORS, "dir_acc")})
    return model.join(renamed, "ticker")


def ticker_series(predictions: DataFrame, ticker: str) -> DataFrame:
    """Dated true, predicted and baseline values of one ticker."""
    return predictions.filter(F.col("ticker") == ticker).select("date", "y", "pred", "base_pred")


def comparison_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per measure: model, baseline and improvement.

    Errors improve by (1 - model/baseline) percent, null if the baseline is not positive;
    direction accuracy by the difference in points.
    """
    items = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(m).alias("model"),
            F.col(f"base_{m}").alias("baseline"),
            F.when(F.col(f"base_{m}") > 0, (1 - F.col(m) / F.nullif(F.col(f"base_{m}"), F.lit(0.0))) * 100).alias("improvement"),
        )
        for m in ERRORS
    ]
    items.append(
        F.struct(
            F.lit("dir_acc").alias("metric"),
            F.col("dir_acc").alias("model"),
            F.col("base_dir_acc").alias("baseline"),
            ((F.col("dir_acc") - F.col("base_dir_acc")) * 100).alias("improvement"),
        )
    )
    return df.select(*keys, F.explode(F.array(*items)).alias("r")).select(*keys, "r.*")


def all_runs(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Measures of every run plus those of persistence on the samples, in one table."""
    runs = regression_metrics(predictions, ["run_id"])
    base = regression_metrics(samples, pred="base_pred").withColumn("run_id", F.lit(BASELINE_RUN))
    return runs.unionByName(base)


def run_summary(metrics: DataFrame, configs: DataFrame) -> DataFrame:
    """Measures with the configuration of their run; a run without one keeps nulls."""
    return metrics.join(configs, "run_id", "left")


def best_run(metrics: DataFrame) -> DataFrame:
    """The run with the smallest squared error; the baseline only when it is alone."""
    is_base = F.when(F.col("run_id") == BASELINE_RUN, 1).otherwise(0)
    return metrics.orderBy(is_base, F.col("mse").asc_nulls_last(), "run_id").limit(1)


def metric_records(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Measures as plain (keys, metric, value) rows for storage."""
    names = [c for c in metrics.columns if c not in keys]
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names]
    return metrics.select(*keys, F.explode(F.array(*pairs)).alias("r")).select(*keys, "r.*")


def flat_metrics(metrics: DataFrame) -> DataFrame:
    """Only the scalar columns, as a one-row report needs them."""
    from pyspark.sql import types as T

    nested = (T.ArrayType, T.MapType, T.StructType)
    return metrics.select([f.name for f in metrics.schema.fields if not isinstance(f.dataType, nested)])


def ablation_summary(metrics: DataFrame, task: str = "price") -> DataFrame:
    """The headline measures per feature set, best one marked."""
    return _with_best(metrics, "feature_set", task)


def _with_best(metrics: DataFrame, key: str, task: str) -> DataFrame:
    # Arg-max over a handful of rows: one per feature set.
    if task == "direction":
        best = metrics.agg(F.max_by(key, "accuracy")).scalar()
        cols = ["accuracy", "auc", "vs_baseline"]
    else:
        best = metrics.agg(F.min_by(key, "mape")).scalar()
        cols = ["mape", "mape_vs_naive", "direction_accuracy"]
    return metrics.select(key, *cols, (F.col(key) == best).cast("int").alias("is_best"))


def horizon_summary(metrics: DataFrame, task: str = "price") -> DataFrame:
    cols = (
        ["accuracy", "vs_baseline"]
        if task == "direction"
        else ["mape", "naive_mape", "mape_vs_naive", "direction_accuracy"]
    )
    return metrics.select("horizon", *cols)


def suite_findings(ablation: DataFrame, direction: DataFrame) -> DataFrame:
    """Does direction beat its baseline by over 2 points; does sentiment lower the error by over 0.1."""
    gain = ablation.agg(
        (
            F.max(F.when(F.col("feature_set") == "price_only", F.col("mape")))
            - F.max(F.when(F.col("feature_set") == "price_volume_sentiment", F.col("mape")))
        ).alias("sentiment_gain"),
        F.min_by("feature_set", "mape").alias("best_feature_set"),
    )
    best = direction.agg(F.max("vs_baseline")).scalar()
    return gain.withColumn("best_vs_baseline", best).withColumns(
        {
            "direction_beats_baseline": (F.col("best_vs_baseline") > 2).cast("int"),
            "sentiment_helps": (F.col("sentiment_gain") > 0.1).cast("int"),
        }
    )


def baseline_comparison(metrics: DataFrame, task: str = "price") -> DataFrame:
    """Two rows: the model and its baseline (naive price or majority class)."""
    if task == "direction":
        model = metrics.select(F.lit("model").alias("model"), "accuracy", "vs_baseline")
        base = metrics.select(
            F.lit("majority").alias("model"),
            F.col("baseline_accuracy").alias("accuracy"),
            F.lit(0.0).alias("vs_baseline"),
        )
    else:
        model = metrics.select(F.lit("model").alias("model"), "mape", "r2")
        base = metrics.select(
            F.lit("naive").alias("model"), F.col("naive_mape").alias("mape"), F.lit(0.0).alias("r2")
        )
    return model.unionByName(base)


def _band(value: Column, bands: Sequence[tuple[float, str]], last: str) -> Column:
    expr = F
    for bound, name in bands:
        expr = expr.when(value > bound, name)
    return expr.otherwise(last)


def rating_bands(metrics: DataFrame) -> DataFrame:
    """Verbal ratings of fit, direction accuracy and the gain over the naive price."""
    fit = _band(F.col("r2"), [(0.95, "excellent"), (0.80, "good"), (0.50, "ok")], "poor")
    direction = _band(F.col("direction_accuracy"), [(60, "good"), (55, "ok")], "poor")
    versus = (
        F.when(F.col("mape_vs_naive") < -2, "significant improvement")
        .when(F.col("mape_vs_naive") < 0, "improvement")
        .otherwise("no improvement")
    )
    return metrics.withColumns({"fit_rating": fit, "direction_rating": direction, "naive_rating": versus})
