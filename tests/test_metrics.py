import numpy as np
import pandas as pd
import pytest

from tickertide.operators import metrics as ops
from tickertide.operators import studies


def table(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({"g": rng.integers(0, 3, n), "y": rng.normal(0, 1, n), "pred": rng.normal(0, 1, n)})
    df.loc[:5, ["y", "pred"]] = 0.0
    return df, spark.createDataFrame(df)


def test_regression_metrics(spark):
    pdf, df = table(spark)
    for row in ops.regression_metrics(df, ["g"]).collect():
        p, t = (pdf[pdf.g == row.g][c].to_numpy() for c in ("pred", "y"))
        assert np.isclose(row.mse, ((p - t) ** 2).mean()) and np.isclose(row.mae, np.abs(p - t).mean())
        assert np.isclose(row.rmse, np.sqrt(row.mse)) and np.isclose(row.dir_acc, (np.sign(p) == np.sign(t)).mean())
        assert np.isclose(row.r2, 1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        assert np.isclose(row.sharpe_pred, p.mean() / p.std()) and np.isclose(row.sharpe_true, t.mean() / t.std())


def test_degenerate_groups(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("same", 1.0, 3.0), ("same", 2.0, 3.0)], "g string, pred double, y double")
    got = {r.g: r for r in ops.regression_metrics(df, ["g"]).collect()}
    assert got["one"].r2 is None and got["one"].sharpe_pred == 0.0
    assert got["same"].r2 == 0.0 and got["same"].sharpe_true == 0.0


def pairwise_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    if not len(pos) or not len(neg):
        return 50.0
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return 100 * wins / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [2, 12])
def test_auc_equals_pairs(spark, digits):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 400), "y": rng.integers(0, 2, 400), "p": rng.random(400).round(digits)})
    pdf.loc[pdf.g == 3, "y"] = 1
    pdf.loc[pdf.g == 2, "p"] = 0.5 + pdf.loc[pdf.g == 2, "p"] * 1e-12  # all in one range
    df = spark.createDataFrame(pdf)
    for row in ops.direction_metrics(df, ["g"]).collect():
        part = pdf[pdf.g == row.g]
        y, p = part.y.to_numpy(), part.p.to_numpy()
        c = (p >= 0.5).astype(int)
        assert np.isclose(row.auc, pairwise_auc(y, p))
        assert np.isclose(row.accuracy, 100 * (y == c).mean())
        tp, fp, fn = ((y == 1) & (c == 1)).sum(), ((y == 0) & (c == 1)).sum(), ((y == 1) & (c == 0)).sum()
        assert (row.tp, row.fp, row.fn) == (tp, fp, fn)
        assert np.isclose(row.f1, 100 * 2 * tp / max(2 * tp + fp + fn, 1))
    whole = ops.direction_metrics(df).first()
    assert np.isclose(whole.auc, pairwise_auc(pdf.y.to_numpy(), pdf.p.to_numpy()))


def test_no_positive_prediction_gives_zero(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.2)], "y int, p double")
    row = ops.direction_metrics(df).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_price_baselines(spark):
    x = [[0.1 * k, 1.0] for k in range(7)]
    df = spark.createDataFrame([(x, 100.0), (x[:3], 10.0)], "x array<array<double>>, y_base double")
    naive = [r.pred_price for r in ops.naive_price(df).collect()]
    mean = [r.pred_price for r in ops.moving_average_price(df).collect()]
    assert np.allclose(naive, [160, 12]) and np.allclose(mean, [140, 11])
    momentum = ops.momentum_price(df.limit(1)).first().pred_price
    assert np.isclose(momentum, (0.6 + (0.6 - 0.2) / 4 + 1) * 100)


def test_comparison_without_positive_baseline(spark):
    row = [(1.0, 0.5, 1.0, 0.6, 0.0, 1.0, 2.0, 0.5)]
    cols = "mse double, mae double, rmse double, dir_acc double, base_mse double, base_mae double, base_rmse double, base_dir_acc double"
    got = {r.metric: r.improvement for r in studies.comparison_table(spark.createDataFrame(row, cols)).collect()}
    assert got["mse"] is None and np.isclose(got["mae"], 50) and np.isclose(got["dir_acc"], 10)


def test_best_run_prefers_models(spark):
    rows = [("persistence", 0.1), ("a", 0.3), ("b", 0.2)]
    df = spark.createDataFrame(rows, "run_id string, mse double")
    assert studies.best_run(df).first().run_id == "b"
    assert studies.best_run(df.filter("run_id = 'persistence'")).first().run_id == "persistence"


def test_sweep_survives_a_failing_configuration(spark):
    from tickertide.operators import fit

    def build(config):
        if config["l2"] == 2:
            raise ValueError("no")
        return spark.createDataFrame([(1.0, float(config["l2"]))], "y double, pred double")

    runs, records = fit.sweep(build, {"l2": [1, 2, 3]})
    assert [r["status"] for r in records] == ["done", "failed", "done"]
    assert {r.run_id for r in runs.collect()} == {"run_000", "run_002"}


def test_pooling(spark):
    from tickertide.operators import fit

    df = spark.createDataFrame([([[1.0, 5.0], [3.0, 2.0]],)], "x array<array<double>>")
    want = {"flat": [1, 5, 3, 2], "last": [3, 2], "mean": [2, 3.5], "max": [3, 5]}
    for how, values in want.items():
        assert df.select(fit.pooled("x", 2, how).alias("v")).first().v == values
    with pytest.raises(ValueError):
        fit.pooled("x", 2, "median")


def test_missing_scores_labels_and_groups(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("a", 1, None), ("a", None, 0.5), (None, 1, 7.0), (None, 0, -3.0), (None, 0, 7.0)]
    df = spark.createDataFrame(rows, "g string, y int, p double")
    got = {r.g: r for r in ops.direction_metrics(df, ["g"]).collect()}
    assert set(got) == {"a", None}
    assert got["a"].auc == 100.0 and got["a"].tp + got["a"].tn == 2
    assert got[None].auc == 75.0
    assert {r.g: r.n_unscored for r in ops.count_unscored(df, ["g"]).collect()} == {"a": 2, None: 0}
