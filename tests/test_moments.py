"""Linear models from cross products against numpy and the iterative solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickertide.operators import features as feats
from tickertide.operators import fit, moments, studies
from tickertide.operators import windows as win
from test_features import data  # noqa: F401  (fixture)


def table(spark, rows):
    return spark.createDataFrame(rows, "ticker string, split string, z array<double>, y double").repartition(3)


def drawn(seed=1, n=400, p=3, shift=0.0):
    draw = np.random.default_rng(seed)
    z = draw.normal(size=(n, p)) * [1, 5, 0.1][:p] + shift
    ticker = [f"T{k}" for k in draw.integers(0, 9, n)]
    level = {f"T{k}": 3.0 * k for k in range(9)}
    y = z @ [2.0, -0.5, 7.0][:p] + [level[t] for t in ticker] + draw.normal(size=n) * 0.3
    split = ["train" if draw.random() < 0.7 else "val" for _ in range(n)]
    return [(t, s, [float(v) for v in row], float(value)) for t, s, row, value in zip(ticker, split, z, y)]


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_cross_products_merge_over_tasks(spark, shift):
    rows = drawn(shift=shift)
    odd = [("T1", "train", None, 1.0), ("T1", "train", [1.0, None, 2.0], 1.0), ("T1", "val", [float("nan"), 0.0, 0.0], 1.0), (None, None, [0.0] * 3, 5.0)]
    got = moments.collected(moments.cross_products(table(spark, rows + odd), ["split", "ticker"], "z"), ["split", "ticker"])
    for key, m in got.items():
        z = np.array([r[2] for r in rows + odd[3:] if (r[1], r[0]) == key])
        assert m.n == len(z) and np.allclose(m.mean, z.mean(axis=0))
        assert np.allclose(m.cross, (z - z.mean(axis=0)).T @ (z - z.mean(axis=0)), rtol=1e-5, atol=1e-4 if shift else 1e-9)
    assert len(got) == len({(r[1], r[0]) for r in rows}) + 1
    assert moments.collected(moments.cross_products(table(spark, []), ["split"], "z"), ["split"]) == {}


@pytest.mark.parametrize("l2", [0.0, 0.1, 3.0])
def test_ridge_equals_the_solver_of_the_library(spark, l2):
    rows = table(spark, drawn(2)).withColumn("x", F.array("z"))
    model = fit.fit_regressor(fit.with_vectors(rows, 3, "last"), l2=l2)
    products = moments.cross_products(rows.filter("split = 'train'").withColumn("v", F.concat("z", F.array("y"))), [], "v")
    intercept, slopes = moments.ridge(moments.collected(products, [])[()], l2)
    assert np.allclose(slopes, model.coefficients.toArray(), rtol=1e-6) and np.isclose(intercept, model.intercept, rtol=1e-6)


def test_fits_that_have_no_solution():
    flat = moments.Moments(10, np.ones(3), np.array([[1.0, 0.0, 2.0], [0.0, 0.0, 0.0], [2.0, 0.0, 5.0]]))
    assert np.allclose(moments.ridge(flat)[1], [2.0, 0.0])
    twice = moments.Moments(10, np.zeros(3), np.array([[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 3.0]]))
    for m, l2 in ((twice, 0.0), (moments.Moments(1, np.zeros(2), np.eye(2)), 0.0), (twice, -1.0)):
        with pytest.raises(ValueError):
            moments.ridge(m, l2)
    assert np.isfinite(moments.ridge(twice, 0.1)[1]).all()


def plain_measures(y, pred):
    return [len(y), ((pred - y) ** 2).mean(), 1 - ((pred - y) ** 2).sum() / ((y - y.mean()) ** 2).sum(), pred.mean() / pred.std(), y.mean() / y.std()]


def test_sweep_equals_single_fits_and_keeps_failures(spark, data):  # noqa: F811
    _, _, sbars, snews = data
    rows = win.positional_split(feats.positioned_bars(sbars, snews, fill="zero"))
    grid = {"seq_len": [3, 6, 7000], "feature_set": ["price_only", "all_features", "none"], "pool": ["last", "flat", "odd"], "l2": [0.0, 0.2]}
    got = moments.linear_sweep(win.length_windows(rows, [3, 6, 7000]), grid, win.ALL_COLUMNS)
    runs = {(r.seq_len, r.feature_set, r.pool, r.l2): r for r in got.collect()}
    assert len(runs) == 54 and {r.status for r in runs.values()} == {"done", "failed"}
    for (n, name, pool, l2), r in runs.items():
        failed = n == 7000 or name == "none" or pool == "odd"
        assert (r.status == "failed") == failed and (r.error is not None) == failed and (r.mse is None) == failed
    for n, name, pool, l2 in ((3, "price_only", "last", 0.0), (6, "all_features", "flat", 0.2), (6, "all_features", "last", 0.0)):
        windows = win.horizon_windows(rows, n)
        chosen = [win.ALL_COLUMNS.index(c) for c in win.feature_set(name)]
        picked = windows.withColumn("x", F.transform("x", lambda s: F.array(*[F.element_at(s, k + 1) for k in chosen])))
        vectors = fit.with_vectors(picked, len(chosen), pool)
        out = fit.predict(fit.fit_regressor(vectors, l2=l2), vectors, ["val"]).select("y", "pred").toPandas()
        r = runs[n, name, pool, l2]
        want = plain_measures(out["y"].to_numpy(), out["pred"].to_numpy())
        assert np.allclose([r.n, r.mse, r.r2, r.sharpe_pred, r.sharpe_true], want, rtol=1e-4)
    best = studies.best_run(got).first()
    assert best.status == "done" and best.mse == min(r.mse for r in runs.values() if r.mse is not None)


def test_lengths_cut_at_once_equal_single_ones(data):  # noqa: F811
    _, _, sbars, snews = data
    gaps = feats.positioned_bars(sbars, snews, fill="zero").withColumn("close", F.when(F.col("pos") != 9, F.col("close")))
    rows = win.positional_split(gaps)
    many = win.length_windows(rows, (3, 5), 2, rows_per_block=30)
    for n in (3, 5):
        one = win.horizon_windows(rows, n, 2).select("ticker", "split", "split_pos", "x", "y", "target_price")
        part = many.filter(F.col("seq_len") == n).select(one.columns)
        assert one.count() == part.count() > 0 and one.exceptAll(part).count() == 0
    with pytest.raises(ValueError):
        win.length_windows(rows, (1, 5))


def test_ticker_effects_equal_one_hot_fit(spark):
    rows = drawn(4) + [("NEW", "val", [0.1, 0.2, 0.3], 1.0), (None, "train", [0.1, 0.5, 0.3], 40.0), (None, "train", [0.2, 0.5, 0.3], 41.0), (None, "val", [0.0, 0.0, 0.0], 40.0)]
    data_ = table(spark, rows)
    slopes, effects = moments.fit_ticker_effects(data_, F.col("z"))
    train = [r for r in rows if r[1] == "train"]
    names = sorted({str(r[0]) for r in train})
    x = np.array([r[2] + [float(str(r[0]) == t) for t in names] for r in train])
    want = np.linalg.lstsq(x, np.array([r[3] for r in train]), rcond=None)[0]
    assert np.allclose(slopes, want[:3], rtol=1e-6)
    got = {str(r.ticker): r.effect for r in effects.collect()}
    assert np.allclose([got[t] for t in names], want[3:], rtol=1e-6)
    pred = {(str(r.ticker), tuple(r.z)): r.pred for r in moments.predict_with_effects(data_, F.col("z"), slopes, effects).collect()}
    usual = np.mean([got[str(r[0])] for r in train])
    val = [r for r in rows if r[1] == "val"]
    assert len(pred) == len(val)
    for t, _, z, _ in val:
        assert np.isclose(pred[str(t), tuple(z)], np.dot(slopes, z) + got.get(str(t), usual))
    with pytest.raises(ValueError):
        moments.fit_ticker_effects(data_.filter("split = 'val'"), F.col("z"))


def test_effects_of_many_tickers_stay_a_table(spark):
    rows = spark.range(40_000).select(
        F.concat(F.lit("T"), F.expr("id div 2")).alias("ticker"), F.lit("train").alias("split"),
        F.array(F.sin("id"), F.cos("id") + F.col("id") % 2).alias("z"), F.col("id").alias("k"),
    ).withColumn("y", F.expr("z[0] * 3 - z[1] + (k div 2) % 7"))
    slopes, effects = moments.fit_ticker_effects(rows, F.col("z"))
    assert np.allclose(slopes, [3, -1])
    assert effects.count() == 20_000
    assert effects.filter(F.abs(F.col("effect") - F.substring("ticker", 2, 9).cast("int") % 7) > 1e-6).count() == 0


def test_levels_of_few_features_take_one_pass(spark, monkeypatch):
    """Sums per ticker are stored, so the levels do not read the windows again; a join of the means gives the same."""
    data_ = table(spark, drawn(4) + [(None, "train", [0.1, 0.5, 0.3], 40.0), (None, "train", [0.2, 0.5, 0.3], 41.0), ("ONE", "train", [0.2, 0.1, 0.3], 7.0)])
    slopes, effects = moments.fit_ticker_effects(data_, F.col("z"), 0.1)
    files = effects.inputFiles()
    assert files and all("ticker-moments" in f for f in files)
    monkeypatch.setattr(moments, "FEW_COMPONENTS", 0)
    others, levels = moments.fit_ticker_effects(data_, F.col("z"), 0.1)
    assert np.allclose(slopes, others, rtol=1e-9)
    key = lambda r: str(r.ticker)
    for a, b in zip(sorted(effects.collect(), key=key), sorted(levels.collect(), key=key), strict=True):
        assert (a.ticker, a.n) == (b.ticker, b.n) and np.isclose(a.effect, b.effect, rtol=1e-9)


def test_vectors_of_unequal_length_are_an_error(spark):
    data_ = table(spark, drawn(4) + [("T1", "train", [0.1, 0.2, 0.3, 0.4], 1.0)])
    with pytest.raises(Exception):  # noqa: B017
        moments.fit_ticker_effects(data_, F.col("z"))[1].collect()
