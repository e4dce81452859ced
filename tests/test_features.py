"""Features, cumulative sentiment and windows against pandas and numpy on awkward frames."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickertide.operators import features as feats
from tickertide.operators import sentiment as senti
from tickertide.operators import window_store as ws
from tickertide.operators import windows as win
from tickertide.sources import writers


def frames(seed=0):
    rng = np.random.default_rng(seed)
    bars, news = [], []
    for ticker, n in (("LONG", 90), ("FLAT", 40), ("ONE", 1), ("TWO", 2), ("low", 30)):
        days = pd.bdate_range("2019-11-04", periods=n)
        close = np.full(n, 50.0) if ticker == "FLAT" else 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        bars.append(
            pd.DataFrame(
                {
                    "ticker": ticker, "date": days.date, "open": close * 0.99, "high": close * 1.02, "low": close * 0.97,
                    "close": close, "adj_close": close, "volume": rng.integers(1, 1000, n) * (1 + 9 * (rng.random(n) > 0.9)).astype(int),
                }
            )
        )
        if ticker != "TWO":
            pick = rng.random(n) > 0.6
            news.append(
                pd.DataFrame(
                    {"ticker": ticker, "date": days.date[pick], "daily_sentiment": rng.uniform(-1, 1, pick.sum()),
                     "n_articles": rng.integers(1, 6, pick.sum())}
                )
            )
    return pd.concat(bars, ignore_index=True), pd.concat(news, ignore_index=True)


@pytest.fixture(scope="module")
def data(spark):
    bars, news = frames()
    schema = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume bigint"
    return (
        bars,
        news,
        spark.createDataFrame(bars, schema),
        spark.createDataFrame(news, "ticker string, date date, daily_sentiment double, n_articles bigint"),
    )


def mean(values):
    return sum(values) / len(values)


def deviation(values):
    """Sample standard deviation; None for fewer than two values."""
    if len(values) < 2:
        return None
    m = mean(values)
    return (sum((x - m) ** 2 for x in values) / (len(values) - 1)) ** 0.5


def features_of_row(rows, i):
    """Features of row i of one ticker, from the rows before it and itself."""
    now, before = rows[i], rows[:i]
    closes = [r["close"] for r in before]
    returns = [None] + [rows[k]["close"] / rows[k - 1]["close"] - 1 for k in range(1, i + 1)]
    out = {"return": returns[i], "log_volume": math.log(1 + now["volume"])}
    out["intraday_range"] = (now["high"] - now["low"]) / now["close"]
    out["volatility_5"] = deviation([x for x in returns[max(0, i - 5) : i] if x is not None]) or 0.0
    for k in (5, 20):
        out[f"ma_{k}"] = mean(closes[-k:]) if before else None
    # Moves of the last 14 earlier rows; the first row of a ticker has no move.
    moves = [rows[k]["close"] - rows[k - 1]["close"] for k in range(max(1, i - 14), i)]
    gain, loss = (mean([max(sign * m, 0) for m in moves]) if moves else 0 for sign in (1, -1))
    out["rsi_14"] = 100 - 100 / (1 + gain / loss) if loss else 50.0
    if before:
        half = 2 * (deviation(closes[-20:]) or 0.0)
        out["bb_upper"], out["bb_lower"] = out["ma_20"] + half, out["ma_20"] - half
    else:
        out["bb_upper"] = out["bb_lower"] = None
    for name, k in (("roc_10", 10), ("momentum_5", 5), ("momentum_10", 10)):
        out[name] = closes[-1] / closes[-1 - k] - 1 if len(closes) > k else 0.0
    usual = mean([r["volume"] for r in before[-20:]]) if before else None
    out["volume_spike"] = 1.0 if usual is not None and now["volume"] > 1.5 * usual else 0.0
    return out


def looped_features(bars, news):
    """Features, filled sentiment and next-day return, row by row from their written definitions."""
    said = {(r.ticker, r.date): (r.daily_sentiment, r.n_articles) for r in news.itertuples()}
    out = []
    for ticker in bars["ticker"].unique():
        rows = sorted(bars[bars.ticker == ticker].to_dict("records"), key=lambda r: r["date"])
        seen = 0.0
        for i, row in enumerate(rows):
            sentiment, n = said.get((ticker, row["date"]), (None, 0))
            seen = seen if sentiment is None else sentiment
            after = rows[i + 1]["close"] / row["close"] - 1 if i + 1 < len(rows) else None
            out.append({**row, **features_of_row(rows, i), "daily_sentiment": seen, "n_articles": n, "target": after})
    return pd.DataFrame(out)


def same(got, want, cols, tol=1e-9):
    got = got.sort_values(["ticker", "date"]).reset_index(drop=True)
    want = want.sort_values(["ticker", "date"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in cols:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        assert np.nanmax(np.abs(a - b), initial=0) < tol, c


@pytest.mark.parametrize("size", [25, 4096])
def test_price_features_match_loops(data, size):
    bars, news, sbars, snews = data
    got = feats.feature_table(sbars, snews, rows_per_block=size).toPandas()
    same(got, looped_features(bars, news), feats.FEATURES)


def test_flat_prices_give_neutral_rsi(data):
    _, _, sbars, snews = data
    got = feats.feature_table(sbars, snews).filter("ticker = 'FLAT'").select("rsi_14").distinct().collect()
    assert [r.rsi_14 for r in got] == [50.0]


def test_unknown_options_are_refused(data):
    _, _, sbars, snews = data
    with pytest.raises(ValueError):
        feats.positioned_bars(sbars, snews, fill="mean")
    with pytest.raises(ValueError):
        feats.feature_table(sbars, snews, target_kind="volume")
    with pytest.raises(ValueError):
        win.sliding_windows(sbars, snews, 0)
    with pytest.raises(ValueError):
        win.feature_set("everything")
    with pytest.raises(ValueError):
        win.resolve_columns(sbars.drop("close"), ["close"])


def cumulative_of_row(rows, i, spans):
    """Running sentiment features of row i of one ticker; frames count rows and end at row i."""
    s, n = [r["daily_sentiment"] for r in rows[: i + 1]], [float(r["n_articles"]) for r in rows[: i + 1]]
    out = {**rows[i], "sentiment_strength": abs(s[i]) * math.log(1 + n[i])}
    for k in spans:
        near = s[-k:]
        out[f"sentiment_cum_{k}d"], out[f"sentiment_ma_{k}d"] = sum(near), mean(near)
        out[f"sentiment_vol_{k}d"] = deviation(near) or 0.0
        out[f"news_intensity_{k}d"] = sum(n[-k:])
        top = bottom = 0.0
        for x in s:  # each step takes every earlier weight down by the same share
            top, bottom = top * (1 - 2 / (k + 1)) + x, bottom * (1 - 2 / (k + 1)) + 1
        out[f"sentiment_ewm_{k}d"] = top / bottom
    week = [sum(s[max(0, k - 4) : k + 1]) for k in range(max(0, i - 2), i + 1)]
    steps = [b - a for a, b in zip(week, week[1:])]
    out["sentiment_momentum"] = steps[-1] if steps else 0.0
    out["sentiment_acceleration"] = steps[-1] - steps[-2] if len(steps) > 1 else 0.0
    out["sentiment_surprise"] = s[i] - mean(s[-20:])
    away = (n[i] - mean(n[-20:])) / (deviation(n[-20:]) or 1.0)
    out["news_spike"] = min(3.0, max(-3.0, away))
    out["has_news"], out["strong_sentiment"] = int(n[i] > 0), int(abs(s[i]) > 0.3)
    return out


@pytest.mark.parametrize("size", [50, 4096])
def test_cumulative_features_match_loops(spark, size):
    rng = np.random.default_rng(5)
    parts = []
    for ticker, n in (("MANY", 900), ("ONE", 1), ("FEW", 7)):
        days = pd.date_range("2001-01-01", periods=n).date
        parts.append(pd.DataFrame({"ticker": ticker, "date": days, "daily_sentiment": rng.uniform(-1, 1, n), "n_articles": rng.integers(1, 9, n)}))
    daily = pd.concat(parts, ignore_index=True)
    sdf = spark.createDataFrame(daily, "ticker string, date date, daily_sentiment double, n_articles bigint")
    got = senti.cumulative_features(sdf, rows_per_block=size).toPandas()
    want = []
    for ticker in daily["ticker"].unique():
        rows = daily[daily.ticker == ticker].to_dict("records")
        want += [cumulative_of_row(rows, i, senti.SPANS) for i in range(len(rows))]
    want = pd.DataFrame(want)
    same(got, want, [c for c in want.columns if c not in ("ticker", "date")])


@pytest.mark.parametrize("size", [50, 4096])
def test_exponential_means_lose_no_weight(spark, size):
    """Values 1e20 apart, and spans far longer than a block: every earlier row counts."""
    rng = np.random.default_rng(9)
    spans = (2, 3, 20, 400, 100_000)
    days = pd.date_range("2001-01-01", periods=6000).date
    values = np.where(rng.random(6000) < 0.002, 1e20, 1.0) * rng.uniform(-1, 1, 6000)
    values[3000:] = rng.uniform(-1, 1, 3000) * 1e-20
    rows = pd.DataFrame({"ticker": "LONG", "date": days, "daily_sentiment": values, "n_articles": 1})
    lost = rows.head(40).assign(ticker=None)
    sdf = spark.createDataFrame(pd.concat([rows, lost]), "ticker string, date date, daily_sentiment double, n_articles bigint")
    got = senti.cumulative_features(sdf, spans, rows_per_block=size).orderBy("date").toPandas()
    long = got[got.ticker == "LONG"].reset_index(drop=True)
    assert len(long) == 6000 and len(got) == 6040
    for k in spans:
        top = bottom = 0.0
        want = []
        for x in values:
            top, bottom = top * (1 - 2 / (k + 1)) + x, bottom * (1 - 2 / (k + 1)) + 1
            want.append(top / bottom)
        fading = np.zeros(6000)  # errors fade like the values they come from
        for i, x in enumerate(np.abs(values)):
            fading[i] = (fading[i - 1] if i else 0.0) * (1 - 2 / (k + 1)) + x
        away = np.abs(long[f"sentiment_ewm_{k}d"] - np.array(want))
        assert (away <= 1e-10 * fading).all(), k


def test_doubling_reaches_every_earlier_stretch(spark):
    """A single value, then zeros: what is left of it after many stretches is its exact weight."""
    days = pd.date_range("2001-01-01", periods=3000).date
    rows = pd.DataFrame({"ticker": "A", "date": days, "daily_sentiment": [1e200] + [0.0] * 2999, "n_articles": 1})
    sdf = spark.createDataFrame(rows, "ticker string, date date, daily_sentiment double, n_articles bigint")
    got = senti.cumulative_features(sdf, (5,), rows_per_block=300).orderBy("date").toPandas()["sentiment_ewm_5d"]
    top, bottom = 1e200, 1.0
    for i in range(2500):  # by then the weight alone is far below the smallest double
        assert np.isclose(got[i], top / bottom, rtol=1e-9, atol=0)
        top, bottom = top * (2 / 3), bottom * (2 / 3) + 1


def test_spans_may_leave_out_five_and_twenty(spark, data):
    _, _, _, snews = data
    got = senti.cumulative_features(snews, spans=[4])
    assert {"sentiment_momentum", "sentiment_surprise", "sentiment_cum_4d"} <= set(got.columns)
    assert "sentiment_cum_5d" not in got.columns


def numpy_windows(table, length):
    out = {}
    for ticker, g in table.groupby("ticker", sort=False):
        g = g[g["target"].notna()].reset_index(drop=True)
        x = g[feats.FEATURES].to_numpy(float)
        for end in range(length - 1, len(g)):
            w = x[end - length + 1 : end + 1]
            if not np.isnan(w).any():
                out[(ticker, g.loc[end, "date"])] = (w, g.loc[end, "target"])
    return out


@pytest.mark.parametrize("size", [30, 4096])
def test_sliding_windows_match_numpy(data, size):
    bars, news, sbars, snews = data
    want = numpy_windows(looped_features(bars, news), 6)
    rows = win.sliding_windows(sbars, snews, 6, rows_per_block=size).collect()
    assert {(r.ticker, r.date) for r in rows} == set(want)
    for r in rows:
        x, y = want[(r.ticker, r.date)]
        assert np.allclose(np.array(r.x), x, atol=1e-9) and abs(r.y - y) < 1e-12


def test_split_scale_and_undo(data):
    _, _, sbars, snews = data
    windows = win.sliding_windows(sbars, snews, 4)
    sets = win.calendar_split(windows, (2019, 2019), (2020, 2020), val_months=1).cache()
    months = {(r.date.year, r.date.month): r.split for r in sets.select("date", "split").collect()}
    assert set(months.values()) == {"train", "val", "test"}
    assert months[(2019, 12)] == "val" and months[(2019, 11)] == "train" and months[(2020, 1)] == "test"
    ys = win.fit_target_scalers(sets)
    back = win.unscale(win.scale_targets(sets, ys).withColumn("y2", F.col("y_scaled")), ys, ["y2"])
    assert back.filter(F.abs(F.col("y2") - F.col("y")) > 1e-12).count() == 0
    with pytest.raises(ValueError):
        win.calendar_split(windows, (2019, 2019), (2020, 2020), val_months=0)


@pytest.mark.parametrize("size", [28, 60, 4096])
def test_stored_blocks_give_the_same_windows(data, size):
    bars, news, sbars, snews = data
    lost = sbars.filter("ticker = 'TWO'").withColumn("ticker", F.lit(None).cast("string"))
    sbars = sbars.unionByName(lost)
    store = ws.window_blocks(sbars, snews, 6, rows_per_block=size).cache()
    columns = ["ticker", "date", "x", "y", "last_return", "last_close"]
    want = win.sliding_windows(sbars, snews, 6).select(columns)
    got = ws.cut_windows(store).select(columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    dates = ws.window_dates(store)
    assert dates.exceptAll(want.select("ticker", "date")).count() == 0 and dates.count() == want.count()
    # Each bar stands in the store once, but for those lent to the next block.
    bars_held = store.agg(F.sum(F.size("steps"))).first()[0]
    assert bars_held <= sbars.count() + 5 * store.count()


@pytest.mark.parametrize("size", [28, 60, 4096])
def test_scalers_of_weighted_bars_equal_those_of_all_cells(data, size):
    _, _, sbars, snews = data
    names = [*feats.FEATURES, "flat"]
    flat = snews.withColumn("flat", F.lit(3.5))
    store = ws.window_blocks(sbars.withColumn("flat", F.lit(3.5)), flat, 4, names, rows_per_block=size).cache()
    years = ((2019, 2019), (2020, 2020))
    sets = win.calendar_split(ws.cut_windows(store), *years, val_months=1, dates=ws.window_dates(store)).cache()
    plain = win.calendar_split(win.sliding_windows(sbars, snews, 4), *years, val_months=1)
    both = ["ticker", "date", "split"]
    assert sets.select(both).exceptAll(plain.select(both)).count() == 0 and sets.count() == plain.count()
    train = sets.filter("split = 'train'").collect()
    scalers = ws.fit_scalers(store, *ws.train_range(store, years[0], 1)).cache()
    assert {r.ticker for r in scalers.collect()} == {t.ticker for t in train}

    def check(row, cells):
        sd = cells.std(axis=0)
        assert np.allclose(row.mean, cells.mean(axis=0))
        assert np.allclose(row.scale, np.where(sd < 1e-12, 1, sd), rtol=1e-9) and row.scale[-1] == 1.0

    for row in scalers.collect():
        check(row, np.concatenate([np.array(t.x) for t in train if t.ticker == row.ticker]))
    (whole,) = ws.fit_scalers(store, *ws.train_range(store, years[0], 1), per_ticker=False).collect()
    check(whole, np.concatenate([np.array(t.x) for t in train]))
    assert whole.ticker is None

    some = scalers.filter("ticker <> 'low'")
    scaled = {(r.ticker, r.date): r for r in ws.cut_windows(ws.scale_blocks(store, some), ["has_scaler"]).collect()}
    of = {r.ticker: r for r in some.collect()}
    assert len(scaled) == ws.window_dates(store).count()
    for t in train:
        r = scaled[t.ticker, t.date]
        assert r.has_scaler == (t.ticker != "low")
        if t.ticker == "low":
            assert r.x is None
        else:
            assert np.allclose(r.x, (np.array(t.x) - of[t.ticker].mean) / of[t.ticker].scale)
    none = ws.fit_scalers(store, *ws.train_range(store, (1901, 1902), 1))
    assert none.count() == 0
    assert ws.scale_blocks(store, none).filter("has_scaler").count() == 0


def numpy_relative(g, length, horizon):
    c = g[["close", "volume", "daily_sentiment", "n_articles"]].to_numpy(float)
    rows = []
    for k in range(len(c) - length - horizon + 1):
        w = c[k : k + length].copy()
        target = c[k + length - 1 + horizon, 0]
        base, last = w[0, 0], w[-1, 0]
        for j in (0, 1):
            first = w[0, j] if abs(w[0, j]) >= 1e-8 else 1e-8
            w[:, j] = w[:, j] / first - 1
        w[:, 3] /= 10
        rows.append((w[:-1], target / base - 1, base, last))
    return rows


@pytest.mark.parametrize("size", [15, 4096])
def test_relative_windows_match_numpy(spark, data, size):
    bars, news, sbars, snews = data
    zero = sbars.withColumn("volume", F.when(F.dayofmonth("date") == 5, 0).otherwise(F.col("volume")))
    base = feats.positioned_bars(zero, snews, fill="zero")
    rows = win.positional_split(base)
    got = win.horizon_windows(rows, 5, 2, rows_per_block=size).filter("ticker = 'LONG'").collect()
    table = base.filter("ticker = 'LONG'").orderBy("date").toPandas()
    n = len(table)
    cuts = {"train": (0, int(0.70 * n)), "val": (int(0.70 * n), int(0.85 * n)), "test": (int(0.85 * n), n)}
    for split, (lo, hi) in cuts.items():
        want = numpy_relative(table.iloc[lo:hi].reset_index(drop=True), 5, 2)
        have = sorted((r for r in got if r.split == split), key=lambda r: r.split_pos)
        assert len(have) == len(want)
        for r, (x, y, y_base, last) in zip(have, want):
            assert np.allclose(np.array(r.x), x) and np.isclose(r.y, y)
            assert np.isclose(r.y_base, y_base) and np.isclose(r.last_price, last)


def test_many_horizons_equal_single_ones(data):
    _, _, sbars, snews = data
    rows = win.positional_split(feats.positioned_bars(sbars, snews, fill="zero"))
    many = win.many_horizons(rows, 5, (1, 3))
    for h in (1, 3):
        one = win.horizon_windows(rows, 5, h).select("ticker", "split", "split_pos", "y")
        assert one.exceptAll(many.filter(F.col("horizon") == h).select(one.columns)).count() == 0
        assert one.count() == many.filter(F.col("horizon") == h).count()


def test_a_span_of_one_is_the_value_itself(data):
    _, _, _, snews = data
    got = senti.cumulative_features(snews, spans=[1, 3])
    assert got.filter("abs(sentiment_ewm_1d - daily_sentiment) > 1e-12").count() == 0
    assert "sentiment_ewm_3d" in got.columns


def test_scale_does_not_depend_on_the_number_of_rows(spark):
    """A deviation of 0.005 around 1e6 stays what it is, over 1e4 and over 1e8 rows."""
    for n in (10**4, 10**8):
        values = spark.range(n).select((F.lit(1e6) + F.when(F.col("id") % 2 == 0, 0.005).otherwise(-0.005)).alias("v"))
        assert np.isclose(values.agg(win._scale(F.col("v"))).first()[0], 0.005, rtol=1e-3)
    assert spark.range(9).select(F.lit(7.5).alias("v")).agg(win._scale(F.col("v"))).first()[0] == 1.0


def test_bars_without_a_ticker_are_kept(data):
    _, _, sbars, snews = data
    lost = sbars.filter("ticker = 'TWO'").withColumn("ticker", F.lit(None).cast("string"))
    got = feats.feature_table(sbars.unionByName(lost), snews)
    assert got.filter("ticker IS NULL").count() == feats.feature_table(sbars, snews).filter("ticker = 'TWO'").count()


def test_one_file_per_ticker_unless_it_is_large(spark, tmp_path):
    days = pd.date_range("2000-01-01", periods=900).date
    rows = [(t, d, float(k), k + 1) for t, n in (("BIG", 900), ("SMALL", 400), (None, 3)) for k, d in enumerate(days[:n])]
    combined = spark.createDataFrame(rows, "ticker string, date date, close double, pos int").repartition(4)
    path = str(tmp_path / "combined")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would share a task
    try:
        writers.write_by_ticker(combined, path, rows_per_file=400)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "combined").glob("ticker=*")}
    assert files["ticker=SMALL"] == files["ticker=__HIVE_DEFAULT_PARTITION__"] == 1 and 1 < files["ticker=BIG"] <= 3
    back = spark.read.parquet(path).select("ticker", "date", "close").collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr(r[:3]) for r in rows)


def test_positions_of_combined_bars(spark, data):
    _, _, sbars, snews = data
    table = senti.cumulative_features(snews)
    plain = senti.combine_with_bars(sbars, table)
    assert "pos" not in plain.columns
    got = senti.combine_with_bars(sbars, table, positions=True).toPandas()
    assert len(got) == plain.count()
    for _, g in got.sort_values("date").groupby("ticker"):
        assert list(g["pos"]) == list(range(1, len(g) + 1))


def test_each_window_expression_is_computed_once(spark):
    """A window expression named twice is computed twice; features name columns."""
    bars = spark.createDataFrame([], "ticker string, date date, open double, high double, low double, close double, volume bigint")
    sentiment = spark.createDataFrame([], "ticker string, date date, daily_sentiment double, n_articles bigint")
    plan = feats.feature_table(bars, sentiment)._jdf.queryExecution().analyzed().toString()
    times = lambda made: len(re.findall(made + r"\(close#", plan))
    assert [times(made) for made in ("stddev_samp", "avg", "lag")] == [1, 2, 3]


def test_indexed_windows_join_blocks_without_a_shuffle(spark, folder):
    from tickertide.plans import feature_queries as fq, fit_queries as fits

    got = fits.indexed_windows(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan.split("Subquery")[0] and "BroadcastHashJoin" in plan
    key = ["ticker", "date", "split", "ticker_idx"]
    want = win.ticker_index(fq.split_cells(fq.blocks(spark, folder)))
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
