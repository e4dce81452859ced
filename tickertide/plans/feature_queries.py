"""Queries over features: price indicators, cumulative sentiment, windows, splits, scaling."""

from pyspark.sql import functions as F

from tickertide.operators import features as feats
from tickertide.operators import sentiment as senti
from tickertide.operators import window_store as ws
from tickertide.operators import windows as win
from tickertide.operators.series import with_positions
from tickertide.plans import fixtures as fx
from tickertide.plans.registry import i, query, r, s
from tickertide.session import shared_dir
from tickertide.sources import writers

SEQ = 8  # window length of the calendar split
LONG = 20  # window length of the positional split
TRAIN, TEST = (1995, 1999), (2000, 2001)
N = len(feats.FEATURES)

_W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"


def _past(k: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def _last(k: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


fx.CTES["fx_joined"] = (
    "SELECT b.*, t.daily_sentiment AS raw_sentiment, t.n_articles AS raw_articles FROM fx_sbars b "
    "LEFT JOIN fx_ssent t ON b.ticker = t.ticker AND b.date = t.date"
)
fx.CTES["fx_steps"] = (
    'SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY ticker) AS n_rows, '
    'close / lag(close) OVER w - 1 AS "return", close - lag(close) OVER w AS step, '
    "lead(close) OVER w AS next_close FROM fx_joined " + _W
)
_GAIN, _LOSS = "greatest(step, 0)", "greatest(-step, 0)"
_BAND = f"2 * coalesce(stddev_samp(close) {_past(20)}, 0)"
fx.CTES["fx_feat"] = (
    "SELECT ticker, date, rn, n_rows, close, volume, next_close, \"return\", ln(1.0e0 + volume) AS log_volume, "
    "CASE WHEN close > 0 THEN (high - low) / close ELSE 0.0e0 END AS intraday_range, "
    f"coalesce(stddev_samp(\"return\") {_past(5)}, 0) AS volatility_5, avg(close) {_past(5)} AS ma_5, "
    f"avg(close) {_past(20)} AS ma_20, "
    f"coalesce(100 - 100 / (1 + avg(gain) {_past(14)} / nullif(avg(loss) {_past(14)}, 0)), 50) AS rsi_14, "
    f"avg(close) {_past(20)} + {_BAND} AS bb_upper, avg(close) {_past(20)} - {_BAND} AS bb_lower, "
    "coalesce(lag(close, 1) OVER w / lag(close, 11) OVER w - 1, 0) AS roc_10, "
    "coalesce(lag(close, 1) OVER w / lag(close, 6) OVER w - 1, 0) AS momentum_5, "
    "coalesce(lag(close, 1) OVER w / lag(close, 11) OVER w - 1, 0) AS momentum_10, "
    f"coalesce(CAST(volume > 1.5e0 * avg(volume) {_past(20)} AS DOUBLE), 0) AS volume_spike, "
    "coalesce(last_value(raw_sentiment IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND CURRENT ROW), 0) AS daily_sentiment, coalesce(raw_sentiment, 0) AS zero_sentiment, "
    "coalesce(raw_articles, 0) AS n_articles FROM (SELECT *, CASE WHEN step IS NOT NULL THEN "
    f"{_GAIN} END AS gain, CASE WHEN step IS NOT NULL THEN {_LOSS} END AS loss FROM fx_steps) " + _W
)
_QUOTED = {c: f'"{c}"' if c == "return" else c for c in feats.FEATURES}


def _features_sql(names) -> str:
    return ", ".join(f"{r(_QUOTED[c])} AS {_QUOTED[c]}" if c != "n_articles" else f"{i(c)} AS {c}" for c in names)


def inputs(spark, folder):
    return fx.supplier_bars(spark, folder), fx.supplier_sentiment(spark, folder)


@query("daily_sentiment_scan__a10", f"SELECT ticker, {s('date')} AS date, {r('daily_sentiment')} AS daily_sentiment, "
       "n_articles FROM fx_ssent")
def _(spark, folder):
    from tickertide.sources import readers

    path = shared_dir(spark, "daily-sentiment")
    stored = fx.supplier_sentiment(spark, folder).toDF("Ticker", "Date", "Daily_Sentiment", "n_articles")
    stored.withColumn("Date", F.col("Date").cast("timestamp_ntz")).write.parquet(path)
    return readers.daily_sentiment(spark.read.parquet(path))


@query("price_sentiment_join__c1", f"SELECT ticker, {s('date')} AS date, {r('close', 8)} AS close, "
       f"{r('raw_sentiment', 8)} AS daily_sentiment, raw_articles AS n_articles FROM fx_joined", digits=8)
def _(spark, folder):
    out = feats.join_sentiment(*inputs(spark, folder))
    return out.select("ticker", "date", "close", "daily_sentiment", "n_articles")


@query("price_features__e1_e16", f"SELECT ticker, {s('date')} AS date, {_features_sql(feats.FEATURES)} FROM fx_feat")
def _(spark, folder):
    return feats.feature_table(*inputs(spark, folder)).select("ticker", "date", *feats.FEATURES)


@query("region_features__e1_e12", f"SELECT ticker, {s('date')} AS date, {_features_sql(feats.FEATURES[:13])} FROM "
       f"({fx.CTES['fx_feat'].replace('fx_steps', '(' + fx.CTES['fx_steps'].replace('fx_joined', '(SELECT *, 0 AS raw_sentiment, 0 AS raw_articles FROM fx_bars)') + ')')})")
def _(spark, folder):
    table = feats.feature_table(fx.bars(spark, folder), fx.daily_sentiment(spark, folder))
    return table.select("ticker", "date", *feats.FEATURES[:13])


@query("zero_filled_sentiment__e13_e14", f"SELECT ticker, {s('date')} AS date, {r('zero_sentiment')} AS daily_sentiment, "
       f"{i('n_articles')} AS n_articles FROM fx_feat")
def _(spark, folder):
    out = feats.positioned_bars(*inputs(spark, folder), fill="zero")
    return out.select("ticker", "date", "daily_sentiment", "n_articles")


@query("return_target__e15", f"SELECT ticker, {s('date')} AS date, {r('next_close / close - 1')} AS target FROM fx_feat "
       "WHERE next_close IS NOT NULL")
def _(spark, folder):
    return feats.feature_table(*inputs(spark, folder), target_kind="return").select("ticker", "date", "target")


@query("close_target__e15", f"SELECT ticker, {s('date')} AS date, {r('next_close', 8)} AS target FROM fx_feat "
       "WHERE next_close IS NOT NULL", digits=8)
def _(spark, folder):
    return feats.feature_table(*inputs(spark, folder), target_kind="close").select("ticker", "date", "target")


# ---- cumulative sentiment ----------------------------------------------------------

def _cumulative_sql(source: str) -> str:
    cols = ["ticker", "date", "daily_sentiment", "n_articles",
            "abs(daily_sentiment) * ln(1.0e0 + n_articles) AS sentiment_strength"]
    for k in senti.SPANS:
        q = 1.0 - 2.0 / (k + 1)
        cols += [
            f"sum(daily_sentiment) {_last(k)} AS sentiment_cum_{k}d",
            f"avg(daily_sentiment) {_last(k)} AS sentiment_ma_{k}d",
            f"list_sum(list_transform(list(daily_sentiment) OVER (PARTITION BY ticker ORDER BY date), "
            f"lambda x, j: x * pow({q!r}, rn - j))) * (1 - {q!r}) / (1 - pow({q!r}, rn)) AS sentiment_ewm_{k}d",
            f"sum(n_articles) {_last(k)} AS news_intensity_{k}d",
            f"coalesce(stddev_samp(daily_sentiment) {_last(k)}, 0) AS sentiment_vol_{k}d",
        ]
    cols += [
        "coalesce(mom, 0) AS sentiment_momentum",
        "coalesce(mom - lag(mom) OVER w, 0) AS sentiment_acceleration",
        f"daily_sentiment - avg(daily_sentiment) {_last(20)} AS sentiment_surprise",
        f"greatest(-3, least(3, (n_articles - avg(n_articles) {_last(20)}) / "
        f"coalesce(nullif(stddev_samp(n_articles) {_last(20)}, 0), 1))) AS news_spike",
        "CAST(n_articles > 0 AS BIGINT) AS has_news",
        "CAST(abs(daily_sentiment) > 0.3e0 AS BIGINT) AS strong_sentiment",
    ]
    inner = (
        f"SELECT *, row_number() OVER w AS rn, s5 - lag(s5) OVER w AS mom FROM "
        f"(SELECT *, sum(daily_sentiment) {_last(5)} AS s5 FROM {source}) {_W}"
    )
    return f"SELECT {', '.join(cols)} FROM ({inner}) {_W}"


fx.CTES["fx_cumulative"] = _cumulative_sql("fx_ssent")
_DOUBLES = [
    "daily_sentiment", "sentiment_strength", "sentiment_momentum", "sentiment_acceleration", "sentiment_surprise",
    "news_spike",
] + [f"sentiment_{p}_{k}d" for p in ("cum", "ma", "ewm", "vol") for k in senti.SPANS]
_WHOLE = ["n_articles", "has_news", "strong_sentiment"] + [f"news_intensity_{k}d" for k in senti.SPANS]


def _cumulative_columns(prefix: str = "") -> str:
    return ", ".join([f"{r(prefix + c)} AS {c}" for c in _DOUBLES] + [f"{i(prefix + c)} AS {c}" for c in _WHOLE])


@query("cumulative_sentiment__f1_f12", f"SELECT ticker, {s('date')} AS date, {_cumulative_columns()} FROM fx_cumulative")
def _(spark, folder):
    return senti.cumulative_features(fx.supplier_sentiment(spark, folder))


@query("default_article_counts__f1", f"SELECT ticker, {s('date')} AS date, CAST(daily_sentiment <> 0 AS BIGINT) AS n_articles "
       "FROM fx_ssent")
def _(spark, folder):
    daily = fx.supplier_sentiment(spark, folder).drop("n_articles")
    return senti.with_article_counts(daily).select("ticker", "date", "n_articles")


_CARRIED = [c for c in _DOUBLES + _WHOLE if any(p in c for p in senti.CARRIED_PARTS)]
_ZEROED = [c for c in _DOUBLES + _WHOLE if c not in _CARRIED]
fx.CTES["fx_combined"] = (
    "SELECT b.ticker, b.date, b.close, "
    + ", ".join(
        f"coalesce(last_value(c.{c} IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED "
        f"PRECEDING AND CURRENT ROW), 0) AS {c}" for c in _CARRIED
    )
    + ", " + ", ".join(f"coalesce(c.{c}, 0) AS {c}" for c in _ZEROED)
    + " FROM fx_sbars b LEFT JOIN fx_cumulative c ON b.ticker = c.ticker AND b.date = c.date"
)


def combined(spark, folder):
    bars, daily = inputs(spark, folder)
    lower = senti.cumulative_features(daily).withColumn("ticker", F.lower("ticker"))
    return senti.combine_with_bars(bars.select("ticker", "date", "close"), lower, daily)


@query("combined_features__c2_f13", f"SELECT ticker, {s('date')} AS date, {r('close')} AS close, {_cumulative_columns()} "
       "FROM fx_combined")
def _(spark, folder):
    out = combined(spark, folder)
    return out.select("ticker", "date", "close", *_DOUBLES, *_WHOLE)


@query("news_coverage__a12", f"SELECT ticker, count(*) AS n_rows, {r('avg(CAST(n_articles > 0 AS DOUBLE)) * 100')} "
       "AS coverage_pct FROM fx_combined GROUP BY 1")
def _(spark, folder):
    path = shared_dir(spark, "combined")
    bars, daily = inputs(spark, folder)
    writers.write_by_ticker(senti.combine_with_bars(bars, senti.cumulative_features(daily), daily, positions=True), path)
    return senti.news_coverage(spark.read.parquet(path))


# ---- windows -------------------------------------------------------------------------

def checksum(x: str = "x"):
    """Position-weighted sum of all cells of a window: changes when any cell or order changes."""
    row = lambda step: F.aggregate(
        F.transform(step, lambda v, j: v * (j + 1)), F.lit(0.0), lambda a, v: a + v
    )
    weighted = F.transform(F.col(x), lambda step, k: row(step) * (k + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def _row_sum(cells) -> str:
    return " + ".join(f"{j + 1} * ({c})" for j, c in enumerate(cells))


def _weighted_lags(column: str, length: int) -> str:
    return " + ".join(f"{length - k} * lag({column}, {k}) OVER w" for k in range(length))


fx.CTES["fx_windows"] = (
    "SELECT *, CASE WHEN year(date) BETWEEN 2000 AND 2001 THEN 'test' "
    "WHEN year(date) BETWEEN 1995 AND 1999 AND date_trunc('month', date) IN (SELECT m FROM (SELECT DISTINCT "
    "date_trunc('month', date) AS m FROM fx_all_windows WHERE year(date) BETWEEN 1995 AND 1999) ORDER BY m DESC LIMIT 12) "
    "THEN 'val' WHEN year(date) BETWEEN 1995 AND 1999 THEN 'train' END AS split FROM fx_all_windows"
)
fx.CTES["fx_all_windows"] = (
    "SELECT ticker, date, rn, next_close / close - 1 AS y, \"return\" AS last_return, close AS last_close, cs FROM ("
    f"SELECT *, {_weighted_lags('rs', SEQ)} AS cs FROM (SELECT *, {_row_sum(_QUOTED[c] for c in feats.FEATURES)} AS rs "
    f"FROM fx_feat) {_W}) WHERE cs IS NOT NULL AND next_close IS NOT NULL"
)
fx.CTES["fx_cells"] = (
    "SELECT w.ticker, w.date AS end_date, w.split, f.rn - w.rn AS step, f.* EXCLUDE (ticker, date, rn) FROM fx_windows w "
    f"JOIN fx_feat f ON f.ticker = w.ticker AND f.rn BETWEEN w.rn - {SEQ - 1} AND w.rn WHERE w.split IS NOT NULL"
)


def _unit(e: str) -> str:
    return f"CASE WHEN stddev_pop({e}) = 0 THEN 1 ELSE stddev_pop({e}) END"


fx.CTES["fx_scalers"] = (
    "SELECT ticker, " + ", ".join(f"avg({_QUOTED[c]}) AS mean_{c}, {_unit(_QUOTED[c])} AS scale_{c}" for c in feats.FEATURES)
    + " FROM fx_cells WHERE split = 'train' GROUP BY 1"
)
fx.CTES["fx_yscalers"] = (
    f"SELECT ticker, avg(y) AS y_mean, {_unit('y')} AS y_scale FROM fx_windows WHERE split = 'train' "
    "AND ticker NOT LIKE '%9' GROUP BY 1"
)
fx.CTES["fx_yscaled"] = (
    "SELECT w.*, y_mean, y_scale, coalesce((y - y_mean) / y_scale, y) AS y_scaled, "
    "coalesce((last_return - y_mean) / y_scale, last_return) AS p_scaled FROM fx_windows w "
    "LEFT JOIN fx_yscalers USING (ticker) WHERE split IS NOT NULL"
)


def targets(spark, folder):
    """Windows without their cells."""
    return win.sliding_windows(*inputs(spark, folder), seq_len=SEQ).drop("x")


def split_windows(spark, folder):
    """Windows without their cells, stored once: the month of the split and the result read the store."""
    path = shared_dir(spark, "targets")
    return win.calendar_split(writers.load_or_build(spark, path, lambda: targets(spark, folder)), TRAIN, TEST, 12)


def blocks(spark, folder):
    """The store that windows with cells are cut from."""
    path = shared_dir(spark, "window-blocks")
    return writers.load_or_build(spark, path, lambda: ws.window_blocks(*inputs(spark, folder), seq_len=SEQ))


def windows(spark, folder):
    """Windows that are read once: cut from the blocks as they are made, so nothing is stored."""
    return ws.cut_windows(ws.window_blocks(*inputs(spark, folder), seq_len=SEQ))


def split_cells(store, rows=None, carry=()):
    """Windows of the store (or of ``rows``, made from it) and their split, by the dates of the store."""
    cut = ws.cut_windows(store if rows is None else rows, carry)
    return win.calendar_split(cut, TRAIN, TEST, 12, dates=ws.window_dates(store))


def scalers_of(store, per_ticker=True):
    return ws.fit_scalers(store, *ws.train_range(store, TRAIN, 12), per_ticker=per_ticker)


def target_scalers(windows_df):
    """Without the tickers ending in 9, so that some have no scaler."""
    return win.fit_target_scalers(windows_df.filter(~F.col("ticker").endswith("9")))


@query("sliding_windows__g1", f"SELECT w.ticker, {s('w.date')} AS date, {r('cs / 10', 4)} AS cells, {r('a.log_volume', 4)} AS first_volume, "
       f"{r('b.log_volume', 4)} AS last_volume, {r('y', 4)} AS y, {r('last_return', 4)} AS last_return, {r('last_close', 4)} AS last_close, "
       f"{SEQ} AS n_steps FROM fx_all_windows w JOIN fx_feat a ON a.ticker = w.ticker AND a.rn = w.rn - {SEQ - 1} "
       "JOIN fx_feat b ON b.ticker = w.ticker AND b.rn = w.rn", digits=4)
def _(spark, folder):
    volume = feats.FEATURES.index("log_volume") + 1
    cell = lambda step: F.element_at(F.element_at("x", step), volume)
    return windows(spark, folder).select(
        "ticker", "date", (checksum() / 10).alias("cells"), cell(1).alias("first_volume"), cell(-1).alias("last_volume"),
        "y", "last_return", "last_close", F.size("x").alias("n_steps"),
    )


@query("stored_windows__a13", f"SELECT ticker, count(*) AS n, {r('sum(y)', 4)} AS y, {r('avg(cs) / 10', 4)} AS cells FROM fx_all_windows GROUP BY 1", digits=4)
def _(spark, folder):
    path = shared_dir(spark, "window-blocks")
    built = writers.load_or_build(spark, path, lambda: ws.window_blocks(*inputs(spark, folder), seq_len=SEQ))
    again = writers.load_or_build(spark, path, lambda: built.limit(0))
    return ws.cut_windows(again).groupBy("ticker").agg(F.count("*").alias("n"), F.sum("y").alias("y"), (F.avg(checksum()) / 10).alias("cells"))


@query("calendar_split__g8", f"SELECT ticker, {s('date')} AS date, split FROM fx_windows WHERE split IS NOT NULL")
def _(spark, folder):
    dates = targets(spark, folder).select("ticker", "date")
    stored = writers.load_or_build(spark, shared_dir(spark, "dates"), lambda: dates)
    return win.calendar_split(stored, TRAIN, TEST, 12)


@query("split_sizes__d23", "SELECT split, count(*) AS n FROM fx_windows WHERE split IS NOT NULL GROUP BY 1")
def _(spark, folder):
    return win.split_sizes(split_windows(spark, folder))


def _records_sql(source: str, ticker: str) -> str:
    items = ", ".join(
        f"{{'feature': '{c}', 'mean': {r('mean_' + c, 4)}, 'scale': {r('scale_' + c, 4)}}}" for c in feats.FEATURES
    )
    return f"SELECT {ticker} AS ticker, unnest([{items}], recursive := true) FROM {source}"


@query("ticker_scalers__g9_a22", _records_sql("fx_scalers", "ticker"), digits=4)
def _(spark, folder):
    path = shared_dir(spark, "scalers")
    scalers = scalers_of(blocks(spark, folder))
    win.scaler_records(scalers, feats.FEATURES).write.parquet(path)
    return spark.read.parquet(path)


_GLOBAL = fx.CTES["fx_scalers"].replace("SELECT ticker, ", "SELECT ").replace(" GROUP BY 1", "")


@query("global_scaler__g9_a22", _records_sql(f"({_GLOBAL})", "NULL"), digits=4)
def _(spark, folder):
    return win.scaler_records(scalers_of(blocks(spark, folder), per_ticker=False), feats.FEATURES)


def _scaled_sql(source: str, join: str) -> str:
    cells = [f"({_QUOTED[c]} - mean_{c}) / scale_{c}" for c in feats.FEATURES]
    steps = f"SELECT f.ticker, f.date, f.rn, {_row_sum(cells)} AS rs FROM fx_feat f {join}"
    lagged = f"SELECT ticker, rn, {_weighted_lags('rs', SEQ)} AS cs FROM ({steps}) {_W}"
    return (
        f"SELECT w.ticker, {s('w.date')} AS date, w.split, {r('z.cs', 4)} AS cells, CAST(z.cs IS NOT NULL AS BIGINT) "
        f"AS has_scaler FROM {source} w LEFT JOIN ({lagged}) z ON z.ticker = w.ticker AND z.rn = w.rn "
        "WHERE w.split IS NOT NULL"
    )


@query("scaled_windows__g10_c9", _scaled_sql("fx_windows", "JOIN fx_scalers z ON z.ticker = f.ticker AND f.ticker NOT LIKE '%9'"), digits=4)
def _(spark, folder):
    store = blocks(spark, folder)
    scalers = scalers_of(store).filter(~F.col("ticker").endswith("9"))
    scaled = ws.scale_blocks(store, scalers)
    out = split_cells(store, scaled, ["has_scaler"])
    return out.select("ticker", "date", "split", checksum().alias("cells"), "has_scaler")


@query("globally_scaled_windows__g10", _scaled_sql("fx_windows", f"CROSS JOIN ({_GLOBAL})"), digits=4)
def _(spark, folder):
    store = blocks(spark, folder)
    scaled = ws.scale_blocks(store, scalers_of(store, per_ticker=False), per_ticker=False)
    out = split_cells(store, scaled, ["has_scaler"])
    return out.select("ticker", "date", "split", checksum().alias("cells"), "has_scaler")


@query("scaled_targets__g11", f"SELECT ticker, {s('date')} AS date, split, {r('y_scaled')} AS y_scaled FROM fx_yscaled")
def _(spark, folder):
    sets = split_windows(spark, folder)
    return win.scale_targets(sets, target_scalers(sets)).select("ticker", "date", "split", "y_scaled")


@query("unscaled_targets__g12", f"SELECT ticker, {s('date')} AS date, {r('y')} AS y, {r('y * 2 + 0.5')} AS y_single FROM fx_yscaled")
def _(spark, folder):
    sets = split_windows(spark, folder)
    scalers = target_scalers(sets)
    scaled = win.scale_targets(sets, scalers).withColumn("y_single", F.col("y")).withColumn("y", F.col("y_scaled"))
    back = win.unscale(scaled, scalers, ["y"])
    return win.unscale_with(back, 0.5, 2.0, ["y_single"]).select("ticker", "date", "y", "y_single")


@query("ticker_index__g13", f"SELECT ticker, {s('date')} AS date, dense_rank() OVER (ORDER BY ticker) - 1 AS ticker_idx "
       "FROM fx_all_windows")
def _(spark, folder):
    return win.ticker_index(targets(spark, folder)).select("ticker", "date", "ticker_idx")


@query("target_statistics__g15", f"SELECT split, count(*) AS n, {r('avg(y)')} AS y_mean, {r('stddev_pop(y)')} AS y_std, "
       f"{r('avg(y_scaled)')} AS y_scaled_mean, {r('stddev_pop(y_scaled)')} AS y_scaled_std FROM fx_yscaled GROUP BY 1")
def _(spark, folder):
    sets = split_windows(spark, folder)
    return win.target_statistics(win.scale_targets(sets, target_scalers(sets)))


# ---- relative windows ------------------------------------------------------------------

fx.CTES["fx_split"] = (
    "SELECT *, rn - CASE split WHEN 'train' THEN 0 WHEN 'val' THEN cut1 ELSE cut2 END AS split_pos FROM (SELECT *, "
    "CASE WHEN rn <= cut1 THEN 'train' WHEN rn <= cut2 THEN 'val' ELSE 'test' END AS split FROM (SELECT ticker, date, rn, "
    "close, volume, zero_sentiment AS daily_sentiment, n_articles, CAST(floor(0.70e0 * n_rows) AS BIGINT) AS cut1, "
    "CAST(floor(0.85e0 * n_rows) AS BIGINT) AS cut2 FROM fx_feat))"
)
_HW = "WINDOW w AS (PARTITION BY ticker, split ORDER BY split_pos)"


def _relative_sum(length: int) -> str:
    parts = []
    for k in range(length):
        at = lambda c: f"lead({c}, {k}) OVER w"
        parts.append(
            f"{k + 1} * (({at('close')}) / close - 1 + 2 * (({at('volume')}) / CAST(volume AS DOUBLE) - 1) "
            f"+ 3 * ({at('daily_sentiment')}) + 4 * ({at('n_articles')}) / 10.0e0)"
        )
    return " + ".join(parts)


def horizon_sql(horizon: int, length: int = LONG) -> str:
    lead = lambda c, k: f"lead({c}, {k}) OVER w"
    return (
        "SELECT * FROM (SELECT ticker, split, split_pos, date, close AS y_base, "
        f"{lead('close', length - 1)} AS last_price, {lead('close', length - 1 + horizon)} AS target_price, "
        f"{lead('close', length - 2)} / close - 1 AS x_last, {_relative_sum(length - 1)} AS cs, "
        + ", ".join(f"{lead('close', length - 1 - j)} / close - 1 AS x_{j}" for j in range(1, 6))
        + f", {lead('daily_sentiment', length - 2)} AS s_last, ("
        + " + ".join(f"{lead('close', k)} / close - 1" for k in range(length - 1))
        + f") / {length - 1} AS x_mean FROM fx_split {_HW}) WHERE target_price IS NOT NULL"
    )


fx.CTES["fx_horizon"] = horizon_sql(1)
fx.CTES["fx_horizon5"] = horizon_sql(5)


def split_rows(spark, folder):
    return win.positional_split(feats.positioned_bars(*inputs(spark, folder), fill="zero"))


def price_windows(spark, folder, horizon=1, columns=win.ALL_COLUMNS):
    return win.horizon_windows(split_rows(spark, folder), LONG, horizon, columns)


@query("positional_split__g6_g5", f"SELECT ticker, {s('date')} AS date, split, split_pos, {r('daily_sentiment')} AS daily_sentiment FROM fx_split")
def _(spark, folder):
    rows = with_positions(feats.join_sentiment(*inputs(spark, folder)))
    out = win.positional_split(win.fill_news_gaps(rows))
    return out.select("ticker", "date", "split", "split_pos", "daily_sentiment")


@query("price_windows__g3_g4_g7", f"SELECT ticker, split, split_pos, {r('cs', 4)} AS cells, {r('target_price / y_base - 1', 4)} AS y, "
       f"{i('floor(y_base)')} AS y_base, {i('floor(last_price)')} AS last_price FROM fx_horizon", digits=4)
def _(spark, folder):
    out = price_windows(spark, folder)
    prices = [F.floor(c).alias(c) for c in ("y_base", "last_price")]
    return out.select("ticker", "split", "split_pos", checksum().alias("cells"), "y", *prices)


@query("five_day_windows__g4", f"SELECT ticker, split, split_pos, {r('target_price / y_base - 1')} AS y FROM fx_horizon5")
def _(spark, folder):
    return price_windows(spark, folder, 5).select("ticker", "split", "split_pos", "y")


_CHANGE = "(target_price - last_price) / last_price"


@query("direction_windows__g4", f"SELECT ticker, split, split_pos, CASE WHEN {_CHANGE} > 0 THEN 1.0e0 ELSE 0.0e0 END AS y "
       f"FROM fx_horizon WHERE abs({_CHANGE}) >= 0.01e0")
def _(spark, folder):
    out = win.horizon_windows(split_rows(spark, folder), LONG, 1, task="direction", threshold=0.01)
    return out.select("ticker", "split", "split_pos", "y")


@query("class_distribution__d22", "SELECT n_up, n_down, "
       + r("(n_up + n_down) / (2.0e0 * n_down)") + " AS weight_down, " + r("(n_up + n_down) / (2.0e0 * n_up)") + " AS weight_up, "
       + r("greatest(n_up, n_down) / CAST(n_up + n_down AS DOUBLE)") + " AS majority_accuracy FROM (SELECT "
       f"count(*) FILTER ({_CHANGE} > 0) AS n_up, count(*) FILTER ({_CHANGE} <= 0) AS n_down FROM fx_horizon WHERE split = 'train')")
def _(spark, folder):
    out = win.horizon_windows(split_rows(spark, folder), LONG, 1, task="direction")
    return win.class_distribution(out.filter("split = 'train'"))


@query("denormalised_targets__g14", f"SELECT ticker, split, split_pos, {r('target_price', 5)} AS price FROM fx_horizon", digits=5)
def _(spark, folder):
    out = price_windows(spark, folder)
    price = win.denormalise(F.col("y"), F.col("y_base"))
    return out.select("ticker", "split", "split_pos", price.alias("price"))


@query("feature_set_projection__b15_b16", f"SELECT ticker, {s('date')} AS date, {r('close', 8)} AS close, {r('volume', 8)} AS volume, "
       "CAST(n_articles AS BIGINT) AS n_articles FROM fx_feat", digits=8)
def _(spark, folder):
    bars, daily = inputs(spark, folder)
    rows = feats.positioned_bars(bars, daily, fill="zero").drop("daily_sentiment")
    shouting = rows.withColumnRenamed("close", "CLOSE")
    out = win.project_features(shouting, win.feature_set("all_features"))
    return out.select("ticker", "date", F.col("close").alias("close"), F.col("volume").cast("double").alias("volume"), "n_articles")
