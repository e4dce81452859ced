"""Queries over price bars: scans, cleaning rules, profiles."""

from pyspark.sql import functions as F

from tickertide.operators import bars as ops
from tickertide.operators import news
from tickertide.plans import fixtures as fx
from tickertide.plans.registry import i, query, r, s
from tickertide.session import shared_dir
from tickertide.sources import readers, writers

Y1, Y2 = fx.FIRST_YEAR, fx.LAST_YEAR

fx.CTES["fx_dirty"] = (
    "SELECT ticker, date, open, high, low, CASE WHEN day(date) = 17 THEN NULL ELSE close END AS close, "
    "CASE WHEN day(date) = 21 THEN -adj_close ELSE adj_close END AS adj_close, "
    "CASE WHEN day(date) = 13 THEN 0 ELSE volume END AS volume FROM fx_bars"
)
fx.CTES["fx_clean"] = (
    "SELECT * FROM fx_dirty WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND adj_close > 0 AND volume > 0"
)
fx.CTES["fx_gappy"] = "SELECT * FROM fx_sbars WHERE NOT (ticker LIKE '%7' AND year(date) = 1998)"
fx.CTES["fx_profile"] = (
    "SELECT ticker, year(date) AS year, count(close) AS n_rows, median(close) AS median_close, "
    "median(volume) AS median_volume, min(close) AS min_close, max(close) AS max_close, "
    "stddev_samp(close) AS volatility, "
    "CASE WHEN count(*) >= 2 AND abs(arg_min(close, date)) >= 1e-6 THEN "
    "(arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) END AS annual_return, "
    "CASE WHEN stddev_samp(open) >= 1e-6 AND stddev_samp(close) >= 1e-6 THEN corr(open, close) END AS corr_open_close "
    "FROM fx_bars GROUP BY 1, 2"
)


def dirty_bars(spark, folder):
    day = F.day("date")
    return fx.bars(spark, folder).withColumns(
        {
            "close": F.when(day != 17, F.col("close")),
            "adj_close": F.when(day == 21, -F.col("adj_close")).otherwise(F.col("adj_close")),
            "volume": F.when(day == 13, F.lit(0)).otherwise(F.col("volume")),
        }
    )


def gappy_bars(spark, folder):
    gap = F.col("ticker").endswith("7") & (F.year("date") == 1998)
    return fx.supplier_bars(spark, folder).filter(~gap)


def bar_sql(source: str, where: str = "") -> str:
    prices = ", ".join(f"{r(c, 8)} AS {c}" for c in ops.PRICES)
    return f"SELECT ticker, {s('date')} AS date, {prices}, {i('volume')} AS volume FROM {source} {where}"


@query("price_csv_scan__a1", bar_sql("fx_bars"), digits=8)
def _(spark, folder):
    path = shared_dir(spark, "price-csv")
    stored = fx.bars(spark, folder).withColumnRenamed("adj_close", "adj close")
    columns = ["ticker", "date", "volume", "open", "high", "low", "close", "adj close"]
    stored.select(columns).write.partitionBy("ticker").option("header", True).csv(path)
    return readers.read_price_csv(spark, path)


@query("universe_scan__a2", "SELECT lower(trim(symbol)) AS symbol FROM fx_universe")
def _(spark, folder):
    path = shared_dir(spark, "universe-csv")
    listing = fx.universe(spark, folder).select(F.concat(F.lit(" "), "symbol").alias("Symbol"))
    listing.write.option("header", True).csv(path)
    return readers.read_universe_csv(spark, path)


@query("requested_tickers__a11", "SELECT ticker, count(*) AS n FROM fx_sbars WHERE ticker IN "
       "(SELECT ticker FROM fx_ssent WHERE n_articles > 2) GROUP BY 1")
def _(spark, folder):
    wanted = fx.supplier_sentiment(spark, folder).filter("n_articles > 2")
    return ops.requested_bars(wanted, fx.supplier_bars(spark, folder)).groupBy("ticker").agg(F.count("*").alias("n"))


@query("missing_tickers__a11", "SELECT DISTINCT ticker FROM fx_ssent WHERE ticker NOT IN (SELECT ticker FROM fx_gappy "
       "WHERE ticker NOT LIKE '%3')")
def _(spark, folder):
    bars = gappy_bars(spark, folder).filter(~F.col("ticker").endswith("3"))
    return ops.missing_tickers(fx.supplier_sentiment(spark, folder), bars)


@query("rejected_tickers__a14",
       "SELECT ticker, CASE WHEN lower(ticker) NOT IN (SELECT lower(symbol) FROM fx_universe) THEN 'not in universe' "
       "WHEN n_range = 0 THEN 'no data in date range' WHEN n_clean < 2000 THEN 'insufficient data after cleaning' "
       "WHEN n_years < 7 THEN 'incomplete year coverage' END AS reason FROM (SELECT ticker, "
       "count(*) FILTER (year(date) BETWEEN 1995 AND 2001) AS n_range, "
       "count(*) FILTER (year(date) BETWEEN 1995 AND 2001 AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND "
       "adj_close > 0 AND volume > 0) AS n_clean, count(DISTINCT CASE WHEN year(date) BETWEEN 1995 AND 2001 AND "
       "open > 0 AND high > 0 AND low > 0 AND close > 0 AND adj_close > 0 AND volume > 0 THEN year(date) END) AS n_years "
       "FROM fx_dirty WHERE NOT (ticker = 'ASIA' AND year(date) = 1999) GROUP BY 1) WHERE reason IS NOT NULL")
def _(spark, folder):
    bars = dirty_bars(spark, folder).filter("NOT (ticker = 'ASIA' AND year(date) = 1999)")
    return ops.rejected_tickers(bars, fx.universe(spark, folder), Y1, Y2, minimum=2000)


@query("bars_with_news__a15", "SELECT ticker, count(*) AS n FROM fx_sbars WHERE upper(ticker) IN "
       "(SELECT upper(ticker) FROM fx_ssent WHERE n_articles > 2) GROUP BY 1")
def _(spark, folder):
    named = fx.supplier_sentiment(spark, folder).filter("n_articles > 2").select(F.lower("ticker").alias("ticker"))
    kept = ops.prune_without_news(fx.supplier_bars(spark, folder), named)
    return kept.groupBy("ticker").agg(F.count("*").alias("n"))


@query("valid_tickers__a18", "SELECT DISTINCT lower(ticker) AS ticker FROM fx_sbars")
def _(spark, folder):
    return news.valid_tickers(fx.supplier_bars(spark, folder))


@query("date_range__b1", bar_sql("fx_bars", "WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'"), digits=8)
def _(spark, folder):
    return ops.in_date_range(fx.bars(spark, folder), "1996-03-01", "1998-02-28")


@query("universe_members__b2", bar_sql("fx_bars", "WHERE lower(ticker) IN (SELECT lower(symbol) FROM fx_universe)"), digits=8)
def _(spark, folder):
    return ops.in_universe(fx.bars(spark, folder), fx.universe(spark, folder))


@query("drop_missing__b3", bar_sql("fx_dirty", "WHERE close IS NOT NULL"), digits=8)
def _(spark, folder):
    return ops.drop_missing(dirty_bars(spark, folder))


@query("positive_rows__b4", bar_sql("fx_clean"), digits=8)
def _(spark, folder):
    return ops.clean_rows(dirty_bars(spark, folder))


@query("enough_rows__b5", "SELECT ticker, count(*) AS n FROM fx_sbars GROUP BY 1 HAVING count(*) >= 520")
def _(spark, folder):
    kept = ops.with_enough_rows(fx.supplier_bars(spark, folder), 520)
    return kept.groupBy("ticker").agg(F.count("*").alias("n"))


@query("every_year__b6", "SELECT ticker, count(*) AS n FROM fx_gappy GROUP BY 1 HAVING "
       "count(DISTINCT CASE WHEN year(date) BETWEEN 1995 AND 2001 THEN year(date) END) = 7")
def _(spark, folder):
    kept = ops.with_every_year(gappy_bars(spark, folder), Y1, Y2)
    return kept.groupBy("ticker").agg(F.count("*").alias("n"))


_ROUND = ", ".join(f"round_even({c} * 10000, 0) / 10000 AS {c}" for c in ops.PRICES)


@query("formatted_bars__b7",
       f"SELECT ticker, {s('date')} AS date, {_ROUND}, {i('volume')} AS volume FROM fx_sbars ORDER BY ticker, date", digits=8)
def _(spark, folder):
    return ops.formatted(fx.supplier_bars(spark, folder)).orderBy("ticker", "date")


@query("selected_bars__b1_b7",
       f"SELECT ticker, {s('date')} AS date, {_ROUND}, {i('volume')} AS volume FROM fx_clean "
       "WHERE lower(ticker) IN (SELECT lower(symbol) FROM fx_universe) AND year(date) BETWEEN 1995 AND 2001", digits=8)
def _(spark, folder):
    return ops.select_bars(dirty_bars(spark, folder), fx.universe(spark, folder), Y1, Y2)


@query("year_profile__d1_d2_d3",
       f"SELECT ticker, year, n_rows, {r('median_close')} AS median_close, {r('median_volume')} AS median_volume, "
       f"{r('min_close')} AS min_close, {r('max_close')} AS max_close, {r('volatility')} AS volatility, "
       f"{r('annual_return')} AS annual_return, {r('corr_open_close')} AS corr_open_close FROM fx_profile")
def _(spark, folder):
    return ops.year_profile(fx.bars(spark, folder))


_SPROFILE = fx.CTES["fx_profile"].replace("fx_bars", "fx_sbars")


@query("supplier_year_profile__d1_d2_d3",
       f"SELECT ticker, year, n_rows, {r('median_close')} AS median_close, {r('median_volume')} AS median_volume, "
       f"{r('min_close')} AS min_close, {r('max_close')} AS max_close, {r('volatility')} AS volatility, "
       f"{r('annual_return')} AS annual_return, {r('corr_open_close')} AS corr_open_close FROM ({_SPROFILE})")
def _(spark, folder):
    return ops.year_profile(fx.supplier_bars(spark, folder))


@query("profile_counts__d4", "SELECT count(*) AS n_tickers, count(*) FILTER (n = 7) AS n_complete FROM (SELECT ticker, "
       "count(*) FILTER (year BETWEEN 1995 AND 2001) AS n FROM fx_profile GROUP BY 1)")
def _(spark, folder):
    return ops.profile_counts(ops.year_profile(fx.bars(spark, folder)), Y1, Y2)


@query("top_volume__d4_k2", f"SELECT ticker, {r('mean_value')} AS mean_value FROM (SELECT ticker, "
       f"avg(median_volume) AS mean_value FROM ({_SPROFILE}) GROUP BY 1 ORDER BY round(mean_value, 9) DESC, ticker LIMIT 5)")
def _(spark, folder):
    return ops.top_by_mean(ops.year_profile(fx.supplier_bars(spark, folder)), "median_volume")


@query("top_return__d4_k2", f"SELECT ticker, {r('mean_value')} AS mean_value FROM (SELECT ticker, "
       f"avg(annual_return) AS mean_value FROM ({_SPROFILE}) GROUP BY 1 HAVING mean_value IS NOT NULL "
       "ORDER BY mean_value DESC, ticker LIMIT 5)")
def _(spark, folder):
    return ops.top_by_mean(ops.year_profile(fx.supplier_bars(spark, folder)), "annual_return")


@query("selection_stats__d14",
       f"SELECT ticker, num_days, {r('avg_volume')} AS avg_volume, greatest(0, num_days - 520 + 1) AS possible_sequences, "
       f"coalesce(nd, 0) AS n_sentiment_days, {i('coalesce(na, 0)')} AS total_articles FROM (SELECT ticker, "
       "count(*) AS num_days, avg(volume) AS avg_volume FROM fx_sbars GROUP BY 1) LEFT JOIN (SELECT ticker, "
       "count(DISTINCT date) AS nd, sum(n_articles) AS na FROM fx_ssent WHERE ticker NOT LIKE '%5' GROUP BY 1) USING (ticker)")
def _(spark, folder):
    sentiment = fx.supplier_sentiment(spark, folder).filter(~F.col("ticker").endswith("5"))
    return ops.selection_stats(fx.supplier_bars(spark, folder), sentiment, 520)


@query("capital_tickers__k5", "SELECT DISTINCT ticker FROM fx_sbars WHERE ticker NOT LIKE '%4' ORDER BY ticker")
def _(spark, folder):
    name = F.when(F.col("ticker").endswith("4"), F.lower("ticker")).otherwise(F.col("ticker"))
    return ops.upper_case_tickers(fx.supplier_bars(spark, folder).withColumn("ticker", name))


@query("sorted_bars__k1", bar_sql("fx_sbars"), digits=8)
def _(spark, folder):
    path = shared_dir(spark, "bars")
    writers.write_sorted(fx.supplier_bars(spark, folder), path, "ticker", "date")
    return spark.read.parquet(path)


@query("first_tickers__k2", "SELECT DISTINCT ticker FROM fx_sbars ORDER BY ticker LIMIT 10")
def _(spark, folder):
    return ops.upper_case_tickers(fx.supplier_bars(spark, folder)).orderBy("ticker").limit(10)
