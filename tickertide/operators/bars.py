"""Cleaning, coverage rules and profiles of daily price bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PRICES = ["open", "high", "low", "close", "adj_close"]
MEASURES = ["volume", *PRICES]
MIN_CLEAN_ROWS = 10
FLAT = 1e-6  # below this a first price or a deviation counts as zero


def in_date_range(bars: DataFrame, first: str, last: str) -> DataFrame:
    """Rows dated within the range, both ends included."""
    return bars.filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def in_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows whose ticker is a listed symbol, ignoring case."""
    names = universe.select(F.lower(F.trim("symbol")).alias("_name")).distinct()
    return bars.join(names, F.lower(bars["ticker"]) == names["_name"], "left_semi")


def drop_missing(bars: DataFrame) -> DataFrame:
    return bars.dropna(subset=MEASURES)


def all_positive() -> Column:
    expr = F.col("volume") > 0
    for name in PRICES:
        expr = expr & (F.col(name) > 0)
    return expr


def positive_only(bars: DataFrame) -> DataFrame:
    return bars.filter(all_positive())


def clean_rows(bars: DataFrame) -> DataFrame:
    """Complete rows with strictly positive volume and prices."""
    return positive_only(drop_missing(bars))


def _keep_tickers(bars: DataFrame, kept: DataFrame) -> DataFrame:
    return bars.join(kept.select("ticker"), "ticker", "left_semi")


def with_enough_rows(bars: DataFrame, minimum: int = MIN_CLEAN_ROWS) -> DataFrame:
    counts = bars.groupBy("ticker").agg(F.count("*").alias("n"))
    return _keep_tickers(bars, counts.filter(F.col("n") >= minimum))


def with_every_year(bars: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Tickers that have rows in each year of the range."""
    year = F.year("date")
    years = bars.groupBy("ticker").agg(
        F.count_distinct(F.when(year.between(first_year, last_year), year)).alias("n_years")
    )
    return _keep_tickers(bars, years.filter(F.col("n_years") == last_year - first_year + 1))


def formatted(bars: DataFrame) -> DataFrame:
    """Prices to four decimals (halves to even), volume to whole numbers."""
    rounded = {c: F.rint(F.col(c) * 10_000) / 10_000 for c in PRICES}
    return bars.withColumns({**rounded, "volume": F.col("volume").cast("bigint")})


def _ticker_quality(bars: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Per ticker: rows, rows in range, clean rows in range and years they cover."""
    year = F.year("date")
    in_range = year.between(first_year, last_year)
    complete = F.lit(True)
    for name in MEASURES:
        complete = complete & F.col(name).isNotNull()
    clean = in_range & complete & all_positive()
    return bars.groupBy("ticker").agg(
        F.count("*").alias("n_rows"),
        F.count_if(in_range).alias("n_in_range"),
        F.count_if(clean).alias("n_clean"),
        F.count_distinct(F.when(clean, year)).alias("n_years"),
    )


def rejected_tickers(
    bars: DataFrame,
    universe: DataFrame,
    first_year: int,
    last_year: int,
    minimum: int = MIN_CLEAN_ROWS,
) -> DataFrame:
    """One row per ticker that fails a rule, with the first rule it fails."""
    quality = _ticker_quality(bars, first_year, last_year)
    names = universe.select(F.lower(F.trim("symbol")).alias("_name")).distinct()
    judged = quality.join(names, F.lower(quality["ticker"]) == names["_name"], "left")
    reason = (
        F.when(F.col("_name").isNull(), "not in universe")
        .when(F.col("n_in_range") == 0, "no data in date range")
        .when(F.col("n_clean") < minimum, "insufficient data after cleaning")
        .when(F.col("n_years") < last_year - first_year + 1, "incomplete year coverage")
    )
    return judged.select("ticker", reason.alias("reason")).filter(F.col("reason").isNotNull())


def select_bars(
    bars: DataFrame,
    universe: DataFrame,
    first_year: int,
    last_year: int,
    minimum: int = MIN_CLEAN_ROWS,
) -> DataFrame:
    """All rules together: the clean, formatted bars of the tickers that pass."""
    ranged = in_date_range(in_universe(bars, universe), f"{first_year}-01-01", f"{last_year}-12-31")
    clean = clean_rows(ranged)
    quality = _ticker_quality(clean, first_year, last_year)
    passing = quality.filter(
        (F.col("n_clean") >= minimum) & (F.col("n_years") == last_year - first_year + 1)
    )
    return formatted(_keep_tickers(clean, passing))


def missing_tickers(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Requested tickers without a single bar."""
    have = bars.select("ticker").distinct()
    return requested.select("ticker").distinct().join(have, "ticker", "left_anti")


def requested_bars(requested: DataFrame, bars: DataFrame) -> DataFrame:
    return bars.join(requested.select("ticker").distinct(), "ticker", "left_semi")


def upper_case_tickers(bars: DataFrame) -> DataFrame:
    """Sorted list of tickers written in capitals only."""
    names = bars.select("ticker").filter(F.upper("ticker") == F.col("ticker")).distinct()
    return names.orderBy("ticker")


def year_profile(bars: DataFrame) -> DataFrame:
    """Per ticker and year: counts, medians, extremes, spread, annual return, open/close correlation."""
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    flat = (F.stddev_samp("open") < FLAT) | (F.stddev_samp("close") < FLAT)
    usable = (F.count("*") >= 2) & (F.abs(first) >= FLAT)
    return bars.groupBy("ticker", F.year("date").alias("year")).agg(
        F.count("close").alias("n_rows"),
        F.median("close").alias("median_close"),
        F.median("volume").alias("median_volume"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.stddev_samp("close").alias("volatility"),
        F.when(usable, (last - first) / F.nullif(first, F.lit(0.0))).alias("annual_return"),
        F.when(~flat, F.corr("open", "close")).alias("corr_open_close"),
    )


def profile_counts(profile: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Number of tickers, and of tickers present in every year."""
    per_ticker = profile.groupBy("ticker").agg(
        F.count_if(F.col("year").between(first_year, last_year)).alias("n_years")
    )
    return per_ticker.agg(
        F.count("*").alias("n_tickers"),
        F.count_if(F.col("n_years") == last_year - first_year + 1).alias("n_complete"),
    )


def top_by_mean(profile: DataFrame, measure: str, k: int = 5) -> DataFrame:
    """The ``k`` tickers with the largest mean of a yearly measure; nulls are skipped."""
    means = profile.groupBy("ticker").agg(F.avg(measure).alias("mean_value"))
    ranked = means.filter(F.col("mean_value").isNotNull())
    return ranked.orderBy(F.desc("mean_value"), "ticker").limit(k)


def selection_stats(bars: DataFrame, sentiment: DataFrame, seq_len: int) -> DataFrame:
    """Per ticker figures for choosing what to model."""
    prices = bars.groupBy("ticker").agg(
        F.count("*").alias("num_days"), F.avg("volume").alias("avg_volume")
    )
    news = sentiment.groupBy("ticker").agg(
        F.count_distinct("date").alias("n_sentiment_days"),
        F.sum("n_articles").alias("total_articles"),
    )
    zero = F.lit(0)
    return prices.join(news, "ticker", "left").select(
        "ticker",
        "num_days",
        "avg_volume",
        F.greatest(zero, F.col("num_days") - seq_len + 1).alias("possible_sequences"),
        F.coalesce("n_sentiment_days", zero).alias("n_sentiment_days"),
        F.coalesce("total_articles", zero).alias("total_articles"),
    )


def prune_without_news(bars: DataFrame, named: DataFrame) -> DataFrame:
    """Bars of tickers that have news, ignoring case; an empty news set prunes nothing."""
    names = named.select(F.upper("ticker").alias("_name")).distinct().withColumn("_known", F.lit(True))
    nothing = names.agg((F.count("*") == 0).alias("none")).scalar()
    joined = bars.join(names, F.upper(bars["ticker"]) == names["_name"], "left")
    return joined.filter(F.col("_known") | nothing).drop("_name", "_known")
