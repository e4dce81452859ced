"""Aligning news to market days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tickertide.functions.columns import new_york_hour

CLOSE_HOUR = 16  # New York


def drop_after_calendar(urls: DataFrame, calendar: DataFrame) -> DataFrame:
    """Remove rows dated after the last market day; rows without a readable date stay."""
    last = calendar.agg(F.max("date")).scalar()
    return urls.filter(F.col("date").isNull() | (F.col("date") <= last))


def after_calendar(urls: DataFrame, calendar: DataFrame) -> DataFrame:
    """The rows that ``drop_after_calendar`` removes."""
    return urls.filter(F.col("date") > calendar.agg(F.max("date")).scalar())


def flag_after_close(urls: DataFrame, calendar: DataFrame) -> DataFrame:
    """``posted_after_close``: the UTC date is a market day and it is 16:00 or later in New York.

    The day test uses UTC and the hour test New York time, so a stamp at midnight UTC of a
    market day counts as after close. No readable date gives false.
    """
    days = calendar.select(F.col("date"), F.lit(True).alias("_open"))
    late = F.coalesce(F.col("_open") & (new_york_hour("ts") >= CLOSE_HOUR), F.lit(False))
    return urls.join(days, "date", "left").withColumn("posted_after_close", late).drop("_open")


def close_share(urls: DataFrame) -> DataFrame:
    """Number and share of URLs posted before and after close."""
    after = F.count_if("posted_after_close")
    n = F.count("*")
    return urls.agg(
        n.alias("n_urls"),
        (n - after).alias("n_before"),
        after.alias("n_after"),
        (after * 100.0 / F.nullif(n, F.lit(0))).alias("pct_after"),
    )


def market_day_map(calendar: DataFrame) -> DataFrame:
    """Every date from the first to the last market day with the market day it belongs to.

    The one-task window runs over calendar days only, a few thousand rows per decade.
    """
    bounds = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    dates = bounds.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    days = calendar.select("date", F.col("date").alias("_day"))
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dates.join(days, "date", "left").select(
        "date", F.last("_day", ignorenulls=True).over(so_far).alias("market_day")
    )


def assign_market_day(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Latest market day on or before ``date``; earlier dates go to the first one.

    Dates after the last market day and rows without a date are dropped; see ``count_unassigned``.
    """
    first = calendar.agg(F.min("date")).scalar()
    keyed = df.filter(F.col("date").isNotNull()).withColumn("_key", F.greatest(F.col("date"), first))
    days = market_day_map(calendar).withColumnRenamed("date", "_key")
    return keyed.join(days, "_key").drop("_key")


def count_unassigned(df: DataFrame, calendar: DataFrame) -> DataFrame:
    last = calendar.agg(F.max("date")).scalar()
    return df.agg(
        F.count_if(F.col("date") <= last).alias("n_assigned"),
        F.count_if((F.col("date") > last) | F.col("date").isNull()).alias("n_dropped"),
    )


def articles_per_day(assigned: DataFrame, calendar: DataFrame) -> DataFrame:
    """Article count of every market day, zero where there is none."""
    counts = assigned.groupBy(F.col("market_day").alias("date")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


def busiest_days(per_day: DataFrame, k: int = 10) -> DataFrame:
    return per_day.orderBy(F.desc("n"), "date").limit(k)


def ticker_days(assigned: DataFrame) -> DataFrame:
    """Article count per ticker and market day over the exploded ticker lists."""
    pairs = assigned.select("market_day", F.explode("tickers").alias("ticker"))
    return pairs.groupBy("ticker", "market_day").agg(F.count("*").alias("n"))


def busiest_tickers(counts: DataFrame, k: int = 10) -> list[str]:
    """Names of the ``k`` tickers with most articles: the columns of the wide table.

    Only these ``k`` names come to the driver.
    """
    totals = counts.groupBy("ticker").agg(F.sum("n").alias("total"))
    return [r.ticker for r in totals.orderBy(F.desc("total"), "ticker").limit(k).collect()]


def wide_ticker_days(counts: DataFrame, calendar: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """One row per market day and one column per ticker, zero-filled over the whole calendar."""
    cells = [F.sum(F.when(F.col("ticker") == t, F.col("n"))).alias(t) for t in tickers]
    wide = counts.groupBy(F.col("market_day").alias("date")).agg(*cells)
    return calendar.join(wide, "date", "left").fillna(0, subset=list(tickers))
