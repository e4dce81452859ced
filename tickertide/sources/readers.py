"""Scans of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertide import schemas
from tickertide.functions.columns import leading_date
from tickertide.sources.quoted import read_quoted_csv

# Columns of the raw news file that are not used.
NEWS_DROPPED = [
    "Unnamed: 0", "Author", "Publisher", "Lsa_summary", "Textrank_summary", "Lexrank_summary",
    "Lunh_summary",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Price files as one table; a ticker is the stem of its file, or the name of its folder.

    All files are one scan with a fixed schema, whatever their number.
    """
    options = {"header": True, "enforceSchema": False, "recursiveFileLookup": True}
    raw = spark.read.schema(schemas.PRICE_CSV).options(**options).csv(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"[/=]([^/=]+?)(?:\.csv|/part-[^/]*)$", 1)
    return raw.select(
        name.alias("ticker"),
        "date",
        "open",
        "high",
        "low",
        "close",
        F.col("adj close").alias("adj_close"),
        F.col("volume").cast("bigint").alias("volume"),
    )


def read_universe_csv(spark: SparkSession, path: str) -> DataFrame:
    return universe(spark.read.option("header", True).csv(path).withColumnRenamed("Symbol", "symbol"))


def universe(listing: DataFrame) -> DataFrame:
    """Distinct symbols, trimmed and lower-case."""
    return listing.select(F.lower(F.trim("symbol")).alias("symbol")).distinct()


def read_news_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw news with quoted multi-line text, without the unused columns."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
    return used_news_columns(spark.read.options(**options).csv(path))


# Columns of the raw news file and their names here.
NEWS_NAMES = {
    "Url": "url", "Date": "date_raw", "Stock_symbol": "stock_symbol", "Article_title": "title",
    "Article": "article",
}
ROWS_PER_FILE = 1 << 33  # record numbers of a file
MANY_FILES = 100_000  # file names that may be broadcast


def read_raw_news(spark: SparkSession, path: str) -> DataFrame:
    """Raw news with our names and ``rn``, a row number that rises in file order.

    A file is read by many tasks, also where texts hold line breaks (see ``quoted``). Within a file rows
    are numbered as they stand, files by their names; numbers have gaps.
    """
    raw = read_quoted_csv(spark, path)
    files = [(name, i) for i, name in enumerate(sorted(spark.read.text(path).inputFiles()))]
    numbers = spark.createDataFrame(files, "_file string, _number bigint")
    numbered = raw.join(F.broadcast(numbers) if len(files) <= MANY_FILES else numbers, "_file")
    named = [F.col(old).alias(new) for old, new in NEWS_NAMES.items()]
    return numbered.select((F.col("_number") * ROWS_PER_FILE + F.col("_record")).alias("rn"), *named)


def used_news_columns(news: DataFrame) -> DataFrame:
    return news.drop(*NEWS_DROPPED)


def read_calendar_csv(spark: SparkSession, path: str) -> DataFrame:
    return calendar(spark.read.option("header", True).csv(path))


def calendar(days: DataFrame, column: str = "date") -> DataFrame:
    """Market days from date text; unreadable ones are dropped."""
    return days.select(leading_date(F.col(column).cast("string")).alias("date")).dropna().distinct()


def summaries(stored: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Summaries, all of them or those of an index set (which may be empty)."""
    return stored if keep is None else stored.join(keep.select("article_index"), "article_index", "left_semi")


def daily_sentiment(stored: DataFrame) -> DataFrame:
    """Daily sentiment as stored (``Ticker, Date, Daily_Sentiment, n_articles``) with our names."""
    return stored.select(
        F.col("Ticker").alias("ticker"),
        F.to_date("Date").alias("date"),
        F.col("Daily_Sentiment").cast("double").alias("daily_sentiment"),
        F.col("n_articles").cast("bigint").alias("n_articles"),
    )
