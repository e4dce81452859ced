"""Sinks, and the scans that read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertide.functions.columns import tickers_from_text, tickers_to_text


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished table lies at the path, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """Read the table at the path, building and writing it first if it is absent or forced.

    Tables kept for later steps are as large as their input or larger, so they are packed tightly.
    """
    if force or not table_exists(spark, path):
        build().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def write_url_json(urls: DataFrame, path: str) -> None:
    """One JSON record per URL with a sorted ticker array."""
    urls.withColumn("tickers", F.array_sort("tickers")).write.mode("overwrite").json(path)


def read_url_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def flat_metadata(urls: DataFrame) -> DataFrame:
    """Rows with an article, tickers as text, sorted by article index."""
    rows = urls.filter(F.col("article_index").isNotNull())
    return rows.withColumn("tickers", tickers_to_text("tickers")).orderBy("article_index")


def write_metadata_csv(urls: DataFrame, path: str) -> None:
    flat_metadata(urls).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def read_metadata_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    flat = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    return flat.withColumn("tickers", tickers_from_text("tickers"))


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet sorted by keys, so that readers can skip row groups."""
    df.orderBy(*keys).write.mode("overwrite").parquet(path)


ROWS_PER_FILE = 1_000_000


def write_by_ticker(combined: DataFrame, path: str, pos: str = "pos", rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder per ticker with one file of it, or a file per ``rows_per_file`` rows of a large ticker.

    ``pos`` numbers the rows of a ticker from 1 and is not written. Without it a ticker gets a file per
    year, which costs more than the rows where a year has few.
    """
    if pos in combined.columns:
        part = F.floor((F.col(pos) - 1) / rows_per_file)
        combined = combined.repartition(F.col("ticker"), part).drop(pos)
    elif "date" in combined.columns:
        combined = combined.repartition(F.col("ticker"), F.year("date"))
    combined.write.mode("overwrite").partitionBy("ticker").parquet(path)


def write_run_metrics(records: DataFrame, path: str) -> None:
    """Metric records, one folder per run."""
    records.write.mode("overwrite").partitionBy("run_id").parquet(path)


def read_run_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(metrics: DataFrame, json_path: str, csv_path: str, flat: DataFrame) -> None:
    """All values as JSON, scalar ones as CSV."""
    metrics.write.mode("overwrite").json(json_path)
    flat.write.mode("overwrite").option("header", True).csv(csv_path)


def yearly_map(counts: DataFrame) -> DataFrame:
    """Per ticker a map from year to count: the nested form of the statistics."""
    entry = F.struct("year", "n_articles")
    return counts.groupBy("ticker").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("years")
    )
