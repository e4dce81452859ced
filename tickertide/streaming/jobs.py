"""Incremental forms of the batch steps. Each one gives the same rows as its batch operator."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tickertide.functions.columns import as_instant, instant_date
from tickertide.operators.news import in_years
from tickertide.operators.sentiment import not_yet_scored
from tickertide.session import shared_dir


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """A stream of parquet files; ``path`` is a folder or a glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything there is, batch by batch, then stop."""
    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders at a path, on any file system Spark can reach."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    return [f.getPath().getName() for f in files.listStatus(where) if f.isDirectory()]


class BatchTable:
    """A table of batches: each batch of each run owns one folder, so only a repeat replaces it.

    A run is a checkpoint (its query id); runs are numbered by their first batch, and rows of a later
    run, then of a later batch, are newer. Another checkpoint on the same table never touches the
    folders of earlier ones.
    """

    PLACE = ("started", "run", "batch")

    def __init__(self, out: str, checkpoint: str):
        self.out, self.checkpoint = out, checkpoint

    def _run(self, spark: SparkSession) -> tuple[int, str]:
        run = json.loads(spark.read.text(f"{self.checkpoint}/metadata").first()[0])["id"]
        started = [int(name.split("=")[1]) for name in _folders(spark, self.out) if name.startswith("started=")]
        for n in started:
            if f"run={run}" in _folders(spark, f"{self.out}/started={n}"):
                return n, run
        return max(started, default=-1) + 1, run

    def of_other_runs(self, spark: SparkSession) -> DataFrame | None:
        """The rows of all other runs; None while there are none. Own batches are neither read nor listed."""
        _, own = self._run(spark)
        places = [f"{self.out}/{started}/{run}" for started in _folders(spark, self.out) if started.startswith("started=")
                  for run in _folders(spark, f"{self.out}/{started}") if run != f"run={own}"]
        return spark.read.option("basePath", self.out).parquet(*places) if places else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        started, run = self._run(rows.sparkSession)
        rows.write.mode("overwrite").parquet(f"{self.out}/started={started}/run={run}/batch={batch_id}")


def _newest(stored: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the newest run and batch."""
    fields = [c for c in stored.columns if c not in (*keys, *BatchTable.PLACE)]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*BatchTable.PLACE)).alias("r"))
    return newest.select(*keys, "r.*")


def filter_news_stream(news: DataFrame, first_year: int, last_year: int, out: str, checkpoint: str) -> None:
    """Append the rows within the years to a parquet table; files are committed once."""
    query = (
        in_years(news, first_year, last_year)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_new_articles(
    articles: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, force: bool = False
) -> None:
    """Score articles not scored before and add them to the table at ``out``.

    What this checkpoint has scored is kept as keyed state (one entry per article, found by its key), so a
    batch costs what it brings, however large the table is. Scores of other checkpoints on the table count as
    done and are kept; they alone are read. With ``force`` everything there is is read and scored
    again, under a checkpoint of its own below the given one, and the newest run wins (see ``read_scores``).
    """
    if force:
        checkpoint = f"{checkpoint}/refresh-{uuid.uuid4().hex}"
    table = BatchTable(out, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = None if force else table.of_other_runs(spark)
        fresh = batch if done is None else not_yet_scored(batch, done)
        # Written once: a scorer may read its articles several times, the state of a batch only once.
        path = shared_dir(spark, "stream-articles")
        fresh.write.parquet(path)
        table.write(score(spark.read.schema(batch.schema).parquet(path)), batch_id)

    run_available(articles.dropDuplicates(["article_index"]), checkpoint, write)


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """One score per article: the one of its newest run and batch."""
    return _newest(spark.read.parquet(out), ["article_index"])


def daily_sentiment_stream(events: DataFrame, out: str, checkpoint: str, watermark: str | None = None) -> None:
    """Running mean and count per ticker and day, changed rows written per batch.

    Without a watermark no row is ever late, so the result equals the batch one; state holds one
    row per ticker and day. A watermark bounds the state of an endless stream, at the price of
    dropping rows later than it.
    """
    events = events.withColumn("ts", as_instant("ts"))
    if watermark:
        events = events.withWatermark("ts", watermark)
    daily = events.groupBy("ticker", F.window("ts", "1 day")).agg(
        F.avg("sentiment").alias("daily_sentiment"), F.count("*").alias("n_articles")
    )
    rows = daily.select("ticker", instant_date("window.start").alias("date"), "daily_sentiment", "n_articles")

    run_available(rows, checkpoint, BatchTable(out, checkpoint).write, "update")


def read_daily_sentiment(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every (ticker, day)."""
    return _newest(spark.read.parquet(out), ["ticker", "date"])


def first_urls_stream(news: DataFrame, out: str, checkpoint: str) -> None:
    """Keep the first row of every URL across batches.

    Each batch writes the smallest row number it saw per URL, with its title and date; the
    smallest over batches is exact whatever order the files arrive in (see ``read_first_urls``).
    """

    table = BatchTable(out, checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        firsts = batch.groupBy("url").agg(
            F.min("rn").alias("rn"), F.min_by(F.struct("title", "date_raw"), "rn").alias("r")
        )
        table.write(firsts.select("url", "rn", "r.*"), batch_id)

    run_available(news.filter(F.col("url").isNotNull()), checkpoint, write)


def read_first_urls(spark: SparkSession, out: str) -> DataFrame:
    stored = spark.read.parquet(out)
    firsts = stored.groupBy("url").agg(
        F.min("rn").alias("rn"), F.min_by(F.struct("title", "date_raw"), "rn").alias("r")
    )
    return firsts.select("url", "rn", "r.*")


def first_urls_bounded(news: DataFrame, watermark: str) -> DataFrame:
    """Stream of first arrivals per URL, forgetting URLs older than the watermark.

    For endless streams; ``news`` needs a ``ts`` column (UTC). The first row to arrive wins.
    """
    timed = news.withColumn("ts", as_instant("ts")).withWatermark("ts", watermark)
    return timed.dropDuplicatesWithinWatermark(["url"])
