"""CSV with line breaks inside quotes, every file read by many tasks.

Spark's own reader gives a file with such line breaks to one task. Here lines are scanned in splits, and
the quotes before a line tell whether it begins a record: after an even number it does, after an odd
number it goes on. Quotes are counted inside a split; across splits only one row per split is
ordered. Lines of a record are joined and parsed by ``from_csv``.

Files must keep the common rule: a field that holds a quote, a separator or a line break is quoted, and
quotes inside it are doubled. Where the quotes of a file do not match, its last record runs to the end of
the file, as with Spark's reader. Line breaks inside texts stay as they are. Empty lines between records are skipped; a file without records gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def quoted_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """One row per record: file, record (1, 2, ... in file order), text (line breaks as in the file)."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("file"),
        F.input_file_block_start().alias("split"),
        F.monotonically_increasing_id().alias("line"),  # rises with the lines of a split
        "value",
    )
    n_quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    split = Window.partitionBy("file", "split").orderBy("line")
    earlier = F.coalesce(F.sum("odd").over(split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("odd", n_quotes % 2).withColumn("inside", earlier % 2)

    # Per split: parity of its quotes, and how many records begin in it after either parity before it.
    begins = [F.count_if(F.col("inside") == k).alias(f"begins{k}") for k in (0, 1)]
    splits = lines.groupBy("file", "split").agg(F.sum("odd").alias("odd"), *begins)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    here = F.when(F.col("open") == 0, F.col("begins0")).otherwise(F.col("begins1"))
    splits = splits.withColumn("here", here).withColumn("earlier", F.coalesce(F.sum("here").over(before), F.lit(0)))

    placed = lines.join(splits.select("file", "split", "open", "earlier"), ["file", "split"])
    first = (F.col("inside") == F.col("open")).cast("bigint")
    so_far = F.sum(first).over(split.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("record", F.col("earlier") + so_far)
    parts = F.array_sort(F.collect_list(F.struct("split", "line", "value")))
    records = placed.groupBy("file", "record").agg(parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    return records.select("file", "record", F.regexp_replace(text, "\r$", "").alias("text"))


def read_quoted_csv(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Rows of CSV files with a header line, all columns as text, with ``_file`` and ``_record`` in front.

    Columns are those of the reader for whole files; the first record of each file is its header.
    """
    options = {"multiLine": "true", "quote": quote, "escape": quote}
    names = spark.read.options(header=True, **options).csv(path).columns
    schema = ", ".join(f"`{name}` string" for name in names)
    records = quoted_records(spark, path, quote).filter((F.col("record") > 1) & (F.col("text") != ""))
    rows = records.select(F.col("file").alias("_file"), F.col("record").alias("_record"), F.from_csv("text", schema, options).alias("_row"))
    return rows.select("_file", "_record", "_row.*")
