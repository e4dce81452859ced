import random

import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from tickertide.operators import series


def make(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, v double")


def random_rows(seed=1, hot=400):
    rng = random.Random(seed)
    days = pd.date_range("2000-01-03", periods=2000).date
    rows = [("HOT", d, rng.uniform(1, 9) if rng.random() > 0.3 else None) for d in sorted(rng.sample(list(days), hot))]
    for k in range(12):
        for d in sorted(rng.sample(list(days), rng.randint(1, 30))):
            rows.append((f"T{k}", d, rng.uniform(1, 9) if rng.random() > 0.5 else None))
    return rows


def test_running_total_equals_plain_window(spark):
    df = make(spark, random_rows()).withColumn("n", F.dayofyear("date").cast("double"))
    levels = [F.year("date"), F.year("date") * 12 + F.month("date")]
    got = series.running_total(df, "date", levels, F.col("n"), ["ticker"], "before", "whole")
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0.0)))
    want = want.withColumn("whole", F.sum("n").over(Window.partitionBy("ticker")))
    cols = ["ticker", "date", "before", "whole"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == df.count()


def test_running_total_without_keys(spark):
    df = spark.range(1000).select((F.col("id") * 7).alias("rn"))
    levels = [F.floor(F.col("rn") / 700), F.floor(F.col("rn") / 70)]
    got = series.running_total(df, "rn", levels)
    assert got.filter(F.col("before") != F.col("rn") / 7).count() == 0


def test_positions_and_carry(spark):
    df = make(spark, random_rows(2))
    got = series.with_positions(df, ["v"])
    w = Window.partitionBy("ticker").orderBy("date")
    want = df.withColumns(
        {
            "v": F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "pos": F.row_number().over(w).cast("bigint"),
            "n_rows": F.count("*").over(Window.partitionBy("ticker")),
        }
    )
    cols = ["ticker", "date", "v", "pos", "n_rows"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == df.count()


def test_shared_positions_equal_others(spark):
    odd = [(None, days, 1.0) for days in pd.date_range("2000-01-03", periods=3).date] + [("", pd.Timestamp("2001-01-01").date(), 2.0), ("X", None, 3.0)]
    df = make(spark, random_rows(5, hot=1500) + odd).withColumn("kept", F.lit("a"))
    got, want = series.with_positions(df, ["v"], shared=True), series.with_positions(df, ["v"])
    assert got.columns == want.columns and got.count() == df.count()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 4096])
def test_blocks_equal_the_whole_series(spark, size):
    df = series.with_positions(make(spark, random_rows(3)))

    def compute(rows, w):
        return rows.withColumns(
            {
                "past": F.sum("v").over(w.rowsBetween(-5, -1)),
                "ahead": F.lead("v", 2).over(w),
                "near": F.count("v").over(w.rowsBetween(-3, 2)),
            }
        )

    got = series.over_blocks(df, compute, before=5, after=2, rows_per_block=size)
    want = compute(df, Window.partitionBy("ticker").orderBy("pos"))
    rounded = lambda d: d.select("ticker", "pos", F.round("past", 9).alias("past"), "ahead", "near")
    assert rounded(got).exceptAll(rounded(want)).count() == 0
    assert got.count() == df.count()


def test_hot_series_is_spread_over_blocks(spark):
    df = series.with_positions(make(spark, random_rows(4, hot=1500)))
    seen = series.over_blocks(df, lambda rows, w: rows.withColumn("b", F.col("_block")), 5, 0, rows_per_block=100)
    per_block = seen.groupBy("ticker", "b").count()
    assert per_block.agg(F.max("count")).first()[0] <= 100
    assert per_block.filter("ticker = 'HOT'").count() == 15


def test_dense_index_is_alphabetical(spark):
    names = ["A", "AA", "AAPL", "AB", "B", "BRK", "S000000001", "S000000002", "S000000010", "ZZ"]
    df = spark.createDataFrame([(n,) for n in names for _ in range(3)], "ticker string")
    got = {r.ticker: r.idx for r in series.dense_index(df, "ticker", "idx").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}
