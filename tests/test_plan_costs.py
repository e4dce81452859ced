"""What wide or long plans must not do: projections the JVM leaves uncompiled, steps stacked for one cell."""

import contextlib
import io
import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tickertide.operators import windows as win
from tickertide.plans import fit_queries, registry
from tickertide.sources import writers

COMPILED = 8000  # bytes of a method that the JVM still compiles


def printed(df, mode):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_rounded_values_are_those_of_round(spark):
    values = [(k * 0.7310585 - 40) * 10.0**p for k in range(200) for p in (-8, -3, 0, 4, 9)]
    values += [2.0**53 / 1e6 + k for k in (-0.25, 0.0, 0.25)] + [-1e-9, -0.0, 1e300, -1e300, math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("v", F.col("v") + registry.tie_shift(6))
    rows = df.select("v", registry.rounded(F.col("v"), 6).alias("a"), F.round("v", 6).alias("b")).collect()
    for row in rows:
        assert row.a == row.b or (row.a != row.a and row.b != row.b), row
        assert row.a is None or math.copysign(1, row.a) == 1 or row.a < 0


@pytest.mark.parametrize("name", ["cumulative_sentiment__f1_f12", "combined_features__c2_f13"])
def test_wide_projections_stay_compiled(spark, folder, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", printed(entry_module.queries()[name](spark, folder), "codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(map(int, sizes)) < COMPILED


def split_rows(spark, n=40):
    rows = [("A", "train", k, k, 10.0 + k % 7, 5 + k, 0.1 * k, k % 3) for k in range(1, n + 1)]
    return spark.createDataFrame(
        rows, "ticker string, split string, split_pos bigint, date int, close double, volume bigint, daily_sentiment double, n_articles int"
    )


@pytest.mark.parametrize("columns", [win.ALL_COLUMNS, ("close",)])
def test_last_move_is_the_first_cell_of_the_last_step(spark, columns):
    rows = win.horizon_windows(split_rows(spark), 6, 2, columns, rows_per_block=8).collect()
    assert len(rows) == 40 - 5 - 2
    for row in rows:
        assert len(row.x) == 5 and row.x[0][0] == 0.0
        assert row.last_move == row.x[-1][0]


def test_price_direction_stacks_no_steps(spark, folder):
    plan = printed(entry_module.queries()["price_direction__i10"](spark, folder), "extended")
    optimised = plan.split("== Optimized Logical Plan ==")[1]
    assert "collect_list" not in optimised and "o_orderdate" not in optimised


def test_lines_store_the_price_alone(spark, folder, monkeypatch):
    class Stop(Exception):
        pass

    built = []

    def spy(_spark, _path, build):
        built.append(build())
        raise Stop

    monkeypatch.setattr(fit_queries, "load_or_build", spy)
    with pytest.raises(Stop):
        fit_queries.line_runs(spark, folder)
    assert built[0].columns == ["ticker", "split", "x", "y"]
    assert "o_orderdate" not in printed(built[0], "extended").split("== Optimized Logical Plan ==")[1]
    assert {len(step) for row in built[0].limit(5).collect() for step in row.x} == {1}


@pytest.mark.parametrize("name, reads", [("sliding_windows__g1", 2), ("pooled_windows__m5", 2), ("persistence_from_cells__i2", 2), ("combined_features__c2_f13", 3)])
def test_lines_are_dealt_out_once_per_use(spark, folder, name, reads):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = printed(entry_module.queries()[name](spark, folder), "formatted")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"Location: .*lineitem\.parquet", plan)) == reads
    assert "window-blocks" not in plan


def test_kept_tables_are_packed(spark, tmp_path):
    path = str(tmp_path / "kept")
    assert writers.load_or_build(spark, path, lambda: spark.range(10)).count() == 10
    parts = list((tmp_path / "kept").glob("part-*.parquet"))
    assert parts and all(p.name.endswith(".zstd.parquet") for p in parts)
