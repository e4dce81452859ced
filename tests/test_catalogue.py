"""Every registered query against its SQL, and what its plan must not contain."""

import re

import pytest

import __spark_entry__ as entry_module
from check import compare, duck
from tickertide.plans import catalogue

NAMES = list(catalogue.queries())


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_every_check_belongs_to_a_query():
    assert set(catalogue.checks()) <= set(NAMES)
    assert catalogue.FLAGSHIP in NAMES


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, folder, name):
    ok, note = compare(spark, con, name, folder)
    assert ok, note


PLANNED = [
    "selected_bars__b1_b7", "pruned_urls__h2", "articles_per_day__d15", "market_days__c7", "price_features__e1_e16",
    "cumulative_sentiment__f1_f12", "combined_features__c2_f13", "calendar_split__g8", "scaled_windows__g10_c9",
    "roc_area_of_windows__i11", "all_runs__i19_k3", "text_to_daily_sentiment__h7_h9_d12_c3_d13",
]


@pytest.mark.parametrize("name", PLANNED)
def test_plans_have_no_pairwise_join_and_no_row_python(spark, folder, name):
    plan = catalogue.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin", plan)
    assert "BatchEvalPython" not in plan


def test_price_features_read_only_needed_columns(spark, folder):
    plan = catalogue.queries()["valid_tickers__a18"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("l_extendedprice" not in s for s in schemas)


def test_date_range_reaches_the_scan(spark, folder, tmp_path):
    from tickertide.operators import bars as ops
    from tickertide.plans import fixtures as fx

    path = str(tmp_path / "bars")
    fx.bars(spark, folder).write.parquet(path)
    plan = ops.in_date_range(spark.read.parquet(path), "1996-01-01", "1996-12-31")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in text and "LessThanOrEqual(date" in text
