import pytest
import os

from tickertide.session import shared_dir
from tickertide.operators import studies
from tickertide.sources import readers, writers


def test_price_files_named_after_tickers(spark, tmp_path):
    head = "date,volume,open,high,low,close,adj close\n"
    for name in ("AAPL", "brk-b"):
        (tmp_path / f"{name}.csv").write_text(head + "2020-01-02,10.0,1,2,0.5,1.5,1.4\n2020-01-03,,1,2,0.5,,1.4\n")
    rows = readers.read_price_csv(spark, str(tmp_path)).orderBy("ticker", "date").collect()
    assert [r.ticker for r in rows] == ["AAPL", "AAPL", "brk-b", "brk-b"]
    assert rows[0].volume == 10 and rows[0].adj_close == 1.4 and rows[1].close is None


def test_news_text_keeps_quotes_and_lines(spark, tmp_path):
    path = tmp_path / "news.csv"
    path.write_text('Date,Url,Author,Article\n2020-01-01,http://a,me,"He said ""no"",\nthen left"\n')
    df = readers.read_news_csv(spark, str(path))
    assert df.columns == ["Date", "Url", "Article"]
    assert df.first().Article == 'He said "no",\nthen left'


def test_calendar_skips_unreadable_days(spark, tmp_path):
    path = tmp_path / "days.csv"
    path.write_text("date\n2020-01-02 00:00:00\nnone\n2020-01-02\n2020-01-03\n")
    assert readers.read_calendar_csv(spark, str(path)).count() == 2


def test_summaries_limited_to_an_index_set(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b")], "article_index bigint, summary string")
    keep = spark.createDataFrame([(2,)], "article_index bigint")
    assert readers.summaries(stored).count() == 2
    assert readers.summaries(stored, keep).count() == 1
    assert readers.summaries(stored, keep.limit(0)).count() == 0


def test_load_or_build(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    assert not writers.table_exists(spark, path)
    assert writers.load_or_build(spark, path, build).count() == 1
    assert writers.load_or_build(spark, path, build).count() == 1 and len(calls) == 1
    assert writers.load_or_build(spark, path, build, force=True).count() == 2


def test_articles_of_no_url_leave_an_empty_table(spark, tmp_path):
    from tickertide.operators import news

    articles = spark.createDataFrame([(0, "u", "t")], "article_index bigint, url string, article string")
    urls = spark.createDataFrame([], "url_hash string, article_index bigint")
    path = str(tmp_path / "a")
    news.keep_articles(articles, urls).write.parquet(path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == articles.columns


def test_run_metrics_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame([("r1", 2, 0.5), ("r2", 3, 0.25)], "run_id string, n bigint, mse double")
    path = str(tmp_path / "m")
    writers.write_run_metrics(studies.metric_records(metrics, ["run_id"]), path)
    assert os.path.isdir(f"{path}/run_id=r1")
    assert writers.read_run_metrics(spark, path).filter("metric = 'mse'").count() == 2


def test_tables_go_below_the_warehouse_unless_it_is_local_to_a_cluster_machine(spark):
    class Elsewhere:
        """The session as a cluster would have it."""

        class sparkContext:
            master, _jvm, _jsc = "yarn", spark.sparkContext._jvm, spark.sparkContext._jsc

        class conf:
            @staticmethod
            def get(key, default=None):
                return default if key == "spark.checkpoint.dir" else spark.conf.get(key)

    if not spark.conf.get("spark.checkpoint.dir", None):
        assert shared_dir(spark, "x").startswith(spark.conf.get("spark.sql.warehouse.dir"))
    with pytest.raises(ValueError):
        shared_dir(Elsewhere, "x")


def test_raw_news_rows_are_numbered_in_file_order(spark, tmp_path):
    head = "Unnamed: 0,Date,Article_title,Stock_symbol,Url,Publisher,Author,Article,Lsa_summary,Luhn_summary,Textrank_summary,Lexrank_summary\n"
    for name, rows in (("b", ["2", "3"]), ("a", ["0", "1"])):
        lines = [f'9,2020-01-0{k} 10:00:00 UTC,t{k},ab,u{k},p,q,"two\nlines {k}",x,x,x,x\n' for k in map(int, (str(int(r) + 1) for r in rows))]
        (tmp_path / f"{name}.csv").write_text(head + "".join(lines))
    rows = readers.read_raw_news(spark, str(tmp_path)).orderBy("rn").collect()
    assert [r.url for r in rows] == ["u1", "u2", "u3", "u4"] and len({r.rn for r in rows}) == 4
    assert set(rows[0].asDict()) == {"rn", "url", "date_raw", "stock_symbol", "title", "article"}
    assert rows[0].article == "two\nlines 1" and rows[0].date_raw.startswith("2020-01-01")
