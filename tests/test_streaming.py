import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickertide import schemas
from tickertide.streaming import jobs


def add_files(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.createDataFrame([], schema).schema


def test_scores_are_added_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    seen = []

    def score(batch):
        seen.extend(r.article_index for r in batch.collect())
        return batch.select("article_index", F.length("summary").cast("double").alias("sentiment"))

    schema = schemas.SUMMARIES
    struct = add_files(spark, [(1, "a"), (2, "bb")], schema, src)
    jobs.score_new_articles(jobs.file_stream(spark, src, struct), score, out, mark)
    add_files(spark, [(2, "changed"), (3, "ccc")], schema, src)
    jobs.score_new_articles(jobs.file_stream(spark, src, struct), score, out, mark)
    assert sorted(seen) == [1, 2, 3]
    assert {r.article_index: r.sentiment for r in jobs.read_scores(spark, out).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}


def test_a_batch_reads_nothing_of_what_its_run_has_stored(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    seen = []

    def score(batch):
        seen.extend((r.article_index, r.summary) for r in batch.collect())
        return batch.select("article_index", F.length("summary").cast("double").alias("sentiment"))

    struct = add_files(spark, [(1, "a"), (1, "a"), (None, "n")], schemas.SUMMARIES, src)
    jobs.score_new_articles(jobs.file_stream(spark, src, struct), score, out, mark)
    (broken,) = (tmp_path / "out").glob("started=*/run=*/batch=0")
    (broken / "part-broken.parquet").write_text("no parquet")
    add_files(spark, [(1, "changed"), (2, "b"), (None, "again")], schemas.SUMMARIES, src)
    jobs.score_new_articles(jobs.file_stream(spark, src, struct), score, out, mark)
    assert seen.count((1, "a")) == 1 and sorted(seen, key=repr) == [(1, "a"), (2, "b"), (None, "n")]


def test_a_scorer_may_join_its_articles_with_themselves(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))

    def score(batch):
        lengths = batch.select("article_index", F.length("summary").cast("double").alias("sentiment"))
        return batch.select("article_index").join(lengths, "article_index").unionByName(lengths.filter("false"))

    struct = add_files(spark, [(1, "a"), (2, "bb"), (2, "bb")], schemas.SUMMARIES, src)
    jobs.score_new_articles(jobs.file_stream(spark, src, struct), score, out, mark)
    assert {r.article_index: r.sentiment for r in spark.read.parquet(out).collect()} == {1: 1.0, 2: 2.0}


def test_a_failed_batch_is_scored_again_and_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    calls = []

    def score(batch):
        calls.append(batch.count())
        if len(calls) == 1:
            raise RuntimeError("scorer is down")
        return batch.select("article_index", F.length("summary").cast("double").alias("sentiment"))

    struct = add_files(spark, [(1, "a"), (2, "bb")], schemas.SUMMARIES, src)
    with pytest.raises(Exception, match="scorer is down"):
        jobs.score_new_articles(jobs.file_stream(spark, src, struct), score, out, mark)
    jobs.score_new_articles(jobs.file_stream(spark, src, struct), score, out, mark)
    assert calls == [2, 2]
    assert {r.article_index: r.sentiment for r in spark.read.parquet(out).collect()} == {1: 1.0, 2: 2.0}


def test_force_scores_everything_again(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    struct = add_files(spark, [(1, "a"), (2, "bb")], schemas.SUMMARIES, src)
    by = lambda k: lambda batch: batch.select("article_index", (F.length("summary") * k).cast("double").alias("sentiment"))
    for k in (1, 10, 100):
        jobs.score_new_articles(jobs.file_stream(spark, src, struct), by(k), out, mark, force=k > 1)
        assert {r.article_index: r.sentiment for r in jobs.read_scores(spark, out).collect()} == {1: 1.0 * k, 2: 2.0 * k}
    assert spark.read.parquet(out).count() == 6


def test_another_checkpoint_keeps_stored_rows(spark, tmp_path):
    src, later, out = (str(tmp_path / n) for n in ("src", "later", "out"))
    seen = []

    def score(batch):
        seen.extend(r.article_index for r in batch.collect())
        return batch.select("article_index", F.length("summary").cast("double").alias("sentiment"))

    struct = add_files(spark, [(1, "a"), (2, "bb")], schemas.SUMMARIES, src)
    add_files(spark, [(2, "bbbb"), (3, "ccc")], schemas.SUMMARIES, later)
    for path, mark in ((src, "m1"), (later, "m2"), (src, "m3")):
        jobs.score_new_articles(jobs.file_stream(spark, path, struct), score, out, str(tmp_path / mark))
    assert sorted(seen) == [1, 2, 3]
    assert {r.article_index: r.sentiment for r in jobs.read_scores(spark, out).collect()} == {1: 1.0, 2: 2.0, 3: 3.0}


def test_a_repeated_batch_replaces_its_own_rows_only(spark, tmp_path):
    out = str(tmp_path / "out")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata").write_text('{"id":"%s"}' % name)
    one, two = (jobs.BatchTable(out, str(tmp_path / name)) for name in ("a", "b"))
    rows = lambda *ids: spark.createDataFrame([(i, 1.0) for i in ids], "article_index bigint, sentiment double")
    assert one.of_other_runs(spark) is None
    one.write(rows(1, 2), 0)
    assert one.of_other_runs(spark) is None
    two.write(rows(3), 0)
    one.write(rows(1), 0)
    assert sorted(r.article_index for r in spark.read.parquet(out).collect()) == [1, 3]
    assert [r.article_index for r in one.of_other_runs(spark).collect()] == [3]


def test_daily_means_take_late_rows(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "ticker string, ts timestamp_ntz, sentiment double"
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    struct = add_files(spark, [("A", day(5, 1), 1.0), ("A", day(5, 23), 0.0), ("B", day(6, 0), 1.0)], schema, src)
    jobs.daily_sentiment_stream(jobs.file_stream(spark, src, struct), out, mark)
    add_files(spark, [("A", day(5, 2), 0.5), ("A", day(1, 0), -1.0)], schema, src)
    jobs.daily_sentiment_stream(jobs.file_stream(spark, src, struct), out, mark)
    got = {(r.ticker, r.date.day): (r.daily_sentiment, r.n_articles) for r in jobs.read_daily_sentiment(spark, out).collect()}
    assert got == {("A", 5): (0.5, 3), ("B", 6): (1.0, 1), ("A", 1): (-1.0, 1)}


def test_watermark_is_optional(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "ticker string, ts timestamp_ntz, sentiment double"
    struct = add_files(spark, [("A", dt.datetime(2024, 1, 5, 1), 1.0)], schema, src)
    jobs.daily_sentiment_stream(jobs.file_stream(spark, src, struct), out, mark, watermark="2 days")
    assert jobs.read_daily_sentiment(spark, out).count() == 1


def test_first_row_wins_whatever_the_file_order(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = schemas.NEWS_RAW
    struct = add_files(spark, [(5, "u", "d5", None, "t5", None), (6, None, "d", None, "t", None)], schema, src)
    jobs.first_urls_stream(jobs.file_stream(spark, src, struct), out, mark)
    add_files(spark, [(2, "u", "d2", None, "t2", None), (9, "v", "d9", None, None, None)], schema, src)
    jobs.first_urls_stream(jobs.file_stream(spark, src, struct), out, mark)
    got = {r.url: (r.rn, r.title, r.date_raw) for r in jobs.read_first_urls(spark, out).collect()}
    assert got == {"u": (2, "t2", "d2"), "v": (9, None, "d9")}


def test_filter_stream_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    struct = add_files(spark, [(1, "u", "2019-01-01", None, "t", None), (2, "u", "2005-01-01", None, "t", None)], schemas.NEWS_RAW, src)
    for _ in range(2):
        jobs.filter_news_stream(jobs.file_stream(spark, src, struct), 2018, 2023, out, mark)
    assert [r.rn for r in spark.read.parquet(out).collect()] == [1]
