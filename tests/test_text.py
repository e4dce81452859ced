import math
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickertide.functions import columns as cols
from tickertide.operators import sentiment as senti
from tickertide.operators import text as ops


def brute_force_central(terms, keep):
    """The definition, pair by pair."""
    n = len(terms)
    if n <= keep:
        return list(range(n))
    tf = []
    for words in terms:
        top = max((words.count(w) for w in words), default=1)
        tf.append({w: words.count(w) / top for w in words})
    df = {w: sum(w in t for t in tf) for t in tf for w in t}
    idf = {w: math.log(n / (1 + df[w])) for w in df}

    def cosine(a, b):
        dot = sum(a[w] * b[w] * idf[w] ** 2 for w in a if w in b)
        na = math.sqrt(sum((a[w] * idf[w]) ** 2 for w in a))
        nb = math.sqrt(sum((b[w] * idf[w]) ** 2 for w in b))
        return dot / (na * nb) if na * nb > 0 else 0.0

    link = np.array([[cosine(a, b) > ops.EDGE_THRESHOLD for b in tf] for a in tf], dtype=float)
    degree = np.maximum(link.sum(axis=1), 1)
    rank, change = np.full(n, 1 / n), 1.0
    while change > ops.TOLERANCE:
        new = (link / degree[:, None]).T @ rank
        change, rank = np.linalg.norm(new - rank), new
    return sorted(np.argsort(-np.round(rank, 12), kind="stable")[:keep].tolist())


def corpus(spark, folder, n=60):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("text IS NOT NULL").orderBy("doc_id").limit(n)
    return docs.select(F.col("doc_id").alias("article_index"), F.col("text").alias("article"))


@pytest.mark.parametrize("cells", [4_000_000, 300])
def test_ranking_equals_the_pairwise_definition(monkeypatch, cells):
    monkeypatch.setattr(ops, "BLOCK_CELLS", cells)
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(40)]
    for n in (6, 9, 25, 60):
        terms = [list(rng.choice(words, rng.integers(0, 12))) for _ in range(n)]
        assert ops._central_sentences(terms, 5) == brute_force_central(terms, 5)


def test_summary_of_documents_equals_brute_force(spark, folder):
    articles = corpus(spark, folder)
    got = {r.article_index: r.summary for r in ops.summarise(articles).collect()}
    parts = articles.select("article_index", "article", cols.sentences("article").alias("s")).collect()
    assert len(got) == len(parts)
    equal = 0
    for row in parts:
        summary = got[row.article_index]
        if len(row.article.strip()) < ops.MIN_TEXT:
            assert summary == re.sub(r"\s+", " ", row.article).strip()
            equal += 1
            continue
        lines = [re.sub(r"\s+", " ", s).strip() for s in row.s]
        terms = [[w for w in re.findall(r"[^\W\d_]+", s.lower()) if w not in ops.STOP_WORDS] for s in row.s]
        want = " ".join(lines[k] for k in brute_force_central(terms, 5))
        equal += summary == want
    assert equal == len(parts)


def test_short_and_missing_texts(spark):
    rows = [(1, None), (2, "  short\ntext "), (3, ". " * 80), (4, "x" * 120)]
    df = spark.createDataFrame(rows, "article_index bigint, article string")
    got = {r.article_index: r.summary for r in ops.summarise(df).collect()}
    assert got[1] == "" and got[2] == "short text" and got[4] == "x" * 120
    assert got[3] != ""


def test_sentence_sampling(spark):
    text = " ".join(f"Line {k}." for k in range(10))
    df = spark.createDataFrame([(text,), ("One. Two.",)], "t string").withColumn("s", cols.sentences("t"))
    picks = {
        "first": [0, 1, 2],
        "last": [7, 8, 9],
        "uniform": [0, 3, 6],
        "headtail": [0, 8, 9],
        "other": [0, 1, 2],
    }
    for method, want in picks.items():
        rows = df.select(cols.sample_sentences("s", 3, method).alias("x")).collect()
        assert rows[0].x == [f"Line {k}." for k in want]
        assert rows[1].x == ["One.", "Two."]
    assert len(df.select(cols.sample_sentences("s", 0).alias("x")).first().x) == 10


def test_lexicon_polarity(spark):
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -2.0)], "word string, weight double")
    rows = [(1, "Good good day. Bad day. Nothing here. 123."), (2, "   "), (3, None)]
    articles = spark.createDataFrame(rows, "article_index bigint, summary string")
    table = ops.sentence_table(articles)
    got = {(r.article_index, r.sentence_no): (r.label, round(r.weight, 6)) for r in ops.score_by_lexicon(table, lexicon).collect()}
    assert got == {
        (1, 0): ("positive", round(2 / 3, 6)),
        (1, 1): ("negative", round(-2 / 3, 6)),
        (1, 2): ("neutral", 0.0),
        (1, 3): ("neutral", 0.0),
    }
    means = {r.article_index: (r.sentiment, r.num_sentences) for r in senti.article_sentiment(articles, ops.score_by_lexicon(table, lexicon)).collect()}
    assert means[2] == (0.0, 0) and means[3] == (0.0, 0) and means[1][1] == 4


def test_failing_scorer_counts_as_neutral(spark):
    def broken(texts):
        raise RuntimeError("no model")

    table = ops.sentence_table(spark.createDataFrame([(1, "A b. C d.")], "article_index bigint, summary string"))
    assert {(r.label, r.weight) for r in ops.score_with(table, broken).collect()} == {("neutral", 0.0)}


def test_ticker_text(spark):
    df = spark.createDataFrame([(" aapl, ,MSFT,",), ("",)], "t string")
    assert [r.x for r in df.select(cols.tickers_from_text("t").alias("x")).collect()] == [["AAPL", "MSFT"], []]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2020-03-08 10:30:00 UTC", "2020-03-08", "2020-03-08T10:30:00Z", "2020-03-08 10:30:00", "2020-03-08 10:30:00+02:00", "later", None]
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        ts = cols.utc_timestamp("t")
        rows = df.select("k", ts.cast("string").alias("s"), cols.new_york_hour(ts).alias("h"), cols.instant_date(cols.as_instant(ts)).cast("string").alias("d")).orderBy("k").collect()
        assert [r.s for r in rows] == [
            "2020-03-08 10:30:00", "2020-03-08 00:00:00", "2020-03-08 10:30:00", "2020-03-08 10:30:00", "2020-03-08 08:30:00", None, None,
        ]
        assert [r.h for r in rows][:2] == [6, 19]
        assert {r.d for r in rows} == {"2020-03-08", None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_one_failing_text_does_not_touch_the_others(spark):
    def scorer(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[0.8, 0.1, 0.1] for _ in texts]

    table = spark.createDataFrame([(1, 0, "good"), (1, 1, "bad"), (2, 0, "fine")], "article_index bigint, sentence_no int, sentence string")
    got = {r.sentence_no + 10 * r.article_index: (r.label, r.failed) for r in ops.score_with(table.coalesce(1), scorer).collect()}
    assert got == {10: ("positive", False), 11: ("neutral", True), 20: ("positive", False)}


def test_lexicon_words_keep_their_accents(spark):
    table = spark.createDataFrame([(1, 0, "Un été au café")], "article_index bigint, sentence_no int, sentence string")
    lexicon = spark.createDataFrame([("été", 1.0), ("caf", -1.0), ("t", -1.0)], "word string, weight double")
    assert ops.score_by_lexicon(table, lexicon).first().weight == 0.5


def test_a_text_of_many_sentences_keeps_to_its_memory(monkeypatch):
    """All pairs of 700 linked sentences would take 8 MB as index pairs; a block takes 160 kB."""
    monkeypatch.setattr(ops, "BLOCK_CELLS", 20_000)
    terms = [["all", f"w{k % 3}"] for k in range(700)] + [["y"]] * 3
    tracemalloc.start()
    assert len(ops._central_sentences(terms, 5)) == 5
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 4e6


def test_texts_of_one_partition_are_ranked_by_many_tasks(spark, folder):
    """A file may hold all texts in one row group; stop words are looked up by hash."""
    out = ops.summarise(corpus(spark, folder).coalesce(1), stem=True)
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert "array_contains" not in out._jdf.queryExecution().optimizedPlan().toString()
