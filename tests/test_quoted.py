import random

import pytest
from pyspark.sql import functions as F

from tickertide.sources import quoted, readers

PIECES = ["a", "é", ",", '"', "\n", " ", "\r\n", "b c", "\n\n", '""', "'"]


def field(text):
    """A field as the common rule writes it."""
    if text is None:
        return ""
    return '"' + text.replace('"', '""') + '"' if text == "" or any(c in text for c in '",\n\r') else text


def write(path, rows, end="\n"):
    text = end.join(",".join(field(v) for v in row) for row in [("n", "Some: text", "more"), *rows]) + end
    path.write_bytes(text.encode())


def random_rows(seed, n):
    draw = random.Random(seed)
    text = lambda: None if draw.random() < 0.1 else "".join(draw.choice(PIECES) for _ in range(draw.randrange(9))).strip(" ")
    return [(f"r{i}", text(), text()) for i in range(n)]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "1200b", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_same_rows_as_one_task_per_file(spark, tmp_path, small_splits, seed, end):
    folder = tmp_path / "of two files"
    folder.mkdir()
    parts = {"b x.csv": random_rows(seed, 120), "a%20.csv": random_rows(seed + 10, 40)}
    for name, rows in parts.items():
        write(folder / name, rows, end)
    path = str(folder)
    assert spark.read.text(path).rdd.getNumPartitions() >= 3
    got = quoted.read_quoted_csv(spark, path)
    assert got.columns == ["_file", "_record", "n", "Some: text", "more"]
    rows = [tuple(r) for r in got.orderBy("_file", "_record").drop("_file", "_record").collect()]
    whole = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    # In a file with line ends of two characters the whole-file reader shortens those inside texts, too.
    short = [tuple(v and v.replace("\r\n", "\n") if end == "\r\n" else v for v in row) for row in rows]
    assert sorted(short, key=repr) == sorted((tuple(r) for r in whole.collect()), key=repr)
    no_empty = [tuple(v or None for v in row) for row in rows]
    assert no_empty == [tuple(v or None for v in row) for row in parts["a%20.csv"] + parts["b x.csv"]]


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    long = 'said "x",\n' * 500
    write(tmp_path / "a.csv", [("1", long, "end"), ("2", "short", None), ("3", "", "x")])
    rows = quoted.read_quoted_csv(spark, str(tmp_path)).orderBy("_record").collect()
    assert [(r["n"], r["Some: text"], r["more"]) for r in rows] == [("1", long, "end"), ("2", "short", None), ("3", None, "x")]


def test_blank_lines_short_rows_and_files_without_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n\n1,x\n\n\n2\n")
    (tmp_path / "b.csv").write_text("n,t\n")
    (tmp_path / "c.csv").write_text("")
    rows = quoted.read_quoted_csv(spark, str(tmp_path)).orderBy("_record").collect()
    assert [(r.n, r.t) for r in rows] == [("1", "x"), ("2", None)]


def test_quotes_that_do_not_match_run_to_the_end_of_their_file(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('n,t\n1,x\n2,"open\n3,y\n')
    write(tmp_path / "b.csv", [("4", "z", None)])
    records = quoted.quoted_records(spark, str(tmp_path)).withColumn("file", F.regexp_extract("file", "[^/]*$", 0))
    texts = {(r.file, r.record): r.text for r in records.collect()}
    assert texts[("a.csv", 3)] == '2,"open\n3,y' and texts[("b.csv", 2)] == "4,z,"


def test_one_raw_news_file_is_read_by_several_tasks(spark, tmp_path, small_splits):
    names = ["Unnamed: 0", "Date", "Article_title", "Stock_symbol", "Url", "Article"]
    rows = [(str(i), f"2020-01-01 {i}", f"t{i}", "ab", f"u{i}", 'he said "no",\nthen left\n' * (i % 5)) for i in range(100)]
    text = "\n".join(",".join(map(field, row)) for row in [names, *rows]) + "\n"
    (tmp_path / "news.csv").write_text(text)
    news = readers.read_raw_news(spark, str(tmp_path / "news.csv"))
    assert [(r.url, r.article) for r in news.orderBy("rn").collect()] == [(row[4], row[5] or None) for row in rows]
    assert spark.read.text(str(tmp_path / "news.csv")).rdd.getNumPartitions() >= 3
