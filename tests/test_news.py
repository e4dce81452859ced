import datetime as dt
import hashlib

from tickertide import schemas
from tickertide.operators import bars as bar_ops
from tickertide.operators import calendar as days
from tickertide.operators import news as ops


def news(spark, rows):
    return spark.createDataFrame(rows, schemas.NEWS_RAW)


def hot_news(spark, n=900):
    """A third of all rows share one URL and one ticker."""
    rows = []
    for rn in range(n):
        url = "http://hot" if rn % 3 == 0 else f"http://u{rn % 97}"
        rows.append((rn, url, f"20{18 + rn % 6}-05-01 12:00:00 UTC", " aapl" if rn % 2 else None, f"Title {rn} NVDA CEO", None if rn % 5 else f"text {rn}"))
    return news(spark, rows), rows


def test_hot_url_is_collapsed_whole(spark):
    df, rows = hot_news(spark)
    got = {r.url: r for r in ops.number_articles(ops.collapse_urls(df), rows_per_bucket=50).collect()}
    assert got["http://hot"].n_rows == 300 and got["http://hot"].title == "Title 0 NVDA CEO"
    assert got["http://hot"].url_hash == hashlib.md5(b"http://hot").hexdigest()
    firsts = {}
    for rn, url, *_rest, article in rows:
        if article is not None:
            firsts.setdefault(url, rn)
    order = {u: k for k, u in enumerate(sorted(firsts, key=firsts.get))}
    assert {u: r.article_index for u, r in got.items()} == {u: order.get(u) for u in got}
    assert got["http://hot"].tickers == ["AAPL"]


def test_row_segments_are_bounded_and_complete(spark):
    df, rows = hot_news(spark)
    segments = ops.url_row_segments(df, rows_per_segment=100).collect()
    assert max(len(r.row_ids) for r in segments) <= 100
    hot = hashlib.md5(b"http://hot").hexdigest()
    ids = sorted(k for r in segments if r.url_hash == hot for k in r.row_ids)
    assert ids == [rn + 1 for rn, url, *_ in rows if url == "http://hot"]


def test_enrichment_rules(spark):
    urls = spark.createDataFrame(
        [("a", "NVDA and the CEO of nvda, AAPL", ["AAPL"]), ("b", None, ["AAPL"]), ("c", "XYZ soars", [])],
        "url_hash string, title string, tickers array<string>",
    )
    valid = spark.createDataFrame([("nvda",), ("aapl",), ("ceo",)], "ticker string")
    got = {r.url_hash: (r.tickers, r.n_added) for r in ops.enrich_from_titles(urls, valid).collect()}
    assert got == {"a": (["AAPL", "NVDA"], 1), "b": (["AAPL"], 0), "c": ([], 0)}


def test_prune_and_restrict(spark):
    urls = spark.createDataFrame(
        [("a", ["AAPL", "zz"], 0), ("b", ["ZZ"], 1), ("c", ["AAPL"], None), ("d", [], 2)],
        "url_hash string, tickers array<string>, article_index bigint",
    )
    valid = spark.createDataFrame([("aapl",)], "ticker string")
    pruned = ops.prune_urls(urls, valid).collect()
    assert [(r.url_hash, r.tickers) for r in pruned] == [("a", ["AAPL", "ZZ"])]
    kept = ops.restrict_tickers(urls, spark.createDataFrame([("AAPL",)], "ticker string")).collect()
    assert {(r.url_hash, tuple(r.tickers)) for r in kept} == {("a", ("AAPL",)), ("c", ("AAPL",))}
    nobody = spark.createDataFrame([], "ticker string")
    assert {r.url_hash for r in ops.restrict_tickers(urls, nobody).collect()} == {"a", "b", "c"}


def test_empty_news_set_prunes_no_bars(spark):
    bars = spark.createDataFrame([("A",), ("B",)], "ticker string")
    assert bar_ops.prune_without_news(bars, spark.createDataFrame([], "ticker string")).count() == 2
    assert bar_ops.prune_without_news(bars, spark.createDataFrame([("a",)], "ticker string")).count() == 1


def test_after_close_rules(spark):
    calendar = spark.createDataFrame([(dt.date(2021, 1, 4),), (dt.date(2021, 1, 5),)], "date date")
    texts = {
        "open": "2021-01-04 15:00:00 UTC",  # 10:00 in New York
        "late": "2021-01-04 21:00:00 UTC",  # 16:00
        "midnight": "2021-01-05",  # 19:00 the day before
        "weekend": "2021-01-03 22:00:00 UTC",
        "broken": "unknown",
        "missing": None,
        "after": "2021-01-06 10:00:00 UTC",
    }
    urls = spark.createDataFrame([(k, v, ["A"]) for k, v in texts.items()], "url_hash string, date_raw string, tickers array<string>")
    dated = ops.parse_dates(urls)
    got = {r.url_hash: r.posted_after_close for r in days.flag_after_close(days.drop_after_calendar(dated, calendar), calendar).collect()}
    assert got == {"open": False, "late": True, "midnight": True, "weekend": False, "broken": False, "missing": False}
    assert [r.url_hash for r in days.after_calendar(dated, calendar).collect()] == ["after"]


def test_market_day_assignment_equals_bisect(spark):
    import bisect
    import random

    rng = random.Random(4)
    start = dt.date(2020, 1, 1)
    calendar = sorted({start + dt.timedelta(days=rng.randrange(20, 300)) for _ in range(120)})
    dates = [start + dt.timedelta(days=rng.randrange(0, 340)) for _ in range(400)]
    cal = spark.createDataFrame([(d,) for d in calendar], "date date")
    df = spark.createDataFrame(list(enumerate(dates)), "k int, date date")
    got = {r.k: r.market_day for r in days.assign_market_day(df, cal).collect()}
    want = {
        k: calendar[max(bisect.bisect_right(calendar, d) - 1, 0)] for k, d in enumerate(dates) if d <= calendar[-1]
    }
    assert got == want
    counts = days.count_unassigned(df, cal).first()
    assert counts.n_assigned == len(want) and counts.n_dropped == len(dates) - len(want)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 29, 30, 30)], "v double")
    got = {r.bin: r.n for r in ops.histogram(df, "v", 30).collect()}
    assert got[0] == 1 and got[1] == 1 and got[29] == 3 and len(got) == 30
    flat = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert {r.bin: r.n for r in ops.histogram(flat, "v", 3).collect()} == {0: 2, 1: 0, 2: 0}


def test_year_fallback(spark):
    rows = [(1, "u", "2019-01-01", None, None, None), (2, "u", "bad", None, None, None), (3, "u", "1 Jan", None, None, None), (4, "u", None, None, None, None)]
    assert [r.rn for r in ops.in_years(news(spark, rows), 2018, 2023).collect()] == [1]


def test_rejections_name_the_first_rule(spark):
    rows = []
    for ticker, n, first in (("GOOD", 20, 2018), ("FEW", 5, 2018), ("LATE", 20, 2019), ("OLD", 20, 2001), ("NONE", 20, 2018)):
        for k in range(n):
            rows.append((ticker, dt.date(first + k % 2, 1 + k % 12, 1 + k // 2), 1.0, 1.0, 1.0, 1.0, 1.0, 5))
    bars = spark.createDataFrame(rows, schemas.BARS)
    listed = spark.createDataFrame([(" good",), ("FEW",), ("late",), ("old",)], "symbol string")
    got = {r.ticker: r.reason for r in bar_ops.rejected_tickers(bars, listed, 2018, 2019).collect()}
    assert got == {
        "FEW": "insufficient data after cleaning",
        "LATE": "incomplete year coverage",
        "OLD": "no data in date range",
        "NONE": "not in universe",
    }
    assert {r.ticker for r in bar_ops.select_bars(bars, listed, 2018, 2019).select("ticker").distinct().collect()} == {"GOOD"}
