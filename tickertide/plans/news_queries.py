"""Queries over news: collapse to URLs, enrichment, coverage, market days."""

from pyspark.sql import functions as F

from tickertide import schemas
from tickertide.functions import columns as cols
from tickertide.operators import calendar as days
from tickertide.operators import news as ops
from tickertide.plans import fixtures as fx
from tickertide.plans.registry import i, query, r, s
from tickertide.session import shared_dir
from tickertide.sources import readers, writers

Y1, Y2 = fx.NEWS_FIRST, fx.NEWS_LAST
STOP = "[" + ", ".join(f"'{w}'" for w in ops.TITLE_STOP_WORDS) + "]"
MINIMUM = 20

_YEAR = (
    "coalesce(TRY_CAST(substr(date_raw, 1, 4) AS INTEGER), "
    "year(TRY_CAST(replace(date_raw, ' UTC', '') AS TIMESTAMP)))"
)
fx.CTES["fx_news_years"] = f"SELECT * FROM fx_news WHERE {_YEAR} BETWEEN {Y1} AND {Y2}"
fx.CTES["fx_urls"] = (
    "SELECT *, CASE WHEN article_rn IS NOT NULL THEN "
    "row_number() OVER (PARTITION BY article_rn IS NULL ORDER BY article_rn) - 1 END AS article_index FROM ("
    "SELECT md5(url) AS url_hash, min(url) AS url, arg_min(title, rn) AS title, arg_min(date_raw, rn) AS date_raw, "
    "coalesce(list_sort(list(DISTINCT upper(trim(stock_symbol))) FILTER (trim(stock_symbol) <> '')), []) AS tickers, "
    "min(rn) FILTER (article IS NOT NULL) AS article_rn, count(*) AS n_rows FROM fx_news_years "
    "WHERE url IS NOT NULL GROUP BY 1)"
)
_FOUND = "regexp_extract_all(title, '\\b[A-Z]{2,5}\\b')"
_MINED = (
    f"list_distinct(list_filter({_FOUND}, lambda t: NOT list_contains({STOP}, t) AND NOT list_contains(tickers, t) "
    "AND list_contains(known, t)))"
)
fx.CTES["fx_enriched"] = (
    "SELECT * EXCLUDE (tickers, mined, known), list_sort(list_concat(tickers, mined)) AS tickers, len(mined) AS n_added "
    f"FROM (SELECT *, {_MINED} AS mined FROM fx_urls, (SELECT list(DISTINCT ticker) AS known FROM fx_bars))"
)
fx.CTES["fx_pruned"] = (
    "SELECT * FROM fx_enriched WHERE article_index IS NOT NULL AND "
    "list_has_any(tickers, (SELECT list(DISTINCT ticker) FROM fx_bars WHERE ticker <> 'EURO'))"
)
fx.CTES["fx_dated"] = (
    "SELECT *, TRY_CAST(replace(date_raw, ' UTC', '') AS TIMESTAMP) AS ts, "
    "CAST(TRY_CAST(replace(date_raw, ' UTC', '') AS TIMESTAMP) AS DATE) AS date FROM fx_pruned"
)
fx.CTES["fx_flagged"] = (
    "SELECT *, coalesce(date IN (SELECT date FROM fx_calendar) AND "
    "hour(timezone('America/New_York', timezone('UTC', ts))) >= 16, false) AS posted_after_close FROM fx_dated "
    "WHERE date IS NULL OR date <= (SELECT max(date) FROM fx_calendar)"
)
fx.CTES["fx_mentions"] = (
    "SELECT ticker, TRY_CAST(substr(date_raw, 1, 4) AS INTEGER) AS year FROM "
    "(SELECT date_raw, unnest(tickers) AS ticker FROM fx_pruned) WHERE year IS NOT NULL"
)
fx.CTES["fx_counts"] = "SELECT ticker, year, count(*) AS n_articles FROM fx_mentions GROUP BY 1, 2"
fx.CTES["fx_assigned"] = (
    "SELECT d.*, (SELECT max(c.date) FROM fx_calendar c WHERE c.date <= "
    "greatest(d.date, (SELECT min(date) FROM fx_calendar))) AS market_day FROM fx_dated d "
    "WHERE d.date IS NOT NULL AND d.date <= (SELECT max(date) FROM fx_calendar)"
)

URL_COLS = "url_hash, url, title, date_raw, array_to_string(tickers, ',') AS tickers, article_index"


def news_years(spark, folder):
    return ops.in_years(fx.news_raw(spark, folder), Y1, Y2)


def urls(spark, folder):
    return ops.number_articles(ops.collapse_urls(news_years(spark, folder)))


def valid(spark, folder):
    return ops.valid_tickers(fx.bars(spark, folder))


def enriched(spark, folder):
    return ops.enrich_from_titles(urls(spark, folder), valid(spark, folder))


def pruned(spark, folder):
    return ops.prune_urls(enriched(spark, folder), valid(spark, folder).filter("ticker <> 'euro'"))


def dated(spark, folder):
    return ops.parse_dates(pruned(spark, folder))


def flagged(spark, folder):
    calendar = fx.calendar(spark, folder)
    return days.flag_after_close(days.drop_after_calendar(dated(spark, folder), calendar), calendar)


def counts(spark, folder):
    return ops.yearly_counts(pruned(spark, folder))


def assigned(spark, folder):
    return days.assign_market_day(ops.dated_tickers(pruned(spark, folder)), fx.calendar(spark, folder))


def raw_news(spark, folder):
    """News written as the raw file has it, without row numbers, and scanned again."""
    path = shared_dir(spark, "news-raw")
    old = {new: name for name, new in readers.NEWS_NAMES.items()}
    rows = fx.news_raw(spark, folder).orderBy("rn").drop("rn").withColumnsRenamed(old)
    rows.withColumns({c: F.lit("x") for c in readers.NEWS_DROPPED}).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    return readers.read_raw_news(spark, path)


def url_columns(df):
    return df.select("url_hash", "url", "title", "date_raw", "tickers", "article_index")


@query("news_csv_scan__a3", "SELECT rn, url, date_raw, stock_symbol, title, md5(article) AS article_md5 FROM fx_news")
def _(spark, folder):
    path = shared_dir(spark, "news-csv")
    unused = {c: F.lit("x") for c in readers.NEWS_DROPPED}
    fx.news_raw(spark, folder).withColumns(unused).write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    news = readers.read_news_csv(spark, path)
    return news.select(
        F.col("rn").cast("bigint").alias("rn"), "url", "date_raw", "stock_symbol", "title",
        F.md5("article").alias("article_md5"),
    )


@query("filtered_news_sink__a4_b8", "SELECT rn, url, date_raw FROM fx_news_years")
def _(spark, folder):
    path = shared_dir(spark, "news-filtered")
    stored = writers.load_or_build(spark, path, lambda: news_years(spark, folder))
    reused = writers.load_or_build(spark, path, lambda: stored.limit(0))
    return reused.select("rn", "url", "date_raw")


@query("url_json_sink__a5", f"SELECT {URL_COLS} FROM fx_urls")
def _(spark, folder):
    path = shared_dir(spark, "urls-json")
    writers.write_url_json(urls(spark, folder), path)
    return url_columns(writers.read_url_json(spark, path, schemas.NEWS_META))


@query("metadata_csv_sink__a6_h10",
       "SELECT url_hash, array_to_string(tickers, ',') AS tickers, article_index FROM fx_enriched "
       "WHERE article_index IS NOT NULL AND len(tickers) > 0")
def _(spark, folder):
    path = shared_dir(spark, "metadata-csv")
    rows = enriched(spark, folder).filter(F.size("tickers") > 0).select("url_hash", "tickers", "article_index")
    writers.write_metadata_csv(rows, path)
    return writers.read_metadata_csv(spark, path, "url_hash STRING, tickers STRING, article_index BIGINT")


@query("article_sink__a7_c4",
       "SELECT article_index, p.url, md5(article) AS article_md5 FROM fx_pruned p JOIN fx_news n ON n.rn = p.article_rn")
def _(spark, folder):
    path = shared_dir(spark, "articles")
    numbered = urls(spark, folder)
    articles = ops.articles_of(news_years(spark, folder), numbered)
    ops.keep_articles(articles, pruned(spark, folder)).write.parquet(path)
    return spark.read.parquet(path).select("article_index", "url", F.md5("article").alias("article_md5"))


@query("summaries_scan__a8_a9", "SELECT article_index, num_sentences FROM fx_scores WHERE article_index IN "
       "(SELECT article_index FROM fx_pruned)")
def _(spark, folder):
    path = shared_dir(spark, "summaries")
    writers.write_sorted(fx.article_scores(spark, folder), path, "article_index")
    stored = readers.summaries(spark.read.parquet(path), pruned(spark, folder))
    return stored.select("article_index", "num_sentences")


@query("allowed_tickers__a19", "SELECT DISTINCT upper(trim(ticker)) AS ticker FROM fx_counts")
def _(spark, folder):
    return ops.allowed_tickers(counts(spark, folder))


@query("metadata_dates__a20", f"SELECT url_hash, {s('date')} AS date, array_to_string(tickers, ',') AS tickers "
       "FROM fx_dated WHERE date IS NOT NULL")
def _(spark, folder):
    return ops.dated_tickers(pruned(spark, folder))


@query("calendar_scan__a16", f"SELECT {s('date')} AS date FROM fx_calendar")
def _(spark, folder):
    path = shared_dir(spark, "calendar-csv")
    stamp = F.concat(F.col("date").cast("string"), F.lit(" 00:00:00")).alias("date")
    broken = spark.range(1).select(F.lit("no day").alias("date"))
    fx.calendar(spark, folder).select(stamp).unionByName(broken).write.option("header", True).csv(path)
    return readers.read_calendar_csv(spark, path).orderBy("date")


@query("news_year_filter__b8", "SELECT rn, date_raw FROM fx_news_years")
def _(spark, folder):
    return news_years(spark, folder).select("rn", "date_raw")


@query("news_with_url__b9", "SELECT rn, url FROM fx_news WHERE url IS NOT NULL")
def _(spark, folder):
    return ops.with_url(fx.news_raw(spark, folder)).select("rn", "url")


@query("row_ordinals__d5", "SELECT rn, row_number() OVER (ORDER BY rn) AS row_no FROM fx_news WHERE url IS NOT NULL")
def _(spark, folder):
    return ops.row_ordinals(fx.news_raw(spark, folder), rows_per_bucket=64).select("rn", "row_no")


@query("url_row_segments__d5",
       "SELECT md5(url) AS url_hash, (row_no - 1) // 100 AS segment, "
       "array_to_string(list(row_no ORDER BY row_no), ',') AS row_ids FROM (SELECT url, "
       "row_number() OVER (ORDER BY rn) AS row_no FROM fx_news WHERE url IS NOT NULL) GROUP BY 1, 2")
def _(spark, folder):
    return ops.url_row_segments(fx.news_raw(spark, folder), rows_per_segment=100)


@query("collapsed_urls__d5_h3",
       "SELECT url_hash, url, title, date_raw, array_to_string(tickers, ',') AS tickers, article_rn, n_rows FROM fx_urls")
def _(spark, folder):
    out = ops.collapse_urls(news_years(spark, folder))
    return out.select("url_hash", "url", "title", "date_raw", "tickers", "article_rn", "n_rows")


@query("article_numbers__d6", "SELECT url_hash, article_index FROM fx_urls")
def _(spark, folder):
    return urls(spark, folder).select("url_hash", "article_index")


@query("title_tickers__h1", f"SELECT {URL_COLS}, n_added FROM fx_enriched")
def _(spark, folder):
    return enriched(spark, folder).select("url_hash", "url", "title", "date_raw", "tickers", "article_index", "n_added")


@query("title_ticker_counts__h1", f"SELECT count(*) FILTER (n_added > 0) AS urls_enriched, {i('sum(n_added)')} "
       "AS tickers_added FROM fx_enriched")
def _(spark, folder):
    return ops.enrichment_counts(enriched(spark, folder))


@query("pruned_urls__h2", f"SELECT {URL_COLS} FROM fx_pruned")
def _(spark, folder):
    return url_columns(pruned(spark, folder))


@query("kept_articles__c4", "SELECT article_index, url FROM fx_urls WHERE article_index IN "
       "(SELECT article_index FROM fx_pruned)")
def _(spark, folder):
    articles = ops.articles_of(news_years(spark, folder), urls(spark, folder))
    return ops.keep_articles(articles, pruned(spark, folder)).select("article_index", "url")


@query("dropped_articles__c5", "SELECT article_index, url FROM fx_urls WHERE article_index IS NOT NULL AND "
       "article_index NOT IN (SELECT article_index FROM fx_dated WHERE date > (SELECT max(date) FROM fx_calendar))")
def _(spark, folder):
    articles = ops.articles_of(news_years(spark, folder), urls(spark, folder))
    gone = days.after_calendar(dated(spark, folder), fx.calendar(spark, folder))
    return ops.drop_articles(articles, gone).select("article_index", "url")


@query("allowed_ticker_lists__c8", "SELECT url_hash, array_to_string(kept, ',') AS tickers FROM (SELECT url_hash, "
       "list_filter(tickers, lambda t: list_contains(allowed, t)) AS kept FROM fx_pruned, "
       "(SELECT list(symbol) AS allowed FROM fx_universe)) WHERE len(kept) > 0")
def _(spark, folder):
    allowed = fx.universe(spark, folder).withColumnRenamed("symbol", "ticker")
    return ops.restrict_tickers(pruned(spark, folder), allowed).select("url_hash", "tickers")


@query("no_allowed_tickers__c8", "SELECT url_hash, array_to_string(tickers, ',') AS tickers FROM fx_pruned")
def _(spark, folder):
    nobody = fx.universe(spark, folder).withColumnRenamed("symbol", "ticker").filter("ticker = 'none'")
    return ops.restrict_tickers(pruned(spark, folder), nobody).select("url_hash", "tickers")


@query("url_prefix__b10", "SELECT url_hash, CASE WHEN starts_with(url, 'https://www.example.com') "
       "THEN substr(url, 24) ELSE url END AS url FROM fx_urls")
def _(spark, folder):
    return ops.strip_url_prefix(urls(spark, folder), fx.URL_PREFIX).select("url_hash", "url")


@query("within_calendar__b11", f"SELECT url_hash, {s('date')} AS date FROM fx_flagged")
def _(spark, folder):
    return days.drop_after_calendar(dated(spark, folder), fx.calendar(spark, folder)).select("url_hash", "date")


@query("after_close_flag__b12", "SELECT url_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, "
       "CAST(posted_after_close AS BIGINT) AS posted_after_close FROM fx_flagged")
def _(spark, folder):
    return flagged(spark, folder).select("url_hash", "ts", "posted_after_close")


@query("close_share__d11", "SELECT count(*) AS n_urls, count(*) FILTER (NOT posted_after_close) AS n_before, "
       "count(*) FILTER (posted_after_close) AS n_after, "
       + r("count(*) FILTER (posted_after_close) * 100.0e0 / count(*)") + " AS pct_after FROM fx_flagged")
def _(spark, folder):
    return days.close_share(flagged(spark, folder))


@query("target_articles__b13", "SELECT article_index, num_sentences FROM fx_scores WHERE num_sentences > 1 AND "
       "article_index IN (SELECT article_index FROM fx_pruned WHERE list_has_any(tickers, ['AFRI', 'ASIA']))")
def _(spark, folder):
    texts = fx.article_scores(spark, folder).withColumn(
        "summary", F.when(F.col("num_sentences") > 1, "text").otherwise("  ")
    )
    targets = fx.universe(spark, folder).withColumnRenamed("symbol", "ticker").filter("ticker IN ('AFRI', 'ASIA')")
    out = ops.articles_for_targets(pruned(spark, folder), texts, targets)
    return out.select("article_index", "num_sentences")


@query("all_articles__b13", "SELECT article_index, num_sentences FROM fx_scores WHERE article_index IN "
       "(SELECT article_index FROM fx_pruned)")
def _(spark, folder):
    texts = fx.article_scores(spark, folder).withColumn("summary", F.lit("text"))
    return ops.articles_for_targets(pruned(spark, folder), texts).select("article_index", "num_sentences")


@query("yearly_counts__d7", "SELECT ticker, year, n_articles FROM fx_counts")
def _(spark, folder):
    return counts(spark, folder)


@query("yearly_count_maps__a5_d7", "SELECT ticker, string_agg(year || ':' || n_articles, ',' ORDER BY year) AS years "
       "FROM fx_counts GROUP BY 1")
def _(spark, folder):
    text = F.transform(F.map_entries("years"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return writers.yearly_map(counts(spark, folder)).select("ticker", text.alias("years"))


@query("covered_tickers__d8", f"SELECT ticker FROM fx_counts WHERE year BETWEEN {Y1} AND {Y2 - 1} AND n_articles >= {MINIMUM} "
       f"GROUP BY 1 HAVING count(*) = {Y2 - Y1}")
def _(spark, folder):
    return ops.covered_tickers(counts(spark, folder), Y1, Y2 - 1, MINIMUM)


@query("top_tickers__d9_d10_d18", f"SELECT ticker, {i('sum(n_articles)')} AS total FROM fx_counts GROUP BY 1 "
       "ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, folder):
    return ops.top_tickers(counts(spark, folder), 10)


@query("top_suppliers__d10_d18", f"SELECT ticker, {i('sum(n_articles)')} AS total FROM fx_ssent GROUP BY 1 "
       "ORDER BY 2 DESC, 1 LIMIT 50")
def _(spark, folder):
    return ops.top_tickers(fx.supplier_sentiment(spark, folder), 50)


@query("news_per_year__d19", f"SELECT year, {i('sum(n_articles)')} AS total FROM fx_counts WHERE lower(ticker) IN "
       "(SELECT lower(symbol) FROM fx_universe) GROUP BY 1")
def _(spark, folder):
    priced = fx.universe(spark, folder).withColumnRenamed("symbol", "ticker")
    return ops.counts_per_year(counts(spark, folder), priced)


_CELLS = {y: f"sum(CASE WHEN year = {y} THEN n_articles ELSE 0 END)" for y in range(1995, 2002)}
fx.CTES["fx_every_year"] = (
    "SELECT ticker, " + ", ".join(f"{i(c)} AS y{y}" for y, c in _CELLS.items()) + ", "
    + i(" + ".join(_CELLS.values())) + " AS total FROM (SELECT ticker, year(date) AS year, n_articles FROM fx_ssent) "
    "GROUP BY ticker HAVING " + " AND ".join(f"{c} > 0" for c in _CELLS.values())
)


def supplier_year_counts(spark, folder):
    daily = fx.supplier_sentiment(spark, folder)
    return daily.groupBy("ticker", F.year("date").alias("year")).agg(F.sum("n_articles").alias("n_articles"))


@query("every_year_table__d20", "SELECT * FROM fx_every_year ORDER BY total DESC, ticker")
def _(spark, folder):
    return ops.every_year_table(supplier_year_counts(spark, folder), range(1995, 2002))


@query("total_histogram__d21", "SELECT CAST(b.bin AS BIGINT) AS bin, count(x.total) AS n FROM range(30) b(bin) LEFT JOIN "
       "(SELECT total, least(floor((total - lo) / nullif((hi - lo) / 30.0e0, 0)), 29) AS bin FROM (SELECT total, "
       "CAST(min(total) OVER () AS DOUBLE) AS lo, CAST(max(total) OVER () AS DOUBLE) AS hi FROM fx_every_year)) x "
       "ON x.bin = b.bin GROUP BY 1")
def _(spark, folder):
    wide = ops.every_year_table(supplier_year_counts(spark, folder), range(1995, 2002))
    return ops.histogram(wide, "total", 30)


@query("market_days__c7", f"SELECT url_hash, {s('date')} AS date, {s('market_day')} AS market_day FROM fx_assigned")
def _(spark, folder):
    return assigned(spark, folder).select("url_hash", "date", "market_day")


@query("bar_market_days__c7", f"SELECT {s('market_day')} AS market_day, count(*) AS n FROM (SELECT b.date, "
       "(SELECT max(c.date) FROM fx_calendar c WHERE c.date <= greatest(b.date, (SELECT min(date) FROM fx_calendar))) "
       "AS market_day FROM (SELECT date FROM fx_sbars) b WHERE b.date <= (SELECT max(date) FROM fx_calendar)) GROUP BY 1")
def _(spark, folder):
    bars = fx.supplier_bars(spark, folder).select("date")
    out = days.assign_market_day(bars, fx.calendar(spark, folder))
    return out.groupBy("market_day").agg(F.count("*").alias("n"))


@query("unassigned_days__c7", "SELECT count(*) FILTER (date <= (SELECT max(date) FROM fx_calendar)) AS n_assigned, "
       "count(*) FILTER (date > (SELECT max(date) FROM fx_calendar)) AS n_dropped FROM fx_dated")
def _(spark, folder):
    return days.count_unassigned(dated(spark, folder), fx.calendar(spark, folder))


_PER_DAY = ("SELECT c.date, count(a.url_hash) AS n FROM fx_calendar c LEFT JOIN fx_assigned a ON a.market_day = c.date "
            "GROUP BY 1")


@query("articles_per_day__d15", f"SELECT {s('date')} AS date, n FROM ({_PER_DAY})")
def _(spark, folder):
    return days.articles_per_day(assigned(spark, folder), fx.calendar(spark, folder))


@query("busiest_days__d16", f"SELECT {s('date')} AS date, n FROM ({_PER_DAY} ORDER BY n DESC, date LIMIT 10)")
def _(spark, folder):
    return days.busiest_days(days.articles_per_day(assigned(spark, folder), fx.calendar(spark, folder)))


_WIDE = ["AFRI", "AMER", "ASIA", "EURO", "MIDD"]


@query("ticker_day_table__d17", f"SELECT {s('c.date')} AS date, "
       + ", ".join(f"count(*) FILTER (a.ticker = '{t}') AS {t}" for t in _WIDE)
       + " FROM fx_calendar c LEFT JOIN (SELECT market_day, unnest(tickers) AS ticker FROM fx_assigned) a "
       "ON a.market_day = c.date GROUP BY 1")
def _(spark, folder):
    counted = days.ticker_days(assigned(spark, folder))
    return days.wide_ticker_days(counted, fx.calendar(spark, folder), days.busiest_tickers(counted))


@query("ticker_set_operations__k4",
       "SELECT url_hash, array_to_string(list_sort(list_intersect(tickers, ['AFRI', 'ASIA', 'EURO'])), ',') AS shared, "
       "array_to_string(list_sort(list_filter(tickers, lambda t: NOT list_contains(['AFRI', 'ASIA', 'EURO'], t))), ',') AS other, "
       "array_to_string(list_sort(list_distinct(list_concat(tickers, ['AFRI', 'ASIA', 'EURO']))), ',') AS joined, "
       "CAST(list_has_any(tickers, ['AFRI', 'ASIA', 'EURO']) AS BIGINT) AS overlaps FROM fx_enriched")
def _(spark, folder):
    some = F.array(F.lit("AFRI"), F.lit("ASIA"), F.lit("EURO"))
    return enriched(spark, folder).select(
        "url_hash",
        F.array_sort(F.array_intersect("tickers", some)).alias("shared"),
        F.array_sort(F.array_except("tickers", some)).alias("other"),
        F.array_sort(F.array_union("tickers", some)).alias("joined"),
        F.arrays_overlap("tickers", some).alias("overlaps"),
    )


@query("ticker_table_sets__k4", "(SELECT ticker, 'both' AS side FROM fx_sent INTERSECT SELECT ticker, 'both' FROM fx_bars) "
       "UNION ALL SELECT ticker, 'unlisted' AS side FROM (SELECT ticker FROM fx_bars EXCEPT SELECT symbol FROM fx_universe)")
def _(spark, folder):
    bars = fx.bars(spark, folder).select("ticker")
    both = bars.intersect(fx.daily_sentiment(spark, folder).select("ticker"))
    unlisted = bars.subtract(fx.universe(spark, folder))
    return both.withColumn("side", F.lit("both")).unionByName(unlisted.withColumn("side", F.lit("unlisted")))


@query("report_formats__l",
       "SELECT ticker, printf('%.2f%%', 100.0e0 * total / (SELECT sum(n_articles) FROM fx_counts)) AS share, "
       "format('{:,}', total * 1000) AS scaled, json_object('ticker', ticker, 'total', total) AS record FROM "
       f"(SELECT ticker, {i('sum(n_articles)')} AS total FROM fx_counts GROUP BY 1)")
def _(spark, folder):
    totals = counts(spark, folder).groupBy("ticker").agg(F.sum("n_articles").alias("total"))
    everything = counts(spark, folder).agg(F.sum("n_articles")).scalar()
    return totals.select(
        "ticker",
        F.format_string("%.2f%%", F.col("total") * 100.0 / everything).alias("share"),
        F.format_number(F.col("total") * 1000, 0).alias("scaled"),
        F.to_json(F.struct("ticker", "total")).alias("record"),
    )


@query("ticker_text_round_trip__h10",
       "SELECT url_hash, array_to_string(tickers, ',') AS back FROM fx_enriched")
def _(spark, folder):
    text = F.concat(F.lower(cols.tickers_to_text("tickers")), F.lit(" , ,"))
    return enriched(spark, folder).select("url_hash", cols.tickers_from_text(text).alias("back"))
