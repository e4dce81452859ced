"""Raw news rows to URLs with ticker lists, and the counts built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickertide.functions.columns import (
    leading_year,
    news_year,
    tickers_from_text,
    trim_space,
    url_key,
    utc_timestamp,
    without_prefix,
)
from tickertide.operators.series import running_total

# Words in capitals that are not tickers.
TITLE_STOP_WORDS = [
    "THE", "AND", "FOR", "ARE", "NOT", "BUT", "CAN", "ALL", "OUT", "NEW", "GET", "HAS", "HAD",
    "ITS", "ONE", "TWO", "MAY", "NOW", "SEE", "OWN", "SAY", "SHE", "TOO", "USE", "HER", "HIS",
    "HOW", "OUR", "WHY", "BIG", "TOP", "HOT", "WHO", "YES", "YOU", "WAS", "WAY", "WIN", "WON",
    "ETF", "CEO", "CFO", "IPO", "NYSE", "SEC", "FDA", "DOJ", "USA", "API", "APP", "GDP", "CPI",
    "FED",
]
# Fixed value: a run of two to five capitals.
TITLE_TICKER = r"(?U)\b[A-Z]{2,5}\b"
MIN_ARTICLES_PER_YEAR = 30
ROWS_PER_SEGMENT = 100_000


def in_years(news: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Rows whose date text gives a year in the range; unreadable years are dropped."""
    return news.filter(news_year("date_raw").between(first_year, last_year))


def with_url(news: DataFrame) -> DataFrame:
    return news.filter(F.col("url").isNotNull())


def row_ordinals(news: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``row_no``: 1-based position among the rows that have a URL, in ``rn`` order."""
    buckets = [F.floor(F.col("rn") / (rows_per_bucket * 1000)), F.floor(F.col("rn") / rows_per_bucket)]
    out = running_total(with_url(news), "rn", buckets, name="_before")
    return out.withColumn("row_no", (F.col("_before") + 1).cast("bigint")).drop("_before")


def collapse_urls(news: DataFrame) -> DataFrame:
    """One row per URL: first title and date, ticker set, and where its article is.

    Every aggregate combines before the shuffle, so a URL with very many rows arrives as one
    partial row per task. The set is bounded by the number of different tickers.
    """
    symbol = F.upper(trim_space("stock_symbol"))
    has_article = F.col("article").isNotNull()
    grouped = with_url(news).groupBy(url_key("url").alias("url_hash")).agg(
        F.min("url").alias("url"),
        F.min_by("title", "rn").alias("title"),
        F.min_by("date_raw", "rn").alias("date_raw"),
        F.collect_set(F.when(symbol != "", symbol)).alias("tickers"),
        F.min("rn").alias("first_rn"),
        F.min(F.when(has_article, F.col("rn"))).alias("article_rn"),
        F.count("*").alias("n_rows"),
    )
    return grouped.withColumn("tickers", F.array_sort("tickers"))


def number_articles(urls: DataFrame, rows_per_bucket: int = 1_000_000) -> DataFrame:
    """``article_index``: 0-based rank of the URLs with an article, by its first row; else null.

    Ranks come from counts per range of row numbers, so nothing is sorted in one task.
    """
    has = F.col("article_rn").isNotNull()
    # Row numbers belong to one URL each, so this key is unique.
    keyed = urls.withColumn("_key", F.coalesce("article_rn", "first_rn"))
    buckets = [F.floor(F.col("_key") / (rows_per_bucket * 1000)), F.floor(F.col("_key") / rows_per_bucket)]
    ranked = running_total(keyed, "_key", buckets, has.cast("bigint"), name="_rank")
    return ranked.withColumn("article_index", F.when(has, F.col("_rank").cast("bigint"))).drop("_key", "_rank")


def url_row_segments(news: DataFrame, rows_per_segment: int = ROWS_PER_SEGMENT) -> DataFrame:
    """Row numbers per URL as sorted arrays, one array per range of row numbers.

    A URL may own a large share of all rows; cutting its list by row range keeps each array at
    most ``rows_per_segment`` long and spreads the URL over many tasks. Nothing is left out.
    """
    segment = F.floor((F.col("row_no") - 1) / rows_per_segment).cast("bigint")
    return (
        row_ordinals(news)
        .groupBy(url_key("url").alias("url_hash"), segment.alias("segment"))
        .agg(F.array_sort(F.collect_list("row_no")).alias("row_ids"))
    )


def articles_of(news: DataFrame, numbered: DataFrame) -> DataFrame:
    """Article text per article index. Row numbers are unique, so the join cannot skew."""
    index = numbered.filter(F.col("article_index").isNotNull()).select("article_rn", "article_index")
    rows = news.select("rn", "url", "article")
    return rows.join(index, rows["rn"] == index["article_rn"]).select("article_index", "url", "article")


def valid_tickers(bars: DataFrame) -> DataFrame:
    return bars.select(F.lower("ticker").alias("ticker")).distinct()


def _look_up(urls: DataFrame, tickers: Column, names: DataFrame, name: str) -> DataFrame:
    """Add ``name``: the sorted members of a ticker array that occur in ``names``.

    Only pairs of URL key and ticker are looked up and folded; rows meet their list again by key. A
    ticker found in very many lists only costs in the join, whose small side is broadcast or whose
    hot partition is split by adaptive execution. ``url_hash`` is unique.
    """
    known = names.select(F.upper(F.trim("ticker")).alias("_ticker")).distinct()
    pairs = urls.select(F.col("url_hash").alias("_url"), F.explode(tickers).alias("_ticker"))
    lists = pairs.join(known, "_ticker", "left_semi").groupBy("_url").agg(F.array_sort(F.collect_set("_ticker")).alias(name))
    joined = urls.join(lists, F.col("url_hash") == F.col("_url"), "left").drop("_url")
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def enrich_from_titles(
    urls: DataFrame, valid: DataFrame, stop_words: Sequence[str] = tuple(TITLE_STOP_WORDS)
) -> DataFrame:
    """Add tickers found in titles: capitals, not a stop word, and known to have prices.

    Adds ``n_added``.
    """
    found = F.regexp_extract_all("title", F.lit(TITLE_TICKER), 0)
    stop = F.array(*[F.lit(w) for w in stop_words])
    fresh = F.array_except(F.array_except(F.array_distinct(found), stop), F.col("tickers"))
    mined = _look_up(urls, fresh, valid, "_mined")
    return mined.withColumns(
        {
            "tickers": F.array_sort(F.array_union("tickers", "_mined")),
            "n_added": F.size("_mined"),
        }
    ).drop("_mined")


def enrichment_counts(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count_if(F.col("n_added") > 0).alias("urls_enriched"),
        F.coalesce(F.sum("n_added"), F.lit(0)).alias("tickers_added"),
    )


def prune_urls(urls: DataFrame, valid: DataFrame) -> DataFrame:
    """URLs with an article and at least one ticker that has prices; the whole list is kept."""
    upper = F.array_sort(F.array_distinct(F.transform("tickers", lambda t: F.upper(F.trim(t)))))
    listed = urls.filter(F.col("article_index").isNotNull()).withColumn("tickers", upper)
    priced = _look_up(listed, F.col("tickers"), valid, "_priced")
    return priced.filter(F.size("_priced") > 0).drop("_priced")


def keep_articles(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """Articles of the given URLs."""
    keep = urls.filter(F.col("article_index").isNotNull()).select("article_index")
    return articles.join(keep, "article_index", "left_semi")


def drop_articles(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """Articles of no given URL."""
    gone = urls.filter(F.col("article_index").isNotNull()).select("article_index")
    return articles.join(gone, "article_index", "left_anti")


def restrict_tickers(urls: DataFrame, allowed: DataFrame) -> DataFrame:
    """Cut ticker lists to an allowed set; URLs left without a ticker go.

    An empty allowed set means no restriction.
    """
    unrestricted = allowed.agg((F.count("*") == 0).alias("none")).scalar()
    cut = _look_up(urls, F.col("tickers"), allowed, "_kept")
    kept = F.when(unrestricted, F.col("tickers")).otherwise(F.col("_kept"))
    return cut.withColumn("tickers", kept).drop("_kept").filter(F.size("tickers") > 0)


def strip_url_prefix(urls: DataFrame, prefix: str) -> DataFrame:
    return urls.withColumn("url", without_prefix("url", prefix))


def mentions(urls: DataFrame) -> DataFrame:
    """One row per URL and ticker with the year of the date text; both are required."""
    return (
        urls.select(F.explode("tickers").alias("ticker"), leading_year("date_raw").alias("year"))
        .withColumn("ticker", F.upper(trim_space("ticker")))
        .filter((F.col("ticker") != "") & F.col("year").isNotNull())
    )


def yearly_counts(urls: DataFrame) -> DataFrame:
    return mentions(urls).groupBy("ticker", "year").agg(F.count("*").alias("n_articles"))


def covered_tickers(
    counts: DataFrame, first_year: int, last_year: int, minimum: int = MIN_ARTICLES_PER_YEAR
) -> DataFrame:
    """Tickers with at least ``minimum`` articles in every year of the range."""
    good = F.col("year").between(first_year, last_year) & (F.col("n_articles") >= minimum)
    per_ticker = counts.groupBy("ticker").agg(F.count_if(good).alias("n_years"))
    return per_ticker.filter(F.col("n_years") == last_year - first_year + 1).select("ticker")


def allowed_tickers(stats: DataFrame) -> DataFrame:
    return stats.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()


def top_tickers(counts: DataFrame, k: int, measure: str = "n_articles") -> DataFrame:
    """The ``k`` tickers with the largest totals, ties by name."""
    totals = counts.groupBy("ticker").agg(F.sum(measure).alias("total"))
    return totals.orderBy(F.desc("total"), "ticker").limit(k)


def counts_per_year(counts: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Total news per year, optionally only of tickers that have prices."""
    if valid is not None:
        names = valid.select(F.lower("ticker").alias("_name")).distinct()
        counts = counts.join(names, F.lower(counts["ticker"]) == names["_name"], "left_semi")
    return counts.groupBy("year").agg(F.sum("n_articles").alias("total"))


def every_year_table(counts: DataFrame, years: Sequence[int]) -> DataFrame:
    """Wide table: one column per year and a total, for tickers with news in all of them."""
    cells = {f"y{y}": F.sum(F.when(F.col("year") == y, F.col("n_articles")).otherwise(0)) for y in years}
    wide = counts.groupBy("ticker").agg(*[v.alias(k) for k, v in cells.items()])
    names = list(cells)
    total: Column = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    full = wide.filter(F.least(*names) > 0) if len(names) > 1 else wide.filter(F.col(names[0]) > 0)
    return full.withColumn("total", total).orderBy(F.desc("total"), "ticker")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes; the largest value falls in the last bin.

    All bins are listed, also the empty ones.
    """
    ends = F.struct(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    bounds = df.agg(ends.alias("ends")).scalar()
    placed = df.select(F.col(column).cast("double").alias("_v"), bounds.alias("_e"))
    width = (F.col("_e.high") - F.col("_e.low")) / bins
    step = F.floor((F.col("_v") - F.col("_e.low")) / F.nullif(width, F.lit(0.0)))
    inside = F.when(width > 0, F.least(step, F.lit(bins - 1))).otherwise(0)
    placed = placed.select(inside.cast("int").alias("bin"))
    filled = placed.groupBy("bin").agg(F.count("*").alias("n"))
    axis = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return axis.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def articles_for_targets(
    urls: DataFrame, summaries: DataFrame, targets: DataFrame | None = None
) -> DataFrame:
    """Summaries to score: of URLs naming a target ticker (no targets = all), blanks dropped."""
    index = urls.filter(F.col("article_index").isNotNull())
    if targets is not None:
        names = targets.select(F.upper(F.trim("ticker")).alias("_ticker")).distinct()
        pairs = index.select("article_index", F.explode("tickers").alias("_ticker"))
        index = pairs.join(names, "_ticker", "left_semi").select("article_index").distinct()
    else:
        index = index.select("article_index")
    texts = summaries.filter(F.trim("summary") != "")
    return texts.join(index, "article_index", "left_semi")


def parse_dates(urls: DataFrame) -> DataFrame:
    """Add the UTC timestamp ``ts`` and date ``date`` of the date text."""
    return urls.withColumn("ts", utc_timestamp("date_raw")).withColumn("date", F.col("ts").cast("date"))


def dated_tickers(urls: DataFrame) -> DataFrame:
    """URL, UTC date and ticker list of the rows whose date can be read."""
    return parse_dates(urls).dropna(subset=["date"]).select("url_hash", "date", "tickers")


def tickers_column(df: DataFrame, column: str) -> DataFrame:
    """Turn a comma-separated text column into a ticker array."""
    return df.withColumn(column, tickers_from_text(column))
