"""Views over the driver tables that have the shape of the engine's own inputs.

Each one exists twice: as a DataFrame and as SQL text for the check (``CTES``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickertide.sources.readers import table

FIRST_YEAR, LAST_YEAR = 1995, 2001
NEWS_FIRST, NEWS_LAST = 1996, 2001
URL_PREFIX = "https://www.example.com"

# ---- Spark ---------------------------------------------------------------------


def _priced_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_suppkey",
        F.col("l_shipdate").cast("date").alias("date"),
        "l_quantity",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("ord"),
    )


def _daily_bars(lines: DataFrame) -> DataFrame:
    close = F.max_by("price", "ord")
    return lines.groupBy("ticker", "date").agg(
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        close.alias("close"),
        close.alias("adj_close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return named.select("n_nationkey", F.substring("r_name", 1, 4).alias("ticker"))


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per region: five tickers."""
    lines, regions = _priced_lines(spark, folder), _regions(spark, folder)
    supplier = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    homes = supplier.join(regions, supplier["s_nationkey"] == regions["n_nationkey"]).select("s_suppkey", "ticker")
    return _daily_bars(lines.join(homes, lines["l_suppkey"] == homes["s_suppkey"]))


def supplier_ticker(key: str):
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 9, "0"))


def supplier_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per supplier: the number of tickers grows with the tables."""
    return _daily_bars(_priced_lines(spark, folder).withColumn("ticker", supplier_ticker("l_suppkey")))


def _daily_scores(rows: DataFrame) -> DataFrame:
    # Integer sums, so the mean does not depend on the order of the rows.
    points = F.col("o_orderkey") * 31 % 201 - 100
    return rows.groupBy("ticker", "date").agg(
        (F.sum(points) / (F.lit(100.0) * F.count("*"))).alias("daily_sentiment"),
        F.count("*").alias("n_articles"),
    )


def daily_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    regions = _regions(spark, folder)
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    homes = customer.join(regions, customer["c_nationkey"] == regions["n_nationkey"]).select("c_custkey", "ticker")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date")
    )
    return _daily_scores(orders.join(homes, orders["o_custkey"] == homes["c_custkey"]))


def supplier_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", supplier_ticker("l_suppkey").alias("ticker"))
    return _daily_scores(lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]))


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    days = table(spark, folder, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return days.filter((F.weekday("date") < 5) & (F.col("date") < F.lit("2001-07-01").cast("date"))).distinct()


def universe(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "region").filter(F.col("r_name") != "EUROPE")
    return named.select(F.substring("r_name", 1, 4).alias("symbol")).distinct()


def news_raw(spark: SparkSession, folder: str) -> DataFrame:
    region = table(spark, folder, "region").select("r_regionkey", F.substring("r_name", 1, 4).alias("name"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    a = region.select((F.col("r_regionkey")).alias("k5"), F.col("name").alias("name5"))
    b = region.select((F.col("r_regionkey")).alias("k7"), F.col("name").alias("name7"))
    d = docs.withColumns({"k5": (F.col("doc_id") % 5).cast("int"), "k7": (F.col("doc_id") % 7).cast("int")})
    d = d.join(a, "k5", "left").join(b, "k7", "left")
    minutes = "doc_id * 7919 % 3600000"
    stamp = (
        f"timestampadd(MINUTE, CAST(CASE WHEN doc_id % 4 = 1 THEN ({minutes}) - ({minutes}) % 1440 "
        f"ELSE {minutes} END AS INT), TIMESTAMP_NTZ '1995-01-02 00:00:00')"
    )
    return d.selectExpr(
        "doc_id AS rn",
        "CASE WHEN doc_id % 50 <> 7 THEN concat('https://www.example.com/articles/', "
        "CAST(doc_id - CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS STRING)) END AS url",
        f"CASE WHEN doc_id % 97 = 5 THEN 'not a date' ELSE "
        f"concat(date_format({stamp}, 'yyyy-MM-dd HH:mm:ss'), ' UTC') END AS date_raw",
        "CASE WHEN doc_id % 11 = 2 THEN NULL WHEN doc_id % 3 = 0 THEN concat(' ', lower(name5)) "
        "ELSE name5 END AS stock_symbol",
        "concat('Why ', coalesce(name7, 'XYZ'), ' and its CEO beat THE market') AS title",
        "CASE WHEN doc_id % 13 <> 4 THEN text END AS article",
    )


def article_scores(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id AS article_index",
        "((doc_id * 31) % 201 - 100) / 100.0D AS sentiment",
        "CAST(1 + doc_id % 5 AS INT) AS num_sentences",
    )


def lexicon(spark: SparkSession) -> DataFrame:
    words = [("the", 1.0), ("and", 1.0), ("to", 1.0), ("of", -1.0), ("in", -1.0), ("that", -1.0)]
    return spark.createDataFrame(words, "word string, weight double")


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_scored_events(table(spark, folder, "events"))


def as_scored_events(events: DataFrame) -> DataFrame:
    return events.selectExpr("event_type AS ticker", "ts", "(value - 50) / 500 AS sentiment")


def directions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").selectExpr(
        "o_orderpriority AS grp",
        "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS y",
        "((o_orderkey * 37) % 101) / 100.0D AS p",
    )


# ---- SQL for the check -----------------------------------------------------------

_PRICED = (
    "CAST(l_shipdate AS DATE) AS date, l_quantity, l_extendedprice/l_quantity AS price, "
    "ROW_NUMBER() OVER (PARTITION BY {key}, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "l_extendedprice, l_quantity) AS rn, "
    "ROW_NUMBER() OVER (PARTITION BY {key}, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, "
    "l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rd"
)
_BAR = (
    "SELECT ticker, date, MAX(CASE WHEN rn=1 THEN price END) AS open, MAX(price) AS high, MIN(price) AS low, "
    "MAX(CASE WHEN rd=1 THEN price END) AS close, MAX(CASE WHEN rd=1 THEN price END) AS adj_close, "
    "CAST(SUM(l_quantity) AS BIGINT) AS volume FROM ({lines}) GROUP BY ticker, date"
)
_SUPPLIER = "'S' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')"
_SCORE = "SUM(o_orderkey*31 % 201 - 100) / (100.0e0 * COUNT(*)) AS daily_sentiment, COUNT(*) AS n_articles"
_MINUTES = "(doc_id*7919 % 3600000)"

CTES: dict[str, str] = {
    "fx_bars": _BAR.format(
        lines="SELECT substr(r_name,1,4) AS ticker, "
        + _PRICED.format(key="r_name")
        + " FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey "
        "JOIN region ON n_regionkey=r_regionkey"
    ),
    "fx_sbars": _BAR.format(
        lines=f"SELECT {_SUPPLIER} AS ticker, " + _PRICED.format(key="l_suppkey") + " FROM lineitem"
    ),
    "fx_sent": "SELECT substr(r_name,1,4) AS ticker, CAST(o_orderdate AS DATE) AS date, " + _SCORE + " FROM orders "
    "JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey "
    "JOIN region ON n_regionkey=r_regionkey GROUP BY 1, 2",
    "fx_ssent": f"SELECT {_SUPPLIER} AS ticker, CAST(o_orderdate AS DATE) AS date, {_SCORE} "
    "FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1, 2",
    "fx_calendar": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem "
    "WHERE isodow(l_shipdate) < 6 AND l_shipdate < DATE '2001-07-01'",
    "fx_universe": "SELECT DISTINCT substr(r_name,1,4) AS symbol FROM region WHERE r_name <> 'EUROPE'",
    "fx_news": "SELECT doc_id AS rn, CASE WHEN doc_id % 50 <> 7 THEN concat('https://www.example.com/articles/', "
    "CAST(doc_id - CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS VARCHAR)) END AS url, "
    "CASE WHEN doc_id % 97 = 5 THEN 'not a date' ELSE concat(strftime(TIMESTAMP '1995-01-02 00:00:00' + "
    f"to_minutes(CAST(CASE WHEN doc_id % 4 = 1 THEN {_MINUTES} - {_MINUTES} % 1440 ELSE {_MINUTES} END AS BIGINT)), "
    "'%Y-%m-%d %H:%M:%S'), ' UTC') END AS date_raw, "
    "CASE WHEN doc_id % 11 = 2 THEN NULL WHEN doc_id % 3 = 0 THEN concat(' ', lower(substr(a.r_name,1,4))) "
    "ELSE substr(a.r_name,1,4) END AS stock_symbol, "
    "concat('Why ', coalesce(substr(b.r_name,1,4),'XYZ'), ' and its CEO beat THE market') AS title, "
    "CASE WHEN doc_id % 13 <> 4 THEN text END AS article FROM documents "
    "LEFT JOIN region a ON a.r_regionkey = doc_id % 5 LEFT JOIN region b ON b.r_regionkey = doc_id % 7",
    "fx_scores": "SELECT doc_id AS article_index, ((doc_id*31) % 201 - 100)/100.0e0 AS sentiment, "
    "1 + doc_id % 5 AS num_sentences FROM documents",
    "fx_lexicon": "SELECT * FROM (VALUES ('the',1.0e0),('and',1.0e0),('to',1.0e0),('of',-1.0e0),('in',-1.0e0),"
    "('that',-1.0e0)) t(word, weight)",
    "fx_stream": "SELECT event_type AS ticker, ts, (value-50)/500 AS sentiment FROM events",
    "fx_direction": "SELECT o_orderpriority AS grp, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS y, "
    "((o_orderkey*37) % 101)/100.0e0 AS p FROM orders",
}


# Views computed once where several steps read them.
STORED: set[str] = set()


def with_views(body: str) -> str:
    """Put in front of a statement the views it uses, directly or through other views."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    kind = {n: "AS MATERIALIZED" if n in STORED else "AS" for n in needed}
    return "WITH " + ", ".join(f"{n} {kind[n]} ({CTES[n]})" for n in needed) + " " + body
