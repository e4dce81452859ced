"""A polarity lexicon learned from what prices did after an article.

Articles are labelled by the return that follows them: the mean next-day return of their tickers. The
lexicon is a naive Bayes model: a word weighs the logarithm of how much more often it stands in articles
before a rise than before a fall. It comes from two counts per word, so the fit is one aggregate, and
``text.score_by_lexicon`` scores sentences with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickertide.operators.features import target
from tickertide.operators.series import over_blocks, with_positions

MIN_ARTICLES = 5  # fewer say nothing about a word
HELD_OUT = (3, 1)  # articles whose checksum leaves this remainder are not learned from


def held_out(article: str = "article_index", rule: tuple[int, int] = HELD_OUT) -> Column:
    return F.crc32(F.col(article).cast("string")) % rule[0] == rule[1]


def next_returns(bars: DataFrame) -> DataFrame:
    """(ticker, date, next_return) of every bar that has a next one."""
    rows = over_blocks(with_positions(bars), lambda df, w: target(df, w), 0, 1)
    return rows.filter(F.col("target").isNotNull()).select("ticker", "date", F.col("target").alias("next_return"))


def return_labels(articles: DataFrame, bars: DataFrame) -> DataFrame:
    """(article_index, up): whether the tickers of an article rose on the next day, on average.

    ``articles`` has article_index, tickers and date. Articles without a bar of their day, or without a
    move, have no label.
    """
    pairs = articles.select("article_index", "date", F.explode("tickers").alias("ticker"))
    moves = pairs.join(next_returns(bars), ["ticker", "date"]).groupBy("article_index").agg(F.avg("next_return").alias("move"))
    return moves.filter("move <> 0").select("article_index", (F.col("move") > 0).alias("up"))


def fit_lexicon(texts: DataFrame, labels: DataFrame, text: str = "summary", min_articles: int = MIN_ARTICLES) -> DataFrame:
    """(word, weight) from labelled texts: log of a word's share of rising articles over that of falling ones.

    A word counts once per article; shares are smoothed by one article with and one without it. Words of
    fewer than ``min_articles`` articles are left out.
    """
    rows = texts.join(labels, "article_index")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0))
    counts = rows.select("up", F.explode(words).alias("word")).groupBy("word").agg(F.count_if("up").alias("n_up"), F.count_if(~F.col("up")).alias("n_down"))
    totals = labels.join(texts.select("article_index"), "article_index", "left_semi")
    totals = totals.agg(F.struct(F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down")).alias("t")).scalar()
    counts = counts.filter(F.col("n_up") + F.col("n_down") >= min_articles).withColumn("_t", totals)
    share = lambda n, total: F.log((F.col(n) + 1) / (F.col(f"_t.{total}") + 2))
    return counts.select("word", (share("n_up", "up") - share("n_down", "down")).alias("weight"))


def hit_rates(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of articles whose sentiment has the sign of their label, and of the more common label, held out or not."""
    rows = scores.join(labels, "article_index").select(
        F.when(held_out(), "held_out").otherwise("train").alias("part"), "up", ((F.col("sentiment") >= 0) == F.col("up")).alias("hit")
    )
    share = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("part").agg(F.count("*").alias("n"), share("hit").alias("accuracy"), F.greatest(share("up"), 1 - share("up")).alias("majority"))
