"""Sentence ends that know abbreviations, learned from the texts themselves.

A word that nearly always carries a period, far more often than words do on average, and is followed by
lower case now and then, is an abbreviation: its period ends no sentence. The evidence is a log-likelihood
ratio of word and period (Dunning, 1993; for this use Kiss and Strunk, 2006), from one count per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.functions.columns import trim_space
from tickertide.operators.text import SMALL_LEXICON

# How sure an abbreviation carries its period, least evidence (chance of 0.001), least share
# of lower-case followers.
SURE = 0.99
EVIDENCE = 10.83
LOWER_SHARE = 0.1

WORD_TYPE = r"^\p{L}+(\.\p{L}+)*$"  # letters, with periods inside


def _core(token: Column) -> Column:
    """A token without what stands around its letters, but for a period behind them."""
    return F.regexp_replace(token, r"^[^\p{L}]+|[^\p{L}.]+$", "")


def period_counts(articles: DataFrame, text: str = "summary") -> DataFrame:
    """Per word in lower case: ``n`` times, ``n_period`` with a period, ``n_lower`` of these before lower case."""
    tokens = F.array_remove(F.split(F.col(text), r"\s+"), "")
    before_lower = lambda t, k: F.coalesce(F.rlike(F.get("_t", k + 1), F.lit(r"^\p{Ll}")), F.lit(False))
    paired = F.transform(F.col("_t"), lambda t, k: F.struct(t.alias("token"), before_lower(t, k).alias("lower")))
    rows = articles.select(tokens.alias("_t")).select(F.explode(paired).alias("p")).select("p.*")
    # Tokens are counted as they stand; only different ones are taken apart.
    rows = rows.groupBy("token", "lower").agg(F.count("*").alias("times")).withColumn("core", _core(F.col("token")))
    period = F.col("core").endswith(".")
    rows = rows.select(
        F.lower(F.when(period, F.substring("core", F.lit(1), F.length("core") - 1)).otherwise(F.col("core"))).alias("word"),
        period.alias("period"),
        "lower",
        "times",
    )
    rows = rows.filter(F.rlike("word", F.lit(WORD_TYPE)))
    times = lambda holds: F.sum(F.when(holds, F.col("times")).otherwise(0))
    return rows.groupBy("word").agg(
        F.sum("times").alias("n"), times(F.col("period")).alias("n_period"), times(F.col("period") & F.col("lower")).alias("n_lower")
    )


def abbreviations(counts: DataFrame) -> DataFrame:
    """(word, evidence) of the words whose period ends no sentence."""
    totals = counts.agg(F.struct((F.sum("n_period") / F.sum("n")).alias("share")).alias("t"))
    share = totals.scalar()["share"]
    with_share = counts.withColumn("_p", share).filter((F.col("_p") > 0) & (F.col("_p") < SURE))
    k, rest, p = F.col("n_period"), F.col("n") - F.col("n_period"), F.col("_p")
    usual = k * F.log(p) + rest * F.log(1 - p)
    sure = k * F.log(F.lit(SURE)) + rest * F.log(F.lit(1 - SURE))
    found = with_share.withColumn("evidence", 2 * (sure - usual))
    return found.filter((F.col("evidence") > EVIDENCE) & (F.col("n_lower") >= LOWER_SHARE * k)).select("word", "evidence")


def sentences_with(articles: DataFrame, known: DataFrame, text: str = "summary") -> DataFrame:
    """``sentence_table`` that cuts after ``.``, ``!`` or ``?`` and space, but not after a known abbreviation.

    ``known`` has a ``word`` column; it is broadcast up to ``SMALL_LEXICON`` words, a larger one is joined.
    ``article_index`` tells articles apart. Blanks inside sentences stay as they are.
    """
    # Read once: they are often learned from the texts, which should not be counted again for the join.
    few = known.select("word").limit(SMALL_LEXICON + 1).collect()
    if len(few) <= SMALL_LEXICON:
        known = F.broadcast(articles.sparkSession.createDataFrame(few, "word string"))
    marked = F.regexp_replace(F.col(text), r"([.!?])(\s+)", "$1\u0001$2")
    pieces = articles.select("article_index", F.posexplode(F.split(marked, "\u0001")).alias("_k", "_piece"))
    last = _core(F.regexp_extract("_piece", r"(\S+)\.$", 1))
    pieces = pieces.withColumn("_word", F.lower(F.when(F.col("_piece").endswith("."), last)))
    pieces = pieces.join(known.select(F.col("word").alias("_word"), F.lit(1).alias("_known")), "_word", "left")
    order = Window.partitionBy("article_index").orderBy("_k")
    ends = F.coalesce(F.lag(F.when(F.col("_known") == 1, 0).otherwise(1)).over(order), F.lit(0))
    pieces = pieces.withColumn("_new", ends)
    pieces = pieces.withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = pieces.groupBy("article_index", "_s").agg(F.sort_array(F.collect_list(F.struct("_k", "_piece"))).alias("_l"))
    rows = joined.select("article_index", "_s", trim_space(F.array_join("_l._piece", "")).alias("sentence")).filter("sentence <> ''")
    number = F.row_number().over(Window.partitionBy("article_index").orderBy("_s")) - 1
    return rows.select("article_index", number.alias("sentence_no"), "sentence")
