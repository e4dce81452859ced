"""Exact dedup by a heavy-hitter split.

Texts are equal when their digests are: SHA-256 of the text without blanks. A Misra-Gries summary
(the frequent-items aggregate of Spark) finds every digest that holds more than ``support`` of all
rows; it has at most ``1 / support`` entries. Their exact sizes and winners are counted, which
verifies them, and broadcast: copies in hot groups are settled where they are read. Only the
remaining digests, none of them hot, are shuffled.

Defined results: a null text counts as empty; empty texts are copies of each other; of equal texts
the one with the most code points stays, then the smallest id (null last), then the first row read,
so rows that repeat an id still leave exactly one row per group; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickertide.llm.common import BLANK, free_name, one_of_each, plain_text, row_key, stored

SUPPORT = 0.001


def digest_of(text: str):
    return F.sha2(F.regexp_replace(plain_text(text), f"{BLANK}+", ""), 256)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.unhex(digest_of(text)).alias("digest"),
        F.length(plain_text(text)).cast("bigint").alias("n_chars"),
        F.monotonically_increasing_id().alias("row"),
    )
    digests = stored(digests, "digests")
    # Smallest first: longest text, ids before nulls, smallest id, first row.
    place = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    measures = [F.count("*").alias("group_size"), F.min(place).alias("first")]

    frequent = digests.select(F.hex("digest").alias("digest")).freqItems(["digest"], support)
    frequent = frequent.select(F.explode("digest_freqItems").alias("digest")).select(F.unhex("digest").alias("digest"))
    # Both broadcasts hold at most 1 / support rows, whatever the data.
    winners = digests.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(*measures)
    winners = winners.filter(F.col("group_size") > 1)
    tagged = digests.join(F.broadcast(winners), "digest", "left")

    hot = tagged.filter(F.col("group_size").isNotNull())
    rest = tagged.filter(F.col("group_size").isNull()).select(*digests.columns)
    cold = rest.join(rest.groupBy("digest").agg(*measures), "digest")
    return hot.unionByName(cold).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows that stay, with all their columns. Of rows equal in id and text the first by its other columns stays."""
    key = free_name(docs.columns, "_key")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    identity = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(key).alias("key"))
    decided = exact_dedup(keyed.select(identity.alias("_id"), F.col(text).alias("text")), "_id", "text", support)
    kept = decided.filter("kept").select(F.col("doc_id.key").alias(key))
    return one_of_each(keyed.join(kept, key, "left_semi"), key, [doc_id, text]).select(*docs.columns)
