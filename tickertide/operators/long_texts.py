"""Summaries of texts with thousands of sentences, each spread over many tasks.

The sentence graph of a long text is a table of blocks: a task compares one block of sentences with
another and stores which pairs are linked, a bit per pair. Power iteration is a Spark loop over that
table: each block of links passes the ranks of its rows on to its columns and back, and a round is
written before the next begins. Blocks are rows that tasks go through by Arrow batches, with no group per
block. Summaries equal those of ``text.summarise``, which holds the graph of a text in one task; here a task
holds the words of a text or a block of links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.functions.columns import sentences
from tickertide.functions.stems import stemmed
from tickertide.operators.text import (
    EDGE_THRESHOLD,
    STOP_WORDS,
    SUMMARY_SENTENCES,
    TOLERANCE,
    join_sentences,
    sentence_terms,
    summarise,
    weighted_terms,
)
from tickertide.session import shared_dir

LONGEST = 2000  # sentences of a text that one task may rank
BLOCK = 1024  # sentences of a block
LEAST_SENTENCE = 3  # characters of the shortest sentence with its blank

KEY = "article_index"
PIECE = 4_000_000  # values and bytes of a batch of rows that a task gives out


def _written(df: DataFrame, label: str) -> DataFrame:
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _in_pieces(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a bounded size, so that what a task holds does not grow with its rows."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row.values() if hasattr(v, "__len__"))
        if weight > PIECE:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _mapped(df: DataFrame, each: Callable[..., Iterator[dict]], fields: list[pa.Field], ddl: str) -> DataFrame:
    """Rows from ``each(row, columns)``, applied where the rows lie; ``columns`` gives the values of an array column."""
    schema = pa.schema(fields)

    def values(batch: pa.RecordBatch, name: str, k: int) -> np.ndarray:
        return batch.column(name)[k].values.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for k in range(batch.num_rows) for row in each(batch, k, partial(values, batch, k=k)))
        yield from _in_pieces(rows, schema)

    return df.mapInArrow(run, ddl)


_INTS, _DOUBLES = pa.list_(pa.int32()), pa.list_(pa.float64())
_WORDS = [pa.field("at", _INTS), pa.field("w", _INTS), pa.field("v", _DOUBLES)]


def _word_weights(parts: DataFrame, stem: bool) -> DataFrame:
    """Per article its ``n`` sentences and idf-weighted word frequencies: sentence ``at``, number of the word ``w``, weight ``v``."""

    def each(batch: pa.RecordBatch, k: int, values) -> Iterator[dict]:
        terms = batch.column("_terms")[k].as_py()
        if not terms:
            return
        at, w, v, _ = weighted_terms([list(map(stemmed, s)) for s in terms] if stem else terms)
        order = np.argsort(at, kind="stable")
        yield {KEY: batch.column(KEY)[k].as_py(), "n": len(terms), "at": at[order], "w": w[order], "v": v[order]}

    fields = [pa.field(KEY, pa.int64()), pa.field("n", pa.int32()), *_WORDS]
    return _mapped(parts.select(KEY, "_terms"), each, fields, f"{KEY} bigint, n int, at array<int>, w array<int>, v array<double>")


def _sentence_blocks(weights: DataFrame, block: int) -> DataFrame:
    """One row per article and block: its words by sentence (0-based in the block)."""

    def each(batch: pa.RecordBatch, k: int, values) -> Iterator[dict]:
        n, at, w, v = batch.column("n")[k].as_py(), values("at"), values("w"), values("v")
        for number, first in enumerate(range(0, n, block)):
            size = min(block, n - first)
            low, high = np.searchsorted(at, [first, first + size])
            own = {"at": at[low:high] - first, "w": w[low:high], "v": v[low:high]}
            yield {KEY: batch.column(KEY)[k].as_py(), "n": n, "block": number, "size": size, **own}

    fields = [pa.field(KEY, pa.int64()), *[pa.field(c, pa.int32()) for c in ("n", "block", "size")], *_WORDS]
    return _mapped(weights, each, fields, f"{KEY} bigint, n int, block int, size int, at array<int>, w array<int>, v array<double>")


def _linked(left, right) -> np.ndarray:
    """Which sentences of one block have a cosine over the threshold with which of another, as bits."""
    (at, w, v, rows), (other_at, other_w, other_v, columns) = left, right
    names, number = np.unique(np.concatenate([w, other_w]), return_inverse=True)
    norm, other_norm = (np.sqrt(np.bincount(a, x * x, minlength=n)) for a, x, n in ((at, v, rows), (other_at, other_v, columns)))
    dots = np.zeros((rows, columns))
    own, others = number[: len(w)], number[len(w) :]
    by, other_by = np.argsort(own, kind="stable"), np.argsort(others, kind="stable")
    step = 512  # words at once
    for first in range(0, len(names), step):
        a, b = (o[np.searchsorted(n[o], first) : np.searchsorted(n[o], first + step)] for o, n in ((by, own), (other_by, others)))
        if len(a) and len(b):
            dense, other = np.zeros((rows, step)), np.zeros((columns, step))
            dense[at[a], own[a] - first] = v[a]
            other[other_at[b], others[b] - first] = other_v[b]
            dots += dense @ other.T
    return np.packbits(dots > EDGE_THRESHOLD * np.outer(norm, other_norm))


def _links(blocks: DataFrame, block: int) -> DataFrame:
    """Blocks of links of all pairs of blocks of a text, the first not behind the other."""
    last = F.floor((F.col("n") - 1) / block).cast("int")
    body = ["size", "at", "w", "v"]
    left = blocks.select(KEY, *body, "block", F.explode(F.sequence(F.col("block"), last)).alias("other"))
    # Columns of their own on both sides: they come from one table.
    right = blocks.select(F.col(KEY).alias("_article"), *[F.col(c).alias(f"other_{c}") for c in body], F.col("block").alias("_other"))
    # The work of a pair is the square of its bytes: a fixed number of tasks, not one per so many bytes.
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(tasks, KEY, "other"), right.repartition(tasks, "_article", "_other")
    pairs = left.join(right, (F.col(KEY) == F.col("_article")) & (F.col("other") == F.col("_other"))).drop("_article", "_other")

    def each(batch: pa.RecordBatch, k: int, values) -> Iterator[dict]:
        at = {c: batch.column(c)[k].as_py() for c in (KEY, "block", "other", "size", "other_size")}
        sides = [[*[values(f"{prefix}{c}") for c in ("at", "w", "v")], at[f"{prefix}size"]] for prefix in ("", "other_")]
        bits = _linked(*sides).tobytes()
        yield {KEY: at[KEY], "block": at["block"], "other": at["other"], "rows": at["size"], "columns": at["other_size"], "bits": bits}

    fields = [pa.field(KEY, pa.int64()), *[pa.field(c, pa.int32()) for c in ("block", "other", "rows", "columns")], pa.field("bits", pa.binary())]
    return _mapped(pairs, each, fields, f"{KEY} bigint, block int, other int, rows int, columns int, bits binary")


def _given(links: DataFrame, shares: DataFrame) -> DataFrame:
    """(article, block, given): parts of what each block gets from all blocks of its text.

    ``shares`` has a row per block. Links of a block meet the shares of its text from that block on: a list
    as long as the text, a small part of the links.
    """
    whole = shares.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("block", "share"))).alias("_s"))
    whole = whole.select(F.col(KEY).alias("_article"), F.posexplode("_s.block").alias("_from", "_block"), F.col("_s.share").alias("_shares"))
    later = F.slice("_shares", F.col("_from") + 1, F.size("_shares") - F.col("_from"))
    whole = whole.select("_article", "_block", later.alias("_shares"))
    meet = links.join(whole, (F.col(KEY) == F.col("_article")) & (F.col("block") == F.col("_block")))
    meet = meet.select(KEY, "block", "other", "rows", "columns", "bits", F.get("_shares", F.lit(0)).alias("down"), F.get("_shares", F.col("other") - F.col("block")).alias("up"))

    def each(batch: pa.RecordBatch, k: int, values) -> Iterator[dict]:
        article, first, other, rows, columns, bits = (batch.column(c)[k].as_py() for c in (KEY, "block", "other", "rows", "columns", "bits"))
        mask = np.unpackbits(np.frombuffer(bits, np.uint8), count=rows * columns).reshape(rows, columns)
        yield {KEY: article, "block": other, "given": values("down") @ mask}
        if other != first:
            yield {KEY: article, "block": first, "given": mask @ values("up")}

    fields = [pa.field(KEY, pa.int64()), pa.field("block", pa.int32()), pa.field("given", _DOUBLES)]
    return _mapped(meet, each, fields, f"{KEY} bigint, block int, given array<double>")


def _round(links: DataFrame, ranks: DataFrame, share: Column) -> DataFrame:
    """New ranks of each block, and how far they are from the old ones (squared); the first pass counts links."""
    given = _given(links, ranks.select(KEY, "block", share.alias("share")))
    held = ranks.select(KEY, "block", F.lit(None).cast("array<double>").alias("given"), "rank", "degree")
    both = given.withColumns({"rank": F.lit(None).cast("array<double>"), "degree": F.lit(None).cast("array<double>")}).unionByName(held)
    # Parts are summed in one order, whatever the order they come in.
    sums = both.groupBy(KEY, "block").agg(F.sort_array(F.collect_list("given")).alias("_g"), F.max("rank").alias("rank"), F.max("degree").alias("degree"))
    nothing = F.transform("rank", lambda _: F.lit(0.0))
    added = F.aggregate("_g", nothing, lambda total, g: F.zip_with(total, g, lambda a, b: a + b))
    sums = sums.withColumn("_total", added).drop("_g")
    first = F.col("degree").isNull()
    away = F.aggregate(F.zip_with("_total", "rank", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
    return sums.select(
        KEY,
        "block",
        F.when(first, F.col("rank")).otherwise(F.col("_total")).alias("rank"),
        F.when(first, F.transform("_total", lambda t: F.greatest(t, F.lit(1.0)))).otherwise(F.col("degree")).alias("degree"),
        F.when(first, F.lit(1.0)).otherwise(away).alias("away"),
    )


def central_sentences(parts: DataFrame, keep: int = SUMMARY_SENTENCES, block: int = BLOCK, stem: bool = False) -> DataFrame:
    """(article_index, _best): positions of the most central sentences of each text, in text order.

    ``parts`` comes from ``sentence_terms``; ``article_index`` tells its rows apart and is not null.
    """
    blocks = _written(_sentence_blocks(_word_weights(parts, stem), block), "sentence-blocks")
    linked = links = _written(_links(blocks, block), "sentence-links")
    start = F.transform(F.sequence(F.lit(1), F.col("size")), lambda _: F.lit(1.0) / F.col("n"))
    ranks = blocks.select(KEY, "block", start.alias("rank"), F.lit(None).cast("array<double>").alias("degree"), F.lit(1.0).alias("away"))
    ones = F.transform("rank", lambda _: F.lit(1.0))
    ranks = _written(_round(links, ranks, ones), "sentence-ranks")
    even = F.zip_with("rank", "degree", lambda r, d: r / d)
    settled = None
    while True:  # ends: ranks of a graph in which every sentence is linked to itself settle
        moving = _written(_round(links, ranks, even), "sentence-ranks")
        far = F.sqrt(F.sum("away").over(Window.partitionBy(KEY))) > TOLERANCE
        marked = moving.withColumn("_far", far)
        done = marked.filter(~F.col("_far")).drop("_far")
        settled = done if settled is None else settled.unionByName(done)
        ranks = marked.filter("_far").drop("_far")
        if ranks.isEmpty():
            break
        links = linked.join(ranks.select(KEY).distinct(), KEY, "left_semi")
    rows = settled.select(KEY, "block", F.posexplode("rank").alias("at", "rank"))
    rows = rows.select(KEY, (F.col("block") * block + F.col("at")).alias("i"), F.round("rank", 12).alias("rank"))
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("rank"), "i"))
    best = rows.withColumn("_place", place).filter(F.col("_place") <= keep)
    return best.groupBy(KEY).agg(F.array_sort(F.collect_list("i")).alias("_best"))


def summaries(
    articles: DataFrame,
    text: str = "article",
    keep: int = SUMMARY_SENTENCES,
    stop_words: Sequence[str] = STOP_WORDS,
    stem: bool = False,
    longest: int = LONGEST,
    block: int = BLOCK,
) -> DataFrame:
    """``summarise`` for texts of any length: those of more than ``longest`` sentences take many tasks.

    Long texts are ranked when this is called, in a loop that ends when all have settled.
    Where ``article_index`` is null a text is ranked in one task.
    """
    could = (F.length(text) >= LEAST_SENTENCE * longest) & F.col(KEY).isNotNull()
    is_long = F.coalesce(could & (F.size(sentences(text)) > max(longest, keep)), F.lit(False))
    marked = articles.withColumn("_long", is_long)
    short = summarise(marked.filter(~F.col("_long")).drop("_long"), text, keep, stop_words, stem)
    long = marked.filter("_long").drop("_long")
    if long.isEmpty():
        return short
    # Rows are told apart by a number of their own: rows of one article may repeat.
    terms = sentence_terms(long, text, stop_words).select(KEY, text, "_parts", "_terms")
    parts = _written(terms.withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    # Only texts that are split at all have sentences to rank.
    rows = parts.filter("_parts IS NOT NULL").select(F.col("_row").alias(KEY), "_terms")
    best = central_sentences(rows, keep, block, stem).withColumnRenamed(KEY, "_row")
    return short.unionByName(join_sentences(parts.join(best, "_row", "left"), text))
