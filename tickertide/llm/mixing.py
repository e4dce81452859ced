"""Mixing sources to target weights by Sainte-Lague apportionment.

All words of a source, its documents in a seeded order, form one stream that is cut into blocks of
equal word counts: 1 / ``blocks`` of all words, or less in a source that would have fewer than
``own_blocks`` of them, down to one word. Blocks of the common size are seats: first sources, then the
shards of each source, get them by highest quotients (votes divided by 1, 3, 5, ...), so every shard
has an integer quota. A source with smaller blocks, or one whose target is its cap, takes all its words
as often as they fit into its target and then as many blocks as come nearest to the rest; the others
share what is left. A shard takes all its blocks quota // n times and a seeded run of quota % n of them
once more. No block is taken more than ``repeat`` times.

Tables that go through one task hold one row per source, or at most ``repeat`` rows per block of the
common size, whose number is a constant. Documents of one source are spread over its shards.

Defined results: a null text has no words; null is a source of its own, last in order; sources
without words and texts without words take nothing; repeated rows are documents of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.llm.common import WORD, free_name, one_of_each, plain_text, row_key, stored

BLOCKS = 65_536
OWN_BLOCKS = 256
REPEAT = 3
SHARD_DIGITS = 2
SEED = "mix-1"


def n_words(text: str) -> Column:
    return F.regexp_count(plain_text(text), F.lit(WORD)).cast("bigint")


def targets_of(sources: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """Targets per source (columns source, source_size): weights 1, 2, 3 repeating, in code point order.

    A target stops at ``repeat`` times its source; the excess goes to the others by weight. With
    sources sorted by cap / weight, level k spreads what the capped ones before k leave; the first
    source whose cap lies above its level fixes the level for all that follow.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    ranked = ranked.withColumns({"weight": (F.col("place") - 1) % 3 + 1, "cap": F.col("source_size") * repeat})
    ranked = ranked.withColumns({"total": F.sum("source_size").over(everything), "ratio": F.col("cap") / F.col("weight")})
    by_ratio = Window.orderBy("ratio", "place")
    ranked = ranked.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "weights": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    ranked = ranked.withColumn("level", (F.col("total") - F.col("capped")) / F.col("weights"))
    fixed = F.min_by("level", F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "place"))).over(everything)
    ranked = ranked.withColumn("level", fixed)
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return ranked.select("source", "place", "source_size", "total", target.alias("target"))


def seats(table: DataFrame, votes: Column, cap: Column, wanted: Column, by: list[str], tie: list[str], sure: Column | None = None) -> DataFrame:
    """Add ``quota``: seats by highest quotients among the rows of ``by``, at most ``cap`` for a row.

    The first ``sure`` seats of a row are not ranked and not added: ``wanted`` and ``quota`` leave them out.
    """
    rows = table.withColumns({"_votes": votes, "_cap": cap, "_wanted": wanted, "_sure": F.lit(0) if sure is None else sure})
    ranked = F.sequence(F.col("_sure").cast("bigint") + 1, F.col("_cap").cast("bigint"))
    claims = rows.filter("_cap > _sure").withColumn("_seat", F.explode(ranked))
    quotient = F.col("_votes") / (2 * F.col("_seat") - 1)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(quotient.desc(), *tie, "_seat"))
    won = claims.withColumn("_rank", rank).filter("_rank <= _wanted").groupBy(*by, *tie).agg(F.count("*").alias("quota"))
    return table.join(won, [*by, *tie], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("bigint"))


def word_seats(sources: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """Add ``quota`` to sources with targets: one word a seat, as many as all words, by highest quotients.

    A source whose target is its cap has that many; the others share what is left. Rounded votes divided by
    d are the seats whose quotients reach d. Of n sources with ``left`` words, left / (left - n / 2) deals out too few
    seats, which are sure, and left / (left + n / 2) too many: between them lie two seats a source, which are ranked.
    """
    everything = Window.partitionBy()
    cap = F.col("source_size") * repeat
    full = F.col("target") >= cap
    rows = sources.withColumns({"_all": F.lit(0), "_full": full, "_most": cap.cast("bigint")})
    rows = rows.withColumns(
        {
            "_left": F.col("total") - F.coalesce(F.sum(F.when(full, cap)).over(everything), F.lit(0)),
            "_n": F.sum((~full).cast("int")).over(everything),
        }
    )
    reached = lambda more: F.floor(F.col("target") * (F.col("_left") + more * F.col("_n") / 2) / F.nullif(F.col("_left"), F.lit(0)) + 0.5)
    bounded = lambda n: F.coalesce(F.greatest(F.lit(0), F.least("_most", n)), F.lit(0)).cast("bigint")
    rows = rows.withColumns({"_few": F.when(~F.col("_full"), bounded(reached(-1))), "_many": F.when(~F.col("_full"), bounded(reached(1)))})
    rows = rows.withColumn("_open", F.col("_left") - F.coalesce(F.sum("_few").over(everything), F.lit(0)))
    few = F.coalesce("_few", F.lit(0))
    rows = seats(rows, F.col("target"), F.coalesce("_many", F.lit(0)), F.col("_open"), ["_all"], ["place"], few)
    quota = F.when(F.col("_full"), F.col("_most")).otherwise(few + F.col("quota"))
    return rows.withColumn("quota", quota).drop("_all", "_full", "_most", "_left", "_n", "_few", "_many", "_open")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    blocks: int = BLOCKS,
    own_blocks: int = OWN_BLOCKS,
    repeat: int = REPEAT,
    shard_digits: int = SHARD_DIGITS,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, parts.

    ``parts`` lists (first word, number of words, times taken), in order.
    """
    sizes = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        n_words(text).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))).alias("draw"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("shard", F.substring("draw", 1, shard_digits))
    sizes = stored(sizes, "sizes")

    shards = sizes.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sources = targets_of(shards.groupBy("source").agg(F.sum("shard_size").alias("source_size")), repeat)
    common = F.greatest(F.lit(1), F.ceil(F.col("total") / blocks)).cast("bigint")
    own_block = F.least(F.col("_common"), F.greatest(F.lit(1), F.expr(f"source_size div {own_blocks}")))
    alone = (F.col("block") < F.col("_common")) | (F.col("target") >= F.col("source_size") * repeat)
    sources = sources.withColumn("_common", common).withColumn("block", own_block).withColumn("_alone", alone)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")))
    # A source on its own: all words so often, then blocks nearest to the rest. It has no seats among the others.
    times = F.floor(F.col("target") / F.col("source_size")).cast("bigint")
    rest = F.round((F.col("target") - times * F.col("source_size")) / F.col("block")).cast("bigint")
    own_quota = F.when(F.col("_alone") & (F.col("source_size") > 0), times * F.col("n_blocks") + F.least("n_blocks", rest))
    settled = F.coalesce(F.sum(F.when(F.col("_alone"), F.col("target"))).over(Window.partitionBy()), F.lit(0.0))
    sources = sources.withColumns({"_own": own_quota, "_left": F.round((F.col("total") - settled) / F.col("_common")).cast("bigint"), "_all": F.lit(0)})
    cap = F.when(F.col("_alone"), 0).otherwise(F.col("n_blocks") * repeat)
    sources = seats(sources, F.col("target"), cap, F.col("_left"), ["_all"], ["place"])
    sources = sources.withColumn("quota", F.coalesce("_own", "quota").cast("bigint"))
    sources = stored(sources.drop("_all", "_common", "_alone", "_own", "_left"), "quotas")

    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.join(sources, shards.source.eqNullSafe(sources.source)).drop(shards.source)
    shards = shards.withColumn("start", F.coalesce(F.sum("shard_size").over(before), F.lit(0)).cast("bigint"))
    edge = lambda at: F.ceil(at / F.col("block"))  # noqa: E731  first block that begins at or after a word
    shards = shards.withColumns(
        {"first_block": edge(F.col("start")), "in_shard": edge(F.col("start") + F.col("shard_size")) - edge(F.col("start"))}
    ).withColumnRenamed("quota", "source_quota")
    shards = stored(
        seats(shards, F.col("in_shard").cast("double"), F.col("in_shard") * repeat, F.col("source_quota"), ["place"], ["shard"]),
        "shard_quotas",
    )

    # A seeded run of blocks, cyclic within the shard, is taken once more than the others.
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "place", "shard")), 1, 8), 16, 10).cast("bigint")
    index = F.col("idx") - F.col("first_block")
    times = F.expr("quota div in_shard") + ((index + turn) % F.col("in_shard") < F.col("quota") % F.col("in_shard")).cast("bigint")
    taken_blocks = (
        shards.filter("in_shard > 0")
        .withColumn("idx", F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("in_shard") - 1)))
        .select("place", "idx", times.alias("times"))
    )

    # Words of a document within the stream of its source.
    starts = shards.select("place", "source", "shard", "start", "source_size", "target", "block")
    running = Window.partitionBy("source", "shard").orderBy("draw", "row").rowsBetween(Window.unboundedPreceding, 0)
    at = sizes.withColumn("_end", F.sum("size").over(running))
    at = at.join(starts, at.source.eqNullSafe(starts.source) & (at["shard"] == starts["shard"])).drop(starts.source, starts["shard"])
    at = at.withColumn("end", F.col("start") + F.col("_end")).withColumn("begin", F.col("end") - F.col("size"))
    spans = F.when(F.col("size") > 0, F.sequence(F.expr("begin div block"), F.expr("(end - 1) div block")))
    cut = at.withColumn("idx", F.explode_outer(spans)).join(taken_blocks, ["place", "idx"], "left")
    low = F.greatest(F.col("begin"), F.col("idx") * F.col("block"))
    high = F.least(F.col("end"), (F.col("idx") + 1) * F.col("block"))
    part = F.when(F.col("idx").isNotNull(), F.struct((low - F.col("begin")).alias("first"), (high - low).alias("n"), "times"))
    base = ["row", "doc_id", "source", "size", "source_size", "target"]
    out = cut.withColumn("part", part).groupBy(*base).agg(
        F.coalesce(F.sum(F.col("part.n") * F.col("part.times")), F.lit(0)).cast("bigint").alias("taken"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    return out.drop("row")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix as rows of ``docs``: the c-th copy of a document holds its parts taken c times or more.

    A copy that takes every part keeps the text as it is; otherwise its words are joined by one space.
    """
    key, parts, copy = (free_name(docs.columns, name) for name in ("_key", "_parts", "_copy"))
    keyed = one_of_each(docs.withColumn(key, row_key(doc_id, text)), key, [doc_id, text])
    narrow = keyed.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"))
    plan = mix(narrow, "key", "text", "source", **options)
    plan = plan.filter("taken > 0").select(F.col("doc_id").alias(key), F.col("parts").alias(parts))
    most = F.array_max(F.transform(parts, lambda p: p["times"]))
    rows = keyed.join(plan, key).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), most)))
    words = F.regexp_extract_all(plain_text(text), F.lit(f"({WORD})"))
    chosen = F.filter(parts, lambda p: p["times"] >= F.col(copy))
    picked = F.flatten(F.transform(chosen, lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["n"].cast("int"))))
    whole = F.size(chosen) == F.size(parts)
    rows = rows.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(picked, " ")))
    return rows.select(*docs.columns)


def whole_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    repeat: int = REPEAT,
    shard_digits: int = SHARD_DIGITS,
    seed: str = SEED,
) -> DataFrame:
    """The mix in whole documents, as rows of ``docs``: each source meets its quota within one document.

    The quotas are seats of one word, as many as there are words, dealt to the sources by highest
    quotients (see ``word_seats``). The documents of a source in seeded order are the list that fills its
    seats, from the front again when it ends: a document is taken as often as its first word gets a seat, so
    the last one taken may run over the quota. Documents without words are not taken.
    """
    key, copy, often = (free_name(docs.columns, name) for name in ("_key", "_copy", "_times"))
    keyed = one_of_each(docs.withColumn(key, row_key(doc_id, text)), key, [doc_id, text])
    sizes = keyed.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), F.md5(F.concat_ws(":", F.lit(seed), key)).alias("draw"))
    sizes = stored(sizes.withColumn("shard", F.substring("draw", 1, shard_digits)), "sizes")
    shards = sizes.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sources = targets_of(shards.groupBy("source").agg(F.sum("shard_size").alias("source_size")), repeat)
    sources = stored(word_seats(sources, repeat), "quotas")
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.join(sources, shards.source.eqNullSafe(sources.source)).drop(shards.source)
    starts = starts.withColumn("start", F.coalesce(F.sum("shard_size").over(before), F.lit(0)))
    running = Window.partitionBy("source", "shard").orderBy("draw", "key").rowsBetween(Window.unboundedPreceding, 0)
    at = sizes.filter("size > 0").withColumn("_end", F.sum("size").over(running))
    at = at.join(starts, at.source.eqNullSafe(starts.source) & (at["shard"] == starts["shard"]))
    more = F.col("start") + F.col("_end") - F.col("size") < F.expr("quota % source_size")
    times = at.select(F.col("key").alias(key), (F.expr("quota div source_size") + more.cast("bigint")).alias(often)).filter(F.col(often) > 0)
    rows = keyed.join(times, key).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(often))))
    return rows.select(*docs.columns)
