"""N-gram Jaccard join by MinHash banding.

A text is the set of its ``ngram``-word grams (words: runs of letters, marks, digits and underscores
in lower case); a text with fewer words has one gram of all of them. Two texts are linked if the
Jaccard similarity of their full sets reaches ``threshold``. ``choose_bands`` takes the most rows per
band for which the bands find a pair at the threshold with probability ``recall``, within ``hashes``
hash functions; texts are shuffled on band hashes, and candidates are verified on the full sets.

Copies (equal word sequences) are one node. Within a bucket, pairs are not enumerated: every member
is verified against ``HUBS`` hubs drawn by hash, which covers small buckets whole, and links make
components. Only buckets that hold several components stay open: there the members outside the
largest component are compared with all others, in blocks of at most about ``BLOCK`` texts, and a
link is kept per text and component it reaches. So the classes are those of all links between
candidates, while a large group of near copies costs rows in proportion to its size.

Links lie within classes, so they are counted there: every text of a class is compared with all
others of it, in units of two cells of about ``CELL`` texts, and each unit returns one count per text.
Pairs are never emitted. The work of a class grows with the square of its texts, its rows with their
number times the number of cells.

Defined results: texts without words have no grams and form a class each; null ids come last; rows
repeating an id are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tickertide.llm.common import free_name, in_batches, one_of_each, row_key, stored

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.99999
HASHES = 96
HUBS = 3
BLOCK = 256
CELL = 1024
CELL_GRAMS = 1 << 20
DENSE = 128
SEED = 20_240_607


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, thus the fewest false candidates, that reach the recall."""
    best = None
    for rows in range(1, hashes + 1):
        share = threshold**rows
        bands = 1 if share >= 1 else math.ceil(math.log1p(-recall) / math.log1p(-share))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best


def _words(texts: pa.Array) -> pa.Array:
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}\p{N}_]+")
    flat = pc.list_flatten(lists)
    full = pc.greater(pc.binary_length(flat), 0)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    counts = np.bincount(text[full.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat.filter(full).cast(pa.string()))


def _digests(words: pa.Array) -> list[bytes]:
    return [hashlib.sha256(t.encode()).digest() for t in pc.binary_join(words, " ").to_pylist()]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(words: pa.Array, ngram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of all texts, in order, and the number of grams of each text."""
    import xxhash

    coded = words.values.dictionary_encode()
    distinct = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    flat = distinct[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    counts = pc.list_value_length(words).to_numpy().astype(np.int64)
    size = np.where(counts >= ngram, ngram, counts)  # words per gram
    n = np.where(counts > 0, counts - size + 1, 0)
    starts = np.cumsum(counts) - counts
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    width = np.repeat(size, n)
    hashes = np.zeros(len(first), np.uint64)
    for j in range(ngram):
        inside = j < width
        at = first + j
        step = _mix(hashes * np.uint64(0x100000001B3) + flat[np.where(inside, at, 0)] + np.uint64(j + 1)) if len(flat) else hashes
        hashes = np.where(inside, step, hashes)
    return hashes, n


def signatures(docs: DataFrame, columns: list[str], text: str, ngram: int, bands: int, rows: int) -> DataFrame:
    """Rows of ``docs`` with digest of the words, n_grams and one hash per band."""

    def task():
        draw = np.random.default_rng(SEED)
        factors = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        masks = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

        def step(texts: pa.Array):
            words = _words(texts)
            hashes, n = _gram_hashes(words, ngram)
            full = n > 0
            starts = (np.cumsum(n) - n)[full]
            out = np.zeros((len(n), bands), np.uint64)
            for band in range(bands):
                h = np.full(len(starts), band + 1, np.uint64)
                for row in range(band * rows, (band + 1) * rows):
                    least = np.minimum.reduceat((hashes ^ masks[row]) * factors[row], starts) if len(starts) else h
                    h = _mix(h * np.uint64(31) + least)
                out[full, band] = h
            ends = np.cumsum(np.where(full, bands, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out[full].ravel().view(np.int64)))
            return pa.array(_digests(words), pa.binary()), pa.array(n, pa.int64()), lists

        return step

    return in_batches(docs, task, [("digest", "binary"), ("n_grams", "bigint"), ("bands", "array<bigint>")], columns, text, 4 << 20)


def gram_sets(docs: DataFrame, columns: list[str], text: str, ngram: int) -> DataFrame:
    """Rows of ``docs`` with digest of the words and the set of gram hashes."""

    def task():
        def step(texts: pa.Array):
            words = _words(texts)
            hashes, n = _gram_hashes(words, ngram)
            sets = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(n)[:-1])] if len(n) else []
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            return pa.array(_digests(words), pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))

        return step

    return in_batches(docs, task, [("own_digest", "binary"), ("grams", "array<bigint>")], columns, text, 4 << 20)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links lead to, by alternating large and small stars.

    Every step is an aggregate and a join, and its edges are written, so no lineage grows.
    """
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _similarity(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _compare_blocks(threshold: float):
    """Links between the asking texts of a unit and its others, one per text and component reached."""

    def run(unit: pa.Table) -> pa.Table:
        asks = np.array(unit.column("asks").to_pylist(), bool)
        nodes, labels = unit.column("node").to_numpy(), unit.column("label").to_numpy()
        sets = unit.column("grams").combine_chunks()
        sizes = pc.list_value_length(sets).to_numpy().astype(np.int64)
        values, codes = np.unique(pc.list_flatten(sets).to_numpy(), return_inverse=True)
        ends = np.cumsum(sizes)
        others = np.flatnonzero(~asks)
        flat = np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in others]) if len(others) else codes[:0]
        starts = np.cumsum(sizes[others]) - sizes[others]
        found = set()
        mark = np.zeros(len(values), np.int64)
        for i in np.flatnonzero(asks) if len(others) else []:
            own = codes[ends[i] - sizes[i] : ends[i]]
            mark[own] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[own] = 0
            near = (both >= threshold * (sizes[i] + sizes[others] - both)) & (labels[others] != labels[i])
            reached = {}
            for j in others[near]:
                reached.setdefault(labels[j], nodes[j])
            found.update((nodes[i], other) for other in reached.values())
        a, b = zip(*sorted(found)) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _shared(a: np.ndarray, rows_a: np.ndarray, n_a: int, b: np.ndarray, rows_b: np.ndarray, n_b: int) -> np.ndarray:
    """Number of codes that each of ``n_a`` sets has in common with each of ``n_b`` sets.

    Codes (``a`` and ``b``, with the rows that hold them) are distinct within a row. Frequent codes
    are counted by products of matrices, the others by listing the rows they meet in.
    """
    both = np.zeros(n_a * n_b, np.int32)
    n_codes = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
    of_a, of_b = np.bincount(a, minlength=n_codes), np.bincount(b, minlength=n_codes)
    meets = of_a * of_b
    dense = meets * DENSE > n_a * n_b
    number = np.cumsum(dense) - 1
    take_a, take_b = dense[a], dense[b]
    code_a, at_a, code_b, at_b = number[a[take_a]], rows_a[take_a], number[b[take_b]], rows_b[take_b]
    step = 1024
    for low in range(0, int(dense.sum()), step):
        x, y = np.zeros((n_a, step), np.float32), np.zeros((n_b, step), np.float32)
        inside = (code_a >= low) & (code_a < low + step)
        x[at_a[inside], code_a[inside] - low] = 1
        inside = (code_b >= low) & (code_b < low + step)
        y[at_b[inside], code_b[inside] - low] = 1
        both += (x @ y.T).astype(np.int32).ravel()

    sparse = (meets > 0) & ~dense
    take_a, take_b = sparse[a], sparse[b]
    order_a, order_b = (np.argsort(c, kind="stable") for c in (a[take_a], b[take_b]))
    code_a, at_a, at_b = a[take_a][order_a], rows_a[take_a][order_a], rows_b[take_b][order_b]
    first_b = np.cumsum(np.where(sparse, of_b, 0)) - of_b
    width = of_b[code_a]
    ends = np.cumsum(width)
    low = 0
    while low < len(code_a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (1 << 20), "right")))
        n = width[low:high]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        met = at_b[np.repeat(first_b[code_a[low:high]], n) + within]
        hit, times = np.unique(np.repeat(at_a[low:high], n).astype(np.int64) * n_b + met, return_counts=True)
        both[hit] += times.astype(np.int32)
        low = high
    return both.reshape(n_a, n_b)


def _count_links(threshold: float):
    """Links of every text of a unit to the texts of its other cell, or of its own if there is one cell."""

    def run(unit: pa.Table) -> pa.Table:
        nodes, labels = unit.column("node").to_numpy(), unit.column("label").to_numpy()
        second = unit.column("second").to_numpy().astype(bool)
        sets = unit.column("grams").combine_chunks()
        sizes = pc.list_value_length(sets).to_numpy().astype(np.int64)
        grams = pc.list_flatten(sets).to_numpy()
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(labels, kind="stable")
        counts = np.zeros(len(nodes), np.int64)
        for group in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            size = sizes[group]
            at = np.repeat(starts[group] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            codes, rows = np.unique(grams[at], return_inverse=True)[1], np.repeat(np.arange(len(group)), size)
            one, two = np.flatnonzero(~second[group]), np.flatnonzero(second[group])
            alone = not len(two)
            if alone:
                both = _shared(codes, rows, len(group), codes, rows, len(group))
                two = one
            else:
                place = np.zeros(len(group), np.int64)
                place[one], place[two] = np.arange(len(one)), np.arange(len(two))
                later = second[group][rows]
                both = _shared(codes[~later], place[rows[~later]], len(one), codes[later], place[rows[later]], len(two))
            near = both / (size[one][:, None] + size[two][None, :] - both) >= threshold
            if alone:
                np.fill_diagonal(near, False)
                counts[group] += near.sum(1)
            else:
                counts[group[one]] += near.sum(1)
                counts[group[two]] += near.sum(0)
        found = counts > 0
        return pa.table({"node": pa.array(nodes[found], pa.int64()), "links": pa.array(counts[found], pa.int64())})

    return run


def count_links(sets: DataFrame, labels: DataFrame, threshold: float, cell: int = CELL, cell_grams: int = CELL_GRAMS) -> DataFrame:
    """(node, links): the other nodes of its class that each node is linked to.

    A class is dealt into cells by its texts and its grams; each two cells are a unit. Classes of one
    cell share units, so that there are not more units than the grams ask for.
    """
    size = F.size("grams").cast("bigint")
    placed = stored(sets.join(labels, "node").select("node", "label", "grams", size.alias("n_grams")), "classes")
    by_class = placed.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_grams").alias("g")).filter("n > 1")
    by_class = by_class.withColumn("cells", F.greatest(F.ceil(F.col("n") / cell), F.ceil(F.col("g") / cell_grams)).cast("int"))
    by_class = stored(by_class, "class_sizes")
    small = by_class.filter("cells = 1").agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = max(1, -(-small[0] // cell_grams), -(-small[1] // cell))
    rows = placed.join(by_class.select("label", "cells"), "label")
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    rows = rows.select("node", "label", "grams", "cells", "cell", other.alias("other"))
    single = F.col("cells") == 1
    units = rows.select(
        F.when(single, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.col("label")).alias("unit"),
        F.when(single, -1).otherwise(F.least("cell", "other")).alias("low"),
        F.when(single, -1).otherwise(F.greatest("cell", "other")).alias("high"),
        (F.col("cell") > F.col("other")).cast("int").alias("second"),
        "node",
        "label",
        "grams",
    )
    found = units.groupBy("unit", "low", "high").applyInArrow(_count_links(threshold), "node bigint, links bigint")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def near_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    ngram: int = NGRAM,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    hashes: int = HASHES,
    hubs: int = HUBS,
    block: int = BLOCK,
    cell: int = CELL,
    counted: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (its smallest id), class_size, links, kept.

    ``links`` counts all other texts linked to the text, copies of a text as one (null unless
    ``counted``); ``kept`` marks one row per class, the first by id.
    """
    bands, rows = choose_bands(threshold, recall, hashes)
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = signatures(plain, ["doc_id"], "text", ngram, bands, rows)
    signed = stored(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    # Without words there is nothing to compare: each such row is a node of its own.
    same = F.when(F.col("n_grams") > 0, F.col("digest")).otherwise(F.col("row").cast("string").cast("binary"))
    narrow = signed.select("doc_id", "row", "digest", "n_grams", same.alias("same"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    firsts = narrow.groupBy("same").agg(F.min(place).alias("first")).select("same", "first", F.col("first.row").alias("node"))
    members = stored(narrow.join(firsts, "same").select("doc_id", "row", "digest", "n_grams", "node"), "members")

    heads = members.filter("row = node").select("row", "node")
    banded = signed.filter("n_grams > 0").select("row", "bands").join(heads, "row")
    banded = stored(banded.select("node", F.explode("bands").alias("bucket")), "bands")
    full = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(banded.join(full, "bucket"), "buckets")

    # Hubs of a bucket: the first of its members in a few seeded orders.
    drawn = [F.min_by("node", F.xxhash64("node", "bucket", F.lit(k))) for k in range(hubs)]
    hub_sets = stored(shared.groupBy("bucket").agg(F.array_distinct(F.array(*drawn)).alias("hubs")), "hubs")
    pairs = shared.join(hub_sets, "bucket").select("node", F.explode("hubs").alias("hub")).filter("node <> hub")
    pairs = stored(pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")

    wanted = shared.select("node").distinct().join(heads_of(members), "node")
    texts = plain.join(wanted.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = gram_sets(texts.select("node", "digest", "text"), ["node", "digest"], "text", ngram)
    sets = sets.filter("digest = own_digest").select("node", "grams").dropDuplicates(["node"])
    sets = stored(sets, "sets")

    of_a, of_b = (sets.select(F.col("node").alias(k), F.col("grams").alias(f"_{k}")) for k in "ab")
    near = pairs.join(of_a, "a").join(of_b, "b").filter(_similarity("_a", "_b") >= threshold)
    links = stored(near.select("a", "b"), "links")
    labels = stored(components(links), "labels")

    # Open buckets: not covered by their hubs, and in more than one component.
    placed = _labelled(shared, labels)
    by_label = placed.groupBy("bucket", "label").agg(F.count("*").alias("n_label"))
    main = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("n_label", "label")).alias("main"), F.sum("n_label").alias("n_main"), F.count("*").alias("n_labels"))
    main = main.filter("n_labels > 1").join(hub_sets, "bucket").filter(F.col("n_main") - F.size("hubs") > 1)
    main = main.withColumn("blocks", F.ceil(F.col("n_main") / block).cast("int")).select("bucket", "main", "blocks")
    inside = stored(placed.join(main, "bucket").withColumn("cell", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "open")
    asking = inside.filter("label <> main").withColumn("asks", F.lit(True))
    cells = asking.select("bucket", "cell").distinct().withColumnRenamed("cell", "ask_cell")
    asked = asking.select("bucket", "node", "label", "asks", F.col("cell").alias("ask_cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("cell"))
    others = inside.withColumn("asks", F.lit(False)).join(cells, "bucket").select("bucket", "node", "label", "asks", "ask_cell", "cell")
    units = asked.unionByName(others).join(sets, "node")
    rest = units.groupBy("bucket", "ask_cell", "cell").applyInArrow(_compare_blocks(threshold), "a bigint, b bigint")
    rest = stored(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    every = links.unionByName(rest)
    if rest.take(1):
        labels = stored(components(every), "labels")

    rows_of = _labelled(members.select("doc_id", "row", "node"), labels)
    if counted:
        degree = count_links(sets, labels, threshold, cell)
        rows_of = rows_of.join(degree, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("bigint"))
    else:
        rows_of = rows_of.withColumn("links", F.lit(None).cast("bigint"))
    classes = rows_of.groupBy("label").agg(F.min(place).alias("first"), F.count("*").alias("class_size"))
    return rows_of.join(classes, "label").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        "links",
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def heads_of(members: DataFrame) -> DataFrame:
    return members.filter("row = node").select("node", "doc_id", "digest")


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The first row of every class, with all its columns. Of rows equal in id and text the first by its other columns stays."""
    key = free_name(docs.columns, "_key")
    keyed = docs.withColumn(key, row_key(doc_id, text))
    identity = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(key).alias("key"))
    found = near_classes(keyed.select(identity.alias("_id"), F.col(text).alias("text")), "_id", "text", counted=False, **options)
    kept = found.filter("kept").select(F.col("doc_id.key").alias(key))
    return one_of_each(keyed.join(kept, key, "left_semi"), key, [doc_id, text]).select(*docs.columns)
