"""Sharding by minimax contiguous partition: equal texts stay together, the fullest shard is as small as can be.

Groups of equal texts stand in the order of their smallest id; their sizes become running sums, in a
written table sorted by them. A capacity is checked greedily: each shard takes as many groups as fit,
which is one look-up of a running sum per shard. Bounds for the smallest feasible capacity are known
(the largest group or the mean; that plus the largest group), and the search divides them: every
look-up job answers for many capacities at once, until the few groups between the cuts of the two
bounds fit the driver (``WINDOW`` rows at most), where the rest of the search runs on them alone.

Under the smallest capacity the cuts are then placed as evenly as it allows: each cut goes to the
group end nearest to an even share of what is left, between the last cut that leaves a feasible rest
and the first that overfills the shard.

Defined results: null counts as an empty text; all empty texts are one group; ids may be null (first)
or repeat; fewer groups than shards leave the last shards empty; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window, functions as F

from tickertide.llm.common import ordered_positions, plain_text, stored

SHARDS = 24
POINTS = 256
WINDOW = 100_000
ROW_BYTES = 8


class _Ends:
    """Running sums at the ends of groups, looked up by Spark jobs over the written table."""

    def __init__(self, table: DataFrame, largest: int):
        self.table, self.largest = table, largest

    def last_up_to(self, points: list[int]) -> list[int]:
        """For each point the largest end that is not above it (0 if none)."""
        marks = sorted(set(points))
        near = self.table.filter(F.col("end").between(marks[0] - self.largest, marks[-1]))
        spot = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col("end")))
        found = {r[0]: r[1] for r in near.groupBy(spot.alias("spot")).agg(F.max("end").alias("end")).collect()}
        best, out = 0, {}
        for i, m in enumerate(marks):
            best = max(best, found.get(i, 0))
            out[m] = best
        return [out[p] for p in points]

    def first_from(self, point: int) -> int:
        """The smallest end that is not below the point (0 for points up to 0)."""
        if point <= 0:
            return 0
        near = self.table.filter(F.col("end").between(point, point + self.largest))
        return near.agg(F.min("end")).first()[0]

    def between(self, pairs: list[tuple[int, int]]) -> DataFrame:
        inside = F.lit(False)
        for low, high in pairs:
            inside = inside | F.col("end").between(low, high)
        return self.table.filter(inside).select("end")


def _greedy(ends: _Ends, capacities: list[int], total: int, shards: int) -> list[list[int]]:
    """The cuts of a greedy check, for each capacity; feasible if the last cut is the total."""
    cuts = [[0] for _ in capacities]
    for _ in range(shards):
        open_ = [i for i, c in enumerate(cuts) if c[-1] < total]
        if not open_:
            break
        points = [min(total, cuts[i][-1] + capacities[i]) for i in open_]
        for i, end in zip(open_, ends.last_up_to(points)):
            cuts[i].append(end)
    return cuts


def smallest_capacity(ends: _Ends, total: int, shards: int, points: int = POINTS, window: int = WINDOW) -> int:
    low, high = max(ends.largest, -(-total // shards)), -(-total // shards) + ends.largest
    while low < high:
        tried = sorted({low + (high - low) * k // points for k in range(points + 1)})
        cuts = _greedy(ends, tried, total, shards)
        good = next(i for i, c in enumerate(cuts) if c[-1] == total)
        if good == 0:
            return tried[0]
        low, high = tried[good - 1] + 1, tried[good]
        below, above = cuts[good - 1], cuts[good]
        # A cut moves up with the capacity, so those still in question lie between these two.
        pairs = list(zip(below[1:], above[1:] + [total] * len(below)))
        rest = ends.between(pairs)
        if low < high and rest.count() <= window:
            known = sorted(r[0] for r in rest.collect())
            while low < high:
                middle, at = (low + high) // 2, 0
                for _ in range(shards):
                    if at < total:
                        at = known[bisect_right(known, at + middle) - 1]
                low, high = (low, middle) if at == total else (middle + 1, high)
    return high


def even_cuts(ends: _Ends, capacity: int, total: int, shards: int) -> list[int]:
    """Cuts (running sums) under a capacity, as near to even shares as it allows."""
    least = [total]
    for _ in range(shards - 1):
        least.append(ends.first_from(least[-1] - capacity))
    least.reverse()  # least[j]: the first end from which the shards after j can take the rest
    at, cuts = 0, []
    for j in range(shards - 1):
        even = at + (total - at) / (shards - j)
        low, high = ends.last_up_to([int(even), at + capacity])
        choices = {low, min(ends.first_from(int(even) + 1), high) if even < total else total, high}
        fitting = [c for c in choices if max(least[j], at) <= c <= high]
        at = min(fitting, key=lambda c: (abs(c - even), c)) if fitting else max(least[j], at)
        cuts.append(at)
    return cuts


def shard_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    points: int = POINTS,
    window: int = WINDOW,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot, group_size."""
    body = plain_text(text)
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    narrow = stored(narrow, "sizes")
    groups = narrow.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("group_size"))
    order = [F.col("first_id"), F.col("digest"), F.col("doc_id"), F.col("row")]
    ranked = ordered_positions(
        narrow.join(groups, "digest"), order, {"end": F.col("size"), "position": F.lit(1).cast("bigint")}, "ordered"
    )
    ends = ranked.groupBy("digest").agg(F.max("end").alias("end"), F.max("position").alias("rows"), F.sum("size").alias("bytes"))
    ends = stored(ends.drop("digest").repartitionByRange("end").sortWithinPartitions("end"), "ends")

    total, largest = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    cuts: list[int] = []
    if total:
        looked = _Ends(ends, largest)
        cuts = even_cuts(looked, smallest_capacity(looked, total, shards, points, window), total, shards)
    firsts = {0: 0} | {r[0]: r[1] for r in ends.filter(F.col("end").isin(cuts)).select("end", "rows").collect()}
    # Of shards that begin at the same place all but the last are empty.
    begins = [0, *cuts]
    shard = F.size(F.filter(F.array(*[F.lit(c) for c in begins]), lambda c: c < F.col("end"))) - 1
    first = F.element_at(F.array(*[F.lit(firsts[c]) for c in begins]), F.col("shard") + 1)
    out = ranked.withColumn("shard", shard.cast("int"))
    out = out.withColumn("slot", (F.col("position") - 1 - first).cast("bigint"))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", "group_size")
