"""Ordered computations over long series without a whole series in one task.

Two building blocks:

* ``running_total`` - an exact running sum in a total order, by coarse-to-fine buckets. Only
  the per-bucket totals are ordered across buckets; rows are sorted inside their bucket.
* ``over_blocks`` - runs window expressions over blocks of consecutive rows. Each block gets a
  copy of the rows just before (and after) it, so bounded frames give the same values as over
  the whole series, while a hot key is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tickertide.functions.columns import as_column

ROWS_PER_BLOCK = 4096


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name where null equals null; the columns appear once."""
    other = {c: f"_on_{i}" for i, c in enumerate(on)}
    renamed = right.withColumnsRenamed(other)
    same = [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()]
    return left.join(renamed, same, how).drop(*other.values())


def running_total(
    df: DataFrame,
    order: str,
    levels: Sequence[Column],
    value: Column | None = None,
    keys: Sequence[str] = (),
    name: str = "before",
    total: str | None = None,
) -> DataFrame:
    """Add ``name`` = sum of ``value`` over the rows strictly before, in ``order`` within ``keys``.

    ``levels`` are buckets from coarse to fine, each non-decreasing in ``order`` (a year, a
    range of row numbers). ``order`` must be unique within ``keys``. With ``value`` omitted the
    rows are counted. ``total`` adds the sum over the whole key.
    """
    keys = list(keys)
    marks = [f"_level{i}" for i in range(len(levels))]
    base = df.withColumns(dict(zip(marks, levels)))
    base = base.withColumn("_value", F.lit(1).cast("bigint") if value is None else value)
    zero = F.lit(0)

    # Bucket totals, finest first; coarser ones are sums of sums.
    totals = [base.groupBy(*keys, *marks).agg(F.sum("_value").alias("_sum"))]
    for depth in range(len(marks) - 1, 0, -1):
        totals.insert(0, totals[0].groupBy(*keys, *marks[:depth]).agg(F.sum("_sum").alias("_sum")))

    offsets = None
    for depth, sums in enumerate(totals):
        parent = [*keys, *marks[:depth]]
        whole = Window.partitionBy(*parent)
        before = whole.orderBy(marks[depth]).rowsBetween(Window.unboundedPreceding, -1)
        step = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), zero))
        if depth == 0 and total:
            step = step.withColumn("_total", F.sum("_sum").over(whole))
        step = step.drop("_sum")
        if offsets is not None:
            upper = offsets.withColumnRenamed("_offset", "_upper")
            step = null_safe_join(step, upper, parent).withColumn("_offset", F.col("_offset") + F.col("_upper"))
            step = step.drop("_upper")
        offsets = step

    inside = Window.partitionBy(*keys, *marks).orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = base.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), zero))
    out = null_safe_join(out, offsets, [*keys, *marks]).withColumn(name, F.col("_offset") + F.col("_inside"))
    if total:
        out = out.withColumnRenamed("_total", total)
    return out.drop(*marks, "_value", "_inside", "_offset")


def read_all(df: DataFrame) -> Column:
    """An aggregate of every column that can be hashed.

    Spark reuses a shuffle only where the same columns are read from it, and leaves out those that are not.
    """
    return F.max(F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]))


def with_positions(
    df: DataFrame,
    carry: Sequence[str] = (),
    key: str = "ticker",
    order: str = "date",
    pos: str = "pos",
    n: str = "n_rows",
    shared: bool = False,
) -> DataFrame:
    """1-based position of each row in its series, and the length of the series.

    Nulls in the ``carry`` columns are replaced by the last value seen earlier in the series,
    however far back. Rows are sorted within one year of a key; across years only the row counts
    and last values of each year are ordered.

    ``shared`` is for tables of which every column is read above: the years are then counted from the
    same shuffle as the rows, and nothing below it is made or written twice.
    """
    # Null keys and dates get values of their own, so that the join and the window share one shuffle.
    series, year = "_series", "_year"
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    base = df.withColumns({series: named, year: F.coalesce(F.year(order), F.lit(-(2**31)))})
    ends = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in carry]
    if shared:
        base = base.repartition(series, year)
        ends.append(read_all(df).alias("_read"))
    years = base.groupBy(series, year).agg(F.count("*").alias("_count"), *ends)
    if shared:
        years = years.filter(F.col("_read").isNotNull())  # of a group, so never null
    whole = Window.partitionBy(series)
    before = whole.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    offsets = years.select(
        series,
        year,
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"),
        F.sum("_count").over(whole).alias(n),
        *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in carry],
    )
    inside = Window.partitionBy(series, year).orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = base.join(offsets, [series, year])
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.col(f"_carry_{c}")) for c in carry}
    out = out.withColumns({pos: F.row_number().over(inside) + F.col("_offset"), **filled})
    return out.drop(series, year, "_offset", *[f"_carry_{c}" for c in carry])


def over_blocks(
    df: DataFrame,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int,
    after: int = 0,
    keys: Sequence[str] = ("ticker",),
    pos: str = "pos",
    rows_per_block: int = ROWS_PER_BLOCK,
    keep: int = 0,
) -> DataFrame:
    """Apply ``fn(block_rows, window)`` to blocks of rows with their neighbours.

    ``fn`` may use any frame reaching at most ``before`` rows back and ``after`` rows ahead. It
    must keep ``pos`` and the helper columns; neighbour rows are removed afterwards. With ``keep``
    the last rows before each block stay too, and ``_own`` (the block a row belongs to) and
    ``_block`` (the one it stands in) stay as columns.
    """
    # A block must be longer than the neighbourhood it lends to the next one.
    size = max(rows_per_block, before, after, 1)
    p = F.col(pos) - 1
    own = F.floor(p / F.lit(size)).cast("bigint")
    offset = p % F.lit(size)
    targets = [own]
    if before:
        targets.append(F.when(offset >= size - before, own + 1))
    if after:
        targets.append(F.when((offset < after) & (own > 0), own - 1))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(F.array(*targets))))
    w = Window.partitionBy(*keys, "_block").orderBy(pos)
    out = fn(spread, w)
    inside = F.col("_own") == F.col("_block")
    if not keep:
        return out.filter(inside).drop("_own", "_block")
    return out.filter(inside | ((F.col("_own") < F.col("_block")) & (offset >= size - keep)))


def dense_index(df: DataFrame, column: str, name: str, levels: Sequence[Column] | None = None) -> DataFrame:
    """0-based alphabetical index of each distinct value: one row per value.

    Values are bucketed by growing prefixes, so no task sorts all of them: two more characters
    per level keep every step to the pairs of characters in use.
    """
    distinct = df.select(as_column(column).alias(column)).distinct()
    if levels is None:
        levels = [F.substring(column, 1, k) for k in (2, 4, 6, 8)]
    out = running_total(distinct, column, levels, name=name)
    return out.withColumn(name, F.col(name).cast("bigint"))
