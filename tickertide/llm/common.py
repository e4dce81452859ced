"""Helpers shared by the corpus operators: written tables, row keys, ordered positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.session import shared_dir

# The blanks between words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identity of a row for joining decisions back: its id and its whole text."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), plain_text(text)), 256)


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, or a longer one where a column is called so already (names differ in more than case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(rows: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """One row per ``key``, whose rows are equal in ``same``: the first by its other columns written as JSON."""
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (key, *same)]
    place = F.to_json(F.struct(*others)) if others else F.lit("")
    fields = [F.col(f"`{c}`") for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*fields), place).alias("_row")).select(key, "_row.*")


def ordered_positions(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """Rows in a total order with running sums over all rows up to and including each row.

    Rows are dealt out by ranges of ``order`` (which must tell rows apart, so that no key is too
    hot for a task) and written with the number of their range. Only the totals of the ranges, one
    row per range, are summed across ranges. Adds one column per entry of ``sums``.
    """
    marks = [f"_order{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(marks, order)) | {f"_add_{k}": v for k, v in sums.items()})
    ranged = stored(ranged.repartitionByRange(*marks).withColumn("_range", F.spark_partition_id()), label)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_add_{k}").alias(f"_sum_{k}") for k in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_sum_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*marks).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range: as few as the shuffle has partitions, whatever the data.
    out = ranged.join(F.broadcast(offsets), "_range")
    out = out.withColumns({k: F.col(f"_off_{k}") + F.sum(f"_add_{k}").over(inside) for k in sums})
    return out.drop("_range", *marks, *[f"_add_{k}" for k in sums], *[f"_off_{k}" for k in sums])


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``max_bytes`` of text, to bound the memory of a step."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > max_bytes:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n + 1
    if held:
        yield batch.slice(first, len(lengths) - first)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def in_batches(df: DataFrame, fn, fields: Sequence[tuple[str, str]], columns: Sequence[str] | None = None, text: str = "text", max_bytes: int = 8 << 20) -> DataFrame:
    """Run ``fn`` over Arrow batches: rows of ``columns`` (all if None) with new columns behind them.

    ``fn`` gets the texts of at most about ``max_bytes`` and returns an array per entry of ``fields``
    (name, type); a new column takes the place of an old one of the same name.
    """
    names = [name for name, _ in fields]
    kept = [c for c in (df.columns if columns is None else columns) if c not in names]
    own = free_name(kept, "__text")
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(own))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{name}` {kind}" for name, kind in fields])

    def run(batches):
        step = fn()
        for batch in batches:
            for piece in pieces(batch, own, max_bytes):
                made = step(texts_of(piece, own))
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in kept] + list(made), [*kept, *names])

    return rows.mapInArrow(run, schema)
