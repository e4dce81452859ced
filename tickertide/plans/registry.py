"""The catalogue of queries: a DataFrame function each, and SQL to check it where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickertide.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: shown(fn(spark, folder), digits)
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn

    return register


def tie_shift(digits: int) -> float:
    """Added before rounding on both sides.

    Exact decimal ties (means of dyadic fractions) would round by the last bit of the sum, which
    depends on the order of the rows; the shift moves them off the border.
    """
    return float(f"1.3e-{digits + 3}")


def rounded(value: Column, digits: int) -> Column:
    """``round`` without its way over decimal text, and without negative zero.

    Below 2**40 steps the product is exact to a thousandth of a step; other values, and those that are not
    finite, are left to ``round``. Exact ties go to the even step, so values are moved off them first
    (``tie_shift``).
    """
    steps = 10.0**digits
    near = F.rint(value * steps) / steps + 0.0
    return F.when(F.abs(value) < 2.0**40 / steps, near).otherwise(F.round(value, digits))


FEW_DOUBLES = 8  # rounded column by column; more would make a method that the JVM does not compile


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Plain comparable columns: rounded doubles, dates and arrays as text, flags as numbers."""
    cols, fields = [], df.schema.fields
    shift = lambda name: F.col(f"`{name}`").cast("double") + tie_shift(digits)
    doubles = [f.name for f in fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    together = len(doubles) > FEW_DOUBLES
    if together:
        array = F.transform(F.array(*map(shift, doubles)), lambda v: rounded(v, digits))
        df = df.withColumn("_doubles", array)
    for field in fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.get("_doubles", F.lit(doubles.index(field.name))) if together else rounded(shift(field.name), digits)
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.BooleanType):
            c = c.cast("int")
        elif isinstance(kind, T.ArrayType):
            c = F.concat_ws(",", c.cast("array<string>"))
        elif isinstance(kind, T.IntegralType):
            c = c.cast("bigint")
        cols.append(c.alias(field.name))
    return df.select(cols)


def r(expr: str, digits: int = 6) -> str:
    """SQL for a rounded double without negative zero."""
    rounded = f"round(({expr}) + {tie_shift(digits)!r}, {digits})"
    return f"CASE WHEN {rounded} = 0 THEN 0.0e0 ELSE {rounded} END"


def i(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def s(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"
