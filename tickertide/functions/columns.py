"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_HAS_ZONE = r"(?i)(z|utc|gmt|[+-]\d{2}:\d{2})$"
_EDGE_SPACE = r"^\s+|\s+$"


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- dates -----------------------------------------------------------------

def utc_timestamp(text: str | Column) -> Column:
    """Date text to a zone-free UTC timestamp; null when it cannot be read.

    Text without a zone is taken as UTC, whatever the session zone is.
    """
    s = F.trim(as_column(text))
    zoned = F.when(s.rlike(_HAS_ZONE), s).otherwise(F.concat(s, F.lit("Z")))
    micros = F.unix_micros(zoned.try_cast("timestamp"))
    full = F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))
    day_only = F.when(F.length(s) == 10, s.try_cast("date").cast("timestamp_ntz"))
    return F.coalesce(day_only, full)


def as_instant(ts: str | Column) -> Column:
    """A zone-free UTC timestamp as a point in time, which watermarks need."""
    micros = F.timestamp_diff("MICROSECOND", F.expr(EPOCH), as_column(ts))
    return F.timestamp_micros(micros)


def instant_date(ts: str | Column) -> Column:
    """The UTC date of a point in time, whatever the session zone is."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(as_column(ts)), F.expr(EPOCH)).cast("date")


def leading_date(text: str | Column) -> Column:
    """The date in the first ten characters; null when it is not one."""
    return F.substring(as_column(text), 1, 10).try_cast("date")


def leading_year(text: str | Column) -> Column:
    """The year in the first four characters, read as a number only."""
    return F.substring(as_column(text), 1, 4).try_cast("int")


def news_year(text: str | Column) -> Column:
    """Leading year, falling back to a full date parse."""
    return F.coalesce(leading_year(text), F.year(utc_timestamp(text)))


def new_york_hour(ts: str | Column) -> Column:
    """Hour of the day in New York of a zone-free UTC timestamp."""
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), as_column(ts)))


# ---- text ------------------------------------------------------------------

def url_key(url: str | Column) -> Column:
    return F.md5(as_column(url))


def without_prefix(text: str | Column, prefix: str) -> Column:
    s = as_column(text)
    return F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 2_147_483_647)).otherwise(s)


def trim_space(text: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(as_column(text), _EDGE_SPACE, "")


def one_line(text: str | Column) -> Column:
    """Runs of white space to one blank, trimmed; null to the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(as_column(text), F.lit("")), r"\s+", " "))


def sentences(text: str | Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by space; trimmed, blanks removed."""
    marked = F.regexp_replace(as_column(text), r"([.!?])\s+", "$1\u0001")
    parts = F.transform(F.split(marked, "\u0001"), trim_space)
    return F.filter(parts, lambda s: s != "")


def sample_sentences(items: str | Column, limit: int, method: str = "first") -> Column:
    """At most ``limit`` items of an array; 0 keeps all. Unknown methods act as ``first``."""
    arr = as_column(items)
    if not limit:
        return arr
    n = F.size(arr)
    if method == "last":
        picked = F.slice(arr, n - limit + 1, F.lit(limit))
    elif method == "uniform":
        step = n.cast("double") / F.lit(float(limit))
        picked = F.transform(
            F.sequence(F.lit(0), F.lit(limit - 1)),
            lambda i: F.get(arr, F.floor(i.cast("double") * step).cast("int")),
        )
    elif method == "headtail":
        head = limit // 2
        tail = limit - head
        picked = F.concat(F.slice(arr, 1, head), F.slice(arr, n - tail + 1, F.lit(tail)))
    else:
        picked = F.slice(arr, 1, limit)
    return F.when(n <= limit, arr).otherwise(picked)


def tickers_from_text(text: str | Column) -> Column:
    """Comma-separated tickers to an array of trimmed upper-case names without blanks."""
    parts = F.transform(F.split(as_column(text), ","), lambda t: F.upper(trim_space(t)))
    return F.filter(parts, lambda t: t != "")


def tickers_to_text(tickers: str | Column) -> Column:
    return F.concat_ws(",", as_column(tickers))


# ---- numbers ---------------------------------------------------------------

def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null where the denominator is zero (ANSI mode would raise)."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def any_null(columns: Sequence[str]) -> Column:
    expr = F.lit(False)
    for name in columns:
        expr = expr | F.col(name).isNull()
    return expr
