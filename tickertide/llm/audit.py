"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

The failing filters of a document are a set of letters. Counts of documents per part and set are all
the corpus has to give; from them Spark tabulates what every coalition of filters removes (a document
goes if it fails any filter of the coalition). A step of a chain removes the difference of two
coalitions: the filters up to it and those before it.

Shapley values come from exact constrained least squares: of all additive games the one nearest to the
table, in the norm of the Shapley kernel, whose values add up to what all filters remove. Its normal
equations are solved in rationals, so nothing is rounded.

Copies (filter E) need no join back to the rows: copies of one text with the same part and labels are
counted together before the shuffle, so a text in a third of all rows sends one record per task and
kind of row.

Defined results: null text counts as empty, null part as the empty string; a row fails E if the same
text stands under a smaller id, so rows that repeat an id don't fail by each other, and a row without
id neither fails E nor makes others fail; a document is good or toxic if any of its label rows says so
(rows without id belong to none);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickertide.llm.common import BLANK, plain_text

# The limits of the filters.
MIN_WORDS = 100
DISTINCT_SHARE = 80  # percent
CAPITAL_SHARE = 10  # percent
SYMBOLS = "[#$%&*|]"

LETTERS = "ABCDE"
COPY = "E"
SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
    "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that judge a text by itself: true where it fails."""
    words = F.array_remove(F.split(text, f"{BLANK}+"), "")
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_SHARE,
        "C": capitals.cast("bigint") * 100 > F.length(text).cast("bigint") * CAPITAL_SHARE,
        "D": F.rlike(text, F.lit(SYMBOLS)),
    }


def failure_sets(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): documents per part and set of failed filters, a bit per letter."""
    whole = plain_text(text)
    failed = sum((fails.cast("int") * (1 << LETTERS.index(letter)) for letter, fails in text_failures(whole).items()), F.lit(0))
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        failed.alias("failed"),
    )
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    kind = ["digest", "failed", "part", "good", "toxic"]
    # The id spreads a hot text over all tasks; only then are its copies counted together.
    ids = rows.join(marks, "id", "left").fillna(False, ["good", "toxic"]).groupBy("id", *kind).agg(F.count("*").alias("n"))
    known = F.col("id").isNotNull()
    kinds = ids.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, F.col("n")).otherwise(0)).alias("with_id"),
        F.min(F.when(known, F.struct("id", "n"))).alias("least"),
    )
    first = F.min("least.id").over(Window.partitionBy("digest"))
    copies = F.col("with_id") - F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    kinds = kinds.withColumn("copies", copies)
    bit = 1 << LETTERS.index(COPY)
    split = F.array(
        F.struct(F.col("failed"), (F.col("n") - F.col("copies")).alias("n")),
        F.struct((F.col("failed") + bit).alias("failed"), F.col("copies").alias("n")),
    )
    out = kinds.select("part", "good", "toxic", F.explode(split).alias("s")).select("part", "good", "toxic", "s.failed", "s.n")
    counted = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0)).alias(flag)
    return out.groupBy("part", "failed").agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def coalition_removals(failures: DataFrame, n_filters: int = len(LETTERS)) -> DataFrame:
    """(part, coalition, total, removed, good, toxic): what every set of filters removes together."""
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1)))
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    removed = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(0))
    return (
        failures.withColumn("coalition", every)
        .groupBy("part", "coalition")
        .agg(F.sum("n").alias("total"), removed("n").alias("removed"), removed("good").alias("good"), removed("toxic").alias("toxic"))
    )


def _solve(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Solution of a regular system in rationals, by elimination."""
    rows = [[*row, value] for row, value in zip(matrix, right)]
    for c in range(len(rows)):
        pivot = next(r for r in range(c, len(rows)) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(len(rows)):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [row[-1] for row in rows]


def shapley_values(removed: Sequence[int]) -> list[Fraction]:
    """Shapley values of a game given by its value per coalition (bit sets, the empty one worth 0)."""
    n = len(removed).bit_length() - 1
    whole = len(removed) - 1
    weight = {}
    for coalition in range(1, whole):
        size = coalition.bit_count()
        weight[coalition] = Fraction(n - 1, math.comb(n, size) * size * (n - size))
    has = lambda coalition, i: coalition >> i & 1
    normal = [[sum((w for c, w in weight.items() if has(c, i) and has(c, j)), Fraction()) for j in range(n)] for i in range(n)]
    right = [sum((w * removed[c] for c, w in weight.items() if has(c, i)), Fraction()) for i in range(n)]
    # The last row is the constraint, the last column its multiplier.
    matrix = [[*row, Fraction(1)] for row in normal] + [[Fraction(1)] * n + [Fraction(0)]]
    return _solve(matrix, [*right, Fraction(removed[whole])])[:n]


def _steps(letters: str, total: int, removed: list[int], good: list[int], toxic: list[int]) -> Iterator[tuple]:
    n, whole = len(letters), len(removed) - 1
    shares = [value * math.factorial(n) for value in shapley_values(removed)]
    for order in itertools.permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            yield (
                "".join(letters[k] for k in order), step, total - removed[after], here, removed[1 << i] - here,
                removed[whole] - removed[whole & ~(1 << i)], good[after] - good[before], toxic[after] - toxic[before], int(shares[i]),
            )
            before = after


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, in long counts.

    ``kept`` after the step; ``removed`` by it; ``redundant``: failing its filter but removed earlier;
    ``unique_fails``: failing its filter only; ``good_lost`` and ``toxic_lost`` removed by it;
    ``shapley``: what its filter removes summed over all orders.
    """
    table = coalition_removals(failure_sets(docs, labels, doc_id, text, part))

    def report(game: pd.DataFrame) -> pd.DataFrame:  # one row per coalition: 32
        game = game.sort_values("coalition")
        columns = [[int(v) for v in game[c]] for c in ("removed", "good", "toxic")]
        rows = [(game["part"].iloc[0], *row) for row in _steps(LETTERS, int(game["total"].iloc[0]), *columns)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return table.groupBy("part").applyInPandas(report, SCHEMA)
