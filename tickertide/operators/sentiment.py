"""Sentiment of articles and days, and features accumulated over sentiment days."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tickertide.functions.columns import clip, leading_date, trim_space
from tickertide.operators.series import ROWS_PER_BLOCK, null_safe_join, over_blocks, read_all, with_positions

SPANS = (3, 5, 10, 20)  # fixed values: default window lengths in rows
STRONG = 0.3
LEAST_WEIGHT = 1e-100  # inside a stretch; its inverse times a value must fit a double

# Columns that become zero on days without news, and name parts of those carried on.
ZERO_FILLED = [
    "daily_sentiment", "n_articles", "sentiment_momentum", "sentiment_acceleration",
    "sentiment_surprise", "news_spike", "has_news", "strong_sentiment", "sentiment_std",
    "sentiment_strength", "daily_confidence",
]
CARRIED_PARTS = ("cum_", "ma_", "ewm_", "intensity", "vol_")


def article_sentiment(articles: DataFrame, scored: DataFrame) -> DataFrame:
    """Mean sentence weight per article; an article without sentences gets (0.0, 0)."""
    means = scored.groupBy("article_index").agg(
        F.avg("weight").alias("_mean"), F.count("*").alias("_n")
    )
    return articles.select("article_index").join(means, "article_index", "left").select(
        "article_index",
        F.coalesce("_mean", F.lit(0.0)).alias("sentiment"),
        F.coalesce("_n", F.lit(0)).cast("int").alias("num_sentences"),
    )


def attach_sentiment(urls: DataFrame, scores: DataFrame) -> DataFrame:
    return urls.join(
        scores.select("article_index", "sentiment", "num_sentences"), "article_index", "left"
    )


def not_yet_scored(articles: DataFrame, scores: DataFrame) -> DataFrame:
    return articles.join(scores.select("article_index"), "article_index", "left_anti")


def daily_sentiment(urls: DataFrame) -> DataFrame:
    """Mean sentiment and article count per ticker and UTC date.

    The date is the first ten characters of the date text. A ticker holding most articles is
    reduced to one partial row per task and day before the shuffle.
    """
    pairs = (
        urls.filter(F.col("sentiment").isNotNull())
        .select(
            F.explode("tickers").alias("ticker"), leading_date("date_raw").alias("date"), "sentiment"
        )
        .withColumn("ticker", F.upper(trim_space("ticker")))
        .filter((F.col("ticker") != "") & F.col("date").isNotNull())
    )
    return pairs.groupBy("ticker", "date").agg(
        F.avg("sentiment").alias("daily_sentiment"), F.count("*").alias("n_articles")
    )


def with_article_counts(daily: DataFrame) -> DataFrame:
    """Default article count where the column is missing: one if there is any sentiment."""
    if "n_articles" in daily.columns:
        return daily
    return daily.withColumn("n_articles", (F.col("daily_sentiment") != 0).cast("int"))


def _ratio(span: int) -> float:
    """Share of its weight that a value keeps from one row to the next."""
    return 1.0 - 2.0 / (span + 1)


def stretch_length(spans: Sequence[int]) -> int:
    """Rows of a stretch: so many that no weight in it falls below ``LEAST_WEIGHT``."""
    ratios = [_ratio(k) for k in spans if _ratio(k) > 0]
    rows = [math.floor(math.log(LEAST_WEIGHT) / math.log(q)) for q in ratios]
    return max(1, min([ROWS_PER_BLOCK, *rows]))


def _carried_sums(base: DataFrame, value: str, spans: Sequence[int], length: int) -> DataFrame:
    """Per ticker and stretch the weighted sum of all rows before it (``_carry_<span>``).

    A stretch maps the sum before it to q^length times that sum plus its own. Maps of neighbouring
    stretches compose, so the sums of 1, 2, 4, ... stretches follow by doubling, each from the one
    before, until the weight of what is still to be added is zero in a double.
    """
    place = (F.col("pos") - 1) % length
    own = {k: F.sum(F.col(value) * F.pow(F.lit(_ratio(k)), (length - 1 - place).cast("double"))) for k in spans}
    # Every column is read, so that the sums are taken from the shuffle that the rows come from.
    sums = base.groupBy("ticker", "_stretch").agg(*[own[k].alias(f"_carry_{k}") for k in spans], read_all(base).alias("_read"))
    sums = sums.filter(F.col("_read").isNotNull()).drop("_read")
    w = Window.partitionBy("ticker").orderBy("_stretch")
    zero = F.lit(0.0)
    sums = sums.withColumns({f"_carry_{k}": F.coalesce(F.lag(f"_carry_{k}").over(w), zero) for k in spans})
    reach = 1
    while any(_ratio(k) ** (length * reach) > 0.0 for k in spans):
        older = {k: F.coalesce(F.lag(f"_carry_{k}", reach).over(w), zero) for k in spans}
        sums = sums.withColumns(
            {f"_carry_{k}": F.col(f"_carry_{k}") + F.lit(_ratio(k) ** (length * reach)) * older[k] for k in spans}
        )
        reach *= 2
    return sums


def _add_ewm(df: DataFrame, partition: Sequence[str], value: str, spans: Sequence[int], length: int) -> DataFrame:
    """Bias-adjusted exponentially weighted means, in time linear in the rows and without a cut-off.

    Inside a stretch the weighted sum is a running sum of values scaled up by q^-place; with the carried
    sum of the rows before it is scaled back down by ``_fade_<span>``, q^place over the sum of all weights,
    which has a closed form. Powers are columns below the window: a projection above it that holds them
    besides all other columns grows beyond what the JVM compiles.
    """
    place, pos = ((F.col("pos") - 1) % length).cast("double"), F.col("pos").cast("double")
    inside = Window.partitionBy(*partition, "_stretch").orderBy("pos")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    means, powers = {}, {}
    for k in spans:
        q = _ratio(k)
        if q == 0.0:  # span 1: only the value itself has weight
            means[f"sentiment_ewm_{k}d"] = F.col(value)
            continue
        down = F.pow(F.lit(q), place)
        powers |= {f"_up_{k}": F.col(value) / down, f"_fade_{k}": down * (1 - q) / (1 - F.pow(F.lit(q), pos))}
        total = F.sum(f"_up_{k}").over(inside) + q * F.col(f"_carry_{k}")
        means[f"sentiment_ewm_{k}d"] = F.col(f"_fade_{k}") * total
    return df.withColumns(powers).withColumns(means).drop(*powers)


def cumulative_features(
    daily: DataFrame, spans: Sequence[int] = SPANS, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Rolling and exponential sentiment features; frames count sentiment days, not calendar days.

    The 5-row sum and 20-row mean behind momentum and surprise do not depend on ``spans``.
    """
    base = with_positions(
        with_article_counts(daily).withColumn("daily_sentiment", F.coalesce("daily_sentiment", F.lit(0.0))), shared=True
    )
    s, n = F.col("daily_sentiment"), F.col("n_articles").cast("double")
    zero = F.lit(0.0)

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        def last(rows: int) -> WindowSpec:
            return w.rowsBetween(-(rows - 1), 0)

        cols: dict[str, Column] = {"sentiment_strength": F.abs(s) * F.log1p(n)}
        for k in spans:
            cols[f"sentiment_cum_{k}d"] = F.sum(s).over(last(k))
            cols[f"news_intensity_{k}d"] = F.sum("n_articles").over(last(k))
            cols[f"sentiment_vol_{k}d"] = F.coalesce(F.stddev_samp(s).over(last(k)), zero)
        sd = F.stddev_samp(n).over(last(20))
        for k in {5, 20}.difference(spans):
            cols[f"sentiment_cum_{k}d"] = F.sum(s).over(last(k))
        cols["news_spike"] = clip(
            (n - F.avg(n).over(last(20))) / F.coalesce(F.nullif(sd, zero), F.lit(1.0)), -3.0, 3.0
        )
        cols["has_news"] = (n > 0).cast("int")
        cols["strong_sentiment"] = (F.abs(s) > STRONG).cast("int")
        df = df.withColumns(cols)
        # Sentiment has no nulls, so a mean is the sum over the rows there are.
        mean = lambda k: F.col(f"sentiment_cum_{k}d") / F.least(F.col("pos"), F.lit(k))
        means = {f"sentiment_ma_{k}d": mean(k) for k in spans}
        step = F.col("sentiment_cum_5d") - F.lag("sentiment_cum_5d", 1).over(w)
        df = df.withColumns({**means, "sentiment_surprise": s - mean(20), "_step": step})
        df = df.withColumns(
            {
                "sentiment_momentum": F.coalesce("_step", zero),
                "sentiment_acceleration": F.coalesce(F.col("_step") - F.lag("_step", 1).over(w), zero),
            }
        )
        if spans:
            df = _add_ewm(df, ["ticker", "_block"], "daily_sentiment", spans, length)
        return df.drop("_step", *[f"sentiment_cum_{k}d" for k in {5, 20}.difference(spans)])

    reach, length = max(22, *spans), stretch_length(spans)
    faded = [k for k in spans if _ratio(k) > 0]
    if faded:
        base = base.withColumn("_stretch", F.floor((F.col("pos") - 1) / F.lit(length)).cast("bigint"))
        base = null_safe_join(base, _carried_sums(base, "daily_sentiment", faded, length), ["ticker", "_stretch"])
    # Blocks are whole stretches, so each begins with a carried sum.
    size = math.ceil(max(rows_per_block, reach) / length) * length
    out = over_blocks(base, compute, before=reach, rows_per_block=size)
    return out.drop("pos", "n_rows", "_stretch", *[f"_carry_{k}" for k in faded])


def combine_with_bars(
    bars: DataFrame, features: DataFrame, daily: DataFrame | None = None, positions: bool = False
) -> DataFrame:
    """Bars with cumulative features: running ones are carried over gaps, the others become zero.

    What is carried is only the date of the last bar that had news, so the features are fetched by
    that date. The dates come from ``daily``, the table the features were made of, if it is given;
    the features are then computed once. Features must be free of nulls (see ``cumulative_features``).
    ``positions`` keeps the place of a bar in its ticker as ``pos``.
    """
    upper = bars.withColumn("ticker", F.upper("ticker"))
    news = features.withColumn("ticker", F.upper("ticker"))
    carried = [c for c in news.columns if any(part in c for part in CARRIED_PARTS)]
    zeroed = [c for c in news.columns if c in ZERO_FILLED]
    # NaN is filled below the join, so that above it only what found no partner is left to fill.
    news = news.fillna(0, subset=[*carried, *zeroed])
    zero = {c: F.lit(0).cast(kind) if kind not in ("string", "boolean") else F.lit(None).cast(kind) for c, kind in news.dtypes}
    dated = news if daily is None else daily.withColumn("ticker", F.upper("ticker"))
    days = dated.select("ticker", "date", F.col("date").alias("_news"))
    marked = with_positions(upper.join(days, ["ticker", "date"], "left"), ["_news"], shared=True)
    # Compared below the join, once for all columns.
    marked = marked.withColumn("_fresh", F.coalesce(F.col("_news") == F.col("date"), F.lit(False)))
    fetched = marked.join(news.withColumnRenamed("date", "_news"), ["ticker", "_news"], "left")
    filled = {c: F.coalesce(F.col(c), zero[c]) for c in carried}
    filled |= {c: F.coalesce(F.when(F.col("_fresh"), F.col(c)), zero[c]) for c in zeroed}
    out = fetched.withColumns(filled).drop("_news", "_fresh", "n_rows")
    return out if positions else out.drop("pos")


def news_coverage(combined: DataFrame) -> DataFrame:
    """Share of bars with news, in percent, per ticker."""
    return combined.groupBy("ticker").agg(
        F.count("*").alias("n_rows"),
        (F.avg((F.col("n_articles") > 0).cast("double")) * 100).alias("coverage_pct"),
    )
