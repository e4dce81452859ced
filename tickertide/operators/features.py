"""Price features per bar, all looking back only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import WindowSpec

from tickertide.functions.columns import ratio
from tickertide.operators.series import ROWS_PER_BLOCK, over_blocks, with_positions

# Default features, in the order of the window vectors.
FEATURES = [
    "return", "log_volume", "intraday_range", "volatility_5", "ma_5", "ma_20", "rsi_14", "bb_upper",
    "bb_lower", "roc_10", "momentum_5", "momentum_10", "volume_spike", "daily_sentiment", "n_articles",
]
# Rows a feature reaches back: 20 earlier bars, whose returns need one more.
LOOKBACK = 21
SENTIMENT_FILLS = ("ffill", "zero")


def join_sentiment(bars: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Bars with the sentiment of the same ticker (case-sensitive) and day, null where none.

    Sentiment of non-trading days matches no bar and is lost.
    """
    news = sentiment.select("ticker", "date", "daily_sentiment", "n_articles")
    return bars.join(news, ["ticker", "date"], "left")


def price_features(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Add the thirteen price and volume features over an ordered window."""

    def past(rows: int) -> WindowSpec:
        return w.rowsBetween(-rows, -1)

    # A window expression named twice is computed twice: each one is a column, used by name.
    zero = F.lit(0.0)
    volume = F.col("volume").cast("double")
    df = df.withColumns({"_last": F.lag("close", 1).over(w), "_volume": volume})
    step, first = F.col("close") - F.col("_last"), F.col("return").isNull()
    df = df.withColumn("return", ratio(F.col("close"), F.col("_last")) - 1)
    # greatest() skips nulls, so the first bar needs its gain and loss removed again.
    df = df.withColumns({"_gain": F.when(~first, F.greatest(step, zero)), "_loss": F.when(~first, F.greatest(-step, zero))})
    df = df.withColumns(
        {
            "_gains": F.avg("_gain").over(past(14)),
            "_losses": F.avg("_loss").over(past(14)),
            "_deviation": F.stddev_samp("close").over(past(20)),
            "_usual": F.avg("_volume").over(past(20)),
            "_returns": F.stddev_samp("return").over(past(5)),
            "_last6": F.lag("close", 6).over(w),
            "_last11": F.lag("close", 11).over(w),
            "ma_5": F.avg("close").over(past(5)),
            "ma_20": F.avg("close").over(past(20)),
        }
    )
    strength = ratio(F.col("_gains"), F.col("_losses"))
    spread = 2 * F.coalesce("_deviation", zero)
    change = lambda far: F.coalesce(ratio(F.col("_last"), F.col(far)) - 1, zero)
    return df.withColumns(
        {
            "log_volume": F.log1p(volume),
            "intraday_range": F.when(
                F.col("close") > 0, (F.col("high") - F.col("low")) / F.nullif(F.col("close"), zero)
            ).otherwise(0.0),
            "volatility_5": F.coalesce("_returns", zero),
            # No loss in the frame gives the neutral 50, not 100.
            "rsi_14": F.coalesce(100 - 100 / (1 + strength), F.lit(50.0)),
            "bb_upper": F.col("ma_20") + spread,
            "bb_lower": F.col("ma_20") - spread,
            "roc_10": change("_last11"),
            "momentum_5": change("_last6"),
            "momentum_10": change("_last11"),
            "volume_spike": F.coalesce((volume > 1.5 * F.col("_usual")).cast("double"), zero),
        }
    ).drop("_last", "_volume", "_gain", "_loss", "_gains", "_losses", "_deviation", "_usual", "_returns", "_last6", "_last11")


def positioned_bars(bars: DataFrame, sentiment: DataFrame, fill: str = "ffill", shared: bool = False) -> DataFrame:
    """Bars joined with sentiment and numbered per ticker: the input of block operators.

    Gaps in sentiment take the last value seen (``ffill``, then zero) or zero; missing article
    counts become zero. ``shared`` as in ``with_positions``.
    """
    if fill not in SENTIMENT_FILLS:
        raise ValueError(f"fill must be one of {SENTIMENT_FILLS}, got {fill!r}")
    if fill == "ffill":
        numbered = with_positions(join_sentiment(bars, sentiment), ["daily_sentiment"], shared=shared)
    else:
        # Nothing to carry: number the bars alone, so counting them needs no join.
        numbered = join_sentiment(with_positions(bars), sentiment)
    return numbered.withColumns(
        {
            "daily_sentiment": F.coalesce("daily_sentiment", F.lit(0.0)),
            "n_articles": F.coalesce("n_articles", F.lit(0)).cast("int"),
        }
    )


def target(df: DataFrame, w: WindowSpec, kind: str = "return") -> DataFrame:
    """Next day's return or close; null on the last bar."""
    following = F.lead("close", 1).over(w)
    if kind == "return":
        value = ratio(following, F.col("close")) - 1
    elif kind == "close":
        value = following
    else:
        raise ValueError(f"target must be 'return' or 'close', got {kind!r}")
    return df.withColumn("target", value)


def feature_table(
    bars: DataFrame,
    sentiment: DataFrame,
    fill: str = "ffill",
    target_kind: str | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """All features per bar; with ``target_kind`` also the target, rows without one dropped."""
    base = positioned_bars(bars, sentiment, fill)

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        out = price_features(df, w)
        return target(out, w, target_kind) if target_kind else out

    out = over_blocks(base, compute, before=LOOKBACK, after=1, rows_per_block=rows_per_block)
    return out.filter(F.col("target").isNotNull()) if target_kind else out
