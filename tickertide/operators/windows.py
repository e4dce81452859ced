"""Sliding windows over feature rows, time splits and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import WindowSpec

from tickertide.functions.columns import any_null, ratio
from tickertide.operators.features import FEATURES, LOOKBACK, positioned_bars, price_features, target
from tickertide.operators.series import ROWS_PER_BLOCK, dense_index, over_blocks

# Named feature sets and the columns taken relative to the window start.
FEATURE_SETS = {
    "price_only": ["close"],
    "price_volume": ["close", "volume"],
    "price_volume_sentiment": ["close", "volume", "daily_sentiment"],
    "all_features": ["close", "volume", "daily_sentiment", "n_articles"],
    "sentiment_only": ["close", "daily_sentiment"],
}
RELATIVE = ("close", "volume")
ARTICLE_SCALE = 10.0
TINY = 1e-8
ROUNDING = 2.0**-44  # the last bits of a double


def feature_set(name: str) -> list[str]:
    if name not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {name!r}, choose from {sorted(FEATURE_SETS)}")
    return FEATURE_SETS[name]


def resolve_columns(df: DataFrame, wanted: Sequence[str], price: str = "close") -> list[str]:
    """The wanted columns that exist, ignoring case; the price column must be among them."""
    by_lower = {c.lower(): c for c in df.columns}
    found = [by_lower[c.lower()] for c in wanted if c.lower() in by_lower]
    if price.lower() not in (c.lower() for c in found):
        raise ValueError(f"price column {price!r} is missing; found {found}")
    return found


def project_features(df: DataFrame, wanted: Sequence[str], price: str = "close") -> DataFrame:
    return df.select("ticker", "date", *resolve_columns(df, wanted, price))


# ---- windows of features ----------------------------------------------------

def _stack(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def stack_windows(df: DataFrame, w: WindowSpec, seq_len: int, columns: Sequence[str]) -> DataFrame:
    """Add ``x``, the last ``seq_len`` feature rows, and ``complete``: enough rows and no null.

    The flag does not depend on ``x``, so plans that only need to know which windows exist do
    not stack them.
    """
    frame = w.rowsBetween(-(seq_len - 1), 0)
    complete = (F.count("*").over(frame) == seq_len) & (
        F.max(any_null(columns).cast("int")).over(frame) == 0
    )
    return df.withColumns({"x": F.collect_list(_stack(columns)).over(frame), "complete": complete})


def sliding_windows(
    bars: DataFrame,
    sentiment: DataFrame,
    seq_len: int,
    columns: Sequence[str] = tuple(FEATURES),
    target_kind: str = "return",
    fill: str = "ffill",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One window per bar that ends a full run of ``seq_len`` bars and has a next-day target.

    Features, target and windows are computed in one pass over the same blocks, so the rows
    are shuffled once for all of them. Bars must have a close (see ``clean_rows``).
    """
    if seq_len < 1:
        raise ValueError("seq_len must be at least 1")
    base = positioned_bars(bars.filter(F.col("close").isNotNull()), sentiment, fill)

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        return stack_windows(target(price_features(df, w), w, target_kind), w, seq_len, columns)

    out = over_blocks(base, compute, LOOKBACK + seq_len - 1, 1, rows_per_block=rows_per_block)
    return out.filter(F.col("complete") & F.col("target").isNotNull()).select(
        "ticker",
        "date",
        "x",
        F.col("target").alias("y"),
        F.col("return").alias("last_return"),
        F.col("close").alias("last_close"),
    )


def validation_start(dates: DataFrame, train_years: tuple[int, int], val_months: int = 12) -> Column:
    """The first day of the last months present in the train years, pooled over tickers."""
    if val_months < 1:
        raise ValueError("val_months must be at least 1")
    months = dates.filter(F.year("date").between(*train_years)).select(F.trunc("date", "MM").alias("month")).distinct()
    last = months.orderBy(F.desc("month")).limit(val_months)
    return last.agg(F.min("month")).scalar()


def calendar_split(
    windows: DataFrame,
    train_years: tuple[int, int],
    test_years: tuple[int, int],
    val_months: int = 12,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Add ``split``: test by year; validation is the last months present in the train years.

    The months are those of ``dates``, by default of the windows themselves. Being the last ones,
    they are cut off by one date.
    """
    year, month = F.year("date"), F.trunc("date", "MM")
    in_train = year.between(*train_years)
    cut = validation_start(windows if dates is None else dates, train_years, val_months)
    split = (
        F.when(year.between(*test_years), "test")
        .when(in_train & (month >= cut), "val")
        .when(in_train, "train")
    )
    return windows.withColumn("split", split).filter(F.col("split").isNotNull())


def split_sizes(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split").agg(F.count("*").alias("n"))


# ---- scaling -----------------------------------------------------------------

def _scale(value: Column) -> Column:
    """Population deviation; 1 for a feature with one value but for rounding, whatever the number of rows."""
    low, high = F.min(value), F.max(value)
    rounding = F.greatest(F.abs(low), F.abs(high)) * ROUNDING
    return F.when(high - low <= rounding, 1.0).otherwise(F.stddev_pop(value))


def scaler_records(scalers: DataFrame, names: Sequence[str]) -> DataFrame:
    """Scalers as plain (ticker, feature, mean, scale) rows; a null ticker is the global one."""
    labels = F.array(*[F.lit(n) for n in names])
    zipped = F.arrays_zip(labels.alias("feature"), F.col("mean"), F.col("scale"))
    return scalers.select("ticker", F.explode(zipped).alias("r")).select(
        "ticker", F.col("r.feature"), F.col("r.mean"), F.col("r.scale")
    )


def fit_target_scalers(windows: DataFrame) -> DataFrame:
    train = windows.filter(F.col("split") == "train")
    return train.groupBy("ticker").agg(
        F.avg("y").alias("y_mean"), _scale(F.col("y")).alias("y_scale")
    )


def scale_targets(windows: DataFrame, scalers: DataFrame) -> DataFrame:
    """Add ``y_scaled``; tickers absent from train keep the raw target."""
    joined = windows.join(scalers, "ticker", "left")
    value = F.coalesce((F.col("y") - F.col("y_mean")) / F.col("y_scale"), F.col("y"))
    return joined.withColumn("y_scaled", value).drop("y_mean", "y_scale")


def unscale(df: DataFrame, scalers: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Undo target scaling per ticker; raw where the ticker has no scaler."""
    joined = df.join(scalers, "ticker", "left")
    back = {c: F.coalesce(F.col(c) * F.col("y_scale") + F.col("y_mean"), F.col(c)) for c in columns}
    return joined.withColumns(back).drop("y_mean", "y_scale")


def unscale_with(df: DataFrame, mean: float, scale: float, columns: Sequence[str]) -> DataFrame:
    """Undo one scaler for all rows."""
    return df.withColumns({c: F.col(c) * scale + mean for c in columns})


SMALL_INDEX = 1_000_000  # tickers whose index may be broadcast


def ticker_index(windows: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Add ``ticker_idx``: 0-based alphabetical index over all splits.

    ``index`` is a stored (ticker, ticker_idx); of up to ``SMALL_INDEX`` tickers it is broadcast, so that
    no row is shuffled for it however often it is read.
    """
    if index is None:
        return windows.join(dense_index(windows, "ticker", "ticker_idx"), "ticker")
    small = index.limit(SMALL_INDEX + 1).count() <= SMALL_INDEX
    return windows.join(F.broadcast(index) if small else index, "ticker")


def target_statistics(windows: DataFrame) -> DataFrame:
    """Mean and deviation of raw and scaled targets per split."""
    aggs = [F.count("*").alias("n")]
    for c in ("y", "y_scaled"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return windows.groupBy("split").agg(*aggs)


# ---- windows relative to their start --------------------------------------------

def fill_news_gaps(df: DataFrame) -> DataFrame:
    """No news counts as zero sentiment and zero articles."""
    present = [c for c in ("daily_sentiment", "n_articles") if c in df.columns]
    return df.fillna(0, subset=present)


def positional_split(df: DataFrame, train: float = 0.70, val: float = 0.85) -> DataFrame:
    """Add ``split`` by position in the series, ``split_pos`` and the rows of the split.

    Expects ``pos`` and ``n_rows``. Windows are cut after this, so none crosses a border.
    """
    cut1 = F.floor(F.lit(train) * F.col("n_rows"))
    cut2 = F.floor(F.lit(val) * F.col("n_rows"))
    p = F.col("pos")
    split = F.when(p <= cut1, "train").when(p <= cut2, "val").otherwise("test")
    start = F.when(p <= cut1, F.lit(0)).when(p <= cut2, cut1).otherwise(cut2)
    return df.withColumns({"split": split, "split_pos": (p - start).cast("bigint")})


def relative_value(value: Column, start: Column, name: str) -> Column:
    """A value relative to that of the first row: value/first - 1 for price and volume.

    Article counts are divided by a fixed scale, other columns stay as they are.
    """
    if name in RELATIVE:
        return value / F.when(F.abs(start) < TINY, TINY).otherwise(start) - 1
    return value / ARTICLE_SCALE if name == "n_articles" else value


def relative_steps(x: Column, columns: Sequence[str]) -> Column:
    """Each step of a window relative to the row it begins at (see ``relative_value``).

    ``x`` lists the ``columns`` of the row itself and of rows behind it. Columns are addressed by
    name, so a missing feature cannot shift the others.
    """
    cell = lambda step, i, c: relative_value(F.element_at(step, i + 1), F.col(c).cast("double"), c)
    return F.transform(x, lambda step: F.array(*[cell(step, i, c) for i, c in enumerate(columns)]))


def _cut_windows(
    df: DataFrame, seq_len: int, horizons: Sequence[int], columns: Sequence[str], rows_per_block: int
) -> DataFrame:
    """Windows per split with their last price and the prices at each horizon (``_ahead``).

    ``last_move`` is the first cell of the last step of ``x``. Neither it nor the choice of rows depends
    on ``x``, so plans that need no other cell do not stack the steps.
    """
    names = resolve_columns(df, columns)
    reach = seq_len - 1 + max(horizons)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(0, seq_len - 1)
        whole = (F.count("*").over(frame) == seq_len) & (F.count("close").over(frame) == seq_len)
        # The last price comes before the last row, which x leaves out; a window of one row has no step.
        before_last = F.lead(names[0], seq_len - 2).over(w).cast("double") if seq_len > 1 else F.lit(None).cast("double")
        return rows.withColumns(
            {
                "_x": F.collect_list(_stack(names)).over(frame),
                "_whole": whole,
                "_before_last": before_last,
                "last_price": F.lead("close", seq_len - 1).over(w),
                "_ahead": F.array(*[F.lead("close", seq_len - 1 + h).over(w) for h in horizons]),
            }
        )

    out = over_blocks(fill_news_gaps(df), compute, 0, reach, ["ticker", "split"], "split_pos", rows_per_block)
    return out.filter("_whole").select(
        "ticker",
        "split",
        "split_pos",
        "date",
        relative_steps(F.slice("_x", 1, seq_len - 1), names).alias("x"),
        relative_value(F.col("_before_last"), F.col(names[0]).cast("double"), names[0]).alias("last_move"),
        F.col("close").alias("y_base"),
        "last_price",
        "_ahead",
    )


ALL_COLUMNS = tuple(FEATURE_SETS["all_features"])


def horizon_windows(
    df: DataFrame,
    seq_len: int,
    horizon: int = 1,
    columns: Sequence[str] = ALL_COLUMNS,
    task: str = "price",
    threshold: float = 0.0,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Windows of ``seq_len`` rows and a target ``horizon`` rows after their end, per split.

    ``x`` leaves out the last step, while target and direction use the true last price.
    Expects the output of ``positional_split``.
    """
    if task not in ("price", "direction"):
        raise ValueError("task must be 'price' or 'direction'")
    out = _cut_windows(df, seq_len, [horizon], columns, rows_per_block)
    out = out.withColumn("target_price", F.element_at("_ahead", 1)).drop("_ahead")
    out = out.filter(F.col("target_price").isNotNull())
    if task == "price":
        return out.withColumn("y", ratio(F.col("target_price"), F.col("y_base")) - 1)
    change = ratio(F.col("target_price") - F.col("last_price"), F.col("last_price"))
    moved = out.filter(F.abs(change) >= threshold)
    return moved.withColumn("y", F.when(change > 0, 1.0).otherwise(0.0))


def many_horizons(
    df: DataFrame,
    seq_len: int,
    horizons: Sequence[int],
    columns: Sequence[str] = ALL_COLUMNS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Price windows for several horizons at once: cut in one pass, then one row per horizon."""
    out = _cut_windows(df, seq_len, horizons, columns, rows_per_block)
    pairs = F.arrays_zip(F.array(*[F.lit(h) for h in horizons]).alias("h"), F.col("_ahead").alias("p"))
    rows = out.withColumn("_t", F.explode(pairs))
    rows = rows.withColumns({"horizon": F.col("_t.h"), "target_price": F.col("_t.p")}).drop("_t", "_ahead")
    rows = rows.filter(F.col("target_price").isNotNull())
    return rows.withColumn("y", ratio(F.col("target_price"), F.col("y_base")) - 1)


def length_windows(
    df: DataFrame,
    seq_lens: Sequence[int],
    horizon: int = 1,
    columns: Sequence[str] = ALL_COLUMNS,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Price windows of several lengths at once, with their ``seq_len``.

    A shorter window is the beginning of a longer one, so all are cut in one pass. A window has
    ``seq_len`` - 1 steps relative to its first row, like those of ``horizon_windows``.
    """
    if min(seq_lens) < 2:
        raise ValueError("windows have at least two rows")
    names = resolve_columns(df, columns)
    longest = max(seq_lens)

    def compute(rows: DataFrame, w: WindowSpec) -> DataFrame:
        def end(n: int) -> Column:
            whole = F.count("close").over(w.rowsBetween(0, n - 1)) == n
            price = F.lead("close", n - 1 + horizon).over(w)
            return F.struct(F.lit(n).alias("seq_len"), whole.alias("whole"), price.alias("price"))

        steps = F.collect_list(_stack(names)).over(w.rowsBetween(0, longest - 1))
        return rows.withColumns({"_steps": steps, "_ends": F.array(*[end(n) for n in seq_lens])})

    reach = longest - 1 + horizon
    out = over_blocks(fill_news_gaps(df), compute, 0, reach, ["ticker", "split"], "split_pos", rows_per_block)
    kept = F.filter("_ends", lambda e: e["whole"] & e["price"].isNotNull())
    out = out.withColumns({"_x": relative_steps(F.col("_steps"), names), "_e": F.explode(kept)})
    price = F.col("_e.price")
    return out.select(
        "ticker",
        "split",
        "split_pos",
        "date",
        "_e.seq_len",
        F.slice("_x", F.lit(1), F.col("_e.seq_len") - 1).alias("x"),
        F.col("close").alias("y_base"),
        price.alias("target_price"),
        (ratio(price, F.col("close")) - 1).alias("y"),
    )


def denormalise(y: Column, base: Column) -> Column:
    return (y + 1) * base


def class_distribution(windows: DataFrame) -> DataFrame:
    """Class counts, balanced weights total/(2*n) and the majority accuracy."""
    up, down = F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)
    return windows.agg(up.alias("n_up"), down.alias("n_down")).select(
        "n_up",
        "n_down",
        *[
            F.when(F.col(c) > 0, (F.col("n_up") + F.col("n_down")) / (2 * F.nullif(F.col(c), F.lit(0))))
            .otherwise(1.0)
            .alias(name)
            for c, name in (("n_down", "weight_down"), ("n_up", "weight_up"))
        ],
        (
            F.greatest("n_up", "n_down") / F.nullif(F.col("n_up") + F.col("n_down"), F.lit(0))
        ).alias("majority_accuracy"),
    )
