"""Checks of bar series, resampling and table merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES, TF_MS, series

#: Ratios that a share split leaves in a series.
SPLITS = (2.0, 3.0, 4.0, 5.0, 0.5, 1 / 3, 0.25, 0.2)


def check(bars: DataFrame, outlier: float = 0.5) -> DataFrame:
    """Flags of each bar: bad values or geometry, zero volume, outlying return, split-like ratio, frozen tail.

    The tail is frozen while, from the end, volume is zero and the close doesn't change.
    """
    w = series()
    ratio = F.try_divide("close", F.lag("close").over(w))
    prices = ("open", "high", "low", "close")
    bad_number = sum((F.col(c).isNull() | F.isnan(c)).cast("int") for c in prices) > 0
    b = bars.withColumn("ratio", ratio).withColumns({
        "bad_number": bad_number,
        "non_positive": F.least(*prices) <= 0,
        "bad_geometry": (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")),
        "zero_volume": F.col("volume") == 0,
        "outlier": F.coalesce(F.abs(F.col("ratio") - 1) > outlier, F.lit(False)),
        "split_like": F.coalesce(F.exists(F.array(*map(F.lit, SPLITS)), lambda s: F.abs(F.col("ratio") / s - 1) <= 0.05), F.lit(False)),
        "_still": F.coalesce((F.col("volume") == 0) & (F.col("ratio") == 1), F.lit(False)),
    })
    back = Window.partitionBy(*SERIES).orderBy(F.desc("open_time")).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("frozen", F.min(F.col("_still").cast("int")).over(back) == 1).drop("ratio", "_still")


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean bars, and those with a hard fault."""
    hard = F.col("bad_number") | F.col("non_positive") | F.col("bad_geometry")
    return checked.where(~hard), checked.where(hard)


def resample(bars: DataFrame, timeframe: str = "4h", anchor_minutes: int = 90) -> DataFrame:
    """Bars of a longer timeframe, bins anchored so many minutes past midnight UTC (13:30 is 1:30 modulo four hours)."""
    ms, shift = TF_MS[timeframe], anchor_minutes * 60_000
    start = (F.floor((F.col("open_time") - shift) / ms) * ms + shift).cast("long")
    return bars.groupBy("symbol", F.lit(timeframe).alias("timeframe"), start.alias("bin")).agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("bin", "open_time")


def level_breaks(bars: DataFrame, gap_days: float = 4.0) -> DataFrame:
    """Neighbouring bars whose level breaks: ``gapped`` over a long gap beyond a factor of 1.25, ``large`` beyond 2."""
    w = series()
    b = bars.select(*SERIES, "open_time", "close", F.lag("open_time").over(w).alias("prev_time"), F.lag("close").over(w).alias("prev_close")).where("prev_close > 0 and close > 0")
    move = F.abs(F.ln(F.col("close") / F.col("prev_close")))
    kind = F.when(((F.col("open_time") - F.col("prev_time")) > gap_days * 86_400_000) & (move > F.ln(F.lit(1.25))), "gapped").when(move > F.ln(F.lit(2.0)), "large")
    return b.withColumn("kind", kind).where("kind is not null")


def session_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar days without a bar, between each series' first and last."""
    days = bars.select(*SERIES, F.to_date(F.timestamp_millis("open_time")).alias("session_date")).distinct()
    span = days.groupBy(*SERIES).agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    want = span.join(calendar, (F.col("session_date") >= F.col("lo")) & (F.col("session_date") <= F.col("hi"))).select(*SERIES, "session_date")
    return want.join(days, [*SERIES, "session_date"], "left_anti")


def slots(sessions: DataFrame, hours: int = 4, origin_minutes: int = 810, least_minutes: int = 60) -> DataFrame:
    """``sessions(session_date, open_ms, close_ms)`` to the bars of a grid that overlap each by an hour or more, as ``slot_ms``.

    The grid has a bar at 13:30 UTC.
    """
    step, day = hours * 3_600_000, F.expr("open_ms div 86400000 * 86400000")
    first = day + origin_minutes * 60_000 - step
    x = sessions.withColumn("slot_ms", F.explode(F.sequence(first, F.greatest(first, F.col("close_ms") - 1), F.lit(step).cast("long"))))
    return x.where(F.least(F.col("slot_ms") + step, F.col("close_ms")) - F.greatest("slot_ms", "open_ms") >= least_minutes * 60_000)


def slot_gaps(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Slots without a bar, within each series' first and last bar, in sessions that have one."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("open_time"), "America/New_York"))
    seen = bars.select(*SERIES, day.alias("session_date")).distinct()
    span = bars.groupBy(*SERIES).agg(F.min("open_time").alias("_lo"), F.max("open_time").alias("_hi"))
    want = seen.join(slots(sessions), "session_date").join(span, list(SERIES)).where("slot_ms between _lo and _hi").select(*SERIES, "session_date", F.col("slot_ms").alias("open_time"))
    return want.join(bars.select(*SERIES, "open_time"), [*SERIES, "open_time"], "left_anti")


def disagrees(close: Column, quote: Column, factor: float = 1.25) -> Column:
    """Whether a close and a quote differ by more than a factor."""
    return F.abs(F.ln(close / quote)) > F.ln(F.lit(factor))


def seams(stored: DataFrame, page: DataFrame, basis: float = 0.01) -> DataFrame:
    """Where a page of bars meets what is stored: the newest stored bar before it and its first bar, and, where both have a
    bar, whether the basis of the closes changed."""
    first = page.groupBy(*SERIES).agg(F.min("open_time").alias("page_from"), F.min_by("close", "open_time").alias("page_close"))
    before = stored.join(first, list(SERIES)).where("open_time < page_from").groupBy(*SERIES).agg(F.max("open_time").alias("stored_to"), F.max_by("close", "open_time").alias("stored_close"))
    both = stored.select(*SERIES, "open_time", F.col("close").alias("_old")).join(page.select(*SERIES, "open_time", F.col("close").alias("_new")), [*SERIES, "open_time"])
    moved = both.groupBy(*SERIES).agg(F.count("*").alias("n_both"), F.max((F.abs(F.col("_new") / F.col("_old") - 1) > basis)).alias("basis_changed"))
    return first.join(before, list(SERIES), "left").join(moved, list(SERIES), "left").withColumns({"n_both": F.coalesce("n_both", F.lit(0)), "basis_changed": F.coalesce("basis_changed", F.lit(False))})


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the new ones in place of those of equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, and the new ones of other keys: the first write wins."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def merge_outcomes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge in which a null never erases what is known."""
    a, b = old.alias("a"), new.alias("b")
    cols = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) for c in old.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*cols)


def prune(rows: DataFrame, keys: list[str], order: Column, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= keep).drop("_n")
