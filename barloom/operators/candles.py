"""Candle warnings at a signal's bar, and what they are worth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.resampling import audit_cells, lift_interval
from ..sources.tables import DAY_MS, SERIES, series

NAMES = ("w1_marubozu", "w2_equal_levels", "w5_wick_rejection", "w6_consecutive", "w7_doji", "w8_inside_bar")
WICK, BODY, REJECTION, EQUAL = 0.10, 0.10, 0.40, 0.0015
LEVEL_BARS, RUN = 10, 3


def candle_warnings(bars: DataFrame) -> DataFrame:
    """``symbol, timeframe, open_time, direction`` with six flags, a row for each bar after a series' first and each direction.

    A doji (a small body) is neither a marubozu (no wicks to speak of) nor a rejecting wick. Equal levels are two of the ten lows
    before that lie under the close (highs over it, for shorts) and close together: sorted, the closest two are neighbours.
    Consecutive are three closed in the signal's direction, this one included. Inside bars stay within the one before.
    """
    past = series().rowsBetween(-LEVEL_BARS, -1)
    run = series().rowsBetween(1 - RUN, 0)
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, size = F.abs(c - o), h - lo
    up, down = h - F.greatest(o, c), F.least(o, c) - lo
    b = bars.withColumns({
        "_high": F.lag("high").over(series()), "_low": F.lag("low").over(series()), "_lows": F.collect_list("low").over(past), "_highs": F.collect_list("high").over(past),
        "_up": F.sum((c > o).cast("int")).over(run), "_down": F.sum((c < o).cast("int")).over(run),
    }).where("_high is not null")
    b = b.withColumn("w7_doji", F.coalesce((size != 0) & (body <= BODY * size), F.lit(False)))
    marubozu = (body != 0) & (up <= WICK * body) & (down <= WICK * body)
    b = b.withColumns({"w1_marubozu": ~F.col("w7_doji") & marubozu, "w8_inside_bar": (h <= F.col("_high")) & (lo >= F.col("_low"))})
    near = f"exists(sequence(0, size(v) - 2), i -> v[i + 1] - v[i] <= close * {EQUAL}D)"
    equal = lambda levels, side: F.expr(f"transform(array(array_sort(filter({levels}, x -> x {side} close))), v -> if(size(v) < 2, false, {near}))[0]")
    sides = F.array(
        F.struct(F.lit("long").alias("direction"), equal("_lows", "<").alias("w2_equal_levels"), (up > REJECTION * size).alias("wick"), (F.col("_up") == RUN).alias("w6_consecutive")),
        F.struct(F.lit("short").alias("direction"), equal("_highs", ">").alias("w2_equal_levels"), (down > REJECTION * size).alias("wick"), (F.col("_down") == RUN).alias("w6_consecutive")),
    )
    b = b.withColumn("_size", size).select(*SERIES, "open_time", "_size", "w1_marubozu", "w7_doji", "w8_inside_bar", F.inline(sides))
    return b.withColumn("w5_wick_rejection", ~F.col("w7_doji") & (F.col("_size") != 0) & F.col("wick")).select(*SERIES, "open_time", "direction", *NAMES)


def tag(trades: DataFrame, bars: DataFrame, at: str = "signal_time") -> DataFrame:
    """Trades with the six flags of the bar they were signalled at; those without such a bar, or without one before it, are left out."""
    w = candle_warnings(bars).withColumnRenamed("open_time", at)
    return trades.join(w, [*SERIES, at, "direction"])


def warning_cells(trades: DataFrame, bars: DataFrame, row_id: str, at: str = "signal_time", value: str = "pnl_r", bar: float = 0.05, least: int = 30, draws: int = 10_000) -> DataFrame:
    """A verdict per warning and direction, all of them one family: ``SUPPRESS-CANDIDATE`` where warned trades lose reliably,
    ``REVERSE`` where they win, ``COSMETIC`` where an effect is ruled out, else ``INSUFFICIENT``.

    Trades of a day are one cluster. The interval of warned against other trades' means goes with it and decides nothing.
    """
    flags = F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*(F.col(n) for n in NAMES)))
    t = tag(trades, bars, at).where(F.col(value).isNotNull())
    t = t.select(row_id, "direction", F.col(value).alias("r"), F.expr(f"{at} div {DAY_MS}").alias("day"), F.explode(flags).alias("warning", "warned"))
    keys = ["warning", "direction"]
    cells = audit_cells(t, keys, "warned", "day", "r", bar, least=least, draws=draws)
    verdict = F.when(F.col("decision") == "ENABLE", "SUPPRESS-CANDIDATE").when(F.col("decision") == "DISABLE", "REVERSE").when((F.col("decision") == "CONCENTRATE") | F.col("powered_null"), "COSMETIC").otherwise("INSUFFICIENT")
    return cells.withColumn("verdict", verdict).join(lift_interval(t, keys, "warned", row_id, "r", draws), keys, "left")
