"""The first later bar that touches a level, to the end of a series, without pairs of rows.

Bars lie in blocks of time, and blocks in large blocks, each with its extremes. A search looks into the block it starts in; by
the extremes of the blocks of its large block, and else of the later large blocks, it finds the first later block that can
hold the bar, and looks into that. Five equal joins and no range join, whatever the distance; a search carries a list of at most
256 blocks at a time, or one of its series' large blocks, each of 65,536 bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import DAY_MS, SERIES, TF_MS

BARS_A_BLOCK = 256
_BAR = ("open_time", "open", "high", "low", "close")


def block_of(open_time: str) -> Column:
    """The number of the block of a time; timeframes that have no known width are taken for a day's."""
    width = F.lit(DAY_MS * BARS_A_BLOCK)
    for timeframe, ms in TF_MS.items():
        width = F.when(F.col("timeframe") == timeframe, F.lit(ms * BARS_A_BLOCK)).otherwise(width)
    return F.floor(F.col(open_time) / width).cast("long")


def first_touch(bars: DataFrame, asks: DataFrame, start: str, below: str, above: str) -> DataFrame:
    """``asks`` with ``x``, the first bar at or after the time in column ``start`` whose low is at or under ``below`` or
    whose high is at or over ``above`` (columns of asks; a null level is never touched); null where there is none.

    ``x`` holds ``open_time, open, high, low, close``. Asks of series without bars, or without a start, stay.
    """
    key = ["_symbol", "_timeframe"]
    b = bars.groupBy(*SERIES, block_of("open_time").alias("_block")).agg(F.array_sort(F.collect_list(F.struct(*_BAR))).alias("_bars"), F.min("low").alias("_lo"), F.max("high").alias("_hi"))
    b = b.select(F.col("symbol").alias("_symbol"), F.col("timeframe").alias("_timeframe"), "_block", "_bars", "_lo", "_hi")
    large = b.groupBy(*key, F.expr(f"_block div {BARS_A_BLOCK}").alias("_large")).agg(F.array_sort(F.collect_list(F.struct("_block", "_lo", "_hi"))).alias("_small"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    known = large.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_large", "_lo", "_hi"))).alias("_all"))
    small = large.select(*key, "_large", "_small")
    same = (F.col("symbol") == F.col("_symbol")) & (F.col("timeframe") == F.col("_timeframe"))
    first = lambda blocks, also="true": F.expr(f"try_element_at(filter({blocks}, z -> {also} and (z._lo <= {below} or z._hi >= {above})), 1)")
    none = -1 - F.col("_own")  # no block has such a number; searches that need not look further don't all go to one place
    a = asks.withColumn("_own", block_of(start)).withColumn("_in", F.expr(f"_own div {BARS_A_BLOCK}"))
    a = a.join(known, same, "left").withColumn("_next", first("_all", "z._large > _in")["_large"]).drop(*key, "_all")
    a = a.join(small, same & (F.col("_in") == F.col("_large")), "left").withColumn("_later", first("_small", "z._block > _own")["_block"]).drop(*key, "_large", "_small")
    a = a.withColumn("_next", F.when(F.col("_later").isNull() & F.col("_next").isNotNull(), F.col("_next")).otherwise(none))
    a = a.join(small, same & (F.col("_next") == F.col("_large")), "left").withColumn("_later", F.coalesce(F.col("_later"), first("_small")["_block"], none)).drop(*key, "_large", "_small", "_next", "_in")
    hit = f"try_element_at(filter(_bars, x -> x.open_time >= {start} and (x.low <= {below} or x.high >= {above})), 1)"
    for at, name in (("_own", "_x1"), ("_later", "_x2")):
        a = a.join(b, same & (F.col(at) == F.col("_block")), "left").withColumn(name, F.expr(hit)).drop(*key, "_block", "_bars", "_lo", "_hi")
    return a.withColumn("x", F.coalesce("_x1", "_x2")).drop("_x1", "_x2", "_own", "_later")
