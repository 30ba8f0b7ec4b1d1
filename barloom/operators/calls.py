"""Calls that someone made in public, scored on bars: did they trigger, and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import atr_mean
from ..sources.tables import DAY_MS, SERIES, TF_MS, as_of, series
from .search import first_touch

WIN, LOSS, OPEN, NOT_TRIGGERED, UNSCORED, UNRESOLVABLE, STALE = "WIN", "LOSS", "OPEN", "NOT_TRIGGERED", "UNSCORED", "UNRESOLVABLE", "STALE"


def width(timeframe: str = "timeframe") -> Column:
    out = F.lit(DAY_MS)
    for name, ms in TF_MS.items():
        out = F.when(F.col(timeframe) == name, F.lit(ms)).otherwise(out)
    return out


def bar_outcome(long: Column, opened: Column, high: Column, low: Column, stop: Column, target: Column) -> Column:
    """``state, price`` of one bar, null if it reaches neither level: opened beyond the stop or the target, at the open; then the
    stop, then the target, at the level. So the worse comes first where a bar reaches both."""
    at = lambda state, price: F.struct(F.lit(state).alias("state"), price.cast("double").alias("price"))
    beyond = lambda x, level: F.when(long, x <= level).otherwise(x >= level)
    reached = lambda x, level: F.when(long, x >= level).otherwise(x <= level)
    against, favour = F.when(long, low).otherwise(high), F.when(long, high).otherwise(low)
    return (
        F.when(beyond(opened, stop), at(LOSS, opened))
        .when(reached(opened, target), at(WIN, opened))
        .when(beyond(against, stop), at(LOSS, stop))
        .when(reached(favour, target), at(WIN, target))
    )


def score_calls(calls: DataFrame, bars: DataFrame, now_ms: int, expected_ms: int | None = None) -> DataFrame:
    """``calls`` with ``state, fill_ms, fill, exit_ms, exit, r, atr_r``, a row each.

    ``calls`` has ``symbol, timeframe, direction, call_ms, entry, stop, target, window_ms``; levels may be null, and without an entry
    the call is taken at the open of the first bar after it. Bars after ``now_ms`` are not there yet; they are expected to reach
    ``expected_ms``, the last close there could be, by default ``now_ms``.

    Trigger: the first bar at or after the call, opening within its window, whose range, with the close before it, holds the entry; it fills at the
    entry, or at the open of a bar that gaps over it. Exit: from the fill on, for another window, by ``bar_outcome``; on
    the bar of the fill it has opened at the fill. Both are searches for the first later bar that touches a level. After the
    window it ends at its last bar's close, a win if that is better than the fill. ``UNSCORED``: no direction, or levels out of
    order; ``UNRESOLVABLE``: no bar had closed by the call; ``STALE``: the bars end before they could tell; ``NOT_TRIGGERED`` and
    ``OPEN`` as they say. ``r`` is in parts of the risk to the stop, ``atr_r`` in the mean true range before the fill.
    """
    seen = bars.where(F.col("open_time") <= now_ms)
    b = seen.withColumn("prev", F.lag("close").over(series())).select(*SERIES, "open_time", "open", "high", "low", "close", "prev")
    ends = b.groupBy(*SERIES).agg((F.max("open_time") + F.first(width())).alias("data_end"))
    c = calls.withColumn("_id", F.monotonically_increasing_id()) if "_id" not in calls.columns else calls
    long, sign = F.col("direction") == "long", F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    closed = b.withColumn("_closed", F.col("open_time") + width()).select(*SERIES, "_closed", F.col("open_time").alias("_ref"))
    c = as_of(c, closed, list(SERIES), "call_ms", "_closed", ["_ref"]).drop("matched_time").join(ends, list(SERIES), "left")
    limit = F.least(F.col("call_ms") + F.col("window_ms"), F.lit(now_ms))

    # the first bar after the call, then, by the side of the entry that its price comes from, the first to reach it
    bar = F.struct("open_time", "open", "high", "low", "close", "prev")
    back = b.select(*SERIES, (-F.col("open_time")).alias("_neg"), bar.alias("_b"))
    c = as_of(c.withColumn("_ask", -F.col("call_ms")), back, list(SERIES), "_ask", "_neg", ["_b"]).drop("matched_time", "_ask").withColumnRenamed("_b", "_first")
    entry = F.col("entry")
    inside = (F.col("_first.low") <= entry) & (entry <= F.col("_first.high"))
    gapped = ((F.col("_first.prev") < entry) & (entry < F.col("_first.open"))) | ((F.col("_first.open") < entry) & (entry < F.col("_first.prev")))
    c = c.withColumn("_at_once", F.col("entry").isNull() | F.coalesce(inside | gapped, F.lit(False)))
    c = c.withColumns({
        "_from": F.when(~F.col("_at_once"), F.col("_first.open_time") + 1),
        "_down": F.when(F.col("_first.close") > entry, entry),
        "_up": F.when(F.col("_first.close") <= entry, entry),
    })
    c = first_touch(b, c, "_from", "_down", "_up")
    t = F.when(F.col("_at_once"), F.col("_first").dropFields("prev")).otherwise(F.col("x"))
    c = c.withColumn("_t", t).withColumn("_t", F.when(F.col("_t.open_time") <= limit, F.col("_t")))
    holds = (F.col("_t.low") <= entry) & (entry <= F.col("_t.high"))
    c = c.withColumns({"fill_ms": F.col("_t.open_time"), "fill": F.when(entry.isNull(), F.col("_t.open")).when(holds, entry).otherwise(F.col("_t.open"))}).drop("x", "_first", "_from", "_down", "_up", "_at_once")

    stop, target = F.col("stop"), F.col("target")
    order = lambda low, high: F.coalesce(F.when(long, low < high).otherwise(low > high), F.lit(True))
    sane = order(stop, F.col("fill")) & order(F.col("fill"), target) & order(stop, target)
    c = c.withColumn("_at_fill", bar_outcome(long, F.col("fill"), F.col("_t.high"), F.col("_t.low"), stop, target))
    c = c.withColumns({"_from": F.when(F.col("_at_fill").isNull(), F.col("fill_ms") + 1), "_below": F.when(long, stop).otherwise(target), "_above": F.when(long, target).otherwise(stop)})
    c = first_touch(b, c, "_from", "_below", "_above")
    expiry = F.col("fill_ms") + F.col("window_ms")
    later = F.when(F.col("x.open_time") <= F.least(expiry, F.lit(now_ms)), bar_outcome(long, F.col("x.open"), F.col("x.high"), F.col("x.low"), stop, target))
    c = c.withColumn("_exit", F.coalesce("_at_fill", later)).withColumn("_exit_ms", F.when(F.col("_at_fill").isNotNull(), F.col("fill_ms")).otherwise(F.col("x.open_time"))).drop("x")
    c = as_of(c.withColumn("_expiry", expiry), b.select(*SERIES, "open_time", F.col("close").alias("_last")), list(SERIES), "_expiry", "open_time", ["_last"]).withColumnRenamed("matched_time", "_last_ms")
    expected = F.lit(now_ms if expected_ms is None else expected_ms)
    over = (expiry <= now_ms) & (F.col("data_end") >= expiry)
    deadline = F.col("call_ms") + F.col("window_ms")
    at_end = F.when((F.col("_last") - F.col("fill")) * sign > 0, WIN).otherwise(LOSS)
    state = (
        F.when(~F.coalesce(F.col("direction").isin("long", "short"), F.lit(False)), UNSCORED)
        .when(F.col("_ref").isNull(), UNRESOLVABLE)
        .when(F.col("fill").isNull(), F.when((deadline <= now_ms) & (F.col("data_end") >= deadline), NOT_TRIGGERED).when(F.col("data_end") < F.least(deadline, expected), STALE).otherwise(OPEN))
        .when(~sane, UNSCORED)
        .when(F.col("_exit").isNotNull(), F.col("_exit.state"))
        .when(over, at_end)
        .when(F.col("data_end") < F.least(expiry, expected), STALE)
        .otherwise(OPEN)
    )
    c = c.withColumn("state", state)
    done, took = F.col("state").isin(WIN, LOSS), F.col("_exit").isNotNull()
    c = c.withColumns({"exit": F.when(done, F.when(took, F.col("_exit.price")).otherwise(F.col("_last"))), "exit_ms": F.when(done, F.when(took, F.col("_exit_ms")).otherwise(F.col("_last_ms")))})
    known = ~F.col("state").isin(UNRESOLVABLE) & F.coalesce(F.col("direction").isin("long", "short"), F.lit(False))
    c = c.withColumns({"fill": F.when(known, F.col("fill")), "fill_ms": F.when(known, F.col("fill_ms"))})
    atr = atr_mean(b).withColumn("_closed", F.col("open_time") + width()).select(*SERIES, "_closed", F.col("atr14").alias("_atr"))
    c = as_of(c.withColumn("_fill_ms", F.coalesce("fill_ms", F.lit(-1))), atr, list(SERIES), "_fill_ms", "_closed", ["_atr"]).drop("matched_time")
    won = (F.col("exit") - F.col("fill")) * sign
    c = c.withColumns({"r": F.when(F.abs(F.col("fill") - stop) > 0, won / F.abs(F.col("fill") - stop)), "atr_r": F.when(F.col("_atr") > 0, won / F.col("_atr"))})
    return c.select(*(x for x in calls.columns if x != "_id"), "state", "fill_ms", "fill", "exit_ms", "exit", "r", "atr_r")


def call_cells(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell: ``n, triggered, open, resolved, wins, hit_rate, avg_r, avg_atr_r, r_coverage``; the last is the share of resolved calls that have an ``r``."""
    done = F.col("state").isin(WIN, LOSS)
    g = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count("fill").alias("triggered"), F.count_if(F.col("state") == OPEN).alias("open"), F.count_if(done).alias("resolved"), F.count_if(F.col("state") == WIN).alias("wins"),
        F.avg(F.when(done, F.col("r"))).alias("avg_r"), F.avg(F.when(done, F.col("atr_r"))).alias("avg_atr_r"), F.count(F.when(done, F.col("r"))).alias("_r"),
    )
    return g.withColumns({"hit_rate": F.try_divide("wins", "resolved"), "r_coverage": F.try_divide("_r", "resolved")}).drop("_r")
