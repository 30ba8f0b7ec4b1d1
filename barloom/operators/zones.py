"""Zones and levels of the newest bars of each series, as a chart shows them: boxes, where they end, and if they still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES
from .detectors import broken_swing, retracement

ZONE = ("zone_type", "direction", "zone_low", "zone_high", "start_ms", "close_ms", "active")


def newest(bars: DataFrame, n: int) -> DataFrame:
    """A row per series: its newest ``n`` bars in order as ``t``, and how many it has as ``n``."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("open_time"))
    last = bars.withColumn("_k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy(*SERIES))).where(F.col("_k") <= n)
    return last.groupBy(*SERIES, "n").agg(F.array_sort(F.collect_list(F.struct("open_time", "open", "high", "low", "close"))).alias("t"))


def _at(tail: DataFrame, first: int, last: Column | int, after: int) -> DataFrame:
    """A row per bar of ``t`` with its place ``i`` in the series, from ``first`` of the series and to ``last``; ``after``
    places on begins ``rest``."""
    x = tail.select("*", F.posexplode("t").alias("p", "bar")).withColumn("i", F.col("p") + F.col("n") - F.size("t"))
    return x.where((F.col("i") >= first) & (F.col("i") <= last)).withColumn("rest", F.expr(f"slice(t, p + {after + 1}, size(t))"))


def _zone(rows: DataFrame, kind: str, side: Column, low: Column, high: Column, start: Column, ends: str) -> DataFrame:
    """Zones with the first of the bars ``rest`` that meets ``ends`` (SQL on x and ``zone_low``, ``zone_high``, ``direction``)."""
    z = rows.select(*SERIES, "i", "rest", F.lit(kind).alias("zone_type"), side.alias("direction"), low.alias("zone_low"), high.alias("zone_high"), start.alias("start_ms"))
    z = z.withColumn("close_ms", F.expr(f"try_element_at(filter(rest, x -> {ends}), 1).open_time"))
    return z.withColumn("active", F.col("close_ms").isNull()).drop("rest")


def _shown(zones: DataFrame, filled: int, most: int) -> DataFrame:
    """The active zones and the newest ``filled`` ended ones, of these the last ``most``: what a chart has room for."""
    order = [F.desc("i"), F.desc("direction")]
    z = zones.withColumn("_f", F.row_number().over(Window.partitionBy(*SERIES, "active").orderBy(*order))).where(F.col("active") | (F.col("_f") <= filled))
    z = z.withColumn("_r", F.row_number().over(Window.partitionBy(*SERIES).orderBy("active", *order))).where(F.col("_r") <= most)
    return z.select(*SERIES, *ZONE)


def gap_boxes(bars: DataFrame, lookback: int = 100, min_gap_pct: float = 0.001, most: int = 30) -> DataFrame:
    """Three-bar gaps, until their middle is crossed."""
    x = _at(newest(bars, lookback + 2), 1, F.col("n") - 2, 2).where("p > 0").withColumns({"a": F.expr("t[p - 1]"), "b": F.expr("t[p + 1]")})
    up = F.col("a.high") < F.col("b.low")
    x = x.where(up | (F.col("a.low") > F.col("b.high"))).withColumns({"lo": F.when(up, F.col("a.high")).otherwise(F.col("b.high")), "hi": F.when(up, F.col("b.low")).otherwise(F.col("a.low"))})
    x = x.where(F.col("hi") - F.col("lo") >= min_gap_pct * (F.col("lo") + F.col("hi")) / 2)
    z = _zone(x, "fvg", F.when(up, "bull").otherwise("bear"), F.col("lo"), F.col("hi"), F.col("a.open_time"), "if(direction = 'bull', x.low <= (zone_low + zone_high) / 2, x.high >= (zone_low + zone_high) / 2)")
    return _shown(z, 5, most)


def order_blocks(bars: DataFrame, lookback: int = 100, displacement_pct: float = 0.003, most: int = 20) -> DataFrame:
    """Bodies before a displacement, until a bar touches them and closes beyond."""
    x = _at(newest(bars, lookback + 2), 0, F.col("n") - 3, 2).withColumn("b", F.expr("t[p + 1]"))
    rise = F.col("bar.close") > F.col("bar.open")
    bear = rise & (F.col("b.close") < F.col("bar.low") * (1 - displacement_pct))
    bull = (F.col("bar.open") > F.col("bar.close")) & (F.col("b.close") > F.col("bar.high") * (1 + displacement_pct))
    z = _zone(x.where(bear | bull), "ob", F.when(rise, "bear").otherwise("bull"), F.least("bar.open", "bar.close"), F.greatest("bar.open", "bar.close"), F.col("bar.open_time"), "if(direction = 'bear', x.high >= zone_low and x.close < zone_low, x.low <= zone_high and x.close > zone_high)")
    return _shown(z, 3, most)


def _swings(bars: DataFrame, lookback: int, n: int) -> DataFrame:
    """Swing bars of the newest: extremes among the ``n`` bars on either side; ``side`` H or L with its price."""
    x = _at(newest(bars, lookback + 2 * n), n, F.col("n") - n - 1, n + 1).where(f"i >= n - {lookback + n} and n >= {2 * n + 1}")
    x = x.withColumn("around", F.expr(f"slice(t, p - {n} + 1, {2 * n + 1})"))
    high = x.where(F.col("bar.high") == F.array_max(F.col("around.high"))).withColumns({"side": F.lit("H"), "price": F.col("bar.high")})
    low = x.where(F.col("bar.low") == F.array_min(F.col("around.low"))).withColumns({"side": F.lit("L"), "price": F.col("bar.low")})
    return high.unionByName(low).drop("around")


def swing_points(bars: DataFrame, lookback: int = 100, n: int = 5, most: int = 30) -> DataFrame:
    """The newest swing highs and lows."""
    s = _swings(bars, lookback, n).select(*SERIES, "i", F.when(F.col("side") == "H", "high").otherwise("low").alias("swing_type"), "price", F.col("bar.open_time").alias("time_ms"))
    w = Window.partitionBy(*SERIES).orderBy(F.desc("i"), F.desc("swing_type"))
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(*SERIES, "swing_type", "price", "time_ms")


def structure_levels(bars: DataFrame, lookback: int = 100, n: int = 5, most: int = 8) -> DataFrame:
    """Swing prices as levels, from their confirmation until a bar closes beyond."""
    s = _swings(bars, lookback, n).where(F.col("n") >= 3 * n)
    z = _zone(s, "bos", F.when(F.col("side") == "H", "bear").otherwise("bull"), F.col("price"), F.col("price"), F.col("bar.open_time"), "if(direction = 'bear', x.close > zone_high, x.close < zone_low)")
    return _shown(z, 5, most)  # of one bar the low, which is the bull level, is the newer


def equal_pools(bars: DataFrame, lookback: int = 100, tolerance_pct: float = 0.003, n: int = 5, most: int = 10) -> DataFrame:
    """Pairs of equal swings, each swing in one pair, paired in order with the first free one; until the level is reached.

    No price is equal to one of 0, as no share of it is. A fold over the few swings of a series, since each pair takes its swings out.
    """
    s = _swings(bars, lookback, n).select(*SERIES, "t", "side", F.struct("i", "p", "price").alias("swing"))
    s = s.groupBy(*SERIES, "t", "side").agg(F.array_sort(F.collect_list("swing")).alias("s"))
    free = f"filter(sequence(0, size(s) - 1), k -> k > j and not array_contains(a.seen, k) and try_divide(abs(s[j].price - s[k].price), s[j].price) < {tolerance_pct!r})"
    step = f"if(array_contains(a.seen, j), a, element_at(transform(array(try_element_at({free}, 1)), k -> if(k is null, a, named_struct('seen', a.seen || array(j, k), 'pairs', a.pairs || array(named_struct('j', j, 'k', k))))), 1))"
    pairs = F.expr(f"aggregate(sequence(0, size(s) - 1), named_struct('seen', cast(array() as array<int>), 'pairs', cast(array() as array<struct<j:int,k:int>>)), (a, j) -> {step}).pairs")
    x = s.withColumn("pair", F.explode(pairs)).withColumns({"one": F.expr("s[pair.j]"), "two": F.expr("s[pair.k]")})
    x = x.withColumns({"i": F.col("one.i"), "rest": F.expr("slice(t, two.p + 2, size(t))"), "price": (F.col("one.price") + F.col("two.price")) / 2})
    high = F.col("side") == "H"
    z = _zone(x.withColumn("start", F.expr("t[one.p].open_time")), "pool", F.when(high, "bear").otherwise("bull"), F.col("price"), F.col("price"), F.col("start"), "if(direction = 'bear', x.high >= zone_high, x.low <= zone_low)")
    z = z.withColumn("zone_type", F.when(F.col("direction") == "bear", "eqh").otherwise("eql"))
    w = Window.partitionBy(*SERIES).orderBy(F.desc("zone_type"), F.desc("i"))
    return z.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).select(*SERIES, *ZONE)


def retracement_box(bars: DataFrame, near: float, far: float, kind: str, swing_lookback: int = 20, bos_lookback: int = 5) -> DataFrame:
    """The box between two shares back of the swing that each series broke last, seen from its newest bar."""
    need = swing_lookback + bos_lookback + 2
    w = Window.partitionBy(*SERIES).orderBy(F.desc("open_time"))
    tail = bars.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= need)
    b = broken_swing(tail, swing_lookback, bos_lookback).withColumn("_n", F.count("*").over(Window.partitionBy(*SERIES))).where((F.col("_k") == 1) & (F.col("_n") == need) & F.col("bos").isNotNull())
    ends = (retracement(near), retracement(far))
    return b.select(*SERIES, F.lit(kind).alias("zone_type"), F.when(F.col("bos.direction") == "long", "bull").otherwise("bear").alias("direction"), F.least(*ends).alias("zone_low"), F.greatest(*ends).alias("zone_high"), "bos.start_ms", F.lit(None).cast("long").alias("close_ms"), F.lit(True).alias("active"))


def golden_box(bars: DataFrame) -> DataFrame:
    """50% to 61.8% back."""
    return retracement_box(bars, 0.5, 0.618, "fib_zone")


def ote_box(bars: DataFrame) -> DataFrame:
    """61.8% to 78.6% back."""
    return retracement_box(bars, 0.618, 0.786, "ote")
