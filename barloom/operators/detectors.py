"""Pattern detectors: bars in, signals out, all series at once.

Detectors are column programs over one sort of each series. Where a pattern waits for the first later bar that meets a
condition, the next bars are carried along as a bounded array and searched in place, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import ema, volume_flags
from ..sources.tables import SERIES, as_of, series

SIGNAL = ("open_time", "direction", "reason", "sl_price", "low_volume", "tp_price")


def _body() -> Column:
    return F.abs(F.col("close") - F.col("open"))


def _range() -> Column:
    return F.col("high") - F.col("low")


def _top() -> Column:
    return F.greatest("open", "close")


def _bottom() -> Column:
    return F.least("open", "close")


def _upper() -> Column:
    return F.col("high") - _top()


def _lower() -> Column:
    return _bottom() - F.col("low")


def _price(name: str, *cols: Column) -> Column:
    return F.format_string(f"{name}@" + "-".join(["%.2f"] * len(cols)), *cols)


def _found(rows: DataFrame, *options: tuple[Column, str, Column, Column], low_volume: bool = False, tp: Column | None = None) -> DataFrame:
    """Signals of bars by the first option that holds: condition, direction, reason, stop."""
    pick = lambda at: F.coalesce(*(F.when(o[0], o[at]) for o in options))
    out = rows.select(*SERIES, "open_time", pick(1).alias("direction"), pick(2).alias("reason"), pick(3).alias("sl_price"), (~F.col("vol_ok") if low_volume else F.lit(False)).alias("low_volume"), (tp if tp is not None else F.lit(None).cast("double")).alias("tp_price"))
    return out.where("direction is not null")


def _first_kept(rows: DataFrame) -> DataFrame:
    """One signal per bar: that of the earliest formation, long before short."""
    w = Window.partitionBy(*SERIES, "open_time").orderBy("formed", "direction")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*SERIES, *SIGNAL)


def _hits(bars: DataFrame, start: int, stop: int, options: list[tuple[Column, str, str, str, Column, Column]], extra: str = "") -> DataFrame:
    """Signals on the first of the bars ``start..stop`` after a formation that meets a condition on ``x``.

    Options: formed, condition (SQL on x and the row), direction, further condition on the bar that was found, reason,
    stop. The search ends at the first hit, whether the further condition holds or not.
    """
    w = series()
    formed = [F.coalesce(o[0], F.lit(False)) for o in options]
    rows = bars.withColumns({**{f"_f{i}": f for i, f in enumerate(formed)}, "_k": F.row_number().over(w)})
    any_ = F.greatest(*(F.col(f"_f{i}") for i in range(len(options)))) if len(options) > 1 else F.col("_f0")
    # bars that no formation looks at go before the formations' own are collected
    rows = rows.withColumn("_any", any_).withColumn("_since", F.last(F.when(F.col("_any"), F.col("_k")), True).over(w)).where(F.col("_k") - F.col("_since") <= stop)
    ahead = F.collect_list(F.struct("open_time", "low", "high", "close", *([extra] if extra else []))).over(w.rowsBetween(start, stop))
    rows = rows.withColumn("_ahead", ahead).where("_any")
    found = []
    for i, (_, condition, direction, further, reason, stop_at) in enumerate(options):
        rows = rows.withColumn(f"_x{i}", F.expr(f"if(_f{i}, try_element_at(filter(_ahead, x -> {condition}), 1), null)"))
        kept = F.expr(f"transform(array(_x{i}), x -> {further or 'true'})[0]")
        found.append(F.when(F.col(f"_x{i}").isNotNull() & kept, F.struct(F.col(f"_x{i}.open_time").alias("open_time"), F.lit(direction).alias("direction"), reason.alias("reason"), stop_at.alias("sl_price"))))
    out = rows.select(*SERIES, F.col("open_time").alias("formed"), F.explode(F.array_compact(F.array(*found))).alias("o")).select(*SERIES, "formed", "o.*")
    return _first_kept(out.select(*SERIES, "formed", "open_time", "direction", "reason", "sl_price", F.lit(False).alias("low_volume"), F.lit(None).cast("double").alias("tp_price")))


def wick_fill(bars: DataFrame, ratio: float = 1.5, lookback: int = 20) -> DataFrame:
    """A long wick opens a zone; the first bar that enters it and closes beyond its far side's edge signals."""
    b = bars.withColumns({"_top": _top(), "_bot": _bottom()})
    return _hits(b, 1, lookback, [
        ((_body() != 0) & (_lower() >= ratio * _body()), "x.low <= _bot and x.close > low", "long", "", _price("wick_fill_long", F.col("low"), F.col("_bot")), F.col("low")),
        ((_body() != 0) & (_upper() >= ratio * _body()), "x.high >= _top and x.close < high", "short", "", _price("wick_fill_short", F.col("_top"), F.col("high")), F.col("high")),
    ])


def marubozu_retest(bars: DataFrame, max_wick_ratio: float = 0.1, lookback: int = 30, min_body_pct: float = 0.005) -> DataFrame:
    """A candle almost all body; the first later bar that touches its open and closes beyond it signals."""
    is_one = (_body() != 0) & (_body() >= min_body_pct * F.col("open")) & (_upper() <= max_wick_ratio * _body()) & (_lower() <= max_wick_ratio * _body())
    return _hits(bars, 1, lookback, [
        (is_one & (F.col("close") > F.col("open")), "x.low <= open and x.close > open", "long", "", _price("marubozu_long", F.col("open")), F.col("low")),
        (is_one & (F.col("close") <= F.col("open")), "x.high >= open and x.close < open", "short", "", _price("marubozu_short", F.col("open")), F.col("high")),
    ])


def fair_value_gap(bars: DataFrame, lookback: int = 50, min_gap_pct: float = 0.001, trend_filter: bool = True) -> DataFrame:
    """A gap over three bars, consumed by the first bar that reaches its middle and closes inside or beyond."""
    w = series()
    b = ema(bars, {"ema50": 50}).withColumns({"_ph": F.lag("high").over(w), "_pl": F.lag("low").over(w), "_nl": F.lead("low").over(w), "_nh": F.lead("high").over(w)})
    up = (F.col("_ph") < F.col("_nl")) & (F.col("_nl") - F.col("_ph") >= min_gap_pct * (F.col("_nl") + F.col("_ph")) / 2)
    down = (F.col("_pl") > F.col("_nh")) & (F.col("_pl") - F.col("_nh") >= min_gap_pct * (F.col("_pl") + F.col("_nh")) / 2)
    return _hits(b, 2, lookback + 1, [
        (up, "x.low <= (_ph + _nl) / 2 and x.close > _ph", "long", "x.close > x.ema50" if trend_filter else "", _price("fvg_long", F.col("_ph"), F.col("_nl")), F.col("_ph")),
        (down, "x.high >= (_pl + _nh) / 2 and x.close < _pl", "short", "x.close < x.ema50" if trend_filter else "", _price("fvg_short", F.col("_pl"), F.col("_nh")), F.col("_pl")),
    ], "ema50")


def order_block(bars: DataFrame, lookback: int = 100, displacement_pct: float = 0.003) -> DataFrame:
    """The last opposite candle before a displacement; the first retest of its body signals."""
    b = bars.withColumn("_next", F.lead("close").over(series()))
    return _hits(b, 2, lookback + 1, [
        ((F.col("close") > F.col("open")) & (F.col("_next") < F.col("low") * (1 - displacement_pct)), "x.high >= open and x.low <= close and x.close < close", "short", "", _price("ob_short", F.col("open"), F.col("close")), F.col("high")),
        ((F.col("open") > F.col("close")) & (F.col("_next") > F.col("high") * (1 + displacement_pct)), "x.low <= open and x.high >= close and x.close > close", "long", "", _price("ob_long", F.col("close"), F.col("open")), F.col("low")),
    ])


def orb_breakout(bars: DataFrame, range_candles: int = 1) -> DataFrame:
    """The first close outside the opening range of a 13:30 UTC session, once per direction."""
    b = bars.withColumn("_day", F.to_date(F.timestamp_millis(F.col("open_time") - 48_600_000)))
    w = Window.partitionBy(*SERIES, "_day")
    b = b.withColumn("_k", F.row_number().over(w.orderBy("open_time")))
    b = b.withColumns({"_hi": F.max(F.when(F.col("_k") <= range_candles, F.col("high"))).over(w), "_lo": F.min(F.when(F.col("_k") <= range_candles, F.col("low"))).over(w)})
    out = b.where((F.col("_k") > range_candles) & (F.col("_hi") > F.col("_lo"))).withColumn("direction", F.when(F.col("close") > F.col("_hi"), "long").when(F.col("close") < F.col("_lo"), "short")).where("direction is not null")
    out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*SERIES, "_day", "direction").orderBy("open_time"))).where("_n = 1")
    long = F.col("direction") == "long"
    return out.select(*SERIES, "open_time", "direction", F.when(long, _price("orb_long", F.col("_hi"))).otherwise(_price("orb_short", F.col("_lo"))).alias("reason"), F.when(long, F.col("_lo")).otherwise(F.col("_hi")).alias("sl_price"), F.lit(False).alias("low_volume"), F.lit(None).cast("double").alias("tp_price"))


def trend_day(bars: DataFrame, body_pct_min: float = 0.65, wick_max: float = 0.15) -> DataFrame:
    """A candle almost all body with next to no wick on the side it came from."""
    big = (_range() != 0) & (_body() / F.nullif(_range(), F.lit(0.0)) >= body_pct_min)
    return _found(
        bars,
        (big & (_lower() / F.nullif(_range(), F.lit(0.0)) <= wick_max) & (F.col("close") > F.col("open")), F.lit("long"), _price("trend_day_bull", F.col("open"), F.col("close")), F.col("low")),
        (big & (_upper() / F.nullif(_range(), F.lit(0.0)) <= wick_max) & (F.col("close") < F.col("open")), F.lit("short"), _price("trend_day_bear", F.col("open"), F.col("close")), F.col("high")),
    )


def _pct_stop(sl_pct: float) -> tuple[Column, Column]:
    return F.col("close") * (1 - sl_pct), F.col("close") * (1 + sl_pct)


def engulfing(bars: DataFrame, sl_pct: float = 0.02) -> DataFrame:
    """A body strictly around the opposite body before it."""
    w, (below, above) = series(), _pct_stop(sl_pct)
    po, pc = F.lag("open").over(w), F.lag("close").over(w)
    b = volume_flags(bars).withColumns({"_po": po, "_pc": pc})
    po, pc, o, c = (F.col(x) for x in ("_po", "_pc", "open", "close"))
    return _found(
        b,
        ((pc < po) & (c > o) & (o < pc) & (c > po), F.lit("long"), _price("bullish_engulfing", c), below),
        ((pc > po) & (c < o) & (o > pc) & (c < po), F.lit("short"), _price("bearish_engulfing", c), above),
        low_volume=True,
    )


def pin_bar(bars: DataFrame, wick_ratio: float = 2.0, sl_pct: float = 0.02) -> DataFrame:
    """One wick at least twice the body, the other within it."""
    below, above = _pct_stop(sl_pct)
    return _found(
        volume_flags(bars),
        ((_body() != 0) & (_lower() >= wick_ratio * _body()) & (_upper() <= _body()), F.lit("long"), _price("pin_bar_bull", F.col("close")), below),
        ((_body() != 0) & (_upper() >= wick_ratio * _body()) & (_lower() <= _body()), F.lit("short"), _price("pin_bar_bear", F.col("close")), above),
        low_volume=True,
    )


def inside_bar(bars: DataFrame, sl_pct: float = 0.02) -> DataFrame:
    """A body within the body before it; the bar after signals if it closes outside the first."""
    w, (below, above) = series(), _pct_stop(sl_pct)
    b = bars.withColumns({"_mt": F.lag(_top(), 2).over(w), "_mb": F.lag(_bottom(), 2).over(w), "_it": F.lag(_top()).over(w), "_ib": F.lag(_bottom()).over(w)})
    inside = (F.col("_it") <= F.col("_mt")) & (F.col("_ib") >= F.col("_mb"))
    return _found(
        b,
        (inside & (F.col("close") > F.col("_mt")), F.lit("long"), _price("inside_bar_long", F.col("close")), below),
        (inside & (F.col("close") < F.col("_mb")), F.lit("short"), _price("inside_bar_short", F.col("close")), above),
    )


def hammer(bars: DataFrame, wick_ratio: float = 2.0, context_lookback: int = 10, sl_pct: float = 0.02) -> DataFrame:
    """A hammer's shape, long after a fall and short otherwise."""
    below, above = _pct_stop(sl_pct)
    b = volume_flags(bars).withColumn("_past", F.lag("close", context_lookback).over(series()))
    shape = (_body() != 0) & (_lower() >= wick_ratio * _body()) & (_upper() <= _body()) & F.col("_past").isNotNull()
    return _found(
        b,
        (shape & (F.col("close") < F.col("_past")), F.lit("long"), _price("hammer", F.col("close")), below),
        (shape & (F.col("close") >= F.col("_past")), F.lit("short"), _price("hanging_man", F.col("close")), above),
        low_volume=True,
    )


def doji(bars: DataFrame, body_threshold: float = 0.1, confirm_body_pct: float = 0.6, sl_pct: float = 0.02) -> DataFrame:
    """A candle without a body, then one that is mostly body, whose direction counts."""
    w, (below, above) = series(), _pct_stop(sl_pct)
    b = bars.withColumns({"_pr": F.lag(_range()).over(w), "_pb": F.lag(_body()).over(w)})
    both = (F.col("_pr") != 0) & (F.col("_pb") <= body_threshold * F.col("_pr")) & (_range() != 0) & (_body() >= confirm_body_pct * _range())
    return _found(
        b,
        (both & (F.col("close") > F.col("open")), F.lit("long"), _price("doji_bull", F.col("close")), below),
        (both & (F.col("close") <= F.col("open")), F.lit("short"), _price("doji_bear", F.col("close")), above),
    )


def star(bars: DataFrame, star_body_max: float = 0.3, sl_pct: float = 0.02) -> DataFrame:
    """Three bars with a small body in the middle, the third closing past the first one's midpoint."""
    w, (below, above) = series(), _pct_stop(sl_pct)
    b = bars.withColumns({"_ao": F.lag("open", 2).over(w), "_ac": F.lag("close", 2).over(w), "_sr": F.lag(_range()).over(w), "_sb": F.lag(_body()).over(w)})
    mid, small = (F.col("_ao") + F.col("_ac")) / 2, (F.col("_sr") != 0) & (F.col("_sb") <= star_body_max * F.col("_sr"))
    return _found(
        b,
        (small & (F.col("_ac") < F.col("_ao")) & (F.col("close") > F.col("open")) & (F.col("close") > mid), F.lit("long"), _price("morning_star", F.col("close")), below),
        (small & (F.col("_ac") > F.col("_ao")) & (F.col("close") < F.col("open")) & (F.col("close") < mid), F.lit("short"), _price("evening_star", F.col("close")), above),
    )


def equal_levels(bars: DataFrame, lookback: int = 50, tolerance_pct: float = 0.003, swing_n: int = 5) -> DataFrame:
    """Two swings at one level with no bar beyond it between them; the bar that wicks through and closes back signals.

    The outermost level counts, of equal ones the earliest pair. A swing is the extreme of the ``swing_n`` bars on either
    side, as far as there are any. Per bar, the few swings of the last ``lookback`` bars are carried along, each with the
    extreme of the bars since the swing before it.
    """
    parts = []
    for high in (True, False):
        v, top, beyond = ("high", F.max, ">") if high else ("low", F.min, "<")
        inner = "greatest" if high else "least"
        end, far = ("array_max", "-double('inf')") if high else ("array_min", "double('inf')")
        b = bars.withColumns({"_i": F.row_number().over(series()), "_is": F.col(v) == top(v).over(series().rowsBetween(-swing_n, swing_n))})
        b = b.withColumn("_c", F.count_if("_is").over(series()) - F.col("_is").cast("int"))
        since = Window.partitionBy(*SERIES, "_c")
        b = b.withColumns({"_m": top(F.when(~F.col("_is"), F.col(v))).over(since), "_now": top(v).over(since.orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0))})
        swing = F.when(F.col("_is"), F.struct(F.col("_i").alias("i"), F.col(v).alias("p"), F.coalesce("_m", F.expr(far)).alias("m")))
        b = b.withColumn("_sw", F.collect_list(swing).over(series().rowsBetween(-lookback, -1))).where((F.col("_i") > lookback) & (F.size("_sw") > 1))
        level = f"{inner}(_sw[k].p, _sw[l].p)"
        between = f"{end}(transform(slice(_sw, k + 2, l - k), (z, n) -> {inner}(z.m, if(n < l - k - 1, z.p, {far}))))"
        swept = f"{v} {beyond} {level} and close {'<' if high else '>'} {level}"
        ok = f"{level} <> 0 and abs(_sw[k].p - _sw[l].p) / {level} <= {tolerance_pct!r} and not ({between} {beyond} {level}) and {swept}"
        after = f"{end}(transform(slice(_sw, l + 1, size(_sw)), (z, n) -> if(n = 0, z.p, {inner}(z.m, z.p))))"
        pairs = f"""flatten(transform(sequence(0, size(_sw) - 2), k -> transform(filter(sequence(k + 1, size(_sw) - 1), l -> {ok}),
          l -> named_struct('rank', {'' if high else '-'}{level}, 'a', -k, 'b', -l, 'p', _sw[k].p, 'q', _sw[l].p, 'stop', {inner}({after}, _now)))))"""
        b = b.withColumn("x", F.array_max(F.expr(pairs))).where("x is not null")
        name, side = ("eqh_short", "short") if high else ("eql_long", "long")
        parts.append(b.select(*SERIES, "open_time", F.lit(side).alias("direction"), _price(name, F.col("x.p"), F.col("x.q")).alias("reason"), F.col("x.stop").alias("sl_price"), F.lit(False).alias("low_volume"), F.lit(None).cast("double").alias("tp_price")))
    # of a bar that sweeps both sides the short stays
    both = parts[0].unionByName(parts[1]).withColumn("_n", F.row_number().over(Window.partitionBy(*SERIES, "open_time").orderBy(F.desc("direction"))))
    return both.where("_n = 1").drop("_n")


def broken_swing(bars: DataFrame, swing_lookback: int = 20, bos_lookback: int = 5) -> DataFrame:
    """Adds ``bos``: low and high of the swing that the bars before this one broke, its direction and its later pivot's time.

    The swing lies in the ``swing_lookback`` bars before the last ``bos_lookback``; a break upwards is looked for first.
    """
    w, zone = series(), series().rowsBetween(-swing_lookback - bos_lookback, -bos_lookback - 1)
    last = w.rowsBetween(-bos_lookback, -1)
    b = bars.withColumns({"_z": F.collect_list(F.struct("low", "high", "open_time")).over(zone), "_up": F.max(F.greatest("high", "close")).over(last), "_dn": F.min(F.least("low", "close")).over(last)})
    full = F.size("_z") == swing_lookback
    b = b.withColumns({"_lo": F.expr("array_position(_z.low, array_min(_z.low))").cast("int"), "_hi": F.expr("array_position(_z.high, array_max(_z.high))").cast("int")})
    b = b.withColumns({"_rise": F.expr("array_max(transform(slice(_z, _lo, size(_z)), (x, n) -> struct(x.high, -n as n, x.open_time)))"), "_fall": F.expr("array_min(transform(slice(_z, _hi, size(_z)), (x, n) -> struct(x.low, n as n, x.open_time)))")})
    swing = lambda lo, hi, side, at: F.struct(lo.alias("low"), hi.alias("high"), F.lit(side).alias("direction"), at.alias("start_ms"))
    lo, hi = F.array_min(F.col("_z.low")), F.array_max(F.col("_z.high"))
    up = full & (F.col("_rise.high") > lo) & (F.col("_rise.n") < 0) & (F.col("_up") > F.col("_rise.high"))
    down = full & (hi > F.col("_fall.low")) & (F.col("_fall.n") > 0) & (F.col("_dn") < F.col("_fall.low"))
    bos = F.when(up, swing(lo, F.col("_rise.high"), "long", F.col("_rise.open_time"))).when(down, swing(F.col("_fall.low"), hi, "short", F.col("_fall.open_time")))
    return b.withColumn("bos", bos).drop("_z", "_up", "_dn", "_lo", "_hi", "_rise", "_fall")


def retracement(share: float) -> Column:
    """The level a share of the broken swing back from its later pivot."""
    size = F.col("bos.high") - F.col("bos.low")
    return F.when(F.col("bos.direction") == "long", F.col("bos.high") - share * size).otherwise(F.col("bos.low") + share * size)


def ote_entry(bars: DataFrame, swing_lookback: int = 20, bos_lookback: int = 5) -> DataFrame:
    """A close between 61.8% and 78.6% back after a break of structure; target at 1.618 of the swing, stop at its start."""
    b = broken_swing(bars, swing_lookback, bos_lookback).withColumn("_k", F.row_number().over(series())).where((F.col("_k") > swing_lookback + bos_lookback + 1) & F.col("bos").isNotNull())
    near, far, long = retracement(0.618), retracement(0.786), F.col("bos.direction") == "long"
    b = b.where(F.when(long, (near >= F.col("close")) & (F.col("close") >= far)).otherwise((far >= F.col("close")) & (F.col("close") >= near)))
    size = F.col("bos.high") - F.col("bos.low")
    reason = F.format_string("ote_%s@%.2f (0.786=%.2f)", "bos.direction", "close", far)
    stop, target = F.when(long, F.col("bos.low")).otherwise(F.col("bos.high")), F.when(long, F.col("bos.high") + 0.618 * size).otherwise(F.col("bos.low") - 0.618 * size)
    return b.select(*SERIES, "open_time", "bos.direction", reason.alias("reason"), stop.alias("sl_price"), F.lit(False).alias("low_volume"), target.alias("tp_price"))


def ema_pullback(bars: DataFrame, fast: int = 20, slow: int = 50, slope_lookback: int = 10, regime_lookback: int = 20, max_crosses: int = 2, min_slope_pct: float = 0.003, pullback_lookback: int = 5, min_body_pct: float = 0.5, tp_r: float = 3.0) -> DataFrame:
    """A bar that goes on with the trend after a touch of the fast mean, in a trend with few crosses and a steep slow mean."""
    w, past = series(), series().rowsBetween(-pullback_lookback, -1)
    b = volume_flags(ema(bars, {"_f": fast, "_s": slow})).withColumns({"_k": F.row_number().over(w), "_slope": F.try_divide(F.col("_s"), F.lag("_s", slope_lookback).over(w)) - 1})
    side = F.nullif(F.signum(F.col("close") - F.col("_f")), F.lit(0.0))
    b = b.withColumns({
        "_sides": F.collect_list(side).over(w.rowsBetween(1 - regime_lookback, 0)),
        "_low": F.min(F.when((F.col("low") <= F.col("_f")) & (F.col("close") > F.col("_f")), F.col("low"))).over(past),
        "_high": F.max(F.when((F.col("high") >= F.col("_f")) & (F.col("close") < F.col("_f")), F.col("high"))).over(past),
    })
    crosses = F.expr("aggregate(_sides, named_struct('n', 0, 'l', 0D), (a, x) -> named_struct('n', a.n + if(a.l <> 0 and a.l <> x, 1, 0), 'l', x)).n")
    c, o = F.col("close"), F.col("open")
    b = b.where((F.col("_k") > max(slow, regime_lookback, slope_lookback, pullback_lookback)) & (F.abs("_slope") >= min_slope_pct) & (crosses <= max_crosses) & (_range() > 0) & (F.try_divide(_body(), _range()) >= min_body_pct))
    up = (c > F.col("_s")) & (F.col("_slope") > 0) & (c > o) & (c > F.col("_f")) & (c > F.col("_low"))
    down = (c < F.col("_s")) & (F.col("_slope") < 0) & (c < o) & (c < F.col("_f")) & (c < F.col("_high"))
    stop = F.when(up, F.col("_low")).otherwise(F.col("_high"))
    return _found(
        b,
        (up, F.lit("long"), _price("ema_pullback_long", c), F.col("_low")),
        (down, F.lit("short"), _price("ema_pullback_short", c), F.col("_high")),
        low_volume=True,
        tp=c + (c - stop) * tp_r,
    )


def fibonacci_retracement(bars: DataFrame, swing_lookback: int = 20) -> DataFrame:
    """A close between 50% and 61.8% back from the later of the latest three-bar pivots; stop at 78.6%."""
    w, past = series(), series().rowsBetween(1 - swing_lookback, -2)
    b = bars.withColumns({"_k": F.row_number().over(w), "_hi": (F.col("high") > F.lag("high").over(w)) & (F.col("high") > F.lead("high").over(w)), "_lo": (F.col("low") < F.lag("low").over(w)) & (F.col("low") < F.lead("low").over(w))})
    b = b.withColumns({"_h": F.last(F.when(F.col("_hi"), F.struct("_k", "high")), True).over(past), "_l": F.last(F.when(F.col("_lo"), F.struct("_k", "low")), True).over(past)})
    size, c = F.col("_h.high") - F.col("_l.low"), F.col("close")
    b = b.where((F.col("_k") > swing_lookback + 1) & (size > 0))
    rising = F.col("_l._k") < F.col("_h._k")
    back = lambda x: F.when(rising, F.col("_h.high") - x * size).otherwise(F.col("_l.low") + x * size)
    reason = F.format_string("fib_golden_zone@%.2f (0.618=%.2f)", c, back(0.618))
    return _found(
        b.where(F.col("_l._k") != F.col("_h._k")),
        (rising & (back(0.5) >= c) & (c >= back(0.618)), F.lit("long"), reason, back(0.786)),
        (~rising & (back(0.618) >= c) & (c >= back(0.5)), F.lit("short"), reason, back(0.786)),
    )


def funding_extreme(bars: DataFrame, funding: DataFrame, threshold: float = 0.0001) -> DataFrame:
    """Extreme funding rates as signals against them, on the first bar at or after each.

    ``funding(symbol, funding_time, rate)``; of several between two bars the latest counts.
    """
    b = as_of(bars.withColumn("_t", F.col("open_time")), funding, ["symbol"], "_t", "funding_time", ["rate"]).where("rate is not null")
    w = Window.partitionBy(*SERIES, "matched_time").orderBy("open_time")
    b = b.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    name = lambda n: F.format_string(f"funding_{n}_extreme@%.4f", "rate")
    return _found(b, (F.col("rate") > threshold, F.lit("short"), name("long"), F.lit(0.0)), (F.col("rate") < -threshold, F.lit("long"), name("short"), F.lit(0.0)))


#: Detectors by name; each takes bars and returns signals.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "wick_fill": wick_fill,
    "marubozu_retest": marubozu_retest,
    "orb_breakout": orb_breakout,
    "fvg": fair_value_gap,
    "order_block": order_block,
    "trend_day": trend_day,
    "engulfing": engulfing,
    "pin_bar": pin_bar,
    "inside_bar": inside_bar,
    "hammer": hammer,
    "doji": doji,
    "star": star,
    "equal_levels": equal_levels,
    "ote_entry": ote_entry,
    "ema_pullback": ema_pullback,
    "fibonacci_retracement": fibonacci_retracement,
}


def detect_all(bars: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Signals of several detectors with their ``strategy``; a lexical union, all series in each."""
    out = None
    for n in names or list(REGISTRY):
        one = REGISTRY[n](bars).withColumn("strategy", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out
