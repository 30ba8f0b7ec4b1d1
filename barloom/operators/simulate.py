"""Trade simulation on bars: entries, first-touch exits, costs, gates and result metrics."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import atr_mean, volume_flags
from ..sources.tables import SERIES, as_of, series
from .search import first_touch

ORDER = ("symbol", "timeframe", "strategy")


def fill(level: Column, bar_open: Column, down: Column) -> Column:
    """Fill price of a level: the bar's open if that is beyond it already."""
    return F.when(down, F.least(level, bar_open)).otherwise(F.greatest(level, bar_open))


@dataclass(frozen=True)
class Costs:
    """Trading costs: half spreads in basis points by bucket of daily dollar volume, impact, borrow for shorts, commission.

    A volume on a floor is in the more liquid bucket; one that isn't known is in the least liquid.
    """

    floors: tuple[float, ...] = (5e6, 5e7, 5e8)
    half_spread_bps: tuple[float, ...] = (20.0, 8.0, 3.0, 1.0)
    impact: float = 1.0
    notional: float = 10_000.0
    borrow_a_year: float = 0.01
    commission_bps: float = 0.0
    window_days: float = 20.0


@dataclass(frozen=True)
class Rules:
    """How trades are made of signals. Values by direction, where given, stand before those for both.

    Stops are a signal's own, else ``atr_multiple`` mean ranges away, else ``sl_pct``; none lies nearer than ``min_sl_pct``,
    nor, with ``atr_floor``, nearer than the multiple. ``suppress`` drops signals on bars of low volume, but, with ``boost``,
    not those on spikes. With ``costs``, these stand for the flat fee.
    """

    tp_r: float = 2.0
    tp_r_long: float | None = None
    tp_r_short: float | None = None
    sl_pct: float = 0.02
    min_sl_pct: float = 0.0
    atr_multiple: float | None = None
    atr_floor: bool = False
    suppress: bool = False
    suppress_long: bool | None = None
    suppress_short: bool | None = None
    boost: bool = False
    boost_long: bool | None = None
    boost_short: bool | None = None
    fee_pct: float = 0.0
    costs: Costs | None = None

    def by_side(self, name: str) -> Column:
        both, long, short = (getattr(self, name + x) for x in ("", "_long", "_short"))
        return F.when(F.col("long"), F.lit(both if long is None else long)).otherwise(F.lit(both if short is None else short))


#: Bars of a trading day by timeframe; others count as days.
BARS_A_DAY = {"1h": 7.0, "4h": 2.0, "1d": 1.0, "1wk": 0.2}


def volume_context(bars: DataFrame, window_days: float = 20.0) -> DataFrame:
    """Adds ``adv``, trailing mean dollar volume, and ``sigma``, population deviation of returns, both a day's, at each bar.

    Null where the window holds too little: any positive volume, and two returns.
    """
    a_day = F.lit(1.0)
    for timeframe, n in BARS_A_DAY.items():
        a_day = F.when(F.col("timeframe") == timeframe, n).otherwise(a_day)
    b = bars.withColumns({"_ret": F.try_divide("close", F.lag("close").over(series())) - 1, "_a_day": a_day})
    # every width in one sort of the bars; a row takes those of its timeframe
    dollars, own = F.col("close") * F.col("volume"), sorted({n for n in BARS_A_DAY.values()} | {1.0})
    adv, many, sigma = F.lit(None).cast("double"), F.lit(None).cast("long"), F.lit(None).cast("double")
    for x in own:
        n = max(2, round(window_days * x))
        w, r = series().rowsBetween(1 - n, 0), series().rowsBetween(2 - n, 0)
        adv, many, sigma = (F.when(F.col("_a_day") == x, new).otherwise(old) for new, old in ((F.avg(dollars).over(w), adv), (F.count("_ret").over(r), many), (F.stddev_pop("_ret").over(r), sigma)))
    b = b.withColumns({"_adv": adv * F.col("_a_day"), "_many": many, "_sd": sigma})
    return b.withColumns({"adv": F.when(F.col("_adv") > 0, F.col("_adv")), "sigma": F.when(F.col("_many") >= 2, F.col("_sd") * F.sqrt("_a_day"))}).drop("_ret", "_a_day", "_adv", "_many", "_sd")


def entries(bars: DataFrame, signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Signals with the time and price they enter at, the next bar's open, as ``signal_time, entry_time, entry, long``.

    ``low`` and ``spike`` tell the volume of the signal's bar; ``atr``, ``adv`` and ``sigma`` are there where rules need them.
    Signals off the bars' clock and those on a series' last bar make no trade.
    """
    w = series()
    b = volume_flags(bars)
    more = []
    if rules.atr_multiple is not None:
        b, more = atr_mean(b, name="atr"), ["atr"]
    if rules.costs:
        b, more = volume_context(b, rules.costs.window_days), [*more, "adv", "sigma"]
    after = b.select(*SERIES, "open_time", F.col("low_volume").alias("low"), F.col("volume_spike").alias("spike"), *more, F.lead("open_time").over(w).alias("entry_time"), F.lead("open").over(w).alias("entry")).where("entry_time is not null")
    out = signals.join(after, [*SERIES, "open_time"]).withColumnRenamed("open_time", "signal_time").withColumn("long", F.col("direction") == "long")
    return out.where(~(rules.by_side("suppress") & F.col("low") & ~(rules.by_side("boost") & F.col("spike"))))


def exits(bars: DataFrame, entered: DataFrame, rules: Rules = Rules(), tp_r: Column | None = None, sl_pct: Column | None = None) -> DataFrame:
    """Trades of ``entries``: the first touch of stop or target from the entry bar to the end of the series.

    The stop wins a bar that touches both. A bar that opens beyond a level fills at its open, one on the wrong side of the
    entry at the level. A trade without a touch is open (no exit). ``tp_r`` and ``sl_pct`` as columns stand for the rules'.
    """
    long, entry, own = F.col("long"), F.col("entry"), F.col("sl_price")
    sign, tp_r = F.when(long, 1.0).otherwise(-1.0), rules.by_side("tp_r") if tp_r is None else tp_r
    nearest = entry * rules.min_sl_pct
    away = entry * (F.lit(rules.sl_pct) if sl_pct is None else sl_pct)
    if rules.min_sl_pct:
        own = F.when(own.isNotNull(), F.when(long, F.least(own, entry - nearest)).otherwise(F.greatest(own, entry + nearest)))
    if rules.atr_multiple is not None:
        atr = F.col("atr") * rules.atr_multiple
        away = F.coalesce(F.when(atr.isNotNull(), F.greatest(atr, nearest)), away)
        if rules.atr_floor:
            own = F.when(atr > F.abs(entry - own), entry - sign * atr).otherwise(own)
    at = entered.withColumn("sl", F.coalesce(own, entry - sign * away))
    at = at.withColumn("risk", F.abs(entry - F.col("sl"))).withColumn("tp", entry + sign * tp_r * F.col("risk"))
    at = at.withColumns({"_below": F.when(F.col("long"), F.col("sl")).otherwise(F.col("tp")), "_above": F.when(F.col("long"), F.col("tp")).otherwise(F.col("sl"))})
    at = first_touch(bars, at, "entry_time", "_below", "_above").withColumn("stopped", F.expr("if(long, x.low <= sl, x.high >= sl)"))
    side = (entry - F.col("sl")) * sign > 0
    price = F.when(F.col("stopped"), F.when(side, fill(F.col("sl"), F.col("x.open"), F.col("long"))).otherwise(F.col("sl"))).otherwise(fill(F.col("tp"), F.col("x.open"), ~F.col("long")))
    at = at.withColumn("exit", F.when(F.col("x").isNotNull(), price)).withColumn("outcome", F.when(F.col("x").isNull(), "open").when(F.col("stopped"), "loss").otherwise("win")).withColumn("exit_time", F.col("x.open_time"))
    if rules.costs:
        at = at.withColumns(cost_r(rules.costs))
        cost = F.col("cost_r") * F.col("risk")
    else:
        cost = 2 * rules.fee_pct * entry
    pnl = F.when(F.col("risk") > 0, ((F.col("exit") - entry) * sign - cost) / F.col("risk"))
    return at.withColumn("pnl_r", pnl).drop("x", "stopped", "_below", "_above")


TRADE = ("signal_time", "direction", "entry_time", "entry", "sl", "tp", "exit_time", "exit", "outcome", "pnl_r")
COST = ("spread_r", "impact_r", "borrow_r", "commission_r", "cost_r")


def simulate(bars: DataFrame, signals: DataFrame, rules: Rules = Rules(), **over) -> DataFrame:
    """Trades of signals, by ``entries`` and ``exits``, with the strategy where there is one, and costs where rules have them.

    Values of ``Rules`` may be given by name.
    """
    rules = replace(rules, **over)
    at = exits(bars, entries(bars, signals, rules), rules)
    return at.select(*[c for c in ORDER if c in at.columns], *TRADE, *(COST if rules.costs else ()))


def metrics(trades: DataFrame, keys: tuple[str, ...] = ORDER) -> DataFrame:
    """Per cell: counts, win rate, R by direction, Sharpe ratio, largest drawdown and recovery factor.

    The drawdown is that of summed R in the order of signals, from a peak of at least 0.
    """
    w = Window.partitionBy(*keys).orderBy("signal_time", "direction")
    closed = trades.where("pnl_r is not null").withColumn("_cum", F.sum("pnl_r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    closed = closed.withColumn("_dd", F.greatest(F.lit(0.0), F.max("_cum").over(w.rowsBetween(Window.unboundedPreceding, 0))) - F.col("_cum"))
    side = lambda d: F.avg(F.when(F.col("direction") == d, F.col("pnl_r")))
    out = closed.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((F.col("pnl_r") > 0).cast("double")).alias("win_rate"),
        F.avg("pnl_r").alias("avg_r"),
        F.sum("pnl_r").alias("total_r"),
        side("long").alias("long_avg_r"),
        side("short").alias("short_avg_r"),
        F.coalesce(F.try_divide(F.avg("pnl_r"), F.stddev_samp("pnl_r")), F.lit(0.0)).alias("sharpe"),
        F.max("_dd").alias("max_dd"),
    )
    return out.withColumn("recovery", F.coalesce(F.try_divide("total_r", F.nullif("max_dd", F.lit(0.0))), F.lit(0.0)))


def grid(bars: DataFrame, signals: DataFrame, tp_rs: list[float], sl_pcts: list[float], min_trades: int = 5) -> DataFrame:
    """Score of each (tp_r, sl_pct) and cell: mean R x win rate x sqrt(n), 0 with few trades or no gain.

    Entries are found once and spread over the grid; all its cells are searched in one pass.
    """
    lists = [F.array(*map(F.lit, v)) for v in (tp_rs, sl_pcts)]
    no_level = F.lit(None).cast("double")
    e = entries(bars, signals.withColumn("sl_price", no_level)).withColumn("tp_r", F.explode(lists[0])).withColumn("sl_pct", F.explode(lists[1]))
    m = metrics(exits(bars, e, Rules(), F.col("tp_r"), F.col("sl_pct")), (*ORDER, "tp_r", "sl_pct"))
    score = F.when((F.col("n") >= min_trades) & (F.col("avg_r") > 0), F.col("avg_r") * F.col("win_rate") * F.sqrt("n")).otherwise(0.0)
    return m.select(*ORDER, "tp_r", "sl_pct", "n", "avg_r", score.alias("score"))


def cost_r(c: Costs) -> dict[str, Column]:
    """Columns of trades: each cost in R and their sum, from ``entry, risk, adv, sigma, long, entry_time, exit_time``."""
    adv, to_r = F.col("adv"), F.try_divide("entry", "risk")
    bucket = sum((F.coalesce(adv, F.lit(0.0)) >= x).cast("int") for x in c.floors)
    half = F.element_at(F.array(*map(F.lit, c.half_spread_bps)), bucket + 1) / 10_000
    days = F.greatest(F.lit(0.0), (F.col("exit_time") - F.col("entry_time")) / 86_400_000)
    out = {
        "spread_r": 2 * half * to_r,
        "impact_r": F.coalesce(F.when((adv > 0) & (F.col("sigma") > 0), 2 * c.impact * F.col("sigma") * F.sqrt(c.notional / adv) * to_r), F.lit(0.0)),
        "borrow_r": F.coalesce(F.when(~F.col("long"), c.borrow_a_year * days / 365 * to_r), F.lit(0.0)),
        "commission_r": 2 * c.commission_bps / 10_000 * to_r,
    }
    return out | {"cost_r": sum(out.values())}


def cooldown(signals: DataFrame, bars_between: int, tf_ms: int, keys: tuple[str, ...] = ORDER) -> DataFrame:
    """Signals at least so many bars after the last one kept, per cell and direction: greedy, so a fold per cell."""

    def run(one: pd.DataFrame) -> pd.DataFrame:
        one, last, keep = one.sort_values("open_time"), None, []
        for t in one["open_time"]:
            ok = last is None or t - last >= bars_between * tf_ms
            last = t if ok else last
            keep.append(ok)
        return one[keep]

    return signals.groupBy(*keys, "direction").applyInPandas(run, signals.schema)


def resolve_conflicts(signals: DataFrame, confidence: DataFrame) -> DataFrame:
    """Where one bar has both directions, those of the side with the higher top confidence; a tie keeps both."""
    s = signals.join(confidence, ["strategy", "direction"], "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    w = Window.partitionBy(*SERIES, "open_time")
    best = lambda d: F.max(F.when(F.col("direction") == d, F.col("confidence"))).over(w)
    s = s.withColumns({"_l": best("long"), "_s": best("short")})
    keep = F.col("_l").isNull() | F.col("_s").isNull() | F.when(F.col("direction") == "long", F.col("_l") >= F.col("_s")).otherwise(F.col("_s") >= F.col("_l"))
    return s.where(keep).select(*signals.columns, "confidence")


def split(bars: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """The first share of each series' bars, and the rest."""
    w = Window.partitionBy(*SERIES)
    b = bars.withColumns({"_k": F.row_number().over(w.orderBy("open_time")), "_n": F.floor(F.count("*").over(w) * share)})
    return b.where("_k <= _n").drop("_k", "_n"), b.where("_k > _n").drop("_k", "_n")


def audit(bars: DataFrame, detect, tp_rs: list[float], sl_pcts: list[float], share: float = 0.7, min_trades: int = 5) -> DataFrame:
    """The grid in and out of sample: scores, ``decay`` of the score, whether a row is overfit (no gain outside, or under 0.4 of
    the score), and ``pick``, the best row by the score in sample that isn't.

    ``detect`` makes signals of bars, with their strategy, on each part for itself.
    """
    inside, outside = (grid(b, detect(b), tp_rs, sl_pcts, least) for b, least in zip(split(bars, share), (min_trades, 1), strict=True))
    keys = [*ORDER, "tp_r", "sl_pct"]
    x = inside.withColumnsRenamed({c: f"in_{c}" for c in ("n", "avg_r", "score")}).join(outside.withColumnsRenamed({c: f"out_{c}" for c in ("n", "avg_r", "score")}), keys, "left")
    x = x.withColumn("out_score", F.coalesce("out_score", F.lit(0.0))).withColumn("decay", F.when(F.col("in_score") > 0, F.col("out_score") / F.col("in_score")))
    x = x.withColumn("overfit", F.coalesce(F.col("out_avg_r") <= 0, F.lit(True)) | F.coalesce(F.col("decay") < 0.4, F.lit(False)))
    w = Window.partitionBy(*ORDER).orderBy("overfit", F.desc("in_score"), "tp_r", "sl_pct")
    return x.withColumn("pick", (F.row_number().over(w) == 1) & ~F.col("overfit"))


def pooled_winner(rows: DataFrame, least: int = 30) -> DataFrame:
    """Trades of several symbols pooled by strategy, timeframe and ``tp_r``, with ``pick``: the largest mean R of those with enough
    trades, of equal ones the smaller target."""
    p = rows.where("pnl_r is not null").groupBy("strategy", "timeframe", "tp_r").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("symbols"), F.avg("pnl_r").alias("avg_r"), F.avg((F.col("pnl_r") > 0).cast("double")).alias("win_rate"))
    w = Window.partitionBy("strategy", "timeframe").orderBy(F.when(F.col("n") >= least, F.col("avg_r")).desc_nulls_last(), "tp_r")
    return p.withColumn("pick", (F.row_number().over(w) == 1) & (F.col("n") >= least))


def one_of_each(trades: DataFrame, keys: tuple[str, ...] = ORDER) -> DataFrame:
    """One trade per cell, signal time and direction: a closed one before an open one, then the earlier exit."""
    w = Window.partitionBy(*keys, "signal_time", "direction").orderBy(F.col("exit_time").isNull(), "exit_time", "entry")
    return trades.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: Timeframes with several bars a day, where a part of the day's range can be used up.
INTRADAY = ("1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h")


def adr_gate(bars: DataFrame, signals: DataFrame, threshold: float, exempt: tuple[str, ...] = ()) -> DataFrame:
    """Signals that don't chase a day that has run ``threshold`` of its mean range of 14 days, today's included.

    Ranges are shares of the day's open. Longer timeframes, exempt strategies and signals off the bars' clock stay.
    """
    day = F.to_date(F.timestamp_millis("open_time"))
    run = Window.partitionBy(*SERIES, "_day").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    b = bars.where(F.col("timeframe").isin(*INTRADAY)).withColumn("_day", day)
    b = b.withColumns({"_hi": F.max("high").over(run), "_lo": F.min("low").over(run), "_o": F.first("open").over(run)})
    daily = b.groupBy(*SERIES, "_day").agg(((F.max("high") - F.min("low")) / F.nullif(F.min_by("open", "open_time"), F.lit(0.0))).alias("_range"))
    daily = daily.withColumn("_adr", F.avg("_range").over(Window.partitionBy(*SERIES).orderBy("_day").rowsBetween(-13, 0)))
    b = b.join(daily, [*SERIES, "_day"]).select(*SERIES, "open_time", "_hi", "_lo", "_o", "_adr", "close")
    s = signals.join(b, [*SERIES, "open_time"], "left")
    up = F.col("close") > (F.col("_hi") + F.col("_lo")) / 2
    used = F.try_divide((F.col("_hi") - F.col("_lo")) / F.nullif(F.col("_o"), F.lit(0.0)), F.col("_adr"))
    chased = (used >= threshold) & F.when(F.col("direction") == "long", up).otherwise(~up)
    if exempt:
        chased = chased & ~F.col("strategy").isin(*exempt)
    return s.where(~F.coalesce(chased, F.lit(False))).select(*signals.columns)


def effective_adr_threshold(threshold: Column, timeframe: Column, exempt: Column) -> Column:
    """The threshold that could gate a cell, null where the gate did nothing."""
    return F.when(timeframe.isin(*INTRADAY) & ~exempt, threshold)


def regime_gate(signals: DataFrame, regimes: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Signals whose strategy may fire in the regime of the last closed bar of a higher timeframe.

    ``regimes(symbol, open_time, regime)``; the bar before the latest at or before a signal counts. Unknown regimes, no such
    bar and strategies without a list stay.
    """
    r = regimes.select("symbol", "open_time", "regime")
    s = as_of(signals.withColumn("_t", F.col("open_time")), r, ["symbol"], "_t", "open_time", ["regime"], lag=1)
    ok = F.lit(True)
    for strategy, names in allowed.items():
        ok = F.when(F.col("strategy") == strategy, F.col("regime").isin(*names)).otherwise(ok)
    return s.where(F.col("regime").isNull() | (F.col("regime") == "unknown") | ok).select(*signals.columns)


def trend_gate(signals: DataFrame, slopes: DataFrame, deadband: float = 0.0) -> DataFrame:
    """Signals that don't go against the slope of the last closed bar of a higher timeframe, ``slopes(symbol, open_time, slope)``."""
    s = as_of(signals.withColumn("_t", F.col("open_time")), slopes.select("symbol", "open_time", "slope"), ["symbol"], "_t", "open_time", ["slope"], lag=1)
    against = (F.abs("slope") >= deadband) & F.when(F.col("direction") == "long", F.col("slope") < 0).otherwise(F.col("slope") > 0)
    return s.where(~F.coalesce(against, F.lit(False))).select(*signals.columns)


def direction_gate(signals: DataFrame, suppressed: dict[str, list[str]]) -> DataFrame:
    """Signals but those of a strategy's suppressed directions."""
    gone = F.lit(False)
    for strategy, sides in suppressed.items():
        gone = gone | (F.col("strategy") == strategy) & F.col("direction").isin(*sides)
    return signals.where(~gone)


def day_gate(signals: DataFrame, weekdays: list[int] | None = None) -> DataFrame:
    """Signals of some weekdays in UTC (Monday 0); none given, all."""
    return signals if weekdays is None else signals.where(F.weekday(F.timestamp_millis("open_time")).isin(*weekdays))


def ev_gate(cells: DataFrame, threshold: float = 0.0, min_trades: int = 10, min_z: float = 1.645) -> DataFrame:
    """Adds ``passes``: false where enough trades have a mean R significantly below the threshold."""
    z = (threshold - F.col("avg_r")) / (F.col("sd_r") / F.sqrt("n"))
    fails = (F.col("n") >= min_trades) & (F.col("avg_r") < threshold) & F.when(F.col("sd_r") > 0, z >= min_z).otherwise(F.col("n") >= 5)
    return cells.withColumn("passes", ~F.coalesce(fails, F.lit(False)))


def folds(bars: DataFrame, k: int, purge_ms: int, embargo_ms: int) -> DataFrame:
    """Contiguous folds of each series: bounds, and how many bars outside purge and embargo may train."""
    f = bars.withColumn("fold", F.ntile(k).over(series()))
    b = f.groupBy(*SERIES, "fold").agg(F.min("open_time").alias("t0"), F.max("open_time").alias("t1"), F.count("*").alias("n_test"))
    can = (F.col("open_time") < F.col("t0") - purge_ms) | (F.col("open_time") > F.col("t1") + embargo_ms)
    return bars.select(*SERIES, "open_time").join(b, list(SERIES)).groupBy(*SERIES, "fold", "t0", "t1", "n_test").agg(F.count_if(can).alias("n_train"))
