"""Market statistics over hourly bars, and digests of the run ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import SERIES


def _ts(shift_hours: int = 0) -> Column:
    return F.timestamp_millis(F.col("open_time") + shift_hours * 3_600_000)


def daily(bars: DataFrame, key: Column | None = None) -> DataFrame:
    """Day extremes, open and close, and when the extremes first printed; the day is the UTC date or ``key``."""
    b = bars.withColumn("day", key if key is not None else F.to_date(_ts()))
    w = Window.partitionBy(*SERIES, "day")
    b = b.withColumns({"day_high": F.max("high").over(w), "day_low": F.min("low").over(w)})
    return b.groupBy(*SERIES, "day", "day_high", "day_low").agg(
        F.min_by("open", "open_time").alias("day_open"),
        F.max_by("close", "open_time").alias("day_close"),
        F.min(F.when(F.col("high") == F.col("day_high"), F.col("open_time"))).alias("high_ts"),
        F.min(F.when(F.col("low") == F.col("day_low"), F.col("open_time"))).alias("low_ts"),
    )


def adr(bars: DataFrame) -> DataFrame:
    """Mean and median daily range of the newest 14 and 30 days, the newest day's share of it and its half."""
    d = daily(bars).where("day_open > 0").withColumn("r", (F.col("day_high") - F.col("day_low")) / F.col("day_open"))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("day"))))
    n = lambda m, f: f(F.when(F.col("k") <= m, F.col("r")))
    up = F.when(F.col("day_high") != F.col("day_low"), F.col("day_close") > (F.col("day_high") + F.col("day_low")) / 2)
    out = d.groupBy(*SERIES).agg(n(14, F.avg).alias("adr_14"), n(30, F.avg).alias("adr_30"), n(14, F.median).alias("adr_14_median"), n(30, F.median).alias("adr_30_median"), F.max(F.when(F.col("k") == 1, F.col("r"))).alias("today_range"), F.max(F.when(F.col("k") == 1, up)).alias("today_up"))
    return out.withColumn("today_consumed", F.try_divide("today_range", "adr_14"))


def weekday_patterns(bars: DataFrame) -> DataFrame:
    """Per weekday: ranges, returns with their standard error, share of rises, closes near an extreme."""
    d = daily(bars).where("day_open > 0")
    spread = F.col("day_high") - F.col("day_low")
    r, ret = spread / F.col("day_open"), (F.col("day_close") - F.col("day_open")) / F.col("day_open")
    near = lambda x: F.avg(F.when((spread > 0) & (x / F.nullif(spread, F.lit(0.0)) < 0.2), 1.0).otherwise(0.0))
    return d.groupBy(*SERIES, F.date_format("day", "EEEE").alias("dow")).agg(
        F.avg(r).alias("avg_range"),
        F.median(r).alias("median_range"),
        F.avg((F.col("day_close") > F.col("day_open")).cast("double")).alias("bull_pct"),
        F.count("*").alias("n"),
        F.avg(ret).alias("avg_return"),
        F.median(ret).alias("median_return"),
        (F.stddev_samp(ret) / F.sqrt(F.count("*"))).alias("return_stderr"),
        near(F.col("day_close") - F.col("day_low")).alias("strong_high"),
        near(F.col("day_high") - F.col("day_close")).alias("strong_low"),
    )


def hourly_extremes(bars: DataFrame) -> DataFrame:
    """Share of days whose first high or low falls in each hour at UTC+8; all 24 hours of every series."""
    d = daily(bars)
    hour = lambda c: F.hour(F.timestamp_millis(F.col(c) + 8 * 3_600_000))
    rows = d.select(*SERIES, hour("high_ts").alias("hh"), hour("low_ts").alias("lh"))
    n = rows.groupBy(*SERIES).agg(F.count("*").alias("n")).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    each = rows.select(*SERIES, F.explode(F.array(F.struct(F.col("hh").alias("hour"), F.lit(1.0).alias("h"), F.lit(0.0).alias("l")), F.struct(F.col("lh").alias("hour"), F.lit(0.0).alias("h"), F.lit(1.0).alias("l")))).alias("x")).select(*SERIES, "x.*").groupBy(*SERIES, "hour").agg(F.sum("h").alias("h"), F.sum("l").alias("l"))
    return n.join(each, [*SERIES, "hour"], "left").select(*SERIES, "hour", (F.coalesce("h", F.lit(0.0)) / F.col("n")).alias("high_pct"), (F.coalesce("l", F.lit(0.0)) / F.col("n")).alias("low_pct"))


def first_extreme(bars: DataFrame) -> DataFrame:
    """Per weekday: share of days whose low printed before the high, and of closes near the later extreme."""
    d = daily(bars)
    low_first, spread = F.col("low_ts") < F.col("high_ts"), F.col("day_high") - F.col("day_low")
    strong = F.when((spread > 0) & low_first & ((F.col("day_high") - F.col("day_close")) / F.nullif(spread, F.lit(0.0)) < 0.2), 1.0).when((spread > 0) & ~low_first & ((F.col("day_close") - F.col("day_low")) / F.nullif(spread, F.lit(0.0)) < 0.2), 1.0).otherwise(0.0)
    return d.groupBy(*SERIES, F.date_format("day", "EEEE").alias("dow")).agg(F.avg(low_first.cast("double")).alias("p1_low_pct"), F.count("*").alias("n"), F.avg(strong).alias("p1_strong_pct"))


def sessions(bars: DataFrame) -> DataFrame:
    """Share of New York days whose high or low a session made; days on which several tie count in each."""
    local = F.from_utc_timestamp(_ts(), "America/New_York")
    minute = F.hour(local) * 60 + F.minute(local)
    name = F.when(minute.between(240, 569), "Pre").when(minute.between(570, 899), "RTH").when(minute.between(900, 959), "Power").when(minute.between(960, 1199), "AH").otherwise("Other")
    b = bars.withColumns({"day": F.to_date(local), "session": name})
    w = Window.partitionBy(*SERIES, "day")
    b = b.withColumns({"h": F.col("high") == F.max("high").over(w), "l": F.col("low") == F.min("low").over(w)})
    per = b.groupBy(*SERIES, "day", "session").agg(F.max("h").alias("h"), F.max("l").alias("l"))
    total = b.groupBy(*SERIES).agg(F.countDistinct("day").alias("days"))
    return per.groupBy(*SERIES, "session").agg(F.count_if("h").alias("n_high"), F.count_if("l").alias("n_low")).join(total, list(SERIES)).select(*SERIES, "session", (F.col("n_high") / F.col("days")).alias("high_pct"), (F.col("n_low") / F.col("days")).alias("low_pct"), "days")


def weeks(bars: DataFrame, shift_hours: int = 0) -> DataFrame:
    """Per week from Monday: extremes, when they first printed, and the weekdays (1 to 7) of both."""
    d = daily(bars, F.to_date(F.date_trunc("week", _ts(shift_hours))))
    day = lambda c: F.weekday(F.timestamp_millis(F.col(c) + shift_hours * 3_600_000)) + 1
    return d.withColumnRenamed("day", "week").withColumns({"high_dow": day("high_ts"), "low_dow": day("low_ts")})


def weekly_first_extreme(bars: DataFrame) -> DataFrame:
    """Share of weeks whose low came first, and the commonest weekday of both (a tie: the earliest)."""
    w = weeks(bars)
    mode = lambda c: F.expr(f"mode() within group (order by {c})")
    return w.groupBy(*SERIES).agg(F.avg((F.col("low_ts") < F.col("high_ts")).cast("double")).alias("p1_low_pct"), F.count("*").alias("n"), mode("low_dow").alias("low_mode"), mode("high_dow").alias("high_mode"))


def weekly_timing(bars: DataFrame) -> DataFrame:
    """For each weekday: share of weeks (UTC+8) whose high, or low, is still ahead after it."""
    w = weeks(bars, 8).select(*SERIES, "high_dow", "low_dow", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow"))
    return w.groupBy(*SERIES, "dow").agg(F.avg((F.col("high_dow") > F.col("dow")).cast("double")).alias("high_ahead"), F.avg((F.col("low_dow") > F.col("dow")).cast("double")).alias("low_ahead"), F.count("*").alias("n"))


def _week_of(ms: Column) -> Column:
    """The Monday, at UTC+8, of the week of a time, in milliseconds."""
    shift = 8 * 3_600_000
    return F.unix_millis(F.date_trunc("week", F.timestamp_millis(ms + shift))) - shift


def _move(move: Column, unit: Column) -> Column:
    return F.when(F.abs(move) < unit, "small").when(F.abs(move) < 2 * unit, "medium").otherwise("large")


def weekly_moves(bars: DataFrame) -> DataFrame:
    """For each weekday and size of the week's move by its end (under one, two or more mean daily ranges): share of weeks, at
    UTC+8, whose low, or high, was still ahead."""
    unit = adr(bars).select(*SERIES, "adr_14")
    w = weeks(bars, 8).select(*SERIES, "week", "day_open", "high_dow", "low_dow")
    ts = _ts(8)
    eod = bars.groupBy(*SERIES, F.to_date(F.date_trunc("week", ts)).alias("week"), (F.weekday(ts) + 1).alias("dow")).agg(F.max_by("close", "open_time").alias("eod"))
    x = eod.join(w, [*SERIES, "week"]).join(unit, list(SERIES)).withColumn("move", _move(F.col("eod") / F.col("day_open") - 1, F.col("adr_14")))
    ahead = lambda c: F.avg((F.col(c) > F.col("dow")).cast("double"))
    return x.groupBy(*SERIES, "dow", "move").agg(F.count("*").alias("n"), ahead("low_dow").alias("low_ahead"), ahead("high_dow").alias("high_ahead"))


def weekly_state(bars: DataFrame) -> DataFrame:
    """Each series' newest week at UTC+8: its open, the newest close, the move between them and its size, and how often, after
    such a day of such a week, the low or the high was still ahead."""
    last = F.max("open_time").over(Window.partitionBy(*SERIES))
    cur = bars.withColumn("_last", last).where(F.col("open_time") >= _week_of(F.col("_last")))
    c = cur.groupBy(*SERIES).agg(F.min_by("open", "open_time").alias("week_open"), F.max_by("close", "open_time").alias("price"), F.max("open_time").alias("_t"))
    c = c.join(adr(bars).select(*SERIES, "adr_14"), list(SERIES)).withColumn("move_pct", F.col("price") / F.col("week_open") - 1)
    c = c.withColumns({"dow": F.weekday(F.timestamp_millis(F.col("_t") + 8 * 3_600_000)) + 1, "move": _move(F.col("move_pct"), F.col("adr_14"))})
    return c.join(weekly_moves(bars), [*SERIES, "dow", "move"], "left").select(*SERIES, "dow", "week_open", "price", "move_pct", "move", "n", "low_ahead", "high_ahead")


def first_wicks(bars: DataFrame, key: Column) -> DataFrame:
    """Per period: the side of its first extreme and the wick there, over that bar's open; none where one bar is both."""
    d = daily(bars, key).where("low_ts <> high_ts").select(*SERIES, "day", F.when(F.col("low_ts") < F.col("high_ts"), "low").otherwise("high").alias("first"), F.least("low_ts", "high_ts").alias("open_time"))
    x = d.join(bars, [*SERIES, "open_time"]).where("open > 0")
    wick = F.when(F.col("first") == "low", F.least("open", "close") - F.col("low")).otherwise(F.col("high") - F.greatest("open", "close"))
    return x.select(*SERIES, "day", "first", (wick / F.col("open")).alias("wick"))


def wick_percentile(bars: DataFrame) -> DataFrame:
    """The wick of the newest week's first extreme in mean daily ranges, and the share of weeks with a longer one."""
    unit = adr(bars).where("adr_14 > 0").select(*SERIES, "adr_14")
    past = first_wicks(bars, F.to_date(F.date_trunc("week", _ts()))).select(*SERIES, F.col("wick").alias("h"))
    last = F.max("open_time").over(Window.partitionBy(*SERIES))
    cur = bars.withColumn("_last", last).where(F.col("open_time") >= _week_of(F.col("_last"))).drop("_last")
    now = first_wicks(cur, F.lit(0)).join(unit, list(SERIES))
    return past.join(now, list(SERIES)).groupBy(*SERIES, "first", (F.col("wick") / F.col("adr_14")).alias("wick_of_adr")).agg(F.avg((F.col("h") > F.col("wick")).cast("double")).alias("exceeded"), F.count("*").alias("n"))


def pooled(avg: str, n: str = "closed_trades") -> Column:
    """Trade-weighted mean of a per-run average; both sums over the rows that have one."""
    return F.sum(F.col(avg) * F.col(n)) / F.nullif(F.sum(F.when(F.col(avg).isNotNull(), F.col(n))), F.lit(0))


def by_symbol(runs: DataFrame, least: int = 5) -> DataFrame:
    r = runs.where(F.col("closed_trades") >= least).withColumn("top", F.max("avg_r").over(Window.partitionBy("symbol")))
    return r.groupBy("symbol").agg(F.sum("total_r").alias("total_r"), pooled("avg_r").alias("avg_r"), F.sum("closed_trades").alias("trades"), F.count("*").alias("run_count"), F.max(F.when(F.col("avg_r") == F.col("top"), F.col("strategy"))).alias("best_strategy"))


def by_key(runs: DataFrame, key: str, least: int = 5) -> DataFrame:
    return runs.where(F.col("closed_trades") >= least).groupBy(key).agg(pooled("avg_r").alias("avg_r"), F.sum("total_r").alias("total_r"), F.sum("closed_trades").alias("trades"), F.count("*").alias("run_count"), (pooled("win_rate") * 100).alias("win_pct"))


def top_cells(runs: DataFrame, least: int = 5, top_n: int = 20) -> DataFrame:
    """The n best cells by mean R; ties by the cell's keys."""
    cols = ("symbol", "timeframe", "strategy", "day_filter", "adr_suppress_threshold", "volume_suppress")
    return runs.where(F.col("closed_trades") >= least).orderBy(F.desc("avg_r"), *cols).limit(top_n).select(*cols, "closed_trades", "avg_r")


def ab(runs: DataFrame, flag: Column, keys: list[str], least: int = 5) -> DataFrame:
    """Mean R with and without a gate, for cells alike in all else."""
    r = runs.where(F.col("closed_trades") >= least)
    side = lambda on, p: r.where(flag if on else ~flag).select(*keys, F.col("avg_r").alias(f"{p}_avg_r"), F.col("closed_trades").alias(f"{p}_trades"))
    on, off = side(True, "on"), side(False, "off")
    same = [on[k].eqNullSafe(off[k]) for k in keys]
    return on.join(off, same).select(*(on[k] for k in keys), "on_avg_r", "off_avg_r", (F.col("on_avg_r") - F.col("off_avg_r")).alias("delta"), "on_trades", "off_trades")


def direction_bias(runs: DataFrame, least: int = 3) -> DataFrame:
    r = runs.where((F.col("long_closed_trades") >= least) & (F.col("short_closed_trades") >= least))
    side = lambda d, c: pooled(f"{d}_{c}", f"{d}_closed_trades")
    return r.groupBy("strategy").agg(
        side("long", "avg_r").alias("long_avg_r"), side("short", "avg_r").alias("short_avg_r"), (side("long", "avg_r") - side("short", "avg_r")).alias("long_minus_short"),
        F.sum("long_closed_trades").alias("long_trades"), F.sum("short_closed_trades").alias("short_trades"), (side("long", "win_rate") * 100).alias("long_win_pct"), (side("short", "win_rate") * 100).alias("short_win_pct"),
    )


def consistency(runs: DataFrame, least: int = 5) -> DataFrame:
    good = F.count_if(F.col("avg_r") > 0)
    return runs.where(F.col("closed_trades") >= least).groupBy("strategy").agg(F.count("*").alias("cells"), good.alias("profitable"), (100.0 * good / F.count("*")).alias("pct_profitable"), pooled("avg_r").alias("avg_r"), F.sum("closed_trades").alias("trades"))


def recovery(runs: DataFrame, least: int = 5) -> DataFrame:
    """Per strategy: mean and best recovery factor of the runs that recovered, with their drawdowns.

    Drawdowns are averaged as decimals: in doubles, a mean half way between two last places goes by the order of runs.
    """
    r = runs.where((F.col("closed_trades") >= least) & (F.col("recovery_factor") > 0))
    return r.groupBy("strategy").agg(F.avg("recovery_factor").alias("avg_rf"), F.max("recovery_factor").alias("best_rf"), F.avg(F.col("max_drawdown_r").cast("decimal(28,9)")).cast("double").alias("avg_max_dd_r"), pooled("avg_r").alias("avg_r"), F.sum("closed_trades").alias("trades"), F.count("*").alias("run_count"))


def leaderboard(runs: DataFrame, keys: list[str], least: int = 3, top_n: int = 30) -> DataFrame:
    """The best of the newest run of each key by mean R; ties by the keys."""
    w = Window.partitionBy(*keys).orderBy(F.desc("run_at_ms"))
    r = runs.where(F.col("closed_trades") >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return r.orderBy(F.desc("avg_r"), *keys).limit(top_n)


def latest(runs: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("run_at_ms"), *ties)
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stars(avg_r: Column, n: Column, least: int = 10) -> Column:
    return F.when(n >= least, F.when(avg_r < 0, 1).when(avg_r < 0.2, 2).when(avg_r < 0.5, 3).when(avg_r < 0.9, 4).otherwise(5))


def ratings(runs: DataFrame, least: int = 10) -> DataFrame:
    """Stars per strategy and timeframe, from the newest run of each symbol."""
    r = latest(runs, ["strategy", "timeframe", "symbol"], ["day_filter", "adr_suppress_threshold", "volume_suppress"])
    m = r.groupBy("strategy", "timeframe").agg(F.round(pooled("avg_r"), 4).alias("avg_r"), F.round(pooled("win_rate"), 4).alias("win_rate"), F.sum("closed_trades").alias("trades"))
    return m.withColumn("stars", stars(F.col("avg_r"), F.col("trades"), least))


def directional_ratings(runs: DataFrame, least: int = 5) -> DataFrame:
    side = F.expr("stack(2, 'long', long_avg_r, long_closed_trades, 'short', short_avg_r, short_closed_trades) as (direction, d_avg, d_n)")
    r = runs.select("strategy", "timeframe", side).groupBy("strategy", "timeframe", "direction").agg(pooled("d_avg", "d_n").alias("avg_r"), F.sum("d_n").alias("trades"))
    return r.withColumn("stars", stars(F.col("avg_r"), F.col("trades"), least))


def weekly_flip_risk(bars: DataFrame) -> DataFrame:
    """For each weekday and side of the week's first extreme: share of weeks whose second one is still ahead."""
    w = weeks(bars)
    low_first = F.col("low_ts") < F.col("high_ts")
    w = w.select(*SERIES, F.when(low_first, "low").otherwise("high").alias("first"), F.when(low_first, F.col("high_dow")).otherwise(F.col("low_dow")).alias("second"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("dow"))
    return w.groupBy(*SERIES, "first", "dow").agg(F.avg((F.col("second") > F.col("dow")).cast("double")).alias("ahead"), F.count("*").alias("n"))


def edge_slices(trades: DataFrame) -> DataFrame:
    """Standalone cells by strategy, timeframe and UTC session third: count, mean R, win rate, share of the strategy."""
    third = F.element_at(F.array(F.lit("asia"), F.lit("europe"), F.lit("us")), (F.hour(F.timestamp_millis("entry_time")) / 8).cast("int") + 1)
    g = trades.groupBy("strategy", "timeframe", third.alias("session")).agg(F.count("*").alias("n"), F.avg("pnl_r").alias("avg_r"), F.avg((F.col("pnl_r") > 0).cast("double")).alias("win_rate"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("strategy")))


def verdicts(slices: DataFrame, least: int = 30) -> DataFrame:
    """KILL, DEMOTE or KEEP for each strategy and timeframe by pooled R of its slices."""
    m = slices.groupBy("strategy", "timeframe").agg((F.sum(F.col("avg_r") * F.col("n")) / F.sum("n")).alias("avg_r"), F.sum("n").alias("n"), F.count_if(F.col("avg_r") > 0).alias("good"), F.count("*").alias("slices"))
    v = F.when(F.col("n") < least, "INSUFFICIENT").when((F.col("avg_r") < 0) & (F.col("good") == 0), "KILL").when(F.col("avg_r") < 0, "DEMOTE").otherwise("KEEP")
    return m.withColumn("verdict", v)
