"""Readers: the bar table and the ledgers, derived from the driver's tables, and lookups on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
TF_MS = {"1h": HOUR_MS, "4h": 4 * HOUR_MS, "1d": DAY_MS, "1wk": 7 * DAY_MS}
SERIES = ("symbol", "timeframe")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a UTC timestamp column without a zone."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


def series(*order: str) -> Window:
    return Window.partitionBy(*SERIES).orderBy(*(order or ("open_time",)))


def bars_1h(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    """Hourly bars of event values: a series per event type, or one of all. Open and close follow (ts, event_id)."""
    e = table(spark, sf_dir, "events").select(
        F.lit("ALL").alias("symbol") if pooled else F.col("event_type").alias("symbol"),
        F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("open_time"),
        F.struct("ts", "event_id").alias("at"),
        "value",
    )
    return (
        e.groupBy("symbol", F.lit("1h").alias("timeframe"), "open_time")
        .agg(F.min_by("value", "at").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "at").alias("close"), F.count("*").cast("double").alias("volume"))
    )


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices, a series per return flag and line status."""
    x = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.unix_millis(F.date_trunc("day", F.col("l_shipdate").cast("timestamp"))).alias("open_time"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        "l_quantity",
    )
    return (
        x.groupBy("symbol", F.lit("1d").alias("timeframe"), "open_time")
        .agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("l_quantity").alias("volume"))
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of closed trades, one per order line."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("trade_id"),
        F.concat(F.lit("S"), F.col("l_suppkey") % 10).alias("symbol"),
        F.element_at(F.array(F.lit("1h"), F.lit("4h"), F.lit("1d")), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("timeframe"),
        F.col("l_returnflag").alias("strategy"),
        F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("direction"),
        millis("l_shipdate").alias("entry_time"),
        F.round((F.col("l_discount") - 0.05) * 20, 6).alias("pnl_r"),
        F.when(F.col("l_orderkey") % 2 == 0, "off").otherwise("weekdays").alias("day_filter"),
        F.when(F.col("l_quantity") > 25, 0.8).alias("adr_suppress_threshold"),
        (F.col("l_tax") > 0.04).alias("volume_suppress"),
    )


RUN_KEYS = ("symbol", "timeframe", "strategy", "day_filter", "adr_suppress_threshold", "volume_suppress")


def runs(ledger: DataFrame) -> DataFrame:
    """The run ledger: one aggregate row per parameter cell. A side without trades has null averages."""
    side = lambda d: F.col("direction") == d
    aggs = [F.count("*").alias("closed_trades"), F.avg("pnl_r").alias("avg_r"), F.sum("pnl_r").alias("total_r"), F.avg((F.col("pnl_r") > 0).cast("double")).alias("win_rate")]
    for d in ("long", "short"):
        aggs += [
            F.count_if(side(d)).alias(f"{d}_closed_trades"),
            F.avg(F.when(side(d), F.col("pnl_r"))).alias(f"{d}_avg_r"),
            F.avg(F.when(side(d), (F.col("pnl_r") > 0).cast("double"))).alias(f"{d}_win_rate"),
        ]
    return ledger.groupBy(*RUN_KEYS).agg(*aggs, F.max("entry_time").alias("run_at_ms"))


def drawdown_runs(ledger: DataFrame) -> DataFrame:
    """The run ledger with ``max_drawdown_r``, of summed R in the order of entry, and ``recovery_factor``."""
    w = Window.partitionBy(*RUN_KEYS).orderBy("entry_time", "trade_id").rowsBetween(Window.unboundedPreceding, 0)
    t = ledger.withColumn("_cum", F.sum("pnl_r").over(w))
    t = t.withColumn("_dd", F.greatest(F.lit(0.0), F.max("_cum").over(w)) - F.col("_cum"))
    g = t.groupBy(*RUN_KEYS).agg(F.count("*").alias("closed_trades"), F.avg("pnl_r").alias("avg_r"), F.sum("pnl_r").alias("total_r"), F.avg((F.col("pnl_r") > 0).cast("double")).alias("win_rate"), F.max("_dd").alias("max_drawdown_r"), F.max("entry_time").alias("run_at_ms"))
    return g.withColumn("recovery_factor", F.try_divide("total_r", F.nullif(F.col("max_drawdown_r"), F.lit(0.0))))


def scan(bars: DataFrame, symbol: str, timeframe: str, start: int, end: int) -> DataFrame:
    """Bars of one series with open_time from start to end, both included."""
    return bars.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe) & F.col("open_time").between(start, end))


def close_at(asks: DataFrame, bars: DataFrame) -> DataFrame:
    """``asks(symbol, timeframe, open_time)`` with the close of exactly that bar; null where there is none."""
    return asks.join(bars.select(*SERIES, "open_time", "close"), [*SERIES, "open_time"], "left")


def history(signals: DataFrame, symbol: str, timeframe: str, start: int, end: int) -> DataFrame:
    """A series' signals from start to end, newest first."""
    return scan(signals, symbol, timeframe, start, end).orderBy(F.desc("open_time"), "direction")


def complete(progress: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted symbols that are not marked as complete yet."""
    return wanted.join(progress.select("symbol").distinct(), "symbol", "left_anti")


def coverage(bars: DataFrame) -> DataFrame:
    """First and last bar and count of each series."""
    return bars.groupBy(*SERIES).agg(F.min("open_time").alias("first_bar"), F.max("open_time").alias("last_bar"), F.count("*").alias("n_bars"))


def universe_coverage(bars: DataFrame, members: DataFrame, timeframes: list[str]) -> DataFrame:
    """Coverage of every member in every timeframe, those without bars included."""
    want = members.select("symbol", F.explode(F.array(*map(F.lit, timeframes))).alias("timeframe"))
    return want.join(coverage(bars), list(SERIES), "left").select(*SERIES, "first_bar", "last_bar", F.coalesce("n_bars", F.lit(0)).alias("n_bars"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, lag: int = 0) -> DataFrame:
    """Latest row of ``right`` at or before each row of ``left`` (before, if strict), ``lag`` rows further back.

    Both sides go into one sorted stream per key, and the last right row is carried on; no pair is made. A key with
    more right rows than fit a task is not in view here: bars and signals of one series are.
    """
    r = right.select(*keys, F.col(right_time).alias("_t"), F.struct(right_time, *values).alias("_v"))
    if lag:
        r = r.withColumn("_v", F.lag("_v", lag).over(Window.partitionBy(*keys).orderBy("_t")))
    first = F.lit(2 if strict else 0)
    stream = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_l"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v")).unionByName(r.select(*keys, "_t", first.alias("_side"), F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_l"), "_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return stream.withColumn("_v", F.last("_v", True).over(w)).where("_side = 1").select("_l.*", F.col(f"_v.{right_time}").alias("matched_time"), *(F.col(f"_v.{v}").alias(v) for v in values))


#: The same tables in DuckDB's SQL, as the head of a WITH.
BARS_SQL = """
with bars as (
  select event_type as symbol, '1h' as timeframe, epoch_ms(date_trunc('hour', ts)) as open_time, first(value order by ts, event_id) as open,
    max(value) as high, min(value) as low, last(value order by ts, event_id) as close, cast(count(*) as double) as volume
  from events group by event_type, date_trunc('hour', ts)),
b as (select *, row_number() over (partition by symbol order by open_time) as i from bars)
"""
POOLED_SQL = BARS_SQL.replace("event_type as symbol", "'ALL' as symbol").replace("group by event_type, ", "group by ")
DAILY_SQL = """
with bars as (
  select l_returnflag || l_linestatus as symbol, '1d' as timeframe, epoch_ms(date_trunc('day', l_shipdate)) as open_time,
    first(l_extendedprice / l_quantity order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as open, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    last(l_extendedprice / l_quantity order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as close, sum(l_quantity) as volume
  from lineitem group by 1, date_trunc('day', l_shipdate)),
b as (select *, row_number() over (partition by symbol order by open_time) as i from bars)
"""
TRADES_SQL = """
with t as (
  select l_orderkey || ':' || l_linenumber as trade_id, 'S' || (l_suppkey % 10) as symbol, ['1h', '4h', '1d'][l_linenumber % 3 + 1] as timeframe, l_returnflag as strategy,
    case when l_linestatus = 'O' then 'long' else 'short' end as direction, epoch_ms(l_shipdate) as entry_time, round((l_discount - 0.05) * 20, 6) as pnl_r,
    case when l_orderkey % 2 = 0 then 'off' else 'weekdays' end as day_filter, case when l_quantity > 25 then 0.8 end as adr_suppress_threshold, l_tax > 0.04 as volume_suppress
  from lineitem),
r as (
  select symbol, timeframe, strategy, day_filter, adr_suppress_threshold, volume_suppress, count(*) as closed_trades, avg(pnl_r) as avg_r, sum(pnl_r) as total_r,
    avg(cast(pnl_r > 0 as integer)) as win_rate, count(*) filter (direction = 'long') as long_closed_trades, count(*) filter (direction = 'short') as short_closed_trades,
    avg(pnl_r) filter (direction = 'long') as long_avg_r, avg(pnl_r) filter (direction = 'short') as short_avg_r,
    avg(cast(pnl_r > 0 as integer)) filter (direction = 'long') as long_win_rate, avg(cast(pnl_r > 0 as integer)) filter (direction = 'short') as short_win_rate,
    max(entry_time) as run_at_ms
  from t group by all)
"""
