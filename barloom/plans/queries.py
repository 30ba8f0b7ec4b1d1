"""Registered queries of the bar and ledger operators, each with DuckDB's SQL for the same result where SQL can tell it.

Double columns are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators, statistics
from ..operators import books, cones, confluence, detectors, exits, magnets, outcomes, quality, reports, simulate, structure, zones
from ..sources import tables
from ..sources.tables import BARS_SQL, DAILY_SQL, POOLED_SQL, TRADES_SQL
from ..streaming import bars as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str = "", doubles: str = ""):
    """Register a query, its SQL and the names of its double columns."""

    def put(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            head, _, tail = sql.rpartition("\nfinal ")
            body = f"{head}\n{tail}" if head else tail
            names = doubles.split()
            SQL[name] = f"select * replace ({', '.join(f'round({c}, 6) + 0.0 as {c}' for c in names)}) from ({body})" if names else body
        return f

    return put


OHLC = "open high low close volume"
hourly, per_day = tables.bars_1h, tables.bars_1d

# sources and sinks


@query("bars_1h", BARS_SQL + "\nfinal select symbol, timeframe, open_time, open, high, low, close, volume from bars", OHLC)
def _(s, d):
    return hourly(s, d)


@query("bars_1d", DAILY_SQL + "\nfinal select symbol, timeframe, open_time, open, high, low, close, volume from bars", OHLC)
def _(s, d):
    return per_day(s, d)


@query("bars_scan", BARS_SQL + "\nfinal select symbol, timeframe, open_time, open, high, low, close, volume from bars where symbol = 'click' and open_time between 1704500000000 and 1705500000000", OHLC)
def _(s, d):
    return tables.scan(hourly(s, d), "click", "1h", 1704500000000, 1705500000000)


@query("close_at", BARS_SQL + """
, a as (select distinct event_type as symbol, '1h' as timeframe, epoch_ms(date_trunc('day', ts)) as open_time from events)
final select a.symbol, a.timeframe, a.open_time, b.close from a left join b on b.symbol = a.symbol and b.open_time = a.open_time""", "close")
def _(s, d):
    a = tables.table(s, d, "events").select(F.col("event_type").alias("symbol"), F.lit("1h").alias("timeframe"), F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("open_time")).distinct()
    return tables.close_at(a, hourly(s, d))


@query("bars_coverage", BARS_SQL + "\nfinal select symbol, timeframe, min(open_time) as first_bar, max(open_time) as last_bar, count(*) as n_bars from bars group by all")
def _(s, d):
    return tables.coverage(hourly(s, d))


@query("universe_coverage", BARS_SQL + """
final select m.symbol, tf as timeframe, min(open_time) as first_bar, max(open_time) as last_bar, count(open_time) as n_bars
from (select distinct event_type as symbol from events union select 'absent') m cross join (select unnest(['1h', '4h']) as tf) left join bars b on b.symbol = m.symbol and b.timeframe = tf group by all""")
def _(s, d):
    members = tables.table(s, d, "events").select(F.col("event_type").alias("symbol")).distinct().union(s.createDataFrame([("absent",)], "symbol string"))
    return tables.universe_coverage(hourly(s, d), members, ["1h", "4h"])


AS_OF = """
, e as (select event_id, event_type as symbol, epoch_us(ts) // 1000 as t from events)
final select event_id, e.symbol, t, b.open_time as matched_time, b.close from e asof left join b on b.symbol = e.symbol and e.t {} b.open_time"""


@query("asof_backward", BARS_SQL + AS_OF.format(">="), "close")
def _(s, d):
    e = tables.table(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), tables.millis("ts").alias("t"))
    return tables.as_of(e, hourly(s, d), ["symbol"], "t", "open_time", ["close"])


@query("asof_previous_bar", BARS_SQL + """
, e as (select event_id, event_type as symbol, epoch_us(ts) // 1000 as t from events),
j as (select event_id, e.symbol, t, b.i from e asof left join b on b.symbol = e.symbol and e.t >= b.open_time)
final select event_id, j.symbol, t, b.open_time as matched_time, b.close from j left join b on b.symbol = j.symbol and b.i = j.i - 1""", "close")
def _(s, d):
    e = tables.table(s, d, "events").select("event_id", F.col("event_type").alias("symbol"), tables.millis("ts").alias("t"))
    return tables.as_of(e, hourly(s, d), ["symbol"], "t", "open_time", ["close"], lag=1)


@query("upsert_bars", BARS_SQL + """
, n as (select symbol, timeframe, open_time, open, high, low, close * 2 as close, volume from bars where hour(make_timestamp(open_time * 1000)) < 15)
final select symbol, timeframe, open_time, open, high, low, close, volume from bars anti join n using (symbol, timeframe, open_time) union all select * from n""", OHLC)
def _(s, d):
    old = hourly(s, d)
    new = old.where(F.hour(F.timestamp_millis("open_time")) < 15).withColumn("close", F.col("close") * 2)
    return quality.upsert(old, new, ["symbol", "timeframe", "open_time"])


@query("insert_new_rows", BARS_SQL + """
final select symbol, timeframe, open_time, close from bars where i_ % 2 = 0 union all select symbol, timeframe, open_time, -close from bars where i_ % 2 = 1""".replace("from bars where i_", "from (select *, open_time // 3600000 as i_ from bars) where i_"), "close")
def _(s, d):
    b = hourly(s, d).select("symbol", "timeframe", "open_time", "close")
    odd = F.expr("open_time div 3600000 % 2 = 1")
    return quality.insert_new(b.where(~odd), b.withColumn("close", -F.col("close")), ["symbol", "timeframe", "open_time"])


@query("merge_outcomes", """
with a as (select o_orderkey as id, case when o_orderkey % 3 = 0 then o_totalprice end as r, o_orderstatus as s from orders where o_orderkey % 4 < 3),
b as (select o_orderkey as id, case when o_orderkey % 2 = 0 then 1.0 end as r, 'new' as s from orders where o_orderkey % 4 > 0)
final select coalesce(b.id, a.id) as id, coalesce(b.r, a.r) as r, coalesce(b.s, a.s) as s from a full join b on a.id = b.id""", "r")
def _(s, d):
    o = tables.table(s, d, "orders").withColumnRenamed("o_orderkey", "id")
    a = o.where("id % 4 < 3").select("id", F.when(F.col("id") % 3 == 0, F.col("o_totalprice")).alias("r"), F.col("o_orderstatus").alias("s"))
    b = o.where("id % 4 > 0").select("id", F.when(F.col("id") % 2 == 0, 1.0).alias("r"), F.lit("new").alias("s"))
    return quality.merge_outcomes(a, b, "id")


@query("prune_newest", TRADES_SQL + "\nfinal select trade_id, symbol, strategy, entry_time from t qualify row_number() over (partition by symbol, strategy order by entry_time desc, trade_id) <= 5")
def _(s, d):
    return quality.prune(tables.trades(s, d).select("trade_id", "symbol", "strategy", "entry_time"), ["symbol", "strategy"], F.struct(-F.col("entry_time"), "trade_id"), 5)


# data quality


@query("check_bars", BARS_SQL + """
, x as (select *, close / lag(close) over (partition by symbol order by open_time) as ratio from bars),
f as (select *, coalesce(volume = 0 and ratio = 1, false) as still from x)
final select symbol, timeframe, open_time, open, high, low, close, volume, false as bad_number, least(open, high, low, close) <= 0 as non_positive,
  high < greatest(open, close, low) or low > least(open, close, high) as bad_geometry, volume = 0 as zero_volume, coalesce(abs(ratio - 1) > 0.5, false) as outlier,
  coalesce(len(list_filter([2.0::double, 3.0, 4.0, 5.0, 0.5, 1.0::double / 3, 0.25, 0.2], lambda k: abs(ratio / k - 1) <= 0.05)) > 0, false) as split_like,
  bool_and(still) over (partition by symbol order by open_time desc) as frozen
from f""", OHLC)
def _(s, d):
    return quality.check(hourly(s, d))




RESAMPLED = ", h as (select symbol, '4h' as timeframe, ((open_time - 5400000) // 14400000) * 14400000 + 5400000 as t, {} from bars group by all)"


@query("resample_4h", BARS_SQL + RESAMPLED.format("first(open order by open_time) as open, max(high) as high, min(low) as low, last(close order by open_time) as close, sum(volume) as volume") + "\nfinal select symbol, timeframe, t as open_time, open, high, low, close, volume from h", OHLC)
def _(s, d):
    return quality.resample(hourly(s, d))


@query("level_breaks", BARS_SQL + """
, x as (select symbol, timeframe, open_time, close, lag(open_time) over w as prev_time, lag(close) over w as prev_close from bars window w as (partition by symbol order by open_time)),
k as (select *, case when open_time - prev_time > 4 * 86400000 and abs(ln(close / prev_close)) > ln(1.25) then 'gapped' when abs(ln(close / prev_close)) > ln(2.0) then 'large' end as kind from x where prev_close > 0 and close > 0)
final select * from k where kind is not null""", "close prev_close")
def _(s, d):
    return quality.level_breaks(hourly(s, d))


@query("session_gaps", DAILY_SQL + """
, days as (select distinct symbol, timeframe, cast(make_timestamp(open_time * 1000) as date) as session_date from bars),
span as (select symbol, timeframe, min(session_date) as lo, max(session_date) as hi from days group by all),
cal as (select distinct session_date from days where isodow(session_date) < 6)
final select symbol, timeframe, session_date from span join cal on session_date between lo and hi anti join days using (symbol, timeframe, session_date)""")
def _(s, d):
    b = per_day(s, d)
    cal = b.select(F.to_date(F.timestamp_millis("open_time")).alias("session_date")).distinct().where(F.weekday("session_date") < 5)
    return quality.session_gaps(b, cal)


SESSIONS = """
, ds as (select distinct cast(make_timestamp(open_time * 1000) as date) as session_date from bars),
se as (select session_date, epoch_ms(session_date) + 52200000 as open_ms, epoch_ms(session_date) + case when day(session_date) % 7 = 0 then 64800000 else 75600000 end as close_ms from ds)
"""


@query("slot_gaps", BARS_SQL + SESSIONS + RESAMPLED.format("max(high) as high") + """
, h1 as (select symbol, timeframe, t as open_time from h where (t // 14400000) % 5 <> 0),
seen as (select distinct symbol, timeframe, cast(make_timestamp(open_time * 1000) at time zone 'UTC' at time zone 'America/New_York' as date) as session_date from h1),
sl as (select se.*, open_ms // 86400000 * 86400000 + 48600000 + k * 14400000 as slot_ms from se cross join (select unnest(range(-1, 6)) as k)),
sk as (select * from sl where slot_ms < close_ms and least(slot_ms + 14400000, close_ms) - greatest(slot_ms, open_ms) >= 3600000),
sp as (select symbol, min(open_time) as lo, max(open_time) as hi from h1 group by symbol)
final select symbol, timeframe, session_date, slot_ms as open_time from seen join sk using (session_date) join sp using (symbol) anti join h1 on h1.symbol = seen.symbol and h1.open_time = slot_ms where slot_ms between lo and hi""")
def _(s, d):
    b = hourly(s, d)
    day = b.select(F.to_date(F.timestamp_millis("open_time")).alias("session_date")).distinct()
    ms = F.unix_millis(F.col("session_date").cast("timestamp"))
    cal = day.select("session_date", (ms + 52_200_000).alias("open_ms"), (ms + F.when(F.dayofmonth("session_date") % 7 == 0, 64_800_000).otherwise(75_600_000)).alias("close_ms"))
    return quality.slot_gaps(quality.resample(b).where("(open_time div 14400000) % 5 <> 0"), cal)


@query("page_seams", BARS_SQL + """
, st as (select * from bars where open_time < 1705500000000), pg as (select symbol, timeframe, open_time, close * case symbol when 'click' then 1.05 else 1.0 end as close from bars where open_time >= 1705400000000),
f as (select symbol, timeframe, min(open_time) as page_from, arg_min(close, open_time) as page_close from pg group by all),
be as (select st.symbol, max(open_time) as stored_to, arg_max(close, open_time) as stored_close from st join f using (symbol) where open_time < page_from group by st.symbol),
mv as (select symbol, count(*) as n_both, bool_or(abs(pg.close / st.close - 1) > 0.01) as basis_changed from st join pg using (symbol, open_time) group by symbol)
final select f.symbol, f.timeframe, page_from, page_close, stored_to, stored_close, coalesce(n_both, 0) as n_both, coalesce(basis_changed, false) as basis_changed from f left join be using (symbol) left join mv using (symbol)""", "page_close stored_close")
def _(s, d):
    b = hourly(s, d)
    page = b.where("open_time >= 1705400000000").withColumn("close", F.col("close") * F.when(F.col("symbol") == "click", 1.05).otherwise(1.0))
    return quality.seams(b.where("open_time < 1705500000000"), page)


# indicators


@query("ema", BARS_SQL + """
final select x.symbol, x.timeframe, x.open_time, sum(y.close * case when y.i = 1 then pow(1 - 2.0 / 21, x.i - 1) else (2.0 / 21) * pow(1 - 2.0 / 21, x.i - y.i) end) as ema20
from b x join b y on x.symbol = y.symbol and y.i <= x.i group by all""", "ema20")
def _(s, d):
    return indicators.ema(hourly(s, d), {"ema20": 20}).select("symbol", "timeframe", "open_time", "ema20")


@query("volume_flags", BARS_SQL + """
, m as (select *, avg(volume) over (partition by symbol order by open_time rows between 20 preceding and 1 preceding) as m from bars)
final select symbol, timeframe, open_time, coalesce(volume >= 1.5 * m, true) as vol_ok, coalesce(volume < 1.5 * m, false) as low_volume, coalesce(volume > 3 * m, false) as volume_spike from m""")
def _(s, d):
    return indicators.volume_flags(hourly(s, d)).select("symbol", "timeframe", "open_time", "vol_ok", "low_volume", "volume_spike")


@query("atr14", BARS_SQL + """
, x as (select *, lag(close) over (partition by symbol order by open_time) as pc from bars),
y as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from x),
z as (select *, avg(tr) over (partition by symbol order by open_time rows between 13 preceding and current row) as a from y)
final select symbol, timeframe, open_time, case when a > 0 then a end as atr14 from z""", "atr14")
def _(s, d):
    return indicators.atr_mean(hourly(s, d)).select("symbol", "timeframe", "open_time", "atr14")


# means with a seed as sums of powers: the first bar keeps what the weights of all others leave
WEIGHED = "sum({1} * case when y.i = 1 then pow(1 - {0}, x.i - 1) else {0} * pow(1 - {0}, x.i - y.i) end)"
REGIME = f"""
, tr as (select *, greatest(high - low, coalesce(abs(high - lag(close) over w), 0), coalesce(abs(low - lag(close) over w), 0)) as tr from b window w as (partition by symbol order by i)),
m as (select x.symbol, x.timeframe, x.open_time, x.i, x.close, {WEIGHED.format('2.0 / 51', 'y.close')} as ema50, {WEIGHED.format('1.0 / 14', 'y.tr')} as atr from tr x join tr y on x.symbol = y.symbol and y.i <= x.i group by all),
sl as (select *, ema50 / lag(ema50, 10) over (partition by symbol order by i) - 1 as slope, atr / close as atr_pct from m),
pc as (select *, case when count(*) over w >= 50 then quantile_cont(atr_pct, 0.8) over w end as p80 from sl window w as (partition by symbol order by i rows 629 preceding)),
reg as (select *, case when slope is null or p80 is null then 'unknown' when atr_pct >= p80 then 'high_vol' when abs(slope) >= 0.005 then 'trend' else 'range' end as regime from pc)
"""


@query("regime_labels", BARS_SQL + REGIME + "\nfinal select symbol, timeframe, open_time, regime, slope, atr_pct, p80 from reg", "slope atr_pct p80")
def _(s, d):
    return indicators.regime(hourly(s, d)).select("symbol", "timeframe", "open_time", "regime", "slope", "atr_pct", "p80")


@query("seasonality", BARS_SQL + """
, x as (select symbol, timeframe, make_timestamp(open_time * 1000) as ts, (close / lag(close) over (partition by symbol order by open_time) - 1) * 100 as ret from bars),
k as (select symbol, timeframe, ret, unnest([{'k': 'weekday', 'b': isodow(ts) - 1}, {'k': 'hour', 'b': hour(ts)}, {'k': 'week_of_month', 'b': (day(ts) - 1) // 7 + 1}]) as s from x where ret is not null)
final select symbol, timeframe, s.k as kind, cast(s.b as integer) as bucket, avg(ret) as avg_return, avg(cast(ret > 0 as integer)) as win_rate, count(*) as n from k group by all""", "avg_return win_rate")
def _(s, d):
    return indicators.seasonality(hourly(s, d))


# detectors

SIGNALS = "symbol, timeframe, open_time, direction, reason, sl_price, low_volume, cast(null as double) as tp_price"


def _detector(name: str, sql: str = "") -> None:
    query(f"detect_{name}", sql and BARS_SQL + sql, "sl_price" if sql else "")(lambda s, d: detectors.REGISTRY[name](hourly(s, d)))


def _first_hits(forms: list[tuple[str, str, str, str, str]], start: int, stop: int, extra: str = "", further: dict[str, str] | None = None) -> str:
    """SQL of the first bar after a formation that meets a condition; the earliest formation keeps the bar."""
    parts = "\nunion all\n".join(
        f"select f.symbol, f.timeframe, f.i as formed, min(j.i) as hit, '{side}' as direction, {reason} as reason, {stop_at} as sl_price from f join b j on j.symbol = f.symbol and j.i between f.i + {start} and f.i + {stop} where ({formed}) and ({cond}) group by all"
        for side, formed, cond, reason, stop_at in forms
    )
    more = " or ".join(f"(h.direction = '{k}' and {v})" for k, v in (further or {"long": "true", "short": "true"}).items())
    return f"""{extra}
, f as (select *, greatest(open, close) as t_, least(open, close) as b_, abs(close - open) as body, lag(high) over w as ph, lag(low) over w as pl, lead(high) over w as nh, lead(low) over w as nl, lead(close) over w as nc from b window w as (partition by symbol order by i)),
h as ({parts}),
k as (select h.*, j.open_time, false as low_volume, row_number() over (partition by h.symbol, j.open_time order by formed, h.direction) as n from h join b j on j.symbol = h.symbol and j.i = h.hit {'join ema on ema.symbol = j.symbol and ema.i = j.i' if extra else ''} where {more})
final select {SIGNALS} from k where n = 1"""


P2 = "printf('{}@%.2f-%.2f', {}, {})"
_detector("wick_fill", _first_hits([
    ("long", "body <> 0 and b_ - f.low >= 1.5 * body", "j.low <= b_ and j.close > f.low", P2.format("wick_fill_long", "f.low", "b_"), "f.low"),
    ("short", "body <> 0 and f.high - t_ >= 1.5 * body", "j.high >= t_ and j.close < f.high", P2.format("wick_fill_short", "t_", "f.high"), "f.high"),
], 1, 20))
MARU = "body <> 0 and body >= 0.005 * f.open and f.high - t_ <= 0.1 * body and b_ - f.low <= 0.1 * body and "
_detector("marubozu_retest", _first_hits([
    ("long", MARU + "f.close > f.open", "j.low <= f.open and j.close > f.open", "printf('marubozu_long@%.2f', f.open)", "f.low"),
    ("short", MARU + "f.close <= f.open", "j.high >= f.open and j.close < f.open", "printf('marubozu_short@%.2f', f.open)", "f.high"),
], 1, 30))
EMA50 = ", ema as (select x.symbol, x.i, sum(y.close * case when y.i = 1 then pow(1 - 2.0 / 51, x.i - 1) else (2.0 / 51) * pow(1 - 2.0 / 51, x.i - y.i) end) as ema from b x join b y on x.symbol = y.symbol and y.i <= x.i group by all)"
_detector("fvg", _first_hits([
    ("long", "ph < nl and nl - ph >= 0.001 * (nl + ph) / 2", "j.low <= (ph + nl) / 2 and j.close > ph", P2.format("fvg_long", "ph", "nl"), "ph"),
    ("short", "pl > nh and pl - nh >= 0.001 * (pl + nh) / 2", "j.high >= (pl + nh) / 2 and j.close < pl", P2.format("fvg_short", "pl", "nh"), "pl"),
], 2, 51, EMA50, {"long": "j.close > ema.ema", "short": "j.close < ema.ema"}))
_detector("order_block", _first_hits([
    ("short", "f.close > f.open and nc < f.low * (1 - 0.003)", "j.high >= f.open and j.low <= f.close and j.close < f.close", P2.format("ob_short", "f.open", "f.close"), "f.high"),
    ("long", "f.open > f.close and nc > f.high * (1 + 0.003)", "j.low <= f.open and j.high >= f.close and j.close > f.close", P2.format("ob_long", "f.close", "f.open"), "f.low"),
], 2, 101))
_detector("orb_breakout", """
, s as (select *, cast(make_timestamp((open_time - 48600000) * 1000) as date) as day from b),
r as (select *, row_number() over w as k, first_value(high) over w as hi, first_value(low) over w as lo from s window w as (partition by symbol, day order by open_time)),
x as (select *, case when close > hi then 'long' else 'short' end as direction from r where k > 1 and hi > lo and (close > hi or close < lo))
final select symbol, timeframe, open_time, direction, case when direction = 'long' then printf('orb_long@%.2f', hi) else printf('orb_short@%.2f', lo) end as reason,
  case when direction = 'long' then lo else hi end as sl_price, false as low_volume, cast(null as double) as tp_price
from x qualify row_number() over (partition by symbol, day, direction order by open_time) = 1""")


def _shapes(cases: list[tuple[str, str, str, str]], low: str = "false") -> str:
    """SQL of single-bar patterns: conditions in order, with direction, reason and stop."""
    pick = lambda i: "case " + " ".join(f"when {c[0]} then {c[i]}" for c in cases) + " end"
    return f"""
, x as (select *, greatest(open, close) as t_, least(open, close) as b_, abs(close - open) as body, high - low as rng, avg(volume) over (partition by symbol order by i rows between 20 preceding and 1 preceding) as mv from b),
f as (select *, high - t_ as up, b_ - low as dn, lag(open) over w as po, lag(close) over w as pc, lag(open, 2) over w as ao, lag(close, 2) over w as ac, lag(t_) over w as it, lag(b_) over w as ib, lag(t_, 2) over w as mt, lag(b_, 2) over w as mb,
  lag(rng) over w as prng, lag(body) over w as pbody, lag(close, 10) over w as past from x window w as (partition by symbol order by i)),
k as (select symbol, timeframe, open_time, {pick(1)} as direction, {pick(2)} as reason, {pick(3)} as sl_price, {low} as low_volume from f)
final select {SIGNALS} from k where direction is not null"""


LOW_VOLUME, BELOW, ABOVE = "coalesce(volume < 1.5 * mv, false)", "close * (1 - 0.02)", "close * (1 + 0.02)"
_at = lambda n, c="close": f"printf('{n}@%.2f', {c})"
_detector("trend_day", _shapes([("rng <> 0 and body / rng >= 0.65 and dn / rng <= 0.15 and close > open", "'long'", P2.format("trend_day_bull", "open", "close"), "low"), ("rng <> 0 and body / rng >= 0.65 and up / rng <= 0.15 and close < open", "'short'", P2.format("trend_day_bear", "open", "close"), "high")]))
_detector("engulfing", _shapes([("pc < po and close > open and open < pc and close > po", "'long'", _at("bullish_engulfing"), BELOW), ("pc > po and close < open and open > pc and close < po", "'short'", _at("bearish_engulfing"), ABOVE)], LOW_VOLUME))
_detector("pin_bar", _shapes([("body <> 0 and dn >= 2 * body and up <= body", "'long'", _at("pin_bar_bull"), BELOW), ("body <> 0 and up >= 2 * body and dn <= body", "'short'", _at("pin_bar_bear"), ABOVE)], LOW_VOLUME))
_detector("inside_bar", _shapes([("it <= mt and ib >= mb and close > mt", "'long'", _at("inside_bar_long"), BELOW), ("it <= mt and ib >= mb and close < mb", "'short'", _at("inside_bar_short"), ABOVE)]))
_detector("hammer", _shapes([("body <> 0 and dn >= 2 * body and up <= body and close < past", "'long'", _at("hammer"), BELOW), ("body <> 0 and dn >= 2 * body and up <= body and close >= past", "'short'", _at("hanging_man"), ABOVE)], LOW_VOLUME))
DOJI = "prng <> 0 and pbody <= 0.1 * prng and rng <> 0 and body >= 0.6 * rng and "
_detector("doji", _shapes([(DOJI + "close > open", "'long'", _at("doji_bull"), BELOW), (DOJI + "close <= open", "'short'", _at("doji_bear"), ABOVE)]))
STAR = "prng <> 0 and pbody <= 0.3 * prng and "
_detector("star", _shapes([(STAR + "ac < ao and close > open and close > (ao + ac) / 2", "'long'", _at("morning_star"), BELOW), (STAR + "ac > ao and close < open and close < (ao + ac) / 2", "'short'", _at("evening_star"), ABOVE)]))


def _equal(side: str) -> str:
    high = side == "high"
    g, ext, cmp, back, name, direction = ("greatest", "max", ">", "<", "eqh_short", "short") if high else ("least", "min", "<", ">", "eql_long", "long")
    return f"""select s.symbol, s.timeframe, s.open_time, '{direction}' as direction, printf('{name}@%.2f-%.2f', a.{side}, c.{side}) as reason, (select {ext}({side}) from b z where z.symbol = s.symbol and z.i between c.i and s.i) as sl_price,
  row_number() over (partition by s.symbol, s.i order by {g}(a.{side}, c.{side}) {'desc' if high else 'asc'}, a.i, c.i) as n
from {side}s a join {side}s c on c.symbol = a.symbol and c.i > a.i and abs(a.{side} - c.{side}) / {g}(a.{side}, c.{side}) <= 0.003 join b s on s.symbol = a.symbol and s.i > 50 and s.i - 50 <= a.i and s.i > c.i and s.{side} {cmp} {g}(a.{side}, c.{side}) and s.close {back} {g}(a.{side}, c.{side})
where not exists (select 1 from b z where z.symbol = a.symbol and z.i > a.i and z.i < c.i and z.{side} {cmp} {g}(a.{side}, c.{side}))"""


_detector("equal_levels", f"""
, sw as (select *, max(high) over w as hi, min(low) over w as lo from b window w as (partition by symbol order by i rows between 5 preceding and 5 following)),
highs as (select * from sw where high = hi), lows as (select * from sw where low = lo),
k as (select * from ({_equal('high')}) where n = 1 union all select * from ({_equal('low')}) where n = 1)
final select {SIGNALS.replace('low_volume', 'false as low_volume')} from k qualify row_number() over (partition by symbol, open_time order by direction desc) = 1""")

BROKEN = """
, z as (select x.symbol, x.timeframe, x.i, x.open_time, x.close, list(y.low order by y.i) as ls, list(y.high order by y.i) as hs, list(y.open_time order by y.i) as ts from b x join b y on y.symbol = x.symbol and y.i between x.i - 25 and x.i - 6 group by all having count(*) = 20),
p as (select *, list_position(ls, list_min(ls)) as pl, list_position(hs, list_max(hs)) as ph, (select max(greatest(high, close)) from b y where y.symbol = z.symbol and y.i between z.i - 5 and z.i - 1) as up, (select min(least(low, close)) from b y where y.symbol = z.symbol and y.i between z.i - 5 and z.i - 1) as dn from z),
q as (select *, list_max(hs[pl:]) as rise, list_position(hs[pl:], list_max(hs[pl:])) as rk, list_min(ls[ph:]) as fall, list_position(ls[ph:], list_min(ls[ph:])) as fk from p),
bo as (select *, case when rise > list_min(ls) and rk > 1 and up > rise then 'long' when list_max(hs) > fall and fk > 1 and dn < fall then 'short' end as side from q),
br as (select symbol, timeframe, i, open_time, close, side, case side when 'long' then list_min(ls) else fall end as lo, case side when 'long' then rise else list_max(hs) end as hi, case side when 'long' then ts[pl + rk - 1] else ts[ph + fk - 1] end as start_ms from bo where side is not null)
"""
BACK = "case side when 'long' then hi - {0} * (hi - lo) else lo + {0} * (hi - lo) end"

query("detect_ote_entry", BARS_SQL + BROKEN + f"""
, k as (select *, {BACK.format(0.618)} as near, {BACK.format(0.786)} as far from br where i > 26)
final select symbol, timeframe, open_time, side as direction, case side when 'long' then lo else hi end as sl_price, false as low_volume, case side when 'long' then hi + 0.618 * (hi - lo) else lo - 0.618 * (hi - lo) end as tp_price
from k where case side when 'long' then near >= close and close >= far else far >= close and close >= near end""", "sl_price tp_price")(lambda s, d: detectors.ote_entry(hourly(s, d)).drop("reason"))

query("detect_ema_pullback", BARS_SQL + """
, m as (select x.symbol, x.timeframe, x.i, x.open_time, x.open, x.high, x.low, x.close, x.volume, sum(y.close * case when y.i = 1 then pow(1 - 2.0 / 21, x.i - 1) else (2.0 / 21) * pow(1 - 2.0 / 21, x.i - y.i) end) as f, sum(y.close * case when y.i = 1 then pow(1 - 2.0 / 51, x.i - 1) else (2.0 / 51) * pow(1 - 2.0 / 51, x.i - y.i) end) as s from b x join b y on x.symbol = y.symbol and y.i <= x.i group by all),
n as (select *, s / lag(s, 10) over w - 1 as slope, sign(close - f) as sd, lag(sign(close - f)) over w as psd, avg(volume) over (partition by symbol order by i rows between 20 preceding and 1 preceding) as mv,
  min(case when low <= f and close > f then low end) over p as pl, max(case when high >= f and close < f then high end) over p as ph from m window w as (partition by symbol order by i), p as (partition by symbol order by i rows between 5 preceding and 1 preceding)),
c as (select *, sum(cast(sd <> psd as integer)) over (partition by symbol order by i rows 18 preceding) as crosses from n),
g as (select *, case when close > s and slope > 0 and close > open and close > f and close > pl then 'long' when close < s and slope < 0 and close < open and close < f and close < ph then 'short' end as direction from c where i > 50 and abs(slope) >= 0.003 and crosses <= 2 and high > low and abs(close - open) / (high - low) >= 0.5)
final select symbol, timeframe, open_time, direction, printf('ema_pullback_%s@%.2f', direction, close) as reason, case direction when 'long' then pl else ph end as sl_price, coalesce(volume < 1.5 * mv, false) as low_volume, close + (close - case direction when 'long' then pl else ph end) * 3 as tp_price from g where direction is not null""", "sl_price tp_price")(lambda s, d: detectors.ema_pullback(hourly(s, d)))

query("detect_fibonacci_retracement", BARS_SQL + """
, v as (select *, case when high > lag(high) over w and high > lead(high) over w then i end as hi_, case when low < lag(low) over w and low < lead(low) over w then i end as lo_ from b window w as (partition by symbol order by i)),
l as (select *, max(hi_) over p as ih, max(lo_) over p as il from v window p as (partition by symbol order by i rows between 19 preceding and 2 preceding)),
k as (select l.symbol, l.timeframe, l.i, l.open_time, l.close, case when il < ih then 'long' else 'short' end as side, h.high as hi, o.low as lo from l join b h on h.symbol = l.symbol and h.i = ih join b o on o.symbol = l.symbol and o.i = il where ih <> il and h.high > o.low and l.i > 21)
"""+f"""
, z as (select *, {BACK.format(0.5)} as half, {BACK.format(0.618)} as deep, {BACK.format(0.786)} as stop from k)
final select symbol, timeframe, open_time, side as direction, stop as sl_price, false as low_volume, cast(null as double) as tp_price from z where case side when 'long' then half >= close and close >= deep else deep >= close and close >= half end""", "sl_price")(lambda s, d: detectors.fibonacci_retracement(hourly(s, d)).drop("reason"))


@query("detect_funding_extreme", BARS_SQL + """
, fu as (select event_type as symbol, epoch_ms(time_bucket(interval '8 hours', ts)) as funding_time, (avg(value) - 50) / 200000 as rate from events group by all),
j as (select b.symbol, b.timeframe, b.open_time, fu.funding_time, fu.rate from b asof join fu on fu.symbol = b.symbol and b.open_time >= fu.funding_time),
k as (select * from j qualify row_number() over (partition by symbol, funding_time order by open_time) = 1)
final select symbol, timeframe, open_time, case when rate > 0 then 'short' else 'long' end as direction, printf('funding_%s_extreme@%.4f', case when rate > 0 then 'long' else 'short' end, rate) as reason, 0.0::double as sl_price, false as low_volume, cast(null as double) as tp_price from k where abs(rate) > 0.0001""", "sl_price")
def _(s, d):
    f = tables.table(s, d, "events").groupBy(F.col("event_type").alias("symbol"), F.unix_millis(F.window(F.col("ts").cast("timestamp"), "8 hours")["start"]).alias("funding_time")).agg(((F.avg("value") - 50) / 200000).alias("rate"))
    return detectors.funding_extreme(hourly(s, d), f)


@query("detect_market_structure", BARS_SQL + """
, x as (select *, count(*) over w as k, max(high) over w as hi, min(low) over w as lo, lead(open_time, 5) over (partition by symbol order by i) as conf from b window w as (partition by symbol order by i rows between 5 preceding and 5 following)),
sw as (select symbol, timeframe, i, 'H' as side, high as price, conf from x where k = 11 and high = hi union all select symbol, timeframe, i, 'L', low, conf from x where k = 11 and low = lo),
st as (select *, last_value(case when side = 'H' then price end ignore nulls) over w as sh, last_value(case when side = 'L' then price end ignore nulls) over w as sl from sw window w as (partition by symbol order by i, side rows between unbounded preceding and 1 preceding)),
ev as (select *, case when side = 'H' and price > sh then 'up' when side = 'L' and price < sl then 'down' end as event from st),
tr as (select *, last_value(event ignore nulls) over (partition by symbol order by i, side rows between unbounded preceding and 1 preceding) as trend from ev),
o as (select *, coalesce(case when event = 'up' then sl else sh end, 0) as other from tr where event is not null),
z as (select * from o where case when price > 0 then case when event = 'up' then price - other else other - price end / price else 0 end >= 0.005 qualify row_number() over (partition by symbol, i order by side) = 1)
final select symbol, timeframe, conf as open_time, case event when 'up' then 'long' else 'short' end as direction,
  printf('%s_%s@%.2f', case when coalesce(trend <> event, false) then 'choch' else 'bos' end, case event when 'up' then 'long' else 'short' end, price) as reason, other as sl_price, false as low_volume, cast(null as double) as tp_price from z""", "sl_price")
def _(s, d):
    return structure.market_structure(hourly(s, d))


@query("gap_zones", BARS_SQL + """
, x as (select *, lag(high) over w as ph, lag(low) over w as pl, lead(low) over w as nl, lead(high) over w as nh from b window w as (partition by symbol order by i)),
y as (select *, case when ph < nl then 'bull' else 'bear' end as side, case when ph < nl then ph else nh end as bottom, case when ph < nl then nl else pl end as top from x where ph < nl or pl > nh),
z as (select * from y where top - bottom >= 0.001 * (top + bottom) / 2)
final select z.symbol, z.timeframe, z.open_time, side, bottom, top, min(j.open_time) as crossed_at, min(j.open_time) is null as active
from z left join b j on j.symbol = z.symbol and j.i >= z.i + 2 and case when side = 'bull' then j.low <= (top + bottom) / 2 else j.high >= (top + bottom) / 2 end group by all""", "bottom top")
def _(s, d):
    return structure.gap_zones(hourly(s, d))


# zones of the newest bars

TAIL = """
, nn as (select symbol, max(i) as n from b group by symbol),
bt as (select b.*, n from b join nn using (symbol))
"""
ENDED = """
, ze as (select z.symbol, z.timeframe, z.zone_type, z.direction, z.zone_low, z.zone_high, z.start_ms, z.i, min(j.open_time) as close_ms from z0 z left join b j on j.symbol = z.symbol and j.i >= z.rest and {0} group by all),
zf as (select *, close_ms is null as active from ze),
zr as (select *, row_number() over (partition by symbol, active order by i desc, direction desc) as f from zf)
final select symbol, timeframe, zone_type, direction, zone_low, zone_high, start_ms, close_ms, active from zr where active or f <= {1} qualify row_number() over (partition by symbol order by active, i desc, direction desc) <= {2}"""


def _zones(name: str, sql: str) -> None:
    query(name, BARS_SQL + TAIL + sql, "zone_low zone_high")(lambda s, d: getattr(zones, name)(hourly(s, d)))


_zones("gap_boxes", """
, y as (select *, lag(high) over w as ph, lag(low) over w as pl, lead(low) over w as nl, lead(high) over w as nh, lag(open_time) over w as pt from bt window w as (partition by symbol order by i)),
z0 as (select symbol, timeframe, 'fvg' as zone_type, case when ph < nl then 'bull' else 'bear' end as direction, case when ph < nl then ph else nh end as zone_low, case when ph < nl then nl else pl end as zone_high, pt as start_ms, i, i + 2 as rest from y
  where i > 1 and i >= n - 100 and i < n and (ph < nl or pl > nh) and case when ph < nl then nl - ph else pl - nh end >= 0.001 * case when ph < nl then nl + ph else pl + nh end / 2)
""" + ENDED.format("case when direction = 'bull' then j.low <= (zone_low + zone_high) / 2 else j.high >= (zone_low + zone_high) / 2 end", 5, 30))
_zones("order_blocks", """
, y as (select *, lead(close) over (partition by symbol order by i) as nc from bt),
z0 as (select symbol, timeframe, 'ob' as zone_type, case when close > open then 'bear' else 'bull' end as direction, least(open, close) as zone_low, greatest(open, close) as zone_high, open_time as start_ms, i, i + 2 as rest from y
  where i >= n - 101 and i <= n - 2 and (close > open and nc < low * (1 - 0.003) or open > close and nc > high * (1 + 0.003)))
""" + ENDED.format("case when direction = 'bear' then j.high >= zone_low and j.close < zone_low else j.low <= zone_high and j.close > zone_high end", 3, 20))
SWUNG = """
, ar as (select *, max(high) over w as hi, min(low) over w as lo from bt window w as (partition by symbol order by i rows between 5 preceding and 5 following)),
sg as (select *, 'H' as side, high as price from ar where high = hi union all select *, 'L', low from ar where low = lo),
sw as (select * from sg where i > 5 and i >= n - 104 and i <= n - 5 and n >= 11)
"""
_zones("structure_levels", SWUNG + """
, z0 as (select symbol, timeframe, 'bos' as zone_type, case side when 'H' then 'bear' else 'bull' end as direction, price as zone_low, price as zone_high, open_time as start_ms, i, i + 6 as rest from sw where n >= 15)
""" + ENDED.format("case when direction = 'bear' then j.close > zone_high else j.close < zone_low end", 5, 8))


@query("swing_points", BARS_SQL + TAIL + SWUNG + "\nfinal select symbol, timeframe, case side when 'H' then 'high' else 'low' end as swing_type, price, open_time as time_ms from sw qualify row_number() over (partition by symbol order by i desc, side desc) <= 30", "price")
def _(s, d):
    return zones.swing_points(hourly(s, d))


@query("equal_pools", BARS_SQL + TAIL + SWUNG + """
, o as (select *, row_number() over (partition by symbol, side order by i) as k, row_number() over () as r from sw),
pr as (with recursive f as (
  select symbol, side, 0 as k, cast([] as integer[]) as seen, cast([] as integer[]) as js, cast([] as integer[]) as ks from (select distinct symbol, side from o)
  union all
  select f.symbol, f.side, f.k + 1, case when mate is null then seen else seen || [f.k + 1, mate] end, case when mate is null then js else js || [f.k + 1] end, case when mate is null then ks else ks || [mate] end
  from (select f.*, (select cast(min(c.k) as integer) from o a join o c on c.symbol = a.symbol and c.side = a.side where a.symbol = f.symbol and a.side = f.side and a.k = f.k + 1 and not list_contains(f.seen, a.k) and c.k > a.k and not list_contains(f.seen, c.k) and abs(a.price - c.price) / a.price < 0.003) as mate from f) f
  where f.k < (select max(k) from o where o.symbol = f.symbol and o.side = f.side)) select * from f),
pz as (select symbol, side, unnest(js) as j, unnest(ks) as k from pr where pr.k = (select max(k) from o where o.symbol = pr.symbol and o.side = pr.side)),
z0 as (select a.symbol, a.timeframe, case a.side when 'H' then 'eqh' else 'eql' end as zone_type, case a.side when 'H' then 'bear' else 'bull' end as direction, (a.price + c.price) / 2 as price, a.open_time as start_ms, a.i, c.i + 1 as rest from pz join o a on a.symbol = pz.symbol and a.side = pz.side and a.k = pz.j join o c on c.symbol = pz.symbol and c.side = pz.side and c.k = pz.k),
ze as (select z.symbol, z.timeframe, z.zone_type, z.direction, price as zone_low, price as zone_high, z.start_ms, z.i, min(b.open_time) as close_ms from z0 z left join b on b.symbol = z.symbol and b.i >= z.rest and case direction when 'bear' then b.high >= price else b.low <= price end group by all)
final select symbol, timeframe, zone_type, direction, zone_low, zone_high, start_ms, close_ms, close_ms is null as active from ze qualify row_number() over (partition by symbol order by zone_type desc, i desc) <= 10""", "zone_low zone_high")
def _(s, d):
    return zones.equal_pools(hourly(s, d))


def _box(name: str, kind: str, near: float, far: float) -> None:
    ends = f"{BACK.format(near)}, {BACK.format(far)}"
    sql = BROKEN + f"\nfinal select symbol, timeframe, '{kind}' as zone_type, case side when 'long' then 'bull' else 'bear' end as direction, least({ends}) as zone_low, greatest({ends}) as zone_high, start_ms, cast(null as bigint) as close_ms, true as active from br where i = (select max(i) from b where b.symbol = br.symbol)"
    query(name, BARS_SQL + sql, "zone_low zone_high")(lambda s, d: getattr(zones, name)(hourly(s, d)))


_box("golden_box", "fib_zone", 0.5, 0.618)
_box("ote_box", "ote", 0.618, 0.786)


# simulation, gates, confluence

PINS = """
, x as (select *, abs(close - open) as body, high - greatest(open, close) as up, least(open, close) - low as dn from b),
sig as (select symbol, timeframe, i, open_time, case when dn >= 2 * body and up <= body then 'long' else 'short' end as direction, case when dn >= 2 * body and up <= body then close * 0.98 else close * 1.02 end as sl_price
  from x where body <> 0 and ((dn >= 2 * body and up <= body) or (up >= 2 * body and dn <= body)))
"""
SIMULATED = PINS + """
, e as (select g.*, n.open_time as entry_time, n.open as entry, sl_price as sl, case direction when 'long' then 1.0::double else -1.0 end as sg
  from sig g join b n on n.symbol = g.symbol and n.i = g.i + 1),
l as (select *, abs(entry - sl) as risk, case when direction = 'long' then entry + 2 * abs(entry - sl) else entry - 2 * abs(entry - sl) end as tp from e),
h as (select l.symbol, l.i, min(j.i) as hit from l join b j on j.symbol = l.symbol and j.i > l.i where case when direction = 'long' then j.low <= sl or j.high >= tp else j.high >= sl or j.low <= tp end group by all),
o as (select l.*, j.open_time as exit_time, j.open as jo, case when direction = 'long' then j.low <= sl else j.high >= sl end as stopped, j.i as ji from l left join h using (symbol, i) left join b j on j.symbol = l.symbol and j.i = h.hit),
tr as (select symbol, timeframe, 'pin_bar' as strategy, open_time as signal_time, direction, entry_time, entry, sl, tp, exit_time,
  case when ji is null then null when stopped then case when (entry - sl) * sg <= 0 then sl when direction = 'long' then least(sl, jo) else greatest(sl, jo) end else case when direction = 'long' then greatest(tp, jo) else least(tp, jo) end end as exit,
  case when ji is null then 'open' when stopped then 'loss' else 'win' end as outcome, risk from o),
trades as (select * exclude (risk), (exit - entry) * case when direction = 'long' then 1 else -1 end / nullif(risk, 0) as pnl_r from tr)
"""


def _pins(s, d):
    return detectors.pin_bar(hourly(s, d)).withColumn("strategy", F.lit("pin_bar"))


@query("simulate_trades", BARS_SQL + SIMULATED + "\nfinal select * from trades", "entry sl tp exit pnl_r")
def _(s, d):
    return simulate.simulate(hourly(s, d), _pins(s, d))


METRICS = """
, c as (select *, sum(pnl_r) over (partition by symbol order by signal_time, direction rows unbounded preceding) as cum from trades where pnl_r is not null),
m as (select *, greatest(0, max(cum) over (partition by symbol order by signal_time, direction rows unbounded preceding)) - cum as dd from c),
g as (select symbol, timeframe, strategy, count(*) as n, avg(cast(pnl_r > 0 as integer)) as win_rate, avg(pnl_r) as avg_r, sum(pnl_r) as total_r, avg(pnl_r) filter (direction = 'long') as long_avg_r, avg(pnl_r) filter (direction = 'short') as short_avg_r,
  coalesce(avg(pnl_r) / nullif(stddev_samp(pnl_r), 0), 0) as sharpe, max(dd) as max_dd from m group by all)
final select *, coalesce(total_r / nullif(max_dd, 0), 0) as recovery from g"""
METRIC_NAMES = "win_rate avg_r total_r long_avg_r short_avg_r sharpe max_dd recovery"


@query("trade_metrics", BARS_SQL + SIMULATED + METRICS, "win_rate avg_r total_r long_avg_r short_avg_r sharpe max_dd recovery")
def _(s, d):
    return simulate.metrics(simulate.simulate(hourly(s, d), _pins(s, d)))


SWEEP = PINS + """
, g as (select unnest([1.5, 2.0, 3.0]) as tp_r), q as (select unnest([0.05, 0.2]) as sl_pct),
e as (select s.*, n.open_time as entry_time, n.open as entry, tp_r::double as tp_r, sl_pct::double as sl_pct, case direction when 'long' then 1.0::double else -1.0 end as sg from sig s join b n on n.symbol = s.symbol and n.i = s.i + 1 cross join g cross join q),
l as (select *, entry * sl_pct as risk, entry * (1 - sg * sl_pct) as sl, entry + sg * tp_r * entry * sl_pct as tp from e),
h as (select l.symbol, l.i, tp_r, sl_pct, min(j.i) as hit from l join b j on j.symbol = l.symbol and j.i > l.i where case when direction = 'long' then j.low <= sl or j.high >= tp else j.high >= sl or j.low <= tp end group by all),
o as (select l.*, j.open as jo, case when direction = 'long' then j.low <= sl else j.high >= sl end as stopped from l join h using (symbol, i, tp_r, sl_pct) join b j on j.symbol = l.symbol and j.i = h.hit),
tr as (select *, (case when stopped then case when direction = 'long' then least(sl, jo) else greatest(sl, jo) end else case when direction = 'long' then greatest(tp, jo) else least(tp, jo) end end - entry) * sg / risk as r from o),
m as (select symbol, timeframe, 'pin_bar' as strategy, tp_r, sl_pct, count(*) as n, avg(r) as avg_r, avg(cast(r > 0 as integer)) as win_rate from tr group by all)
final select symbol, timeframe, strategy, tp_r, sl_pct, n, avg_r, case when n >= 5 and avg_r > 0 then avg_r * win_rate * sqrt(n) else 0 end as score from m"""


@query("sweep_grid", BARS_SQL + SWEEP, "tp_r sl_pct avg_r score")
def _(s, d):
    return simulate.grid(hourly(s, d), _pins(s, d), [1.5, 2.0, 3.0], [0.05, 0.2])


COSTS = """
, dv as (select *, close / lag(close) over (partition by symbol order by i) - 1 as ret from b),
cx as (select symbol, i, avg(close * volume) over w * 7 as adv, case when count(ret) over r >= 2 then stddev_pop(ret) over r * sqrt(7) end as sigma from dv window w as (partition by symbol order by i rows 139 preceding), r as (partition by symbol order by i rows 138 preceding)),
ct as (select t.*, abs(t.entry - t.sl) as risk, adv, sigma from trades t join b on b.symbol = t.symbol and b.open_time = t.signal_time join cx on cx.symbol = b.symbol and cx.i = b.i),
cc as (select *, 2 * (case when adv >= 5e8 then 1 when adv >= 5e7 then 3 when adv >= 5e6 then 8 else 20 end) / 10000.0 * entry / risk as spread_r, coalesce(case when adv > 0 and sigma > 0 then 2 * sigma * sqrt(10000 / adv) * entry / risk end, 0) as impact_r,
  coalesce(case when direction = 'short' then 0.01 * greatest(0, (exit_time - entry_time) / 86400000) / 365 * entry / risk end, 0) as borrow_r from ct)
"""


@query("trade_costs", BARS_SQL + SIMULATED + COSTS + "\nfinal select symbol, timeframe, strategy, signal_time, direction, outcome, spread_r, impact_r, borrow_r, spread_r + impact_r + borrow_r as cost_r, pnl_r - (spread_r + impact_r + borrow_r) as pnl_r from cc", "spread_r impact_r borrow_r cost_r pnl_r")
def _(s, d):
    t = simulate.simulate(hourly(s, d), _pins(s, d), costs=simulate.Costs())
    return t.select("symbol", "timeframe", "strategy", "signal_time", "direction", "outcome", "spread_r", "impact_r", "borrow_r", "cost_r", "pnl_r")


RULED = SIMULATED.replace("sl_price as sl, case", """case direction when 'long' then least(sl_price, n.open * (1 - 0.03)) else greatest(sl_price, n.open * (1 + 0.03)) end as sl0, case""").replace("from sig g join b n", "from kept g join b n").replace("l as (select *,", """e1 as (select e.* exclude (sl0), case when 1.5 * a.atr > abs(entry - sl0) then entry - sg * 1.5 * a.atr else sl0 end as sl from e left join atr a using (symbol, i)),
l as (select *,""").replace("as tp from e)", "as tp from e1)").replace("entry + 2 * abs", "entry + 3 * abs").replace("(exit - entry) * case when direction = 'long' then 1 else -1 end / nullif(risk, 0)", "((exit - entry) * case when direction = 'long' then 1 else -1 end - 2 * 0.0005 * entry) / nullif(risk, 0)")
RULES = """
, tr0 as (select *, lag(close) over (partition by symbol order by i) as pc0 from b),
tr1 as (select symbol, i, case when pc0 is not null then greatest(high - low, abs(high - pc0), abs(low - pc0)) end as tr from tr0),
atr as (select symbol, i, nullif(avg(tr) over (partition by symbol order by i rows 13 preceding), 0) as atr from tr1),
vm as (select symbol, i, volume, avg(volume) over (partition by symbol order by i rows between 20 preceding and 1 preceding) as mv from b),
kept as (select sig.* from sig join vm using (symbol, i) where not (direction = 'long' and coalesce(volume < 1.5 * mv, false) and not coalesce(volume > 3 * mv, false)))
"""


@query("trades_by_rules", BARS_SQL + RULED.replace(PINS, PINS + RULES) + "\nfinal select * from trades", "entry sl tp exit pnl_r")
def _(s, d):
    return simulate.simulate(hourly(s, d), _pins(s, d), tp_r_long=3.0, min_sl_pct=0.03, atr_multiple=1.5, atr_floor=True, suppress_long=True, boost=True, fee_pct=0.0005)


# the latest higher bar at or before a signal is forming, the one before it counts
H4 = RESAMPLED.format("first(open order by open_time) as open, max(high) as high, min(low) as low, last(close order by open_time) as close, sum(volume) as volume") + """
, b4 as (select symbol, timeframe, t as open_time, open, high, low, close, row_number() over (partition by symbol order by t) as i from h)"""
ASOF_4H = """
, at4 as (select g.*, f.i as i4 from sig g asof left join b4 f on f.symbol = g.symbol and g.open_time >= f.open_time)"""


@query("regime_gate", BARS_SQL + PINS + H4 + REGIME.replace(" from b window", " from b4 window") + ASOF_4H + """
final select g.symbol, g.timeframe, g.open_time, g.direction, g.sl_price from at4 g left join reg on reg.symbol = g.symbol and reg.i = g.i4 - 1 where coalesce(regime in ('unknown', 'range', 'trend'), true)""", "sl_price")
def _(s, d):
    b = hourly(s, d)
    return simulate.regime_gate(_pins(s, d), indicators.regime(quality.resample(b)), {"pin_bar": ["range", "trend"], "other": []}).select("symbol", "timeframe", "open_time", "direction", "sl_price")


@query("trend_gate", BARS_SQL + PINS + H4 + f"""
, m4 as (select x.symbol, x.i, {WEIGHED.format('2.0 / 21', 'y.close')} as e from b4 x join b4 y on x.symbol = y.symbol and y.i <= x.i group by all),
s4 as (select *, e / lag(e, 5) over (partition by symbol order by i) - 1 as slope from m4)""" + ASOF_4H + """
final select g.symbol, g.timeframe, g.open_time, g.direction, g.sl_price from at4 g left join s4 on s4.symbol = g.symbol and s4.i = g.i4 - 1
where not coalesce(abs(slope) >= 0.01 and case when direction = 'long' then slope < 0 else slope > 0 end, false)""", "sl_price")
def _(s, d):
    b = hourly(s, d)
    return simulate.trend_gate(_pins(s, d), indicators.ema_slope(quality.resample(b), 20, 5), 0.01).select("symbol", "timeframe", "open_time", "direction", "sl_price")


@query("direction_and_day_gates", BARS_SQL + PINS + "\nfinal select symbol, timeframe, open_time, direction, sl_price from sig where direction <> 'short' and isodow(make_timestamp(open_time * 1000)) in (2, 3, 4)", "sl_price")
def _(s, d):
    return simulate.day_gate(simulate.direction_gate(_pins(s, d), {"pin_bar": ["short"]}), [1, 2, 3]).select("symbol", "timeframe", "open_time", "direction", "sl_price")


# each half of a series stands as a series of its own
HALVES = BARS_SQL.replace("\nb as (", "\nb0 as (") + """
, b as (select symbol || case when i <= floor(n * 0.7::double) then '#in' else '#out' end as symbol, timeframe, open_time, open, high, low, close, volume, row_number() over (partition by symbol, i <= floor(n * 0.7::double) order by i) as i from b0 join (select symbol, count(*) as n from b0 group by symbol) using (symbol))
"""


@query("pooled_targets", BARS_SQL + SWEEP.partition("\nfinal ")[0] + """
, pl as (select 'pin_bar' as strategy, timeframe, tp_r, count(*) as n, count(distinct symbol) as symbols, avg(r) as avg_r, avg(cast(r > 0 as integer)) as win_rate from tr where sl_pct = 0.05 group by timeframe, tp_r)
final select *, row_number() over (order by case when n >= 30 then avg_r end desc nulls last, tp_r) = 1 and n >= 30 as pick from pl""", "tp_r avg_r win_rate")
def _(s, d):
    b = hourly(s, d)
    e = simulate.entries(b, _pins(s, d).withColumn("sl_price", F.lit(None).cast("double"))).withColumn("tp_r", F.explode(F.array(*map(F.lit, (1.5, 2.0, 3.0)))))
    return simulate.pooled_winner(simulate.exits(b, e, tp_r=F.col("tp_r"), sl_pct=F.lit(0.05)))


@query("sweep_audit", HALVES + SWEEP.partition("\nfinal ")[0] + """
, sc as (select split_part(symbol, '#', 1) as symbol, split_part(symbol, '#', 2) as part, timeframe, strategy, tp_r, sl_pct, n, avg_r, case when n >= case split_part(symbol, '#', 2) when 'in' then 5 else 1 end and avg_r > 0 then avg_r * win_rate * sqrt(n) else 0 end as score from m),
io as (select a.symbol, a.timeframe, a.strategy, a.tp_r, a.sl_pct, a.n as in_n, a.avg_r as in_avg_r, a.score as in_score, c.n as out_n, c.avg_r as out_avg_r, coalesce(c.score, 0) as out_score
  from sc a left join sc c on c.symbol = a.symbol and c.part = 'out' and c.tp_r = a.tp_r and c.sl_pct = a.sl_pct where a.part = 'in'),
dc as (select *, case when in_score > 0 then out_score / in_score end as decay from io),
ov as (select *, coalesce(out_avg_r <= 0, true) or coalesce(decay < 0.4, false) as overfit from dc)
final select *, row_number() over (partition by symbol order by overfit, in_score desc, tp_r, sl_pct) = 1 and not overfit as pick from ov""", "tp_r sl_pct in_avg_r in_score out_avg_r out_score decay")
def _(s, d):
    return simulate.audit(hourly(s, d), lambda b: detectors.pin_bar(b).withColumn("strategy", F.lit("pin_bar")), [1.5, 2.0, 3.0], [0.05, 0.2])


COOLED = """
, o as (select *, row_number() over (partition by symbol, direction order by open_time) as k from sig),
f as (with recursive f as (select symbol, direction, k, open_time from o where k = 1 union all
  select f.symbol, f.direction, n.k, n.open_time from f join lateral (select o.k, o.open_time from o where o.symbol = f.symbol and o.direction = f.direction and o.k > f.k and o.open_time - f.open_time >= 18000000 order by o.k limit 1) n on true) select * from f)
final select g.symbol, g.timeframe, g.open_time, g.direction, printf('pin_bar_%s@%.2f', case g.direction when 'long' then 'bull' else 'bear' end, b.close) as reason, g.sl_price, coalesce(b.volume < 1.5 * b.mv, false) as low_volume, cast(null as double) as tp_price, 'pin_bar' as strategy
from f join o g using (symbol, direction, k) join (select *, avg(volume) over (partition by symbol order by i rows between 20 preceding and 1 preceding) as mv from b) b on b.symbol = g.symbol and b.i = g.i"""


@query("cooldown_gate", BARS_SQL + PINS + COOLED, "sl_price")
def _(s, d):
    return simulate.cooldown(_pins(s, d), 5, tables.HOUR_MS)


@query("adr_gate", BARS_SQL + PINS + """
, dd as (select *, cast(make_timestamp(open_time * 1000) as date) as day from b),
run as (select symbol, open_time, close, day, max(high) over w as hi, min(low) over w as lo, first_value(open) over w as o from dd window w as (partition by symbol, day order by open_time)),
r14 as (select symbol, day, avg((max(high) - min(low)) / first(open order by open_time)) over (partition by symbol order by day rows 13 preceding) as a from dd group by symbol, day)
final select g.symbol, g.timeframe, g.open_time, g.direction, sl_price from sig g join run using (symbol, open_time) join r14 using (symbol, day)
where not ((hi - lo) / o >= 0.8 * a and case when g.direction = 'long' then close > (hi + lo) / 2 else not close > (hi + lo) / 2 end)""", "sl_price")
def _(s, d):
    b = hourly(s, d)
    return simulate.adr_gate(b, detectors.pin_bar(b), 0.8).select("symbol", "timeframe", "open_time", "direction", "sl_price")


ENGULFS = """
, y as (select *, lag(open) over (partition by symbol order by i) as po, lag(close) over (partition by symbol order by i) as pc from b),
eng as (select symbol, timeframe, i, open_time, case when pc < po then 'long' else 'short' end as direction, case when pc < po then close * 0.98 else close * 1.02 end as sl_price
  from y where (pc < po and close > open and open < pc and close > po) or (pc > po and close < open and open > pc and close < po))
"""


@query("conflict_resolver", BARS_SQL + PINS + ENGULFS + """
, c as (select 'pin_bar' as strategy, symbol, timeframe, open_time, direction, 3.0 as confidence from sig union all select 'engulfing', symbol, timeframe, open_time, direction, case direction when 'long' then 4.0 else 0.0 end from eng),
m as (select *, max(confidence) filter (direction = 'long') over w as l, max(confidence) filter (direction = 'short') over w as s from c window w as (partition by symbol, open_time))
final select strategy, symbol, timeframe, open_time, direction, confidence from m where l is null or s is null or case when direction = 'long' then l >= s else s >= l end""", "confidence")
def _(s, d):
    conf = s.createDataFrame([("pin_bar", "long", 3.0), ("pin_bar", "short", 3.0), ("engulfing", "long", 4.0)], "strategy string, direction string, confidence double")
    return simulate.resolve_conflicts(detectors.detect_all(hourly(s, d), ["pin_bar", "engulfing"]), conf).select("strategy", "symbol", "timeframe", "open_time", "direction", "confidence")


@query("ev_gate", TRADES_SQL + """
, c as (select strategy, timeframe, direction, count(*) as n, avg(pnl_r) as avg_r, stddev_samp(pnl_r) as sd_r from t group by all)
final select *, not coalesce(n >= 10 and avg_r < 0 and case when sd_r > 0 then (0 - avg_r) / (sd_r / sqrt(n)) >= 1.645 else n >= 5 end, false) as passes from c""", "avg_r sd_r")
def _(s, d):
    return simulate.ev_gate(tables.trades(s, d).groupBy("strategy", "timeframe", "direction").agg(F.count("*").alias("n"), F.avg("pnl_r").alias("avg_r"), F.stddev_samp("pnl_r").alias("sd_r")))


@query("purged_folds", BARS_SQL + """
, f as (select *, ntile(5) over (partition by symbol order by open_time) as fold from bars),
g as (select symbol, timeframe, fold, min(open_time) as t0, max(open_time) as t1, count(*) as n_test from f group by all)
final select g.symbol, g.timeframe, fold, t0, t1, n_test, count(*) filter (x.open_time < t0 - 18000000 or x.open_time > t1 + 36000000) as n_train from g join bars x on x.symbol = g.symbol group by all""")
def _(s, d):
    return simulate.folds(hourly(s, d), 5, 5 * tables.HOUR_MS, 10 * tables.HOUR_MS)


COFIRED = """
, pa as (select *, row_number() over (partition by symbol, direction order by i) as k from sig),
cf as (with recursive f as (
  select symbol, direction, cast(0 as bigint) as k, cast([] as bigint[]) as used, cast([] as bigint[]) as ia, cast([] as bigint[]) as ib from (select distinct symbol, direction from pa)
  union all
  select symbol, direction, k, case when mate is null then used else list_append(used, mate) end, case when mate is null then ia else list_append(ia, i) end, case when mate is null then ib else list_append(ib, mate) end
  from (select f.symbol, f.direction, a.k, a.i, f.used, f.ia, f.ib, (select arg_min(e.i, abs(e.i - a.i) * 1000000 + e.i) from eng e where e.symbol = a.symbol and e.direction = a.direction and abs(e.i - a.i) <= 5 and not list_contains(f.used, e.i)) as mate
    from f join pa a on a.symbol = f.symbol and a.direction = f.direction and a.k = f.k + 1))
  select * from f),
cp as (select symbol, direction, unnest(ia) as ia, unnest(ib) as ib from cf where k = (select max(k) from pa where pa.symbol = cf.symbol and pa.direction = cf.direction)),
co as (select c.symbol, '1h' as timeframe, c.direction, b.open_time, case when ia >= ib then a.sl_price else e.sl_price end as sl_price, cast(ia as integer) as idx_a, cast(ib as integer) as idx_b
  from cp c join pa a on a.symbol = c.symbol and a.direction = c.direction and a.i = c.ia join eng e on e.symbol = c.symbol and e.direction = c.direction and e.i = c.ib join b on b.symbol = c.symbol and b.i = greatest(ia, ib))
"""


@query("cofire_pairs", BARS_SQL + PINS + ENGULFS + COFIRED + "\nfinal select * from co", "sl_price")
def _(s, d):
    b = hourly(s, d)
    return confluence.cofire(b, detectors.pin_bar(b), detectors.engulfing(b))


@query("cross_timeframe", BARS_SQL + PINS + RESAMPLED.format("first(open order by open_time) as open, max(high) as high, min(low) as low, last(close order by open_time) as close") + """
, hs as (select symbol, t as open_time, case when least(open, close) - low >= 2 * abs(close - open) and high - greatest(open, close) <= abs(close - open) then 'long' else 'short' end as direction from h
  where close <> open and ((least(open, close) - low >= 2 * abs(close - open) and high - greatest(open, close) <= abs(close - open)) or (high - greatest(open, close) >= 2 * abs(close - open) and least(open, close) - low <= abs(close - open))))
final select symbol, timeframe, open_time, direction, sl_price from sig g where exists (select 1 from hs where hs.symbol = g.symbol and hs.direction = g.direction and hs.open_time between g.open_time - 14400000 and g.open_time)""", "sl_price")
def _(s, d):
    b = hourly(s, d)
    return confluence.cross_timeframe(detectors.pin_bar(quality.resample(b)), detectors.pin_bar(b), 4 * tables.HOUR_MS).select("symbol", "timeframe", "open_time", "direction", "sl_price")


def _traded(name: str, signals: str) -> str:
    """SQL of the trades of a table of signals, in place of the pin bars'."""
    return SIMULATED.replace(PINS, "").replace("from sig g", f"from {signals} g").replace("'pin_bar' as strategy", f"'{name}' as strategy")


ALIVE = ", few as (select symbol from sig group by symbol having count(*) < 3 union select symbol from {} group by symbol having count(*) < 3)\n, cs as (select * from {} where symbol not in (select symbol from few))\n"


@query("combo_backtest", BARS_SQL + PINS + ENGULFS + COFIRED + ALIVE.format("eng", "(select symbol, timeframe, greatest(idx_a, idx_b) as i, open_time, direction, sl_price from co)") + _traded("pin_bar+engulfing", "cs") + METRICS, METRIC_NAMES)
def _(s, d):
    b = hourly(s, d)
    return confluence.backtest_pair(b, detectors.pin_bar(b), detectors.engulfing(b), "pin_bar+engulfing")


HIGHER = RESAMPLED.replace(", h as", ", hi4 as").format("first(open order by open_time) as open, max(high) as high, min(low) as low, last(close order by open_time) as close") + """
, hs as (select symbol, t as open_time, case when least(open, close) - low >= 2 * abs(close - open) and high - greatest(open, close) <= abs(close - open) then 'long' else 'short' end as direction from hi4
  where close <> open and ((least(open, close) - low >= 2 * abs(close - open) and high - greatest(open, close) <= abs(close - open)) or (high - greatest(open, close) >= 2 * abs(close - open) and least(open, close) - low <= abs(close - open))))"""


@query("cross_timeframe_backtest", BARS_SQL + PINS + HIGHER + ALIVE.format("hs", "(select * from sig g where exists (select 1 from hs where hs.symbol = g.symbol and hs.direction = g.direction and hs.open_time between g.open_time - 14400000 and g.open_time))") + _traded("pin_bar@4h+pin_bar@1h", "cs") + METRICS, METRIC_NAMES)
def _(s, d):
    b = hourly(s, d)
    return confluence.backtest_cross(b, detectors.pin_bar(quality.resample(b)), detectors.pin_bar(b), "pin_bar@4h+pin_bar@1h", 4 * tables.HOUR_MS)


@query("combo_lookup", TRADES_SQL + """
, c as (select a.symbol, a.timeframe, least(a.strategy, b.strategy) as first, greatest(a.strategy, b.strategy) as second, a.avg_r + b.avg_r as avg_r from r a join r b on a.symbol = b.symbol and a.timeframe = b.timeframe and a.day_filter = b.day_filter and a.volume_suppress = b.volume_suppress where a.strategy <> b.strategy)
final select symbol, timeframe, first, second, max(avg_r) as best_avg_r, count(*) as n from c group by all""", "best_avg_r")
def _(s, d):
    r = tables.runs(tables.trades(s, d)).select("symbol", "timeframe", "day_filter", "volume_suppress", "strategy", "avg_r")
    keys = ["symbol", "timeframe", "day_filter", "volume_suppress"]
    both = r.withColumnsRenamed({"strategy": "strategy_a", "avg_r": "ra"}).join(r.withColumnsRenamed({"strategy": "strategy_b", "avg_r": "rb"}), keys).where("strategy_a <> strategy_b")
    return confluence.best_pairs(both.withColumn("avg_r", F.col("ra") + F.col("rb")))


# market statistics

DAYS = """
, dd as (select *, cast(make_timestamp(open_time * 1000) as date) as day from bars),
de as (select symbol, timeframe, day, max(high) as dh, min(low) as dl, first(open order by open_time) as o, last(close order by open_time) as c from dd group by all),
dx as (select de.*, (select min(open_time) from dd where dd.symbol = de.symbol and dd.day = de.day and dd.high = de.dh) as ht, (select min(open_time) from dd where dd.symbol = de.symbol and dd.day = de.day and dd.low = de.dl) as lt from de)
"""


@query("adr_report", BARS_SQL + DAYS + """
, k as (select *, (dh - dl) / o as r, row_number() over (partition by symbol order by day desc) as k from de where o > 0),
a as (select symbol, timeframe, avg(r) filter (k <= 14) as adr_14, avg(r) filter (k <= 30) as adr_30, median(r) filter (k <= 14) as adr_14_median, median(r) filter (k <= 30) as adr_30_median, max(r) filter (k = 1) as today_range,
  bool_or(case when dh <> dl then c > (dh + dl) / 2 end) filter (k = 1) as today_up from k group by all)
final select *, today_range / adr_14 as today_consumed from a""", "adr_14 adr_30 adr_14_median adr_30_median today_range today_consumed")
def _(s, d):
    return reports.adr(hourly(s, d))


@query("weekday_patterns", BARS_SQL + DAYS + """
final select symbol, timeframe, dayname(day) as dow, avg((dh - dl) / o) as avg_range, median((dh - dl) / o) as median_range, avg(cast(c > o as integer)) as bull_pct, count(*) as n, avg((c - o) / o) as avg_return, median((c - o) / o) as median_return,
  stddev_samp((c - o) / o) / sqrt(count(*)) as return_stderr, avg(case when dh > dl and (c - dl) / (dh - dl) < 0.2 then 1.0 else 0.0 end) as strong_high, avg(case when dh > dl and (dh - c) / (dh - dl) < 0.2 then 1.0 else 0.0 end) as strong_low
from de where o > 0 group by all""", "avg_range median_range bull_pct avg_return median_return return_stderr strong_high strong_low")
def _(s, d):
    return reports.weekday_patterns(hourly(s, d))


@query("hourly_extremes", BARS_SQL + DAYS + """
, x as (select symbol, timeframe, hour(make_timestamp((ht + 28800000) * 1000)) as hh, hour(make_timestamp((lt + 28800000) * 1000)) as lh from dx)
final select symbol, timeframe, cast(g.hour as integer) as hour, avg(cast(hh = g.hour as integer)) as high_pct, avg(cast(lh = g.hour as integer)) as low_pct from x cross join (select unnest(range(24)) as hour) g group by all""", "high_pct low_pct")
def _(s, d):
    return reports.hourly_extremes(hourly(s, d))


@query("first_extreme", BARS_SQL + DAYS + """
final select symbol, timeframe, dayname(day) as dow, avg(cast(lt < ht as integer)) as p1_low_pct, count(*) as n,
  avg(case when dh > dl and lt < ht and (dh - c) / (dh - dl) < 0.2 then 1.0 when dh > dl and lt >= ht and (c - dl) / (dh - dl) < 0.2 then 1.0 else 0.0 end) as p1_strong_pct
from dx group by all""", "p1_low_pct p1_strong_pct")
def _(s, d):
    return reports.first_extreme(hourly(s, d))


@query("session_breakdown", BARS_SQL + """
, ny as (select *, make_timestamp(open_time * 1000) at time zone 'UTC' at time zone 'America/New_York' as l from bars),
x as (select *, cast(l as date) as day, hour(l) * 60 + minute(l) as m from ny),
y as (select *, case when m between 240 and 569 then 'Pre' when m between 570 and 899 then 'RTH' when m between 900 and 959 then 'Power' when m between 960 and 1199 then 'AH' else 'Other' end as session,
  high = max(high) over (partition by symbol, day) as h, low = min(low) over (partition by symbol, day) as l_ from x),
p as (select symbol, timeframe, day, session, bool_or(h) as h, bool_or(l_) as l from y group by all),
n as (select symbol, count(distinct day) as days from y group by symbol)
final select symbol, timeframe, session, count(*) filter (h) / days as high_pct, count(*) filter (l) / days as low_pct, days from p join n using (symbol) group by symbol, timeframe, session, days""", "high_pct low_pct")
def _(s, d):
    return reports.sessions(hourly(s, d))


WEEKS = """
, wk as (select *, cast(date_trunc('week', make_timestamp((open_time + {0}) * 1000)) as date) as week from bars),
we as (select symbol, timeframe, week, max(high) as wh, min(low) as wl from wk group by all),
wx as (select we.*, (select min(open_time) from wk where wk.symbol = we.symbol and wk.week = we.week and wk.high = we.wh) as ht, (select min(open_time) from wk where wk.symbol = we.symbol and wk.week = we.week and wk.low = we.wl) as lt from we),
wd as (select *, isodow(make_timestamp((ht + {0}) * 1000)) as hd, isodow(make_timestamp((lt + {0}) * 1000)) as ld from wx)
"""


@query("weekly_first_extreme", BARS_SQL + WEEKS.format(0) + """
, c as (select symbol, timeframe, avg(cast(lt < ht as integer)) as p1_low_pct, count(*) as n from wd group by all),
lm as (select symbol, ld from wd group by symbol, ld qualify row_number() over (partition by symbol order by count(*) desc, ld) = 1),
hm as (select symbol, hd from wd group by symbol, hd qualify row_number() over (partition by symbol order by count(*) desc, hd) = 1)
final select c.*, cast(ld as integer) as low_mode, cast(hd as integer) as high_mode from c join lm using (symbol) join hm using (symbol)""", "p1_low_pct")
def _(s, d):
    return reports.weekly_first_extreme(hourly(s, d))


@query("weekly_timing", BARS_SQL + WEEKS.format(28800000) + """
final select symbol, timeframe, cast(g.dow as integer) as dow, avg(cast(hd > g.dow as integer)) as high_ahead, avg(cast(ld > g.dow as integer)) as low_ahead, count(*) as n from wd cross join (select unnest(range(1, 8)) as dow) g group by all""", "high_ahead low_ahead")
def _(s, d):
    return reports.weekly_timing(hourly(s, d))


CONE = """
, sb as (select *, make_timestamp(open_time * 1000) as ts from bars where hour(make_timestamp(open_time * 1000)) between 13 and 19),
x as (select *, cast(date_trunc('{0}', ts) as date) as period, count(*) over w as bars_, row_number() over (partition by symbol, date_trunc('{0}', ts) order by open_time) as step from sb window w as (partition by symbol, date_trunc('{0}', ts))),
y as (select * from x where bars_ = {1}),
s as (select symbol, timeframe, period, first(open order by open_time) as o, last(close order by open_time) as c, max(high) as hi, min(low) as lo, (max(high) - min(low)) / first(open order by open_time) as r from y group by all),
z as (select *, avg(r) over w as scale, count(r) over w as k from s window w as (partition by symbol order by period rows between {2} preceding and 1 preceding)),
g as (select *, case when c > o then 'bull' when c < o then 'bear' else 'doji' end as side, lower(dayname(period)[1:3]) as wd, (select min(step) from y where y.symbol = z.symbol and y.period = z.period and y.low = z.lo) as low_step, (select min(step) from y where y.symbol = z.symbol and y.period = z.period and y.high = z.hi) as high_step from z where k = {2} and scale > 0),
v as (select g.*, step, (close / o - 1) / scale as v from g join y using (symbol, timeframe, period)),
e as (select * exclude (step, v), min(v) as mae, max(v) as mfe, (hi - o) / (o * scale) as high_mag, (o - lo) / (o * scale) as low_mag from v group by all)
"""
SLICED = """
, c1 as (select *, unnest(case when side = 'doji' then ['all'] else ['all', side] end) as direction from {0})
, c2 as (select *, unnest(case when wd in ('sat', 'sun') then ['all'] else ['all', wd] end) as weekday from c1)
"""
BANDED = "count(*) as n, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.75) as p75, quantile_cont(v, 0.9) as p90"
DAY_CONE, WEEK_CONE = CONE.format("day", 7, 14), CONE.format("week", 35, 2)


def _records(s, d, kind="day"):
    b = cones.session(hourly(s, d, True))
    return cones.records(b) if kind == "day" else cones.records(b.where(F.weekday(F.timestamp_millis("open_time")) < 5), "week", 35, 2)


@query("path_cone", POOLED_SQL + DAY_CONE + SLICED.format("v") + f"\nfinal select symbol, timeframe, direction, weekday, cast(step as integer) as step, {BANDED} from c2 group by all", "p10 p25 p50 p75 p90")
def _(s, d):
    return cones.bands(_records(s, d))


@query("cone_timing", POOLED_SQL + DAY_CONE + SLICED.format("e") + """
final select symbol, timeframe, direction, weekday, cast(h.step as integer) as step, count(*) as n, avg(cast(low_step <= h.step as integer)) as low_in_by, avg(cast(high_step <= h.step as integer)) as high_in_by from c2 cross join (select unnest(range(1, 8)) as step) h group by all""", "low_in_by high_in_by")
def _(s, d):
    return cones.timing(_records(s, d))


EXCURSIONS = ", ".join([f"quantile_cont({c}, {p / 100}) as {c}_p{p}" for c in ("mae", "mfe") for p in (10, 50, 90)] + [f"quantile_cont({c}, {p / 100}) as {c}_p{p}" for c in ("high_mag", "low_mag") for p in (50, 80)])
EXCURSION_NAMES = "mae_p10 mae_p50 mae_p90 mfe_p10 mfe_p50 mfe_p90 high_mag_p50 high_mag_p80 low_mag_p50 low_mag_p80"


@query("cone_excursions", POOLED_SQL + DAY_CONE + SLICED.format("e") + f"\nfinal select symbol, timeframe, direction, weekday, count(*) as n, {EXCURSIONS} from c2 group by all", EXCURSION_NAMES)
def _(s, d):
    return cones.excursions(_records(s, d))


WEEKLY = WEEK_CONE.replace("between 13 and 19", "between 13 and 19 and isodow(make_timestamp(open_time * 1000)) < 6")


@query("weekly_cone", POOLED_SQL + WEEKLY + SLICED.format("v") + f"\nfinal select symbol, timeframe, direction, cast(step as integer) as step, {BANDED} from c1 group by all", "p10 p25 p50 p75 p90")
def _(s, d):
    return cones.bands(_records(s, d, "week"), False)


@query("week_records", POOLED_SQL + WEEKLY + """
final select symbol, timeframe, period, side as direction, cast(low_step as integer) as low_step, cast(high_step as integer) as high_step, mae, mfe, high_mag, low_mag from e""", "mae mfe high_mag low_mag")
def _(s, d):
    return _records(s, d, "week").drop("path", "weekday")


NOW = 1706549400000  # 17:30 of a Monday


@query("today_path", POOLED_SQL + f"""
, sb as (select *, make_timestamp(open_time * 1000) as ts, cast(make_timestamp(open_time * 1000) as date) as day from bars where hour(make_timestamp(open_time * 1000)) between 13 and 19),
s as (select symbol, day, (max(high) - min(low)) / first(open order by open_time) as r from sb where day < cast(make_timestamp({NOW} * 1000) as date) group by all having count(*) = 7),
a as (select symbol, avg(r) as scale from (select * from s qualify row_number() over (partition by symbol order by day desc) <= 14) group by symbol having count(*) = 14),
t as (select symbol, timeframe, first(open order by open_time) as period_open, count(*) filter (open_time + 3600000 <= {NOW}) as elapsed from sb where day = cast(make_timestamp({NOW} * 1000) as date) group by all)
final select t.symbol, t.timeframe, cast(row_number() over (partition by t.symbol order by open_time) as integer) as step, (close - period_open) / (period_open * scale) as v, cast(elapsed as integer) as elapsed, scale, period_open
from t join a using (symbol) join sb on sb.symbol = t.symbol and sb.day = cast(make_timestamp({NOW} * 1000) as date)""", "v scale period_open")
def _(s, d):
    p = cones.current_path(cones.session(hourly(s, d, True)), NOW)
    return p.select("symbol", "timeframe", F.posexplode("points").alias("step", "v"), "elapsed", "scale", "period_open").withColumn("step", F.col("step") + 1)


@query("weekly_flip_risk", BARS_SQL + WEEKS.format(0) + """
, f as (select symbol, timeframe, case when lt < ht then 'low' else 'high' end as first, case when lt < ht then hd else ld end as second from wd)
final select symbol, timeframe, first, cast(g.dow as integer) as dow, avg(cast(second > g.dow as integer)) as ahead, count(*) as n from f cross join (select unnest(range(1, 8)) as dow) g group by all""", "ahead")
def _(s, d):
    return reports.weekly_flip_risk(hourly(s, d))


ADR14 = """
, ak as (select *, (dh - dl) / o as r, row_number() over (partition by symbol order by day desc) as k from de where o > 0),
au as (select symbol, avg(r) filter (k <= 14) as adr from ak group by symbol)
"""
MOVES = DAYS + ADR14 + WEEKS.format(28800000) + """
, wo as (select symbol, week, first(open order by open_time) as wopen from wk group by all),
eo_ as (select symbol, timeframe, week, isodow(make_timestamp((open_time + 28800000) * 1000)) as dow, last(close order by open_time) as eod from wk group by all),
mj as (select e.symbol, e.timeframe, e.dow, eod / wopen - 1 as mv, adr, hd, ld from eo_ e join wo using (symbol, week) join wd using (symbol, week) join au using (symbol)),
mb as (select *, case when abs(mv) < adr then 'small' when abs(mv) < 2 * adr then 'medium' else 'large' end as move from mj),
mt as (select symbol, timeframe, cast(dow as integer) as dow, move, count(*) as n, avg(cast(ld > dow as integer)) as low_ahead, avg(cast(hd > dow as integer)) as high_ahead from mb group by all),
nw as (select symbol, max(open_time) as t, epoch_ms(date_trunc('week', make_timestamp((max(open_time) + 28800000) * 1000))) - 28800000 as w0 from bars group by symbol)
"""


@query("weekly_moves", BARS_SQL + MOVES + "\nfinal select * from mt", "low_ahead high_ahead")
def _(s, d):
    return reports.weekly_moves(hourly(s, d))


@query("weekly_state", BARS_SQL + MOVES + """
, c as (select b.symbol, b.timeframe, first(open order by open_time) as week_open, last(close order by open_time) as price, cast(isodow(make_timestamp((any_value(t) + 28800000) * 1000)) as integer) as dow from b join nw using (symbol) where open_time >= w0 group by all),
cm as (select c.*, price / week_open - 1 as move_pct, case when abs(price / week_open - 1) < adr then 'small' when abs(price / week_open - 1) < 2 * adr then 'medium' else 'large' end as move from c join au using (symbol))
final select cm.symbol, cm.timeframe, cm.dow, week_open, price, move_pct, cm.move, n, low_ahead, high_ahead from cm left join mt on mt.symbol = cm.symbol and mt.dow = cm.dow and mt.move = cm.move""", "week_open price move_pct low_ahead high_ahead")
def _(s, d):
    return reports.weekly_state(hourly(s, d))


FIRST_WICK = "select b.symbol, b.timeframe, case when lt < ht then 'low' else 'high' end as first, case when lt < ht then least(open, close) - low else high - greatest(open, close) end / open as wick from {} w join b on b.symbol = w.symbol and b.open_time = least(lt, ht) where lt <> ht and open > 0"


@query("wick_percentile", BARS_SQL + MOVES.replace(WEEKS.format(28800000), WEEKS.format(0)).partition("\n, wo as")[0] + """
, nw as (select symbol, epoch_ms(date_trunc('week', make_timestamp((max(open_time) + 28800000) * 1000))) - 28800000 as w0 from bars group by symbol),
cb as (select bars.* from bars join nw using (symbol) where open_time >= w0), ce as (select symbol, max(high) as h, min(low) as l from cb group by symbol),
cx as (select symbol, (select min(open_time) from cb where cb.symbol = ce.symbol and cb.high = ce.h) as ht, (select min(open_time) from cb where cb.symbol = ce.symbol and cb.low = ce.l) as lt from ce),
""" + f"hw as ({FIRST_WICK.format('wx')}), cw as ({FIRST_WICK.format('cx')})" + """
final select cw.symbol, cw.timeframe, cw.first, cw.wick / adr as wick_of_adr, avg(cast(hw.wick > cw.wick as integer)) as exceeded, count(*) as n from cw join au using (symbol) join hw on hw.symbol = cw.symbol group by cw.symbol, cw.timeframe, cw.first, cw.wick, adr""", "wick_of_adr exceeded")
def _(s, d):
    return reports.wick_percentile(hourly(s, d))


# the outcome ledger

ALERTS = PINS + """
, al as (select g.symbol, g.timeframe, g.open_time, g.i, direction, x.close as entry, g.sl_price as sl, case when direction = 'long' then x.close + 2 * (x.close - g.sl_price) else x.close - 2 * (g.sl_price - x.close) end as tp from sig g join b x using (symbol, i)),
ah as (select al.symbol, al.i, min(j.i) as hit from al join b j on j.symbol = al.symbol and j.i between al.i + 1 and al.i + 24 where case when direction = 'long' then j.low <= sl or j.high >= tp else j.high >= sl or j.low <= tp end group by all),
an as (select al.symbol, al.i, count(*) as n, max(j.i) as last from al join b j on j.symbol = al.symbol and j.i between al.i + 1 and al.i + 24 group by all),
ao as (select al.*, j.open_time as hit_at, case when j.i is null then case when an.n >= 24 then 'expired' end when case when direction = 'long' then j.low <= sl else j.high >= sl end then 'loss' else 'win' end as outcome, e.close as last_close, e.open_time as last_at
  from al left join ah using (symbol, i) left join b j on j.symbol = al.symbol and j.i = ah.hit left join an on an.symbol = al.symbol and an.i = al.i left join b e on e.symbol = al.symbol and e.i = an.last),
ol as (select symbol, timeframe, open_time, direction, entry, sl, tp, outcome, (case outcome when 'loss' then sl when 'win' then tp when 'expired' then last_close end - entry) * case when direction = 'long' then 1 else -1 end / nullif(abs(entry - sl), 0) as outcome_r,
  case when outcome = 'expired' then last_at else hit_at end as resolved_at from ao)
"""


def _ledger(s, d):
    b = hourly(s, d)
    a = detectors.pin_bar(b).join(b.select("symbol", "timeframe", "open_time", F.col("close").alias("entry")), ["symbol", "timeframe", "open_time"])
    a = a.select("symbol", "timeframe", "open_time", "direction", "entry", F.col("sl_price").alias("sl"), (F.col("entry") + 2 * (F.col("entry") - F.col("sl_price"))).alias("tp"))
    return outcomes.resolve(b, a, 24)


@query("resolve_outcomes", BARS_SQL + ALERTS + "\nfinal select * from ol", "entry sl tp outcome_r")
def _(s, d):
    return _ledger(s, d)


@query("outcome_totals", BARS_SQL + ALERTS + "\nfinal select count(*) as total_rows, count(outcome) as resolved, count(*) filter (outcome is null) as open_rows, count(*) filter (outcome = 'win') as wins, count(*) filter (outcome = 'loss') as losses, count(*) filter (outcome = 'expired') as expired from ol")
def _(s, d):
    return outcomes.totals(_ledger(s, d))


@query("outcome_cells", BARS_SQL + ALERTS + """
final select symbol, timeframe, direction, count(*) as n, count(*) filter (outcome = 'win') as wins, count(*) filter (outcome = 'loss') as losses, count(*) filter (outcome = 'expired') as expired,
  avg(case outcome when 'win' then 1.0 when 'loss' then 0.0 end) as win_rate, avg(outcome_r) as avg_r from ol where outcome is not null group by symbol, timeframe, direction having count(*) >= 5""", "win_rate avg_r")
def _(s, d):
    return outcomes.cells(_ledger(s, d), ["symbol", "timeframe", "direction"], 5)


@query("open_positions", BARS_SQL + ALERTS + """
, mk as (select symbol, last(close order by open_time) as mark from bars group by symbol),
sg as (select ol.*, mark, case when direction = 'long' then 1 else -1 end as g, abs(entry - sl) as risk from ol left join mk using (symbol) where outcome is null)
final select symbol, timeframe, open_time, direction, entry, sl, tp, mark, (mark - entry) * g / nullif(risk, 0) as open_r, (mark - sl) * g / nullif(risk, 0) as to_stop, (tp - mark) * g / nullif(risk, 0) as to_target from sg""", "entry sl tp mark open_r to_stop to_target")
def _(s, d):
    return outcomes.marked(_ledger(s, d), hourly(s, d))


# exits

WALK = ALERTS + """
, wk as (select al.*, j.i - al.i - 1 as k, j.open_time as t, case direction when 'long' then j.high - entry else entry - j.low end / abs(entry - sl) as fav, case direction when 'long' then j.low - entry else entry - j.high end / abs(entry - sl) as adv,
  (j.close - entry) * case direction when 'long' then 1 else -1 end / abs(entry - sl) as c from al join b j on j.symbol = al.symbol and j.i between al.i + 1 and al.i + 24),
ev as (select symbol, i, min(k) filter (fav >= 1 - 1e-12) as arm, min(k) filter (fav >= 2 - 1e-12) as tp_k, min(k) filter (adv <= -1 + 1e-12) as sl_k, max(k) as last, arg_max(c, k) as last_c from wk group by all),
es as (select ev.*, least(sl_k, (select min(k) from wk where wk.symbol = ev.symbol and wk.i = ev.i and wk.k > ev.arm and wk.adv <= 1e-12)) as st from ev),
eo as (select *, case when st is not null and st <= coalesce(tp_k, st) then case when coalesce(st > arm, false) then 'breakeven' else 'loss' end when tp_k is not null then 'win' else 'expired' end as outcome from es),
ex as (select *, case when outcome in ('loss', 'breakeven') then st when outcome = 'win' then tp_k else last end as e from eo),
ey as (select *, coalesce(arm < e or arm = e and outcome not in ('loss', 'breakeven'), false) as part from ex)
"""


@query("exit_replay", BARS_SQL + WALK + """
final select al.symbol, al.timeframe, al.open_time, al.direction, al.entry, al.sl, 'composite' as policy, outcome, case when part then 0.5 else 0 end + case when part then 0.5 else 1 end * case outcome when 'loss' then -1 when 'breakeven' then 0 when 'win' then 2 else last_c end as realized_r, cast(e as integer) as exit_bar, part as partial_taken
from ey join al using (symbol, i)""", "entry sl realized_r")
def _(s, d):
    a = _ledger(s, d).select("symbol", "timeframe", "open_time", "direction", "entry", "sl")
    return exits.replay(hourly(s, d), a, exits.Policy("composite", 2.0, 24, 1.0, 0.5, 1.0))


@query("exit_policies", BARS_SQL + WALK + """
, cm as (select symbol, i, case when part then 0.5 else 0 end + case when part then 0.5 else 1 end * case outcome when 'loss' then -1 when 'breakeven' then 0 when 'win' then 2 else last_c end as r from ey),
fx as (select symbol, i, case when sl_k is not null and sl_k <= coalesce(tp_k, sl_k) then -1 when tp_k is not null then 2 else last_c end as r from ev),
u as (select 'fixed' as policy, al.direction, fx.r, 0.0 as gain from fx join al using (symbol, i) union all select 'composite', al.direction, cm.r, cm.r - fx.r from cm join fx using (symbol, i) join al using (symbol, i))
final select policy, direction, count(*) as n, avg(r) as avg_r, stddev_samp(r) as sd_r, avg(cast(r > 0 as integer)) as win_rate, avg(gain) as gain from u group by all""", "avg_r sd_r win_rate gain")
def _(s, d):
    a = _ledger(s, d).select("symbol", "timeframe", "open_time", "direction", "entry", "sl")
    return exits.compare(hourly(s, d), a, [exits.Policy("fixed", 2.0, 24), exits.Policy("composite", 2.0, 24, 1.0, 0.5, 1.0)], ["direction"])


EXCURSED = ALERTS + """
, wk as (select ol.*, j.i as ji, case ol.direction when 'long' then j.high - ol.entry else ol.entry - j.low end / abs(ol.entry - ol.sl) as fav, case ol.direction when 'long' then ol.entry - j.low else j.high - ol.entry end / abs(ol.entry - ol.sl) as adv
  from ol join al on al.symbol = ol.symbol and al.open_time = ol.open_time and al.direction = ol.direction join b j on j.symbol = ol.symbol and j.i between al.i + 1 and al.i + 24 and j.open_time <= resolved_at where outcome is not null),
wl as (select *, max(ji) over (partition by symbol, open_time, direction) as lj from wk),
eg as (select symbol, timeframe, open_time, direction, entry, sl, tp, outcome, outcome_r, resolved_at, coalesce(max(fav) filter (ji < lj), 0) as bf, max(fav) as af, max(adv) as ad, count(*) as held, (tp - entry) * case direction when 'long' then 1 else -1 end / abs(entry - sl) as tp_r from wl group by all),
exc as (select * exclude (bf, af, ad, held), greatest(case outcome when 'loss' then bf when 'win' then greatest(bf, tp_r) else af end, 0) as mfe_r, greatest(ad, 0) as mae_r, cast(held as integer) as bars_held from eg)
"""


@query("excursions", BARS_SQL + EXCURSED + "\nfinal select * from exc", "entry sl tp outcome_r tp_r mfe_r mae_r")
def _(s, d):
    return exits.excursions(hourly(s, d), _ledger(s, d), 24)


@query("excursion_cohorts", BARS_SQL + EXCURSED + """
final select outcome, direction, count(*) as n, avg(mfe_r) as mfe_mean, median(mfe_r) as mfe_p50, avg(mae_r) as mae_mean, median(mae_r) as mae_p50, avg(cast(mfe_r >= 0.5 as integer)) as reach_05, avg(cast(mfe_r >= 1 as integer)) as reach_10,
  median(tp_r) as tp_r_p50, cast(median(bars_held) as double) as bars_held_p50, avg(outcome_r) as outcome_r_mean from exc group by all having count(*) >= 5""", "mfe_mean mfe_p50 mae_mean mae_p50 reach_05 reach_10 tp_r_p50 bars_held_p50 outcome_r_mean")
def _(s, d):
    return exits.cohorts(exits.excursions(hourly(s, d), _ledger(s, d), 24), ["direction"], 5)


# digests of the run ledger

POOLED = "sum({0} * {1}) / nullif(sum({1}) filter ({0} is not null), 0)"


def _runs(s, d):
    return tables.runs(tables.trades(s, d))


@query("run_ledger", TRADES_SQL + "\nfinal select * from r", "avg_r total_r win_rate long_avg_r short_avg_r long_win_rate short_win_rate adr_suppress_threshold")
def _(s, d):
    return _runs(s, d)


@query("digest_symbol", TRADES_SQL + f"""
, x as (select *, max(avg_r) over (partition by symbol) as top from r where closed_trades >= 5)
final select symbol, sum(total_r) as total_r, {POOLED.format('avg_r', 'closed_trades')} as avg_r, cast(sum(closed_trades) as bigint) as trades, count(*) as run_count, max(case when avg_r = top then strategy end) as best_strategy from x group by symbol""", "total_r avg_r")
def _(s, d):
    return reports.by_symbol(_runs(s, d))


def _by(name: str, key: str) -> None:
    sql = f"\nfinal select {key}, {POOLED.format('avg_r', 'closed_trades')} as avg_r, sum(total_r) as total_r, cast(sum(closed_trades) as bigint) as trades, count(*) as run_count, {POOLED.format('win_rate', 'closed_trades')} * 100 as win_pct from r where closed_trades >= 5 group by {key}"
    query(name, TRADES_SQL + sql, "avg_r total_r win_pct")(lambda s, d: reports.by_key(_runs(s, d), key))


_by("digest_strategy", "strategy")
_by("digest_timeframe", "timeframe")


@query("digest_top_cells", TRADES_SQL + """
final select symbol, timeframe, strategy, day_filter, adr_suppress_threshold, volume_suppress, closed_trades, avg_r from r where closed_trades >= 5
order by avg_r desc, symbol, timeframe, strategy, day_filter, adr_suppress_threshold nulls first, volume_suppress limit 20""", "avg_r adr_suppress_threshold")
def _(s, d):
    return reports.top_cells(_runs(s, d))


def _ab(name: str, on: str, off: str, flag, keys: list[str]) -> None:
    same = " and ".join(f"x.{k} is not distinct from y.{k}" for k in keys)
    sql = f"""
final select {', '.join(f'x.{k}' for k in keys)}, x.avg_r as on_avg_r, y.avg_r as off_avg_r, x.avg_r - y.avg_r as delta, x.closed_trades as on_trades, y.closed_trades as off_trades
from r x join r y on {same} where x.{on} and y.{off} and x.closed_trades >= 5 and y.closed_trades >= 5"""
    query(name, TRADES_SQL + sql, "on_avg_r off_avg_r delta" + " adr_suppress_threshold" * ("adr_suppress_threshold" in keys))(lambda s, d: reports.ab(_runs(s, d), flag(), keys))


CELL = ["symbol", "timeframe", "strategy"]
_ab("digest_adr_ab", "adr_suppress_threshold is not null", "adr_suppress_threshold is null", lambda: F.col("adr_suppress_threshold").isNotNull(), [*CELL, "day_filter", "volume_suppress"])
_ab("digest_volume_ab", "volume_suppress", "volume_suppress = false", lambda: F.col("volume_suppress"), [*CELL, "day_filter", "adr_suppress_threshold"])
_ab("digest_day_filter_ab", "day_filter <> 'off'", "day_filter = 'off'", lambda: F.col("day_filter") != "off", [*CELL, "adr_suppress_threshold", "volume_suppress"])


@query("digest_direction_bias", TRADES_SQL + f"""
final select strategy, {POOLED.format('long_avg_r', 'long_closed_trades')} as long_avg_r, {POOLED.format('short_avg_r', 'short_closed_trades')} as short_avg_r,
  {POOLED.format('long_avg_r', 'long_closed_trades')} - {POOLED.format('short_avg_r', 'short_closed_trades')} as long_minus_short, cast(sum(long_closed_trades) as bigint) as long_trades, cast(sum(short_closed_trades) as bigint) as short_trades,
  {POOLED.format('long_win_rate', 'long_closed_trades')} * 100 as long_win_pct, {POOLED.format('short_win_rate', 'short_closed_trades')} * 100 as short_win_pct
from r where long_closed_trades >= 3 and short_closed_trades >= 3 group by strategy""", "long_avg_r short_avg_r long_minus_short long_win_pct short_win_pct")
def _(s, d):
    return reports.direction_bias(_runs(s, d))


@query("digest_consistency", TRADES_SQL + f"""
final select strategy, count(*) as cells, count(*) filter (avg_r > 0) as profitable, 100.0::double * count(*) filter (avg_r > 0) / count(*) as pct_profitable, {POOLED.format('avg_r', 'closed_trades')} as avg_r, cast(sum(closed_trades) as bigint) as trades
from r where closed_trades >= 5 group by strategy""", "pct_profitable avg_r")
def _(s, d):
    return reports.consistency(_runs(s, d))


DRAWN = """
, tc as (select *, sum(pnl_r) over w as cum from t window w as (partition by symbol, timeframe, strategy, day_filter, adr_suppress_threshold, volume_suppress order by entry_time, trade_id rows unbounded preceding)),
td as (select *, greatest(0, max(cum) over (partition by symbol, timeframe, strategy, day_filter, adr_suppress_threshold, volume_suppress order by entry_time, trade_id rows unbounded preceding)) - cum as dd from tc),
dr as (select symbol, timeframe, strategy, day_filter, adr_suppress_threshold, volume_suppress, count(*) as closed_trades, avg(pnl_r) as avg_r, sum(pnl_r) as total_r, avg(cast(pnl_r > 0 as integer)) as win_rate, max(dd) as max_drawdown_r, max(entry_time) as run_at_ms, sum(pnl_r) / nullif(max(dd), 0) as recovery_factor from td group by all)
"""


@query("digest_recovery", TRADES_SQL + DRAWN + f"""
final select strategy, avg(recovery_factor) as avg_rf, max(recovery_factor) as best_rf, avg(max_drawdown_r) as avg_max_dd_r, {POOLED.format('avg_r', 'closed_trades')} as avg_r, cast(sum(closed_trades) as bigint) as trades, count(*) as run_count from dr where closed_trades >= 5 and recovery_factor > 0 group by strategy""", "avg_rf best_rf avg_max_dd_r avg_r")
def _(s, d):
    return reports.recovery(tables.drawdown_runs(tables.trades(s, d)))


def _pair_runs(s, d):
    """A ledger of pairs of strategies on the cells of the run ledger."""
    r = tables.drawdown_runs(tables.trades(s, d)).where("volume_suppress and adr_suppress_threshold is null").select("symbol", "timeframe", "day_filter", "strategy", "closed_trades", "avg_r", "total_r", "run_at_ms")
    keys = ["symbol", "timeframe", "day_filter"]
    a, b = (r.withColumnsRenamed({c: f"{p}_{c}" for c in r.columns if c not in keys}) for p in ("a", "b"))
    x = a.join(b, keys).where("a_strategy < b_strategy")
    return x.select(*keys, F.col("a_strategy").alias("strategy_a"), F.col("b_strategy").alias("strategy_b"), F.least("a_closed_trades", "b_closed_trades").alias("closed_trades"), ((F.col("a_avg_r") + F.col("b_avg_r")) / 2).alias("avg_r"), F.greatest("a_run_at_ms", "b_run_at_ms").alias("run_at_ms"))


PAIRED = DRAWN + """
, rr as (select * from dr where volume_suppress and adr_suppress_threshold is null),
pr as (select a.symbol, a.timeframe, a.day_filter, a.strategy as strategy_a, b.strategy as strategy_b, least(a.closed_trades, b.closed_trades) as closed_trades, (a.avg_r + b.avg_r) / 2 as avg_r, greatest(a.run_at_ms, b.run_at_ms) as run_at_ms
  from rr a join rr b on a.symbol = b.symbol and a.timeframe = b.timeframe and a.day_filter = b.day_filter and a.strategy < b.strategy)
"""


@query("digest_co_firing", TRADES_SQL + PAIRED + """
final select * from pr where closed_trades >= 3 qualify row_number() over (partition by symbol, timeframe, strategy_a, strategy_b, day_filter order by run_at_ms desc) = 1 order by avg_r desc, symbol, timeframe, strategy_a, strategy_b, day_filter limit 30""", "avg_r")
def _(s, d):
    return reports.leaderboard(_pair_runs(s, d), ["symbol", "timeframe", "strategy_a", "strategy_b", "day_filter"])


@query("digest_cross_timeframe", TRADES_SQL + DRAWN + """
, rr as (select * from dr where volume_suppress and adr_suppress_threshold is null and day_filter = 'off'),
pr as (select h.symbol, h.timeframe as tf_high, l.timeframe as tf_low, h.strategy as strategy_high, l.strategy as strategy_low, least(h.closed_trades, l.closed_trades) as closed_trades, l.avg_r, greatest(h.run_at_ms, l.run_at_ms) as run_at_ms
  from rr h join rr l on h.symbol = l.symbol and h.timeframe = '1d' and l.timeframe in ('1h', '4h'))
final select * from pr where closed_trades >= 3 order by avg_r desc, symbol, tf_high, tf_low, strategy_high, strategy_low limit 30""", "avg_r")
def _(s, d):
    r = tables.drawdown_runs(tables.trades(s, d)).where("volume_suppress and adr_suppress_threshold is null and day_filter = 'off'").select("symbol", "timeframe", "strategy", "closed_trades", "avg_r", "run_at_ms")
    h, low = r.where("timeframe = '1d'").toDF("symbol", "tf_high", "strategy_high", "hn", "_", "ht"), r.where("timeframe <> '1d'").toDF("symbol", "tf_low", "strategy_low", "ln", "avg_r", "lt")
    x = h.join(low, "symbol").select("symbol", "tf_high", "tf_low", "strategy_high", "strategy_low", F.least("hn", "ln").alias("closed_trades"), "avg_r", F.greatest("ht", "lt").alias("run_at_ms"))
    return reports.leaderboard(x, ["symbol", "tf_high", "tf_low", "strategy_high", "strategy_low"])


@query("latest_runs", TRADES_SQL + "\nfinal select * from r qualify row_number() over (partition by symbol, timeframe, strategy order by run_at_ms desc, day_filter, adr_suppress_threshold nulls first, volume_suppress) = 1", "avg_r total_r win_rate long_avg_r short_avg_r long_win_rate short_win_rate adr_suppress_threshold")
def _(s, d):
    return reports.latest(_runs(s, d), CELL, ["day_filter", "adr_suppress_threshold", "volume_suppress"])


STARS = "case when {1} >= {2} then case when {0} < 0 then 1 when {0} < 0.2 then 2 when {0} < 0.5 then 3 when {0} < 0.9 then 4 else 5 end end"


@query("confidence_ratings", TRADES_SQL + f"""
, n as (select * from r qualify row_number() over (partition by strategy, timeframe, symbol order by run_at_ms desc, day_filter, adr_suppress_threshold nulls first, volume_suppress) = 1),
m as (select strategy, timeframe, round({POOLED.format('avg_r', 'closed_trades')}, 4) as avg_r, round({POOLED.format('win_rate', 'closed_trades')}, 4) as win_rate, cast(sum(closed_trades) as bigint) as trades from n group by all)
final select *, {STARS.format('avg_r', 'trades', 10)} as stars from m""", "avg_r win_rate")
def _(s, d):
    return reports.ratings(_runs(s, d))


@query("directional_ratings", TRADES_SQL + f"""
, u as (select strategy, timeframe, 'long' as direction, long_avg_r as a, long_closed_trades as n from r union all select strategy, timeframe, 'short', short_avg_r, short_closed_trades from r),
m as (select strategy, timeframe, direction, {POOLED.format('a', 'n')} as avg_r, cast(sum(n) as bigint) as trades from u group by all)
final select *, {STARS.format('avg_r', 'trades', 5)} as stars from m""", "avg_r")
def _(s, d):
    return reports.directional_ratings(_runs(s, d))


SLICES = """
, g as (select strategy, timeframe, ['asia', 'europe', 'us'][hour(make_timestamp(entry_time * 1000)) // 8 + 1] as session, count(*) as n, avg(pnl_r) as avg_r, avg(cast(pnl_r > 0 as integer)) as win_rate from t group by all)
"""


@query("edge_slices", TRADES_SQL + SLICES + "\nfinal select *, n / sum(n) over (partition by strategy) as share from g", "avg_r win_rate share")
def _(s, d):
    return reports.edge_slices(tables.trades(s, d))


@query("edge_verdicts", TRADES_SQL + SLICES + """
, m as (select strategy, timeframe, sum(avg_r * n) / sum(n) as avg_r, cast(sum(n) as bigint) as n, count(*) filter (avg_r > 0) as good, count(*) as slices from g group by all)
final select *, case when n < 30 then 'INSUFFICIENT' when avg_r < 0 and good = 0 then 'KILL' when avg_r < 0 then 'DEMOTE' else 'KEEP' end as verdict from m""", "avg_r")
def _(s, d):
    return reports.verdicts(reports.edge_slices(tables.trades(s, d)))


# daily books

PANEL = DAILY_SQL + ", p as (select cast(make_timestamp(open_time * 1000) as date) as date, symbol, close, close / lag(close) over (partition by symbol order by open_time) - 1 as ret from bars)\n"


@query("momentum_book", PANEL + """
, g as (select *, lag(close, 5) over w / lag(close, 60) over w - 1 as signal from p window w as (partition by symbol order by date)),
z as (select *, case when stddev_samp(signal) over w > 0 then (signal - avg(signal) over w) / stddev_samp(signal) over w end as z from g window w as (partition by date)),
r as (select *, z - avg(z) over (partition by date) as raw from z),
k as (select *, coalesce(raw / nullif(sum(abs(raw)) over (partition by date), 0), 0) as weight from r),
h as (select *, coalesce(lag(weight) over (partition by symbol order by date), 0) as held from k)
final select date, sum(held * coalesce(ret, 0)) as ret, sum(abs(held)) as gross, sum(abs(weight - held)) as turnover, count(*) as n from h group by date""", "ret gross turnover")
def _(s, d):
    return books.book_returns(books.weights(books.zscore(books.momentum(books.panel(per_day(s, d)), 60, 5))))


# exponential weights as powers of the distance; deviations with weights are unbiased
FORECAST = PANEL + f"""
, k as (select *, row_number() over (partition by symbol order by date) as i from p),
em as (select x.symbol, x.date, x.i, x.close, x.ret, {', '.join(WEIGHED.format(f'2.0 / {n + 1}', 'y.close') + f' as e{n}' for n in (8, 16, 32, 64, 128, 256))} from k x join k y on x.symbol = y.symbol and y.i <= x.i group by all),
vs as (select x.symbol, x.i, sum(w) as sw, sum(w * w) as sww, sum(w * y.ret) as swr, sum(w * y.ret * y.ret) as swrr, count(*) as n from (select *, 1 as one from k) x join k y on x.symbol = y.symbol and y.i <= x.i and y.ret is not null cross join lateral (select pow(1 - 2.0 / 33, x.i - y.i) as w) group by all),
vo as (select symbol, i + 1 as i, case when n >= 32 then sqrt((swrr / sw - pow(swr / sw, 2)) * sw * sw / (sw * sw - sww)) end as vol from vs),
ft as (select em.symbol, em.date, em.close, em.ret, vol, greatest(-20, least(20, (greatest(-20, least(20, (e8 - e32) / (vol * close) * 5.3)) + greatest(-20, least(20, (e16 - e64) / (vol * close) * 3.75)) + greatest(-20, least(20, (e32 - e128) / (vol * close) * 2.65)) + greatest(-20, least(20, (e64 - e256) / (vol * close) * 1.91))) / 4 * 1.25)) as f0 from em left join vo using (symbol, i)),
fc as (select * exclude (f0), case when vol is not null then f0 end as forecast from ft),
sz as (select *, lag(forecast) over (partition by symbol order by date) / 10 * 0.2 / (vol * sqrt(252)) as leverage from fc),
nt as (select *, leverage * ret as gross, abs(leverage - coalesce(lag(leverage) over (partition by symbol order by date), 0)) * 0.0003 as cost from sz)
"""


def _forecasts(s, d):
    return books.sized(books.forecasts(books.panel(per_day(s, d)), books.SPEEDS))


@query("forecast_positions", FORECAST + "\nfinal select *, gross - cost as net from nt", "close ret vol forecast leverage gross cost net")
def _(s, d):
    return _forecasts(s, d)


GOVERNED = """
, g as (select date, coalesce(avg(gross - cost), 0) as pre, count(gross - cost) as active from nt group by date),
v as (select *, case when count(pre) over w = 64 then stddev_samp(pre) over w end as vol from g window w as (order by date rows 63 preceding)),
gv as (select date, pre, active, case when lag(vol) over (order by date) is not null then greatest(0.5, least(1.5, 0.2 / (lag(vol) over (order by date) * sqrt(252)))) end as governor from v),
bk as (select *, coalesce(governor, 0) * pre as ret from gv)
"""


@query("forecast_book", FORECAST + GOVERNED + "\nfinal select * from bk", "pre governor ret")
def _(s, d):
    return books.governed(_forecasts(s, d))


@query("book_subperiods", FORECAST + GOVERNED + """
, n as (select *, ntile(4) over (order by date) as part from bk), m as (select cast(part as integer) as part, min(date) as first, count(*) as n, avg(ret) as mean, stddev_samp(ret) as sd from n group by part)
final select *, mean / sd * sqrt(252) as sharpe from m""", "mean sd sharpe")
def _(s, d):
    return books.subperiods(books.governed(_forecasts(s, d)))


@query("cross_sectional_forecasts", FORECAST + """
final select date, symbol, substr(symbol, 2) as status, forecast - avg(forecast) over (partition by date) as forecast, forecast - avg(forecast) over (partition by date, substr(symbol, 2)) as neutral from fc""", "forecast neutral")
def _(s, d):
    f = books.forecasts(books.panel(per_day(s, d)), books.SPEEDS).withColumn("status", F.substring("symbol", 2, 1)).withColumn("neutral", F.col("forecast"))
    return books.demeaned(books.demeaned(f), "neutral", ("status",)).select("date", "symbol", "status", "forecast", "neutral")


RESIDUAL = PANEL + """
, m as (select *, avg(ret) over (partition by date) as market from p where ret is not null),
be as (select *, case when count(ret) over w >= 60 then covar_samp(ret, market) over w / var_samp(market) over w end as beta from m window w as (partition by symbol order by date rows between 60 preceding and 1 preceding)),
rs as (select *, ret - beta * market as resid from be)
"""


@query("residual_returns", RESIDUAL + "\nfinal select * from rs", "close ret market beta resid")
def _(s, d):
    return books.residuals(books.panel(per_day(s, d)), 60)


@query("beta_neutral_book", RESIDUAL + """
, sg as (select *, lag(close, 1) over w / lag(close, 21) over w - 1 as signal from rs window w as (partition by symbol order by date)),
c as (select *, signal - avg(signal) over (partition by date) as sd, beta - avg(beta) over (partition by date) as bd from sg where signal is not null and beta is not null),
r as (select *, sd - coalesce(sum(sd * bd) over (partition by date) / nullif(sum(bd * bd) over (partition by date), 0), 0) * bd as raw from c),
k as (select *, case when sum(abs(raw)) over (partition by date) > 1e-9 * sum(abs(sd)) over (partition by date) then raw / sum(abs(raw)) over (partition by date) else 0 end as weight from r)
final select date, symbol, signal, beta, weight from k""", "signal beta weight")
def _(s, d):
    return books.beta_neutral(books.momentum(books.residuals(books.panel(per_day(s, d)), 60), 21, 1)).select("date", "symbol", "signal", "beta", "weight")


@query("vol_overlay", PANEL + """
, m as (select *, case when count(close) over w >= 200 then avg(close) over w end as sma, case when count(ret) over v >= 20 then stddev_samp(ret) over v end as vol from p window w as (partition by symbol order by date rows 199 preceding), v as (partition by symbol order by date rows 19 preceding)),
l as (select *, lag(close > sma) over w as risk_on, lag(vol) over w as pv from m window w as (partition by symbol order by date)),
z as (select date, symbol, risk_on, case when risk_on and pv is not null then least(0.1 / (pv * sqrt(252)), 1) else 0 end as weight, ret from l)
final select date, symbol, risk_on, weight, weight * coalesce(ret, 0) as arm from z""", "weight arm")
def _(s, d):
    return books.vol_overlay(books.panel(per_day(s, d))).select("date", "symbol", "risk_on", "weight", "arm")


SIGMA = """
, k as (select *, close / lag(close) over (partition by symbol order by i) - 1 as ret from b),
sd as (select *, case when count(ret) over w >= 20 then stddev_samp(ret) over w end as now from k window w as (partition by symbol order by i rows 19 preceding)),
sv as (select *, lag(now) over (partition by symbol order by i) as sigma from sd)
"""
GAPS = SIGMA + """
, gp as (select *, lag(close) over (partition by symbol order by i) as level from sv),
gm as (select symbol, timeframe, i, level, open / level - 1 > 0 as up from gp where level > 0 and sigma > 0 and abs(open / level - 1) >= 0.5 * sigma),
gf as (select g.symbol, g.timeframe, g.i, g.level, g.up, min(j.i) as filled from gm g left join b j on j.symbol = g.symbol and j.i >= g.i and case when up then j.low <= level else j.high >= level end group by all)
"""


def _with_sigma(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("open_time")
    b = per_day(s, d).withColumn("_ret", F.col("close") / F.lag("close").over(w) - 1)
    past = w.rowsBetween(-19, 0)
    return b.withColumn("_sd", F.when(F.count("_ret").over(past) >= 20, F.stddev_samp("_ret").over(past))).withColumn("sigma", F.lag("_sd").over(w)).drop("_ret", "_sd")


@query("gap_fill_shares", DAILY_SQL + GAPS + """
final select symbol, timeframe, count(*) as n_gaps, avg(cast(up as integer)) as up_share, avg(coalesce(cast(filled - i + 1 <= 1 as integer), 0)) as fill_1, avg(coalesce(cast(filled - i + 1 <= 5 as integer), 0)) as fill_5, avg(coalesce(cast(filled - i + 1 <= 20 as integer), 0)) as fill_20, avg(coalesce(cast(filled - i + 1 <= 60 as integer), 0)) as fill_60 from gf group by all""", "up_share fill_1 fill_5 fill_20 fill_60")
def _(s, d):
    return magnets.fill_shares(magnets.gaps(_with_sigma(s, d)))


@query("gap_magnets", DAILY_SQL + GAPS + """
, al as (select sv.symbol, sv.i, arg_min(g.level, struct_pack(d := abs(g.level - sv.close), m := g.i)) as level from sv join gf g on g.symbol = sv.symbol and sv.i between g.i and g.i + 59 and (g.filled is null or g.filled > sv.i) group by all),
ds as (select sv.symbol, sv.timeframe, sv.open_time, sv.close, sv.sigma, al.level, (al.level - sv.close) / (sv.close * sv.sigma) as dist from sv left join al using (symbol, i))
final select symbol, timeframe, open_time, close, sigma, level, sign(dist) * greatest(0, 1 - abs(dist) / 2) as magnet from ds""", "close sigma level magnet")
def _(s, d):
    return magnets.magnets(_with_sigma(s, d)).select("symbol", "timeframe", "open_time", "close", "sigma", "level", "magnet")


DECLINES = PANEL + """
, dk as (select *, row_number() over (partition by symbol order by date) as k from p),
dp as (select *, max(close) over w as peak, arg_max(k, struct_pack(c := close, n := -k)) over w as at_ from dk window w as (partition by symbol order by date rows 59 preceding)),
de as (select *, (peak - close) / peak as d0, k - at_ as u0 from dp),
dd as (select date, symbol, close, case when k >= 60 and d0 >= 0.1 and u0 >= 3 then d0 end as depth, case when k >= 60 and d0 >= 0.1 and u0 >= 3 then cast(u0 as double) end as duration from de)
"""


@query("declines", DECLINES + "\nfinal select *, depth / duration as velocity from dd", "close depth duration velocity")
def _(s, d):
    return magnets.declines(books.panel(per_day(s, d))).select("date", "symbol", "close", "depth", "duration", "velocity")


@query("decline_book", DECLINES + """
, sc as (select dd.*, p.ret, lag(-depth / duration) over (partition by dd.symbol order by date) as signal from dd join p using (date, symbol)),
z as (select *, case when stddev_samp(signal) over w > 0 then (signal - avg(signal) over w) / stddev_samp(signal) over w end as z from sc window w as (partition by date))
final select date, count(signal) as n, coalesce(sum(z * ret) / nullif(sum(abs(z)), 0), 0) as ret from z group by date""", "ret")
def _(s, d):
    p = magnets.declines(books.panel(per_day(s, d))).withColumn("signal", -F.col("velocity"))
    z = books.zscore(magnets.lagged(p, "signal"))
    return z.groupBy("date").agg(F.count("signal").alias("n"), F.coalesce(F.try_divide(F.sum(F.col("z") * F.col("ret")), F.nullif(F.sum(F.abs("z")), F.lit(0.0))), F.lit(0.0)).alias("ret"))


@query("sideways_market", PANEL + """
, m as (select date, avg(ret) as ret from p where ret is not null group by date),
f as (select *, count(ret) over w >= 20 and abs(sum(ret) over w) < stddev_samp(ret) over w * sqrt(20) as flat from m window w as (order by date rows 19 preceding))
final select date, ret, coalesce(lag(flat) over (order by date), false) as sideways from f""", "ret")
def _(s, d):
    return magnets.sideways(books.panel(per_day(s, d)).where("ret is not null").groupBy("date").agg(F.avg("ret").alias("ret")))


@query("market_regression", PANEL + """
, m as (select *, avg(ret) over (partition by date) as market from p where ret is not null),
r as (select symbol, count(*) as n, regr_slope(ret, market) as beta, regr_intercept(ret, market) as alpha, regr_r2(ret, market) as r2, avg(market) as mx, var_pop(market) as vx, var_pop(ret) as vy from m group by symbol),
e as (select *, n * vy * (1 - r2) as rss from r)
final select symbol, n, alpha * 252 as alpha_a_year, beta, alpha / sqrt(rss / (n - 2) * (1.0 / n + mx * mx / (n * vx))) as t_alpha, r2, alpha / sqrt(rss / (n - 1)) * sqrt(252) as hedged_sharpe from e""", "alpha_a_year beta t_alpha r2 hedged_sharpe")
def _(s, d):
    from pyspark.sql import Window

    p = books.panel(per_day(s, d)).where("ret is not null").withColumn("market", F.avg("ret").over(Window.partitionBy("date")))
    return statistics.ols(p, ["symbol"], "ret", "market")


@query("independent_series", PANEL + """
, c as (select corr(x.ret, y.ret) as corr from p x join p y using (date) where x.symbol < y.symbol and x.ret is not null and y.ret is not null group by x.symbol, y.symbol),
m as (select avg(corr) as mean_corr from c), n as (select count(distinct symbol) as k from p where ret is not null)
final select k, mean_corr, greatest(1, least(k, k / (1 + (k - 1) * greatest(mean_corr, 0)))) as k_eff from n cross join m""", "mean_corr k_eff")
def _(s, d):
    return statistics.independent_series(books.panel(per_day(s, d)))


@query("trend_filter", PANEL + """
, m as (select *, case when count(close) over w >= 200 then avg(close) over w end as sma from p window w as (partition by symbol order by date rows 199 preceding))
final select date, symbol, close, ret, sma, lag(close > sma) over (partition by symbol order by date) as risk_on from m""", "close ret sma")
def _(s, d):
    return books.trend_filter(books.panel(per_day(s, d)))


@query("low_volatility_book", PANEL + """
, v as (select *, case when count(ret) over w >= 60 then stddev_samp(ret) over w end as vol from p window w as (partition by symbol order by date rows 59 preceding)),
q as (select date, quantile_cont(vol, 0.5) as cut from v where vol is not null group by date)
final select date, symbol, close, ret, vol, cut, 1.0::double / count(*) over (partition by date) as weight from v join q using (date) where vol <= cut""", "close ret vol cut weight")
def _(s, d):
    return books.low_volatility(books.panel(per_day(s, d)))


@query("rolling_beta", PANEL + """
, m as (select *, avg(ret) over (partition by date) as market from p where ret is not null)
final select date, symbol, case when count(*) over w >= 252 then covar_samp(ret, market) over w / var_samp(market) over w end as beta from m window w as (partition by symbol order by date rows 251 preceding)""", "beta")
def _(s, d):
    from pyspark.sql import Window

    p = books.panel(per_day(s, d)).where("ret is not null").withColumn("market", F.avg("ret").over(Window.partitionBy("date")))
    return p.select("date", "symbol", indicators.rolling_beta(p, 252).alias("beta"))


@query("turn_of_month", PANEL + """
, x as (select *, row_number() over (partition by symbol, date_trunc('month', date) order by date) <= 3 or row_number() over (partition by symbol, date_trunc('month', date) order by date desc) <= 1 as in_turn from p)
final select symbol, in_turn, avg(ret) as mean, stddev_samp(ret) as sd, count(*) as n from x where ret is not null group by all""", "mean sd")
def _(s, d):
    return books.turn_of_month(books.panel(per_day(s, d)))


@query("gap_fades", DAILY_SQL + """
, x as (select *, lag(close) over (partition by symbol order by open_time) as prev from bars), g as (select *, open / prev - 1 as gap from x)
final select symbol, timeframe, gap > 0 as up, count(*) as n, avg(cast(case when gap > 0 then low <= prev else high >= prev end as integer)) as filled, avg(gap) as mean_gap from g where abs(gap) >= 0.01 group by all""", "filled mean_gap")
def _(s, d):
    return books.gap_fades(per_day(s, d))


@query("seasonal_surprise", """
with e as (select 'S' || (l_suppkey % 10) as symbol, year(l_shipdate) as fy, quarter(l_shipdate) as fp, sum(l_extendedprice * (1 - l_discount)) / 1e6 as eps from lineitem group by all),
c as (select a.symbol, a.fy, a.fp, a.eps - b.eps as change from e a join e b on a.symbol = b.symbol and a.fp = b.fp and a.fy = b.fy + 1)
final select symbol, cast(fy as integer) as fy, cast(fp as integer) as fp, change, change / case when count(change) over w >= 4 then stddev_samp(change) over w end as sue from c window w as (partition by symbol order by fy, fp rows between 8 preceding and 1 preceding)""", "change sue")
def _(s, d):
    e = tables.table(s, d, "lineitem").groupBy(F.concat(F.lit("S"), F.col("l_suppkey") % 10).alias("symbol"), F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("fp")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("eps"))
    return books.seasonal_surprise(e)


@query("insider_classes", """
with x as (select o_orderkey as id, o_custkey as owner, cast(o_orderdate as date) as date, year(o_orderdate) as y, month(o_orderdate) as m from orders),
ym as (select distinct owner, y, m from x), ys as (select distinct owner, y from x)
final select id, owner, date, case when (select count(*) from ym where ym.owner = x.owner and ym.m = x.m and ym.y between x.y - 3 and x.y - 1) = 3 then 'routine'
  when (select count(*) from ys where ys.owner = x.owner and ys.y between x.y - 3 and x.y - 1) = 3 then 'opportunistic' else 'unclassified' end as class from x""")
def _(s, d):
    o = tables.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("date"))
    return books.insider_classes(o)


# statistics


@query("trade_moments", TRADES_SQL + """
, m as (select strategy, timeframe, count(*) as n, avg(pnl_r) as mean, stddev_samp(pnl_r) as sd from t group by all)
final select m.strategy, m.timeframe, n, mean, sd, avg(pow((pnl_r - mean) / sd, 3)) as skew, avg(pow((pnl_r - mean) / sd, 4)) as kurt from m join t using (strategy, timeframe) group by all""", "mean sd skew kurt")
def _(s, d):
    return statistics.moments(tables.trades(s, d), ["strategy", "timeframe"], "pnl_r")


# the normal law as its series, with terms of few digits lost under |z| of 8
CDF = "case when abs({0}) > 8 then case when {0} > 0 then 1 else 0 end else 0.5 + sign({0}) * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: case when {0} = 0 then 0 else exp((2 * k + 1) * ln(abs({0})) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi())) end)) end"
MOMENTS = """
, m0 as (select {0}, count(*) as n, avg(pnl_r) as mean, stddev_samp(pnl_r) as sd from t group by all),
mo as (select m0.*, avg(pow((pnl_r - mean) / sd, 3)) as skew, avg(pow((pnl_r - mean) / sd, 4)) as kurt, mean / sd as sr from m0 join t using ({0}) group by all),
mv as (select *, 1 - skew * sr + (kurt - 1) / 4 * sr * sr as v from mo)
"""


@query("sharpe_odds", TRADES_SQL + MOMENTS.format("strategy, timeframe") + f"""
, z as (select *, sr * sqrt(n - 1) / sqrt(v) as z from mv)
final select strategy, timeframe, n, mean, sd, skew, kurt, sr, {CDF.format('z')} as psr, case when sr > 0 then 1 + v * pow(1.6448536269514722 / sr, 2) end as min_n from z""", "mean sd skew kurt sr psr min_n")
def _(s, d):
    return statistics.sharpe_odds(tables.trades(s, d), ["strategy", "timeframe"], "pnl_r")


# the normal law's quantile by halving an interval
QUANTILE = """
, qq as (with recursive q as (select name, p, -10.0::double as lo, 10.0::double as hi, 0 as step from (select * from at_) union all
  select name, p, case when {0} < p then (lo + hi) / 2 else lo end, case when {0} < p then hi else (lo + hi) / 2 end, step + 1 from q where step < 60) select name, (lo + hi) / 2 as z from q where step = 60)
""".format(CDF.format("((lo + hi) / 2)"))


@query("deflated_sharpe", TRADES_SQL + MOMENTS.format("symbol, strategy, timeframe") + """
, tr as (select count(sr) as trials, var_samp(sr) as vs from mv),
at_ as (select 'a' as name, 1 - 1.0::double / trials as p from tr union all select 'b', 1 - 1 / (trials * exp(1.0)) from tr)""" + QUANTILE + f"""
, fl as (select trials, sqrt(vs) * ((1 - 0.5772156649015329) * (select z from qq where name = 'a') + 0.5772156649015329 * (select z from qq where name = 'b')) as floor from tr),
z as (select mv.*, fl.floor, trials, (sr - fl.floor) * sqrt(n - 1) / sqrt(v) as z from mv cross join fl)
final select symbol, strategy, timeframe, n, mean, sd, skew, kurt, sr, floor, trials, {CDF.format('z')} as dsr from z""", "mean sd skew kurt sr floor dsr")
def _(s, d):
    return statistics.deflated_sharpe(tables.trades(s, d), ["symbol", "strategy", "timeframe"], "pnl_r")


@query("cluster_icc", TRADES_SQL + """
, g as (select entry_time as c, count(*) as n, avg(pnl_r) as m, var_pop(pnl_r) as v from t group by 1),
a as (select count(*) as k, sum(n) as n, sum(n * n) as nn, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) as ssb, sum(n * v) as ssw from g),
b as (select k, cast(n as bigint) as n, ssb / (k - 1) as msb, ssw / (n - k) as msw, (n - nn / n) / (k - 1) as n0 from a),
i as (select k, n, greatest(0, (msb - msw) / (msb + (n0 - 1) * msw)) as icc from b)
final select k, n, icc, 1 + (n / k - 1) * icc as deff, n / (1 + (n / k - 1) * icc) as n_eff from i""", "icc deff n_eff")
def _(s, d):
    return statistics.cluster_icc(tables.trades(s, d), "entry_time", "pnl_r")


@query("correlations", PANEL + "\nfinal select x.symbol as a, y.symbol as b, corr(x.ret, y.ret) as corr, count(*) as n from p x join p y using (date) where x.symbol < y.symbol and x.ret is not null and y.ret is not null group by all", "corr")
def _(s, d):
    return statistics.correlations(books.panel(per_day(s, d)))


@query("bootstrap_mean", TRADES_SQL + """
, g as (select strategy, entry_time as c, sum(pnl_r) as s, count(*) as n from t group by all),
d as (select g.*, four * 4 + j + 1 as draw, substr(md5('7|' || four || '|' || c), 1 + 8 * j, 8) as u from g cross join (select cast(unnest(range(0, 500)) as integer) as four) cross join (select cast(unnest(range(0, 4)) as integer) as j)),
w as (select *, list_sum(list_transform(['5e2d58d4', 'bc5ab1a8', 'eb715e12', 'fb23978a', 'ff1025e8', 'ffd90f51'], lambda x: cast(u >= x as integer))) as w from d),
e as (select strategy, draw, sum(w * s) / nullif(sum(w * n), 0) as m from w group by all),
q as (select strategy, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from e group by all),
o as (select strategy, sum(s) / sum(n) as mean, cast(sum(n) as bigint) as n from g group by all)
final select * from o join q using (strategy)""", "mean lo hi")
def _(s, d):
    return statistics.bootstrap_mean(tables.trades(s, d), ["strategy"], "entry_time", "pnl_r")


@query("backtest_overfitting", TRADES_SQL + """
, sp as (select min(entry_time) as t0, max(entry_time) as t1 from t),
ce as (select symbol || '|' || strategy || '|' || timeframe as trial, cast(floor(least(floor((entry_time - t0) * 56.0::double / greatest(t1 - t0, 1)), 55) * 14 / 56) as integer) as block, sum(pnl_r) as r from t cross join sp group by all),
ch as (select row_number() over (order by m) as choice, m from (select unnest(range(16384)) as m) where bit_count(m) = 7),
x as (select choice, trial, round(coalesce(sum(r) filter ((m >> block) & 1 = 1), 0), 9) as inside, round(coalesce(sum(r) filter ((m >> block) & 1 = 0), 0), 9) as outside from ch cross join ce group by all),
ow as (select choice, outside as own from x qualify row_number() over (partition by choice order by inside desc, trial) = 1),
rk as (select choice, count(*) as n, count(*) filter (outside < own) + 0.5 * (count(*) filter (outside = own) - 1) + 1 as rank from x join ow using (choice) group by choice)
final select max(n) as trials, avg(case when rank / (n + 1) < 0.5 then 1.0 else 0.0 end) as pbo from rk""", "pbo")
def _(s, d):
    return statistics.backtest_overfitting(tables.trades(s, d).withColumn("trial", F.concat_ws("|", "symbol", "strategy", "timeframe")), "trial", "entry_time", "pnl_r")


@query("drawdown_stats", PANEL + """
, w as (select *, exp(sum(ln(1 + ret)) over (partition by symbol order by date rows unbounded preceding)) as wealth, row_number() over (partition by symbol order by date) as k from p where ret is not null),
x as (select *, wealth / greatest(1, max(wealth) over (partition by symbol order by date rows unbounded preceding)) - 1 as dd from w),
y as (select *, coalesce(max(case when dd >= -1e-12 then k end) over (partition by symbol order by date rows unbounded preceding), 0) as dry from x)
final select symbol, count(*) as n, min(dd) as max_drawdown, sqrt(avg(dd * dd)) as ulcer, cast(max(k - dry) as integer) as longest_under_water, avg(cast(dd < -1e-12 as integer)) as share_under_water from y group by symbol""", "max_drawdown ulcer share_under_water")
def _(s, d):
    return statistics.drawdown_stats(books.panel(per_day(s, d)), ["symbol"])


def _adjusted(method: str, sql: str) -> None:
    own = """
, q as (select strategy, timeframe, symbol, exp(-abs(avg(pnl_r) / stddev_samp(pnl_r) * sqrt(count(*)))) as p from t group by all),
o as (select *, row_number() over (order by p) as k, count(*) over () as m from q)
"""

    def run(s, d):
        q = tables.trades(s, d).groupBy("strategy", "timeframe", "symbol").agg(F.exp(-F.abs(F.avg("pnl_r") / F.stddev_samp("pnl_r") * F.sqrt(F.count("*")))).alias("p"))
        return statistics.adjusted_p(q, method=method)

    query(f"adjusted_p_{method}", TRADES_SQL + own + f"\nfinal select strategy, timeframe, symbol, p, least({sql}, 1) as p_adjusted from o", "p p_adjusted")(run)


_adjusted("holm", "max(p * (m - k + 1)) over (order by k)")
_adjusted("bhy", "min(p * m / k * list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / i))) over (order by k desc)")


# streams


@query("stream_bars", "\nfinal select event_type as symbol, epoch_ms(date_trunc('hour', ts)) as open_time, max(value) as high, min(value) as low, count(*) as volume, sum(value) as total from events group by event_type, date_trunc('hour', ts)", "high low total")
def _(s, d):
    return streams.all_bars(s, d, "events.parquet", tables.table(s, d, "events").schema)


@query("stream_fresh_alerts", "\nfinal select event_type as symbol, epoch_ms(date_trunc('day', ts)) as open_time from events group by all")
def _(s, d):
    rows = streams.files(s, d, "events.parquet", tables.table(s, d, "events").schema).select(F.col("event_type").alias("symbol"), F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("open_time"))
    return streams.drain(streams.fresh_alerts(rows, ["symbol"]), "alerts")
