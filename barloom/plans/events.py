"""Registered queries on live confluence, event books and the exchange's calendar."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import resampling
from ..operators import books, calls, cohorts, confluence, detectors, quality, similar
from ..sources import calendar, sync, tables
from ..sources.tables import BARS_SQL, DAILY_SQL
from ..streaming import bars as streams
from ..streaming import catchup
from .queries import ENGULFS, FORECAST, HIGHER, OHLC, PINS, hourly, per_day, query
from .research import ARMS, BOOTSTRAP, BOOTSTRAP_NAMES, GEOMETRIC, SIX

# live confluence: three strategies on one clock, and what their signals were worth on the next bar

THREE = PINS + ENGULFS + """
, ib0 as (select *, greatest(open, close) as t_, least(open, close) as b_ from b),
ib1 as (select *, lag(t_) over w as it, lag(b_) over w as ib, lag(t_, 2) over w as mt, lag(b_, 2) over w as mb from ib0 window w as (partition by symbol order by i)),
sg as (select symbol, timeframe, open_time, i, direction, 'pin_bar' as strategy from sig union all select symbol, timeframe, open_time, i, direction, 'engulfing' from eng
  union all select symbol, timeframe, open_time, i, case when close > mt then 'long' else 'short' end, 'inside_bar' from ib1 where it <= mt and ib >= mb and (close > mt or close < mb)),
wr as (select sg.*, sign(n.close - c.close) * case direction when 'long' then 1.0::double else -1.0 end as r from sg join b c on c.symbol = sg.symbol and c.i = sg.i left join b n on n.symbol = sg.symbol and n.i = sg.i + 1),
wo as (select symbol, timeframe, strategy, avg(r) as avg_r, count(r) as n, count(*) filter (r > 0) as wins from wr group by all),
lk as (select x.symbol, x.timeframe, x.strategy as first, y.strategy as second, (x.avg_r + y.avg_r) / 2 as avg_r, x.n + y.n as closed_trades, (x.wins + y.wins) / (x.n + y.n) as win_rate from wo x join wo y on x.symbol = y.symbol and x.strategy < y.strategy)
"""


def _worth(signals, bars):
    """Of each series' signals of a strategy: right on the next bar less wrong, as a share."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("open_time")
    b = bars.select("symbol", "timeframe", "open_time", F.signum(F.lead("close").over(w) - F.col("close")).alias("move"))
    s = signals.join(b, ["symbol", "timeframe", "open_time"]).withColumn("r", F.when(F.col("direction") == "long", F.col("move")).otherwise(-F.col("move")))
    return s.groupBy("symbol", "timeframe", "strategy").agg(F.avg("r").alias("avg_r"), F.count("r").alias("n"), F.count_if(F.col("r") > 0).alias("wins"))


def _paired(a, b, keys, names):
    a, b = (x.withColumnsRenamed({"strategy": n, "avg_r": f"r_{n}", "n": f"n_{n}", "wins": f"w_{n}"}) for x, n in zip((a, b), names, strict=True))
    both = a.join(b, keys)
    r, n, w = ([F.col(f"{c}_{x}") for x in names] for c in "rnw")
    return both.withColumns({"avg_r": (r[0] + r[1]) / 2, "closed_trades": n[0] + n[1], "win_rate": F.try_divide(w[0] + w[1], n[0] + n[1])})


@query("live_cofire", BARS_SQL + THREE + """
, pp as (select s.symbol, s.timeframe, s.direction, s.open_time, s.strategy, o.strategy as co_strategy, cast(s.i - max(o.i) as integer) as candles_ago from sg s join sg o on o.symbol = s.symbol and o.direction = s.direction and o.strategy <> s.strategy and o.i between s.i - 5 and s.i group by s.symbol, s.timeframe, s.direction, s.open_time, s.strategy, s.i, o.strategy),
pl as (select pp.*, avg_r, closed_trades, win_rate from pp join lk on lk.symbol = pp.symbol and lk.first = least(pp.strategy, co_strategy) and lk.second = greatest(pp.strategy, co_strategy) where (candles_ago > 0 or pp.strategy < co_strategy) and avg_r >= -0.6)
final select * from pl qualify row_number() over (partition by symbol, direction, open_time order by avg_r desc, candles_ago, strategy, co_strategy) = 1""", "avg_r win_rate")
def _(s, d):
    b = hourly(s, d)
    signals = detectors.detect_all(b, ["pin_bar", "engulfing", "inside_bar"])
    worth = _worth(signals, b)
    lookup = _paired(worth, worth, ["symbol", "timeframe"], ("first", "second")).where("first < second")
    return confluence.live_cofire(b, signals, lookup, least=-0.6)


@query("live_cross_cofire", BARS_SQL + THREE + HIGHER + """
, hb as (select *, row_number() over (partition by symbol order by t) as i from hi4),
hw as (select hs.*, sign(n.close - c.close) * case direction when 'long' then 1.0::double else -1.0 end as r from hs join hb c on c.symbol = hs.symbol and c.t = hs.open_time left join hb n on n.symbol = c.symbol and n.i = c.i + 1),
ho as (select symbol, avg(r) as avg_r, count(r) as n, count(*) filter (r > 0) as wins from hw group by symbol),
pc as (select s.symbol, s.timeframe, s.direction, s.open_time, s.strategy, max(hs.open_time) as last_at from sg s join hs on hs.symbol = s.symbol and hs.direction = s.direction and hs.open_time between s.open_time - 43200000 and s.open_time group by all),
pl as (select pc.* exclude (last_at), '4h' as co_timeframe, 'pin_bar' as co_strategy, cast((pc.open_time - last_at) // 3600000 as integer) as candles_ago, (ho.avg_r + wo.avg_r) / 2 as avg_r, ho.n + wo.n as closed_trades, (ho.wins + wo.wins) / (ho.n + wo.n) as win_rate
  from pc join ho on ho.symbol = pc.symbol join wo on wo.symbol = pc.symbol and wo.strategy = pc.strategy where (ho.avg_r + wo.avg_r) / 2 >= -0.6)
final select * from pl qualify row_number() over (partition by symbol, direction, open_time order by avg_r desc, candles_ago, co_timeframe, strategy, co_strategy) = 1""", "avg_r win_rate")
def _(s, d):
    b = hourly(s, d)
    h4 = quality.resample(b)
    low, high = detectors.detect_all(b, ["pin_bar", "engulfing", "inside_bar"]), detectors.detect_all(h4, ["pin_bar"])
    a, c = _worth(high, h4).withColumnRenamed("timeframe", "high"), _worth(low, b).withColumnRenamed("timeframe", "low")
    lookup = _paired(a, c, ["symbol"], ("strategy_high", "strategy_low"))
    return confluence.live_cross(low, high, lookup, 12 * tables.HOUR_MS, tables.HOUR_MS, -0.6)


# insiders: orders stand for filed trades, two days after them, in one of six names

INSIDER = DAILY_SQL + """
, x as (select o_orderkey as id, o_custkey as owner, cast(o_orderdate as date) as date, year(o_orderdate) as y, month(o_orderdate) as m, ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][o_custkey % 6 + 1] as symbol, case o_orderstatus when 'F' then 'P' when 'O' then 'S' else 'M' end as code from orders),
ym as (select distinct owner, y, m from x), ys as (select distinct owner, y from x),
lb as (select *, date + 2 as filed, case when (select count(*) from ym where ym.owner = x.owner and ym.m = x.m and ym.y between x.y - 3 and x.y - 1) = 3 then 'routine' when (select count(*) from ys where ys.owner = x.owner and ys.y between x.y - 3 and x.y - 1) = 3 then 'opportunistic' else 'unclassified' end as label from x),
p0 as (select cast(make_timestamp(open_time * 1000) as date) as date, symbol, close * volume as dollars, close / lag(close) over (partition by symbol order by open_time) - 1 as ret from bars),
pn as (select *, avg(dollars) over w as adv, case when count(ret) over w >= 3 then stddev_samp(ret) over w end as sigma from p0 window w as (partition by symbol order by date rows 19 preceding)),
me as (select date_trunc('month', date)::date as month, max(date) as formed from pn group by 1),
nm as (select distinct label, code, symbol, date_trunc('month', filed)::date as month from lb),
co as (select nm.*, adv / sum(adv) over (partition by label, code, nm.month) as weight from nm join me on me.month = nm.month join pn on pn.date = me.formed and pn.symbol = nm.symbol where adv > 0),
dt as (select distinct date, date_trunc('month', date)::date as month from pn),
dw as (select label, code, dt.date, symbol, sum(weight) / 3 as weight from co join (select unnest([1, 2, 3]) as k) on true join dt on dt.month = (co.month + to_months(k::integer))::date group by all),
lg as (select label, 'long_only' as arm, date, symbol, weight from dw where code = 'P' union all
  select label, 'long_short', date, symbol, sum(case code when 'P' then weight else -weight end) from dw where code in ('P', 'S') group by all)
"""


def _insiders(s, d):
    o = tables.table(s, d, "orders")
    t = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("date"),
        F.element_at(F.array(*map(F.lit, ("AF", "AO", "NF", "NO", "RF", "RO"))), (F.col("o_custkey") % 6 + 1).cast("int")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", "P").when(F.col("o_orderstatus") == "O", "S").otherwise("M").alias("code"),
    )
    return books.insider_classes(t).withColumnRenamed("class", "label").withColumn("filed", F.date_add("date", 2))


def _liquid(s, d):
    b = per_day(s, d)
    return books.panel(b).join(b.select("symbol", F.to_date(F.timestamp_millis("open_time")).alias("date"), (F.col("close") * F.col("volume")).alias("dollars")), ["symbol", "date"])


@query("insider_weights", INSIDER + "\nfinal select * from lg", "weight")
def _(s, d):
    p = cohorts.liquidity(_liquid(s, d))
    return cohorts.legs(cohorts.daily_weights(cohorts.cohort_weights(_insiders(s, d), p), p, 3))


@query("insider_book", INSIDER + """
, ss as (select date, row_number() over (order by date) as i from (select distinct date from pn)),
wi as (select lg.*, i from lg join ss using (date)),
bt as (select label, arm, symbol, i, sum(weight) as weight, sum(before) as before from (select label, arm, symbol, i, weight, 0 as before from wi union all select label, arm, symbol, i + 1, 0, weight from wi) group by all),
bk as (select label, arm, ss.date, weight, weight * coalesce(ret, 0) as gross, greatest(-weight, 0) * 0.01 / 252 as borrow,
  abs(weight - before) * (case when adv >= 5e8 then 1 when adv >= 5e7 then 3 when adv >= 5e6 then 8 else 20 end / 10000.0::double + case when adv > 0 and sigma > 0 then sigma * sqrt(10000 / adv) else 0 end) as cost
  from bt join ss using (i) left join pn on pn.date = ss.date and pn.symbol = bt.symbol)
final select label, arm, date, sum(gross) as gross, sum(cost) as cost, sum(borrow) as borrow, count(*) filter (abs(weight) > 1e-15) as active, sum(gross) - sum(cost) - sum(borrow) as net from bk group by all""", "gross cost borrow net")
def _(s, d):
    return cohorts.insider_book(_insiders(s, d), _liquid(s, d))


@query("insider_paired", INSIDER + """
, ss as (select date, row_number() over (order by date) as i from (select distinct date from pn)),
wi as (select lg.*, i from lg join ss using (date)),
bt as (select label, arm, symbol, i, sum(weight) as weight, sum(before) as before from (select label, arm, symbol, i, weight, 0 as before from wi union all select label, arm, symbol, i + 1, 0, weight from wi) group by all),
bk as (select label, arm, ss.date, weight * coalesce(ret, 0) - greatest(-weight, 0) * 0.01 / 252
  - abs(weight - before) * (case when adv >= 5e8 then 1 when adv >= 5e7 then 3 when adv >= 5e6 then 8 else 20 end / 10000.0::double + case when adv > 0 and sigma > 0 then sigma * sqrt(10000 / adv) else 0 end) as net
  from bt join ss using (i) left join pn on pn.date = ss.date and pn.symbol = bt.symbol),
ib as (select label, arm, date, sum(net) as net from bk group by all),
arms as (select a.arm as arm, a.date as date, a.net - c.net as r from ib a join ib c on a.arm = c.arm and a.date = c.date where a.label = 'opportunistic' and c.label = 'routine')
""" + BOOTSTRAP[len(ARMS):].format(runs=SIX.format("n / block::double"), drawn=GEOMETRIC, draws=10000, total="n", last="case when k = runs - 1 then free else least(free, drawn) end"), BOOTSTRAP_NAMES)
def _(s, d):
    b = cohorts.insider_book(_insiders(s, d), _liquid(s, d)).select("label", "arm", "date", "net")
    both = b.where("label = 'opportunistic'").join(b.where("label = 'routine'").select("arm", "date", F.col("net").alias("other")), ["arm", "date"])
    return resampling.block_bootstrap(both.select("arm", "date", (F.col("net") - F.col("other")).alias("r")), ["arm"], "date", "r")


# earnings: a name's sales of a quarter, announced thirty days after it

SURPRISE = FORECAST + """
, ea as (select l_returnflag || l_linestatus as symbol, year(l_shipdate) as fy, quarter(l_shipdate) as fp, sum(l_extendedprice * (1 - l_discount)) / 1e6 as eps from lineitem group by all),
ec as (select a.symbol, a.fy, a.fp, a.eps - b.eps as change from ea a join ea b on a.symbol = b.symbol and a.fp = b.fp and a.fy = b.fy + 1),
es as (select *, change / case when count(change) over w >= 4 then nullif(stddev_samp(change) over w, 0) end as sue, last_day(make_date(fy, fp * 3, 1)) + 30 as announced from ec window w as (partition by symbol order by fy, fp rows between 8 preceding and 1 preceding)),
ss as (select date, row_number() over (order by date) as i from (select distinct date from p)),
ef as (select es.symbol, min(ss.i) as first, announced, any_value(sue) as sue from es join ss on ss.date > announced where sue is not null {0} group by es.symbol, announced),
ef2 as (select symbol, first, max_by(sue, announced) as sue from ef group by all),
ac as (select p.date, p.symbol, ss.i, (select max(first) from ef2 where ef2.symbol = p.symbol and ef2.first <= ss.i) as first from p join ss using (date)),
au as (select ac.date, ac.symbol, sue from ac join ef2 on ef2.symbol = ac.symbol and ef2.first = ac.first where ac.i < ac.first + 60),
lv as (select fc.date, fc.symbol, fc.ret, sue, sue * 0.2 / (vol * sqrt(252)) as l0 from fc left join au using (date, symbol)),
lw as (select *, {1} as leverage from lv),
lx as (select *, coalesce(leverage, 0) as held, coalesce(lag(coalesce(leverage, 0)) over (partition by symbol order by date), 0) as before from lw)
final select date, symbol, sue, leverage, held * coalesce(ret, 0) - abs(held - before) * 0.0003 as net from lx"""


def _announced(s, d):
    e = tables.table(s, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.year("l_shipdate").alias("fy"), F.quarter("l_shipdate").alias("fp")).agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1e6).alias("eps"))
    return books.seasonal_surprise(e).withColumn("announced", F.date_add(F.last_day(F.make_date("fy", F.col("fp") * 3, F.lit(1))), 30))


def _surprises(long_only):
    def run(s, d):
        return cohorts.surprise_book(_announced(s, d), books.forecasts(books.panel(per_day(s, d))), long_only=long_only)

    return run


query("surprise_book", SURPRISE.format("", "l0 - avg(l0) over (partition by date)"), "sue leverage net")(_surprises(False))
query("surprise_book_long", SURPRISE.format("and sue > 0", "l0"), "sue leverage net")(_surprises(True))


# the exchange's calendar over the days of the orders

CALENDAR = """
with sp as (select min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as z from orders),
dy as (select cast(unnest(generate_series(a, z, interval 1 day)) as date) as date from sp),
d0 as (select date, year(date) as y, month(date) as m, day(date) as dd, isodow(date) as w from dy),
e0 as (select *, y % 19 as g, y // 100 as c, y % 100 as u from d0),
e1 as (select *, (19 * g + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 as h from e0),
e2 as (select *, (32 + 2 * (c % 4) + 2 * (u // 4) - h - u % 4) % 7 as l from e1),
e3 as (select *, h + l - 7 * ((g + 11 * h + 22 * l) // 451) + 114 as n from e2),
hd as (select *, w > 5 or date = make_date(y, n // 31, n % 31 + 1) - 2 or (m = 1 and ((dd = 1) or (dd = 2 and w = 1))) or (m = 1 and w = 1 and dd between 15 and 21 and y >= 1998) or (m = 2 and w = 1 and dd between 15 and 21)
  or (m = 5 and w = 1 and dd >= 25) or (m = 7 and (dd = 4 or (dd = 3 and w = 5) or (dd = 5 and w = 1))) or (m = 9 and w = 1 and dd <= 7) or (m = 11 and w = 4 and dd between 22 and 28) or (m = 12 and (dd = 25 or (dd = 24 and w = 5) or (dd = 26 and w = 1)))
  or (y >= 2022 and m = 6 and (dd = 19 or (dd = 18 and w = 5) or (dd = 20 and w = 1)))
  or date in ('1994-04-27', '2001-09-11', '2001-09-12', '2001-09-13', '2001-09-14', '2004-06-11', '2007-01-02', '2012-10-29', '2012-10-30', '2018-12-05', '2025-01-09') as off from e3),
cl as (select date, y, not off and ((m = 7 and dd = 3 and w < 5 and y >= 1995 and (w <> 3 or y >= 2013)) or (m = 11 and w = 5 and dd between 23 and 29 and y >= 1993) or (m = 12 and dd = 24 and w < 5 and y >= 1993) or date in ('1996-07-05', '2002-07-05')) as early, not off as session from hd),
sm as (select *, case when y >= 2007 then make_date(y, 3, 1) + (7 - isodow(make_date(y, 3, 1)))::integer + 7 else make_date(y, 4, 1) + (7 - isodow(make_date(y, 4, 1)))::integer end as ds,
  case when y >= 2007 then make_date(y, 11, 1) + (7 - isodow(make_date(y, 11, 1)))::integer else make_date(y, 10, 31) - (isodow(make_date(y, 10, 31)) % 7)::integer end as de from cl),
ca as (select date, early, session, epoch_ms(date::timestamp) + (case when date >= ds and date < de then 4 else 5 end) * 3600000 as midnight from sm)
"""


@query("exchange_sessions", CALENDAR + """
, n as (select cast(o_orderdate as date) as date, count(*) as n_orders from orders group by 1)
final select ca.date, midnight + 34200000 as open_ms, midnight + case when early then 46800000 else 57600000 end as close_ms, early, coalesce(n_orders, 0) as n_orders from ca left join n using (date) where session""")
def _(s, d):
    o = tables.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    b = calendar.bounds(o.agg(F.min("date").alias("first"), F.max("date").alias("last")))
    return b.join(o.groupBy("date").agg(F.count("*").alias("n_orders")), "date", "left").fillna(0, ["n_orders"])


@query("sessions_elapsed", CALENDAR + """
, nw as (select o_custkey as customer, max(cast(o_orderdate as date)) as newest from orders group by 1)
final select customer, newest, z as now, cast(case when z > newest then greatest(0, (select count(*) from ca where session and date between newest and z) - 1) else 0 end as integer) as sessions_elapsed from nw cross join sp""")
def _(s, d):
    o = tables.table(s, d, "orders").select(F.col("o_custkey").alias("customer"), F.to_date("o_orderdate").alias("date"))
    now = o.agg(F.max("date").alias("now"))
    newest = o.groupBy("customer").agg(F.max("date").alias("newest")).crossJoin(F.broadcast(now))  # one row
    return calendar.elapsed(newest, "now", "newest")


@query("missing_sessions", CALENDAR + DAILY_SQL.replace("with bars", ", bars") + """
, hv as (select distinct symbol, cast(make_timestamp(open_time * 1000) as date) as date from bars), sx as (select symbol, min(date) as a, max(date) as z from hv group by symbol)
final select sx.symbol, ca.date from sx join ca on ca.date between sx.a and sx.z and session anti join hv on hv.symbol = sx.symbol and hv.date = ca.date""")
def _(s, d):
    h = per_day(s, d).select("symbol", F.to_date(F.timestamp_millis("open_time")).alias("date")).distinct()
    o = tables.table(s, d, "orders").select(F.to_date("o_orderdate").alias("date"))
    spans = h.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("z")).withColumn("date", F.explode(F.expr("sequence(a, z)")))
    open_ = calendar.days(o.agg(F.min("date").alias("first"), F.max("date").alias("last"))).where("session").select("date")
    return spans.join(open_, "date").select("symbol", "date").join(h, ["symbol", "date"], "left_anti")


# closed bars as a stream, five days a batch: what is replayed, how, and the pin bars among it


@query("stream_catch_up", BARS_SQL + PINS + """
, ch as (select *, open_time // 432000000 as chunk, max(open_time) over (partition by symbol, open_time // 432000000) as latest, min(open_time // 432000000) over (partition by symbol) as cold from b)
final select ch.symbol, ch.timeframe, ch.open_time, case when ch.open_time = latest or latest - ch.open_time <= 86400000 then 'alert' else 'backfill' end as status, cast(least(200, ch.i) as integer) as n_context, sig.direction
from ch left join sig on sig.symbol = ch.symbol and sig.i = ch.i where chunk > cold or ch.open_time = latest""")
def _(s, d):
    path = streams.folder(s, "hourly")
    b = hourly(s, d).withColumn("chunk", F.expr("open_time div 432000000"))
    catchup.in_batches(b.withColumn("seen_ms", F.col("open_time") + tables.HOUR_MS), "chunk", path)
    rows = s.readStream.schema(s.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    x = catchup.last_bar(streams.drain(catchup.catch_up(rows, max_age_hours=24.0), "replayed"))
    body, up, down = F.abs(F.col("close") - F.col("open")), F.col("high") - F.greatest("open", "close"), F.least("open", "close") - F.col("low")
    direction = F.when((body != 0) & (down >= 2 * body) & (up <= body), "long").when((body != 0) & (up >= 2 * body) & (down <= body), "short")
    return x.select("symbol", "timeframe", "open_time", "status", "n_context", direction.alias("direction"))


# entries that already say what a claim says: documents for the benchmark's items

SETS = r"""
, {0}1 as (select id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)https?://\S+', ' ', 'g'), '\d{{4}}-\d{{2}}-\d{{2}}', ' ', 'g'), '(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:\d{{1,2}}(?:st|nd|rd|th)?,?\s+)?\d{{4}}\b', ' ', 'g'), '\d+(?:\.\d+)?\s*%', ' ', 'g') as t,
  lower(regexp_replace(coalesce(text, ''), '(?i)https?://\S+', ' ', 'g')) as u from {1}),
{0} as (select id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '\d[\d,]*(?:\.\d+)?(?:\s*[kK])?'), lambda x: case when x[-1] in ('k', 'K') then try_cast(regexp_replace(x, '[,\s]|[kK]', '', 'g') as double) * 1000
    when regexp_matches(x, '[,.]') or try_cast(x as double) not between 1900 and 2099 then try_cast(regexp_replace(x, ',', '', 'g') as double) end), lambda v: v >= 100))) as lv,
  list_filter(list_distinct(regexp_extract_all(u, '[a-z]{{4,}}')), lambda w: not list_contains(['also', 'been', 'from', 'have', 'into', 'here', 'just', 'more', 'much', 'only', 'over', 'same', 'such', 'than', 'that', 'them', 'then', 'they', 'this', 'very', 'were', 'what', 'when', 'which', 'will', 'with', 'your'], w)) as tm from {0}1)
"""


@query("similar_entries", "with e0 as (select 1)" + SETS.format("ca", "(select item_id as id, text from benchmark)") + SETS.format("en", "(select doc_id as id, text from documents)") + """
, pr as (select ca.id as claim_id, en.id as entry_id, len(list_intersect(ca.lv, en.lv)) as n_levels, len(list_intersect(ca.tm, en.tm)) as n_terms, greatest(least(len(ca.tm), len(en.tm)), 8) as n from ca cross join en),
sc as (select *, 3.0::double * n_levels + 10.0::double * n_terms / n as s from pr)
final select claim_id, entry_id, cast(row_number() over (partition by claim_id order by s desc, entry_id) as integer) as rank, round(s, 3) as score, cast(n_levels as integer) as n_levels, cast(n_terms as integer) as n_terms from sc where s >= 3 qualify rank <= 3""", "score")
def _(s, d):
    claims = tables.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return similar.find_similar(claims, tables.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"))


# calls on pin bars, some at a level and some at the market, some without a stop or a target

CALLS = BARS_SQL + PINS + """
, nw as (select max(open_time) - 172800000 as now from b),
cl as (select sig.symbol, sig.timeframe, sig.direction, sig.open_time + 5400000 as call_ms, cast(b.i as integer) as n, case b.i % 3 when 0 then null when 1 then b.close * case sig.direction when 'long' then 0.9::double else 1.1::double end else b.close end as entry,
  case when b.i % 5 > 0 then b.close * case sig.direction when 'long' then 0.5::double else 1.5::double end end as stop, case when b.i % 7 > 0 then b.close * case sig.direction when 'long' then 1.6::double else 0.4::double end end as target, case when b.i % 2 = 0 then 86400000 else 432000000 end as window_ms
  from sig join b on b.symbol = sig.symbol and b.i = sig.i),
bb as (select b.*, lag(close) over (partition by symbol order by i) as prev, case when lag(close) over (partition by symbol order by i) is not null then greatest(high - low, abs(high - lag(close) over (partition by symbol order by i)), abs(low - lag(close) over (partition by symbol order by i))) end as tr from b, nw where open_time <= now),
ba as (select *, avg(tr) over (partition by symbol order by i rows 13 preceding) as atr from bb),
de as (select symbol, max(open_time) + 3600000 as data_end from ba group by symbol),
f0 as (select cl.*, now, data_end, (select count(*) from ba where ba.symbol = cl.symbol and open_time + 3600000 <= call_ms) as refs,
  (select min(ba.i) from ba where ba.symbol = cl.symbol and open_time >= call_ms and open_time <= least(call_ms + window_ms, now) and (entry is null or (low <= entry and entry <= high) or (prev < entry and entry < ba.open) or (ba.open < entry and entry < prev))) as fi from cl cross join nw left join de on de.symbol = cl.symbol),
f1 as (select f0.*, f.open_time as fill_ms, case when entry is null or not (f.low <= entry and entry <= f.high) then f.open else entry end as fill, f.high as fh, f.low as fl, case direction when 'long' then 1.0::double else -1.0::double end as sg from f0 left join ba f on f.symbol = f0.symbol and f.i = f0.fi),
f2 as (select f1.*, coalesce((stop - fill) * sg < 0, true) and coalesce((target - fill) * sg > 0, true) and coalesce((target - stop) * sg > 0, true) as sane,
  (select min(ba.i) from ba where ba.symbol = f1.symbol and ba.i >= fi and open_time <= least(fill_ms + window_ms, now) and case direction when 'long' then coalesce(low <= stop, false) or coalesce(high >= target, false) else coalesce(high >= stop, false) or coalesce(low <= target, false) end) as ei from f1),
f3 as (select f2.*, e.open_time as e_ms, case when e.i = fi then fill else e.open end as eo, e.high as eh, e.low as el, (select max(ba.i) from ba where ba.symbol = f2.symbol and open_time <= fill_ms + window_ms) as li from f2 left join ba e on e.symbol = f2.symbol and e.i = ei),
f4 as (select f3.*, l.close as last, l.open_time as last_ms, case when e_ms is null then null when coalesce((eo - stop) * sg <= 0, false) then 'LOSS' when coalesce((eo - target) * sg >= 0, false) then 'WIN' when coalesce(case direction when 'long' then el <= stop else eh >= stop end, false) then 'LOSS' else 'WIN' end as es,
  case when coalesce((eo - stop) * sg <= 0, false) or coalesce((eo - target) * sg >= 0, false) then eo when coalesce(case direction when 'long' then el <= stop else eh >= stop end, false) then stop else target end as ep from f3 left join ba l on l.symbol = f3.symbol and l.i = li),
f5 as (select *, case when refs = 0 then 'UNRESOLVABLE' when fill_ms is null then case when call_ms + window_ms <= now and data_end >= call_ms + window_ms then 'NOT_TRIGGERED' when data_end < least(call_ms + window_ms, now) then 'STALE' else 'OPEN' end
  when not sane then 'UNSCORED' when es is not null then es when fill_ms + window_ms <= now and data_end >= fill_ms + window_ms then case when (last - fill) * sg > 0 then 'WIN' else 'LOSS' end when data_end < least(fill_ms + window_ms, now) then 'STALE' else 'OPEN' end as state from f4),
f6 as (select f5.* exclude (fill, fill_ms), case when state <> 'UNRESOLVABLE' then fill_ms end as fill_ms, case when state <> 'UNRESOLVABLE' and fill_ms is not null then fill end as fill, case when state in ('WIN', 'LOSS') then case when es is not null then ep else last end end as exit, case when state in ('WIN', 'LOSS') then case when es is not null then e_ms else last_ms end end as exit_ms from f5),
sd as (select f6.symbol, f6.timeframe, direction, call_ms, n, entry, stop, target, window_ms, state, fill_ms, fill, exit_ms, exit, (exit - fill) * sg / nullif(abs(fill - stop), 0) as r, (exit - fill) * sg / nullif((select atr from ba where ba.symbol = f6.symbol and ba.open_time + 3600000 <= fill_ms order by open_time desc limit 1), 0) as atr_r from f6)
"""


def _scored(s, d):
    b = hourly(s, d)
    numbered = b.withColumn("n", F.row_number().over(Window.partitionBy("symbol", "timeframe").orderBy("open_time"))).select("symbol", "timeframe", "open_time", "close", "n")
    x = detectors.pin_bar(b).select("symbol", "timeframe", "open_time", "direction").join(numbered, ["symbol", "timeframe", "open_time"])
    side = lambda long, short: F.col("close") * F.when(F.col("direction") == "long", long).otherwise(short)
    x = x.select(
        "symbol", "timeframe", "direction", (F.col("open_time") + 5_400_000).alias("call_ms"), "n",
        F.when(F.col("n") % 3 == 1, side(0.9, 1.1)).when(F.col("n") % 3 == 2, F.col("close")).alias("entry"),
        F.when(F.col("n") % 5 > 0, side(0.5, 1.5)).alias("stop"), F.when(F.col("n") % 7 > 0, side(1.6, 0.4)).alias("target"),
        F.when(F.col("n") % 2 == 0, 86_400_000).otherwise(432_000_000).cast("long").alias("window_ms"),
    )
    now = b.agg(F.max("open_time")).first()[0] or 0
    return calls.score_calls(x, b, now - 172_800_000)


@query("scored_calls", CALLS + "\nfinal select * from sd", "entry stop target fill exit r atr_r")
def _(s, d):
    return _scored(s, d)


@query("call_cells", CALLS + """
final select symbol, direction, count(*) as n, count(fill) as triggered, count(*) filter (state = 'OPEN') as open, count(*) filter (state in ('WIN', 'LOSS')) as resolved, count(*) filter (state = 'WIN') as wins, avg(r) filter (state in ('WIN', 'LOSS')) as avg_r, avg(atr_r) filter (state in ('WIN', 'LOSS')) as avg_atr_r,
  count(*) filter (state = 'WIN') / nullif(count(*) filter (state in ('WIN', 'LOSS')), 0) as hit_rate, count(r) filter (state in ('WIN', 'LOSS')) / nullif(count(*) filter (state in ('WIN', 'LOSS')), 0) as r_coverage from sd group by all""", "avg_r avg_atr_r hit_rate r_coverage")
def _(s, d):
    return calls.call_cells(_scored(s, d), ["symbol", "direction"])


# three pages of bars; the second finds one series on another basis, as after a split


@query("restated_sync", BARS_SQL + """
final select symbol, timeframe, open_time, open * m as open, high * m as high, low * m as low, close * m as close, volume from (select *, case when symbol = 'click' then 0.5::double else 1.0::double end as m from bars)""", OHLC)
def _(s, d):
    b = hourly(s, d)
    half = F.when(F.col("symbol") == "click", 0.5).otherwise(1.0)
    split = b.withColumns({c: F.col(c) * half for c in ("open", "high", "low", "close")})
    first, last = b.agg(F.min("open_time"), F.max("open_time")).first()
    ends = [first + (last - first) * k // 3 for k in (1, 2, 3)]
    path = streams.folder(s, "synced")
    forming = b.where(F.col("open_time") <= ends[0])
    newest = F.max("open_time").over(Window.partitionBy("symbol", "timeframe"))  # the newest bar has not closed yet when fetched
    forming = forming.withColumn("close", F.when(F.col("open_time") == newest, F.col("close") * 1.001).otherwise(F.col("close")))
    sync.sync(s, path, forming.limit(0), b, 0)
    done = sync.sync(s, path, forming, b, 1)
    for k in (1, 2, 2):  # the last page is tried again
        at = sync.newest(sync.stored(s, path, k + 1)).select("symbol", "timeframe", "latest")
        page = split.join(at, ["symbol", "timeframe"]).where((F.col("open_time") >= F.col("latest")) & (F.col("open_time") <= ends[k])).drop("latest")
        done = sync.sync(s, path, page, split, k + 1)
    return done
