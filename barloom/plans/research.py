"""Registered queries on resampling, gates and candle warnings."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import indicators, resampling, statistics
from ..operators import books, candles, magnets, overlay, quality, replays, simulate
from ..sources import tables
from ..sources.tables import BARS_SQL, DAILY_SQL, TRADES_SQL
from .queries import CDF, FORECAST, H4, MOMENTS, PANEL, PINS, QUANTILE, REGIME, RESIDUAL, SIMULATED, SWEEP, _pins, hourly, per_day, query

# resampling of serially dependent returns: a book of all symbols and one of each line status

ARMS = PANEL + """
, arms as (select 'all' as arm, date, avg(ret) as r from p where ret is not null group by date union all select substr(symbol, 2), date, avg(ret) from p where ret is not null group by all)
"""


def _arms(s, d):
    p = books.panel(per_day(s, d)).where("ret is not null")
    return p.withColumn("arm", F.explode(F.array(F.lit("all"), F.substring("symbol", 2, 1)))).groupBy("arm", "date").agg(F.avg("ret").alias("r"))


# runs of a draw: a random first day, and how many days, of which the last run takes what is left
RUNS = """
, r0 as (select *, cast(floor(cast('0x' || substr(h, 1, 8) as bigint) / 4294967296.0::double * n) as bigint) as start, {drawn} as drawn
  from (select *, md5('7|' || n || '|' || d || '|' || k) as h from (select *, unnest(range(runs)) as k from (select *, unnest(range({draws})) as d from kk)))),
r1 as (select *, {total} - coalesce(sum(drawn) over (partition by arm, d order by k rows between unbounded preceding and 1 preceding), 0) as free from r0),
rn as (select arm, n, d, k, start, cast({last} as bigint) as m from r1 where free > 0)
"""
GEOMETRIC = "case when block <= 1 then 1 else 1 + cast(floor(ln(1 - cast('0x' || substr(h, 9, 8) as bigint) / 4294967296.0::double) / ln(1 - 1.0::double / block)) as bigint) end"
BOOTSTRAP = ARMS + """
, sr as (select arm, row_number() over w as i, sum(r) over w as a, sum(r * r) over w as b from arms window w as (partition by arm order by date rows unbounded preceding)),
px as (select * from sr union all select distinct arm, 0, 0, 0 from sr),
kn as (select arm, count(*) as n, max_by(a, i) as ta, max_by(b, i) as tb, cast(greatest(1, least(round(pow(count(*), 1.0::double / 3)), count(*) - 1)) as bigint) as block from sr group by arm),
kk as (select *, {runs} as runs from kn where n >= 2)""" + RUNS + """
, sm as (select rn.arm, rn.n, d, sum(case when start + m <= rn.n then e.a else ta + e.a end - f.a) as a, sum(case when start + m <= rn.n then e.b else tb + e.b end - f.b) as b
  from rn join kk using (arm) join px f on f.arm = rn.arm and f.i = start join px e on e.arm = rn.arm and e.i = case when start + m <= rn.n then start + m else start + m - rn.n end group by all),
dr as (select arm, a / n as mean, sqrt(greatest(0, (b - a * a / n) / (n - 1))) as sd from sm),
ends as (select arm, quantile_cont(mean, 0.025) as mean_lo, quantile_cont(mean, 0.975) as mean_hi, quantile_cont(sh, 0.025) as sharpe_lo, quantile_cont(sh, 0.975) as sharpe_hi, count(sh) as n_valid
  from (select *, case when sd > 1e-12 then mean / sd * sqrt(252) end as sh from dr) group by arm)
final select arm, cast(n as integer) as n, cast(block as integer) as block, ta / n as mean, mean_lo, mean_hi, case when tb - ta * ta / n > 1e-20 then ta / n / sqrt((tb - ta * ta / n) / (n - 1)) * sqrt(252) end as sharpe, sharpe_lo, sharpe_hi, n_valid from kk join ends using (arm)"""
SIX = "cast(ceil({0} + 6 * sqrt({0})) as bigint) + 10"
BOOTSTRAP_NAMES = "mean mean_lo mean_hi sharpe sharpe_lo sharpe_hi"


@query("block_bootstrap", BOOTSTRAP.format(runs=SIX.format("n / block::double"), drawn=GEOMETRIC, draws=10000, total="n", last="case when k = runs - 1 then free else least(free, drawn) end"), BOOTSTRAP_NAMES)
def _(s, d):
    return resampling.block_bootstrap(_arms(s, d), ["arm"], "date", "r")


@query("block_bootstrap_circular", BOOTSTRAP.format(runs="cast(ceil(n / block::double) as bigint)", drawn="block", draws=10000, total="n", last="least(free, drawn)"), BOOTSTRAP_NAMES)
def _(s, d):
    return resampling.block_bootstrap(_arms(s, d), ["arm"], "date", "r", method="circular")


@query("drawdown_breach_curve", ARMS + """
, sr as (select arm, row_number() over (partition by arm order by date) - 1 as i, r from arms),
kk as (select arm, count(*) as n, least(252, count(*) - 1) as block, """ + SIX.format("(252 / least(252, count(*) - 1)::double)") + """ as runs from sr group by arm having count(*) >= 2)""" + RUNS.format(drawn=GEOMETRIC, draws=5000, total="252", last="case when k = runs - 1 then free else least(free, drawn) end") + """
, dy as (select arm, n, d, k, start, unnest(range(m)) as j from rn),
we as (select dy.arm, d, k, j, exp(sum(ln(1 + r)) over (partition by dy.arm, d order by k, j rows unbounded preceding)) as wealth from dy join sr on sr.arm = dy.arm and sr.i = (start + j) % n),
pk as (select arm, d, wealth / greatest(1, max(wealth) over (partition by arm, d order by k, j rows unbounded preceding)) - 1 as dd from we),
wo as (select arm, d, min(dd) as worst from pk group by all)
final select arm, depth, avg(cast(worst <= -depth as integer)) as odds from wo cross join (select unnest([0.1, 0.25, 0.5])::double as depth) group by all""", "odds")
def _(s, d):
    return resampling.breach_curve(_arms(s, d), ["arm"], "date", "r")


# the Sharpe ratio that a gate demands of each cell

MET = "((1 - skew * {0} + (kurt - 1) / 4 * {0} * {0}) <= 0 or ({0} - floor) * sqrt(n - 1) >= 1.6448536269514722 * sqrt(greatest(1 - skew * {0} + (kurt - 1) / 4 * {0} * {0}, 0)))"


@query("required_sharpe", TRADES_SQL + MOMENTS.format("symbol, strategy, timeframe") + """
, tr as (select count(sr) as trials, var_samp(sr) as vs from mv),
at_ as (select 'a' as name, 1 - 1.0::double / trials as p from tr union all select 'b', 1 - 1 / (trials * exp(1.0)) from tr)""" + QUANTILE + f"""
, fl as (select sqrt(vs) * ((1 - 0.5772156649015329) * (select z from qq where name = 'a') + 0.5772156649015329 * (select z from qq where name = 'b')) as floor from tr),
bs as (select mv.*, floor from mv cross join fl),
wd as (select *, list_reduce(list_transform(range(22), lambda i: struct_pack(lo := 0.0::double, hi := 1.0::double)), lambda s, i: case when {MET.format('s.hi')} then s else struct_pack(lo := s.hi, hi := s.hi * 2) end) as w from bs),
rq as (select *, case when {MET.format('w.hi')} then list_reduce(list_transform(range(101), lambda i: w), lambda s, i: case when {MET.format('((s.lo + s.hi) / 2)')} then struct_pack(lo := s.lo, hi := (s.lo + s.hi) / 2) else struct_pack(lo := (s.lo + s.hi) / 2, hi := s.hi) end).hi end as required from wd)
final select symbol, strategy, timeframe, n, sr, floor as benchmark, required, coalesce(sr >= required, false) as reached from rq""", "sr benchmark required")
def _(s, d):
    t = statistics.deflated_sharpe(tables.trades(s, d), ["symbol", "strategy", "timeframe"], "pnl_r").withColumnRenamed("floor", "benchmark")
    return resampling.required_sharpe(t).select("symbol", "strategy", "timeframe", "n", "sr", "benchmark", "required", F.coalesce(F.col("sr") >= F.col("required"), F.lit(False)).alias("reached"))


@query("effective_observations", PANEL + """
, co as (select corr(x.ret, y.ret) as corr from p x join p y using (date) where x.symbol < y.symbol and x.ret is not null and y.ret is not null group by x.symbol, y.symbol),
k as (select count(distinct symbol) as k, count(*) as n from p where ret is not null),
ke as (select *, greatest(1, least(k, k / (1 + (k - 1) * greatest((select avg(corr) from co), 0)))) as k_eff from k)
final select n, k, k_eff, cast(greatest(2, floor(n * k_eff / k)) as bigint) as n_eff from ke""", "k_eff")
def _(s, d):
    p = books.panel(per_day(s, d))
    n = p.where("ret is not null").agg(F.count("*").alias("n"))
    x = statistics.independent_series(p).crossJoin(F.broadcast(n))  # one row each
    return x.select("n", "k", "k_eff", resampling.effective_n(F.col("n"), F.col("k"), F.col("k_eff")).alias("n_eff"))


# cells of a gate: what it would suppress against what it keeps

WEIGHT = "list_sum(list_transform(['5e2d58d4', 'bc5ab1a8', 'eb715e12', 'fb23978a', 'ff1025e8', 'ffd90f51'], lambda x: cast(u >= x as integer)))"
# rows: cl(cell columns {0}, out, day, r)
AUDIT = """
, ce as (select {0}, count(*) filter (out) as n_supp, count(*) filter (not out) as n_kept, avg(r) filter (out) as supp_avg, avg(r) filter (not out) as kept_avg, stddev_samp(r) filter (out) as sd from cl where r is not null group by all),
te as (select * from ce where n_supp >= 30),
dg as (select {0}, day, count(*) as n, avg(r) as m, sum(r) as s, var_pop(r) as v from cl semi join te using ({0}) where out and r is not null group by all),
ds as (select {0}, count(*) as n_clusters, sum(n) as n, sum(n * n) as nn, sum(n * m) as nm, sum(n * m * m) as nmm, sum(n * v) as ssw from dg group by all),
di as (select *, (nmm - nm * nm / n) / nullif(n_clusters - 1, 0) as msb, coalesce(ssw / nullif(n - n_clusters, 0), 0) as msw, (n - nn / n) / nullif(n_clusters - 1, 0) as n0 from ds),
dj as (select *, case when n_clusters = 1 then 1.0 when n_clusters = n or msb + (n0 - 1) * msw <= 0 then 0.0 else least(1, greatest(0, (msb - msw) / (msb + (n0 - 1) * msw))) end as icc from di),
dk as (select *, greatest(1, 1 + (n / n_clusters - 1) * icc) as deff from dj),
dp as (select te.*, n_clusters, deff, case when sd > 0 then abs(supp_avg) / sd when supp_avg = 0 then 0 else 1e9 end * sqrt(greatest(2, round_even(least(n, greatest(1, n / deff)), 0))) as z from te join dk using ({0})),
dq as (select *, 2 * (1 - {1}) as p, count(*) over () as n_tests from dp),
dr as (select *, least(1, max(p * (n_tests - k + 1)) over (order by k)) as p_adjusted from (select *, row_number() over (order by p) as k from dq)),
du as (select dg.*, four * 4 + j + 1 as draw, substr(md5('7|' || four || '|' || day), 1 + 8 * j, 8) as u from dg cross join (select cast(unnest(range(0, {2})) as integer) as four) cross join (select cast(unnest(range(0, 4)) as integer) as j)),
dw as (select *, {3} as w from du),
dm as (select {0}, draw, sum(w * s) / nullif(sum(w * n), 0) as m from dw group by all),
de as (select {0}, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from dm group by all),
av as (select ce.* exclude (sd), n_clusters, deff, p, n_tests, p_adjusted, case when n_clusters > 1 then lo end as lo, case when n_clusters > 1 then hi end as hi from ce left join dr using ({0}) left join de using ({0})),
ad as (select *, coalesce(lo > -0.05 and hi < 0.05, false) as powered_null, case when p_adjusted < 0.05 and hi <= -0.05 then 'ENABLE' when p_adjusted < 0.05 and lo >= 0.05 then case when kept_avg >= supp_avg + 0.05 then 'CONCENTRATE' else 'DISABLE' end else 'INSUFFICIENT' end as decision from av)
"""
CDF_Z = "case when z > 8 then 1 else 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: case when z = 0 then 0 else exp((2 * k + 1) * ln(z) - (k + 1) * ln(2.0) - lgamma(k + 1.5) + 0.5 * ln(pi())) end)) end"
AUDIT_NAMES = "supp_avg kept_avg deff p p_adjusted lo hi"


@query("audit_cells", TRADES_SQL + ", cl as (select strategy, timeframe, volume_suppress as out, entry_time // 86400000 as day, pnl_r as r from t)" + AUDIT.format("strategy, timeframe", CDF_Z, 500, WEIGHT) + "\nfinal select * from ad", AUDIT_NAMES)
def _(s, d):
    t = tables.trades(s, d).withColumn("day", F.expr(f"entry_time div {tables.DAY_MS}"))
    return resampling.audit_cells(t, ["strategy", "timeframe"], "volume_suppress", "day", "pnl_r")


# candle warnings

FLAGS = """
, cw0 as (select *, abs(close - open) as bd, high - low as sz, high - greatest(open, close) as uw, least(open, close) - low as lw, lag(high) over s as ph, lag(low) over s as pl, list(low) over t as lows, list(high) over t as highs,
  sum(cast(close > open as integer)) over u as nu, sum(cast(close < open as integer)) over u as nd from b window s as (partition by symbol order by i), t as (partition by symbol order by i rows between 10 preceding and 1 preceding), u as (partition by symbol order by i rows 2 preceding)),
cw1 as (select *, sz <> 0 and bd <= 0.1 * sz as doji, bd <> 0 and uw <= 0.1 * bd and lw <= 0.1 * bd as maru, high <= ph and low >= pl as inside, list_sort(list_filter(lows, lambda x: x < close)) as va, list_sort(list_filter(highs, lambda x: x > close)) as vb from cw0 where ph is not null),
cw2 as (select symbol, timeframe, open_time, 'long' as direction, doji, maru, inside, va as v, close, sz <> 0 and uw > 0.4 * sz as wick, nu = 3 as run from cw1
  union all select symbol, timeframe, open_time, 'short', doji, maru, inside, vb, close, sz <> 0 and lw > 0.4 * sz, nd = 3 from cw1),
cw as (select symbol, timeframe, open_time, direction, not doji and maru as w1_marubozu, len(v) >= 2 and coalesce(list_bool_or(list_transform(range(1, len(v)), lambda j: v[j + 1] - v[j] <= close * 0.0015::double)), false) as w2_equal_levels,
  not doji and wick as w5_wick_rejection, run as w6_consecutive, doji as w7_doji, inside as w8_inside_bar from cw2)
"""


@query("candle_warnings", BARS_SQL + FLAGS + "\nfinal select * from cw")
def _(s, d):
    return candles.candle_warnings(hourly(s, d))


@query("warning_cells", BARS_SQL + SIMULATED + FLAGS + """
, tg as (select tr.symbol || '|' || signal_time || '|' || tr.direction as id, tr.direction, signal_time // 86400000 as day, pnl_r as r, cw.* exclude (symbol, timeframe, open_time, direction) from trades tr join cw on cw.symbol = tr.symbol and cw.open_time = signal_time and cw.direction = tr.direction where pnl_r is not null),
cl as (select id, direction, day, r, unnest(['w1_marubozu', 'w2_equal_levels', 'w5_wick_rejection', 'w6_consecutive', 'w7_doji', 'w8_inside_bar']) as warning, unnest([w1_marubozu, w2_equal_levels, w5_wick_rejection, w6_consecutive, w7_doji, w8_inside_bar]) as out from tg)""" + AUDIT.format("warning, direction", CDF_Z, 2500, WEIGHT) + """
, lh as (select id, four * 4 + j + 1 as draw, substr(md5('7|' || four || '|' || id), 1 + 8 * j, 8) as u from (select distinct id from cl) cross join (select cast(unnest(range(0, 2500)) as integer) as four) cross join (select cast(unnest(range(0, 4)) as integer) as j)),
lw as (select id, draw, """ + WEIGHT + """ as w from lh),
ld as (select warning, direction, draw, sum(w * r) filter (out) / nullif(sum(w) filter (out), 0) - sum(w * r) filter (not out) / nullif(sum(w) filter (not out), 0) as x from cl join lw using (id) group by all),
le as (select warning, direction, quantile_cont(x, 0.025) as lift_lo, quantile_cont(x, 0.975) as lift_hi from ld group by all)
final select ad.*, case decision when 'ENABLE' then 'SUPPRESS-CANDIDATE' when 'DISABLE' then 'REVERSE' when 'CONCENTRATE' then 'COSMETIC' else case when powered_null then 'COSMETIC' else 'INSUFFICIENT' end end as verdict,
  case when n_supp >= 2 and n_kept >= 2 then supp_avg - kept_avg end as lift, case when n_supp >= 2 and n_kept >= 2 then lift_lo end as lift_lo, case when n_supp >= 2 and n_kept >= 2 then lift_hi end as lift_hi from ad left join le using (warning, direction)""", AUDIT_NAMES + " lift lift_lo lift_hi")
def _(s, d):
    t = simulate.simulate(hourly(s, d), _pins(s, d)).withColumn("id", F.concat_ws("|", "symbol", "signal_time", "direction"))
    return candles.warning_cells(t, hourly(s, d), "id")


# verdicts on the cells of a sweep, and on strategies by the gates of a book and of a sleeve

PBO = """
, sp as (select min({t}) as t0, max({t}) as t1 from {0}),
ce as (select trial, cast(floor(least(floor(({t} - t0) * {1}.0::double / greatest(t1 - t0, 1)), {1} - 1) * 14 / {1}) as integer) as block, sum({v}) as r from {0} cross join sp group by all),
ch as (select row_number() over (order by m) as choice, m from (select unnest(range(16384)) as m) where bit_count(m) = 7),
xx as (select choice, trial, round(coalesce(sum(r) filter ((m >> block) & 1 = 1), 0), 9) as inside, round(coalesce(sum(r) filter ((m >> block) & 1 = 0), 0), 9) as outside from ch cross join ce group by all),
ow as (select choice, outside as own from xx qualify row_number() over (partition by choice order by inside desc, trial) = 1),
rk as (select choice, count(*) as n, count(*) filter (outside < own) + 0.5 * (count(*) filter (outside = own) - 1) + 1 as rank from xx join ow using (choice) group by choice),
pb as (select avg(case when rank / (n + 1) < 0.5 then 1.0 else 0.0 end) as pbo from rk)
"""


@query("sweep_verdicts", BARS_SQL + SWEEP.partition("\nfinal ")[0] + """
, pt as (select symbol || '|' || tp_r || '|' || sl_pct as trial, entry_time, r as v from tr)""" + PBO.format("pt", 28, t="entry_time", v="v") + """
, mm as (select trial, count(*) as n, case when stddev_samp(v) > 0 then avg(v) / stddev_samp(v) else 0 end as sharpe from pt group by trial),
tt as (select count(*) as trials, var_samp(sharpe) as vs from mm),
at_ as (select 'a' as name, 1 - 1.0::double / trials as p from tt union all select 'b', 1 - 1 / (trials * exp(1.0)) from tt)""" + QUANTILE + f"""
, fl as (select trials, sqrt(vs) * ((1 - 0.5772156649015329) * (select z from qq where name = 'a') + 0.5772156649015329 * (select z from qq where name = 'b')) as floor from tt),
zz as (select mm.*, trials, n >= 28 as ok, (sharpe - floor) * sqrt(n - 1) / sqrt(1 + 0.5 * sharpe * sharpe) as z from mm cross join fl),
gg as (select trial, n, trials, sharpe, case when ok then {CDF.format('z')} end as dsr, case when ok then pbo end as pbo, case when ok and sharpe > 0 then 1 + (1 + 0.5 * sharpe * sharpe) * pow(1.6448536269514722 / sharpe, 2) end as min_n, ok from zz cross join pb),
ff as (select *, concat_ws(',', case when ok and dsr < 0.95 then 'dsr' end, case when ok and pbo > 0.5 then 'pbo' end, case when ok and coalesce(n < min_n, true) then 'min_n' end) as failed from gg)
final select trial, n, trials, sharpe, dsr, pbo, min_n, case when not ok then 'INSUFFICIENT' when failed = '' then 'COMMIT' else 'DO_NOT_COMMIT' end as decision, failed from ff""", "sharpe dsr pbo min_n")
def _(s, d):
    b = hourly(s, d)
    e = simulate.entries(b, _pins(s, d).withColumn("sl_price", F.lit(None).cast("double")))
    e = e.withColumn("tp_r", F.explode(F.array(*map(F.lit, (1.5, 2.0, 3.0))))).withColumn("sl_pct", F.explode(F.array(F.lit(0.05), F.lit(0.2))))
    t = simulate.exits(b, e, tp_r=F.col("tp_r"), sl_pct=F.col("sl_pct")).withColumn("trial", F.concat_ws("|", "symbol", "tp_r", "sl_pct"))
    return resampling.commit_gate(t, "trial", "entry_time", "pnl_r")


@query("gate_verdicts", TRADES_SQL + MOMENTS.format("strategy") + """
, pt as (select strategy as trial, entry_time, pnl_r as v from t)""" + PBO.format("pt", 56, t="entry_time", v="v") + """
, tr as (select count(sr) as trials, var_samp(sr) as vs from mv),
at_ as (select 'a' as name, 1 - 1.0::double / trials as p from tr union all select 'b', 1 - 1 / (trials * exp(1.0)) from tr)""" + QUANTILE + f"""
, fl as (select sqrt(vs) * ((1 - 0.5772156649015329) * (select z from qq where name = 'a') + 0.5772156649015329 * (select z from qq where name = 'b')) as floor from tr),
zz as (select mv.*, (sr - fl.floor) * sqrt(n - 1) / sqrt(v) as z from mv cross join fl),
g as (select strategy, entry_time as c, sum(pnl_r) as s, count(*) as n from t group by all),
du as (select g.*, four * 4 + j + 1 as draw, substr(md5('7|' || four || '|' || c), 1 + 8 * j, 8) as u from g cross join (select cast(unnest(range(0, 500)) as integer) as four) cross join (select cast(unnest(range(0, 4)) as integer) as j)),
dm as (select strategy, draw, sum({WEIGHT} * s) / nullif(sum({WEIGHT} * n), 0) as m from du group by all),
lo as (select strategy, quantile_cont(m, 0.025) as lo from dm group by all),
vv as (select strategy, sr * sqrt(252) as sharpe, {CDF.format('z')} as dsr, pbo, lo from zz cross join pb join lo using (strategy))
final select *, coalesce(dsr >= 0.95 and pbo <= 0.5 and lo > 0, false) as passes, coalesce(dsr >= 0.95 and pbo <= 0.5 and lo > 0 and sharpe >= 0.7, false) as passes_sleeve from vv""", "sharpe dsr pbo lo")
def _(s, d):
    t = tables.trades(s, d)
    x = statistics.deflated_sharpe(t, ["strategy"], "pnl_r").select("strategy", (F.col("sr") * F.sqrt(F.lit(252.0))).alias("sharpe"), "dsr")
    pbo = statistics.backtest_overfitting(t, "strategy", "entry_time", "pnl_r").select("pbo")
    x = x.crossJoin(F.broadcast(pbo)).join(statistics.bootstrap_mean(t, ["strategy"], "entry_time", "pnl_r").select("strategy", "lo"), "strategy")  # pbo: one row
    ask = [F.col(c) for c in ("dsr", "pbo", "lo")]
    return x.withColumns({"passes": statistics.passes(*ask), "passes_sleeve": statistics.passes(*ask, F.col("sharpe"))})


# small lookups

@query("signals_history", BARS_SQL + PINS + "\nfinal select symbol, timeframe, open_time, direction, sl_price from sig where symbol = 'click' and open_time between 1704500000000 and 1705500000000", "sl_price")
def _(s, d):
    return tables.history(_pins(s, d).select("symbol", "timeframe", "open_time", "direction", "sl_price"), "click", "1h", 1704500000000, 1705500000000)


@query("incomplete_symbols", BARS_SQL + "\nfinal select symbol from (select distinct symbol from bars union select 'absent') anti join (select symbol from bars group by symbol having count(*) >= 650 and symbol <> 'view') using (symbol)")
def _(s, d):
    b = hourly(s, d)
    done = b.groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 650 and symbol <> 'view'")
    return tables.complete(done, b.select("symbol").distinct().union(s.createDataFrame([("absent",)], "symbol string")))


@query("adr_thresholds", TRADES_SQL + "\nfinal select timeframe, strategy, threshold, count(*) as n from (select *, case when timeframe in ('1h', '4h') and strategy <> 'A' then adr_suppress_threshold end as threshold from r) group by all", "threshold")
def _(s, d):
    r = tables.runs(tables.trades(s, d))
    t = simulate.effective_adr_threshold(F.col("adr_suppress_threshold"), F.col("timeframe"), F.col("strategy") == "A")
    return r.groupBy("timeframe", "strategy", t.alias("threshold")).agg(F.count("*").alias("n"))


@query("one_trade_each", BARS_SQL + SIMULATED + "\nfinal select strategy, timeframe, signal_time, direction, entry, exit_time, outcome from trades qualify row_number() over (partition by strategy, timeframe, signal_time, direction order by exit_time is null, exit_time, entry) = 1", "entry")
def _(s, d):
    t = simulate.simulate(hourly(s, d), _pins(s, d))
    return simulate.one_of_each(t, ("strategy", "timeframe")).select("strategy", "timeframe", "signal_time", "direction", "entry", "exit_time", "outcome")


@query("quote_disagrees", DAILY_SQL + """
, q as (select symbol, open_time, close, lead(open) over (partition by symbol order by open_time) as quote from bars)
final select symbol, count(*) as n, count(*) filter (abs(ln(close / quote)) > ln(1.25)) as n_off from q where quote is not null group by symbol""")
def _(s, d):
    b = per_day(s, d).withColumn("quote", F.lead("open").over(Window.partitionBy("symbol").orderBy("open_time"))).where("quote is not null")
    return b.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(quality.disagrees(F.col("close"), F.col("quote"))).alias("n_off"))


@query("reversal_scores", PANEL + """
, m as (select *, case when count(ret) over w >= 20 then stddev_samp(ret) over w end as sigma from p window w as (partition by symbol order by date rows 19 preceding)),
l as (select date, symbol, -ret / nullif(sigma, 0) as score from m)
final select date, symbol, score, count(score) over (partition by date) as n from l""", "score")
def _(s, d):
    p = books.panel(per_day(s, d)).withColumn("sigma", books.full("ret", 20, F.stddev_samp))
    p = p.withColumn("score", magnets.reversal(p)).select("date", "symbol", "score")
    return p.join(magnets.eligible(p, "score"), "date")


# trades under the regime of their entry, and whether the gate is worth turning on

AT_REGIME = BARS_SQL + SIMULATED + H4.replace(", h as", ", hi4 as").replace("from h)", "from hi4)") + REGIME.replace(" from b window", " from b4 window").replace(", tr as", ", tr4 as").replace("from tr x join tr y", "from tr4 x join tr4 y") + """
, ae as (select tr.*, f.i as i4 from trades tr asof left join b4 f on f.symbol = tr.symbol and tr.entry_time >= f.open_time),
an as (select ae.*, coalesce(reg.regime, 'unknown') as regime, coalesce(reg.regime, 'unknown') in ('high_vol') as suppressed from ae left join reg on reg.symbol = ae.symbol and reg.i = ae.i4 - 1)
"""


def _at_regime(s, d):
    b = hourly(s, d)
    t = replays.annotate_regime(simulate.simulate(b, _pins(s, d)), indicators.regime(quality.resample(b)).select("symbol", "open_time", "regime"))
    return replays.annotate_suppression(t, {"high_vol": [], "trend": ["pin_bar"]})


@query("suppressed_trades", AT_REGIME + "\nfinal select strategy, regime, suppressed, count(*) as n, avg(pnl_r) as avg_r, avg(cast(pnl_r > 0 as integer)) as win_rate from an where pnl_r is not null group by all", "avg_r win_rate")
def _(s, d):
    return replays.kept_and_dropped(_at_regime(s, d))


@query("gate_flip", AT_REGIME + ", cl as (select strategy, suppressed as out, entry_time // 86400000 as day, pnl_r as r from an)" + AUDIT.format("strategy", CDF_Z, 500, WEIGHT) + """
final select *, case when bool_or(decision in ('DISABLE', 'CONCENTRATE')) over () then 'DO NOT FLIP' when bool_or(decision = 'ENABLE') over () then 'FLIP justified' else 'HOLD' end as flip from ad""", AUDIT_NAMES)
def _(s, d):
    return replays.flip(_at_regime(s, d).withColumn("day", F.expr(f"entry_time div {tables.DAY_MS}")))


# the overlay's arms, and its state at the last close

OVERLAY = PANEL + """
, om as (select *, case when count(close) over w >= 200 then avg(close) over w end as sma, case when count(ret) over v >= 20 then stddev_samp(ret) over v end as vol from p window w as (partition by symbol order by date rows 199 preceding), v as (partition by symbol order by date rows 19 preceding)),
ol as (select *, lag(close > sma) over w as risk_on, lag(vol) over w as pv from om window w as (partition by symbol order by date)),
oz as (select date, symbol, case when risk_on and pv is not null then least(0.1 / (pv * sqrt(252)), 1) else 0 end as weight, ret from ol),
oa as (select symbol, 'held' as arm, date, ret, 1.0::double as weight from oz where ret is not null union all select symbol, 'overlay', date, weight * coalesce(ret, 0), weight from oz),
ow as (select *, coalesce(abs(weight - lag(weight) over (partition by symbol, arm order by date)), 0) as step, exp(sum(ln(1 + ret)) over (partition by symbol, arm order by date rows unbounded preceding)) as wealth, row_number() over (partition by symbol, arm order by date) as k from oa),
od as (select *, wealth / greatest(1, max(wealth) over (partition by symbol, arm order by date rows unbounded preceding)) - 1 as dd from ow),
oe as (select *, coalesce(max(case when dd >= -1e-12 then k end) over (partition by symbol, arm order by date rows unbounded preceding), 0) as dry from od),
og as (select symbol, arm, date_diff('day', min(date), max(date)) / 365.25::double as years, sum(ln(1 + ret)) as lg, avg(ret) as mean, stddev_samp(ret) as sd, sum(cast(step > 0 as integer)) as sw, avg(weight) as in_market, sum(step) as tu, sqrt(avg(dd * dd)) * 100 as ulcer, min(dd) as max_drawdown, cast(max(k - dry) as integer) as longest_under_water from oe group by all)
"""


@query("overlay_summaries", OVERLAY + "\nfinal select symbol, arm, years, exp(lg / years) - 1 as ann_return, sd * sqrt(252) as ann_vol, mean / nullif(sd, 0) * sqrt(252) as sharpe, ulcer, max_drawdown, longest_under_water, sw / years as switches_a_year, in_market, tu / years as turnover_a_year from og", "years ann_return ann_vol sharpe ulcer max_drawdown switches_a_year in_market turnover_a_year")
def _(s, d):
    v = books.vol_overlay(books.panel(per_day(s, d)))
    held = v.where("ret is not null").select("symbol", F.lit("held").alias("arm"), "date", "ret", F.lit(1.0).alias("weight"))
    return overlay.summaries(held.unionByName(v.select("symbol", F.lit("overlay").alias("arm"), "date", F.col("arm").alias("ret"), "weight")), ["symbol", "arm"])


@query("overlay_state", PANEL + """
, cl as (select symbol, date, close, ret, row_number() over (partition by symbol order by date) as n from p where date < (select max(date) from p)),
st as (select *, avg(close) over (partition by symbol order by date rows 199 preceding) as sma, avg(close) over (partition by symbol order by date rows 198 preceding) as flip_level, stddev_samp(ret) over (partition by symbol order by date rows 19 preceding) as sd from cl),
si as (select *, close > sma as ma_in from st where n >= 200),
sn as (select *, max(case when chg then n end) over (partition by symbol order by date rows unbounded preceding) as since, max(n) over (partition by symbol) as newest from (select *, coalesce(lag(ma_in) over (partition by symbol order by date) <> ma_in, true) as chg from si))
final select symbol, date as as_of, close, sma, ma_in, cast(n - since + 1 as integer) as sessions_in_state, flip_level, sd * sqrt(252) as sigma_ann, least(0.00709 / sd, 1) as vm_weight, case when ma_in then least(0.00709 / sd, 1) else 0 end as exposure from sn where n = newest""", "close sma flip_level sigma_ann vm_weight exposure")
def _(s, d):
    return overlay.state(overlay.completed(books.panel(per_day(s, d)).select("symbol", "date", "close"), _noon(s, d)))


def _noon(s, d):
    """Noon of the last day there is a bar of: that day's bars have not closed yet."""
    last = per_day(s, d).agg(F.max("open_time")).first()[0] or 0
    return datetime.datetime.fromtimestamp(last / 1000 + 43_200, datetime.UTC)


# cross-sectional books, as they are and centred, on prices and on what the market doesn't explain

XS = """
, dm as (select fc.date, fc.symbol, {0} as ret, vol, forecast - avg(forecast) over (partition by fc.date) as forecast from fc{1}),
x0 as (select *, lag(forecast) over (partition by symbol order by date) / 10 * 0.2 / (vol * sqrt(252)) as leverage from dm),
x1 as (select false as neutral, * from x0 union all select true, * exclude (leverage), leverage - avg(leverage) over (partition by date) from x0),
x2 as (select *, leverage * ret - abs(leverage - coalesce(lag(leverage) over (partition by neutral, symbol order by date), 0)) * 0.0003 as net from x1),
g as (select neutral, date, coalesce(sum(net), 0) as pre, count(net) as active from x2 group by all),
v as (select *, case when count(pre) over w = 64 then stddev_samp(pre) over w end as vol from g window w as (partition by neutral order by date rows 63 preceding)),
gv as (select neutral, date, pre, active, case when lag(vol) over (partition by neutral order by date) is not null then greatest(0.5, least(1.5, 0.2 / (lag(vol) over (partition by neutral order by date) * sqrt(252)))) end as governor from v)
final select *, coalesce(governor, 0) * pre as ret from gv"""


def _xs(f):
    both = None
    for neutral in (False, True):
        x = books.cross_sectional(f, neutral=neutral).withColumn("neutral", F.lit(neutral)).select("neutral", "date", "symbol", "net")
        both = x if both is None else both.unionByName(x)
    return books.governed(both, keys=("neutral",), total=F.sum)


@query("cross_sectional_books", FORECAST + XS.format("ret", ""), "pre governor ret")
def _(s, d):
    return _xs(books.forecasts(books.panel(per_day(s, d))))


@query("residual_books", RESIDUAL + ", rq as (select date, symbol, exp(sum(ln(1 + greatest(least(resid, 0.2), -0.2))) over (partition by symbol order by date rows unbounded preceding)) as close, ret as own from (select * from rs where resid is not null qualify count(*) over (partition by date) >= 3)), rp as (select *, close / lag(close) over (partition by symbol order by date) - 1 as ret from rq)" + FORECAST[len(PANEL):].replace(" as i from p)", " as i from rp)") + XS.format("rp.own", " join rp on rp.date = fc.date and rp.symbol = fc.symbol"), "pre governor ret")
def _(s, d):
    f = books.forecasts(books.residual_closes(books.panel(per_day(s, d)), 60, most=0.2))
    return _xs(f.withColumn("ret", F.col("own")).drop("own"))
