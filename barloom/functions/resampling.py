"""Resampling of series that depend on their past, and what a gate demands.

Draws come from digests, not from a generator's state: a draw is the same wherever it is worked out, arms of one length get
the same draws, and a lost task gives the same rows again. No resample is built: a run of days is a difference of two running
sums, and a path is folded over its runs.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import adjusted_p, backtest_overfitting, bootstrap_mean, normal_cdf, normal_quantile, spread, weighted_sums

#: Draws that one row works out; a series' draws are spread over tasks in such rows.
CHUNK = 100


def _uniform(digest: str, i: int) -> str:
    """The i-th number in [0, 1) of a hexadecimal digest, as SQL."""
    return f"cast(conv(substr({digest}, {8 * i + 1}, 8), 16, 10) as double) / 4294967296D"


def _run_length(block: str, left: str, method: str, last: str) -> str:
    """Days that a run takes: geometric with mean ``block``, or ``block``; at most what is left, and all of it for the last run."""
    if method == "circular":
        return f"least({left}, {block})"
    if method != "stationary":
        raise ValueError(f"no method {method}")
    drawn = f"if({block} <= 1, 1, 1 + cast(floor(ln(1D - {_uniform('h', 1)}) / ln(1D - 1D / {block})) as int))"
    return f"if({last}, {left}, least({left}, {drawn}))"


def _runs(mean: str) -> str:
    """Runs that fill a draw: six deviations above their mean number, so that the last has something left once in a billion."""
    return f"cast(ceil({mean} + 6 * sqrt({mean})) as int) + 10"


def _spread(df: DataFrame, keys: list[str], draws: int) -> DataFrame:
    chunks = F.sequence(F.lit(0), F.lit((draws - 1) // CHUNK))
    df = spread(df.withColumn("_chunk", F.explode(chunks)), *keys, "_chunk")
    return df.withColumn("_draws", F.expr(f"sequence(_chunk * {CHUNK}, least(_chunk * {CHUNK} + {CHUNK - 1}, {draws - 1}))"))


def block_bootstrap(rows: DataFrame, keys: list[str], order: str, value: str, draws: int = 10_000, block: int | None = None, alpha: float = 0.05, method: str = "stationary", seed: int = 7, days: float = 252.0) -> DataFrame:
    """Percentile intervals of the mean and of the yearly Sharpe ratio of serially dependent returns, a row a key.

    ``keys, n, block, mean, mean_lo, mean_hi, sharpe, sharpe_lo, sharpe_hi, n_valid``. A draw strings runs of days together, each
    from a random day on and around the end to the start: ``stationary`` runs have geometric lengths of mean ``block``,
    ``circular`` ones that length. ``block`` is the cube root of the count if not given, at least 1 and less than the count.
    Null values are left out; ``order`` has to be unique in a key. Keys with fewer than two values give no row; draws without
    deviation have no Sharpe ratio and are not counted in ``n_valid``.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.where(F.col(value).isNotNull()).select(*keys, order, F.sum(value).over(upto).alias("a"), F.sum(F.col(value) * F.col(value)).over(upto).alias("b"))
    s = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "a", "b"))).alias("_p")).withColumn("n", F.size("_p")).where("n >= 2")
    s = s.withColumn("block", F.expr(f"greatest(1, least({block if block else 'cast(round(pow(n, 1D / 3)) as int)'}, n - 1))"))
    s = s.withColumns({"_a": F.expr("concat(array(0D), transform(_p, x -> x.a))"), "_b": F.expr("concat(array(0D), transform(_p, x -> x.b))")}).drop("_p")
    s = s.withColumn("_runs", F.expr("cast(ceil(n / block) as int)" if method == "circular" else _runs("n / block")))
    around = lambda p: f"(if(i + m <= n, {p}[i + m], {p}[n] + {p}[i + m - n]) - {p}[i])"
    step = f"""transform(array(md5(concat_ws('|', '{seed}', n, d, k))), h -> transform(array(cast(floor({_uniform('h', 0)} * n) as int)), i ->
        transform(array({_run_length('block', 'acc.free', method, 'k = _runs - 1')}), m ->
        named_struct('free', acc.free - m, 'a', acc.a + {around('_a')}, 'b', acc.b + {around('_b')}))[0])[0])[0]"""
    fold = f"aggregate(sequence(0, _runs - 1), named_struct('free', n, 'a', 0D, 'b', 0D), (acc, k) -> {step})"
    each = _spread(s, keys, draws).select(*keys, "n", F.explode(F.expr(f"transform(_draws, d -> {fold})")).alias("x"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("x.b") - F.col("x.a") * F.col("x.a") / F.col("n")) / (F.col("n") - 1)))
    each = each.withColumns({"_mean": F.col("x.a") / F.col("n"), "_sd": sd})
    each = each.withColumn("_sharpe", F.when(F.col("_sd") > 1e-12, F.col("_mean") / F.col("_sd")) * math.sqrt(days))
    low, high = F.lit(alpha / 2), F.lit(1 - alpha / 2)
    ends = each.groupBy(*keys).agg(F.percentile("_mean", low).alias("mean_lo"), F.percentile("_mean", high).alias("mean_hi"), F.percentile("_sharpe", low).alias("sharpe_lo"), F.percentile("_sharpe", high).alias("sharpe_hi"), F.count("_sharpe").alias("n_valid"))
    a, b = F.col("_a")[F.col("n")], F.col("_b")[F.col("n")]
    point = s.withColumns({"mean": a / F.col("n"), "_sd": F.sqrt(F.greatest(F.lit(0.0), (b - a * a / F.col("n")) / (F.col("n") - 1)))})
    point = point.select(*keys, "n", "block", "mean", (F.when(F.col("_sd") > 1e-12, F.col("mean") / F.col("_sd")) * math.sqrt(days)).alias("sharpe"))
    return point.join(ends, keys).select(*keys, "n", "block", "mean", "mean_lo", "mean_hi", "sharpe", "sharpe_lo", "sharpe_hi", "n_valid")


def breach_curve(rows: DataFrame, keys: list[str], order: str, value: str, depths: tuple[float, ...] = (0.1, 0.25, 0.5), horizon: int = 252, paths: int = 5_000, block: int = 252, seed: int = 7) -> DataFrame:
    """Odds that a drawdown of each depth occurs within ``horizon`` days: ``keys, depth, odds``.

    A path strings together runs of past days of geometric lengths, mean ``block``, each from a random day on and around the
    end; it starts from fresh wealth, which counts as a peak. Paths are folded day by day with their running peak, hundreds
    of them a row, and rows are spread over tasks. Nulls are left out; keys with fewer than two values give no rows.
    """
    s = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("r")))).alias("_p")).withColumn("n", F.size("_p")).where("n >= 2")
    s = s.withColumn("_block", F.least(F.lit(block), F.col("n") - 1))
    s = s.withColumn("_r", F.expr(f"flatten(array_repeat(transform(_p, x -> x.r), cast(ceil({horizon} / n) as int) + 1))")).drop("_p")
    s = s.withColumn("_runs", F.expr(_runs(f"{horizon} / _block")))
    day = "named_struct('wealth', s.wealth * (1D + r), 'peak', greatest(s.peak, s.wealth * (1D + r)), 'worst', least(s.worst, s.wealth * (1D + r) / greatest(s.peak, s.wealth * (1D + r)) - 1D))"
    step = f"""transform(array(md5(concat_ws('|', '{seed}', n, d, k))), h -> transform(array({_run_length('_block', 'acc.free', 'stationary', 'k = _runs - 1')}), m ->
        named_struct('free', acc.free - m, 's', aggregate(slice(_r, cast(floor({_uniform('h', 0)} * n) as int) + 1, m), acc.s, (s, r) -> {day})))[0])[0]"""
    fold = f"aggregate(sequence(0, _runs - 1), named_struct('free', {horizon}, 's', named_struct('wealth', 1D, 'peak', 1D, 'worst', 0D)), (acc, k) -> {step}, acc -> acc.s.worst)"
    worst = _spread(s, keys, paths).select(*keys, F.explode(F.expr(f"transform(_draws, d -> {fold})")).alias("worst"))
    g = worst.groupBy(*keys).agg(*(F.avg((F.col("worst") <= -d).cast("double")).alias(f"_{i}") for i, d in enumerate(depths)))
    return g.select(*keys, F.inline(F.array(*(F.struct(F.lit(float(d)).alias("depth"), F.col(f"_{i}").alias("odds")) for i, d in enumerate(depths)))))


def required_sharpe(df: DataFrame, n: str = "n", benchmark: str = "benchmark", skew: str = "skew", kurt: str = "kurt", target: float = 0.95) -> DataFrame:
    """Adds ``required``: the least Sharpe ratio a period whose probabilistic odds against the benchmark reach ``target``.

    Null where none does, as with a small sample against a high benchmark, or where anything isn't known; with fewer than two
    periods nothing does. Odds are compared as deviates, so no distribution function is worked out: the bracket is doubled and
    then halved, all in one column. A variance term of 0 or less counts as reached.
    """
    z = NormalDist().inv_cdf(target)
    var = f"(1D - `{skew}` * {{0}} + (`{kurt}` - 1D) / 4D * {{0}} * {{0}})"
    met = f"({var} <= 0D or ({{0}} - `{benchmark}`) * sqrt(`{n}` - 1D) >= {z!r}D * sqrt(greatest({var}, 0D)))"
    mid = "((s.lo + s.hi) / 2D)"
    widen = f"aggregate(sequence(1, 21), named_struct('lo', 0D, 'hi', 1D), (s, i) -> if({met.format('s.hi')}, s, named_struct('lo', s.hi, 'hi', s.hi * 2D)))"
    halve = f"aggregate(sequence(1, 100), w, (s, i) -> if({met.format(mid)}, named_struct('lo', s.lo, 'hi', {mid}), named_struct('lo', {mid}, 'hi', s.hi)), s -> s.hi)"
    found = f"transform(array({widen}), w -> if({met.format('w.hi')}, {halve}, cast(null as double)))[0]"
    known = " and ".join(f"`{c}` is not null" for c in (n, benchmark, skew, kurt))
    return df.withColumn("required", F.expr(f"if({known} and `{n}` >= 2, {found}, cast(null as double))"))


def effective_n(n: Column, series: Column, k_eff: Column) -> Column:
    """Observations pooled over correlated series, deflated to the independent ones they are worth; at least 2, null where unknown."""
    return F.greatest(F.lit(2), F.floor(n * F.least(k_eff, series.cast("double")) / series)).cast("long")


def cluster_stats(rows: DataFrame, keys: list[str], cluster: str, value: str) -> DataFrame:
    """Per key: ``n, n_clusters, icc, deff, n_eff`` of one-way analysis of variance.

    One cluster is one observation; where each value is its own cluster, or nothing varies, nothing is deflated.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    t = g.groupBy(*keys).agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    k, n = F.col("n_clusters"), F.col("n")
    msb, msw = F.try_divide(F.col("nmm") - F.col("nm") * F.col("nm") / n, k - 1), F.coalesce(F.try_divide(F.col("ssw"), n - k), F.lit(0.0))
    t = t.withColumns({"msb": msb, "msw": msw, "n0": F.try_divide(n - F.col("nn") / n, k - 1)})
    of = F.col("msb") + (F.col("n0") - 1) * F.col("msw")
    icc = F.when(k == 1, 1.0).when((k == n) | (of <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("msb") - F.col("msw"), of))))
    t = t.withColumn("icc", icc).withColumn("deff", F.greatest(F.lit(1.0), 1 + (n / k - 1) * F.col("icc")))
    return t.select(*keys, "n", "n_clusters", "icc", "deff", F.least(n.cast("double"), F.greatest(F.lit(1.0), n / F.col("deff"))).alias("n_eff"))


def audit_cells(rows: DataFrame, keys: list[str], suppressed: str, cluster: str, value: str, bar: float = 0.05, alpha: float = 0.05, least: int = 30, draws: int = 2000, seed: int = 7) -> DataFrame:
    """A verdict per cell on what a gate would suppress; the tested cells are one family of tests.

    ``keys, n_supp, n_kept, supp_avg, kept_avg, n_clusters, deff, p, n_tests, p_adjusted, lo, hi, powered_null, decision``.
    Tested are cells with ``least`` suppressed values. Their mean's interval comes from a bootstrap of whole clusters, p from the
    Sharpe ratio on the effective count, adjusted by Holm's steps. ``ENABLE`` the gate where the interval is at or under
    ``-bar`` and p significant, ``DISABLE`` it where it is at or over ``bar``, or ``CONCENTRATE`` if what is kept is better still
    by ``bar``; else ``INSUFFICIENT``. ``powered_null``: the interval lies within the bars, so an effect is ruled out. One
    cluster has no interval. Null values are left out.
    """
    rows = rows.where(F.col(value).isNotNull() & F.col(suppressed).isNotNull())
    out = F.col(suppressed)
    cells = rows.groupBy(*keys).agg(F.count_if(out).alias("n_supp"), F.count_if(~out).alias("n_kept"), F.avg(F.when(out, F.col(value))).alias("supp_avg"), F.avg(F.when(~out, F.col(value))).alias("kept_avg"), F.stddev_samp(F.when(out, F.col(value))).alias("_sd"))
    tested = cells.where(F.col("n_supp") >= max(least, 2)).select(*keys, "supp_avg", "_sd")
    mine = rows.where(out).join(tested.select(*keys), keys, "left_semi")
    t = tested.join(cluster_stats(mine, keys, cluster, value), keys)
    size = F.greatest(F.lit(2.0), F.bround("n_eff", 0))
    sr = F.when(F.col("_sd") > 0, F.abs("supp_avg") / F.col("_sd")).when(F.col("supp_avg") == 0, 0.0).otherwise(1e9)
    t = adjusted_p(t.withColumn("p", 2 * normal_cdf(-sr * F.sqrt(size))).withColumn("n_tests", F.count("*").over(Window.partitionBy())))
    ends = bootstrap_mean(mine, keys, cluster, value, draws, seed, alpha).select(*keys, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    t = t.join(ends, keys).withColumns({"lo": F.when(F.col("n_clusters") > 1, F.col("_lo")), "hi": F.when(F.col("n_clusters") > 1, F.col("_hi"))})
    c = cells.join(t.select(*keys, "n_clusters", "deff", "p", "n_tests", "p_adjusted", "lo", "hi"), keys, "left")
    sure = F.col("p_adjusted") < alpha
    decision = (
        F.when(sure & (F.col("hi") <= -bar), "ENABLE")
        .when(sure & (F.col("lo") >= bar) & (F.col("kept_avg") >= F.col("supp_avg") + bar), "CONCENTRATE")
        .when(sure & (F.col("lo") >= bar), "DISABLE")
        .otherwise("INSUFFICIENT")
    )
    null = F.coalesce((F.col("lo") > -bar) & (F.col("hi") < bar), F.lit(False))
    return c.withColumns({"powered_null": null, "decision": decision}).drop("_sd")


def lift_interval(rows: DataFrame, keys: list[str], flag: str, row_id: str, value: str, draws: int = 10_000, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """Per key, the interval of the difference of means between flagged rows and the rest: ``keys, lift, lift_lo, lift_hi``.

    Each draw weighs every row by a Poisson(1) count from a digest of seed, draw and ``row_id``, which both sides' sums share.
    Null where a side has fewer than two rows.
    """
    r = rows.where(F.col(value).isNotNull() & F.col(flag).isNotNull()).select(*keys, row_id, F.col(flag).cast("int").alias("_f"), F.col(value).alias("_v"))
    both = r.groupBy(*keys).agg(F.sum("_f").alias("_n"), F.count("*").alias("_all"), (F.avg(F.when(F.col("_f") == 1, F.col("_v"))) - F.avg(F.when(F.col("_f") == 0, F.col("_v")))).alias("lift"))
    s = r.withColumns({"s1": F.col("_f") * F.col("_v"), "n1": F.col("_f"), "s0": (1 - F.col("_f")) * F.col("_v"), "n0": 1 - F.col("_f")})
    each = weighted_sums(s, keys, row_id, ["s1", "n1", "s0", "n0"], draws, seed)
    d = each.select(*keys, (F.try_divide("s1", "n1") - F.try_divide("s0", "n0")).alias("_d"))
    ends = d.groupBy(*keys).agg(F.percentile("_d", alpha / 2).alias("_lo"), F.percentile("_d", 1 - alpha / 2).alias("_hi"))
    ok = (F.col("_n") >= 2) & (F.col("_all") - F.col("_n") >= 2)
    return both.join(ends, keys, "left").select(*keys, F.when(ok, F.col("lift")).alias("lift"), F.when(ok, F.col("_lo")).alias("lift_lo"), F.when(ok, F.col("_hi")).alias("lift_hi"))


def commit_gate(points: DataFrame, trial: str, time: str, value: str, n_grid: int | None = None, splits: int = 14, odds: float = 0.95, overfit: float = 0.5, confidence: float = 0.95) -> DataFrame:
    """The verdict on committing to each trial of a sweep: ``trial, n, trials, sharpe, dsr, pbo, min_n, decision, failed``.

    ``points`` are all trials' results with their times. Odds of the Sharpe ratio are deflated by the best that as many trials, or
    ``n_grid`` if the table is only the top of a larger grid, would give by chance; overfitting is that of the whole sweep, in
    ``2 * splits`` bins of time; ``min_n`` is the least record for the ratio. ``COMMIT`` if all three pass, else ``DO_NOT_COMMIT``
    with what ``failed``; ``INSUFFICIENT`` with fewer than two trials or than ``2 * splits`` results. A trial that doesn't vary, but
    for the rounding of its results, has a ratio of 0.
    """
    rows = points.where(F.col(value).isNotNull())
    m = rows.groupBy(F.col(trial).alias("trial")).agg(F.count("*").alias("n"), F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    m = m.withColumn("sharpe", F.when(F.col("_sd") > 1e-12, F.col("_mean") / F.col("_sd")).otherwise(0.0))
    t = m.agg(F.count("*").alias("trials"), F.var_samp("sharpe").alias("_v"))
    many = F.greatest(F.col("trials"), F.lit(n_grid or 0)).cast("double")
    t = t.withColumns({"_a": 1 - 1 / many, "_b": 1 - 1 / (many * math.e)})
    euler = 0.5772156649015329
    t = t.withColumn("_floor", F.sqrt("_v") * ((1 - euler) * normal_quantile(F.col("_a")) + euler * normal_quantile(F.col("_b"))))
    pbo = backtest_overfitting(rows, trial, time, value, 2 * splits, splits).select("pbo")
    m = m.crossJoin(F.broadcast(t.select("trials", "_floor"))).crossJoin(F.broadcast(pbo))  # one row each
    ok = (F.col("trials") >= 2) & (F.col("n") >= 2 * splits)
    sr = F.col("sharpe")
    z = (sr - F.col("_floor")) * F.sqrt(F.col("n") - 1) / F.sqrt(1 + 0.5 * sr * sr)
    need = 1 + (1 + 0.5 * sr * sr) * F.pow(F.lit(NormalDist().inv_cdf(confidence)) / sr, F.lit(2))
    m = m.withColumns({"dsr": F.when(ok, normal_cdf(z)), "pbo": F.when(ok, F.col("pbo")), "min_n": F.when(ok & (sr > 0), need)})
    tests = {"dsr": F.col("dsr") < odds, "pbo": F.col("pbo") > overfit, "min_n": F.coalesce(F.col("n") < F.col("min_n"), F.lit(True))}
    failed = F.concat_ws(",", *(F.when(ok & bad, F.lit(name)) for name, bad in tests.items()))
    m = m.withColumn("failed", failed)
    decision = F.when(~ok, "INSUFFICIENT").when(F.col("failed") == "", "COMMIT").otherwise("DO_NOT_COMMIT")
    return m.select("trial", "n", "trials", "sharpe", "dsr", "pbo", "min_n", decision.alias("decision"), "failed")
