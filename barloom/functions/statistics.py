"""Statistics of return samples: moments, Sharpe ratios and their odds, overfitting, clusters, bootstraps."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _cdf(x: np.ndarray) -> np.ndarray:
    """Normal distribution function: its series near 0, a continued fraction in the tails; NaN stays."""
    a = np.minimum(np.abs(np.nan_to_num(x)), 40.0)
    small = np.minimum(a, 4.0)
    term = total = small.copy()
    for k in range(1, 60):
        term = term * small * small / (2 * k + 1)
        total = total + term
    tail = np.maximum(a, 4.0)
    fraction = tail.copy()
    for k in range(60, 0, -1):
        fraction = tail + k / fraction
    upper = np.where(a <= 4.0, 0.5 - total * np.exp(-small * small / 2) / np.sqrt(2 * np.pi), np.exp(-tail * tail / 2) / np.sqrt(2 * np.pi) / fraction)
    return np.where(np.isnan(x), np.nan, np.where(x > 0, 1 - upper, upper))


def _quantile(p: np.ndarray) -> np.ndarray:
    """Its inverse by bisection; NaN outside of (0, 1)."""
    lo, hi = np.full(len(p), -40.0), np.full(len(p), 40.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = _cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return np.where((p > 0) & (p < 1), (lo + hi) / 2, np.nan)


def normal_cdf(c):
    @F.pandas_udf(DoubleType())
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(_cdf(x.to_numpy(float)))

    return cdf(c)


def normal_quantile(c):
    @F.pandas_udf(DoubleType())
    def inv(x: pd.Series) -> pd.Series:
        return pd.Series(_quantile(x.to_numpy(float)))

    return inv(c)


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, skew and kurtosis (3 for a normal law) per key, on the sample deviation."""
    m = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *(F.sum(F.pow(value, F.lit(k))).alias(f"s{k}") for k in (2, 3, 4)))
    mean, n, sd = F.col("mean"), F.col("n"), F.nullif(F.col("sd"), F.lit(0.0))
    third = F.col("s3") / n - 3 * mean * F.col("s2") / n + 2 * mean**3
    fourth = F.col("s4") / n - 4 * mean * F.col("s3") / n + 6 * mean**2 * F.col("s2") / n - 3 * mean**4
    return m.select(*keys, "n", "mean", "sd", (third / sd**3).alias("skew"), (fourth / sd**4).alias("kurt"))


def sharpe_odds(rows: DataFrame, keys: list[str], value: str, against: float = 0.0) -> DataFrame:
    """Probabilistic Sharpe ratio per key and the least sample for 95%."""
    m = moments(rows, keys, value).withColumn("sr", F.try_divide("mean", "sd"))
    var = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2
    z = (F.col("sr") - against) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(var > 0, var))
    least = 1 + var * F.pow(F.lit(NormalDist().inv_cdf(0.95)) / F.nullif(F.col("sr") - against, F.lit(0.0)), F.lit(2))
    return m.withColumns({"psr": normal_cdf(z), "min_n": F.when(F.col("sr") > against, least)})


def deflated_sharpe(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sharpe odds per key against the best that as many trials of no skill would give."""
    m = moments(rows, keys, value).withColumn("sr", F.try_divide("mean", "sd"))
    t = m.agg(F.count("sr").alias("trials"), F.var_samp("sr").alias("v")).withColumns({"a": 1 - 1 / F.col("trials"), "b": 1 - 1 / (F.col("trials") * float(np.e))})
    t = t.withColumn("floor", F.sqrt("v") * ((1 - float(np.euler_gamma)) * normal_quantile(F.col("a")) + float(np.euler_gamma) * normal_quantile(F.col("b"))))
    m = m.crossJoin(F.broadcast(t.select("floor", "trials")))  # one row
    var = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2
    return m.withColumn("dsr", normal_cdf((F.col("sr") - F.col("floor")) * F.sqrt(F.col("n") - 1) / F.sqrt(F.when(var > 0, var))))


def cluster_icc(rows: DataFrame, cluster: str, value: str) -> DataFrame:
    """Intra-cluster correlation of one-way analysis of variance, design effect and effective sample; one row."""
    g = rows.where(F.col(value).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("ssw"))
    ssb = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    t = t.withColumns({"msb": ssb / (F.col("k") - 1), "msw": F.col("ssw") / (F.col("n") - F.col("k")), "n0": (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)})
    icc = F.greatest(F.lit(0.0), (F.col("msb") - F.col("msw")) / (F.col("msb") + (F.col("n0") - 1) * F.col("msw")))
    return t.withColumn("icc", icc).withColumn("deff", 1 + (F.col("n") / F.col("k") - 1) * F.col("icc")).select("k", "n", "icc", "deff", (F.col("n") / F.col("deff")).alias("n_eff"))


def correlations(panel: DataFrame) -> DataFrame:
    """Pairwise correlation of returns over shared dates, a before b."""
    a, b = (panel.where("ret is not null").select("date", F.col("symbol").alias(n), F.col("ret").alias(f"r{n}")) for n in ("a", "b"))
    return a.join(b, "date").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("corr"), F.count("*").alias("n"))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows by the columns over as many tasks as shuffles have: few rows that make much work, which are not put together again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


# fixed values: the distribution function of the Poisson law of mean 1
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


def weighted_sums(rows: DataFrame, keys: list[str], unit: str, values: list[str], draws: int, seed: int) -> DataFrame:
    """``keys, draw, values``: sums in which each draw weighs a unit by a Poisson(1) count from a digest of seed, draw and unit.

    Four draws share a digest, each by eight of its digits, which compare as the number they write; their sums are kept side by
    side, so a row is met once for four draws.
    """
    # a unit's rows go together, so that its digests and weights are worked out once for all of them
    x = spread(rows.select(*keys, F.col(unit).alias("_unit"), *values), "_unit").groupBy("_unit").agg(F.collect_list(F.struct(*keys, *values)).alias("_rows"))
    x = x.withColumn("_four", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))))
    x = x.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), "_four", "_unit").cast("binary")))
    x = x.withColumns({f"_u{i}": F.substring("_h", 8 * i + 1, 8) for i in range(4)})
    x = x.withColumns({f"_w{i}": sum((F.col(f"_u{i}") >= f"{math.ceil(p * 2**32):08x}").cast("int") for p in POISSON) for i in range(4)})
    x = x.select("_four", *(f"_w{i}" for i in range(4)), F.inline("_rows"))
    g = x.groupBy(*keys, "_four").agg(*(F.sum(F.col(f"_w{i}") * F.col(v)).alias(f"_{v}{i}") for v in values for i in range(4)))
    each = F.array(*(F.struct((F.col("_four") * 4 + i + 1).alias("draw"), *(F.col(f"_{v}{i}").alias(v) for v in values)) for i in range(4)))
    return g.select(*keys, F.inline(each)).where(F.col("draw") <= draws)


def bootstrap_mean(rows: DataFrame, keys: list[str], cluster: str, value: str, draws: int = 2000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """Cluster bootstrap of the mean per key: mean, its count, and the ends of the percentile interval.

    Whole clusters are weighed, so the work is sums over (key, cluster) aggregates and no resample is built.
    """
    g = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    each = weighted_sums(g, keys, cluster, ["s", "n"], draws, seed).select(*keys, F.try_divide("s", "n").alias("m"))
    ends = each.groupBy(*keys).agg(F.percentile("m", alpha / 2).alias("lo"), F.percentile("m", 1 - alpha / 2).alias("hi"))
    return g.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"), F.sum("n").alias("n")).join(ends, keys)


def backtest_overfitting(points: DataFrame, trial: str, time: str, value: str, bins: int = 56, splits: int = 14) -> DataFrame:
    """Probability of backtest overfitting of trials: R summed in equal time bins, then symmetric cross-validation.

    Bins go to ``splits`` blocks in order. For every choice of half the blocks, the trial best there is ranked in the other
    half; overfit are the choices in which it is at or under the median. Ties count half, and of equal best ones the first
    by name is taken. Sums per block and trial are all that is ever held, so trials may be any number.
    """
    span = points.agg(F.min(time).alias("t0"), F.max(time).alias("t1"))
    b = F.least(F.floor((F.col(time) - F.col("t0")) * bins / F.greatest(F.col("t1") - F.col("t0"), F.lit(1))), F.lit(bins - 1))
    cells = points.crossJoin(F.broadcast(span)).groupBy(F.floor(b * splits / bins).cast("int").alias("block"), F.col(trial).alias("trial")).agg(F.sum(value).alias("r"))
    wide = cells.groupBy("trial").agg(F.sum("r").alias("all_"), F.map_from_entries(F.collect_list(F.struct("block", "r"))).alias("_b"))
    wide = spread(wide.withColumn("_b", F.expr(f"transform(sequence(0, {splits - 1}), j -> coalesce(_b[j], 0D))")), "trial")
    # a choice is a number whose bits tell the blocks inside
    choices = F.expr(f"filter(sequence(0, {2**splits - 1}), m -> bit_count(m) = {splits // 2})")
    inside = F.expr(f"round(aggregate(sequence(0, {splits - 1}), 0D, (a, j) -> a + if(getbit(choice, j) = 1, _b[j], 0D)), 9)")
    rows = wide.withColumn("choice", F.explode(choices)).withColumn("inside", inside).select("trial", "choice", "inside", F.round(F.col("all_") - F.col("inside"), 9).alias("outside"))
    best = rows.groupBy("choice").agg(F.max("inside").alias("top"))
    first = rows.join(best, "choice").where("inside = top").groupBy("choice").agg(F.min_by("outside", "trial").alias("own"))
    ranks = rows.join(first, "choice").groupBy("choice").agg(F.count("*").alias("n"), (F.count_if(F.col("outside") < F.col("own")) + 0.5 * (F.count_if(F.col("outside") == F.col("own")) - 1) + 1).alias("rank"))
    return ranks.agg(F.max("n").alias("trials"), F.avg((F.col("rank") / (F.col("n") + 1) < 0.5).cast("double")).alias("pbo"))


def adjusted_p(tests: DataFrame, p: str = "p", method: str = "holm", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``p_adjusted`` for the number of tests: ``bonferroni``, ``holm`` or ``bhy`` (false discoveries under any dependence).

    ``by`` tells families apart; a row is a test, so a family is no large group.
    """
    w = Window.partitionBy(*by).orderBy(p)
    t = tests.withColumns({"_k": F.row_number().over(w), "_m": F.count("*").over(Window.partitionBy(*by))})
    if method == "bonferroni":
        out = F.col(p) * F.col("_m")
    elif method == "holm":
        out = F.max(F.col(p) * (F.col("_m") - F.col("_k") + 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif method == "bhy":
        c = F.expr("aggregate(sequence(1, cast(_m as int)), 0D, (a, i) -> a + 1D / i)")
        out = F.min(F.col(p) * F.col("_m") * c / F.col("_k")).over(Window.partitionBy(*by).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    else:
        raise ValueError(f"no method {method}")
    return t.withColumn("p_adjusted", F.least(out, F.lit(1.0))).drop("_k", "_m")


def drawdown_stats(rets: DataFrame, keys: list[str], order: str = "date", value: str = "ret") -> DataFrame:
    """Per key: largest drawdown of compounded returns, ulcer index, longest run of bars under water and share of them."""
    w = Window.partitionBy(*keys).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    r = rets.where(F.col(value).isNotNull()).withColumns({"_wealth": F.exp(F.sum(F.log1p(value)).over(up)), "_k": F.row_number().over(w)})
    r = r.withColumn("_dd", F.col("_wealth") / F.greatest(F.lit(1.0), F.max("_wealth").over(up)) - 1)
    r = r.withColumn("_wet", F.col("_dd") < -1e-12).withColumn("_dry", F.coalesce(F.max(F.when(~F.col("_wet"), F.col("_k"))).over(up), F.lit(0)))
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("ulcer"), F.max(F.col("_k") - F.col("_dry")).alias("longest_under_water"), F.avg(F.col("_wet").cast("double")).alias("share_under_water"))


def ols(rows: DataFrame, keys: list[str], y: str, x: str, days: float = 252.0) -> DataFrame:
    """Per key, y on x: yearly alpha and its t value, beta, R squared, and the yearly Sharpe ratio of y less beta times x.

    Where x doesn't vary, beta, t and R squared are 0. Null values are left out in pairs.
    """
    r = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.coalesce(F.var_pop(x), F.lit(0.0)).alias("vx"), F.coalesce(F.var_pop(y), F.lit(0.0)).alias("vy"), F.covar_pop(y, x).alias("c"))
    r = r.withColumn("beta", F.when((F.col("n") > 1) & (F.col("vx") > 1e-24), F.col("c") / F.col("vx")).otherwise(0.0))
    r = r.withColumns({"alpha": F.col("my") - F.col("beta") * F.col("mx"), "rss": F.greatest(F.lit(0.0), F.col("n") * (F.col("vy") - F.col("beta") * F.col("c")))})
    se = F.sqrt(F.col("rss") / (F.col("n") - 2) * (1 / F.col("n") + F.col("mx") * F.col("mx") / (F.col("n") * F.col("vx"))))
    t = F.when((F.col("n") > 2) & (F.col("vx") > 1e-24) & (se > 1e-15), F.col("alpha") / se).otherwise(0.0)
    hedged = F.try_divide(F.col("alpha"), F.sqrt(F.col("rss") / (F.col("n") - 1))) * F.sqrt(F.lit(days))
    r2 = F.when(F.col("n") * F.col("vy") > 1e-15, 1 - F.col("rss") / (F.col("n") * F.col("vy"))).otherwise(0.0)
    return r.select(*keys, "n", (F.col("alpha") * days).alias("alpha_a_year"), "beta", t.alias("t_alpha"), r2.alias("r2"), hedged.alias("hedged_sharpe"))


def independent_series(panel: DataFrame) -> DataFrame:
    """How many independent series the panel's are worth, by their mean correlation; one row ``k, mean_corr, k_eff``."""
    c = correlations(panel).agg(F.avg("corr").alias("mean_corr"))
    k = panel.where("ret is not null").agg(F.countDistinct("symbol").alias("k"))
    x = k.crossJoin(F.broadcast(c))  # one row each
    return x.withColumn("k_eff", F.greatest(F.lit(1.0), F.least(F.col("k").cast("double"), F.col("k") / (1 + (F.col("k") - 1) * F.greatest("mean_corr", F.lit(0.0))))))


def passes(dsr, pbo, low, sharpe=None):
    """The gate of a book: deflated odds of 0.95, overfitting in at most half, a bound above 0, and a Sharpe ratio of 0.7 if
    given. What isn't known fails."""
    ok = (dsr >= 0.95) & (pbo <= 0.5) & (low > 0)
    return F.coalesce(ok if sharpe is None else ok & (sharpe >= 0.7), F.lit(False))
