"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a domain-language-source tree. A node's budget is shared among its children by weight, no child above
what its subtree can give (its tokens times the allowed epochs); what a short child leaves goes to its siblings, and
only what a whole subtree lacks reaches the siblings of its ancestors. A leaf gives whole seeded epochs of itself and,
of the last, the longest prefix within its budget. Only counts per leaf and per slice of the hash order are windowed;
rows meet in one place only within the one slice of each leaf where its prefix ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SLICE_ROWS = 2000


def n_tokens(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def _shared(rows: DataFrame, parent: list[str], budget: str, weight: str, cap: str, out: str) -> DataFrame:
    """Adds ``out``: each row's share of its parent's ``budget`` by ``weight``, at most ``cap``, all of it if it can be.

    With rows in order of cap / weight, a row is full if what is used up to its level stays within the budget; the
    others split the rest by weight. No weight, no share.
    """
    live = rows.withColumn("_cap", F.when(F.col(weight) > 0, F.col(cap)).otherwise(F.lit(0)).cast("double")).withColumn("_r", F.when(F.col(weight) > 0, F.col("_cap") / F.col(weight)).otherwise(0.0))
    name = F.concat_ws("\x01", *[F.col(c) for c in rows.columns if c in ("domain", "lang", "source")])
    up = Window.partitionBy(*parent).orderBy("_r", name)
    all_ = Window.partitionBy(*parent)
    live = live.withColumn("_before", F.sum("_cap").over(up) - F.col("_cap")).withColumn("_from", F.sum(weight).over(all_) - F.sum(weight).over(up) + F.col(weight))
    live = live.withColumn("_full", F.col("_before") + F.col("_r") * F.col("_from") <= F.col(budget) + 1e-6)
    used, rest = F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(all_), F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col(weight))).over(all_)
    live = live.withColumn("_used", used).withColumn("_rest", rest)
    share = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col(budget) - F.col("_used")) * F.col(weight) / F.col("_rest"))
    return live.withColumn(out, share).drop("_cap", "_r", "_before", "_from", "_full", "_used", "_rest")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], fraction: float, epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with ``budget``, which sum to ``fraction`` of all tokens where they can.

    ``weights`` holds a weight for names of each level (``domain``, ``lang``, ``source``); names not given weigh 1. A name of
    weight 0 or less gives nothing: leaves below it count as tokens of the whole but not as what its ancestors can give, so
    none of them is promised more than its other children have.
    """

    def weight(level: str) -> Column:
        out = F.lit(1.0)
        for k, v in sorted(weights.get(level, {}).items()):
            out = F.when(F.col(level) == k, float(v)).otherwise(out)
        return out

    levels = ["domain", "lang", "source"]
    alive = F.least(*[weight(level) for level in levels]) > 0
    tree = leaves.select(*levels, "tokens", F.when(alive, F.col("tokens") * epochs).otherwise(0).cast("double").alias("cap"))
    budget = tree.groupBy().agg((F.sum("tokens") * float(fraction)).alias("all"))
    parent = F.broadcast(budget)  # one row
    node = tree
    above: list[str] = []
    for i, level in enumerate(levels):
        here = [*above, level]
        sums = node.groupBy(*here).agg(F.sum("cap").alias("cap")).withColumn("w", weight(level))
        sums = sums.join(parent, above) if above else sums.crossJoin(parent)
        parent = _shared(sums, above or ["all"], "all", "w", "cap", "b").select(*here, F.col("b").alias("all"))
        above = here
    return tree.join(parent.withColumnRenamed("all", "budget"), levels).select(*levels, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: dict[str, dict[str, float]], fraction: float = 0.8, epochs: int = 3, seed: int = 7) -> DataFrame:
    """The chosen documents, their columns with ``domain, n_tokens, epoch`` (in place of any so named); a row for each epoch that takes it.

    ``docs`` needs doc_id, text, lang, source; a ``domain`` column is taken as it is, else it comes from the source's
    MD5 modulo 3. Null names are the empty name. The order of epoch e is that of md5(seed|e|doc_id), ties by
    doc_id, then text. Texts without tokens cost nothing and go with their place in the order. No rows give no rows.
    """
    rule = F.col("domain") if "domain" in docs.columns else F.expr("concat('d', (instr('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 3)")
    inner = ["_domain", "_lang", "_source"]
    names = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip((rule, F.col("lang"), F.col("source")), inner, strict=True)]
    rows = docs.select(F.struct("*").alias("_doc"), "doc_id", "text", *names, rule.alias("domain"), n_tokens(F.col("text")).alias("n_tokens"))
    leaves = rows.groupBy(*inner).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("many"))
    leaves = staged(leaves, "leaves")
    most = leaves.agg(F.max("many")).first()[0] or 1
    digits = max(1, math.ceil(math.log(most / SLICE_ROWS, 16))) if most > SLICE_ROWS else 1
    budgets = leaf_budgets(leaves.select(*(F.col(c).alias(c[1:]) for c in inner), "tokens"), weights, fraction, epochs)
    budgets = budgets.select(*(F.col(c[1:]).alias(c) for c in inner), F.expr("if(tokens > 0, budget div tokens, 0)").cast("int").alias("_full"), F.expr("if(tokens > 0, budget % tokens, 0)").alias("_rest"))
    budgets = staged(budgets, "budgets")
    own = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = rows.join(budgets, inner).withColumn("_at", F.struct(own.alias("key"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    slim = placed.select(*inner, "_rest", "n_tokens", "_at", F.substring("_at.key", 1, digits).alias("_slice"))
    sums = slim.groupBy(*inner, "_slice").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    sums = sums.withColumn("_to", F.sum("_sum").over(Window.partitionBy(*inner).orderBy("_slice")))
    ends = staged(sums.where("_to > _rest").groupBy(*inner).agg(F.min(F.struct("_slice", (F.col("_to") - F.col("_sum")).alias("before"))).alias("_end")), "ends")
    last = slim.join(ends, inner).where("_slice = _end._slice").withColumn("_cum", F.sum("n_tokens").over(Window.partitionBy(*inner).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where("_end.before + _cum <= _rest").groupBy(*inner).agg(F.max("_at").alias("_last"))
    known = staged(budgets.join(ends, inner, "left").join(last, inner, "left"), "known")
    taken = F.col("_end").isNull() | (F.substring("_at.key", 1, digits) < F.col("_end._slice")) | F.coalesce(F.col("_at") <= F.col("_last"), F.lit(False))
    rounds = F.concat(F.expr("if(_full > 0, sequence(0, _full - 1), cast(array() as array<int>))"), F.when(taken & (F.col("_full") < epochs), F.array("_full")).otherwise(F.expr("cast(array() as array<int>)")))
    kept = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ("domain", "n_tokens", "epoch")]
    return placed.join(known.select(*inner, "_end", "_last"), inner).withColumn("epoch", F.explode(rounds)).select(*kept, "domain", "n_tokens", "epoch")


#: The target weights of the registered query and of the pipeline.
WEIGHTS = {"domain": {"d0": 3.0, "d1": 2.0, "d2": 1.0}, "lang": {"en": 3.0, "de": 2.0}, "source": {}}

#: The registered query's result in DuckDB's SQL.
MIX_SQL = r"""
with t as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, text,
    'd' || ((strpos('0123456789abcdef', substr(md5(coalesce(source, '')), 1, 1)) - 1) % 3) as domain,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as n_tokens
  from documents),
leaf as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens, cast(sum(n_tokens) * 3 as double) as cap from t group by all),
d0 as (
  select domain, sum(cap) as cap, case domain when 'd0' then 3.0 when 'd1' then 2.0 else 1.0 end as w,
    (select sum(tokens) * 0.8 from leaf) as b from leaf group by domain),
d1 as (
  select *, sum(cap) over (order by cap / w, domain) - cap as bef, sum(w) over () - sum(w) over (order by cap / w, domain) + w as fro from d0),
d2 as (select *, bef + cap / w * fro <= b + 1e-6 as full_ from d1),
d3 as (
  select domain, case when full_ then cap else (b - sum(case when full_ then cap else 0 end) over ()) * w / sum(case when full_ then 0 else w end) over () end as b
  from d2),
l0 as (
  select domain, lang, sum(cap) as cap, case lang when 'en' then 3.0 when 'de' then 2.0 else 1.0 end as w, any_value(d3.b) as b
  from leaf join d3 using (domain) group by domain, lang),
l1 as (
  select *, sum(cap) over (partition by domain order by cap / w, lang) - cap as bef,
    sum(w) over (partition by domain) - sum(w) over (partition by domain order by cap / w, lang) + w as fro from l0),
l2 as (select *, bef + cap / w * fro <= b + 1e-6 as full_ from l1),
l3 as (
  select domain, lang, case when full_ then cap else (b - sum(case when full_ then cap else 0 end) over p) * w / sum(case when full_ then 0 else w end) over p end as b
  from l2 window p as (partition by domain)),
s0 as (select domain, lang, source, tokens, cap, 1.0 as w, l3.b from leaf join l3 using (domain, lang)),
s1 as (
  select *, sum(cap) over (partition by domain, lang order by cap / w, source) - cap as bef,
    sum(w) over (partition by domain, lang) - sum(w) over (partition by domain, lang order by cap / w, source) + w as fro from s0),
s2 as (select *, bef + cap / w * fro <= b + 1e-6 as full_ from s1),
s3 as (
  select domain, lang, source, tokens,
    cast(floor(case when full_ then cap else (b - sum(case when full_ then cap else 0 end) over p) * w / sum(case when full_ then 0 else w end) over p end + 1e-6) as bigint) as b
  from s2 window p as (partition by domain, lang)),
s4 as (select *, case when tokens > 0 then b // tokens else 0 end as full_, case when tokens > 0 then b % tokens else 0 end as rest from s3),
x as (
  select t.*, full_, rest, sum(n_tokens) over (partition by domain, lang, source order by md5('7|' || full_ || '|' || doc_id), doc_id rows unbounded preceding) as cum
  from t join s4 using (domain, lang, source)),
e as (
  select *, unnest(range(0, full_ + case when cum <= rest and full_ < 3 then 1 else 0 end)) as epoch from x)
select doc_id, domain, lang, source, n_tokens, cast(epoch as integer) as epoch from e
"""
