"""Benchmark decontamination by a distributed positional inverted index.

Training tokens become postings ``(term, doc_id, pos)``. A test phrase starts from its rarest terms: their posting
lists, moved back by each term's offset, are intersected, and what survives is compared with the documents' words.
Common terms are never joined. Built from DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lowered, then runs of digits, a-z and everything past ASCII. Null gives no words."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), ""), F.array().cast("array<string>"))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", words(F.col("text")).alias("w"))


def build_index(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Store postings ``(term, doc_id, pos)`` of all tokens, or of the tokens in ``terms(term)``.

    The table lies in the shared folder. Rows sharing a doc_id are one document's postings; null texts have none.
    """
    at = _tokens(docs).select("doc_id", F.posexplode("w").alias("pos", "term"))
    if terms is not None:
        at = at.join(terms.select("term").distinct(), "term", "left_semi")
    return staged(at.select("term", "doc_id", "pos"), "postings")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, n)``: how often each of ``terms`` stands in the documents; counted over all, absent terms missing."""
    return _tokens(docs).select(F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 0) -> DataFrame:
    """Exact matches of phrases of ``items(item_id, text)``: ``(doc_id, start, n, item_ids)``.

    The phrases are an item's windows of ``size`` words, or the whole item where that is 0 or more than it has. Each
    phrase's two rarest terms lead: postings are moved back by the term's offset in the item, so that lists meet on
    ``(doc_id, item, diagonal)``, and a phrase goes on where both are on one diagonal. What is left is compared word by
    word with the texts of the documents found so. A phrase with a term that no document has is dropped at once; items
    without words match nothing; items of the same words are one.
    """
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    whole = staged(w.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).withColumn("item", F.xxhash64("w")), "items")
    counts = staged(term_counts(docs, whole.select(F.explode("w").alias("term"))), "counts")
    n = f"least(size(w), {size})" if size else "size(w)"
    windows = whole.select("item", "item_ids", F.expr(n).alias("n"), F.explode(F.expr(f"sequence(0, size(w) - {n})")).alias("s"), "w")
    windows = windows.select("item", "item_ids", "n", "s", F.expr("slice(w, s + 1, n)").alias("phrase"))
    by = (
        windows.select("item", "s", "n", F.posexplode("phrase").alias("i", "term"))
        .join(counts.withColumnRenamed("n", "df"), "term")
        .groupBy("item", "s", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "term", (F.col("s") + F.col("i")).alias("off")))).alias("by"))
        .where("size(by) = n")
        .select("item", "s", F.expr("slice(by, 1, 2)").alias("by"))
    )
    lead = staged(windows.join(by, ["item", "s"]), "phrases")
    anchors = staged(lead.select("item", F.explode("by").alias("x")).select("item", "x.term", "x.off").distinct(), "anchors")
    index = build_index(docs, anchors)
    lists = index.join(anchors, "term").select("doc_id", "item", (F.col("pos") - F.col("off")).alias("diagonal"), "off")
    met = lists.groupBy("doc_id", "item", "diagonal").agg(F.collect_set("off").alias("offs"))
    found = met.join(lead, "item").where("diagonal + s >= 0 and forall(by, x -> array_contains(offs, x.off))").select("doc_id", (F.col("diagonal") + F.col("s")).alias("start"), "phrase", "item_ids")
    found = staged(found, "candidates")
    ids = staged(found.select("doc_id").distinct(), "candidate_ids")
    texts = docs.select(F.col("doc_id").alias("own"), "text")
    texts = texts.join(ids, texts["own"].eqNullSafe(ids["doc_id"]), "left_semi").select("own", words(F.col("text")).alias("w"))
    both = found.join(texts, found["doc_id"].eqNullSafe(texts["own"])).where("slice(w, start + 1, size(phrase)) = phrase")
    return both.select("doc_id", "start", F.size("phrase").alias("n"), "item_ids")


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """Documents in which all of a phrase's terms stand within ``span`` consecutive words, in any order.

    ``phrases(item_id, phrase)``; returns ``(item_id, doc_id, start)``, the start of each tightest place around a
    posting of the rarest term. Lists meet on the document and on ``pos div span``, so far-apart postings never pair.
    """
    phrases = staged(phrases.where("size(phrase) > 0").select("item_id", F.array_distinct("phrase").alias("phrase")).distinct(), "near")
    spread = phrases.select("item_id", F.size("phrase").alias("k"), F.explode("phrase").alias("term"))
    index = build_index(docs, spread)
    counts = index.groupBy("term").agg(F.count("*").alias("n"))
    rarest = spread.join(counts, "term").groupBy("item_id", "k").agg(F.min(F.struct("n", "term")).alias("r"), F.count("*").alias("found")).where("found = k").select("item_id", "k", F.col("r.term").alias("term"))
    anchor = index.join(rarest, "term").select("item_id", "k", "doc_id", F.col("pos").alias("at"), F.explode(F.expr(f"sequence(pos div {span} - 1, pos div {span} + 1)")).alias("cell"))
    other = index.join(spread.drop("k"), "term").withColumn("cell", F.expr(f"pos div {span}"))
    near = anchor.join(other, ["item_id", "doc_id", "cell"]).where(F.abs(F.col("pos") - F.col("at")) < span)
    held = near.groupBy("item_id", "k", "doc_id", "at").agg(F.collect_set(F.struct("pos", "term")).alias("p"))
    start = F.expr(f"array_min(filter(transform(p, x -> x.pos), s -> s <= at and size(array_distinct(transform(filter(p, y -> y.pos >= s and y.pos < s + {span}), y -> y.term))) = k))")
    return held.select("item_id", "doc_id", start.alias("start")).where("start is not null").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it stands inside an occurrence of a window of ``size`` item words. Null or empty texts have no
    words and no hits; null doc_ids count as one id; rows that share a doc_id share their hits, and each is returned.
    """
    found = staged(phrase_matches(docs, items, size), "matches").distinct()
    # the length of the union of occurrences, in order of their starts
    covered = """aggregate(array_sort(collect_set(struct(start, start + n as stop))), named_struct('n', 0L, 'to', -1L),
      (a, x) -> named_struct('n', a.n + greatest(0L, x.stop - greatest(a.to, x.start)), 'to', greatest(a.to, cast(x.stop as bigint)))).n"""
    hits = found.groupBy("doc_id").agg(
        F.expr(covered).cast("long").alias("n_hit"),
        F.expr("array_distinct(flatten(collect_set(item_ids)))").alias("items"),
    )
    hits = hits.withColumnRenamed("doc_id", "hit_id")
    base = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(hits, base["doc_id"].eqNullSafe(hits["hit_id"]), "left")
    ids = F.coalesce(F.col("items"), F.array().cast("array<bigint>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ids.cast("array<string>")), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The documents without a hit word, columns unchanged; rows that share a doc_id go or stay together."""
    bad = staged(phrase_matches(docs, items, size).select(F.col("doc_id").alias("bad_id")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


#: The same result in DuckDB's SQL.
DECONTAMINATE_SQL = r"""
with dw as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents),
iw as (
  select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from benchmark),
win as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select item_id, w, least(len(w), 10) as n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from iw where len(w) > 0)),
ns as (select distinct n from win),
runs as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as phrase
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, ns where len(w) >= n)),
hit as (select doc_id, i, n, item_id from runs join win using (n, phrase)),
per as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct doc_id, cast(item_id as varchar) as item_id from hit) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join per using (doc_id) left join its using (doc_id)
"""
