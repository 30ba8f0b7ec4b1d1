"""Entries that already say what a claim says: shared price levels and shared words, by inverted indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.places import stored

LEVEL_WEIGHT, TERM_WEIGHT = 3.0, 10.0
#: Words that a containment is measured against at least.
FLOOR = 8
LEAST = 3.0
TOP = 3
LEAST_LEVEL = 100.0
#: Entries that hold a level from which it is looked at last, and only for claims that it can still help.
COMMON = 1000
# fixed values: words of no content, and the band in which a bare number is a year
STOPWORDS = ("also", "been", "from", "have", "into", "here", "just", "more", "much", "only", "over", "same", "such", "than", "that", "them", "then", "they", "this", "very", "were", "what", "when", "which", "will", "with", "your")
YEARS = (1900, 2099)
# fixed values: addresses, dates, years after a month's name and percentages, which hold no levels
ADDRESS = r"(?i)https?://\S+"
NO_LEVELS = (ADDRESS, r"\d{4}-\d{2}-\d{2}", r"(?i)\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:\d{1,2}(?:st|nd|rd|th)?,?\s+)?\d{4}\b", r"\d+(?:\.\d+)?\s*%")
NUMBER = r"\d[\d,]*(?:\.\d+)?(?:\s*[kK])?"
TERM = "[a-z]{4,}"
#: Begins a level among words.
LEVEL = "#"


def levels(text: Column) -> Column:
    """The price levels in a text, each once, in order: ``28k``, ``1,982.10``; null has none.

    No levels are numbers of addresses, dates and percentages, bare whole numbers that can be years, and what is under 100.
    """
    t = F.coalesce(text, F.lit(""))
    for pattern in NO_LEVELS:
        t = F.regexp_replace(t, pattern, " ")

    def value(x: Column) -> Column:
        n = F.regexp_replace(x, r"[,\s]|[kK]", "").try_cast("double")
        thousands = x.rlike("[kK]$")
        year = ~thousands & n.between(*YEARS) & ~x.rlike("[,.]")
        return F.when(thousands, n * 1000).when(~year, n)

    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)), value), lambda x: x >= LEAST_LEVEL)))


def terms(text: Column) -> Column:
    """The words of four letters or more in a text, each once, without those of no content; null has none."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), ADDRESS, " "))
    return F.array_except(F.array_distinct(F.regexp_extract_all(t, F.lit(TERM), F.lit(0))), F.array(*map(F.lit, STOPWORDS)))


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def _scored(pairs: DataFrame) -> DataFrame:
    n = F.greatest(F.least("a_size", "b_size"), F.lit(FLOOR))
    return pairs.withColumns({"n_levels": _shared("a_levels", "b_levels"), "n_terms": _shared("a_terms", "b_terms")}).withColumn("score", LEVEL_WEIGHT * F.col("n_levels") + TERM_WEIGHT * F.col("n_terms") / n)


def _best(scored: DataFrame, top: int) -> DataFrame:
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def find_similar(claims: DataFrame, entries: DataFrame, top: int = TOP, least: float = LEAST, common: int = COMMON) -> DataFrame:
    """``claim_id, entry_id, rank, score, n_levels, n_terms``: for each claim the ``top`` entries that say most of it already.

    Both tables have ``id, text``. The score is 3 a shared level and 10 times the shared words over the smaller set's size, 8 at
    least; entries under ``least`` don't count, ties go to the smaller id.

    Nothing is compared with everything. Texts are read once: of an entry no more is kept than the levels and words that some
    claim has, and its number of words; entries alike in these are one. Pairs come from two indexes of what is kept.
    Words: a pair without a shared level needs a share of the smaller set's words, so that set is only looked up by its rarest
    words, as many as leave too few others; words that no claim has are the rarest. Levels: those that at most ``common``
    entries hold are looked up first; what a claim has found by then tells whether common levels can still bring it an entry
    among the best, and only such claims meet them.
    """
    share = least / TERM_WEIGHT
    need = lambda size: F.ceil(F.greatest(size, F.lit(FLOOR)) * share - 1e-9)
    mark = lambda x: F.concat(F.lit(LEVEL), x.cast("string"))
    is_level = lambda x: x.startswith(LEVEL)

    a_rows = claims.where("id is not null").select("id", F.transform(levels(F.col("text")), mark).alias("levels"), F.array_sort(terms(F.col("text"))).alias("terms"))
    a_rows = stored(a_rows.where("size(levels) + size(terms) > 0"), "claims")
    a = a_rows.groupBy("levels", "terms").agg(F.min("id").alias("a")).select("a", F.size("terms").alias("a_size"), F.col("levels").alias("a_levels"), F.col("terms").alias("a_terms"))

    asked = a.select(F.explode(F.concat("a_levels", "a_terms")).alias("item")).distinct()
    rows = entries.where("id is not null").select("id", F.monotonically_increasing_id().alias("row"), F.transform(levels(F.col("text")), mark).alias("levels"), terms(F.col("text")).alias("terms"))
    items = rows.select("id", "row", F.size("terms").alias("b_size"), F.explode(F.concat("levels", "terms")).alias("item")).join(asked, "item", "left_semi")
    kept = items.groupBy("row", "id", "b_size").agg(F.array_sort(F.collect_list("item")).alias("items"))
    kept = kept.select("id", "b_size", F.filter("items", is_level).alias("b_levels"), F.filter("items", lambda x: ~is_level(x)).alias("b_terms"))
    kept = kept.where((F.size("b_levels") > 0) | (F.size("b_terms") >= need(F.lit(0))))
    # of equal entries no more than the best can be among the best
    b = kept.groupBy("b_size", "b_levels", "b_terms").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    b = stored(b.select(F.col("ids")[0].alias("b"), F.slice("ids", 1, top).alias("b_ids"), "b_size", "b_levels", "b_terms"), "entries")

    held = b.select(F.explode("b_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_held"))

    def rarest(t: DataFrame, key: str) -> DataFrame:
        words = t.select(key, f"{key}_size", F.size(f"{key}_terms").alias("n"), F.explode(f"{key}_terms").alias("term")).join(held, "term", "left")
        at = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("n_held", F.lit(0)), "term"))
        return words.withColumn(f"{key}_rare", at <= F.col("n") - need(F.col(f"{key}_size")) + 1).select(key, f"{key}_size", "term", f"{key}_rare")

    met = rarest(a, "a").join(rarest(b, "b"), "term").where("if(a_size <= b_size, a_rare, b_rare)").select("a", "b")

    a_level, b_level = a.select("a", F.explode("a_levels").alias("level")), b.select("b", F.explode("b_levels").alias("level"))
    n_level = b_level.groupBy("level").agg(F.count("*").alias("n_held"))
    usual, rare = n_level.where(F.col("n_held") > common).select("level"), n_level.where(F.col("n_held") <= common).select("level")
    by_rare = a_level.join(rare, "level", "left_semi").join(b_level, "level").select("a", "b")

    def scored(pairs: DataFrame) -> DataFrame:
        """The best of some pairs, each once; pairs go to their entries, whose sets then move no more."""
        x = pairs.repartition("b").distinct().join(b, "b").join(a, "a")
        return _best(_scored(x).where(F.col("score") >= least).select("a", "b", "b_ids", "score", "n_levels", "n_terms"), top)

    first = stored(scored(met.union(by_rare)), "found")

    # what common levels alone can bring: their number, and fewer words than would have been found
    third = first.where(F.col("rank") == top).select("a", F.col("score").alias("bar"))
    most = a_level.join(usual, "level", "left_semi").groupBy("a").agg((F.count("*") * LEVEL_WEIGHT + least).alias("most"))
    open_ = most.join(third, "a", "left").where("bar is null or bar < most").select("a")
    late = a_level.join(open_, "a", "left_semi").join(usual, "level", "left_semi").join(b_level, "level").select("a", "b")

    pairs = first.union(scored(late)).drop("rank").distinct().withColumn("b", F.explode("b_ids")).drop("b_ids")
    same = a_rows.groupBy("levels", "terms").agg(F.min("id").alias("a"), F.collect_list("id").alias("claim_ids")).select("a", "claim_ids")
    return _best(pairs, top).join(same, "a").select(F.explode("claim_ids").alias("claim_id"), F.col("b").alias("entry_id"), "rank", F.round("score", 3).alias("score"), "n_levels", "n_terms")
