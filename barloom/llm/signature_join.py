"""Exact Jaccard join of word shingles by signature trees.

A document's set is its distinct 5-word shingles, hashed to 64 bits. Equal sets are joined to one representative first.
Two sets at or above the threshold share a token among the first ``n - ceil(t * n) + 1`` of either, in any one order of
all tokens, so representatives meet in groups by such a token; groups of the same members are one. The order is that of
the hashes, with frequent tokens last: a passage that many documents share makes no group of them. Each member is compared
with its group's smallest one, which ties near copies together at one pair each. Groups that still hold several
components are parted by size and searched with signature trees: leaves hold a set's token bitmap and size, inner nodes the OR of the
bitmaps and the range of sizes, and a dual traversal leaves out pairs of nodes whose largest possible overlap is too
small or that lie in one component. Large groups are cut in blocks, and each pair of blocks is a task's work. Pairs
that are left are confirmed on the shingles of the whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, drop_staged, rolling, staged, word_hashes

WORDS = 5
PERCENT = 80
BLOCK = 2048
FANOUT = 8
FREQUENT = 8  # texts that have a token in front, from which it is frequent
MOST_FREQUENT = 1 << 20  # tokens called frequent at most, the most frequent ones: 8 MB


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of five lower-cased words; of all words if there are fewer."""
    a = word_hashes(text)
    if not len(a):
        return a
    h = rolling(a, min(WORDS, len(a)))
    return np.unique(h)


def front(h: np.ndarray, percent: int = PERCENT, last: np.ndarray | None = None) -> np.ndarray:
    """The tokens of which linked sets share one: the first by hash, those in ``last`` (sorted) after all others."""
    n = len(h) - -(-percent * len(h) // 100) + 1
    if last is None or not len(last) or not len(h):
        return h[:n]
    late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h
    return np.concatenate([h[~late], h[late]])[:n]


def bitmap(h: np.ndarray) -> np.ndarray:
    """Token bitmap of at least four bits a token, as 64-bit words; a power of two, so that wider ones fold."""
    wide = 1 << max(9, int(4 * max(len(h), 1) - 1).bit_length())
    spot = np.unique(h & np.uint64(wide - 1)).astype(np.int64)
    out = np.zeros(wide, np.uint8)
    out[spot] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap as it would be with so many words."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), 0)


def needed(a, b, percent: int = PERCENT):
    """Least overlap of two linked sets with so many elements."""
    return -(-percent * (a + b) // (100 + percent))


class _Tree:
    """Nodes level by level from the leaves: OR of bitmaps, range of sizes, most tokens that share a bit, components."""

    def __init__(self, sizes: np.ndarray, comps: np.ndarray, bits: np.ndarray):
        pop = np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, sizes - pop, comps, comps)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, more, first, last = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, 0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(more, at), np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)))


def _open(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether two nodes can hold a linked pair of different components."""
    can = (x[2][i] * 100 >= percent * y[1][j]) & (y[2][j] * 100 >= percent * x[1][i])
    can &= ~((x[4][i] == x[5][i]) & (y[4][j] == y[5][j]) & (x[4][i] == y[4][j]))
    at = np.flatnonzero(can)
    for s in range(0, len(at), 1 << 14):
        k = at[s : s + (1 << 14)]
        both = np.bitwise_count(x[0][i[k]] & y[0][j[k]]).sum(1, dtype=np.int64) + np.minimum(x[3][i[k]], y[3][j[k]])
        can[k] = both >= needed(x[1][i[k]], y[1][j[k]], percent)
    return can


def dual_search(sizes: np.ndarray, comps: np.ndarray, bitmaps: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that may be linked, of different components; with ``side``, only pairs of side 0 with side 1.

    Bitmaps of one width make a tree; each tree is searched against itself and those of other widths that sizes allow,
    the wider bitmaps folded.
    """
    width = np.array([len(b) for b in bitmaps])
    out = []
    for w in np.unique(width):
        narrow = np.flatnonzero(width == w)
        near = 100 * sizes[narrow].max() >= percent * sizes
        wide = np.flatnonzero((width > w) & near)
        own = np.stack([bitmaps[i] for i in narrow])
        sets = [(narrow, own, None if side is None else side[narrow])]
        if len(wide):
            both = np.concatenate([narrow, wide])
            bits = np.concatenate([own, np.stack([fold(bitmaps[i], int(w)) for i in wide])])
            which = (width[both] > w).astype(int)
            if side is None:
                sets.append((both, bits, which))
            else:
                for s in (0, 1):
                    keep = np.where(which == 1, side[both] == 1 - s, side[both] == s)
                    sets.append((both[keep], bits[keep], which[keep]))
        for at, bits, apart in sets:
            i, j = _dual(sizes[at], comps[at], bits, apart, percent)
            out.append((at[i], at[j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dual(sizes: np.ndarray, comps: np.ndarray, bits: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``dual_search`` over bitmaps of one width."""
    order = np.lexsort((bits[:, 0], comps, sizes))
    parts = [order] if side is None else [order[side[order] == 0], order[side[order] == 1]]
    if not all(len(p) for p in parts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    trees = [_Tree(sizes[p], comps[p], bits[p]) for p in parts]
    x, y = trees[0], trees[-1]
    level = max(len(x.levels), len(y.levels)) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        lx, ly = x.levels[min(level, len(x.levels) - 1)], y.levels[min(level, len(y.levels) - 1)]
        can = _open(lx, i, ly, j, percent)
        i, j = i[can], j[can]
        if level == 0:
            break
        level -= 1
        step = np.arange(FANOUT)
        if level < len(x.levels) - 1:
            i, j = np.repeat(i, FANOUT) * FANOUT + np.tile(step, len(i)), np.repeat(j, FANOUT)
            keep = i < len(x.levels[level][0])
            i, j = i[keep], j[keep]
        if level < len(y.levels) - 1:
            i, j = np.repeat(i, FANOUT), np.repeat(j, FANOUT) * FANOUT + np.tile(step, len(j))
            keep = j < len(y.levels[level][0])
            i, j = i[keep], j[keep]
        if side is None:
            keep = i <= j
            i, j = i[keep], j[keep]
    if side is None:
        keep = i < j
        i, j = i[keep], j[keep]
    return parts[0][i], parts[-1][j]


def frequent_tokens(docs: DataFrame, percent: int = PERCENT, least: int = FREQUENT, most: int = MOST_FREQUENT) -> np.ndarray:
    """Sorted tokens that ``least`` or more texts have in front. Of more than ``most``, ``least`` is doubled until they fit.

    Any set gives right links, as it only orders tokens. Counted over all texts; the driver gets at most ``most`` hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 512):
                got = [front(shingles(t.as_py()), percent) for t in b.column("text")[s : s + 512]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).view(np.int64))], ["key"])

    counts = staged(docs.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= least), "frequent")
    step = F.floor(F.log2(F.col("c") / least) + 1e-9).cast("int")
    steps = sorted(((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, lowest = 0, None
    for k, n in steps:
        total += n
        if total > most:
            break
        lowest = k
    if lowest is None:
        return np.zeros(0, np.uint64)
    keys = counts.where(step >= lowest).select("key").toArrow().column("key").to_numpy()
    return np.sort(keys.view(np.uint64))


def sketches(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n, f1, f2, prefix, bits`` of each row's whole text: size, fingerprint, prefix tokens, token bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs, percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, len(b), 512):
                part = b.slice(s, 512)
                n, f1, f2, prefix, bits = [], [], [], [], []
                for t in part.column("text"):
                    h = shingles(t.as_py())
                    n.append(len(h))
                    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    f1.append(int(h.sum(dtype=np.uint64)) - (1 << 63))
                    f2.append(int(np.bitwise_xor.reduce(mixed)) - (1 << 63) if len(h) else 0)
                    prefix.append(front(h, percent, sent.value).view(np.int64))
                    bits.append(bitmap(h).tobytes() if len(h) else b"")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], ["doc_id", "n", "f1", "f2", "prefix", "bits"])

    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, f1 long, f2 long, prefix array<long>, bits binary"), "sketches")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows with equal first columns, from sorted batches."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _members(sets: DataFrame) -> DataFrame:
    """``key, doc, hub`` of the groups of ``sets(doc_id, prefix)`` that share a token, groups of the same members once.

    Prefix tokens are most of what this search moves, so they are dealt out once: what is left behind the window, the tokens
    that two sets or more share, is small. ``hub`` is a group's smallest member.
    """
    posts = sets.select(F.explode("prefix").alias("key"), F.col("doc_id").alias("doc"))
    same = Window.partitionBy("key")
    # the digest is added behind the exchange, which then carries two numbers a token
    met = posts.repartition("key").withColumn("x", F.xxhash64("doc"))
    met = met.select("key", "doc", F.count("*").over(same).alias("c"), F.bit_xor("x").over(same).alias("x"), F.min("doc").over(same).alias("hub"))
    met = staged(met.where("c > 1"), "met")
    lists = met.where("doc = hub").groupBy("c", "x", "hub").agg(F.min("key").alias("key"))
    members = staged(met.select("key", "doc").join(lists.select("key", "hub"), "key"), "members")
    drop_staged(met)
    return members


def _by_size(placed: DataFrame, percent: int) -> DataFrame:
    """``placed(key, doc, comp, n)`` in the groups ``(key, g)`` that may hold links of two components, with size ``c``.

    Size classes are as wide as sizes of linked sets lie apart, so those are in one class or in neighbours; a set is in
    the group of its class and in the next one's, and groups in which none has that class are left out.
    """
    wide = max(math.log(100 / percent), 0.01) * 1.000001
    own = placed.withColumn("own", F.floor(F.log("n") / wide).cast("int"))
    own = own.withColumn("g", F.explode(F.array("own", F.col("own") + 1)))
    open_ = own.groupBy("key", "g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("own").alias("top"), F.count("*").alias("c"))
    return own.join(open_.where("lo < hi and top = g").select("key", "g", "c"), ["key", "g"]).select("key", "g", "c", "doc", "comp")


def _searched(members: DataFrame, percent: int) -> DataFrame:
    """Tree search in ``members(key, g, c, doc, comp, n, bits)``: candidate pairs ``(a, b)``, a > b."""
    cut = members.withColumn("k", F.ceil(F.col("c") / BLOCK).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("k")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    cut = cut.select("key", "g", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc", "comp", "n", "bits")

    def run(batches):
        a, b = [], []
        for rows in _groups(batches, 4):
            _, _, lo, hi, side, doc, comp, n, bits = zip(*rows, strict=True)
            comp = np.array(comp, np.int64)
            if len(rows) > 1 and comp.min() < comp.max():
                i, j = dual_search(np.array(n, np.int64), comp, [np.frombuffer(x, np.uint64) for x in bits], None if lo[0] == hi[0] else np.array(side), percent)
                ids = np.array(doc, np.int64)
                a.append(np.maximum(ids[i], ids[j]))
                b.append(np.minimum(ids[i], ids[j]))
            if sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return cut.repartition("key", "g", "lo", "hi").sortWithinPartitions("key", "g", "lo", "hi").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes, then bitmaps allow a link."""
    n, bits = sets.select("doc_id", "n"), sets.select("doc_id", "bits")
    sized = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").where(f"na * 100 >= {percent} * nb and nb * 100 >= {percent} * na")
    both = sized.join(bits.toDF("a", "x"), "a").join(bits.toDF("b", "y"), "b")

    def run(batches):
        for t in batches:
            keep = []
            for na, nb, x, y in zip(*(t.column(c).to_pylist() for c in ("na", "nb", "x", "y")), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(p), len(q))
                p, q = fold(p, w), fold(q, w)
                more = min(na - int(np.bitwise_count(p).sum()), nb - int(np.bitwise_count(q).sum()))
                keep.append(int(np.bitwise_count(p & q).sum()) + more >= needed(na, nb, percent))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, share: int = 500) -> DataFrame:
    """Pairs ``(a, b)`` that are linked by their whole texts. Texts meet by b, in parts of about ``share`` partners."""
    pairs = staged(pairs, "pairs")
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "pair_ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("k"))
    left = pairs.join(many, "b").select("b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("part"), F.lit(1).alias("side"), F.col("a").alias("id"))
    right = many.select("b", F.explode(F.expr("sequence(0, k - 1)")).alias("part"), F.lit(0).alias("side"), F.col("b").alias("id"))
    rows = left.union(right).join(texts, "id").select("b", "part", "side", "id", "text")

    def run(batches):
        at, sets = None, []
        for t in batches:
            a, b = [], []
            for hub, part, side, doc, text in zip(*(c for c in t.columns), strict=True):
                now = (hub.as_py(), part.as_py())
                if now != at:
                    at, sets = now, []
                h = shingles(text.as_py())
                if side.as_py() == 0:
                    sets.append(h)
                    continue
                for s in sets:
                    spot = np.minimum(np.searchsorted(s, h), max(len(s) - 1, 0))
                    common = int((s[spot] == h).sum()) if len(s) and len(h) else 0
                    if common and 100 * common >= percent * (len(s) + len(h) - common):
                        a.append(doc.as_py())
                        b.append(now[0])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return staged(rows.repartition("b", "part").sortWithinPartitions("b", "part", "side").mapInArrow(run, "a long, b long"), "links")


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``, links being a Jaccard similarity of ``percent`` or more.

    Null and empty texts have no shingles and stay alone. A null doc_id has its size and a null component. Rows that
    share a doc_id pool their links.
    """
    own = sketches(docs, percent)
    sizes = staged(own.select("doc_id", "n", "f1", "f2"), "sizes")
    some = sizes.where("n > 0 and doc_id is not null")
    reps = staged(some.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many")), "representatives")
    copies = some.join(reps.where("many > 1"), ["f1", "f2", "n"]).where("doc_id <> rep").select("doc_id")
    every = own.where("n > 0 and doc_id is not null").join(staged(copies.distinct(), "copies"), "doc_id", "left_anti")
    members = _members(every)
    sets = staged(every.select("doc_id", "n", "bits"), "sets")
    drop_staged(own)  # prefixes are the larger part of it
    tried = staged(members.where("doc <> hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct(), "tried")
    links = _confirmed(_possible(tried, sets, percent), docs, percent)
    first = staged(connected_components(links), "first").select(F.col("id").alias("doc"), "component")
    one = sets.select(F.col("doc_id").alias("doc"), "n", "bits")
    placed = members.join(first, "doc", "left").join(one.select("doc", "n"), "doc").select("key", "doc", F.coalesce("component", "doc").alias("comp"), "n")
    open_ = staged(_by_size(staged(placed, "placed"), percent), "open")
    found = _searched(open_.join(one, "doc"), percent).join(tried, ["a", "b"], "left_anti")
    more = _confirmed(found, docs, percent)
    tops = first.select(F.col("doc").alias("rep"), "component")
    if not more.isEmpty():  # components so far stand for the links that made them
        both = tops.select(F.col("rep").alias("a"), F.col("component").alias("b")).union(more)
        tops = staged(connected_components(both), "components").select(F.col("id").alias("rep"), "component")
    known = sizes.join(reps.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left").join(tops, "rep", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return known.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"))


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each component, columns unchanged; rows without an id stay.

    Of rows that share id and text one stays, that with the least other columns, compared as JSON.
    """
    gone = staged(components(docs, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    kept = docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")
    many = staged(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("many")), "many")
    if many.isEmpty():
        return kept
    again = kept.join(many, kept["doc_id"] == many["many"], "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct("*"), F.to_json(F.struct("*"))).alias("_row"))
    return kept.join(many, kept["doc_id"] == many["many"], "left_anti").unionByName(again.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns)))


#: The same result in DuckDB's SQL.
COMPONENTS_SQL = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w
  from documents),
s as (
  select distinct doc_id, hash(array_to_string(w[i:i + 4], ' ')) as h
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
sets as (select doc_id, md5(string_agg(h, ',' order by h)) as f from s group by doc_id),
rep as (select doc_id, min(doc_id) over (partition by f) as rep from sets),
r as (select s.* from s join rep using (doc_id) where doc_id = rep),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from r a join r b on a.h = b.h and a.doc_id <> b.doc_id group by all),
links as (
  select a, b from pairs join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) as (
  select distinct rep, rep from rep
  union
  select reach.a, links.b from reach join links on reach.b = links.a),
comp as (select a, min(b) as top from reach group by a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(comp.top, w.doc_id) as component_id
from w left join n using (doc_id) left join rep using (doc_id) left join comp on comp.a = rep.rep
"""
