"""Substring dedup by collinear chaining of shared k-mer seeds.

Seeds are the minimisers of windows of word 8-grams: two texts that share 23 words in a row share one. Each repeated
seed points to the first document that has it, each of its places to all places there, so a seed of n documents links
n - 1 pairs and not all. Per pair of documents, anchors are chained in both orders with a cost for gaps, the best
predecessor coming from a Fenwick tree. Chains are aligned on the words themselves and go on past words that differ, up
to ``MARGIN`` words beyond the outer anchors; they are cut where over ``BRIDGE`` words in a row have no partner, so that
words of a document's own between two repeats stay its own. Stretches of ``MIN_WORDS`` or more words that one earlier document has are
repeated passages. Where several documents have as many words only together, the span is chained again with each of
these documents and with the first that has the same ``MIN_WORDS`` words in a row in such a span.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import rolling, staged, word_hashes

K = 8
WINDOW = 16
GAP_COST = 0.1
MIN_CHAIN = 12
MIN_WORDS = 50
IDENTITY = 0.8
SHARE = 500
MARGIN = 64  # words that an alignment may add at either end
MISS = 2  # matching words that make up for one that differs, beyond the outer anchors
DROP = 12  # how far that balance may fall before an end is given up
BRIDGE = 16  # words in a row that may differ, or be missing on one side, within a stretch
PAIRS = 1024  # anchors of two documents from which each place points to one place only
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """Places of the first smallest value in each run of ``window`` values, each once: minima of runs, twice as long at each step."""
    at, n = np.arange(len(h)), 1
    while n < window:
        step = min(n, window - n)
        later = h[step:] < h[:-step]
        h, at, n = np.where(later, h[step:], h[:-step]), np.where(later, at[step:], at[:-step]), n + step
    return at[np.append(True, at[1:] != at[:-1])]


def minimisers(text: str | None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each seed, once, and the word positions of all: those of seed i are ``at[cut[i] : cut[i + 1]]``."""
    h = rolling(word_hashes(text), k)
    if not len(h):
        return h, np.zeros(1, np.int64), np.zeros(0, np.int64)
    at = window_minima(h, min(window, len(h)))
    order = np.argsort(h[at], kind="stable")
    seed, at = h[at][order], at[order]
    new = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]]))
    return seed[new], np.append(new, len(seed)), at


def anchors(seeds: list[tuple[list[int], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Anchors (x, y) of two documents, from the places of each seed in both.

    All pairs of places, unless they are more than ``PAIRS`` and than the places: then each place in the first document
    points to the place in the second that goes with the longest common run of seeds around it.
    """
    if sum(len(xs) * len(ys) for xs, ys in seeds) <= max(PAIRS, sum(len(xs) + len(ys) for xs, ys in seeds)):
        pairs = sorted({(x, y) for xs, ys in seeds for x in xs for y in ys})
        return np.array([x for x, _ in pairs], np.int64), np.array([y for _, y in pairs], np.int64)
    mine = sorted((x, i) for i, (xs, _) in enumerate(seeds) for x in xs)
    other = sorted((y, i) for i, (_, ys) in enumerate(seeds) for y in ys)
    # a suffix automaton of the second document's seeds, with the first end of each state
    link, size, end, step, last = [-1], [0], [-1], [{}], 0
    for j, (_, s) in enumerate(other):
        cur, p = len(size), last
        link.append(0), size.append(size[last] + 1), end.append(j), step.append({})
        while p >= 0 and s not in step[p]:
            step[p][s], p = cur, link[p]
        if p >= 0:
            q = link[cur] = step[p][s]
            if size[p] + 1 < size[q]:
                new = len(size)
                link.append(link[q]), size.append(size[p] + 1), end.append(end[q]), step.append(dict(step[q]))
                while p >= 0 and step[p].get(s) == q:
                    step[p][s], p = new, link[p]
                link[q] = link[cur] = new
        last = cur
    runs, v, n = [], 0, 0
    for i, (_, s) in enumerate(mine):
        while v and s not in step[v]:
            v = link[v]
            n = size[v]
        v, n = step[v][s], n + 1
        if runs and n == runs[-1][0] + 1:
            runs.pop()
        runs.append((n, i, end[v]))
    # longest runs first; of equal ones that overlap, as few as cover them, so that places follow each other in step
    to = np.full(len(mine), -1, np.int64)
    for n, group in itertools.groupby(sorted(runs, key=lambda r: (-r[0], r[1])), key=lambda r: r[0]):
        ends = [(i, j) for _, i, j in group]
        done, at = -1, 0
        while at < len(ends):
            first = max(ends[at][0] - n + 1, done + 1)
            while at + 1 < len(ends) and ends[at + 1][0] - n + 1 <= first:
                at += 1
            i, j = ends[at]
            part = np.arange(first, i + 1)
            part = part[to[part] < 0]
            to[part] = j - i + part
            done, at = i, at + 1
    return np.array([x for x, _ in mine], np.int64), np.array([y for y, _ in other], np.int64)[to]


def chains(x: np.ndarray, y: np.ndarray, k: int = K, cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of the anchors (x, y): lists of indexes, best first, no anchor in two.

    An anchor's score is k plus the best of nothing and any earlier anchor's score less ``cost`` for each word of the
    gap on both sides. As that cost is linear, the best predecessor is a prefix maximum over y in a Fenwick tree. Anchors
    that all follow each other, with gaps that cost less than an anchor gains, are one chain.
    """
    x, y = x.tolist(), y.tolist()
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    if order and all(x[i] < x[j] and y[i] < y[j] and cost * (x[j] - x[i] + y[j] - y[i]) < k for i, j in itertools.pairwise(order)):
        return [order]
    rank = {v: i + 1 for i, v in enumerate(sorted(set(y)))}
    size = len(rank)
    best, arg = [-math.inf] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    for _, column in itertools.groupby(order, key=x.__getitem__):
        column = list(column)
        for a in column:
            r, top, at = rank[y[a]] - 1, -math.inf, -1
            while r > 0:
                if best[r] > top or best[r] == top and arg[r] > at:
                    top, at = best[r], arg[r]
                r -= r & -r
            gain = top - cost * (x[a] + y[a])
            if gain > 0:
                score[a], back[a] = k + gain, at
            else:
                score[a] = k
        for a in column:
            r, own = rank[y[a]], score[a] + cost * (x[a] + y[a])
            while r <= size:
                if own > best[r] or own == best[r] and a > arg[r]:
                    best[r], arg[r] = own, a
                r += r & -r
    used, out = [False] * len(x), []
    for a in sorted(range(len(x)), key=lambda i: -score[i]):
        path = []
        while a >= 0 and not used[a]:
            used[a] = True
            path.append(a)
            a = back[a]
        if path:
            out.append(path[::-1])
    return out


def parted(x: list[int], y: list[int], chain: list[int], k: int = K) -> Iterator[list[int]]:
    """A chain, cut where the gap to the next seed is too long for any alignment to go over it."""
    begin, far = 0, 2 * MARGIN + BRIDGE + k
    for n, (i, j) in enumerate(itertools.pairwise(chain), 1):
        if x[j] - x[i] > far or y[j] - y[i] > far:
            yield chain[begin:n]
            begin = n
    yield chain[begin:]


def needed(x: np.ndarray, y: np.ndarray, found: list[list[int]], k: int = K) -> Iterator[list[int]]:
    """Parts of chains, best first, without those whose words in x all lie in close runs of earlier ones, no run shorter.

    In a close run seeds follow each other in step within a window, so it is one stretch. Such words repeat the same
    document there already, over as many words, and another place in y adds none.
    """
    x, y = x.tolist(), y.tolist()
    rank = {v: i for i, v in enumerate(sorted(set(x)))}
    over, after = [-1] * len(rank), [-1] * len(rank)  # the longest run over each place of x, and on to the next place
    for n, chain in enumerate(found):
        for c in parted(x, y, chain, k):
            lo, hi, span = rank[x[c[0]]], rank[x[c[-1]]], x[c[-1]] - x[c[0]]
            if over[lo] >= span and min(over[lo : hi + 1]) >= span and (hi == lo or min(after[lo:hi]) >= span):
                continue
            yield c
            if n == len(found) - 1:
                continue
            begin = 0
            for m in range(1, len(c) + 1):
                if m < len(c) and x[c[m]] - x[c[m - 1]] == y[c[m]] - y[c[m - 1]] <= WINDOW:
                    continue
                lo, hi, span = rank[x[c[begin]]], rank[x[c[m - 1]]], x[c[m - 1]] - x[c[begin]]
                for r in range(lo, hi + 1):
                    if over[r] < span:
                        over[r] = span
                    if r < hi and after[r] < span:
                        after[r] = span
                begin = m


def segments(p: list[bytes], q: list[bytes], anchors: list[tuple[int, int]], k: int = K) -> list[tuple[int, int, int, int, int]]:
    """Start and end in p and q and matching words of each stretch of a chain that holds together.

    Both ends of each gap between seeds go on past words that differ. Where they come within ``BRIDGE`` words of each
    other, in p and in q, the gap belongs to the stretch; else the chain is cut there and the words between are nobody's.
    A stretch of too few matching words is cut at its worst gap. Its outer ends go on past words that differ; if that
    makes too few words match, over equal words only.
    """
    runs: list[list[int]] = []  # start and end in p, and in q, of equal words
    for x, y in anchors:
        if runs and (x + k <= runs[-1][1] or y + k <= runs[-1][3]):
            continue
        step = max(runs[-1][1] - x, runs[-1][3] - y, 0) if runs else 0  # seeds that overlap go on from where the last one ended
        if runs and x + step == runs[-1][1] and y + step == runs[-1][3]:
            runs[-1][1], runs[-1][3] = x + k, y + k
        else:
            runs.append([x + step, x + k, y + step, y + k])
    gaps = [_bridge(p[a[1] : b[0]], q[a[3] : b[2]]) for a, b in itertools.pairwise(runs)]
    out, parts = [], []
    first = 0
    for i in range(len(runs)):
        if i == len(gaps) or gaps[i] is None:
            parts.append((first, i))
            first = i + 1
    while parts:
        lo, hi = parts.pop()
        x0, x1, y0, y1 = runs[lo][0], runs[hi][1], runs[lo][2], runs[hi][3]
        same = sum(r[1] - r[0] for r in runs[lo : hi + 1]) + sum(g[1] for g in gaps[lo:hi])
        if same < IDENTITY * max(x1 - x0, y1 - y0):
            worst = max(range(lo, hi), key=lambda i: gaps[i][0])
            parts += [(lo, worst), (worst + 1, hi)]
            continue
        before = (runs[lo - 1][1], runs[lo - 1][3]) if lo else (0, 0)
        after = (runs[hi + 1][0], runs[hi + 1][2]) if hi + 1 < len(runs) else (len(p), len(q))
        head = _reach(p[max(before[0], x0 - MARGIN) : x0][::-1], q[max(before[1], y0 - MARGIN) : y0][::-1])
        tail = _reach(p[x1 : min(after[0], x1 + MARGIN)], q[y1 : min(after[1], y1 + MARGIN)])
        for (a, b, m), (c, d, n) in zip(head, tail, strict=True):
            got = (x0 - a, x1 + c, y0 - b, y1 + d, same + m + n)
            if got[4] >= IDENTITY * max(got[1] - got[0], got[3] - got[2]):
                break
        out.append(got)
    return sorted(out)


def _bridge(p: list[bytes], q: list[bytes]) -> tuple[int, int] | None:
    """Words that differ and that match over a gap between two seeds; None if its ends stay too far apart."""
    if p == q:
        return 0, len(p)
    (a, b, m), _ = _reach(p[:MARGIN], q[:MARGIN])
    (c, d, n), _ = _reach(p[-MARGIN:][::-1], q[-MARGIN:][::-1])
    if max(len(p) - a - c, len(q) - b - d) > BRIDGE:
        return None
    same = m + n if a + c <= len(p) and b + d <= len(q) else _common(p, q)
    return max(len(p), len(q)) - same, same


def _reach(p: list[bytes], q: list[bytes]) -> tuple[tuple[int, int, int], tuple[int, int, int]]:
    """Words of p, of q and matching ones of the best alignment of two beginnings, and of the one without a difference.

    Furthest places on each diagonal by number of differences. The balance is the mean of both lengths less 1 + ``MISS``
    a difference; places that lie more than ``DROP`` under the best one are left.
    """
    best, plain, front, d = (0.0, 0, 0, 0), None, {0: (0, 0)}, 0
    m, n = len(p), len(q)
    while front:
        after: dict[int, tuple[int, int]] = {}
        for k, (x, same) in front.items():
            y = x - k
            if x < m and y < n and p[x] == q[y]:
                begin, x, y = x, x + 1, y + 1
                while x < m and y < n and p[x] == q[y]:
                    x, y = x + 1, y + 1
                same += x - begin
            if plain is None:
                plain = (x, y, same)
            score = (x + y) / 2 - (1 + MISS) * d
            if score >= best[0]:
                best = max(best, (score, x, y, same))
            elif score - MISS < best[0] - DROP:
                continue
            if x < m:
                to = (x + 1, same)
                if y < n and (k not in after or to > after[k]):
                    after[k] = to
                if k + 1 not in after or to > after[k + 1]:
                    after[k + 1] = to
            if y < n:
                to = (x, same)
                if k - 1 not in after or to > after[k - 1]:
                    after[k - 1] = to
        front, d = after, d + 1
    return best[1:], plain


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Words that a best alignment of two short runs matches."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _stream(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _slices(asks: DataFrame, docs: DataFrame) -> DataFrame:
    """``asks(id, doc, src, x0, y0, lo, hi)`` with ``words``: words lo to hi of the text of ``id``, lower-cased.

    Texts go to their askers in parts of about ``SHARE``, so that no text draws all; the join is of one kind at every
    size, a merge of both sides.
    """
    many = staged(asks.groupBy("id").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("k")), "askers")
    rows = asks.join(many, "id").withColumn("part", F.pmod(F.xxhash64("doc", "src", "x0", "y0"), F.col("k")).cast("int")).select("id", "part", F.lit(1).alias("side"), F.lit(None).cast("string").alias("text"), "doc", "src", "x0", "y0", "lo", "hi")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(many.hint("merge"), "id")
    texts = texts.select("id", F.explode(F.expr("sequence(0, k - 1)")).alias("part"), F.lit(0).alias("side"), "text", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns[4:]))

    def run(batches):
        at, words, out, size = None, [], [], 0
        for id_, part, side, text, *ask in (r for g in _stream(batches, 3) for r in g):
            if side == 0:
                if at != (id_, part):
                    at, words = (id_, part), (text or "").encode("utf-8", "surrogatepass").lower().split()
                continue
            got = b" ".join(words[ask[4] : ask[5]]) if at == (id_, part) else b""
            out.append((id_, *ask[:5], got))
            size += len(got)
            if size > 4 << 20:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(out):
        kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "doc", "src", "x0", "y0", "lo", "words"])

    return rows.unionByName(texts).repartition("id", "part").sortWithinPartitions("id", "part", "side").mapInArrow(run, "id long, doc long, src long, x0 int, y0 int, lo int, words binary")


def _posts(docs: DataFrame) -> DataFrame:
    """``seed, doc, pos``: a document's places of each seed."""

    def seeds(batches):
        for b in batches:
            for s in range(0, len(b), 256):
                doc, seed, pos, cuts, n = [], [], [], [np.zeros(1, np.int64)], 0
                for d, t in zip(b.column("doc_id")[s : s + 256].to_pylist(), b.column("text")[s : s + 256], strict=True):
                    h, cut, at = minimisers(t.as_py())
                    doc.append(np.full(len(h), d, np.int64))
                    seed.append(h.view(np.int64))
                    pos.append(at)
                    cuts.append(cut[1:] + n)
                    n += len(at)
                if doc:
                    places = pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(np.concatenate(pos).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seed)), pa.array(np.concatenate(doc)), places], ["seed", "doc", "pos"])

    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return staged(base.mapInArrow(seeds, "seed long, doc long, pos array<int>"), "seeds")


def repeats(docs: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Aligned stretches: ``doc, src, start, stop, src_start, src_stop, same``, in words, src being an earlier id.

    Texts are null-safe; rows without an id or with under 8 words have no seeds. Rows that share an id are taken for
    one document: seeds are pooled and the first of their texts is aligned. Repeats inside one document are not sought.
    """
    posts = _posts(docs) if posts is None else posts
    shared = staged(posts.groupBy("seed").agg(F.min("doc").alias("src"), F.max("doc").alias("top")).where("src < top").select("seed", "src"), "shared")
    known = staged(posts.join(shared, "seed"), "anchors")
    first = known.where("doc = src").groupBy("seed").agg(F.array_distinct(F.flatten(F.collect_list("pos"))).alias("src_pos"))
    return _stretches(known.where("doc <> src").join(first, "seed").select("doc", "src", "seed", "pos", "src_pos"), docs)


def _stretches(links: DataFrame, docs: DataFrame) -> DataFrame:
    """What ``repeats`` gives, from ``doc, src, seed, pos, src_pos``."""

    def chain(batches):
        rows = []
        for group in _stream(batches, 2):
            places: dict[int, tuple[set, set]] = {}
            for _, _, seed, xs, ys in group:
                mine, other = places.setdefault(seed, (set(), set()))
                mine.update(xs), other.update(ys)
            x, y = anchors(list(places.values()))
            for c in needed(x, y, chains(x, y)):
                rows.append({"doc": group[0][0], "src": group[0][1], "x0": int(x[c[0]]), "y0": int(y[c[0]]), "xs": x[c].tolist(), "ys": y[c].tolist()})
            if len(rows) > 2000:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    kind = pa.schema([("doc", pa.int64()), ("src", pa.int64()), ("x0", pa.int32()), ("y0", pa.int32()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32()))])
    # chains cost time and not bytes, by which adaptive execution would put them in few tasks
    many = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = staged(links.repartition(many, "doc", "src").sortWithinPartitions("doc", "src", "seed").mapInArrow(chain, "doc long, src long, x0 int, y0 int, xs array<int>, ys array<int>"), "chains")

    chain_key = ["doc", "src", "x0", "y0"]
    span = lambda at: [F.greatest(F.col(at)[0] - MARGIN, F.lit(0)).alias("lo"), (F.element_at(at, -1) + K + MARGIN).alias("hi")]
    asks = linked.select(F.col("doc").alias("id"), *chain_key, *span("xs")).union(linked.select(F.col("src").alias("id"), *chain_key, *span("ys")))
    cut = staged(_slices(asks, docs), "slices")
    p, q = (cut.where(f"id = {c}").select(*chain_key, F.col("lo").alias(f"{c}_lo"), F.col("words").alias(f"{c}_words")) for c in ("doc", "src"))
    known = linked.join(p, chain_key).join(q, chain_key)

    def align(batches):
        for b in batches:
            rows = []
            for doc, src, xs, ys, x_lo, p, y_lo, q in zip(*(b.column(c).to_pylist() for c in ("doc", "src", "xs", "ys", "doc_lo", "doc_words", "src_lo", "src_words")), strict=True):
                p, q = p.split(), q.split()
                pairs = [(x - x_lo, y - y_lo) for x, y in zip(xs, ys, strict=True)]
                if any(p[x : x + K] != q[y : y + K] or len(p[x : x + K]) < K for x, y in pairs):
                    continue  # texts that share an id
                for start, stop, c, d, same in segments(p, q, pairs):
                    if stop - start >= MIN_CHAIN and same >= IDENTITY * max(stop - start, d - c):
                        rows.append((doc, src, start + x_lo, stop + x_lo, c + y_lo, d + y_lo, same))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc", "src", "start", "stop", "src_start", "src_stop", "same"])

    return staged(known.mapInArrow(align, "doc long, src long, start long, stop long, src_start long, src_stop long, same long"), "stretches")


def _merged(stretches: DataFrame) -> DataFrame:
    """``doc, start, stop, srcs, same`` of stretches of a document that touch, or lie within three words.

    A stretch begins a new one where it starts over three words behind the furthest end so far: one sort a document, and no
    list of all its stretches. ``same`` is the most matching words that one of the stretches has.
    """
    up = Window.partitionBy("doc").orderBy("start", "stop", "src")
    far = F.max("stop").over(up.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start") <= far + 3, 0).otherwise(1)
    parts = stretches.withColumn("_new", new).withColumn("_part", F.sum("_new").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    got = parts.groupBy("doc", "_part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.collect_set("src").alias("srcs"), F.max("same").alias("same"))
    return got.select("doc", "start", "stop", "srcs", "same")


def _rechained(stretches: DataFrame, posts: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Stretches of spans that only several sources together repeat, from all seeds that a span has in common with one.

    A seed that an earlier document took is no longer hidden. Tried are a span's sources and the first document that
    has the same ``least`` words in a row in such a span.
    """
    long = f"stop - start >= {int(least)}"
    spans = staged(_merged(stretches).where(long).join(_merged(stretches.where(long)).select("doc", "start", "stop"), ["doc", "start", "stop"], "left_anti"), "spans")

    def grams(batches):
        for b in batches:
            for doc, start, stop, words in zip(*(b.column(c).to_pylist() for c in ("doc", "x0", "y0", "words")), strict=True):
                h = np.unique(rolling(word_hashes(words.decode("utf-8", "surrogatepass")), int(least)))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.full(len(h), v, np.int64)) for v in (doc, start, stop))], ["gram", "doc", "start", "stop"])

    at = [F.col(c).cast("int") for c in ("start", "stop")]
    asks = spans.select(F.col("doc").alias("id"), "doc", F.col("doc").alias("src"), at[0].alias("x0"), at[1].alias("y0"), at[0].alias("lo"), at[1].alias("hi"))
    held = staged(_slices(asks, docs).mapInArrow(grams, "gram long, doc long, start long, stop long"), "grams")
    first = held.groupBy("gram").agg(F.min("doc").alias("src"), F.max("doc").alias("top")).where("src < top").select("gram", "src")
    same = held.join(first, "gram").where("doc <> src").select("doc", "start", "stop", "src")
    pairs = staged(spans.select("doc", "start", "stop", F.explode("srcs").alias("src")).union(same).distinct(), "pairs")
    inside = F.expr(f"filter(pos, x -> x >= start and x <= stop - {K})")
    mine = posts.join(pairs, "doc").select("doc", "src", "seed", inside.alias("pos")).where("size(pos) > 0")
    return _stretches(mine.join(posts.select(F.col("doc").alias("src"), "seed", F.col("pos").alias("src_pos")), ["src", "seed"]).select("doc", "src", "seed", "pos", "src_pos"), docs)


def passages(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Repeated passages: ``doc_id, start, stop, n_words, n_same, src_ids``, a row each, in word positions.

    Stretches of ``least`` words or more, each aligned with one earlier document; those that touch, or lie within three
    words, are one passage. ``src_ids`` lists the documents; ``n_same`` is how many words match in the stretch of it that has
    most, so it is never above ``n_words``. No repeats, no rows.
    """
    posts = _posts(docs)
    got = repeats(docs, posts)
    got = got.union(_rechained(got, posts, docs, least)).where(f"stop - start >= {int(least)}").dropDuplicates(["doc", "src", "start", "stop"])
    return _merged(got).select(F.col("doc").alias("doc_id"), "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), F.col("same").alias("n_same"), F.array_sort("srcs").alias("src_ids"))


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of some spans and the white space after them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for start, stop in sorted(spans):
        if start >= len(at):
            break
        out.append(text[last : at[start][0]])
        last = max(last, at[stop][0] if stop < len(at) else len(text))
    return "".join(out) + text[last:]


def remove_repeats(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """Documents without their repeated passages, which stay in the first document that has them.

    ``text`` and, where there is one, ``n_chars`` follow; other columns are unchanged. A document of which nothing but
    white space is left goes.
    """
    spans = staged(passages(docs, least).groupBy(F.col("doc_id").alias("span_id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    rows = docs.select(F.col("doc_id").alias("row_id"), "text", F.struct("*").alias("row"))
    both = rows.join(spans, rows["row_id"] == spans["span_id"], "left")
    both = both.withColumn("fixed", F.when(F.col("spans").isNull(), F.col("text")).otherwise(_cut("text", "spans")))
    both = both.where("spans is null or fixed rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    new = {"text": F.col("fixed")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("fixed").cast(docs.schema["n_chars"].dataType))
    return both.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


@F.pandas_udf(StringType())
def _cut(text, spans):
    return text.combine(spans, lambda t, s: None if t is None else t if s is None else without(t, [(x["start"], x["stop"]) for x in s]))
