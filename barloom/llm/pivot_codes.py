"""Vector codes by product quantisation in whole numbers, with pivots that prune the nearest-entry search.

Vectors are cut into parts, and each part position has a codebook, improved over rounds. Distances from every part to a few
fixed pivots are worked out once and stored. In a round the pivots' distances to the codebook's entries give, by the triangle
inequality, lower bounds of all part-to-entry distances; entries are tried in the order of their bounds, and exact whole
numbers are only worked out while a bound is not above the best distance found (LAESA).
"""

from __future__ import annotations

import decimal
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
PIVOTS = 4

#: Sums of scaled components go through Spark as two decimals, ``high * LIMB + low``.
LIMB = 1 << 70
#: Up to this size squared differences of a part fit 64 bits; above it Python's own integers are used.
_SMALL = 1 << 28
#: Rows that are compared at once.
_ROWS = 4096


def kept(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """``vec_id, label, embedding`` of the rows that take part.

    Dropped are null vectors, those with null or non-finite components, and such as cannot be cut into ``parts`` equal parts or
    have another length than the kept vector with the smallest id. Components are read as 32-bit numbers.
    """
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<float>").alias("embedding"))
    v = v.where("embedding is not null and size(embedding) > 0").where(f"size(embedding) % {parts} = 0")
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    first = v.orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
    return v.where(F.size("embedding") == (first[0] if first else 0))


def whole(rows: pa.Array, parts: int) -> np.ndarray:
    """Scaled, floored components as an array (part, row, place in part); Python's integers if any is very large."""
    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * SCALE).reshape(len(rows), parts, -1).transpose(1, 0, 2)
    if np.abs(scaled).max(initial=0) < _SMALL:
        return scaled.astype(np.int64)
    return np.vectorize(int, otypes=[object])(scaled)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    if a.dtype != b.dtype:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(-1)


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances (row, point) as doubles."""
    return np.sqrt(squares(x[:, None, :], to[None, :, :]).astype(np.float64))


def choose_pivots(book: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Points of a codebook that lie far apart: the first, then always the one farthest from those chosen."""
    chosen = [0]
    near = distances(book, book[:1])[:, 0]
    while len(chosen) < min(n, len(book)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(book, book[chosen[-1:]])[:, 0])
    return book[chosen]


def nearest(x: np.ndarray, far: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry (ties: the lower) and the exact squared distance for each part; how many distances it took.

    ``far`` holds the distances of the parts to the pivots. Bounds are lowered by more than their rounding error, so no entry
    that could be nearest, or as near, is left out.
    """
    apart = distances(book, pivots)
    bound = np.abs(far[:, None, :] - apart[None, :, :]).max(-1)
    bound = np.maximum(bound - 1e-9 * (far.max(1)[:, None] + apart.max(1)[None, :]), 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(len(x))
    code = order[:, 0].copy()
    best = squares(x, book[code])
    done = len(x)
    for k in range(1, len(book)):
        entry = order[rows, k]
        open_ = bound[rows, entry] <= best[rows].astype(np.float64) * (1 + 1e-9)
        rows, entry = rows[open_], entry[open_]
        if not len(rows):
            break
        d = squares(x[rows], book[entry])
        done += len(rows)
        better = (d < best[rows]) | ((d == best[rows]) & (entry < code[rows]))
        code[rows[better]], best[rows[better]] = entry[better], d[better]
    return code, best, done


def with_pivots(vectors: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """Store ``vec_id, label, embedding, far``: each vector's distances to its parts' fixed pivots, part after part."""
    parts = len(pivots)

    def run(batches):
        for b in batches:
            x = whole(b.column("embedding"), parts)
            far = np.concatenate([distances(x[p], pivots[p]) for p in range(parts)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), far.shape[1]).cast(pa.list_(pa.float64()))], [*b.schema.names, "far"])

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return staged(vectors.mapInArrow(run, f"{names}, far array<double>"), "far")


def _read(b: pa.RecordBatch, pivots: list[np.ndarray]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, b.num_rows, _ROWS):
        part = b.slice(at, _ROWS)
        far = part.column("far").flatten().to_numpy(zero_copy_only=False)
        yield part, whole(part.column("embedding"), len(pivots)), far.reshape(part.num_rows, len(pivots), -1).transpose(1, 0, 2)


def sums(vectors: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """``part, entry, place, n, high, low``: counts and sums of the parts nearest to each entry; a task sends one row a component."""

    def run(batches):
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for _, x, far in _read(b, pivots):
                for p, book in enumerate(books):
                    code = nearest(x[p], far[p], book, pivots[p])[0]
                    for e in np.unique(code).tolist():
                        mine = x[p][code == e]
                        was = total.setdefault((p, e), [0, [0] * mine.shape[1]])
                        was[0] += len(mine)
                        was[1] = [s + int(c) for s, c in zip(was[1], mine.sum(0), strict=True)]
        rows = [(p, e, i, n, *map(decimal.Decimal, divmod(s, LIMB))) for (p, e), (n, own) in total.items() for i, s in enumerate(own)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["part", "entry", "place", "n", "high", "low"])

    each = vectors.select("embedding", "far").mapInArrow(run, "part int, entry int, place int, n long, high decimal(38,0), low decimal(38,0)")
    return each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))


def _array(rows: list[list[int]]) -> np.ndarray:
    large = any(abs(v) >= _SMALL for r in rows for v in r)
    return np.array(rows, object if large else np.int64)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, n_pivots: int = PIVOTS) -> tuple[DataFrame, list[np.ndarray], list[np.ndarray]]:
    """The stored vectors with pivot distances, the final codebooks and the pivots; no codebooks without vectors.

    Codebooks start from the ``entries`` vectors with the smallest ids (null ids last, repeated ids by their components), fewer
    if there are fewer. Each round is one pass that sums parts by nearest entry; the driver holds codebooks and their sums only,
    ``parts * entries`` rows at any input. Entries without parts stay as they are.
    """
    start = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    if not start.num_rows:
        return vectors.withColumn("far", F.array().cast("array<double>")), [], []
    x = whole(start.column("embedding").combine_chunks(), parts)
    books = [_array(x[p].tolist()) for p in range(parts)]
    pivots = [choose_pivots(b, n_pivots) for b in books]
    stored = with_pivots(vectors, pivots)
    for _ in range(rounds):
        new = [b.tolist() for b in books]
        for r in sums(stored, books, pivots).collect():
            new[r.part][r.entry][r.place] = (int(r.high) * LIMB + int(r.low)) // r.n
        books = [_array(b) for b in new]
    return stored, books, pivots


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 in hex of all entries' components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def encode(stored: DataFrame, books: list[np.ndarray], pivots: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits a part and the squared distances' sum; an error past 64 bits is null."""
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}

    def run(batches):
        for b in batches:
            for part, x, far in _read(b, pivots):
                found = [nearest(x[p], far[p], book, pivots[p])[:2] for p, book in enumerate(books)]
                codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
                error = [v if v < 1 << 63 else None for v in map(sum, zip(*(d.tolist() for _, d in found), strict=True))]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return stored.select("vec_id", "label", "embedding", "far").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, a row for each vector that ``kept`` leaves.

    ``label_error`` is the sum of errors over a label, null labels together, and null if it or one of them passes 64 bits;
    repeated rows are coded each. No vectors give no
    rows. Other columns are left out.
    """
    stored, books, pivots = train(kept(vectors, parts), parts, entries, rounds)
    coded = staged(encode(stored, books, pivots), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    by_label = coded.groupBy(F.col("label").alias("l")).agg(F.when(F.count("*") == F.count("error"), total).alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _compress_sql() -> str:
    assign = """
{0} as materialized (
  select r, p, arg_min(e, struct_pack(d := d, e := e)) as e, min(d) as d
  from (select x.r, x.p, c.e, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint as d from x join {1} c using (p))
  group by r, p)"""
    update = """
{0} as materialized (
  select c.p, c.e, coalesce(s.v, c.v) as v
  from {1} c left join (
    select p, e, list((t - ((t % n) + n) % n) // n order by i) as v
    from (select p, e, i, sum(x.v[i])::hugeint as t, count(*)::hugeint as n from {2} join x using (r, p), (select unnest(range(1, len((select v from x limit 1)) + 1)) as i) group by p, e, i)
    group by p, e) s using (p, e))"""
    steps, book = [], "c0"
    for k in range(ROUNDS):
        steps += [assign.format(f"a{k}", book), update.format(f"c{k + 1}", book, f"a{k}")]
        book = f"c{k + 1}"
    steps.append(assign.format("z", book))
    return rf"""
with k as (
  select vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::double)::hugeint) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
o as materialized (select row_number() over (order by vec_id) as r, * from k),
x as materialized (select r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] as v from o, (select unnest(range({PARTS})) as p)),
c0 as materialized (select p, r - 1 as e, v from x where r <= {ENTRIES}),
{",".join(steps)},
q as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from z group by r),
h as (select sha256(array_to_string(flatten(list(v order by p, e)), ',')) as codebooks_sha256 from {book})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from q join o using (r), h
"""


COMPRESS_SQL = _compress_sql()
