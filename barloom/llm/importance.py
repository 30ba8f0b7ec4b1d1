"""Importance resampling towards a target distribution, on hashed word n-grams.

Both corpora are counted in buckets of feature hashes. A bucket's gain is the log ratio of its smoothed shares; a document's
weight is the mean gain of its features; documents are drawn without replacement by weight plus Gumbel noise. The hash is
CRC32, worked out for many features at once: a task's distinct feature bytes are grouped by equal length into matrices of
bytes, and all CRCs of a matrix go on column by column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BUCKETS = 10_000
#: Share drawn, in percent of the documents that have at least ``MIN_WORDS`` words.
PERCENT = 25
MIN_WORDS = 20
SEED = 7

#: Bytes of text that are hashed at once; longer texts are cut between words.
CHUNK = 1 << 22
BLOCK = 256
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def _columns(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    for column in np.ascontiguousarray(matrix.T):
        crc = crc >> 8 ^ _TABLE[(crc ^ column) & 0xFF]
    return crc


def _block_shift() -> np.ndarray:
    """What a register's four bytes become, each by itself, after a block of zero bytes."""
    r = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    return _columns(np.zeros((len(r), BLOCK), np.uint8), r).reshape(4, 256)


_SHIFT = _block_shift()


def _blockwise(matrix: np.ndarray) -> np.ndarray:
    """Registers of rows longer than a block: blocks are rows of their own, whose registers are then folded from the left.

    Zero bytes in front leave an empty register empty, and a register of ones is the same as the first four bytes inverted.
    """
    n, length = matrix.shape
    blocks = np.zeros((n, -(-length // BLOCK) * BLOCK), np.uint8)
    blocks[:, -length:] = matrix
    blocks[:, -length : 4 - length] ^= 0xFF
    each = _columns(blocks.reshape(-1, BLOCK), np.zeros(blocks.size // BLOCK, np.uint32)).reshape(n, -1)
    crc = np.zeros(n, np.uint32)
    for column in each.T:
        crc = _SHIFT[0][crc & 0xFF] ^ _SHIFT[1][crc >> 8 & 0xFF] ^ _SHIFT[2][crc >> 16 & 0xFF] ^ _SHIFT[3][crc >> 24] ^ column
    return crc


def crc32(features: list[bytes]) -> np.ndarray:
    """CRC32 of each byte string, as 64-bit integers.

    Strings of one length are the rows of a matrix; a step takes one column of it into all rows' CRCs. Results are scattered
    back to the order of ``features``. Very long strings (a script without spaces gives such words) are cut in blocks first.
    """
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    ends = np.flatnonzero(np.diff(lengths[order], append=-1)) + 1
    out = np.empty(len(features), np.int64)
    for lo, hi in zip([0, *ends[:-1]], ends, strict=False):
        rows = order[lo:hi]
        matrix = np.frombuffer(b"".join([features[i] for i in rows]), np.uint8).reshape(len(rows), -1)
        crc = _blockwise(matrix) if matrix.shape[1] > 4 * BLOCK else _columns(matrix, np.full(len(rows), 0xFFFFFFFF, np.uint32))
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _pieces(text: str | None) -> Iterator[bytes]:
    """A-Z lowered UTF-8 of a text, cut at bytes that belong to no word."""
    b = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(b) - at > CHUNK and (gap := _GAP.search(b, at + CHUNK)):
        yield b[at : gap.start()]
        at = gap.start()
    yield b[at:]


def _groups(texts: list[str | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Words of about ``CHUNK`` bytes of text at a time, with each word's document and whether it is there only to precede another."""
    words: list[bytes] = []
    spans: list[tuple[int, int, int]] = []
    size = 0

    def group():
        doc = np.repeat([s[0] for s in spans], [s[1] for s in spans])
        again = np.zeros(len(words), bool)
        at = np.cumsum([0] + [s[1] for s in spans[:-1]])
        again[[a for a, s in zip(at, spans, strict=True) if s[2]]] = True
        return words, doc, again

    for i, text in enumerate(texts):
        last: list[bytes] = []
        for piece in _pieces(text):
            if size and size + len(piece) > CHUNK:
                if spans:
                    yield group()
                words, spans, size = [], [], 0
            found = _WORD.findall(piece)
            if found:
                words += last + found
                spans.append((i, len(last) + len(found), len(last)))
                last = found[-1:]
            size += len(piece)
    if spans:
        yield group()


def _hashed(texts: list[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(document, bucket, whether it is a single word)`` of every feature: runs of one and two words, repeats included."""
    for words, doc, again in _groups(texts):
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        known = list(seen)
        joined = np.flatnonzero((doc[1:] == doc[:-1]) & ~again[1:])
        pairs, which = np.unique(ids[joined] * len(known) + ids[joined + 1], return_inverse=True)
        first, second = np.divmod(pairs, len(known))
        at = crc32(known + [known[a] + b" " + known[b] for a, b in zip(first.tolist(), second.tolist(), strict=True)]) % buckets
        own = ~again
        yield (
            np.concatenate([doc[own], doc[joined]]),
            np.concatenate([at[ids[own]], at[len(known) + which]]),
            np.repeat([True, False], [own.sum(), len(joined)]),
        )


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: how many features of all ``texts.text`` fall into each bucket that has any.

    Each task sends at most one row a bucket. Null, empty and wordless texts have no features; repeated rows count again.
    """

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, bucket, _ in _hashed(b.column("text").to_pylist(), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths: the floored log ratio of its smoothed shares in two tables ``(bucket, n)``.

    At most ``buckets`` rows of each come to the driver. With an empty table all its buckets have the same share.
    """
    rows = source.withColumn("side", F.lit("s")).union(target.withColumn("side", F.lit("t"))).collect()
    count = {side: np.zeros(buckets, np.int64) for side in "st"}
    for r in rows:
        count[r.side][r.bucket] = r.n
    s, t = count["s"].astype(float), count["t"].astype(float)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64).tolist()


def weigh(docs: DataFrame, gain: list[int]) -> DataFrame:
    """``doc_id, n_words, n_features, weight``, one row a document: the floored mean of its features' gains, 0 without features.

    ``gain`` has one whole number a bucket and goes to every task. Whole texts are read; very long ones in pieces.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        of = np.array(gain, np.int64)
        for b in batches:
            n_words, n_features, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for doc, bucket, single in _hashed(b.column("text").to_pylist(), len(of)):
                order = np.argsort(doc, kind="stable")
                here, first = np.unique(doc[order], return_index=True)
                total[here] += np.add.reduceat(of[bucket][order], first)
                n_features += np.bincount(doc, minlength=b.num_rows)
                n_words += np.bincount(doc[single], minlength=b.num_rows)
            weight = total // np.maximum(n_features, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored, drawn from the digest of seed and id; a null id is taken for an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(weights: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: the rank of what is drawn, null for the rest; one row for each row given.

    Drawn are the ``percent`` in 100, rounded down, of the rows with ``min_words`` words or more that have the highest scores,
    weight plus noise; ties go to the smaller id (null first), then repeated rows of one id are in no special order. No task
    ranks all rows: scores are whole thousandths of logarithms, so there are some ten thousand values at any size; their
    counts, summed from above, tell how many rows stand before each value, and rows are numbered within a value only.
    """
    scored = staged(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    fit = F.col("n_words") >= min_words
    counts = scored.where(fit).groupBy("score").agg(F.count("*").alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0)))
    drawn = scored.where(fit).agg(F.floor(F.count("*") * percent / 100).alias("drawn"))
    drawn = counts.crossJoin(F.broadcast(drawn)).where("above < drawn").select("score", "above", "drawn")
    in_value = Window.partitionBy("score", "fit").orderBy(F.asc_nulls_first("doc_id"), "n_features", "weight")
    rows = scored.withColumn("fit", fit).join(drawn, "score", "left").withColumn("rank", F.when(F.col("fit") & F.col("above").isNotNull(), F.col("above") + F.row_number().over(in_value)))
    return rows.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("drawn"), F.col("rank")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document, drawn towards the texts of ``target``.

    Null, empty and wordless texts have no features, weight 0 and are never drawn. Without documents there are no rows; without
    target texts every bucket's target share is the same. Other columns of both tables are left out.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets), buckets)
    return draw(weigh(docs, gain), percent, min_words, seed)


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
#: Table and CRC of a DuckDB string, byte by byte.
CRC_TABLE_SQL = "select list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1]::bigint[], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t"
CRC_SQL = "xor(4294967295, list_reduce([4294967295]::bigint[] || list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::bigint), lambda a, x: xor(a >> 8, crc.t[1 + (xor(a, x) & 255)])))"

RESAMPLE_SQL = rf"""
with crc as materialized ({CRC_TABLE_SQL}),
dw as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
bw as (select {_WORDS} as w from benchmark),
df as (select r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from dw where len(w) > 0),
bf as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from bw where len(w) > 0),
b as materialized (
  select f, cast({CRC_SQL.format("f")} % {BUCKETS} as bigint) as bucket from (select distinct f from (select f from df union all select f from bf)), crc),
s as (select bucket, count(*) as n from df join b using (f) group by bucket),
t as (select bucket, count(*) as n from bf join b using (f) group by bucket),
g as (
  select k.bucket, cast(floor(1000 * ln(cast((coalesce(t.n, 0) + 1) * ((select coalesce(sum(n), 0) from s) + {BUCKETS}) as double)
    / cast((coalesce(s.n, 0) + 1) * ((select coalesce(sum(n), 0) from t) + {BUCKETS}) as double))) as bigint) as gain
  from (select unnest(range({BUCKETS})) as bucket) k left join s using (bucket) left join t using (bucket)),
m as (select r, cast(count(*) as bigint) as n_features, cast(floor(sum(gain) / count(*)) as bigint) as weight from df join b using (f) join g using (bucket) group by r),
e as (
  select doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from dw left join m using (r)),
o as (select *, row_number() over (partition by n_words >= {MIN_WORDS} order by score desc, doc_id nulls first) as k from e)
select doc_id, n_features, weight, score,
  case when n_words >= {MIN_WORDS} and k <= (select count(*) from e where n_words >= {MIN_WORDS}) * {PERCENT} // 100 then k end as rank
from o
"""
