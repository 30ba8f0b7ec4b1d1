"""Sharding over fixed virtual slots.

Records are hashed into a fixed number of slots; what a slot weighs is summed, and a small table says which shard holds each
slot. The table is stored in versions: a rebalance reads the newest one, moves as few slots as it needs and appends the next
version, so readers of an older version still find every record. Records move only with their slot.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.places import exists
from .common import new_path, staged
from .importance import CRC_SQL, CRC_TABLE_SQL

SLOTS = 4096
SHARDS = 24
#: A shard is left as it is while it holds no more than the mean and this share of it.
SLACK = 0.0
#: What a record weighs besides its text.
HEADER = 8

MAP = "version int, vslot int, shard int, bytes long, n long"


def virtual_slot(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: a digest of its id (null: empty) and its text's CRC32, so that no id gathers different texts."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_crc32.cast("string"))
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % slots).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``vslot, doc_id, size, text_crc32, n``: records without their texts, equal ones counted, none null but ``doc_id``.

    A null text weighs as an empty one. Repeated rows with one id and text are one row with ``n`` copies.
    """
    text = F.coalesce("text", F.lit(""))
    r = docs.select("doc_id", (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    r = r.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    return r.select(virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots).alias("vslot"), "doc_id", "size", "text_crc32", "n")


def slot_loads(recs: DataFrame) -> DataFrame:
    """``vslot, bytes, n`` of the slots that hold any record: at most one row a slot."""
    return recs.groupBy("vslot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("n"))


def edit(held: dict[int, int], load: dict[int, int], shards: Iterable[int], slack: float = SLACK) -> dict[int, int]:
    """The next slot-to-shard map: ``held`` with as few slots moved as bring every shard to the mean load.

    Slots without a shard, or whose shard is not among ``shards``, have to be placed. A shard above the mean (and ``slack`` of
    it) gives up slots, the largest that fit into its excess first, so it never falls below the mean. What is to be placed
    goes to the lightest shard, large slots first, ties to the smaller number. With nothing held this is the greedy rule for
    equal loads; a new shard takes slots and gives none; a removed one's slots spread over the rest.
    """
    shards = sorted(shards)
    mean = sum(load.values()) / len(shards)
    on = {s: 0 for s in shards}
    own: dict[int, list[int]] = {s: [] for s in shards}
    for v in sorted(load):
        if held.get(v) in on:
            on[held[v]] += load[v]
            own[held[v]].append(v)
    out = {v: s for v, s in held.items() if s in on}
    loose = [v for v in load if v not in out]
    for s in shards:
        if on[s] > mean * (1 + slack):
            for v in sorted(own[s], key=lambda v: (-load[v], v)):
                if 0 < load[v] <= on[s] - mean:
                    on[s] -= load[v]
                    loose.append(v)
    lightest = [(on[s], s) for s in shards]
    heapq.heapify(lightest)
    for v in sorted(loose, key=lambda v: (-load[v], v)):
        n, s = heapq.heappop(lightest)
        out[v] = s
        heapq.heappush(lightest, (n + load[v], s))
    return out


def newest(spark: SparkSession, path: str) -> int:
    """The newest version stored at ``path``; 0 if there is none."""
    if not exists(spark, path):
        return 0
    return load_map(spark, path).agg(F.max("version")).first()[0] or 0


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All versions stored at ``path``, or one: a row a slot with its shard and what it held when the version was made."""
    m = spark.read.schema(MAP).parquet(path)
    return m if version is None else m.where(F.col("version") == version)


def rebalance(spark: SparkSession, path: str, loads: DataFrame, shards: Iterable[int], slots: int = SLOTS, slack: float = SLACK) -> int:
    """Edit the newest map stored at ``path`` for the loads ``(vslot, bytes, n)`` and store it as the next version, which is returned.

    Every slot is placed, empty ones too, so that records which come later have a shard. A map has ``slots`` rows whatever the
    input, which is all that the driver holds.
    """
    last = newest(spark, path)
    held = {r.vslot: r.shard for r in load_map(spark, path, last).collect()} if last else {}
    seen = {r.vslot: (r.bytes, r.n) for r in loads.collect()}
    now = edit(held, {v: seen.get(v, (0, 0))[0] for v in range(slots)}, shards, slack)
    rows = [(last + 1, v, now[v], *seen.get(v, (0, 0))) for v in range(slots)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("append").parquet(path)
    return last + 1


def place(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot``: records numbered from 0 without gaps in each shard.

    ``slot_map`` is one version. Slots of a shard follow each other, so a record's number is the count of the shard's slots
    before its own and its place by id, size and CRC in it: nothing is ordered over a whole shard. Only the map, of fixed
    size, is broadcast. The law is ``bytes``: the map follows loads, so there is no shard that id and shard count alone
    would give, and ``grown_shard`` is null.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    m = slot_map.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("vslot").orderBy(F.asc_nulls_first("doc_id"), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    r = recs.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(m), "vslot")
    r = r.withColumn("slot", F.explode(F.expr("sequence(first + at, first + at + n - 1)")))
    return r.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "vslot")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Rows of ``place`` for all documents, under a map that is stored at ``path`` (a new one in the shared folder if none).

    If ``path`` holds versions, the newest is edited for the loads of these documents. No documents give no rows.
    """
    spark = docs.sparkSession
    recs = staged(records(docs, slots), "records")
    path = path or new_path(spark, "slots")
    return place(recs, load_map(spark, path, rebalance(spark, path, slot_loads(recs), range(shards), slots)))


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Write whole rows under ``path/shard=N``, as one version of the map says.

    Rows are dealt by slot, not by shard: a shard is written by many tasks. Columns named ``shard`` or ``vslot`` are replaced.
    """
    rows = docs.withColumn("vslot", virtual_slot(F.col("doc_id"), F.crc32(F.coalesce("text", F.lit(""))), slots)).drop("shard")
    rows.join(F.broadcast(slot_map.select("vslot", "shard")), "vslot").repartition("vslot").write.partitionBy("shard").parquet(path)


SHARD_SQL = f"""
with recursive crc as materialized ({CRC_TABLE_SQL}),
d as materialized (
  select doc_id, octet_length(encode(coalesce(text, ''))) + {HEADER} as size, {CRC_SQL.format("coalesce(text, '')")} as text_crc32 from documents, crc),
v as materialized (
  select *, cast(cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || cast(text_crc32 as varchar)), 1, 8)) as bigint) % {SLOTS} as int) as vslot from d),
load as materialized (
  select k.vslot, coalesce(sum(size), 0)::bigint as bytes, row_number() over (order by coalesce(sum(size), 0) desc, k.vslot) as i
  from (select unnest(range({SLOTS}))::int as vslot) k left join v using (vslot) group by k.vslot),
walk as (
  select 0::bigint as i, null::int as vslot, null::int as shard, list_transform(range({SHARDS}), lambda x: 0::bigint) as held
  union all
  select i, vslot, p - 1, list_transform(held, lambda x, j: case when j = p then x + bytes else x end)
  from (select l.i, l.vslot, l.bytes, w.held, list_position(w.held, list_min(w.held))::int as p from walk w join load l on l.i = w.i + 1)),
m as materialized (select vslot, shard from walk where i > 0)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard,
  row_number() over (partition by shard order by vslot, doc_id nulls first, size, text_crc32) - 1 as slot, null::int as grown_shard, vslot
from v join m using (vslot)
"""
