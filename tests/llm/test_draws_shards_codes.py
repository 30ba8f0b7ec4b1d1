"""Importance resampling, virtual slots and pivot codes against plain versions, on odd rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from barloom.llm import importance, pivot_codes, queries, virtual_slots

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_virtual_slots", "op13_pivot_codes"])
def test_rows_are_those_of_the_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == columns
    plain = lambda rows, at: sorted(tuple(str(r[i]) for i in at) for r in rows)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert plain(df.select(*columns).collect(), range(len(columns))) == plain(want.fetchall(), at)


# ---- importance resampling


def test_crcs_of_all_lengths():
    rng = random.Random(0)
    some = [rng.randbytes(rng.choice([0, 1, 2, 3, 7, 300, 1024, 1025, 1028, 4096, 5001])) for _ in range(200)]
    assert importance.crc32(some).tolist() == [zlib.crc32(x) for x in some]
    assert importance.crc32([]).tolist() == []


def brute_resample(rows, target):
    def features(text):
        w = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    own = [(i, *features(t)) for i, t in rows]
    s, t = (collections.Counter(b for _, f in x for b in f) for x in ([(n, f) for _, n, f in own], [features(x) for x in target]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out, fit = [], []
    for i, n, f in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if n >= 20:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_draws_against_plain_counting(spark, docs, none):
    target = spark.createDataFrame([("t1", "w1 w2 w3 y4 y5"), ("t2", None), ("t3", "")], "item_id string, text string")
    docs = docs.withColumn("rank", docs["key"]).withColumn("score", docs["key"])
    got = [tuple(r) for r in importance.resample(docs, target).collect()]
    assert sorted(got, key=str) == brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert importance.resample(none, target).count() == 0
    no_target = importance.resample(docs, none).collect()
    assert sorted(map(tuple, no_target), key=str) == brute_resample([(r.doc_id, r.text) for r in docs.collect()], [])


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = ["a1 b2-c3 " * 50, None, "x " * 20 + "é" * 200 + " y", "", "one"]
    whole = [np.concatenate(x) for x in zip(*importance._hashed(texts, 97), strict=True)]
    monkeypatch.setattr(importance, "CHUNK", 16)
    cut = [np.concatenate(x) for x in zip(*importance._hashed(texts, 97), strict=True)]
    assert sorted(zip(*whole, strict=True)) == sorted(zip(*cut, strict=True))


def test_ranks_are_one_to_the_drawn_number(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 7 + 17 as n_words", "3 as n_features", "cast(id % 3 as bigint) as weight")
    got = importance.draw(rows, 25).collect()
    fit = sorted((r for r in got if r.doc_id % 7 + 17 >= 20), key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in fit[: len(fit) // 4]] == list(range(1, len(fit) // 4 + 1))
    assert all(r["rank"] is None for r in fit[len(fit) // 4 :]) and all(r["rank"] is None for r in got if r.doc_id % 7 + 17 < 20)


# ---- virtual slots


def loads_of(held, load, shards):
    return [sum(load[v] for v in load if held[v] == s) for s in shards]


def test_maps_are_even_and_edits_move_little():
    rng = random.Random(3)
    load = {v: int(rng.paretovariate(1.5) * 1000) for v in range(2000)}
    first = virtual_slots.edit({}, load, range(24))
    on = loads_of(first, load, range(24))
    assert set(first) == set(load) and max(on) - min(on) <= max(load.values())
    assert virtual_slots.edit(first, load, range(24), 0.05) == first
    grown = virtual_slots.edit(first, load, range(25), 0.02)
    assert {grown[v] for v in load if grown[v] != first[v]} == {24}
    assert max(loads_of(grown, load, range(25))) <= 1.06 * sum(load.values()) / 25
    gone = virtual_slots.edit(first, load, [s for s in range(24) if s != 5], 0.2)
    assert {first[v] for v in load if gone[v] != first[v]} == {5} and 5 not in gone.values()
    assert virtual_slots.edit({}, {}, range(3)) == {}


def test_versions_stay_readable(spark, tmp_path):
    path = f"file://{tmp_path}/map"
    loads = spark.createDataFrame([(0, 100, 1), (1, 100, 1), (2, 50, 2)], "vslot int, bytes long, n long")
    assert virtual_slots.newest(spark, path) == 0
    assert virtual_slots.rebalance(spark, path, loads, range(2), slots=8) == 1
    assert virtual_slots.rebalance(spark, path, loads.withColumn("bytes", loads["bytes"] * 3), range(3), slots=8) == 2
    one, two = ({r.vslot: r.shard for r in virtual_slots.load_map(spark, path, v).collect()} for v in (1, 2))
    assert set(one) == set(two) == set(range(8)) and set(one.values()) == {0, 1} and {two[v] for v in one if one[v] != two[v]} == {2}
    assert virtual_slots.load_map(spark, path).count() == 16


def test_every_record_has_a_place(spark, docs, none):
    docs = docs.withColumn("shard", docs["key"]).withColumn("slot", docs["key"])
    got = virtual_slots.shard(docs, 5).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} <= set(range(5))
    assert virtual_slots.shard(none, 5).count() == 0


def test_shards_are_near_equal(spark):
    got = virtual_slots.shard(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 8).collect()
    on = collections.Counter()
    for r in got:
        on[r.shard] += r["size"]
    assert max(on.values()) <= 1.01 * min(on.values())


def test_written_shards_hold_whole_rows(spark, docs, tmp_path):
    path = f"file://{tmp_path}/map"
    recs = virtual_slots.records(docs, 64)
    version = virtual_slots.rebalance(spark, path, virtual_slots.slot_loads(recs), range(3), slots=64)
    m = virtual_slots.load_map(spark, path, version)
    virtual_slots.write_shards(docs.withColumn("shard", docs["key"]), m, f"file://{tmp_path}/out", slots=64)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    placed = collections.Counter((r.doc_id, r.text_crc32, r.shard) for r in virtual_slots.place(recs, m).collect())
    assert collections.Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard) for r in back.collect()) == placed
    assert set(docs.columns) <= set(back.columns)


# ---- pivot codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    def ok(v):
        return v is not None and len(v) > 0 and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)

    kept = [(i, lab, [math.floor(4096 * x) for x in v]) for i, lab, v in rows if ok(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    d = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * d : p * d + d]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = collections.defaultdict(list)
            for _, _, v in kept:
                own[assign(v, p)[1]].append(cut(v, p))
            new.append([[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [(i, lab, "".join(f"{assign(v, p)[1]:02x}" for p in range(parts)), sum(assign(v, p)[0] for p in range(parts))) for i, lab, v in kept]
    total = collections.Counter()
    for _, lab, _, e in got:
        total[lab] += e
    top = {lab: max(e for _, x, _, e in got if x == lab) for lab in total}
    fits = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, fits(e), fits(max(total[lab], top[lab])), sha) for i, lab, c, e in got), key=str)


KIND = "vec_id long, embedding array<float>, label int, error string"


def test_codes_against_plain_search(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 1]), [float(np.float32(rng.gauss(0, 1))) for _ in range(16)]) for i in range(150)]
    rows += [(i, 1, [float(rng.choice([-1, 0, 1])) for _ in range(16)]) for i in range(150, 220)]  # ties
    rows += [(3, 0, rows[3][2]), (3, 0, rows[4][2]), (None, None, rows[5][2])]
    rows += [(900, 0, None), (901, 0, []), (902, 0, [None] * 16), (903, 0, [float("nan")] * 16), (904, 0, [float("inf")] + [0.0] * 15), (905, 0, [0.0] * 15), (906, 0, [0.0] * 24)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, lab, v in rows], KIND).repartition(3)
    assert sorted(map(tuple, pivot_codes.compress(df).collect()), key=str) == brute_codes(rows)
    assert pivot_codes.compress(df.limit(0)).count() == 0
    few = rows[:5]
    assert sorted(map(tuple, pivot_codes.compress(spark.createDataFrame([(i, v, lab, "x") for i, lab, v in few], KIND)).collect()), key=str) == brute_codes(few)


def test_very_large_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, 0, [float(np.float32(rng.gauss(0, 1) * 10 ** rng.choice([0, 3, 6]))) for _ in range(8)]) for i in range(60)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, lab, v in rows], KIND)
    assert sorted(map(tuple, pivot_codes.compress(df).collect()), key=str) == brute_codes(rows)
    huge = [(i, i, [float(np.float32(rng.gauss(0, 1) * 1e30)) for _ in range(8)]) for i in range(30)]
    got = {r.vec_id: r.code for r in pivot_codes.compress(spark.createDataFrame([(i, v, lab, "x") for i, lab, v in huge], KIND)).collect()}
    assert got == {r[0]: r[1] for r in brute_codes(huge)}


def test_bounds_spare_distances():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (16, 8))
    x = centres[rng.integers(0, 16, 2000)] + rng.integers(-200, 200, (2000, 8))
    pivots = pivot_codes.choose_pivots(centres)
    code, best, done = pivot_codes.nearest(x, pivot_codes.distances(x, pivots), centres, pivots)
    d = ((x[:, None, :] - centres[None]) ** 2).sum(-1)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all() and done < 0.25 * d.size
