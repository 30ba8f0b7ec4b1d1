"""Each stage of the pipeline on odd rows, against a plain version of it, and the whole on empty tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from test_llm_operators import brute_components, brute_hits, some_words

from barloom.llm import mixture, pu_quality

import corpus_pipeline

KIND = "doc_id long, text string, lang string, source string, n_chars long, key long, _row string, gone int"


def prose(tag, n):
    return " ".join(some_words(tag, n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, copies, passages, benchmark words, repeated rows, clashing names."""
    d = tmp_path_factory.mktemp("tables")
    shared, item = prose("shared", 70), prose("item", 14)
    rows = [(i, prose(f"d{i}_", 40 + i), "en" if i % 3 else "de", f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, "!!! $$$ ### " * (3 + i), "en", "junk") for i in range(20)]
    rows += [(200, prose("d5_", 45), "en", "s1"), (201, prose("d6_", 45) + " more", "en", None), (202, prose("x", 30) + " " + shared, None, "s2"), (203, prose("y", 30) + "\n" + shared + " " + prose("z", 9), "de", "s2")]
    rows += [(204, shared, "de", "s2"), (205, prose("v", 20) + " " + item.upper() + " " + prose("w", 20), "en", "s3"), (206, None, None, None), (207, "", "en", "s1"), (208, " \n ", "en", "s1"), (209, prose("long", 20_000), "en", "s1")]
    rows += [(None, prose("n", 30), "en", "s1"), (None, None, None, None), (210, "two words", "en", "s1"), (210, "two words", "en", "s1"), (211, "two words", "en", "s1")]
    full = [(i, t, a, s, None if t is None else len(t), 1, "r", 0) for i, t, a, s in rows]
    spark.createDataFrame(full, KIND).coalesce(2).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 40, 2)] + [(i, 0, 0) for i in range(100, 118)] + [(0, None, 0), (None, 1, 0), (1, 1, None), (1, 0, None), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.fixture(scope="module")
def base(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def ids(df):
    return sorted(((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect()))


def test_quality_stage_against_the_same_sums_in_numpy(spark, base, tables):
    rows = [(r.doc_id, pu_quality.describe(r.text).astype(float)) for r in base.collect()]
    said = {}
    for r in spark.read.parquet(f"{tables}/labels.parquet").collect():
        if r.doc_id is not None and r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            said.setdefault(r.doc_id, []).append(r.quality)
    good = {i: np.mean(q) >= 0.5 for i, q in said.items()}
    x = np.stack([v for _, v in rows])
    p = np.stack([v for i, v in rows if good.get(i)])
    n_neg = sum(1 for i, _ in rows if i in good and not good[i])
    at = pu_quality.SHARES * len(pu_quality.RAMPS)
    stat = lambda a: (len(a), (a.T @ a / len(a))[at], a.T @ a / len(a))
    w = pu_quality.minimise(len(p) / (len(p) + n_neg), stat(x), stat(p))
    bins = {}
    for i, v in rows:
        if i in good:
            m = math.floor(min(max(v @ w, -4), 4) * 50 + 0.5) / 50
            bins[m, int(good[i])] = bins.get((m, int(good[i])), 0) + 1
    slope, offset = pu_quality._logistic([(m, y, n) for (m, y), n in sorted(bins.items())])
    bad = {i for i, v in rows if i is not None and 1 / (1 + math.exp(-(v @ w * slope + offset))) < 0.3}
    out = corpus_pipeline.quality(spark, base, tables)
    assert out.columns == base.columns and ids(out) == sorted((i is None, i or 0) for i, _ in rows if i not in bad)
    assert {100, 110, 119} <= bad and not bad & set(range(0, 40))


def test_near_duplicates_stage_against_all_pairs(spark, base, tables):
    out = corpus_pipeline.near_duplicates(spark, base, tables)
    top = brute_components([(r.doc_id, r.text) for r in base.collect()])
    want = [i for i in {i for i in top if top[i] == i}]
    assert out.columns == base.columns and ids(out) == sorted([(False, i) for i in want] + [(True, 0)] * 2)


def test_repeated_passages_stage_leaves_each_passage_once(spark, base, tables):
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, base, tables).where("doc_id >= 202").collect()}
    before = {r.doc_id: r for r in base.collect()}
    assert out[202].text == before[202].text and out[203].text.split() == some_words("y", 30) + some_words("z", 9) and 204 not in out
    assert all(out[i].text == before[i].text for i in (205, 206, 207, 209, 210)) and out[203].n_chars == len(out[203].text)
    assert out[208].text == " \n "  # a text that was blank before stays
    seen, windows = {}, 0
    for i, r in sorted(out.items()):
        w = (r.text or "").lower().split()
        for k in range(len(w) - 49):
            windows += seen.setdefault(tuple(w[k : k + 50]), i) != i
    assert windows == 0


def test_benchmark_stage_against_brute_force(spark, base, tables):
    rows = [(r.doc_id, r.text) for r in base.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_hits(rows, items) if r[5]}
    out = corpus_pipeline.benchmark_free(spark, base, tables)
    assert hit == {205} and out.columns == base.columns and ids(out) == sorted((i is None, i or 0) for i, _ in rows if i not in hit)


def poured(budget, caps, weight):
    """Budget shared by weight, none above its cap; what one leaves goes to the others."""
    out, left = {}, dict(caps)
    while left:
        level = budget / sum(map(weight, left))
        full = {k for k, c in left.items() if c <= level * weight(k) + 1e-9}
        if not full:
            return out | {k: level * weight(k) for k in left}
        out |= {k: left[k] for k in full}
        budget -= sum(left.pop(k) for k in full)
    return out


def test_mixed_stage_against_plain_budgets_and_prefixes(spark, base, tables):
    docs, weights = base.collect(), mixture.WEIGHTS
    leaves = {}
    for r in docs:
        domain = "d" + str(int(hashlib.md5((r.source or "").encode()).hexdigest()[0], 16) % 3)
        leaves.setdefault((domain, r.lang or "", r.source or ""), []).append((len((r.text or "").split()), r.doc_id))
    tokens = {k: sum(n for n, _ in v) for k, v in leaves.items()}
    node = {(): 0.8 * sum(tokens.values())}
    for depth, level in enumerate(("domain", "lang", "source"), 1):
        below = {}
        for up, budget in node.items():
            caps = {}
            for k, n in tokens.items():
                if k[: depth - 1] == up:
                    caps[k[:depth]] = caps.get(k[:depth], 0) + 3 * n
            below |= poured(budget, caps, lambda k: float(weights[level].get(k[-1], 1.0)))  # noqa: B023
        node = below
    want = []
    for leaf, rows in leaves.items():
        budget = math.floor(node[leaf] + 1e-6)
        full, rest = divmod(budget, tokens[leaf]) if tokens[leaf] else (0, 0)
        want += [(i, e) for _, i in rows for e in range(full)]
        if full < 3:
            order = sorted(rows, key=lambda r: (hashlib.md5(f"7|{full}|{'' if r[1] is None else r[1]}".encode()).hexdigest(), r[1] or -1))  # noqa: B023
            at = 0
            for n, i in order:
                if at + n > rest:
                    break
                at += n
                want.append((i, full))
    out = corpus_pipeline.mixed(spark, base, tables)
    assert [c for c in out.columns if c not in base.columns] == ["domain", "n_tokens", "epoch"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.epoch) for r in out.collect()), key=key) == sorted(want, key=key)


def test_whole_pipeline_and_empty_tables(spark, tables, tmp_path):
    out = corpus_pipeline.run(spark, tables)
    got = {r.doc_id for r in out.collect()}
    assert got and not got & {100, 110, 200, 204, 205}
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
