"""Exact and near dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quotemill.llm import exact_dedup, simhash
from quotemill.llm.common import components


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_fingerprint(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lower(text))]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints):
    """id -> smallest id reachable over fingerprints within 4 bits."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", ["small", "odd", "none"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_dedup(request, name, fan_in):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for i, t in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t), i is None, i))
    got = exact_dedup.exact_dedup(docs, fan_in).collect()
    want = Counter()
    for i, t in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()
        keep = min(groups[key], key=lambda g: (g[0], g[1], g[2] or 0))[2]
        want[(i, keep, len(groups[key]), keep == i, key)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    kept = exact_dedup.keep_one(docs, fan_in)
    assert kept.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len(groups)


def test_exact_dedup_plan_is_native_and_splits_a_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    leaves = exact_dedup.with_digest(docs, 8).where("text = 'same'").groupBy("__run").count().collect()
    assert len(leaves) == 8 and max(r["count"] for r in leaves) < 250


@pytest.mark.parametrize("name", ["small", "odd", "none"])
def test_simhash(request, name):
    docs = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = simhash.simhash_dedup(docs).collect()
    assert len(got) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    roots = plain_components(prints)
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == roots[r.doc_id]
    # Null ids are in the component of their fingerprint.
    by_print = {f"{p:016x}": roots[i] for i, p in prints.items()}
    assert all(r.component_id == by_print[r.fingerprint] for r in got)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(roots.values()))


@pytest.mark.parametrize("count", [10, 10**6, 10**9, 10**12])
@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_segments_cover_every_difference(count, radius):
    plan = simhash.segments(count, radius)
    assert sum(w for _, w, _ in plan) == 64 and sum(r + 1 for *_, r in plan) == radius + 1
    rng = np.random.default_rng(1)
    for _ in range(200):
        bits = rng.choice(64, radius, replace=False)
        assert any(sum(s <= b < s + w for b in bits) <= r for s, w, r in plan)


def test_all_close_fingerprints_are_linked(spark):
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    prints = {i: base[i % 20] ^ sum(1 << int(b) for b in rng.choice(64, i % 6, replace=False)) for i in range(200)}
    prints = {i: p for i, p in prints.items() if p not in [q for j, q in prints.items() if j < i]}
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()]
    classes = spark.createDataFrame(signed, "id long, fp long")
    want = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4}
    got = {tuple(r) for r in simhash.links(classes).collect()}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(5, 5), (9, 8), (8, 7), (7, 9), (1, 9)]])
def test_components(spark, edges):
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges * len(edges):
        low = min(root.get(a, a), root.get(b, b))
        root[a], root[b] = low, low
        if len(edges) > 250:
            root = {i: 0 for i in range(301)}
            break
    assert got == {i: r for i, r in root.items() if i != r}
