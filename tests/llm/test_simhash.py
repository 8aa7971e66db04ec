"""SimHash against its definition worked out by brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindle.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, prints):
    n = len(ids)
    p = np.array(prints, np.uint64)
    name = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 4):
            a, b = name[i], name[int(j)]
            if a != b:
                name = [min(a, b) if x in (a, b) else x for x in name]
    best = {}
    for i, g in zip(ids, name):
        if i is not None:
            best[g] = min(best.get(g, i), i)
    return [best.get(g) for g in name]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_components_are_those_of_all_pairs(request, which):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    prints = [plain(r.text) for r in rows]
    expected = sorted((str(r.doc_id), p, str(c)) for r, p, c in zip(rows, prints, smallest([r.doc_id for r in rows], prints)))
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


def test_links_keep_components_of_dense_and_chained_prints(spark):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(4)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(120)}
    x = rng.getrandbits(64)
    for _ in range(40):
        x ^= sum(1 << b for b in rng.sample(range(64), 4))
        prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp long")
    edges = simhash.links(nodes)
    assert edges.count() < 15 * len(prints)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    got = {r.fp & (2**64 - 1): r.root for r in simhash.components(edges).collect()}
    assert got == {r.fp & (2**64 - 1): r.root for r in simhash.components(edges, chunk=150).collect()}
    names = smallest(list(range(len(prints))), prints)
    groups = {}
    for p, n in zip(prints, names):
        groups.setdefault(n, set()).add(p)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(p for p in got if got[p] == r) for r in set(got.values())}


def test_blocks_follow_the_number_of_fingerprints():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**8, 10**10)] == [6, 6, 7, 8]
    for blocks in (6, 7, 8):
        rng = random.Random(blocks)
        for _ in range(200):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(flips & (m & (2**64 - 1)) == 0 for m in simhash.masks(4, blocks))


def test_a_bucket_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        prints = sorted({(1 << 40) ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)})
        edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
        assert {r.root for r in simhash.components(edges).collect()} == {min(prints)} and simhash.components(edges).count() == len(prints)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_fingerprints(spark):
    docs = spark.createDataFrame([(i, "the same words for all of these" if i % 2 else f"other words {i}") for i in range(4000, 0, -1)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(got) == 4000 and {got[i] for i in range(1, 4000, 2)} == {1}


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.one_of_each(nothing).count() == 0
