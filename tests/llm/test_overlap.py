"""Near duplicates by Jaccard against all pairs worked out by brute force."""

import random

import pytest

import corpus_pipeline
from spindle.llm import simhash


def kept(rows, p=4, q=5):
    """The ids that stay, from (doc_id, text): the smallest of each component of pairs with a Jaccard of 0.8 or more."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()})
    name = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if name[i] != name[j] and q * min(len(a), len(b)) >= p * max(len(a), len(b)) and q * len(a & b) >= p * len(a | b):
                old, new = name[i], name[j]
                name = [new if x == old else x for x in name]
    return sorted(min(r[0] for r, n in zip(rows, name) if n == g) for g in set(name))


def made(seed, groups, copies, words=120, changes=3):
    """Groups of near copies, each with some words changed, under one common passage; ids are mixed."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    texts = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own + common))
    ids = rng.sample(range(10 * len(texts)), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("groups,copies,changes", [(40, 4, 4), (3, 60, 4), (1, 80, 9)])
def test_all_pairs(spark, groups, copies, changes):
    rows = made(groups, groups, copies, changes=changes)
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_stage_drops_near_copies_that_differ_in_many_bits(spark, sf):
    """doc_id 177 and 1 (0.83), 145 and 6 (0.83) of the smallest table."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id IN (1, 177, 6, 145)")
    assert sorted(r.doc_id for r in corpus_pipeline.one_copy(spark, docs, sf).collect()) == [1, 6]


def test_odd_rows(odd, nothing):
    got = simhash.one_of_each(odd)
    assert got.columns == odd.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(["-8", "1", "4", "4", "6", "7", "None"])
    assert simhash.one_of_each(nothing).count() == 0


def test_other_similarities(spark):
    rows = made(9, 12, 5, changes=14)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for similarity, p, q in ((0.5, 1, 2), (0.95, 19, 20)):
        assert sorted(r.doc_id for r in simhash.one_of_each(docs, similarity=similarity).collect()) == kept(rows, p, q)


def test_hot_sets_and_repeated_rows(spark):
    """One text has over a thousand rows, some of them the same row."""
    rows = [(i % 1200, "one text that a third of all rows have") for i in range(1500)] + [(5000 + i, f"text {i} of its own with words w{i} x{i} y{i}") for i in range(60)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(r.doc_id for r in got.collect()) == [0, *range(5000, 5060)]


def test_profiles_bound_what_sets_share():
    import numpy as np
    from spindle.llm import overlap

    rng = random.Random(8)
    for n in (5, 300, 9000):
        a = overlap.shingles(" ".join(f"w{rng.randrange(n)}" for _ in range(n)))
        b = overlap.shingles(" ".join(f"w{rng.randrange(n)}" for _ in range(n)) + " w1 w2 w3 w4 w5")
        h = [np.frombuffer(overlap._profile(x), "<u2").astype(int) for x in (a, np.union1d(a[::2], b))]
        assert np.minimum(*h).sum() >= len(np.intersect1d(a, np.union1d(a[::2], b))) and h[0].sum() == len(a)
