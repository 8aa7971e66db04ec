"""Nearest neighbours against all cosines."""

import numpy as np
import pytest

from spindle.llm import ann, registry


def brute(ids, vectors, asked, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        cos = unit @ unit[ids == q][0]
        order = [i for i in np.lexsort((ids, -np.round(cos, 12))) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(cos[i])) for i in order]
    return out


@pytest.mark.parametrize("shard", [100_000, 150])
def test_factor_one_is_exact(spark, sf, shard):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), factor=1.0, shard=shard, block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute(ids, vectors, ids[ids % 20 == 0], 5)
    assert {q: [x for x, _ in v] for q, v in got.items()} == {q: [x for x, _ in v] for q, v in expected.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in expected for a, b in zip(got[q], expected[q]))


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    expected = brute(ids, vectors, ids[ids % 50 == 0], 5)
    got = registry.op7_nearest(spark, sf).collect()
    assert len(got) == 5 * len(expected)
    assert np.mean([r.vec_id in [x for x, _ in expected[r.query_id]] for r in got]) >= 0.9


def test_pruning_of_clustered_vectors():
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.normal(size=(40, 3)), 100, axis=0) + rng.normal(scale=0.01, size=(4000, 3))
    tree = ann.build(np.arange(4000), vectors)
    expected = brute(np.arange(4000), vectors, range(0, 4000, 100), 5)
    for factor, least in ((1.0, 1.0), (0.5, 0.9)):
        got = {q: ids.tolist() for q, ids, _ in ann.search(tree, vectors[::100], np.arange(0, 4000, 100), 5, factor)}
        assert np.mean([len({x for x, _ in expected[q]} & set(got[q])) / 5 for q in expected]) >= least


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [0.0, 1.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (10, [])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, shard string")
    got = [(r.query_id, r.vec_id, round(r.score, 6)) for r in ann.nearest(table, table).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1.0), (0, 2, 1.0), (0, 8, 0.0), (1, 0, 1.0), (1, 2, 1.0), (1, 8, 0.0), (2, 0, 1.0), (2, 1, 1.0), (2, 8, 0.0), (8, 0, 0.0), (8, 1, 0.0), (8, 2, 0.0)]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(600)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ann.nearest(same, same.where("vec_id = 3")).orderBy("rank").collect()] == [0, 1, 2, 4, 5]
    assert ann.nearest(table.limit(0), table).count() == ann.nearest(table, table.limit(0)).count() == 0


def test_equal_vectors_have_equal_scores(spark):
    """Copies at any place of any shard come in the order of their ids."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64))
    rows = [(int(i), base[i % 60].tolist()) for i in rng.permutation(540)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, table.where("vec_id < 60"), k=8, factor=1.0, shard=130).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [q + 60 * k for k in range(1, 9)] for q in range(60)}


def test_very_large_and_very_small_vectors_take_part(spark):
    rows = [(0, [1e200, 1.0]), (1, [1e200, 2e200]), (2, [1.0, 0.0]), (3, [1e-300, 2e-300]), (4, [5e-324, 0.0]), (5, [1.7e308, -1.7e308])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in ann.nearest(table, table, k=2, factor=1.0).collect()}
    assert len(got) == 12 and got[2, 1] == (0, 1.0) and got[2, 2] == (4, 1.0) and got[1, 1] == (3, 1.0) and got[5, 1][1] == round(0.5**0.5, 9)


def test_one_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [1.0, 1.0]), (0, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(table, table.where("vec_id = 0"), k=3, factor=1.0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 0.707107)]


def test_trees_of_one_task(spark, sf):
    """200 shards in 64 groups: a task answers from several trees, and the merged answers are those of all cosines."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), factor=1.0, shard=-(-len(ids) // 200), block=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [x for x, _ in v] for q, v in brute(ids, vectors, ids[ids % 20 == 0], 5).items()}


def test_no_row_holds_a_tree_or_a_block(spark, sf):
    """What is shuffled and sorted is rows of one vector: not trees, blocks of queries, or pairs of both."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    plan = ann.nearest(table, table.where("vec_id % 20 = 0"), shard=150)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "Join" not in plan and "binary" not in plan
