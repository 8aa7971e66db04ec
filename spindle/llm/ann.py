"""Nearest neighbours by vantage-point trees, one per shard, with relaxed triangle-inequality pruning.

On unit vectors a larger cosine is a smaller distance, so trees prune by distance and answers are ranked by the cosine of
the original vectors. A query in a shard visits a subtree only if the triangle inequality, with the search radius scaled by
`factor`, cannot rule it out: factor 1 is exact, smaller factors prune more. A task plants the trees of a group of shards and
streams all queries past them, a row each; it answers a query from its trees together, and the answers of all groups are merged at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Vectors of a shard, of a leaf, and queries answered at a time.
SHARD, LEAF, BLOCK = 16_384, 256, 8192
#: Shards up to GROUPS are a group each; of more, at most TREES make a group, and GROUPS groups at least. A task holds one group's trees.
GROUPS, TREES = 64, 16
#: Distances of equal unit vectors come out as up to 1e-8 apart; bounds are compared with this much to spare.
SLACK = 1e-7


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two that brings its largest component to between 1/2 and 1: exact, and squares stay in range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def _sums(products: np.ndarray) -> np.ndarray:
    """The sum of each row, in an order that depends on its length alone: equal rows have equal sums wherever they stand."""
    return np.add.reduce(np.ascontiguousarray(products), axis=1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    own = _scaled(vectors)
    return own / np.sqrt(_sums(own * own))[:, None]


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """A vantage-point tree over rows of vectors as flat arrays.

    Node i has a vantage row, the radius that parts its rows, the ranges of distances on either side, and two children
    (-1: none); a leaf has a range of rows. Rows at equal distances, copies included, end in a leaf rather than a chain.
    """
    unit = _unit(vectors)
    rng = np.random.default_rng(seed)
    order = np.lexsort((ids,))
    nodes: list[list[float]] = []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][6 + side] = me
        rows = order[lo:hi]
        node = [lo, hi, -1, 0.0, 0.0, 0.0, -1, -1]
        nodes.append(node)
        if hi - lo <= LEAF:
            continue
        vantage = rows[rng.integers(len(rows))]
        away = np.sqrt(np.maximum(0, 2 - 2 * (unit[rows] @ unit[vantage])))
        radius = np.median(away)
        inner = away < radius
        if not inner.any() or inner.all():
            inner = away <= radius
            if inner.all():
                continue
        order[lo:hi] = np.concatenate([rows[inner], rows[~inner]])
        middle = lo + int(inner.sum())
        node[2:6] = [vantage, away[inner].max(), away[~inner].min(), 1.0]
        todo += [(middle, hi, me, 1), (lo, middle, me, 0)]
    return {"ids": ids, "vectors": vectors, "order": order, "nodes": np.array(nodes)}


def search(tree: dict[str, np.ndarray], queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float, known: list[tuple[int, np.ndarray, np.ndarray]] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its id and the ids and cosines of the k best rows found, its own id left out; ties to smaller ids.

    Of several rows with one id the nearest counts. `known` holds what other trees gave for the queries, to be merged with.
    """
    ids, order, nodes = (tree[x] for x in ("ids", "order", "nodes"))
    vectors, queries = _scaled(tree["vectors"]), _scaled(queries)
    norms, lengths = np.sqrt(_sums(vectors * vectors)), np.sqrt(_sums(queries * queries))
    unit, own = vectors / norms[:, None], queries / lengths[:, None]
    vantages = nodes[:, 2].astype(np.int64)
    split = np.flatnonzero(vantages >= 0)
    place = np.full(len(nodes), -1)
    place[split] = np.arange(len(split))
    from_vantage = np.sqrt(np.maximum(0, 2 - 2 * (own @ unit[vantages[split]].T))) if len(split) else np.zeros((len(own), 0))
    rows_of = nodes[:, :2].astype(np.int64)
    inner_far, outer_near, left, right = nodes[:, 3], nodes[:, 4], nodes[:, 6].astype(int), nodes[:, 7].astype(int)
    for q in range(len(own)):
        best_id, best_cos = known[q][1:] if known else (np.zeros(0, np.int64), np.full(0, -2.0))
        reach = float(np.sqrt(max(0.0, 2 - 2 * best_cos[-1]))) if len(best_cos) == k else 3.0
        todo = [(0.0, 0)]
        while todo:
            bound, i = todo.pop()
            if bound > factor * reach + SLACK:
                continue
            if place[i] < 0:
                rows = order[rows_of[i, 0] : rows_of[i, 1]]
                cos = unit[rows] @ own[q]
                if len(best_cos) == k:
                    rows = rows[cos >= best_cos[-1] - 1e-9]
                rows = rows[ids[rows] != query_ids[q]]
                if len(rows):
                    exact = _sums(vectors[rows] * queries[q]) / (norms[rows] * lengths[q])
                    all_cos, all_id = np.r_[best_cos, exact], np.r_[best_id, ids[rows]]
                    top = np.lexsort((all_id, -all_cos))
                    top = top[np.sort(np.unique(all_id[top], return_index=True)[1])][:k]
                    best_cos, best_id = all_cos[top], all_id[top]
                    if len(top) == k:
                        reach = float(np.sqrt(max(0.0, 2 - 2 * best_cos[-1])))
                continue
            d = from_vantage[q, place[i]]
            near = [(max(bound, d - inner_far[i]), left[i]), (max(bound, outer_near[i] - d), right[i])]
            todo += near[::-1] if near[0][0] <= near[1][0] else near
        yield int(query_ids[q]), best_id, best_cos


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles, or of floats if given so) and dim of vectors that are not null, zero or empty and hold finite numbers alone."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast(kind if kind == "array<float>" else "array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.size("embedding").alias("dim"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 0.9, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each query by cosine, its own vec_id left out.

    Both tables have vec_id and embedding; other columns are not read. Rows that repeat in id and vector count once. Of rows that
    share an id alone, each is a candidate and the nearest gives the id's score; as queries they have one answer together.
    Vectors of another length than the query's are no candidates. Every usable row is in a tree. A query with fewer than
    k candidates gets them all, one without any gets no row; empty tables give none.
    """
    rows = checkpointed(usable(vectors).distinct())
    shards = -(-rows.count() // shard) or 1
    groups = min(shards, max(GROUPS, -(-shards // TREES)))
    planted = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int")).withColumn("group", F.col("shard") % groups)
    asked = usable(queries).distinct().withColumn("shard", F.lit(-1)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = planted.withColumn("asks", F.lit(0)).unionByName(asked.withColumn("asks", F.lit(1))).select("group", "asks", "shard", "dim", "vec_id", "v")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, trees = -1, {}, None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                g, asks, s, dim = keys[lo].tolist()
                if g != group:
                    group, held, trees = g, {}, None
                ids = batch.column(4).slice(lo, hi - lo).to_numpy()
                own = np.array(batch.column(5).slice(lo, hi - lo).flatten(), float).reshape(hi - lo, dim)
                if not asks:
                    held.setdefault((dim, s), []).append((ids, own))
                    continue
                if trees is None:
                    trees = {}
                    for key in sorted(held):
                        parts = held.pop(key)
                        trees.setdefault(key[0], []).append(build(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
                for at in range(0, len(ids) if dim in trees else 0, block):
                    found = None
                    for tree in trees[dim]:
                        found = [*search(tree, own[at : at + block], ids[at : at + block], k, factor, found)]
                    sizes = [len(f[1]) for f in found]
                    columns = [np.repeat([f[0] for f in found], sizes), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    # Vectors come before queries in a group: a task holds its trees, and of the queries a batch.
    dealt = both.repartition(groups, "group").sortWithinPartitions("group", "asks", "shard", "dim")
    answers = dealt.mapInArrow(answer, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    answers = answers.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
