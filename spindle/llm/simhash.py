"""SimHash near-duplicates: fingerprints, pigeonhole blocks, and the components of the links.

Two fingerprints that differ in at most 4 of 64 bits agree on at least 2 of 6 blocks, so every link shows in one of the
15 ways to choose 2 blocks. Distinct fingerprints, not documents, are joined on those bits and verified. near_duplicates
gives the components of such links; one_of_each takes them as candidates for pairs of a given similarity, verifies these on
the shingles themselves, and lets overlap.py add the pairs of that similarity whose fingerprints are further apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import overlap
from .common import broadcast_if_few, checkpointed, hot_join, key_of, row_key, unused
from .shingles import fingerprint_of, hashes

#: From this size on, a bucket gives the links of a spanning forest of itself instead of all its links.
FOREST_FROM = 24
#: Edges that are made into stars at a time.
CHUNK = 1 << 19


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit fingerprint of a text, unsigned; zero for a text without words."""
    return fingerprint_of(hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_md5 and fp (the fingerprint's bits as a signed long) of every document; other columns are not read."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.int64())], ["doc_id", "text_md5", "fp"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_md5"), text.alias("text"))
    return read.mapInArrow(each, "doc_id long, text_md5 string, fp long")


def blocks_for(prints: int, distance: int = 4) -> int:
    """How many blocks suit a number of distinct fingerprints: the fewest whose chosen bits part them into buckets of about
    32 or fewer (6 blocks up to some 70 million fingerprints, 7 up to some 5 billion at a distance of 4)."""
    blocks = distance + 2
    while blocks < 2 * distance and prints >> (64 * (blocks - distance) // blocks) > 32:
        blocks += 1
    return blocks


def masks(distance: int = 4, blocks: int = 6) -> list[int]:
    """The bits of each choice of blocks - distance blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [int(np.array(sum(chosen), np.uint64).view(np.int64)) for chosen in combinations(block, blocks - distance)]


def _differing(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Differing bits; counted on unsigned numbers, since numpy counts the bits of a signed one's magnitude."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _bucket_links(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The links of a spanning forest of one bucket of distinct fingerprints: one per fingerprint at most."""
    out, left = [], fps
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = _differing(left, front[0]) <= distance
            found = left[near]
            out.append((np.broadcast_to(front[0], len(found)), found))
            front, left = np.concatenate([front[1:], found]), left[~near]
    return out


def links(nodes: DataFrame, distance: int = 4, blocks: int | None = None, forest_from: int = FOREST_FROM) -> DataFrame:
    """Verified links a, b between distinct fingerprints (column fp) that keep every component whole.

    Buckets of fewer than `forest_from` fingerprints give all their links; larger ones those of a spanning forest of their
    links, so that a group of m near copies gives about m links, not m * m: the components are the same, the set of links is not.
    Each bucket is a run of sorted 8-byte numbers that is read as a stream. Without `blocks` their number follows that of the nodes.
    """
    chosen = masks(distance, blocks or blocks_for(nodes.count(), distance))
    table = F.array(*[F.struct(F.lit(k).cast("byte").alias("k"), F.lit(m).alias("m")) for k, m in enumerate(chosen)])
    keyed = nodes.select("fp", F.explode(table).alias("t")).select("fp", F.col("t.k").alias("k"), F.col("fp").bitwiseAND(F.col("t.m")).alias("bits"))
    keyed = keyed.repartition("k", "bits").sortWithinPartitions("k", "bits")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(fp: np.ndarray, k: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(fp):
                return
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (bits[1:] != bits[:-1])])
            sizes = np.diff(np.r_[new, len(fp)])
            size = np.repeat(sizes, sizes)
            pairs = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            small = size < forest_from
            for step in range(1, int(size[small].max(initial=1))):
                i = np.flatnonzero(small[:-step] & (size[:-step] > step))
                i = i[(k[i] == k[i + step]) & (bits[i] == bits[i + step])]
                i = i[_differing(fp[i], fp[i + step]) <= distance]
                pairs.append((fp[i], fp[i + step]))
            for start, n in zip(new[sizes >= forest_from], sizes[sizes >= forest_from]):
                pairs += _bucket_links(fp[start : start + n], distance)
            a, b = (np.concatenate(x) for x in zip(*pairs))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        kept: list[list[np.ndarray]] = []
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(now[0]):
                continue
            same = (now[1] == now[1][-1]) & (now[2] == now[2][-1])
            cut = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
            if not cut and kept and (kept[0][1][0], kept[0][2][0]) == (now[1][-1], now[2][-1]):
                kept.append(now)  # a bucket of several batches is put together once
                continue
            yield from found(*[np.concatenate(x) for x in zip(*kept, [x[:cut] for x in now])])
            kept = [[x[cut:] for x in now]]
        if kept:
            yield from found(*[np.concatenate(x) for x in zip(*kept)])

    return keyed.mapInArrow(verify, "a long, b long").distinct()


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges, made into stars: each node that has a smaller one in its component, and the smallest one there."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(ids))
    a, b = at[: len(u)], at[len(u) :]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]


def components(edges: DataFrame, rounds: int = 60, chunk: int = CHUNK) -> DataFrame:
    """fp and root (the smallest fp that links reach, as a signed number) of every fp that has a link.

    Each round makes stars of the edges, at most `chunk` at a time, and where they took more than one task, alternates a large
    and a small star over all of them; it is checkpointed, so a lost executor costs a round at most. The loop ends once every
    fp has one link, to a root that has none.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            u, v = _forest(*(np.concatenate(x) for x in zip(*kept)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if kept and sum(len(k[0]) for k in kept) + part.num_rows > chunk:
                    yield made()
                    kept.clear()
                kept.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
        if kept:
            yield made()

    edges = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    for _ in range(rounds):
        tasks = max(1, -(-edges.count() // chunk))
        edges = edges.coalesce(tasks).mapInArrow(stars, "u long, v long")
        if tasks == 1:
            edges = checkpointed(edges)
            break
        edges = edges.distinct()
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = checkpointed(small.where(F.col("u") != F.col("v")).distinct())
        state = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
        if (state["n"] or 0) <= 1 and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, distance: int = 4, blocks: int | None = None, width: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach, its own included) of every document.

    A text that is null, empty or blank has fingerprint zero and links like any other. Equal fingerprints are one node, so
    copies and repeated rows cost nothing in the join. Rows with a null doc_id take part; a component of nothing else has
    a null component_id. An empty table gives no rows. Other columns are not read.
    """
    prints = checkpointed(fingerprints(docs, width).select("doc_id", "fp"))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = components(links(nodes.select("fp"), distance, blocks)).withColumnRenamed("fp", "fp_")
    linked = checkpointed(nodes.join(rooted, nodes["fp"] == rooted["fp_"]).select("fp", "root", "least"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("reached"))
    reached = linked.join(smallest, "root").select(F.col("fp").alias("fp_"), "root", "reached")
    named = nodes.join(reached, nodes["fp"] == reached["fp_"], "left").select("fp", F.least("reached", "least").alias("component_id"))
    return hot_join(prints, named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, width: int = 5, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """The documents, with all their columns, of which one of each group of near duplicates stays: the smallest doc_id.

    Near duplicates have sets of `width`-word shingles with a Jaccard of `similarity` or more, and groups are what such pairs
    reach. Fingerprints within `distance` bits give candidates by pigeonhole blocks; of the pairs further apart, which at 0.8
    are nine in ten, overlap.py leaves none out. Texts without words are one group; those of fewer words are near only if equal
    but for A-Z and blanks. Of several rows with a group's smallest doc_id the one whose text has the smallest MD5 stays, and of
    rows that repeat in id and text any one. Rows without a doc_id stay only if their whole group has none. Columns may have any
    names; an empty table gives no rows.
    """
    prints = checkpointed(overlap.prints(docs, similarity, width))
    there = prints.where("n > 0")
    nodes = checkpointed(there.groupBy("sid").agg(F.min(key_of(F.col("doc_id"), F.col("text_md5"))).alias("key"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("profile").alias("profile")))
    prefixes = there.groupBy("sid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    of_print = nodes.groupBy("fp").agg(F.min("sid").alias("first"))
    same = hot_join(nodes.select("fp", "sid"), of_print, "fp").where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b"))
    close = links(of_print.select("fp"), distance, blocks)
    one, two = (of_print.select(F.col("fp").alias(x), F.col("first").alias(f"{x}_")) for x in "ab")
    close = close.join(one, "a").join(two, "b").select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"))
    rooted = overlap.links(docs, nodes, prefixes, close.union(same), similarity, width).select(F.col("fp").alias("sid"), "root")
    own = prints.select("sid", F.lit(True).alias("own")).distinct().join(rooted, "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"))
    return stay(docs, hot_join(prints.select("doc_id", "text_md5", "sid"), own, "sid"))


def stay(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """One document of each root, as one_of_each says; grouped has doc_id, text_md5 and root of every document.

    Only keys are gathered: those of the documents that go and those of rows that repeat. The texts are read once more and, where
    such keys are few enough to broadcast, not shuffled.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_md5", "key")
    each = grouped.withColumn("key", key_of(F.col("doc_id"), F.col("text_md5"))).groupBy("root", "doc_id", "text_md5", "key").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.key").alias("key"), F.lit(True).alias("best"))
    key = unused(docs, "key_")
    marked = checkpointed(each.select("key", "n").join(best, "key", "left").where("best IS NULL OR n > 1").select(F.col("key").alias(key), F.col("best").isNotNull().alias("best_")))
    touched = broadcast_if_few(marked.select(key))
    named = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    kept = named.join(touched, key, "left_anti")
    twice = checkpointed(marked.where("best_").select(key))
    if not twice.isEmpty():
        kept = kept.unionByName(named.join(broadcast_if_few(twice), key, "left_semi").dropDuplicates([key]))
    return kept.drop(key)
