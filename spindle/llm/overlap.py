"""The exact half of SimHash near-duplicates: every pair of documents whose shingle sets have a Jaccard of p/q or more.

Fingerprints within a few bits miss most such pairs, so further candidates come from prefix filtering, which leaves none out:
with all sets in one order, two sets of such a Jaccard share an element among the first n - ceil(n * p/q) + 1 of each. The
order puts shingles that a sample of the documents has often last; any order is right, this one keeps buckets small. Every
candidate is verified on the whole sets. Shingles and sets go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, checkpointed, compact, row_key
from .shingles import fingerprint_of, hashes

#: Documents that the order of shingles is taken from, and the shingles it tells apart from rare ones.
SAMPLE, COMMON = 20_000, 100_000
#: From this size on, a bucket is first compared with one of its members, in some turns; what they leave apart is compared in full.
STAR_FROM, STARS = 8, 2
#: Pairs that a task holds back to give each once, and the tasks that the buckets of one group of sets are dealt to.
PENDING, TASKS = 1 << 19, 8
#: Bins of a set's profile: how many of its shingles have each remainder. Two sets share no more than their profiles do.
BINS = 128


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted hashes of the distinct runs of `width` words; a shorter text is one run, a text without words none."""
    return np.unique(hashes(text, width).view(np.int64))


def _ratio(similarity: float) -> tuple[int, int]:
    """The similarity as the fraction p/q that its decimals say; |A & B| * (p + q) >= p * (|A| + |B|) compares a Jaccard with it."""
    got = Fraction(str(similarity))
    return got.numerator, got.denominator


def _profile(own: np.ndarray) -> bytes:
    """Counts of the shingles by remainder, 16 bits each; one that doesn't fit makes all of them the most there is."""
    counts = np.bincount(own.view(np.uint64) % np.uint64(BINS), minlength=BINS)
    return (counts if counts.max() < 65_535 else np.full(BINS, 65_535)).astype("<u2").tobytes()


def _name(own: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 7)).view(np.int64))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """sid and grams (the whole set) of each text in the column text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py(), width) for t in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sid", "grams"])

    return docs.select("text").mapInArrow(each, "sid long, grams array<long>")


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that a sample has most often, sorted, and how often; a sample by hash, so the same at each run."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    some = docs.select(_text().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000))
    often = _sets(some, width).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    rows = often.where("often > 2").orderBy(F.desc("often"), "gram").limit(COMMON).toArrow().sort_by("gram")
    return rows["gram"].to_numpy(), rows["often"].to_numpy()


def prints(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """doc_id, text_md5, sid (names the set), n (its size), fp (the fingerprint, signed), prefix and profile of every document."""
    grams, often = _common(docs, width)
    p, q = _ratio(similarity)

    def prefix(own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(grams, own), max(len(grams) - 1, 0))
        weight = np.where(grams[at] == own, often[at], 0) if len(grams) else np.zeros(len(own), np.int64)
        return own[np.lexsort((own, weight))][: len(own) + p * len(own) // -q + 1] if len(own) else own

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every = [hashes(t.as_py(), width) for t in part.column(2)]
                sets = [np.unique(h.view(np.int64)) for h in every]
                named = pa.array([_name(s) for s in sets], pa.int64())
                bits = pa.array(np.array([fingerprint_of(h) for h in every], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), named, pa.array([len(s) for s in sets], pa.int32()), bits, pa.array([prefix(s) for s in sets], pa.list_(pa.int64())), pa.array([_profile(s) for s in sets], pa.binary())], ["doc_id", "text_md5", "sid", "n", "fp", "prefix", "profile"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(_text()).alias("text_md5"), _text().alias("text"))
    return read.mapInArrow(each, "doc_id long, text_md5 string, sid long, n int, fp long, prefix array<long>, profile binary")


def _candidates(keyed: DataFrame, turn: int | None, similarity: float) -> DataFrame:
    """Pairs a, b of each bucket (key) that lengths and places allow, unless they have one root already.

    keyed has key, sid, place (the shingle's place in the prefix, then the size of the set, 32 bits each) and, if the sets
    have roots by now, root. Small buckets give all their pairs. Larger ones those of the member that `turn` picks, and, with
    b null, their own rows for later turns; with no turn all their pairs too.
    """
    columns = ["key", "sid", "place", *(["root", "fp"] if "root" in keyed.columns else [])]
    p, q = _ratio(similarity)
    # Buckets of one group of sets mostly have the same first member: together they give a pair once.
    dealt = keyed.repartition("lead", F.pmod("key", F.lit(TASKS))) if "root" in keyed.columns else keyed.repartition("key")
    keyed = dealt.select(*columns).sortWithinPartitions("key", "sid")

    def allowed(r: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, sid, place = r[:3]
        n, left = place & 0xFFFFFFFF, (place & 0xFFFFFFFF) - (place >> 32)
        both = np.minimum(left[i], left[j])  # at the first common shingle, no more can be common
        ok = (sid[i] != sid[j]) & ((p + q) * both >= p * (n[i] + n[j]))
        if len(r) == 3:
            return i[ok], j[ok]
        ok &= r[3][i] != r[3][j]
        return i[ok], j[ok]

    def found(r: list[np.ndarray]) -> Iterator[np.ndarray | pa.RecordBatch]:
        key, sid, place = r[:3]
        if not len(key):
            return

        def pairs(some: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
            i, j = (np.concatenate(x) for x in zip(*some))
            yield np.stack([np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])], axis=1)

        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[new, len(key)])
        size = np.repeat(sizes, sizes)
        small = size < STAR_FROM
        some = [(np.empty(0, np.int64),) * 2]
        for step in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero(small[:-step] & (key[:-step] == key[step:]))
            some.append(allowed(r, i, i + step))
        yield from pairs(some)
        for start, many in zip(new[sizes >= STAR_FROM], sizes[sizes >= STAR_FROM]):
            every = np.arange(start, start + many)
            if turn is None:
                for i in every[:-1]:
                    yield from pairs([allowed(r, np.full(start + many - i - 1, i), np.arange(i + 1, start + many))])
                continue
            if turn:
                yield from pairs([allowed(r, np.full(many, centre(r, every)), every)])
                continue
            i = start + int(np.argmin(sid[every].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            yield from pairs([allowed(r, np.full(many, i), every)])
            yield pa.RecordBatch.from_arrays([pa.array(key[every]), pa.array(place[every]), pa.array(sid[every]), pa.nulls(many, pa.int64())], ["key", "place", "a", "b"])

    def centre(r: list[np.ndarray], every: np.ndarray) -> int:
        prints = r[4][every].view(np.uint64)
        most = np.zeros(1, np.uint64)
        for bit in range(64):
            if 2 * int((prints >> np.uint64(bit) & np.uint64(1)).sum()) > len(prints):
                most |= np.uint64(1 << bit)
        return int(every[np.argmin(np.bitwise_count(prints ^ most))])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray | pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if not cut and kept and kept[0][0][0] == now[0][-1]:
                kept.append(now)
                continue
            yield from found([np.concatenate(x) for x in zip(*kept, [c[:cut] for c in now])])
            kept = [[c[cut:] for c in now]]
        if kept:
            yield from found([np.concatenate(x) for x in zip(*kept)])

    def batch_of(both: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(both), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(both[:, 0]), pa.array(both[:, 1])], ["key", "place", "a", "b"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The buckets' rows; a pair that several buckets of a task have is given once as far as PENDING pairs reach."""
        pending, size = [np.empty((0, 2), np.int64)], 0
        for x in buckets(batches):
            if isinstance(x, pa.RecordBatch):
                yield x
                continue
            pending.append(x)
            size += len(x)
            if size > PENDING:
                both = np.unique(np.concatenate(pending), axis=0)
                pending, size = [both], len(both)
                if size > PENDING // 2:
                    yield batch_of(both)
                    pending, size = [both[:0]], 0
        yield batch_of(np.unique(np.concatenate(pending), axis=0))

    return keyed.mapInArrow(stream, "key long, place long, a long, b long")


def links(docs: DataFrame, nodes: DataFrame, prefixes: DataFrame, close: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """fp (a set's name) and root of every set that reaches another by pairs of Jaccard `similarity` or more.

    nodes has sid, key (of one document that makes the set), n, fp and profile of each set, prefixes sid, n and prefix; close has
    pairs a, b that are candidates already. These and the candidates of small buckets are verified together; large buckets whose members
    they have not yet made one are looked at again, by one member a turn and at last in full.
    """
    from .simhash import components

    place = F.shiftleft(F.col("at").cast("long"), 32) + F.col("n")
    keyed = prefixes.select("sid", "n", F.posexplode("prefix").alias("at", "key")).select("key", "sid", place.alias("place"))
    edges, turn, large, met = None, 0, None, -1
    while True:
        got = checkpointed(_candidates(keyed, turn if turn < STARS else None, similarity))
        pairs = got.where("b IS NOT NULL").select("a", "b")
        pairs = _possible(nodes, compact(checkpointed((pairs if turn else pairs.union(close)).distinct())), similarity)
        true = _verified(docs, nodes, pairs, similarity, width)
        edges = compact(checkpointed(true if edges is None else edges.union(true).distinct()))
        rooted = components(edges)
        large = compact(got.where("b IS NULL").select("key", "place", F.col("a").alias("sid"))) if large is None else large
        if turn >= STARS or large.isEmpty():
            return rooted
        named = large.join(rooted.withColumnRenamed("fp", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        split = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("sid").alias("lead")).where("lo < hi").select("key", "lead")
        named = compact(checkpointed(named.join(split, "key")))
        if named.isEmpty():
            return rooted
        keyed = named.join(nodes.select("sid", "fp"), "sid")
        met, before = edges.count(), met
        turn = turn + 1 if met > before else STARS  # a turn without a new link is the last but the one in full


def _possible(nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose profiles allow the similarity; a set's profile is a small part of the set."""
    p, q = _ratio(similarity)
    ids = compact(checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()))
    some = nodes.join(broadcast_if_few(ids), "sid", "left_semi")
    one, two = (some.select(F.col("sid").alias(x), F.col("n").alias(f"{x}n"), F.col("profile").alias(f"{x}p")) for x in "ab")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                h = [np.frombuffer(b"".join(part.column(k).to_pylist()), "<u2").reshape(-1, BINS) for k in (4, 5)]
                n = part.column(2).to_numpy().astype(np.int64) + part.column(3).to_numpy()
                ok = pa.array((p + q) * np.minimum(*h).sum(axis=1, dtype=np.int64) >= p * n)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "an", "bn", "ap", "bp")
    return compact(checkpointed(both.mapInArrow(each, "a long, b long")))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs whose whole sets have a Jaccard of the similarity or more; only one text of a set in a pair is read again."""
    p, q = _ratio(similarity)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    needed = checkpointed(nodes.join(ids, "sid", "left_semi").select("key"))
    texts = docs.select(_text().alias("text"), row_key(F.col("doc_id"), F.col("text")).alias("key")).join(broadcast_if_few(needed), "key", "left_semi")
    sets = _sets(texts, width).groupBy("sid").agg(F.first("grams").alias("grams"))
    one, two = (sets.select(F.col("sid").alias(x), F.col("grams").alias(f"{x}s")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("as", "bs")))
    return both.where((p + q) * F.col("common") >= p * (F.size("as") + F.size("bs"))).select("a", "b")
