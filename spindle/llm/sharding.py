"""A reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows are numbered in the order of a digest of their id and text, so the numbers depend on the rows alone, not on files,
partitions or hot keys. The permuted number p of a row gives its shard (p mod shards) and its slot (p div shards), so the
counts of shards differ by one at most, and anyone who knows a row's number can compute where it is (locate()).
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Leading hex digits of the digest that name a bucket: the broadcast counts have at most 16**3 rows.
BUCKET_DIGITS = 3
#: Steps of cycle walking; see permuted().
WALK = 64
ROUNDS = 6
SEED = "deal"


def radices(n: int) -> tuple[int, int]:
    """Factors a and b with a * b >= n, a the rounded-up root of n and b as small as it can be."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def locate(number: int, n: int, shards: int, rounds: int = ROUNDS, seed: str = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, without Spark."""
    a, b = radices(n)
    digest = lambda i, x: int(hashlib.md5(f"{seed}:{i}:{x}".encode()).hexdigest()[:15], 16)
    x = number
    while True:
        right, left = divmod(x, a)
        for i in range(rounds):
            if i % 2:
                right = (right + digest(i, left)) % b
            else:
                left = (left + digest(i, right)) % a
        x = right * a + left
        if x < n:
            return x % shards, x // shards


def permuted(number: Column, n: int, rounds: int = ROUNDS, seed: str = SEED) -> Column:
    """The place of each row number 0 to n-1 under a seeded bijection of 0 to n-1; as an expression, no Python.

    An alternating Feistel network over pairs (left, right) of the two radices permutes 0 to a*b-1; a number that lands at
    n or beyond walks on until it is below n. A walk takes at most a*b-n+1 steps, and a*b-n is less than the root of n.
    Where that is over WALK, a longer walk has a probability under n**-30; such a row raises an error.
    """
    a, b = radices(n)
    below = lambda x, m: F.floor((x - x % m) / m).cast("long")
    digest = lambda i, x: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), i.cast("string"), x.cast("string"))), 1, 15), 16, 10).cast("long")
    pair = lambda left, right: F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(p: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, pair(p["l"], (p["r"] + digest(i, p["l"])) % b)).otherwise(pair((p["l"] + digest(i, p["r"])) % a, p["r"]))

    def step(s: Column, _: Column) -> Column:
        out = lambda p: F.struct((p["r"] * a + p["l"]).alias("x"), (p["r"] * a + p["l"] < n).alias("done"))
        return F.when(s["done"], s).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), pair(s["x"] % a, below(s["x"], a)), turn, out))

    steps = max(1, min(a * b - n + 1, WALK))
    start = F.struct(number.cast("long").alias("x"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: F.when(s["done"], s["x"]).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))


def deal(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents dealt into shards: doc_id, size, text_crc32, row_number, shard, slot.

    A null text counts as empty (size 16, CRC of no bytes); a null doc_id is numbered like any other. Rows that repeat in
    id and text are counted before the shuffle and given neighbouring numbers; each keeps a place of its own. An empty
    table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("digest"),
    )
    rows = checkpointed(rows.groupBy("doc_id", "size", "text_crc32", "digest").agg(F.count(F.lit(1)).alias("copies")))
    rows = rows.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    n = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("n")).first()["n"]
    counts = rows.groupBy("bucket").agg(F.sum("copies").alias("there"))
    before = counts.select("bucket", (F.sum("there").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("there")).alias("base"))
    within = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.join(F.broadcast(before), "bucket").withColumn("last", F.col("base") + F.sum("copies").over(within) - 1).withColumn("first", F.col("last") - F.col("copies") + 1)
    each = numbered.withColumn("chunk", F.explode(F.sequence("first", "last", F.lit(4096).cast("long")))).withColumn("row_number", F.explode(F.sequence("chunk", F.least(F.col("chunk") + 4095, F.col("last")))))
    placed = each.withColumn("place", permuted(F.col("row_number"), n))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.floor((F.col("place") - F.col("place") % shards) / shards).cast("long").alias("slot"))
