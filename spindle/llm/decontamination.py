"""Benchmark decontamination: token windows of documents against a broadcast hash set of benchmark n-grams.

One pass reads and splits the texts. Positions are first matched to a broadcast set of anchors, the word of each
benchmark n-gram that the benchmark itself has least often; only windows around an anchor are built and looked up in
the broadcast n-grams, by the n-gram itself, so a hit is verified by that very comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_few, checkpointed, key_of, repeated, row_key, unused, words

#: Most n-grams that are broadcast (some 30 MB). Beyond it, all windows are joined to the n-grams by a shuffle.
BROADCAST_GRAMS = 200_000


def grams(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The windows of benchmark items: gram, length, item. An item of fewer than n words, but not none, is one window.

    Null or blank texts have none; a null item_id is named by an empty string; repeated windows of an item count once.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    window = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.slice("w", i, n))
    return items.select("item", F.explode(window).alias("g")).select(F.array_join("g", " ").alias("gram"), F.size("g").alias("length"), "item").distinct()


def _anchors(found: DataFrame) -> DataFrame:
    """The word of each n-gram that the fewest n-grams have; of such words the longest."""
    each = found.select("gram").distinct().select("gram", F.explode(F.array_distinct(F.split("gram", " "))).alias("word"))
    often = each.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    best = F.min(F.struct("often", (-F.length("word")).alias("short"), "word"))
    return each.join(often, "word").groupBy("gram").agg(best.alias("best")).select(F.col("best.word").alias("word")).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, most: int = BROADCAST_GRAMS) -> DataFrame:
    """What each document shares with a benchmark: doc_id, text_md5, n_words, spans, items; one row per document.

    spans are the merged runs of hit words, array<struct<start, stop>> with words counted from 0 and stop exclusive;
    items are the sorted ids of items with an occurring window. A null text counts as empty, with no words. Repeated rows are
    worked out once and returned as often as they occur. Empty tables give no hits. Other columns are not read.
    """
    found = checkpointed(grams(benchmark, n))
    few = found.count() <= most
    lengths = sorted(r["length"] for r in found.select("length").distinct().collect())
    hint = F.broadcast if few else lambda x: x
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = text.select("doc_id", F.md5("text").alias("text_md5"), words(F.col("text")).alias("w"))
    # Position 0 is an empty word that every document has and the anchors include: it brings the document's own row.
    at = split.select("doc_id", "text_md5", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("p", "word"))
    if few:
        own = found.sparkSession.createDataFrame([("",)], "word string")
        at = at.join(F.broadcast(_anchors(found).union(own)), "word", "left_semi")
    first, last = F.greatest(F.col("p") - (n - 1), F.lit(1)), F.least(F.col("p") + (n - 1), F.size("w"))
    at = at.select("doc_id", "text_md5", "p", F.size("w").alias("n_words"), first.alias("from"), F.when(F.col("p") > 0, F.slice("w", first, last - first + 1)).otherwise(F.array().cast("array<string>")).alias("near"))
    # Windows of each length that hold the position; without anchors, those that begin there.
    shape = "struct<start:int,length:int,gram:string>"
    kinds = []
    for m in lengths:
        back = m - 1 if few else 0
        begin, end = F.greatest(F.col("p") - back, F.lit(1)), F.least(F.col("p"), F.col("from") + F.size("near") - m)
        begins = F.when((F.col("p") > 0) & (end >= begin), F.sequence(begin, end)).otherwise(F.array().cast("array<int>"))
        kinds.append(F.transform(begins, _window(m)))
    windows = F.concat(*kinds) if kinds else F.array().cast(f"array<{shape}>")
    at = at.select("doc_id", "text_md5", "n_words", (F.col("p") == 0).alias("own"), F.explode_outer(windows).alias("v")).select("doc_id", "text_md5", "n_words", "own", "v.*")
    hits = at.join(hint(found.select("gram", "item")), "gram", "left").where(F.col("own") | F.col("item").isNotNull())
    span = F.when(F.col("item").isNotNull(), F.struct("start", (F.col("start") + F.col("length")).alias("stop")))
    whole = hits.groupBy("doc_id", "text_md5").agg(
        F.sum(F.col("own").cast("long")).alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.collect_set(span).alias("spans"), F.sort_array(F.collect_set("item")).alias("items")
    )
    return repeated(whole.withColumn("spans", _merged("spans")), "copies")


def _window(m: int):
    """From a place in the text to the window of m words there, taken from the words near the anchor."""
    return lambda i: F.struct((i - 1).alias("start"), F.lit(m).alias("length"), F.array_join(F.slice("near", i - F.col("from") + 1, m), " ").alias("gram"))


def _merged(spans: str):
    """Sorted spans with those that touch or overlap made one."""
    kind = "array<struct<start:int,stop:int>>"
    tail = lambda a: F.element_at(a, -1)

    def add(a, s):
        longer = F.struct(tail(a)["start"].alias("start"), F.greatest(tail(a)["stop"], s["stop"]).alias("stop"))
        joins = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["stop"] >= s["start"])
        return F.when(joins, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer)).cast(kind)).otherwise(F.concat(a, F.array(s)).cast(kind))

    return F.aggregate(F.sort_array(spans), F.array().cast(kind), add)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The documents, with all their columns, that share no window with the benchmark; the others are removed.

    Documents are told apart by id and text. Empty texts share nothing and stay; repeated rows stay or go together. Keys of
    hits, not texts, are gathered: they are broadcast if counted few, else joined by a shuffle.
    """
    key = unused(docs, "key_")
    hit = checkpointed(scan(docs, benchmark, n).where(F.size("spans") > 0).select(key_of(F.col("doc_id"), F.col("text_md5")).alias(key)).distinct())
    return docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(broadcast_if_few(hit), key, "left_anti").drop(key)
