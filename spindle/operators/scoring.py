"""Queries: terms and groups, all-words matching and BM25F over zones, for a batch of queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analysis import AnalyzerConfig, analyze, exploded
from .config import EngineConfig
from .index import Index
from .tables import checkpointed

#: Most query rows that are broadcast; a larger batch is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Places to which scores are compared: sums differ in the last bits with the order of their terms.
TIES = 9


def broadcast_if_few(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, to be broadcast only once its rows are counted and are few."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def query_terms(queries: DataFrame, analyzer: AnalyzerConfig | None = None) -> DataFrame:
    """query_id, pos, ord, term of queries (query_id, q). The field is dropped: a term matches in any zone.

    Written once: the analyzer is a large expression, and a search reads its terms many times.
    """
    rows = exploded(analyze(queries, "q", "query", analyzer), "postings", "query_id")
    return checkpointed(rows.select("query_id", F.col("p.pos").alias("pos"), F.col("p.ord").alias("ord"), F.col("p.term").alias("term")).groupBy("query_id", "pos", "term").agg(F.min("ord").alias("ord")))


def score(index: Index, terms: DataFrame, config: EngineConfig | None = None, every_word: bool = True) -> DataFrame:
    """query_id, doc_id, score, rank of the documents that have a term of every position of a query.

    A term that a query repeats adds its score once but makes a group for each position. `every_word=False` scores any
    match. Terms come as query_id, pos, term. Equal scores are ranked by doc_id.
    """
    config = config or EngineConfig()
    groups = terms.groupBy("query_id", "term").agg(F.collect_set("pos").alias("groups"))
    needed = terms.groupBy("query_id").agg(F.count_distinct("pos").alias("needed"))
    asked = broadcast_if_few(checkpointed(groups.join(needed, "query_id")))
    n = index.doc_count()
    df = checkpointed(index.df_for_terms(terms).where(F.col("df") > 0))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = index.avg_zone_lengths().withColumn("weight", config.zone_weight(F.col("zone")))
    hits = index.postings.join(asked, "term").join(broadcast_if_few(df.select("term", idf.alias("idf"))), "term").join(F.broadcast(weights), "zone")  # zones are few names
    norm = F.when(F.col("avg_len") > 0, 1 - config.b + config.b * F.col("len") / F.col("avg_len")).otherwise(1.0)
    share = F.col("weight") * F.col("kw") * F.col("tf") / F.when(norm <= 0, 1.0).otherwise(norm)
    # Dealt by query and document once: both aggregates below keep to that.
    by_term = hits.select("query_id", "doc_id", "term", "groups", "needed", "idf", share.alias("share")).repartition("query_id", "doc_id").groupBy("query_id", "doc_id", "term").agg(
        F.sum("share").alias("wtf"), F.first("groups").alias("groups"), F.first("needed").alias("needed"), F.first("idf").alias("idf")
    )
    per_doc = by_term.groupBy("query_id", "doc_id").agg(
        F.sum(F.col("idf") * F.col("wtf") / (config.k1 + F.col("wtf"))).alias("score"), F.size(F.array_distinct(F.flatten(F.collect_list("groups")))).alias("met"), F.first("needed").alias("needed")
    )
    if every_word:
        per_doc = per_doc.where(F.col("met") >= F.col("needed"))
    return ranked(per_doc.where(F.col("score") > 0).select("query_id", "doc_id", "score"))


def ranked(scores: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.round("score", TIES).desc(), F.col("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order))


def cut(scores: DataFrame, limit: int) -> DataFrame:
    """The first `limit` ranks, at least one, with scores rounded to 4 places."""
    return scores.where(F.col("rank") <= max(limit, 1)).withColumn("score", F.round("score", 4))
