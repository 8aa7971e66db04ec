"""Typo correction: words that no document has, their nearest frequent terms, what is applied and what only suggested."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from .config import EngineConfig
from .index import Index
from .scoring import broadcast_if_few
from .tables import checkpointed


@dataclass
class Expanded:
    """Terms with applied corrections added, and per query the suggestion (null: none) and the query that rerankers see."""

    terms: DataFrame
    queries: DataFrame
    corrections: DataFrame


def corrections(index: Index, terms: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """query_id, pos, word, term, distance, applied for unknown positions that have a match near enough.

    A position is unknown if no document has any of its terms; its longest term (the first of several) stands for it, from 3
    characters on. Candidates share the first character and are all terms of enough documents, or as many of the most frequent as a cap leaves.
    Of equally near ones the most frequent is taken, then the first.
    """
    config = config or EngineConfig()
    known = terms.join(index.df_for_terms(terms), "term").groupBy("query_id", "pos").agg(F.max("df").alias("df"), F.max_by("term", F.struct(F.length("term").alias("n"), (-F.col("ord")).alias("o"))).alias("word"))
    unknown = known.where((F.col("df") == 0) & (F.length("word") >= 3)).select("query_id", "pos", "word").withColumn("first", F.substring("word", 1, 1))
    words = broadcast_if_few(unknown.select("word", "first").distinct())
    if config.typo_vocab_cap is None:
        vocabulary = index.named_frequencies(config.typo_min_freq)
    else:
        vocabulary = index.vocabulary(F.lit(True), config.typo_vocab_cap, config.typo_min_freq)
    near = vocabulary.join(words, "first").where(F.abs(F.length("term") - F.length("word")) <= 2).where(F.levenshtein("term", "word") <= 4)
    near = near.withColumn("distance", D.osa(F.col("word"), F.col("term"))).where(F.col("distance") <= 2)
    best = near.groupBy("word").agg(F.min(F.struct("distance", (-F.col("df")).alias("rare"), "term")).alias("best")).select("word", "best.distance", "best.term")
    auto = D.auto_threshold(F.col("word"))
    applied = ~D.is_code_like(F.col("word")) & D.is_plausible(F.col("word"), F.col("term")) & (F.col("distance") <= auto)
    return unknown.drop("first").join(best, "word").where(applied | (F.col("distance") <= auto + 1)).select("query_id", "pos", "word", "term", "distance", applied.alias("applied"))


def _replaced(text, pairs):
    """The text with each pair's word replaced by its term, one pair after another."""
    return F.aggregate(pairs, text, lambda s, p: F.replace(s, p["word"], p["term"]))


def expand(index: Index, queries: DataFrame, terms: DataFrame, config: EngineConfig | None = None) -> Expanded:
    """Corrections worked into a batch of queries (query_id, q); none if typo tolerance is off or the index larger than a limit that is set."""
    config = config or EngineConfig()
    if not config.typo or (config.typo_max_docs is not None and index.doc_count() > config.typo_max_docs):
        none = terms.select("query_id", "pos", F.col("term").alias("word"), "term", F.lit(0).alias("distance"), F.lit(False).alias("applied")).limit(0)
        return Expanded(terms, queries.select("query_id", "q", F.lit(None).cast("string").alias("did_you_mean"), F.col("q").alias("effective")), none)
    found = checkpointed(corrections(index, terms, config))  # a few rows, read three times
    added = terms.select("query_id", "pos", "term", "ord").unionByName(found.where("applied").select("query_id", "pos", "term", F.lit(1_000_001).alias("ord"))).dropDuplicates(["query_id", "pos", "term"])
    pairs = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "term", "applied"))).alias("pairs"))
    lower = F.lower("q")
    named = queries.select("query_id", "q").join(pairs, "query_id", "left").withColumn("pairs", F.coalesce("pairs", F.array().cast("array<struct<pos:int,word:string,term:string,applied:boolean>>")))
    changed, used = _replaced(lower, F.col("pairs")), F.filter("pairs", lambda p: p["applied"])
    named = named.select("query_id", "q", F.when(changed != lower, changed).alias("did_you_mean"), F.when(F.size(used) > 0, _replaced(lower, used)).otherwise(F.col("q")).alias("effective"))
    return Expanded(added, named, found)
