"""Re-ranking: freshness and exact titles, on the first ranks of each query; the ranks behind them keep their order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analysis import AnalyzerConfig, canonical, tokens
from .config import POOL, STRENGTHS, Settings
from .scoring import TIES, broadcast_if_few
from .tables import checkpointed


class Reranker(Protocol):
    """From query_id, doc_id, score, rank to the same columns; queries has query_id and effective."""

    def __call__(self, scores: DataFrame, queries: DataFrame) -> DataFrame: ...


def chain(*rerankers: Reranker) -> Reranker:
    """Passes in order; the last one has the last word."""

    def run(scores: DataFrame, queries: DataFrame) -> DataFrame:
        for one in rerankers:
            scores = one(scores, queries)
        return scores

    return run


@dataclass
class Recency:
    """Freshness from dates (doc_id, ts in Unix seconds): light, medium or strong boost, date order, or off.

    A boost adds at most a share of the pool's best score, halved with each half-life of age; `as_of` stands for the present.
    Rows without a usable date keep their score, and a query whose pool has none is left alone.
    """

    dates: DataFrame
    as_of: int
    mode: str = "medium"
    halflife_days: int = 180
    pool: int = POOL

    def __call__(self, scores: DataFrame, queries: DataFrame) -> DataFrame:
        if self.mode not in (*STRENGTHS, "date"):
            return scores
        dated = scores.join(self.dates.select("doc_id", F.when(F.col("ts") > 0, F.col("ts")).alias("ts")), "doc_id", "left")
        query = Window.partitionBy("query_id")
        inside = F.col("rank") <= self.pool
        dated = dated.withColumn("inside", inside).withColumn("usable", F.max(F.col("inside") & F.col("ts").isNotNull()).over(query))
        if self.mode == "date":
            new = F.col("score")
            order = [F.col("inside").desc(), F.when(F.col("inside") & F.col("usable"), F.coalesce("ts", F.lit(0))).desc_nulls_last(), F.when(~F.col("inside") | ~F.col("usable"), F.col("rank")), F.round("score", TIES).desc(), F.col("doc_id")]
        else:
            budget = F.max(F.when(F.col("inside"), F.col("score"))).over(query) * STRENGTHS[self.mode]
            age = F.greatest(F.lit(0), self.as_of - F.col("ts"))
            boost = budget * F.exp(-F.log(F.lit(2.0)) * age / (max(1, self.halflife_days) * 86_400))
            new = F.when(F.col("inside") & F.col("ts").isNotNull(), F.col("score") + boost).otherwise(F.col("score"))
            order = [F.col("inside").desc(), F.when(F.col("inside"), F.round("new", TIES)).desc_nulls_last(), F.col("rank")]
        dated = dated.withColumn("new", new)
        return dated.withColumn("rank", F.row_number().over(query.orderBy(*order))).select("query_id", "doc_id", F.col("new").alias("score"), "rank")


@dataclass
class ExactTitle:
    """Titles (doc_id, title) that hold the query's words: 3 in one run, 2 all, 1 some, 0 none; earlier order within a tier.

    A tier adds more than the pool's best score. A query with fewer than two rows, no words or no title is left alone.
    """

    titles: DataFrame
    analyzer: AnalyzerConfig | None = None
    pool: int = POOL

    def __call__(self, scores: DataFrame, queries: DataFrame) -> DataFrame:
        asked = broadcast_if_few(checkpointed(queries.select("query_id", canonical(tokens(F.col("effective"), self.analyzer), self.analyzer).alias("q"))))
        named = self.titles.select("doc_id", F.when(F.col("title") != "", F.col("title")).alias("title"))
        rows = scores.join(named, "doc_id", "left").join(asked, "query_id", "left")
        rows = rows.withColumn("t", F.when(F.col("rank") <= self.pool, canonical(tokens(F.col("title"), self.analyzer), self.analyzer)))
        n, h = F.size("q"), F.size("t")
        starts = F.when(h >= n, F.sequence(F.lit(1), h - n + 1)).otherwise(F.array().cast("array<int>"))
        run = F.exists(starts, lambda i: F.slice("t", i, n) == F.col("q"))
        tier = F.when(F.col("title").isNull() | (F.col("rank") > self.pool), 0).when(run, 3).when(F.size(F.array_except("q", "t")) == 0, 2).when(F.arrays_overlap("q", "t"), 1).otherwise(0)
        query = Window.partitionBy("query_id")
        inside = F.col("rank") <= self.pool
        rows = rows.select("query_id", "doc_id", "score", "rank", tier.alias("tier"), (n > 0).alias("words"), F.count(F.lit(1)).over(query).alias("rows"), F.max(inside & F.col("title").isNotNull()).over(query).alias("any"), F.max(F.when(inside, F.col("score"))).over(query).alias("best"))
        active = F.coalesce(F.col("words"), F.lit(False)) & (F.col("rows") >= 2) & F.col("any") & inside
        step = F.when(F.col("best") > 0, F.col("best") + 1).otherwise(1.0)
        rows = rows.withColumn("lift", F.when(active, F.col("tier")).otherwise(0)).withColumn("score", F.col("score") + F.col("lift") * step).withColumn("inside", inside)
        order = query.orderBy(F.col("inside").desc(), F.col("lift").desc(), F.col("rank"))
        return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "doc_id", "score", "rank")


def shipped(titles: DataFrame, dates: DataFrame, as_of: int, mode: str = "medium", halflife_days: int = 180, analyzer: AnalyzerConfig | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The default chain: freshness, then exact titles."""
    return chain(Recency(dates, as_of, mode, halflife_days), ExactTitle(titles, analyzer))


def of_settings(settings: Settings, titles: DataFrame, posts: DataFrame, as_of: int, analyzer: AnalyzerConfig | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The default chain as a site's settings have it; posts have doc_id, created_gmt and modified_gmt."""
    from ..sources.catalog import timestamps

    return shipped(titles, timestamps(posts, settings.recency_basis), as_of, settings.recency_mode, settings.recency_halflife, analyzer)
