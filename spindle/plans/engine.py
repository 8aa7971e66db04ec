"""The search engine: index tables, corrections, scoring and re-ranking put together for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import rerank, scoring, typo
from ..operators.analysis import AnalyzerConfig
from ..operators.config import POOL, EngineConfig


class SearchEngine:
    """Searches an index. Queries are a frame (query_id, q); one query is a frame of one row."""

    id = "spindle"

    def __init__(self, index: ix.Index, config: EngineConfig | None = None, analyzer: AnalyzerConfig | None = None, reranker: rerank.Reranker | None = None):
        self.index, self.config, self.analyzer, self.reranker = index, config or EngineConfig(), analyzer or AnalyzerConfig(), reranker

    @classmethod
    def of(cls, docs: DataFrame, **options) -> "SearchEngine":
        """An engine over documents (doc_id, fields)."""
        return cls(ix.build(docs, options.get("config"), options.get("analyzer")), **options)

    def upsert(self, docs: DataFrame) -> "SearchEngine":
        return SearchEngine(self.index.upsert(docs, self.config, self.analyzer), self.config, self.analyzer, self.reranker)

    def delete(self, ids: DataFrame) -> "SearchEngine":
        return SearchEngine(self.index.without(ids), self.config, self.analyzer, self.reranker)

    def query(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """query_id, doc_id, score (4 places), rank. Queries without terms or matches give no row.

        Re-ranking comes before the limit; a limit under 1 gives one row a query, as the reference's does.
        """
        terms = scoring.query_terms(queries, self.analyzer)
        expanded = typo.expand(self.index, queries, terms, self.config)
        scores = scoring.score(self.index, expanded.terms, self.config)
        if self.reranker is not None:
            scores = self.reranker(scores, expanded.queries)
        return scoring.cut(scores, limit)

    suggest = query

    def did_you_mean(self, queries: DataFrame) -> DataFrame:
        """query_id, did_you_mean (null: nothing to suggest) of every query; it depends on that query alone."""
        return typo.expand(self.index, queries, scoring.query_terms(queries, self.analyzer), self.config).queries.select("query_id", "did_you_mean")

    def stats(self) -> DataFrame:
        """zone, avg_len, doc_count."""
        return self.index.avg_zone_lengths().withColumn("doc_count", F.lit(self.index.doc_count()).cast("long"))

    def rest_search(self, queries: DataFrame, attributes: DataFrame, limit: int | None = None) -> DataFrame:
        """What a search endpoint returns: query_id, q, did_you_mean, rank, doc_id, title, url, score; limit 1 to 50, 10 unless given."""
        hits = self.query(queries, min(50, max(1, 10 if limit is None else limit)))
        shown = queries.join(self.did_you_mean(queries), "query_id").join(hits, "query_id", "left")
        return shown.join(attributes.select("doc_id", "title", "url"), "doc_id", "left").select("query_id", "q", "did_you_mean", "rank", "doc_id", "title", "url", "score")

    def site_search(self, queries: DataFrame, rows: DataFrame, enabled: bool = True, ready: bool = True) -> DataFrame | None:
        """Rows of a site (doc_id, ...) that replace its own matches, by rank among the first 500; None where the engine is off."""
        if not (enabled and ready):
            return None
        return self.query(queries, POOL).select("query_id", "doc_id", "rank").join(rows, "doc_id")


def like_baseline(docs: DataFrame, queries: DataFrame, limit: int = POOL) -> DataFrame:
    """The plain search that the engine is compared with: every blank-separated word is in the title, newest first.

    docs: doc_id, title, ts. Returns query_id, doc_id, rank.
    """
    from pyspark.sql import Window

    words = F.filter(F.split(F.lower("q"), r"\s+"), lambda w: w != "")
    asked = scoring.broadcast_if_few(queries.select("query_id", words.alias("words")).where(F.size("words") > 0))
    hits = docs.select("doc_id", "ts", F.lower("title").alias("title")).join(asked, F.forall("words", lambda w: F.contains(F.col("title"), w)))
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("ts").desc(), "doc_id"))).where(F.col("rank") <= limit).select("query_id", "doc_id", "rank")
