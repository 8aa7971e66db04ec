"""The change feed: ids of changed documents, each settled by what the source says of it when its batch is processed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.analysis import AnalyzerConfig
from ..operators.config import EngineConfig
from ..operators.index import Index, build
from ..sources.store import Store

#: Most pending changes that are counted.
PENDING_MOST = 5_000


def captured(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """doc_id of events (doc_id, kind, post_type, is_revision) that count: removals and stock changes of any type, others of the
    configured types that are no revisions or autosaves."""
    always = F.col("kind").isin("remove", "untrash", "stock")
    return events.where(always | (F.col("post_type").isin(*types) & ~F.coalesce("is_revision", F.lit(False)))).select("doc_id")


def applied(index: Index, changed: DataFrame, source: DataFrame, config: EngineConfig | None = None, analyzer: AnalyzerConfig | None = None) -> Index:
    """The index after a batch of changed ids: those that the source (doc_id, fields) has are indexed anew, others removed."""
    ids = changed.select("doc_id").where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return index.without(ids).union(build(source.join(ids, "doc_id", "left_semi"), config, analyzer).checkpointed())  # read for its ranges, then to be written


def pending(queue: DataFrame) -> int:
    """How many distinct ids wait; counted up to a bound."""
    return queue.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().limit(PENDING_MOST).count()


def oldest(queue: DataFrame, limit: int) -> DataFrame:
    """doc_id, ts (its first change) of the `limit` ids that wait longest, of changes (doc_id, ts); ties to smaller ids."""
    waiting = queue.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("ts").alias("ts"))
    return waiting.orderBy("ts", "doc_id").limit(limit)


def start(changes: DataFrame, store: Store, source: Callable[[], DataFrame], checkpoint: str, clock: Callable[[], int], config: EngineConfig | None = None, analyzer: AnalyzerConfig | None = None) -> StreamingQuery:
    """Drains a streaming frame of doc_ids into a store, one version for each micro-batch, until what is there is done.

    A batch that is processed again after a failure gives the same index, since it reads the source and not the event. Before a
    first publication the batch fails and its changes keep waiting.
    """

    def drain(batch: DataFrame, _: int) -> None:
        index = store.load()
        ids = batch.select("doc_id").dropDuplicates(["doc_id"]).persist()
        try:
            if index is None:
                raise RuntimeError("no index is published; publish one and start again")
            if not ids.isEmpty():
                store.publish(applied(index, ids, source(), config, analyzer), analyzer, built_at=store.meta()["built_at"], last_drain=clock())
        finally:
            ids.unpersist()

    return changes.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
