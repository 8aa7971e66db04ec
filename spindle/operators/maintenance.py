"""Keeping an index in line with its source: reconciling, zones then and now, backlog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .analysis import AnalyzerConfig
from .config import EngineConfig
from .index import Index


def orphans(index: Index, valid: DataFrame) -> DataFrame:
    """Indexed documents that the source (column doc_id) no longer has."""
    return index.index_docs.select("doc_id").join(valid.select("doc_id"), "doc_id", "left_anti")


def missing(index: Index, valid: DataFrame) -> DataFrame:
    """Documents of the source that are not indexed."""
    return valid.select("doc_id").distinct().join(index.index_docs, "doc_id", "left_anti")


def reconcile(index: Index, docs: DataFrame, config: EngineConfig | None = None, analyzer: AnalyzerConfig | None = None) -> Index:
    """The index without orphans and with missing documents (doc_id, fields); changed ones stay as they are."""
    from .index import build

    return index.without(orphans(index, docs)).union(build(docs.join(missing(index, docs), "doc_id", "left_semi"), config, analyzer))


def zone_status(index: Index, docs: DataFrame, ids: DataFrame, config: EngineConfig | None = None, analyzer: AnalyzerConfig | None = None) -> DataFrame:
    """doc_id, zone, in_source, in_index for the zones that documents would have now and those that the index has."""
    from .index import build

    now = build(docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), config, analyzer).doc_zones
    then = index.zone_lengths_for_docs(ids)
    both = now.select("doc_id", "zone", F.lit(True).alias("a")).join(then.select("doc_id", "zone", F.lit(True).alias("b")), ["doc_id", "zone"], "full")
    return both.select("doc_id", "zone", F.col("a").isNotNull().alias("in_source"), F.col("b").isNotNull().alias("in_index"))


def is_stalled(pending: int, last_drain: int, as_of: int, threshold: int = 600) -> bool:
    """Whether changes wait and none was drained for `threshold` seconds."""
    return pending > 0 and as_of - last_drain > threshold
