"""Index tables in versioned Parquet folders: a new version is written whole, then named by one row of metadata.

Readers follow the newest row, so they see the old version or the new one and nothing between; a job that dies before its
row leaves no trace that readers see. Two writers can't make the same version: each claims its number first, by a file that only one
can create. postings are dealt by ranges of (term, document) and sorted, so a query's terms prune files and row groups and
a frequent term is spread over several.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analysis import AnalyzerConfig
from ..operators.index import Index

_META = "version long, ready boolean, analyzer_hash string, built_at long, last_drain long, folder string"


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(_META).parquet(f"{self.path}/meta")
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], _META)
            raise

    def meta(self):
        """The newest row of metadata, or None for a store that has none."""
        return self._rows().orderBy(F.col("version").desc()).first()

    def publish(self, index: Index, analyzer: AnalyzerConfig | None = None, built_at: int = 0, ready: bool = True, last_drain: int = 0) -> int:
        """Writes an index as the next version and makes it the current one."""
        version = self._next()
        folder = f"v{version}-{uuid4().hex[:8]}"
        where = f"{self.path}/{folder}"
        index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "zone", "doc_id").write.parquet(f"{where}/postings")
        index.doc_zones.write.parquet(f"{where}/doc_zones")
        index.index_docs.write.parquet(f"{where}/index_docs")
        self._claim(version)
        self._append(version, ready, (analyzer or AnalyzerConfig()).hash(), built_at, last_drain, folder)
        return version

    def _next(self) -> int:
        """The number after all that were made or claimed; a claim whose writer died before its row leaves a gap."""
        now = self.meta()
        fs, where = self._files(f"{self.path}/claims")
        claimed = [int(f.getPath().getName()) for f in fs.listStatus(where)] if fs.exists(where) else []
        return max([now["version"] if now else 0, *claimed]) + 1

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _claim(self, version: int) -> None:
        """Takes a version's number; an error if another writer has it, whose version then stands."""
        fs, where = self._files(f"{self.path}/claims/{version}")
        if not fs.createNewFile(where):
            raise RuntimeError(f"another writer has version {version}; read it and publish again")

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], _META).coalesce(1).write.mode("append").parquet(f"{self.path}/meta")

    def folders(self) -> set[str]:
        """The names of the folders that hold versions, current or not."""
        fs, where = self._files(self.path)
        return {f.getPath().getName() for f in fs.listStatus(where) if f.getPath().getName().startswith("v")} if fs.exists(where) else set()

    def expire(self, keep: int = 2) -> None:
        """Deletes the folders of all but the newest `keep` versions; readers of older ones must be done."""
        kept = {r["folder"] for r in self._rows().where("folder IS NOT NULL").orderBy(F.col("version").desc()).limit(keep).collect()}
        for name in self.folders() - kept:
            fs, where = self._files(f"{self.path}/{name}")
            fs.delete(where, True)

    def drop(self) -> None:
        """Deletes the store with all its versions."""
        fs, where = self._files(self.path)
        fs.delete(where, True)

    def status(self, source: DataFrame, analyzer: AnalyzerConfig | None = None) -> DataFrame:
        """One row: version, built_at, last_drain, analyzer_hash, stale (built with another analyzer), active (a published index is
        there), docs (indexed) and source_docs (distinct doc_id of source)."""
        now, index = self.meta(), self.load()
        docs = index.doc_count() if index is not None else 0
        row = (now["version"] if now else None, now["built_at"] if now else None, now["last_drain"] if now else None, now["analyzer_hash"] if now else None, self.analyzer_changed(analyzer), index is not None, docs, source.select("doc_id").distinct().count())
        return self.spark.createDataFrame([row], "version long, built_at long, last_drain long, analyzer_hash string, stale boolean, active boolean, docs long, source_docs long")

    def load(self) -> Index | None:
        """The current index; None where nothing was published or all was flushed."""
        now = self.meta()
        if now is None or not now["ready"]:
            return None
        return Index(*(self.spark.read.parquet(f"{self.path}/{now['folder']}/{t}") for t in ("postings", "doc_zones", "index_docs")))

    def flush(self) -> None:
        """Empties the store: readers find no index until the next publication."""
        version = self._next()
        self._claim(version)
        self._append(version, False, None, 0, 0, None)

    def analyzer_changed(self, analyzer: AnalyzerConfig | None = None) -> bool:
        """Whether the index was built with another analyzer; not where none was recorded."""
        now = self.meta()
        return bool(now and now["analyzer_hash"]) and now["analyzer_hash"] != (analyzer or AnalyzerConfig()).hash()
