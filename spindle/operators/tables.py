"""Frames written once where a plan reads them several times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session gets a temporary one, any other an error: a
    folder of one machine is lost with it."""
    where = session.conf.get("spark.checkpoint.dir", None)
    if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", session.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return (where or tempfile.mkdtemp(prefix="checkpoints-")).rstrip("/")


#: Bytes of a table's files that a task is dealt, and most parts.
PART_BYTES, MOST_PARTS = 4 << 20, 20_000


def dealt(frame: DataFrame, key: str) -> DataFrame:
    """The frame dealt by a key, in parts by the size of its source where Spark knows that.

    Parts are not merged then: Spark merges by the bytes that it shuffles, and a text's terms take ten times those.
    """
    size = int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= PART_BYTES * MOST_PARTS:  # unknown is a number above all tables
        return frame.repartition(key)
    return frame.repartition(max(frame.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), key)


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, its lineage and plan cut."""
    session = frame.sparkSession
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(shared_folder(session))
    return frame.checkpoint(eager=True)
