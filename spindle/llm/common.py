"""What the operators of this subpackage share: text normalising expressions and checkpoints."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One word of a text whose letters A-Z are lower-cased: digits, a-z and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The array of words of a whole text (empty for a text without words)."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, its lineage cut.

    The folder is spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder and any other an error: a
    folder of one machine is lost with it.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        where = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if where is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))
    return frame.checkpoint(eager=True)


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have: `name` with as many underscores behind it as that takes."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_of(doc_id: Column, text_md5: Column) -> Column:
    """What tells documents apart: 16 bytes of an MD5 of the id (null: like no number) and the MD5 of the text."""
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), text_md5)))


def row_key(doc_id: Column, text: Column) -> Column:
    """The same from the text; a null text counts as empty."""
    return key_of(doc_id.cast("long"), F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def hot_join(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined to named (one row a key), where a key may have a third of all rows.

    Keys with more than a hundred-thousandth of the rows, and more than 1,000, are joined by a broadcast: there can't be more
    than 100,000 of them. The others are shuffled, none of them hot.
    """
    most = max(1000, rows.count() // 100_000)
    hot = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(key))
    if hot.isEmpty():
        return rows.join(named, key)
    big = rows.join(F.broadcast(named.join(F.broadcast(hot), key, "left_semi")), key)
    return big.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(named, key))


def broadcast_if_few(keys: DataFrame, most: int = 500_000) -> DataFrame:
    """A checkpointed frame of keys, to be broadcast if it has at most `most` rows; counted, not guessed."""
    return F.broadcast(keys) if keys.count() <= most else keys


def compact(frame: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """A checkpointed frame in as few partitions as its rows need, at `rows` each; counted, so a large one stays as it is.

    What reads it next writes one shuffle file for each of these partitions, not one for each of the partitions of some join before.
    """
    return frame.coalesce(max(1, -(-frame.count() // rows)))


def repeated(frame: DataFrame, copies: str, chunk: int = 4096) -> DataFrame:
    """Each row as often as its column `copies` says, without that column; arrays stay at `chunk` numbers."""
    return (
        frame.withColumn("_chunk", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies), F.lit(chunk).cast("long"))))
        .withColumn("_copy", F.explode(F.sequence(F.col("_chunk"), F.least(F.col("_chunk") + (chunk - 1), F.col(copies)))))
        .drop("_chunk", "_copy", copies)
    )
