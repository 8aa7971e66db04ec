"""A training corpus from documents: five stages, each of which reads what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() applies them to the documents table; the check writes
each stage's result as Parquet and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm import bpe, decontamination, packing, quality, simhash, toxicity
from spindle.llm.common import checkpointed, table


def _labels(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(kind).cast("double").alias("label"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.7 or more)."""
    return quality.keep_good(docs, _labels(spark, sf_dir, "quality"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject (score under 0.7)."""
    return toxicity.drop_toxic(docs, _labels(spark, sf_dir, "toxic"))


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more): that with the smallest doc_id."""
    return simhash.one_of_each(docs, similarity=0.8, width=5)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of 10 words with a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents placed into sequences of 2048 tokens."""
    return packing.pack(docs, bpe.default_path(), capacity=2048)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_copy),
    ("decontamination", uncontaminated),
    ("packing", packed),
]

#: SQL can't express the classifiers, the fingerprints or the tokenizer. tests/llm/test_pipeline.py holds the filters against labels
#: that training never saw, the near-duplicate and benchmark stages and the packed pieces against plain Python without Spark.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
