"""The queries of this subpackage: each applies one operator to the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontamination, licenses, packing, quality, sharding, simhash, sql, token_counts, toxicity, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), bpe.default_path())


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda d: d["base"])
    named = lambda some: F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"), F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def _labels(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col(kind).cast("double").alias("label"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality"), threshold=0.7)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")), "page_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "toxic"), threshold=0.7)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, factor=0.9)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.default_path(), capacity=2048)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.deal(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["stop"] - s["start"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_licenses, op3_quality, op4_simhash, op5_warc, op6_toxicity, op7_nearest, op8_packing, op9_sharding, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": sql.licenses(), "op5_warc": sql.warc(), "op9_sharding": sql.sharding(), "op10_decontamination": sql.decontamination()}
