"""Documents from tables: the factory for posts and products, and adapters for the sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_URL = "(?i)^https?://"


def strip_tags(html: Column) -> Column:
    """Text without scripts, styles and tags, trimmed. What has no end goes on to the end of the text, so a text is read once."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)", "")
    return F.trim(F.regexp_replace(bare, r"(?s)<!--.*?(?:-->|\z)|<[^>]*(?:>|\z)", ""))


def fields(**zones: Column) -> Column:
    """array<struct<zone, text>> of the zones whose text is not null or empty, in the order given."""
    made = F.array(*[F.struct(F.lit(z).alias("zone"), t.cast("string").alias("text")) for z, t in zones.items()])
    return F.filter(made, lambda f: f["text"].isNotNull() & (f["text"] != ""))


def from_posts(posts: DataFrame) -> DataFrame:
    """doc_id, fields of posts (doc_id, post_type, title, content, excerpt, sku_v2, sku, categories array).

    Products have a sku zone, their distinct codes that are not empty or URLs, and an attr zone, their categories.
    """
    product = F.col("post_type") == "product"
    code = lambda c: F.trim(F.coalesce(c, F.lit("")))
    codes = F.array_distinct(F.filter(F.array(code(F.col("sku_v2")), code(F.col("sku"))), lambda v: (v != "") & ~v.rlike(_URL)))
    content = F.trim(F.concat(strip_tags(F.coalesce("content", F.lit(""))), F.lit(" "), F.coalesce("excerpt", F.lit(""))))
    return posts.select("doc_id", fields(title=F.col("title"), content=content, sku=F.when(product, F.array_join(codes, " ")), attr=F.when(product, F.array_join("categories", " "))).alias("fields"))


def candidates(posts: DataFrame, types: tuple[str, ...], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Published posts of the types, by id; a page of them where a limit is given."""
    rows = posts.where((F.col("status") == "publish") & F.col("post_type").isin(*types)).orderBy("doc_id")
    return rows if limit is None else rows.offset(offset).limit(limit)


def timestamps(posts: DataFrame, basis: str = "created") -> DataFrame:
    """doc_id, ts: Unix seconds of the chosen GMT date string; rows without a valid one are left out."""
    name = "modified_gmt" if basis == "modified" else "created_gmt"
    return posts.select("doc_id", F.unix_timestamp(F.try_to_timestamp(F.col(name), F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts")).where(F.col("ts") > 0)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table as a catalogue."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("doc_id"), fields(title=F.col("p_name"), sku=F.col("p_brand"), attr=F.col("p_type")).alias("fields"))


def part_attributes(spark: SparkSession, sf_dir: str, basis: str = "created") -> DataFrame:
    """doc_id, title, ts of parts: first (created) or last (modified) shipping date; null where a part never shipped."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    date = F.min("l_shipdate") if basis == "created" else F.max("l_shipdate")
    shipped = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.unix_timestamp(date.cast("timestamp")).alias("ts"))
    return part.join(shipped, "doc_id", "left")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as documents with a title (first line) and their content."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", fields(title=F.substring_index("text", "\n", 1), content=F.col("text")).alias("fields"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as documents: title element and stripped text."""
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return table.select(F.col("page_id").alias("doc_id"), fields(title=F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), content=strip_tags(F.col("html"))).alias("fields"))
