"""Registered queries on tables of more kinds than the given ones have."""

from pyspark.sql import functions as F

from spindle.operators import index as ix
from spindle.operators import scoring, tables
from spindle.plans import registry
from spindle.sources.store import Store


def test_edit_distances_of_all_words(spark, tmp_path):
    words = [f"w{i:03d}" for i in range(90)]
    spark.createDataFrame([(f"{a} {b}",) for a, b in zip(words[::2], words[1::2])], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a, r.b) for r in registry.edit_distances(spark, str(tmp_path)).select("a", "b").collect()}
    assert got == {(a, b) for a in words for b in words}


def test_the_feed_writes_as_many_versions_however_many_events(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "red ring", "Brand#1", "SMALL") for i in range(40)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(12, numPartitions=12).select(F.col("id").alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    published, publish = [], Store.publish
    monkeypatch.setattr(Store, "publish", lambda self, *a, **k: published.append(1) or publish(self, *a, **k))
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task for each file, as larger ones have
    got = {r.doc_id for r in registry.stream_sync_final(spark, str(tmp_path)).select("doc_id").collect()}
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == set(range(40)) - {0, 10} and len(published) <= 5


def test_parts_by_the_size_of_the_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PART_BYTES", 64)
    spark.range(1000).write.parquet(f"{tmp_path}/ids.parquet")
    assert tables.dealt(spark.read.parquet(f"{tmp_path}/ids.parquet"), "id").rdd.getNumPartitions() > 16


def test_zone_lengths_without_the_postings(spark):
    docs = spark.createDataFrame([(1, [("title", "Giỏ mây RX4420 the 漢1 5m²"), ("title", "the of")]), (2, [("code", "ab12 ab")]), (3, [("title", "x y")]), (3, [("title", "X z"), ("body", "")]), (4, None), (5, [("title", None)])], "doc_id long, fields array<struct<zone:string,text:string>>")
    index = ix.build(docs)
    assert {tuple(r) for r in index.doc_zones.collect()} == {tuple(r) for r in index.postings.select("doc_id", "zone", "len").distinct().collect()}
    got = {(r.doc_id, r.term, r.zone): (r.tf, r.len) for r in index.postings.collect()}
    assert got[1, "giỏ", "title"] == (1, 7) and got[1, "gio_may", "phrase"] == (1, 1) and got[1, "rx4", "code"] == (1, 2)
    assert got[2, "ab", "code"] == (2, 2) and got[3, "x", "title"] == (1, 2) and got[3, "z", "title"] == (1, 2)


def test_an_index_for_a_batch_scores_alike(spark):
    docs = spark.createDataFrame([(i, [("title", f"red ring {i}"), ("content", "small bolt")]) for i in range(9)], "doc_id long, fields array<struct<zone:string,text:string>>")
    index, terms = ix.build(docs), scoring.query_terms(spark.createDataFrame([(0, "red bolt"), (1, "ring 7")], "query_id long, q string"))
    few = index.for_batch(terms)
    assert {r.term for r in few.postings.collect()} == {"red", "bolt", "ring", "7"}
    assert sorted(map(tuple, scoring.score(few, terms).collect())) == sorted(map(tuple, scoring.score(index, terms).collect()))
