"""Sharding: a bijection, computable places, even counts; the SQL version gives the same rows."""

import zlib

import duckdb
import pytest

from spindle.llm import registry, sharding, sql


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 99, 1000, 4097])
def test_places_are_a_permutation(n):
    shards = 7
    places = [sharding.locate(i, n, shards) for i in range(n)]
    assert sorted(slot * shards + shard for shard, slot in places) == list(range(n))


def check(docs, shards):
    rows = sharding.deal(docs, shards).collect()
    n = len(rows)
    given = docs.select("doc_id", "text").collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in given)
    assert sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        assert (r.shard, r.slot) == sharding.locate(r.row_number, n, shards)
    slots = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    return sorted((r.row_number, str(r.doc_id)) for r in rows)


def test_deal(documents, odd, nothing):
    once = check(documents, 40)
    assert once == check(documents.repartition(7), 40)
    check(odd, 5)
    check(odd.unionByName(odd), 3)
    assert sharding.deal(nothing).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    expected = con.sql(sql.sharding()).df()
    got = registry.op9_sharding(spark, sf).toPandas()
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot"]
    assert sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, expected[names].values.tolist()))
