"""The pipeline: its filters against labels that training never saw, its other stages against plain Python."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontamination import expected
from test_overlap import kept
from test_packing import pieces_of

STAGES = dict(corpus_pipeline.STAGES)


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages(spark, sf, benchmark):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert list(STAGES) == ["quality", "toxicity", "near_duplicates", "decontamination", "packing"]
    one = STAGES["quality"](spark, docs, sf).cache()
    two = STAGES["toxicity"](spark, one, sf).cache()
    assert one.columns == two.columns == columns and set(ids(two)) <= set(ids(one)) <= set(ids(docs))
    three = STAGES["near_duplicates"](spark, two, sf).cache()
    assert three.columns == columns and ids(three) == kept([(r.doc_id, r.text) for r in two.collect()])
    four = STAGES["decontamination"](spark, three, sf).cache()
    assert four.columns == columns and ids(four) == sorted(int(r[0]) for r in expected(three, benchmark) if not r[2])
    five = STAGES["packing"](spark, four, sf)
    got = lambda frame: sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in frame.collect())
    assert got(five) == pieces_of(four) == got(corpus_pipeline.run(spark, sf))


def test_the_quality_stage_by_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    stays = set(ids(STAGES["quality"](spark, docs, sf)))
    rows = held.join(docs.select("doc_id"), "doc_id").collect()
    good, bad = ([r.doc_id in stays for r in rows if r.quality == k] for k in (1, 0))
    assert len(rows) > 60 and sum(good) > 0.93 * len(good) and sum(bad) < 0.07 * len(bad)


def test_the_toxicity_stage_on_planted_words(spark, tmp_path):
    """Half of the invented texts have a word in twenty that marks them; most of those without a label are found."""
    import random

    rng = random.Random(5)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(300)]
    rows = []
    for i in range(1200):
        words = rng.choices(plain, k=100)
        for at in range(0, 100, 20) if i % 2 else ():
            words[at] = rng.choice(["wretched", "vermin", "despicable"])
        rows.append((i, " ".join(words), i % 2))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    table.select("doc_id", "toxic").where("doc_id < 800").write.parquet(str(tmp_path / "labels.parquet"))
    stays = set(ids(STAGES["toxicity"](spark, table.drop("toxic"), str(tmp_path))))
    new = range(800, 1200)
    assert sum(i in stays for i in new if i % 2) < 0.1 * 200 and sum(i in stays for i in new if i % 2 == 0) > 0.95 * 200


def test_odd_columns_and_empty_tables(spark, odd, nothing, sf):
    """Every filtering stage keeps all columns, whatever their names, and takes an empty table."""
    for name in ("near_duplicates", "decontamination"):
        assert STAGES[name](spark, odd, sf).columns == odd.columns
    for name, stage in STAGES.items():
        got = stage(spark, nothing, sf)
        assert got.count() == 0 and (name == "packing" or got.columns == nothing.columns)
    marked = odd.withColumn("doc_id", F.col("doc_id") + 10**9)
    for name in ("quality", "toxicity"):
        assert STAGES[name](spark, marked, sf).columns == odd.columns
