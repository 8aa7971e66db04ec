"""Small tables for the operators."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text and columns with names that operators use."""
    long_text = " ".join(f"word{i % 997} licence {i}" for i in range(30_000))
    rows = [
        (1, None, "x", 1), (2, "", None, None), (3, "   \n\t ", "x", 2), (None, "a null id has this text here", "x", 3), (None, None, None, 4),
        (4, "the same text twice in a row", "y", 5), (4, "the same text twice in a row", "y", 5), (4, "the same id with another text", "y", 6),
        (5, "the same text twice in a row", "z", 7), (6, long_text, "z", 8), (7, "MIT License and Ünïcode ΑΣ İ 漢字 \U0001f600 <|endoftext|>", "z", 9), (-8, "one", "z", 10),
    ]
    schema = "doc_id long, text string, fp string, size long"
    frame = spark.createDataFrame(rows, schema)
    extra = {c: "clash" for c in ("component_id", "root", "word", "p", "gram", "item", "bucket", "digest", "shard", "score", "copies", "text_md5", "w", "_key_", "key_", "_key", "score_", "_score", "id_", "label", "features", "k", "bits", "sid", "grams", "prefix", "fp_", "md5")}
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(v) for c, v in extra.items()})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
