"""Quality: held-out accuracy, calibration, and rows without labels or text."""

import numpy as np

from spindle.llm import quality


def labels_of(spark, sf, kind):
    return spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", f"cast({kind} as double) as label")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = labels_of(spark, sf, "quality")
    rows = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60
    assert np.mean([(r.predicted == 1) == (r.label == 1) for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_isotonic_is_the_best_monotone_fit():
    x, y, w = np.arange(5.0), np.array([0.0, 1.0, 0.0, 1.0, 1.0]), np.array([1.0, 1.0, 3.0, 1.0, 1.0])
    knots, values = quality.isotonic(x, y, w)
    assert values.tolist() == [0.0, 0.25, 1.0] and knots.tolist() == [0.0, 1.75, 3.5]


def test_held_out_labels_are_not_read(spark, documents, sf):
    labels = labels_of(spark, sf, "quality")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - label else label end as label")
    score = lambda given: sorted((r.doc_id, round(r.score, 6)) for r in quality.classify(documents, given).collect())
    assert score(labels) == score(turned)


def test_odd_rows(spark, odd, nothing, documents, sf):
    labels = labels_of(spark, sf, "quality")
    assert quality.classify(odd, labels).count() == odd.count()
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0
    mixed = labels.unionByName(spark.createDataFrame([(1, None), (None, 1.0), (2, 0.0), (2, 1.0)], "doc_id long, label double"))
    assert quality.classify(documents, mixed).count() == documents.count()
    every = quality.keep_good(odd, labels.limit(0), threshold=0.5)
    assert every.columns == odd.columns and every.count() == odd.count()
    kept = quality.keep_good(documents, labels)
    good = {r.doc_id for r in quality.classify(documents, labels).where("predicted = 1").collect()}
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == good


def test_fit_is_the_dense_ridge_solution(spark, documents, sf):
    labels = labels_of(spark, sf, "quality")
    model = quality.fit(documents, labels, dimensions=24)
    rows = documents.join(labels, "doc_id").selectExpr("text", "label", "crc32(cast(cast(doc_id as string) as binary)) % 4 as fold").collect()
    own = [r for r in rows if r.fold in (0, 1)]
    x, y = np.array([quality.statistics(r.text) for r in own]), np.array([r.label for r in own])
    assert np.allclose(model.fourier.mean, x.mean(axis=0)) and np.allclose(model.fourier.scale, np.maximum(x.std(axis=0), 1e-4), atol=1e-6)
    z = model.fourier(x)
    pull = 1e-3 * len(x) * np.diag([*[1.0] * (z.shape[1] - 1), 1e-6])
    stacked = np.linalg.lstsq(np.vstack([z, np.sqrt(pull)]), np.concatenate([y, np.zeros(len(pull))]), rcond=None)[0]
    assert np.allclose(model.coefficients, stacked, atol=1e-6)
    rest = [r for r in rows if r.fold == 3]
    raw = np.clip(model.raw(np.array([quality.statistics(r.text) for r in rest])), -1, 2)
    assert all(np.diff(model.values) >= 0) and abs(np.mean(model.score(np.array([quality.statistics(r.text) for r in rest]))) - np.mean([r.label for r in rest])) < 0.1 and raw.size


def test_sums_go_through_rounds(spark):
    frame = spark.range(1000).selectExpr("cast(id as double) as x").repartition(50)
    total = quality._summed(frame, lambda b: np.array([b.num_rows, b.column(0).to_numpy().sum()]), 2)
    assert total.tolist() == [1000.0, 499500.0]


def test_a_sample_of_the_labels(spark, documents, sf):
    marks = quality.marked(labels_of(spark, sf, "quality"), 4, 2, 40)
    assert 20 <= marks.count() <= 60 and quality.marked(labels_of(spark, sf, "quality").limit(0), 4, 2, 40).count() == 0
    assert quality.classify(documents, labels_of(spark, sf, "quality"), sample=60).count() == documents.count()
