"""Toxicity: held-out accuracy, shared n-grams of misspellings, and rows without labels or text."""

import random
import tracemalloc

import numpy as np

from spindle.llm import toxicity
from test_quality import labels_of


def made(seed, n):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    texts, marks = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 120))
        if i % 3 == 0:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(["wretched", "despicable", "vermin"]) + rng.choice(["", "s", "ly"])
        texts.append(" ".join(words))
        marks.append(float(i % 3 == 0))
    return texts, np.array(marks)


def test_training_finds_the_words_and_their_misspellings():
    texts, marks = made(1, 900)
    vectors, classes, offsets, common = toxicity.train(texts, marks)
    model = toxicity.Model((vectors @ (classes[:, 1] - classes[:, 0])).astype(float), common, float(offsets[1] - offsets[0]), np.array([0.0, 1.0]), np.array([0.0, 1.0]), "test")
    new, truth = made(1, 1500)
    margin = model.margins(new[900:])
    rank = np.argsort(np.argsort(margin))
    positive = truth[900:] == 1
    assert (rank[positive].mean() - rank[~positive].mean()) / len(rank) + 0.5 > 0.95
    alone = model.margins(["wretched", "wretchedd", "wretchd", "gabbed"])
    assert min(alone[:3]) > alone[3]


def test_scores_and_folds(spark, documents, sf):
    labels = labels_of(spark, sf, "toxic")
    rows = toxicity.classify(documents, labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - label else label end as label")
    again = toxicity.classify(documents, turned).collect()
    assert sorted((r.doc_id, round(r.score, 6)) for r in rows) == sorted((r.doc_id, round(r.score, 6)) for r in again)


def test_odd_rows(spark, odd, nothing, documents, sf):
    labels = labels_of(spark, sf, "toxic")
    assert toxicity.classify(odd, labels).count() == odd.count()
    assert {r.score for r in toxicity.classify(documents, labels.limit(0)).collect()} == {0.0}
    assert toxicity.classify(nothing, labels).count() == 0
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_no_letter_of_a_long_run_is_left_out():
    run = "a" * 25 + "wretched" + "b" * 25
    for k in range(30, 60):
        glued = "x" * k + "wretched" + "y" * (100 - k)
        pieces = toxicity.words(glued)
        assert any("wretched" in p for p in pieces) and all(len(p) <= toxicity.LONG for p in pieces)
    assert toxicity.words(run) != toxicity.words("a" * 58) and toxicity.words("short word") == ["short", "word"]
    assert set("".join(toxicity.words("\u6f22\u5b57" * 50))) == {"\u6f22", "\u5b57"}
    assert "".join(p if i == 0 else p[toxicity.OVERLAP :] for i, p in enumerate(toxicity.words("".join(map(chr, range(0x4E00, 0x4E00 + 500)))))) == "".join(map(chr, range(0x4E00, 0x4E00 + 500)))


def test_a_slur_inside_glued_words_is_toxic():
    texts, marks = made(1, 900)
    vectors, classes, offsets, common = toxicity.train(texts, marks)
    model = toxicity.Model((vectors @ (classes[:, 1] - classes[:, 0])).astype(float), common, float(offsets[1] - offsets[0]), np.array([0.0, 1.0]), np.array([0.0, 1.0]), "glued")
    plain = "".join(random.Random(3).choices("abcdefghij", k=60))
    assert model.margins([plain[:30] + "wretched" + plain[30:]])[0] > model.margins([plain])[0]


def test_held_out_documents(spark):
    """Ranking and false alarms on documents whose labels training never saw; with some 300 toxic texts to learn from, recall at
    the threshold is far from that of larger tables (README), so the ranking is bounded more tightly."""
    sf = "/root/testdata/sf0.1"
    labels = labels_of(spark, sf, "toxic")
    rows = toxicity.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    truth, score = np.array([r.label for r in rows]) == 1, np.array([r.score for r in rows])
    rank = np.argsort(np.argsort(score + 1e-12 * np.arange(len(score))))
    area = (rank[truth].mean() - (truth.sum() - 1) / 2) / (~truth).sum()
    caught, alarms = (score[truth] >= 0.7).mean(), (score[~truth] >= 0.7).mean()
    assert area >= 0.92 and alarms <= 0.02 and caught >= 0.2


def test_the_sample_keeps_to_its_bytes(spark, documents, sf):
    labels = labels_of(spark, sf, "toxic")
    assert toxicity.fit(documents, labels, sample_bytes=0).name.startswith("none")
    assert 0 < int(toxicity.fit(documents, labels, sample_bytes=60_000).name.split()[-1]) < int(toxicity.fit(documents, labels).name.split()[-1])


def test_gradient_step(monkeypatch):
    """One step on a batch of all texts moves the vectors against the gradient of the log loss, by finite differences."""
    texts, marks = ["idiot stupid day", "fine day day", "stupid fool", "nice calm sea"], np.array([1.0, 0.0, 1.0, 0.0])

    def loss(vectors, classes, offsets, common):
        total = 0.0
        for text, mark in zip(texts, marks):
            bag = toxicity.Counter(toxicity.words(text))
            parts = np.sqrt(np.array([*bag.values()], float))
            word = np.array([vectors[toxicity.grams(w)].mean(axis=0) * toxicity.COMMON / (toxicity.COMMON + common[w]) for w in bag])
            logits = (parts / parts.sum()) @ word @ classes + offsets
            total += (np.log(np.exp(logits - logits.max()).sum()) + logits.max() - logits[int(mark)]) / len(texts)
        return total

    run = lambda rate: toxicity.train(texts, marks, steps=8, batch=4, rate=rate, sparse=0.0, kept=-1.0)
    still, moved = run(0.0), run(1e-3)
    shares = {w: float(x) for w, x in still[3].items()}
    bucket = toxicity.grams("idiot")[0]
    for j in range(toxicity.SIZE):
        up, down = still[0].astype(float).copy(), still[0].astype(float).copy()
        up[bucket, j] += 1e-3
        down[bucket, j] -= 1e-3
        slope = (loss(up, still[1].astype(float), still[2], shares) - loss(down, still[1].astype(float), still[2], shares)) / 2e-3
        assert np.sign(moved[0][bucket, j] - still[0][bucket, j]) == -np.sign(slope)


def test_training_takes_no_memory_of_the_driver(spark, documents, sf, monkeypatch):
    """The texts are trained on by a task: the driver works without train, calibrated and the words' scores."""
    labels = labels_of(spark, sf, "toxic")
    for name in ("train", "calibrated", "_Words"):
        monkeypatch.setattr(toxicity, name, None)
    model = toxicity.fit(documents, labels)
    assert model.weight.any() and len(model.knots) > 1


def test_memory_of_training():
    """Beside what it keeps, preparing the n-grams takes a few bytes for each."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(100)) for _ in range(400)]
    tracemalloc.start()
    toxicity.train(texts, np.arange(400) % 2 * 1.0, steps=8, batch=8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
