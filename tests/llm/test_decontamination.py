"""Decontamination against all windows compared by brute force."""

import re

from spindle.llm import decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, benchmark, n=10):
    grams = {}
    for item in benchmark.collect():
        w = words(item.text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item.item_id is None else str(item.item_id))
    out = []
    for d in docs.select("doc_id", "text").collect():
        w, hit, items = words(d.text), set(), set()
        for m in {len(g) for g in grams}:
            for i in range(len(w) - m + 1):
                if (found := grams.get(tuple(w[i : i + m]))) is not None:
                    hit.update(range(i, i + m))
                    items |= found
        out.append((str(d.doc_id), len(w), len(hit), sorted(items)))
    return sorted(out)


def scanned(docs, benchmark, **options):
    return sorted((str(r.doc_id), r.n_words, sum(s.stop - s.start for s in r.spans), list(r["items"])) for r in decontamination.scan(docs, benchmark, **options).collect())


def test_documents(documents, benchmark):
    assert scanned(documents, benchmark) == expected(documents, benchmark)
    assert sum(1 for r in expected(documents, benchmark) if r[2]) > 0


def test_odd_items_and_documents(spark, odd, nothing, benchmark):
    items = spark.createDataFrame(
        [(1, "The SAME text, twice in a row"), (2, "word3 licence 3 word4 licence 4 word5 licence 5 word6 licence 6 word7"), (3, None), (4, " . "), (None, "one"), (5, "twice in"), (1, "the same text twice in a row"), (6, "a a a a a a a a a a a")],
        "item_id long, text string",
    )
    many = odd.select("doc_id", "text", "gram", "p").unionByName(spark.createDataFrame([(20, "a " * 25, "x", "y"), (20, "a " * 25, "x", "y"), (21, "one two one", "x", "y")], "doc_id long, text string, gram string, p string"))
    for most in (10**6, 0):  # broadcast, then joined by a shuffle
        assert scanned(many, items, most=most) == expected(many, items)
    assert scanned(many, items, n=3) == expected(many, items, n=3)
    assert decontamination.scan(nothing, items).count() == 0
    assert scanned(many, items.limit(0)) == expected(many, items.limit(0))


def test_clean_keeps_the_others_whole(documents, benchmark, odd):
    hit = {int(r[0]) for r in expected(documents, benchmark) if r[2]}
    kept = decontamination.clean(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in documents.collect() if r.doc_id not in hit)
    assert decontamination.clean(odd, benchmark).count() == odd.count()
