"""Licence scan against rules applied by Python's own regular expressions to whole texts."""

import re

from spindle.llm import licenses, registry
from spindle.llm.license_rules import BASE, rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    padded = "".join(f" {x} " for x in w)
    count = lambda s: s.count(" ") // 2
    found = [(count(padded[: m.start()]), count(padded[: m.end()]), r.priority, r.label) for r in rules() for m in re.finditer(r.regex, padded)]
    inside = lambda a, b: a[0] >= b[0] and a[1] <= b[1]
    kept = sorted((s, e, label) for s, e, p, label in found if not any(q < p and (inside((s, e), (a, b)) or inside((a, b), (s, e))) for a, b, q, _ in found))
    base = sorted((i, label) for phrase, label in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    return len(w), kept, base


def check(docs):
    got = sorted((str(r.doc_id), r.n_words, sorted((d.start, d.stop, d.label) for d in r.found if not d.base), sorted((d.start, d.label) for d in r.found if d.base)) for r in licenses.scan(docs).collect())
    assert got == sorted((str(r.doc_id), *brute(r.text)) for r in docs.select("doc_id", "text").collect())


def test_rules():
    listed = rules()
    assert len(listed) > 250 and licenses.span_bound() < licenses.REACH
    assert all(r.keywords and r.regex for r in listed)


def test_documents_and_odd_rows(documents, odd, nothing):
    check(documents)
    check(odd)
    assert licenses.scan(nothing).count() == 0


def test_notices(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(licenses.STRETCH - 3))
    texts = [
        "Released under the MIT License.", "Licensed under CC BY-NC 4.0", "GNU GENERAL PUBLIC LICENSE, Version 3 and the gnu general public license", "Der Text mit Lizenz, cc: by mail", "Apache License Apache-License apache licence 2.0",
        filler + " licensed under the Apache License, Version 2.0 " + filler + " mit license", "all rights reserved. redistribution and use in source and binary forms, with or without modification, are permitted",
    ]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    check(docs)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in registry.op2_licenses(spark, str(tmp_path)).collect()}
    assert (rows[0].base_labels, rows[0].labels, rows[0].first_word) == ("mit", "mit", 3)
    assert (rows[1].base_labels, rows[1].labels) == ("cc-by", "cc-by,cc-by-nc-4.0")
    assert (rows[2].n_base, rows[2].first_word, rows[2].last_word) == (2, 0, 8) and "gpl-3.0" in rows[2].labels
    assert rows[3].base_labels == "cc-by" and rows[4].n_base == 2
    assert 0 <= min(r.score for r in rows.values()) and max(r.score for r in rows.values()) <= 1
