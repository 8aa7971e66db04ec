"""Licence scan: ordered signature rules over whole texts, in expressions alone.

A keyword prefilter gates the rules; a document without any keyword runs none, and in the others each stretch of words
runs only the rules one of whose keywords it holds. Long texts are scanned in overlapping stretches, so the work in a
stretch is bounded and that in a text grows with its length. Of overlapping detections, one that contains or is contained
in a detection of higher priority is suppressed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words
from .license_rules import BASE, rules

#: Words of a stretch, and how far it looks beyond both ends; no rule matches as many words as the latter.
STRETCH, REACH = 2048, 64
_RULE = "array<struct<base:boolean,priority:int,weight:double,label:string,keywords:array<string>,regex:string>>"
_FOUND = "array<struct<start:bigint,stop:bigint,base:boolean,priority:int,weight:double,label:string>>"


def _listed() -> list[dict]:
    """Base phrases and rules as plain rows; base phrases have the lowest priority."""
    own = [{"base": False, "priority": r.priority, "weight": r.weight, "label": r.label, "keywords": list(r.keywords), "regex": r.regex} for r in rules()]
    base = [{"base": True, "priority": len(own) + i, "weight": 0.8, "label": label, "keywords": [max(phrase.split(), key=lambda w: (w in ("license", "cc"), len(w)))], "regex": "".join(f" {w} " for w in phrase.split())} for i, (phrase, label) in enumerate(BASE)]
    return own + base


def _count(padded: Column) -> Column:
    """Words of a text in which each has a blank of its own on either side."""
    return ((F.length(padded) - F.length(F.replace(padded, F.lit(" ")))) / 2).cast("bigint")


def _places(padded: Column, rule: Column, base: Column) -> Column:
    """Where a rule matches in a stretch: its words are counted from `base` on."""
    matched, between = F.regexp_extract_all(padded, rule["regex"], F.lit(0)), F.split(padded, rule["regex"], F.lit(-1))
    none = F.array().cast(_FOUND)

    def add(state: Column, i: Column) -> Column:
        start = state["at"] + _count(F.get(between, i))
        stop = start + _count(F.get(matched, i))
        here = F.struct(start.alias("start"), stop.alias("stop"), rule["base"].alias("base"), rule["priority"].alias("priority"), rule["weight"].alias("weight"), rule["label"].alias("label"))
        return F.struct(stop.alias("at"), F.concat(state["out"], F.array(here)).cast(_FOUND).alias("out"))

    every = F.aggregate(F.sequence(F.lit(0), F.size(matched) - 1), F.struct(base.cast("bigint").alias("at"), none.alias("out")), add, lambda s: s["out"])
    return F.when(F.size(matched) > 0, every).otherwise(none)


def _survivors(found: Column) -> Column:
    """Base places, and detections that no detection of higher priority contains or is contained in."""

    def beaten(d: Column) -> Column:
        inside = lambda a, b: (a["start"] >= b["start"]) & (a["stop"] <= b["stop"])
        return F.exists(found, lambda e: ~e["base"] & (e["priority"] < d["priority"]) & (inside(d, e) | inside(e, d)))

    return F.filter(found, lambda d: d["base"] | ~beaten(d))


def scan(docs: DataFrame) -> DataFrame:
    """Detections of every document: doc_id, n_words, found (array<struct<start, stop, base, priority, weight, label>>).

    Words are counted from 0, stop is exclusive. Base phrases are reported at all their places; other detections if they
    survive. A null text counts as empty, with no words. Null doc_ids and repeated rows are scanned like any others, row by
    row and without a shuffle; other columns are not read.
    """
    listed = _listed()
    table = F.from_json(F.lit(json.dumps(listed)), _RULE)
    gates = F.from_json(F.lit(json.dumps(sorted({k for r in listed for k in r["keywords"]}))), "array<string>")
    none = F.array().cast(_FOUND)

    def stretch(s: Column) -> Column:
        """What begins in the stretch of words from s on; found among the words around it too."""
        first = F.greatest(s - REACH, F.lit(0))
        near = F.slice("w", first + 1, s - first + STRETCH + REACH)
        held = F.array_intersect(near, gates)
        padded = F.concat(F.lit(" "), F.array_join(near, "  "), F.lit(" "))
        ruled = F.filter(table, lambda r: F.arrays_overlap(r["keywords"], held))
        every = F.flatten(F.transform(ruled, lambda r: _places(padded, r, first)))
        own = F.aggregate(F.array(every), none, lambda _, e: F.filter(_survivors(e), lambda d: (d["start"] >= s) & (d["start"] < s + STRETCH)))
        return F.when(F.size(held) > 0, own).otherwise(none)

    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    gated = F.arrays_overlap("w", gates)
    found = F.when(gated, F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(STRETCH)), stretch))).otherwise(none)
    return split.select("doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found"))


def span_bound() -> int:
    """The most words that any rule can match."""
    return max(sum(int(m[1]) if (m := re.fullmatch(r"\{0,(\d+)\}\?", x)) else 1 for x in re.findall(r"\{0,\d+\}\?| \(\?:\(?", r.regex)) for r in rules())
