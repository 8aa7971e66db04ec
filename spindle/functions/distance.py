"""Edit distance and the rules around corrections, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def osa(a: Column, b: Column, most: int = 2) -> Column:
    """Optimal string alignment distance by code points, most + 1 where it is over `most`.

    An edit may not touch a transposed pair again. Pairs that lengths or the built-in distance rule out (a transposition is
    two of its edits) skip the table.
    """
    x, y = F.split(a, ""), F.split(b, "")
    n, m = F.length(a), F.length(b)
    first = F.sequence(F.lit(0), m)
    start = F.struct(first.alias("before"), first.alias("last"), F.lit(0).alias("i"))

    def row(s: Column, _: Column) -> Column:
        i = s["i"] + 1

        def cell(done: Column, j: Column) -> Column:
            same = F.get(x, i - 1) == F.get(y, j - 1)
            step = F.least(F.get(s["last"], j) + 1, F.element_at(done, -1) + 1, F.get(s["last"], j - 1) + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (F.get(x, i - 1) == F.get(y, j - 2)) & (F.get(x, i - 2) == F.get(y, j - 1))
            return F.concat(done, F.array(F.when(swap, F.least(step, F.get(s["before"], j - 2) + 1)).otherwise(step)))

        current = F.aggregate(F.sequence(F.lit(1), m), F.array(i), cell)
        return F.struct(s["last"].alias("before"), current.alias("last"), i.alias("i"))

    full = F.aggregate(F.sequence(F.lit(1), n), start, row, lambda s: F.element_at(s["last"], -1))
    short = F.greatest(n, m)
    near = (F.abs(n - m) <= most) & (F.levenshtein(a, b) <= 2 * most)
    return F.when(~near, most + 1).when((n == 0) | (m == 0), F.least(short, F.lit(most + 1))).otherwise(F.least(full, F.lit(most + 1)))


def auto_threshold(word: Column) -> Column:
    return F.when(F.length(word) <= 4, 1).otherwise(2)


def is_code_like(word: Column) -> Column:
    return (word != "") & (word.rlike("[0-9]") | (word.rlike("^[a-z]+$") & ~word.rlike("[aeiouy]")))


def is_plausible(word: Column, correction: Column) -> Column:
    return F.abs(F.length(word) - F.length(correction)) <= 1
