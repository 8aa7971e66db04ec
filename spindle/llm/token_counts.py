"""Edit-aware token counts: a segment tree of pre-tokens per document, of which an edit re-encodes only what it touches.

BPE never merges across pre-tokens, so the count of a text is the sum of the counts of its pre-tokens. Leaves hold short
runs of pre-tokens; inner nodes hold sums of characters and of tokens. An edit finds its place by the character sums,
splits the touched stretch anew, from a little before it until its boundaries meet old ones again, and mends the sums above.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Pre-tokens of a leaf.
LEAF = 32
#: Edits of one document that are closer than this, in characters, share one stretch to encode.
MERGE = 64
Edit = tuple[int, int, str]

#: What the registered query edits: mail addresses, long hex strings, long numbers and runs of one sign.
_REDACT = re.compile(r"(?P<mail>[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})+)|(?P<hex>\b[0-9a-f]{24,}\b)|(?P<number>\+?\d[\d ()-]{6,}\d)|(?P<run>([!%$&*#|=_-])\5+)")


def redactions(text: str) -> list[Edit]:
    """Edits that mask personal data and secrets of a whole text and shorten runs of one sign; in order, apart."""
    return [(m.start(), m.end(), m[0][0] if m.lastgroup == "run" or m["run"] else f"[{m.lastgroup}]") for m in _REDACT.finditer(text)]


def merged(text: str, edits: list[Edit], gap: int = MERGE) -> list[Edit]:
    """Edits in order and apart, those less than `gap` characters apart made one that keeps the text between them."""
    out: list[list] = []
    for start, stop, new in edits:
        if out and start - out[-1][1] < gap:
            out[-1][2] += [text[out[-1][1] : start], new]
            out[-1][1] = stop
        else:
            out.append([start, stop, [new]])
    return [(start, stop, "".join(parts)) for start, stop, parts in out]


class _Counts(dict):
    """How many ids a pre-token has, for those met so far; forgets all at a bound."""

    def __init__(self, table: bpe.Bpe, entries: int = 600_000):
        self.table, self._entries = table, entries

    def __missing__(self, token: str) -> int:
        if len(self) >= self._entries:
            self.clear()
        n = len(self.table.encoded(token))
        if len(token) <= 64:
            self[token] = n
        return n


_COUNTS: dict[str, _Counts] = {}


class Counted:
    """A text as a segment tree; `tokens` is its count, `encoded` how many pre-tokens were encoded or looked up so far.

    A leaf keeps its pre-tokens and the count of each, so an edit asks only for the counts of what it splits anew. A leaf
    that grows beyond four times `leaf` makes the tree be dealt out again, from the counts that it has.
    """

    def __init__(self, text: str, counts: _Counts, leaf: int = LEAF):
        self.source, self.leaf = counts, leaf
        tokens = counts.table.pretokens(text)
        self.encoded = len(tokens)
        self._deal(tokens, [*map(counts.__getitem__, tokens)])

    def _deal(self, tokens: list[str], counts: list[int]) -> None:
        leaf = self.leaf
        self.leaves = [tokens[i : i + leaf] for i in range(0, len(tokens), leaf)] or [[]]
        self.parts = [counts[i : i + leaf] for i in range(0, len(tokens), leaf)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [[] for _ in range(self.size - len(self.leaves))]
        self.parts += [[] for _ in range(self.size - len(self.parts))]
        self.chars = [0] * self.size + [sum(map(len, held)) for held in self.leaves]
        self.counts = [0] * self.size + [*map(sum, self.parts)]
        for i in range(self.size - 1, 0, -1):
            self._add(i)

    @property
    def tokens(self) -> int:
        return self.counts[1]

    @property
    def text(self) -> str:
        return "".join(t for held in self.leaves for t in held)

    def _add(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.counts[i] = self.counts[2 * i] + self.counts[2 * i + 1]

    def _mend(self, leaf: int) -> None:
        i = self.size + leaf
        self.chars[i], self.counts[i] = sum(map(len, self.leaves[leaf])), sum(self.parts[leaf])
        while i := i // 2:
            self._add(i)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one with text for the end of the text) and its first character."""
        i, before = 1, 0
        while i < self.size:
            left = self.chars[2 * i]
            if at - before < left or not self.chars[2 * i + 1]:
                i *= 2
            else:
                before += left
                i = 2 * i + 1
        return i - self.size, before

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replaces characters start to stop (exclusive) by other ones; positions are cut to the text."""
        length, look = self.chars[1], self.source.table.look
        start, stop = min(max(start, 0), length), min(max(stop, 0), length)
        stop = max(start, stop)
        leaf, first = self._find(max(0, start - look - 1))
        held = self.leaves[leaf]
        keep = 0
        while keep < len(held) and first + len(held[keep]) + look <= start:
            first += len(held[keep])
            keep += 1
        old, known = held[keep:], self.parts[leaf][keep:]
        last, end, more = leaf, first + sum(map(len, old)), self.leaf
        while True:
            while last + 1 < self.size and end < stop + more:
                last += 1
                old += self.leaves[last]
                known += self.parts[last]
                end += self.chars[self.size + last]
            whole = last + 1 >= self.size
            text = "".join(old)
            window = text[: start - first] + new + text[stop - first :]
            shift = len(new) - (stop - start)
            bounds, at = {}, first
            for k, t in enumerate(old):
                if at >= stop:
                    bounds[at - first + shift] = k
                at += len(t)
            if at >= stop:
                bounds[at - first + shift] = len(old)
            fresh, at, meet = [], 0, None
            for t in self.source.table.split(window):
                if at in bounds and at >= start - first + len(new):
                    meet = bounds[at]
                    break
                if at + len(t) + look >= len(window) and not whole:
                    break
                fresh.append(t)
                at += len(t)
            else:
                meet = len(old)
            if meet is not None:
                break
            more *= 4
        self.encoded += len(fresh)
        self.leaves[leaf] = held[:keep] + fresh + old[meet:]
        self.parts[leaf] = self.parts[leaf][:keep] + [*map(self.source.__getitem__, fresh)] + known[meet:]
        for i in range(leaf + 1, last + 1):
            self.leaves[i], self.parts[i] = [], []
        if len(self.leaves[leaf]) > 4 * self.leaf:
            self._deal([t for held in self.leaves for t in held], [n for part in self.parts for n in part])
            return
        for i in range(leaf, last + 1):
            self._mend(i)


def counts_of(tokenizer_path: str) -> _Counts:
    """The counts of this process for a vocabulary file."""
    if tokenizer_path not in _COUNTS:
        _COUNTS[tokenizer_path] = _Counts(bpe.load(tokenizer_path))
    return _COUNTS[tokenizer_path]


def count(docs: DataFrame, tokenizer_path: str, edits_of: Callable[[str], Iterable[Edit]] = redactions) -> DataFrame:
    """Token counts before and after the edits of every document.

    Columns: doc_id, n_chars, n_pretokens, n_tokens, n_edits, n_reencoded (pre-tokens whose counts the edits asked for), n_tokens_edited.
    Edits are (start, stop, text) in characters of the text as it was, in order and apart. A null text counts as empty;
    null doc_ids and repeated rows are counted like any others, long texts whole; an empty table gives no rows; other columns are not read.
    """
    names = ["n_chars", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_edited"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(tokenizer_path)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                tree = Counted(text, counts)
                before, pretokens = tree.tokens, tree.encoded
                edits = list(edits_of(text))
                for edit in reversed(merged(text, edits)):  # from the end, so that positions stay what they were
                    tree.edit(*edit)
                rows.append((len(text), pretokens, before, len(edits), tree.encoded - pretokens, tree.tokens))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names)))], ["doc_id", *names])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(each, "doc_id long, " + ", ".join(f"{n} long" for n in names))
