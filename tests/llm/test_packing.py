"""Packing: an exact round trip of ids, gapless sequences, and few of them."""

import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindle.llm import bpe, packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def pieces_of(docs, capacity=2048):
    """What the pieces of documents must be, by the tokenizer itself."""
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        expected += [(str(r.doc_id), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return sorted(expected)


def check(docs, capacity=2048, per_packer=packing.PACKER):
    rows = packing.pack(docs, bpe.default_path(), capacity, per_packer).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces_of(docs, capacity)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert all(x <= capacity for x in ends.values())
    return len(ends), sum(ends.values())


def test_round_trip(documents):
    n, total = check(documents)
    assert n <= 1.02 * total / 2048 + 2
    n, total = check(documents, capacity=128, per_packer=300)
    assert n <= 1.02 * total / 128 + 8


def test_odd_rows(odd, nothing):
    check(odd)
    check(odd, capacity=16)
    assert packing.pack(nothing, bpe.default_path()).count() == 0


def test_place_follows_the_sum_of_squares():
    rng = random.Random(3)
    lengths = sorted((rng.randint(1, 20) for _ in range(300)), reverse=True)
    sequence, offset = packing.place(np.array(lengths), 20)
    fill, left = {}, sum(lengths)
    for size, s, o in zip(lengths, sequence, offset):
        squares = lambda f: sum(x * x for x in np.bincount([20 - v for v in f.values() if v < 20], minlength=1).tolist())
        now = {k: squares({**fill, k: v + size}) for k, v in fill.items() if v + size <= 20}
        opened = squares({**fill, len(fill): size})
        gaps = sum(20 - v for v in fill.values())
        best = min(now.values(), default=None)
        may_open = best is None or gaps < left and opened < best
        assert fill.get(s, 0) == o
        assert (now[s] == best) if s in now else may_open and s == len(fill)
        fill[int(s)] = o + size
        left -= size


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from([*"ab1 '\n\tstrevmldé  ", "<|endoftext|>", "<|", "<|endof"])), max_size=60))
def test_ids_are_the_tokenizers(parts):
    text = "".join(parts)
    ids = np.frombuffer(bpe.load(bpe.default_path()).ids(text), "<u4").tolist()
    assert ids == TOKENIZER.encode(text, add_special_tokens=False).ids
