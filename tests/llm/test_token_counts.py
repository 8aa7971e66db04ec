"""Edit-aware counts against encoding the edited text anew."""

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindle.llm import bpe, token_counts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = st.one_of(st.characters(codec="utf-8"), st.sampled_from([*"ab1 '\n\tstrevmldé   ", "<|endoftext|>", "<|endof", "text|>"]))
texts = lambda most: st.lists(PARTS, max_size=most).map("".join)


def plain(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(texts(80), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), texts(8)), max_size=6))
def test_edits_one_after_another(text, edits):
    tree = token_counts.Counted(text, token_counts.counts_of(bpe.default_path()), leaf=2)
    for a, b, new in edits:
        a, b = min(a, len(text)), min(max(a, b), len(text))
        tree.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert tree.text == text
        assert tree.tokens == plain(text)


def test_a_small_edit_of_a_long_text_encodes_little():
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha", "beta,", "it's", "\n", "12 ", "gamma"]) for _ in range(20_000))
    tree = token_counts.Counted(text, token_counts.counts_of(bpe.default_path()))
    for _ in range(50):
        before, a = tree.encoded, rng.randrange(len(text))
        tree.edit(a, a + 3, "new words ")
        text = text[:a] + "new words " + text[a + 3 :]
        assert tree.encoded - before < 40
    assert tree.text == text and tree.tokens == plain(text)


def test_every_document(documents, odd, nothing):
    for docs in (documents, odd):
        rows = token_counts.count(docs, bpe.default_path()).collect()
        expected = []
        for r in docs.select("doc_id", "text").collect():
            text, new, at = r.text or "", "", 0
            edits = token_counts.redactions(text)
            for a, b, x in edits:
                new, at = new + text[at:a] + x, b
            expected.append((str(r.doc_id), len(text), plain(text), len(edits), plain(new + text[at:])))
        assert sorted((str(r.doc_id), r.n_chars, r.n_tokens, r.n_edits, r.n_tokens_edited) for r in rows) == sorted(expected)
    assert sum(r.n_edits for r in token_counts.count(documents, bpe.default_path()).collect()) > 0
    assert token_counts.count(nothing, bpe.default_path()).count() == 0


class _Spied(token_counts._Counts):
    def __init__(self, table):
        super().__init__(table)
        self.asked = []

    def __getitem__(self, token):
        self.asked.append(token)
        return super().__getitem__(token)


def test_untouched_pretokens_are_not_asked_for_again():
    text = " ".join(["x" * 81] * 40)
    tree = token_counts.Counted(text, counts := _Spied(bpe.load(bpe.default_path())))
    before, counts.asked = tree.encoded, []
    tree.edit(0, 1, "y")
    assert tree.encoded - before == len(counts.asked) <= 2 and tree.tokens == plain("y" + text[1:])


def test_leaves_stay_short():
    tree = token_counts.Counted("a b c", token_counts.counts_of(bpe.default_path()))
    tree.edit(1, 1, " new words" * 20_000)
    for i in range(300):
        tree.edit(2 * i, 2 * i, " z")
    assert max(map(len, tree.leaves)) <= 4 * token_counts.LEAF and tree.tokens == plain(tree.text)
