"""Byte-level BPE over pre-tokens, with a per-process table of the pre-tokens already encoded. Added tokens of the file are pre-tokens."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

#: Letters, numbers and blanks of the characters that the quick pattern covers.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
_QUICK = re.compile(f" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Texts of these characters only are split by the quick pattern; it leaves out controls that engines class differently.
_COVERED = re.compile("[\\t-\\r -~\\x85\\xa0-ɏ‘’“”–—…€•]*")
_LOADED: dict[tuple, "Bpe"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe(dict):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit bytes.

    The ids are those of the whole text, since BPE never merges across pre-tokens. The table forgets everything
    once it holds `entries` pre-tokens, so memory is bounded whatever the corpus.
    """

    def __init__(self, path: str, entries: int = 600_000):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        letters, self._special = _letters(), {t["content"]: t["id"] for t in stored["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in stored["model"]["vocab"].items() if token not in self._special}
        self._encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._whole = regex.compile(PATTERN)
        self._added = re.compile("|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) or "(?!)")
        self._entries = entries
        #: How far beyond its end the choice of a pre-token can look: 're after an apostrophe, or an added token.
        self.look = max([2, *map(len, self._special)])

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self._entries:
            self.clear()
        ids = b"".join([i.to_bytes(4, "little") for i in self.encoded(token)])
        if len(token) <= 64:
            self[token] = ids
        return ids

    def encoded(self, token: str) -> list[int]:
        """The ids of one pre-token, worked out anew."""
        return [self._special[token]] if token in self._special else self._encode(token)

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text; added tokens part it first."""
        pattern = _QUICK if _COVERED.fullmatch(text) else self._whole
        return pattern.findall(text) if not self._added.search(text) else list(self._parted(pattern, text))

    def split(self, text: str) -> Iterator[str]:
        """The same, one after another."""
        pattern = _QUICK if _COVERED.fullmatch(text) else self._whole
        return (m[0] for m in pattern.finditer(text)) if not self._added.search(text) else self._parted(pattern, text)

    def _parted(self, pattern, text: str) -> Iterator[str]:
        at = 0
        for m in self._added.finditer(text):
            yield from pattern.findall(text[at : m.start()])
            yield m[0]
            at = m.end()
        yield from pattern.findall(text[at:])

    def ids(self, text: str) -> bytes:
        """The ids of a whole text; an added token in it is that token, as the tokenizer has it."""
        return b"".join(map(self.__getitem__, self.pretokens(text)))


def load(path: str) -> Bpe:
    """The table of this process for a vocabulary file; Python workers live on between tasks, and so does it."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
