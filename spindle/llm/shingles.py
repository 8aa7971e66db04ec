"""Shingles of a text as 64-bit hashes, and the fingerprint of such hashes."""

from __future__ import annotations

import numpy as np


def hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42, unsigned) of every run of `width` words, repeats included; fewer words are one run, none no run."""
    import xxhash

    got = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII blanks alone split
    if not got:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(got), np.cumsum([len(w) + 1 for w in got]).tolist()
    digest = xxhash.xxh64_intdigest
    if len(got) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    return np.array([digest(joined[a : b - 1], 42) for a, b in zip([0, *ends], ends[width - 1 :])], np.uint64)


def fingerprint_of(hashed: np.ndarray) -> int:
    """The bits that over half the hashes have; zero for none."""
    counts, step = np.zeros(64, np.int64), 1 << 16
    for k in range(0, len(hashed), step):
        part = hashed[k : k + step].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashed), bitorder="little").view("<u8")[0])
