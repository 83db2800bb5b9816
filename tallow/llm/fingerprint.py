"""Hashes of a text's word shingles, and what is made of them: the 64-bit fingerprint and a key of the set."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """uint64, repeats included. Fewer words than a shingle are one shingle; no word gives none."""
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, SEED) for p in parts), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64 bits: a bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def text_key(kinds: np.ndarray, fingerprint: int) -> int:
    """Signed 64-bit hash of the sorted distinct hashes and the fingerprint."""
    return xxhash.xxh64_intdigest(kinds.tobytes() + fingerprint.to_bytes(8, "little", signed=True), SEED) - (1 << 63)
