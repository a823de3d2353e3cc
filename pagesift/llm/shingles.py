"""Word and shingle helpers on UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import xxhash

def blank_words(text: bytes) -> list[bytes]:
    """Maximal runs of bytes other than U+0020 and U+0009 to U+000D, the white space of ``bytes.split``."""
    return text.split()


def lower_ascii(text: bytes) -> bytes:
    """A-Z in lower case; other letters are no single ASCII bytes in UTF-8 and stay."""
    return text.lower()


def simhash(text: bytes, n_words: int, seed: int) -> int:
    """Majority of the bits of the XXH64 hashes of all ``n_words``-word shingles, repeats included.

    A text of fewer words is one shingle, a text without words has fingerprint 0.
    """
    words = blank_words(lower_ascii(text))
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n_words:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - n_words + 1].tolist()
    ends = ends[n_words - 1 :].tolist()
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = 2 * ones > len(hashes)
    return int.from_bytes(np.packbits(set_bits, bitorder="little").tobytes(), "little")
