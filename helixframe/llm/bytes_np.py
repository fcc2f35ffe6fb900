"""Hashing of many texts at once with numpy: one buffer of bytes, no Python loop over words or characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def chunks(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, buffer, its texts' ends in it): every text is followed by a space."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) < CHUNK):
            n += len(texts[j]) + 1
            j += 1
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        yield i, np.frombuffer(b" ".join(texts[i:j]) + b" ", np.uint8), ends
        i = j


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared, ... modulo 2**64; at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 64), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK:  # a very long text's powers aren't kept
            _powers[base] = have
    return have


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, digits and bytes beyond ASCII. The buffer ends in a space."""
    inside = _WORD[buffer].view(np.int8)
    edges = np.diff(inside, prepend=np.int8(0))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def run_hashes(buffer: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """A 64-bit hash of the bytes of each span, the same wherever the bytes stand."""
    n = len(buffer)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n)[:n], out=sums[1:])
    back = powers(_INVERSE, n)
    return [(sums[e] - sums[s]) * back[s] for s, e in spans]
