"""Words of texts as numbers, for operators that count or hash them."""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.default_rng(31).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes of a word from which on it is hashed by xxh3: sums modulo 2**64 collide on long words of a regular build.
LONG = 256
#: Bytes that are hashed at once: the arrays stay in cache.
_PIECE = 1 << 17
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _up_down(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def hash_words(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words in order, and where each text's words start (one more than texts): polynomial hashes of all words at once, from sums over the bytes modulo 2**64, but for long words."""
    raw = [t.encode() for t in texts]
    data = b"\n".join(raw)
    data = np.frombuffer(data.lower() if lower else data, np.uint8)
    out, at_byte, a = [], [], 0
    while a < len(data):
        b = min(a + _PIECE, len(data))
        if b < len(data):  # end behind white space; a longer word makes the piece longer
            gaps = np.flatnonzero(_SPACE[data[a:b]])
            while not len(gaps) and b < len(data):
                b = min(b + _PIECE, len(data))
                gaps = np.flatnonzero(_SPACE[data[a:b]])
            b = a + int(gaps[-1]) + 1 if len(gaps) and b < len(data) else b
        part = data[a:b]
        up, down = _up_down(len(part) + 1)
        inside = np.concatenate([[False], ~_SPACE[part], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
        own = (sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)
        for i in np.flatnonzero(end - first > LONG).tolist():
            own[i] = xxhash.xxh3_64_intdigest(part[first[i] : end[i]])
        out.append(own)
        at_byte.append(first + a)
        a = b
    hashes = np.concatenate(out) if out else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    starts = np.searchsorted(np.concatenate(at_byte), bounds) if at_byte else np.zeros(len(bounds), np.int64)
    return hashes, starts.astype(np.int64)
