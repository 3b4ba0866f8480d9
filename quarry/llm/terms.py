"""Terms of texts as numbers: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from quarry.llm.words import _BYTES, _up_down

_BLANK = 0x20
#: Every byte of a term to its lower case, every other byte to a blank. UTF-8 has bytes of 0x80 and more beyond ASCII only.
_PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else _BLANK for b in range(256)).lower()
#: Bytes of a term from which on it is hashed by xxh3: sums modulo 2**64 collide on long terms of a regular build.
LONG = 256
#: Bytes that are hashed at once: the arrays stay in cache.
_PIECE = 1 << 17


@dataclass
class Terms:
    """All terms of some texts: the plain bytes, where each term begins and ends, its hash, and where each text's terms begin (one more than texts)."""

    data: np.ndarray
    first: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray

    def joined(self) -> tuple[bytes, np.ndarray]:
        """The terms with one blank behind each, and where each of them begins (one more than terms)."""
        inside = self.data != _BLANK
        keep = inside.copy()
        keep[1:] |= inside[:-1]
        return self.data[keep].tobytes(), np.concatenate([[0], np.cumsum(self.end - self.first + 1)])


def terms_of(column: pa.Array) -> Terms:
    """The terms of an array of texts; null has none."""
    raw = [b or b"" for b in column.cast(pa.binary()).to_pylist()]
    data = np.frombuffer((b" ".join(raw) + b" ").translate(_PLAIN), np.uint8)
    inside = np.concatenate([[False], data != _BLANK])
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # the last byte is a blank, so every term ends
    first, end = edges[::2], edges[1::2]
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return Terms(data, first, end, _hashed(data, first, end), np.searchsorted(first, bounds))


def _hashed(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all terms, from sums over pieces of the bytes."""
    out, k = np.empty(len(first), np.uint64), 0
    while k < len(first):
        a = int(first[k])
        m = max(int(np.searchsorted(end, a + _PIECE, side="right")), k + 1)
        part = data[a : end[m - 1]]
        up, down = _up_down(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
        f, e = first[k:m] - a, end[k:m] - a
        out[k:m] = (sums[e] - sums[f]) * down[f] + (e - f).astype(np.uint64)
        k = m
    for i in np.flatnonzero(end - first > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[first[i] : end[i]])
    return out
