"""Cutting a text into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import public_tokenizers
import regex
import tiktoken

_SPLIT = regex.compile(public_tokenizers.PATTERN)


def _narrow() -> re.Pattern:
    """The public pattern for characters under 256, its classes written out: the standard module is twice as fast."""
    chars = [chr(c) for c in range(256)]
    letter, number, space = ("".join(f"\\x{ord(c):02x}" for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    out = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\S", f"[^{space}]")
    return re.compile(out.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{space}]"))


_SPLIT_NARROW = _narrow()
#: Stands for a character that is neither letter, number nor space; of the same length in code points.
_OTHER = "￿"


@lru_cache(maxsize=1)
def _newer() -> regex.Pattern | None:
    """Characters that this regex module, having newer Unicode tables, takes for letters or numbers and the tokenizers don't.

    The tokenizers' own view is asked for with a vocabulary in which a letter followed by the character is one token.
    """
    doubtful = [
        c
        for c in map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000)))
        if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)
    ]
    ranks = {bytes([i]): i for i in range(256)}
    for first in b"a", b"1":
        for c in doubtful:
            ranks[first + c.encode()] = len(ranks)
    asked = tiktoken.Encoding("asked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = [c for c in doubtful if all(len(asked.encode_ordinary(first + c)) > 1 for first in ("a", "1"))]
    return regex.compile(f"[{''.join(other)}]") if other else None


def pieces(text: str) -> list[str]:
    """The matches of the public pattern in text; together they are the whole text."""
    try:
        text.encode("latin-1")
        return _SPLIT_NARROW.findall(text)
    except UnicodeEncodeError:
        newer = _newer()
        if newer is None or not newer.search(text):
            return _SPLIT.findall(text)
    return [text[m.start() : m.end()] for m in _SPLIT.finditer(newer.sub(_OTHER, text))]


#: Pieces up to this length stay in a memo that is full.
SHORT = 7


class PieceMemo:
    """What was found for pieces seen before: looked up once for each piece of a batch of texts, then only for what was missing."""

    def __init__(self, resolve: Callable[[list[str]], list[bytes]], most: int) -> None:
        self.resolve, self.most = resolve, most
        self.known: dict[str, bytes] = {}

    def joined(self, texts: list[str]) -> list[bytes]:
        """For each text the joined values of its pieces."""
        if len(self.known) > self.most:  # short pieces come again soonest
            short = {k: v for k, v in self.known.items() if len(k) <= SHORT}
            self.known = short if len(short) <= self.most // 2 else {}
        flat: list[str] = []
        ends = []
        for t in texts:
            flat += pieces(t)
            ends.append(len(flat))
        values = list(map(self.known.get, flat))
        if None in values:
            gaps = [i for i, v in enumerate(values) if v is None]
            new = list({flat[i] for i in gaps})
            self.known.update(zip(new, self.resolve(new), strict=True))
            for i in gaps:
                values[i] = self.known[flat[i]]
        return [b"".join(values[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
