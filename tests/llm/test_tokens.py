"""Operators 1 and 2 against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe, tokenfile
from quarry.llm.pretokens import pieces

from .conftest import plain


def own(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = own(bpe.VOCABULARY)
ENCODER = bpe.Encoder(bpe.read_ranks(P.path(bpe.VOCABULARY)))
DEFINITION = open(P.path(tokenfile.TOKENIZER), encoding="utf-8").read()
TOKENIZER, PIECES = Tokenizer.from_str(DEFINITION), tokenfile.PieceEncoder(DEFINITION)
TEXT = st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet=" \n\t'sreavé1ß՘　😀don't", max_size=40)


def test_every_kind_of_character_like_the_libraries():
    """Each code point between letters, numbers and spaces; of the large blocks of one kind every 16th."""
    wide = [(0x3400, 0xD7FF), (0xE000, 0xF8FF), (0x17000, 0x18FFF), (0x20000, 0x10FFFF)]
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 16 == 0 or not any(a <= c <= b for a, b in wide))]
    texts = [f"a{x}1{x} {x}b" for x in map(chr, points)]
    for i in range(0, len(texts), 20_000):
        part = texts[i : i + 20_000]
        theirs = [e.ids for e in TOKENIZER.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(b, "<u4").tolist() for b in PIECES.encode_all(part)] == theirs
        assert [ENCODER.encode(t) for t in part] == LIBRARY.encode_ordinary_batch(part, num_threads=1)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_any_text_like_the_libraries(text):
    assert "".join(pieces(text)) == text
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode_ordinary(text) and ENCODER.decode(ids) == text.encode()
    assert np.frombuffer(PIECES.encode_all([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_added_tokens_go_to_the_library():
    text = "a <|endoftext|> b"
    assert np.frombuffer(PIECES.encode_all([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_long_pre_tokens():
    rng = random.Random(2)
    for text in ("a" * 5000, "".join(rng.choice("abcdefgh") for _ in range(3000))):
        assert ENCODER.encode(text) == LIBRARY.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    keys = [f"key{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    slots = h.slots(keys)
    assert sorted(slots.tolist()) == list(range(5000))
    assert [keys[i] for i in h.order[slots]] == keys


def test_round_trip_query(docs, nothing):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs).collect())
    want = []
    for i, t in plain(docs):
        ids = LIBRARY.encode_ordinary(t)
        want.append((i is not None, i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(nothing).count() == 0


def test_encode_then_decode(docs):
    ids = bpe.encode_texts(docs.filter("doc_id > 40"))
    assert {(r.doc_id, bytes(r.decoded)) for r in bpe.decode_ids(ids).collect()} == {(i, t.encode()) for i, t in plain(docs.filter("doc_id > 40"))}


@pytest.mark.parametrize("values", [[], [0], [0, 0, 5, 5, 1000], list(range(0, 90000, 7)), sorted(random.Random(1).randint(0, 10**12) for _ in range(3000))])
def test_elias_fano(values):
    ef, _ = tokenfile.EliasFano.read(memoryview(tokenfile.EliasFano.of(np.array(values, np.uint64)).tobytes()), 0)
    assert ef.values().tolist() == values
    for i in range(0, len(values), max(1, len(values) // 50)):
        assert ef.select(i) == values[i]
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_boundaries_take_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 1000, 10000))
    assert len(tokenfile.EliasFano.of(ends).tobytes()) < 10000 * 12 / 8 + 200


def test_blocks():
    ids = [np.array([1, 2, 70000], np.uint32), np.array([], np.uint32), np.array([5], np.uint32)]
    block = tokenfile.Block(tokenfile.write_block([None, -7, 12], ids))
    assert [(d, s, x.tolist()) for d, s, x in block] == [(None, 0, [1, 2, 70000]), (-7, 3, []), (12, 3, [5])]
    assert block.ids(2).tolist() == [5]


def test_token_files(docs, nothing, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)  # several blocks a shard
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.token_files(docs).collect())
    rows = [(i, TOKENIZER.encode(t, add_special_tokens=False).ids + [2]) for i, t in plain(docs)]
    assert sorted((k is not None, k or 0, n, c) for k, _, n, c in [(g[1] if g[0] else None, *g[2:]) for g in got]) == sorted((i is not None, i or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in rows)
    at = 0
    for _, _, start, n, _ in sorted(got, key=lambda g: g[2]):
        assert start == at
        at += n
    order = [(g[0], g[1]) for g in sorted(got, key=lambda g: g[2])]
    assert order == sorted(order)
    assert tokenfile.token_files(nothing).count() == 0
