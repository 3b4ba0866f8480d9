"""Operator 1: byte-level BPE encoding and decoding.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token; every other
pre-token is merged by a heap of ranked pairs over a doubly linked list of its bytes. A bounded memo keeps what the
two tiers returned for pre-tokens seen before; it never changes a result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame

from quarry.llm.common import SLICE_BYTES, held, map_batches, texts_of
from quarry.llm.pretokens import PieceMemo

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker keeps; beyond that only short ones stay.
MEMO = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token and rank a line), by rank; ranks must be 0, 1, 2 and so on."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    return [tokens[i] for i in range(len(tokens))]


class PerfectHash:
    """A minimal perfect hash: keys fall into buckets, and each bucket has a displacement that sends its keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4) -> None:
        self.n = len(keys)
        self.buckets = max(1, self.n // per_bucket)
        self.displacement = np.zeros(self.buckets, np.uint64)
        h = self.hashes(keys)
        bucket, first, step = self._parts(h)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        taken = np.zeros(self.n, bool)
        self.order = np.zeros(self.n, np.int64)
        tries = np.arange(4 * self.n, dtype=np.uint64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            members = order[bounds[b] : bounds[b + 1]]
            at = 0
            while True:  # a window of displacements at once
                d = tries[at : at + 64] if at < len(tries) else np.arange(at, at + 64, dtype=np.uint64)
                slots = self._slot(first[members][:, None], step[members][:, None], d[None, :])
                fits = ~taken[slots].any(0)
                if len(members) > 1:
                    ordered = np.sort(slots, axis=0)
                    fits &= (ordered[1:] != ordered[:-1]).all(0)
                if fits.any():
                    k = int(np.argmax(fits))
                    self.displacement[b] = d[k]
                    taken[slots[:, k]] = True
                    self.order[slots[:, k]] = members
                    break
                at += 64

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _parts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        return (high % np.uint64(self.buckets)).astype(np.int64), low, (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)

    def _slot(self, first: np.ndarray, step: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = first + d * (step | np.uint64(1)) + (d * d)
        x ^= x >> np.uint64(15)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """For each key its slot; a key that isn't in the set gets some slot too."""
        bucket, first, step = self._parts(self.hashes(keys))
        return self._slot(first, step, self.displacement[bucket])


class Encoder:
    """Encodes and decodes with the tokens of a rank file."""

    def __init__(self, tokens: list[bytes], hashed: PerfectHash | None = None, memo: int = MEMO) -> None:
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.hashed = hashed or PerfectHash(tokens)
        self.ids = self.hashed.order
        self.keys = [tokens[i] for i in self.ids]
        self.memo = PieceMemo(lambda new: [struct.pack(f"<{len(i)}I", *i) for i in self.resolve(new)], memo)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token that is no token: the pair of lowest rank is joined first, the leftmost of equals."""
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) == n or len(left) + len(part[j]) != size:
                continue  # one of the two has changed since
            joined = left + part[j]
            part[i], part[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + part[k])) is not None:
                    heappush(heap, (r, i, size + len(part[k])))
            if (h := before[i]) >= 0 and (r := rank(part[h] + joined)) is not None:
                heappush(heap, (r, h, len(part[h]) + size))
        return [self.ranks[p] for p in part if p is not None]

    def resolve(self, new: list[str]) -> list[list[int]]:
        """The ids of each pre-token, by the two tiers."""
        raw = [p.encode() for p in new]
        if not raw:
            return []
        slots, keys, ids = self.hashed.slots(raw).tolist(), self.keys, self.ids
        return [[int(ids[s])] if keys[s] == b else self.merge(b) for s, b in zip(slots, raw, strict=True)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.memo.joined(texts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))


def _shared(value: tuple[str, list[bytes], PerfectHash], memo: int = MEMO) -> Encoder:
    """A worker's encoder for a broadcast vocabulary; kept from task to task."""
    return held(f"bpe {value[0]} {memo}", lambda: Encoder(value[1], value[2], memo))


def _prepared(df: DataFrame, vocabulary: str):
    tokens = read_ranks(vocabulary)
    name = hashlib.sha256(b"\0".join(tokens)).hexdigest()
    return df.sparkSession.sparkContext.broadcast((name, tokens, PerfectHash(tokens)))  # grows with the vocabulary only


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """id_col, ids (array of int) of every text. A null text is empty and has no ids; rows stay as many as they are,
    repeated ids included; other columns are not read."""
    shared = _prepared(df, vocabulary or public_tokenizers.path(VOCABULARY))

    def make(batch: pa.RecordBatch) -> dict:
        ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in _shared(shared.value).encode_all(texts_of(batch, "text"))]
        return {"id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))}

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), ["id", "text"], make, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """id_col, decoded (binary) of every array of ids; a null array decodes to nothing."""
    shared = _prepared(df, vocabulary or public_tokenizers.path(VOCABULARY))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            decode = _shared(shared.value).decode
            out = pa.array([decode(x or []) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, memo: int = MEMO, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Encode every text, decode the ids, and return per row: id_col, n_tokens, ids_sha256, decoded_sha256.

    Empty and null texts have 0 ids and the digests of no bytes; an empty table gives no rows; of the input only the
    two named columns are read, whatever the others are called; repeated rows give repeated results. memo and
    slice_bytes bound what a worker holds (about 200 bytes a pre-token, 15 a byte of text) and change no result.
    """
    shared = _prepared(df, vocabulary or public_tokenizers.path(VOCABULARY))

    def make(batch: pa.RecordBatch) -> dict:
        encoder = _shared(shared.value, memo)
        packed = encoder.encode_all(texts_of(batch, "text"))
        return {
            "id": batch.column(0),
            "n_tokens": [len(b) // 4 for b in packed],
            "ids_sha256": [hashlib.sha256(b).hexdigest() for b in packed],
            "decoded_sha256": [hashlib.sha256(encoder.decode(np.frombuffer(b, "<u4"))).hexdigest() for b in packed],
        }

    kind = df.schema[id_col].dataType.simpleString()
    out = map_batches(df.selectExpr(f"`{id_col}` AS id", f"`{text_col}` AS text"), ["id", "text"], make, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", slice_bytes)
    return out.withColumnRenamed("id", id_col)
