"""Operator 2: token ids in binary blocks with Elias-Fano coded document boundaries.

A block is one byte string: a header, the document ids and the boundaries as two Elias-Fano sequences, then the
concatenated ids in 2 or 4 bytes each. Boundaries take about 2 + log2(tokens / documents) bits a document instead of
a table of 64-bit offsets; ``EliasFano.select`` returns any of them. Blocks are rows of a table in the shared folder,
since only Spark's own writers reach every store; their order is (shard, block), and document ids ascend throughout.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import held, shared_dir, slices, texts_of
from quarry.llm.pretokens import PieceMemo

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
MAGIC = b"QTOK1\0\0\0"
#: A block is closed once it holds this many ids; a longer document has a block of its own.
BLOCK_IDS = 2_000_000
#: Distinct pre-tokens whose ids a worker keeps; beyond that only short ones stay.
MEMO = 1_300_000
#: Blocks up to this number have their places broadcast (24 bytes each); more are joined by a shuffle.
BROADCAST_BLOCKS = 500_000


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed plainly, high parts in unary, with samples for select."""

    SAMPLE = 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._ones: np.ndarray | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1)
        low = v & np.uint64((1 << bits) - 1)
        packed = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1, np.uint8)
        unary[at] = 1
        return cls(n, bits, packed, np.packbits(unary, bitorder="little"))

    def tobytes(self) -> bytes:
        return struct.pack("<qqqq", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b = struct.unpack_from("<qqqq", data, at)
        at += 32
        return cls(n, bits, np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)), at + a + b

    def _samples(self) -> np.ndarray:
        """Ones before each run of SAMPLE bytes: the select structure."""
        if self._ones is None:
            counts = np.bitwise_count(self.high).astype(np.int64)
            starts = np.arange(0, len(counts), self.SAMPLE)
            self._ones = np.concatenate([[0], np.cumsum(np.add.reduceat(counts, starts))]) if len(counts) else np.zeros(1, np.int64)
        return self._ones

    def select(self, i: int) -> int:
        """The value at place i, from the samples and one run of bytes."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        ones = self._samples()
        run = int(np.searchsorted(ones, i, side="right")) - 1
        start = run * self.SAMPLE
        bits = np.unpackbits(self.high[start : start + self.SAMPLE], bitorder="little")
        place = start * 8 + int(np.flatnonzero(bits)[i - ones[run]])
        return ((place - i) << self.low_bits) | int(self._low(i, i + 1)[0])

    def _low(self, a: int, b: int) -> np.ndarray:
        w = self.low_bits
        if not w:
            return np.zeros(b - a, np.uint64)
        first = a * w // 8
        bits = np.unpackbits(self.low[first : (b * w + 7) // 8], bitorder="little")
        bits = bits[a * w - first * 8 :][: (b - a) * w].reshape(b - a, w).astype(np.uint64)
        return (bits << np.arange(w, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def values(self) -> np.ndarray:
        """All values, in order."""
        if not self.n:
            return np.zeros(0, np.int64)
        place = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((place - np.arange(self.n)) << self.low_bits) | self._low(0, self.n).astype(np.int64)


def write_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """One block of documents in ascending doc_id order, null ids first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) for x in ids]) if ids else np.zeros(0, np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    docs = EliasFano.of(known.astype(np.uint64) - np.uint64(least & (1 << 64) - 1))
    head = MAGIC + struct.pack("<qqqqq", len(doc_ids), len(doc_ids) - len(known), least, len(flat), width)
    return head + docs.tobytes() + EliasFano.of(ends).tobytes() + flat.astype(f"<u{width}").tobytes()


class Block:
    """A block read back."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("no token block")
        self.n, self.nulls, least, self.n_tokens, width = struct.unpack_from("<qqqqq", data, len(MAGIC))
        view = memoryview(data)
        docs, at = EliasFano.read(view, len(MAGIC) + 40)
        self.ends, at = EliasFano.read(view, at)
        self.doc_ids = [None] * self.nulls + (docs.values() + least).tolist()
        self.flat = np.frombuffer(view, f"<u{width}", self.n_tokens, at)

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects."""
        return self.flat[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the block, ids) of each document."""
        start = 0
        for doc, end in zip(self.doc_ids, self.ends.values().tolist(), strict=True):
            yield doc, start, self.flat[start:end]
            start = end


class PieceEncoder:
    """The tokenizers library, asked once for each distinct pre-token; it encodes pre-tokens independently of each other."""

    def __init__(self, definition: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t for t in added if t]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4  # bytes of an id
        self.memo = PieceMemo(self.resolve, MEMO)

    def resolve(self, new: list[str]) -> list[bytes]:
        """Each piece's ids, packed: many pieces are one input, cut already, of which the library tells each id's piece."""
        out: list[bytes] = []
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            cuts = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)) * self.width).tolist()
            packed = np.array(e.ids, f"<u{self.width}").tobytes()
            out += [packed[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def packed(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of ``width`` bytes; a text with an added token's string goes to the library whole."""
        whole = {i for i, t in enumerate(texts) if any(a in t for a in self.added)}
        out = self.memo.joined(["" if i in whole else t for i, t in enumerate(texts)])
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, f"<u{self.width}").tobytes()
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return [np.frombuffer(b, f"<u{self.width}").astype("<u4").tobytes() for b in self.packed(texts)]


def _encoder(definition: str) -> PieceEncoder:
    return held(f"tokenizer {hashlib.sha256(definition.encode()).hexdigest()}", lambda: PieceEncoder(definition))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every text, append end_id, and write blocks in ascending order of id_col to a table at path.

    Texts are range-partitioned before they are encoded, so ids are computed once; nulls come first in both columns'
    sense: a null id sorts before all others, a null text is empty and leaves only end_id. Rows of equal ids all stay, in the
    order of a hash of their texts, so equal tables give equal files however their rows are dealt.
    """
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())  # grows with the vocabulary only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, encoder = TaskContext.get().partitionId(), 0, _encoder(definition.value)
        own: tuple[list, list, int] = ([], [], 0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": [shard], "block": [block], "n_docs": [len(own[0])], "n_tokens": [own[2]], "data": [write_block(*own[:2])]}, schema=fields)

        for batch in slices(batches):
            end = end_id.to_bytes(encoder.width, "little")
            for doc, packed in zip(batch.column(0).to_pylist(), encoder.packed(texts_of(batch)), strict=True):
                ids = np.frombuffer(packed + end, f"<u{encoder.width}")
                if own[0] and own[2] + len(ids) > BLOCK_IDS:
                    yield out()
                    own, block = ([], [], 0), block + 1
                own[0].append(doc)
                own[1].append(ids)
                own = (own[0], own[1], own[2] + len(ids))
        if own[0]:
            yield out()

    fields = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n, bounds = _bounds(rows)
    dealt = rows.repartitionById(n, _range_of(F.col("doc_id"), bounds)).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    dealt.mapInArrow(run, "shard int, block int, n_docs long, n_tokens long, data binary").write.parquet(path)


def _bounds(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of ranges, and the last id of each but the last: quantiles of the ids alone, so that no text is read for them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n == 1:
        return n, []
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    return n, sorted(set(found))


def _range_of(key: F.Column, bounds: list[int]) -> F.Column:
    """The range that a key falls into, by bisection; nulls are in the first one."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*map(F.lit, bounds)), len(bounds).bit_length()
    mid = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    lower = lambda s: F.coalesce(F.get(table, mid(s)) >= key, F.lit(True))
    step = lambda s, _: F.when(s["low"] >= s["high"], s).when(lower(s), F.struct(s["low"].alias("low"), mid(s).alias("high"))).otherwise(F.struct((mid(s) + 1).alias("low"), s["high"].alias("high")))
    return F.aggregate(F.array_repeat(F.lit(0), steps), F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high")), step, lambda s: s["low"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks at path with the number of ids before each: sums inside a shard, and over the shards, which are as many as write tasks."""
    blocks = spark.read.schema("shard int, block int, n_docs long, n_tokens long, data binary").parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    inside = blocks.select("shard", "block", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("inside"))
    starts = inside.join(before, "shard").select("shard", "block", (F.col("inside") + F.col("before")).alias("first"))
    few = blocks.count() <= BROADCAST_BLOCKS
    return blocks.join(F.broadcast(starts) if few else starts, ["shard", "block"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (array of int) of every document in the blocks at path."""
    return _read(spark, path, "doc_id long, start long, ids array<int>", lambda ids: ids.astype(np.int32))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) from the blocks at path."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", len, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark: SparkSession, path: str, schema: str, *of) -> DataFrame:
    from quarry.llm.common import _arrow_schema

    fields = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(Block(data.as_py()))
                columns = [[r[0] for r in rows], [first + r[1] for r in rows], *([f(r[2]) for r in rows] for f in of)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return _placed(spark, path).select("first", "data").mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write documents' ids to the shared folder and return the digests of what is read back.

    An empty table gives no rows; only doc_id and text are read, so further columns may have any names.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return read_digests(spark, path)
