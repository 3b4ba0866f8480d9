"""An index of trigrams over texts: literal, regular-expression and lexical searches read only texts that can match.

Texts are dealt into folders of some FOLDER_BYTES and numbered inside each. For every three bytes that follow each other
in a lower-case text, a folder has the numbers of its texts with them, as differences of variable length. A pattern is
reduced to a formula of trigrams that any match must satisfy; folders evaluate it on their own postings, and the texts
whose numbers come out are read and tested by the pattern itself, so results are those of a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import lexical
from quarry.operators.graph import written

FOLDER_BYTES = 32 << 20
#: Groups that trigrams are written by; strings that a part of a pattern may stand for at once; candidates that are broadcast (16 bytes each).
BUCKETS, MOST_STRINGS, BROADCAST = 64, 16, 100_000
_FOLDER, _N = "__folder", "__n"
#: Ways of writing that Java and Python read differently: such a pattern is not reduced.
_DIFFERENT = re.compile(r"\\[vhHRXGpPQEkNuxc0-9]|&&|\(\?[^:=!<)imsx]|\[\^?\]|\[[^\]]*\[")

# Formulas: True, or ("and" | "or", parts), or the first and last of a range of trigrams.


def code(three: bytes) -> int:
    return three[0] << 16 | three[1] << 8 | three[2]


def both(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def either(parts: list) -> object:
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", parts)


def of_literal(literal: str) -> object:
    """What texts with a literal satisfy: its ASCII pieces' trigrams; a piece of two letters is any trigram that begins with them."""
    out = []
    for piece in re.findall(r"[\x00-\x7f]+", literal):
        b = piece.lower().encode()
        out += [(code(b[i : i + 3]),) * 2 for i in range(len(b) - 2)]
        if len(b) == 2:
            out.append((code(b + b"\0"), code(b + b"\xff")))
    return both(out)


def of_pattern(pattern: str) -> object:
    """What texts with a match satisfy; True, which all do, for patterns that can't be reduced."""
    if _DIFFERENT.search(pattern):
        return True
    try:
        strings, formula = _sequence(P.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return True
    return both([formula, _any_of(strings)])


def _any_of(strings: set[str]) -> object:
    return either([of_literal(s) for s in sorted(strings)])


def _sequence(parsed) -> tuple[set[str], object]:
    """The strings that a sequence ends in, all of them, and what holds besides. Strings grow while parts are exact."""
    run, held = {""}, []
    for op, arg in parsed:
        strings, formula, exact = _part(op, arg)
        if exact and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:  # what came before stands alone
            held += [_any_of(run), formula]
            run = {""}
            if exact:
                held.append(_any_of(strings))
    return run, both(held)


def _part(op, arg) -> tuple[set[str], object, bool]:
    """strings, formula and whether the part is one of the strings and nothing else."""
    if op is C.LITERAL:
        return {chr(arg)}, True, True
    if op is C.IN and all(kind in (C.LITERAL, C.RANGE) for kind, _ in arg):
        chosen = [x for kind, a in arg for x in ([a] if kind is C.LITERAL else range(a[0], min(a[1], a[0] + MOST_STRINGS) + 1))]
        if len(chosen) <= MOST_STRINGS:
            return set(map(chr, chosen)), True, True
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, True, True
    if op is C.SUBPATTERN:
        return _inner(arg[-1])
    if op is C.ATOMIC_GROUP:
        return _inner(arg)
    if op is C.BRANCH:
        found = [_inner(x) for x in arg[1]]
        if all(exact for *_, exact in found) and sum(len(s) for s, *_ in found) <= MOST_STRINGS:
            return set().union(*(s for s, *_ in found)), True, True
        return set(), either([both([f, _any_of(s)]) if exact else f for s, f, exact in found]), False
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, inner = arg
        strings, formula, exact = _inner(inner)
        if exact and least == most == 1:
            return strings, True, True
        return set(), True if least == 0 else both([formula, _any_of(strings)]) if exact else formula, False
    return set(), True, False


def _inner(parsed) -> tuple[set[str], object, bool]:
    strings, formula = _sequence(parsed)
    if formula is True and _only_strings(parsed):
        return strings, True, True
    return set(), both([formula, _any_of(strings)]), False


def _only_strings(parsed) -> bool:
    """Whether a sequence is made of exact parts alone, few enough to be kept together."""
    size = 1
    for op, arg in parsed:
        strings, _, exact = _part(op, arg)
        size *= max(len(strings), 1)
        if not exact or size > MOST_STRINGS:
            return False
    return True


def ranges(formula) -> set[tuple[int, int]]:
    """The trigrams of a formula."""
    if formula is True:
        return set()
    return {formula} if isinstance(formula[0], int) else set().union(*map(ranges, formula[1]))


def satisfied(formula, postings: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The numbers that satisfy a formula, ascending."""
    if isinstance(formula[0], int):
        return postings.get(formula, np.zeros(0, np.int64))
    found = [satisfied(p, postings) for p in formula[1]]
    out = found[0]
    for x in found[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if formula[0] == "and" else np.union1d(out, x)
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers as differences, seven bits a byte, the last byte of each with the high bit."""
    gaps = np.diff(numbers, prepend=-1).astype(np.uint64)
    size = np.ceil(np.log2(gaps.astype(float) + 1) / 7).astype(np.int64)
    out = np.zeros(int(size.sum()), np.uint8)
    end = np.cumsum(size) - 1
    for k in range(int(size.max(initial=0))):
        own = size > k
        out[end[own] - k] = ((gaps[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | (128 if k == 0 else 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b & 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    back = np.repeat(ends, ends - starts + 1) - np.arange(len(b))
    values = (b & 127).astype(np.int64) << (7 * back)
    return np.cumsum(np.add.reduceat(values, starts)) - 1 if len(ends) else np.zeros(0, np.int64)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Place of the text and trigram, each pair once. Two zero bytes end a text, so that its last two bytes begin a trigram."""
    raw = [(t or "").lower().encode() + b"\0\0" for t in texts]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    inside = owner[:-2] == owner[2:]
    keys = np.unique((owner[:-2] << 24 | b[:-2] << 16 | b[1:-1] << 8 | b[2:])[inside])
    return keys >> 24, keys & 0xFFFFFF


class TrigramIndex:
    """The index in a folder; its columns are those of the table it was made from."""

    def __init__(self, spark: SparkSession, path: str, text: str = "text") -> None:
        self.spark, self.path, self.text = spark, path.rstrip("/"), text

    @classmethod
    def build(cls, df: DataFrame, path: str, text: str = "text", key: str = "doc_id", folder_bytes: int = FOLDER_BYTES) -> TrigramIndex:
        """Write df's rows in folders, then each folder's postings; a null text has none. A folder's numbers are in one task. A table without rows is a ValueError."""
        path = path.rstrip("/")
        n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
        if not n:
            raise ValueError("there are no texts to index")
        folders = max(1, -(-size // folder_bytes))
        dealt = df.withColumn(_FOLDER, F.pmod(F.xxhash64(key, text), F.lit(folders)).cast("int"))
        dealt = dealt.repartitionById(folders, F.col(_FOLDER)).sortWithinPartitions(_FOLDER, key)
        numbered = dealt.withColumn(_N, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        numbered.write.partitionBy(_FOLDER).option("parquet.block.size", 1 << 20).parquet(f"{path}/texts")
        schema = "folder int, trigram int, n int, bucket int, postings binary"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, list] = {}
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    folder, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                    owner, three = trigrams(part.column(2).to_pylist())
                    for f in np.unique(folder).tolist():
                        own = folder[owner] == f
                        held.setdefault(f, []).append(np.stack([three[own], n[owner[own]]]))
            for f, found in held.items():
                three, n = np.concatenate(found, axis=1)
                order = np.lexsort((n, three))
                three, n = three[order], n[order]
                edges = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1], [True]])) if len(three) else np.zeros(1, np.int64)
                for at in range(0, len(edges) - 1, 4096):
                    cut = edges[at : at + 4097]
                    first = three[cut[:-1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), f, np.int32)), pa.array(first.astype(np.int32)), pa.array(np.diff(cut).astype(np.int32)), pa.array(((first >> 8) % BUCKETS).astype(np.int32)), pa.array([packed(n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["folder", "trigram", "n", "bucket", "postings"])

        texts = df.sparkSession.read.parquet(f"{path}/texts").select(_FOLDER, _N, text).repartitionById(folders, F.col(_FOLDER))
        found = texts.mapInArrow(run, schema)
        found.repartition(F.col("bucket")).sortWithinPartitions("bucket", "trigram", "folder").write.partitionBy("bucket").parquet(f"{path}/postings")
        return cls(df.sparkSession, path, text)

    def candidates(self, formula) -> DataFrame | None:
        """__folder, __n of the texts that satisfy a formula; None for all."""
        wanted = sorted(ranges(formula))
        if not wanted:
            return None
        buckets = sorted({(a >> 8) % BUCKETS for a, _ in wanted})  # a range has one begin of two bytes, so one bucket
        test = F.lit(False)
        for a, b in wanted:
            test = test | F.col("trigram").between(a, b)
        read = self.spark.read.parquet(f"{self.path}/postings").filter(F.col("bucket").isin(buckets) & test)
        schema = f"{_FOLDER} int, {_N} long"

        def run(key: tuple, table: pa.Table) -> pa.Table:
            by: dict[tuple[int, int], list] = {}
            for three, data in zip(table.column("trigram").to_pylist(), table.column("postings").to_pylist(), strict=True):
                own = unpacked(data)
                for a, b in wanted:
                    if a <= three <= b:
                        by.setdefault((a, b), []).append(own)
            n = satisfied(formula, {r: np.unique(np.concatenate(x)) for r, x in by.items()})
            return pa.table({_FOLDER: pa.array([key[0].as_py()] * len(n), pa.int32()), _N: pa.array(n, pa.int64())})

        return read.select("folder", "trigram", "postings").groupBy("folder").applyInArrow(run, schema)

    def rows(self, formula) -> DataFrame:
        """The rows whose texts satisfy a formula, with the columns of the table; other folders are not read."""
        texts = self.spark.read.parquet(f"{self.path}/texts")
        found = self.candidates(formula)
        if found is None:
            return texts.drop(_FOLDER, _N)
        found = written(found)
        counts = found.groupBy(_FOLDER).agg(F.count("*").alias("n"), F.min(_N).alias("low"), F.max(_N).alias("high")).limit(BROADCAST).collect()
        if len(counts) < BROADCAST:
            texts = texts.filter(F.col(_FOLDER).isin([r[0] for r in counts]))
            if counts:  # skips row groups
                texts = texts.filter(F.col(_N).between(min(r.low for r in counts), max(r.high for r in counts)))
        few = len(counts) < BROADCAST and sum(r.n for r in counts) <= BROADCAST
        return texts.join(F.broadcast(found) if few else found, [_FOLDER, _N], "left_semi").drop(_FOLDER, _N)

    def grep(self, pattern: str, keys: list[str], fixed: bool = False, ignore_case: bool = False) -> DataFrame:
        """lexical.grep of the whole table, over the texts that can match."""
        formula = of_literal(pattern) if fixed else of_pattern(pattern)
        return lexical.grep(self.rows(formula), pattern, keys, self.text, fixed, ignore_case)

    def retrieve(self, query: str, k: int = 50, path: str = "file", key: str = "chunk_id") -> DataFrame:
        """lexical.retrieve of the whole table, over the texts that have any of the query's tokens."""
        tokens = [t for t in T.query_tokens(query) if len(t) >= 2][:12]
        return lexical.retrieve(self.rows(either([of_literal(t) for t in tokens])), query, k, self.text, None, path, key)
