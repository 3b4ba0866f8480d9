"""Operator 12: benchmark decontamination with multi-pattern search by Wu and Manber.

Test strings are windows of WINDOW consecutive words of an item (an item of fewer words is one window). The alphabet is
words: a block is three of them, hashed. The shift table says for each block how far the next possible end of a window is
from it, so most of a text is skipped, nine words or so at a time; where the shift is 0, the block's hash selects a bucket
of windows, of which those with the same hash of their first block are compared with the text byte by byte.

Many places of many texts advance at once in numpy: each text is cut into lanes of end positions. Texts are read once and
nothing is shuffled. The tables hold TABLE_BYTES of item texts at most; a larger benchmark is searched in several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _arrow_schema, held, mix64, slices
from quarry.llm.terms import Terms, terms_of

WINDOW = 10
#: Words of a block at most; end positions of a lane.
BLOCK, LANE = 3, 512
#: Bytes of item texts that one set of tables is made from; tables take about six times as much.
TABLE_BYTES = 16 << 20
_MULTIPLIERS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _blocks(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The hash of the block of ``size`` words that ends at each position."""
    out = hashes[at].copy()
    for i in range(1, size):
        out += hashes[at - i] * _MULTIPLIERS[i]
    return mix64(out)


@dataclass
class Search:
    """The tables for windows of one length over the words of all items."""

    length: int
    block: int
    bits: int
    shift: np.ndarray
    offsets: np.ndarray  # of a block's bucket
    ends: np.ndarray  # each bucket's windows by their last word
    prefixes: np.ndarray
    owners: np.ndarray

    @classmethod
    def of(cls, words: Terms, items: np.ndarray, length: int) -> Search:
        """Tables for the windows of the given items (indexes of texts in words)."""
        block = min(BLOCK, length)
        place, owner = [], []
        for i in items.tolist():
            n = int(words.starts[i + 1] - words.starts[i])
            place.append(np.arange(block - 1, n))
            owner.append(np.full(n - block + 1, i))
        place, owner = np.concatenate(place), np.concatenate(owner)
        at = words.starts[owner] + place
        bits = max(12, int(len(at) * 8).bit_length())
        keys = (_blocks(words.hashes, at, block) >> np.uint64(64 - bits)).astype(np.int64)
        shift = np.full(1 << bits, length - block + 1, np.uint8)
        np.minimum.at(shift, keys, np.maximum(length - 1 - place, 0).astype(np.uint8))
        last = place >= length - 1
        order = np.argsort(keys[last], kind="stable")
        ends = at[last][order]
        counts = np.bincount(keys[last], minlength=1 << bits)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        prefixes = _blocks(words.hashes, ends - length + block, block)
        return cls(length, block, bits, shift, offsets, ends, prefixes, owner[last][order])

    def candidates(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last words in the texts and numbers of windows whose last and first blocks agree there."""
        low, high = starts[:-1] + self.length - 1, starts[1:]
        lanes = np.maximum(-(-(high - low) // LANE), 0)
        text = np.repeat(np.arange(len(low)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = low[text] + nth * LANE
        stop = np.minimum(at + LANE, high[text])
        found, drop = [], np.uint64(64 - self.bits)
        while len(at):
            key = (_blocks(hashes, at, self.block) >> drop).astype(np.int64)
            step = self.shift[key]
            here = step == 0
            if here.any():
                found.append(np.stack([at[here], key[here]]))
            at = at + np.maximum(step, 1)
            inside = at < stop
            at, stop = at[inside], stop[inside]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, key = np.concatenate(found, axis=1)
        first, many = self.offsets[key].astype(np.int64), (self.offsets[key + 1] - self.offsets[key]).astype(np.int64)
        at = np.repeat(at, many)
        which = np.arange(len(at)) + np.repeat(first - (np.cumsum(many) - many), many)
        same = _blocks(hashes, at - self.length + self.block, self.block) == self.prefixes[which]
        return at[same], which[same]


class Benchmark:
    """The windows of some items, ready to be searched for."""

    def __init__(self, ids: list[str], texts: pa.Array) -> None:
        words = terms_of(texts)
        self.ids = ids
        self.joined, self.at = words.joined()
        lengths = np.minimum(np.diff(words.starts), WINDOW)
        self.searches = [Search.of(words, np.flatnonzero(lengths == n), n) for n in np.unique(lengths[lengths > 0]).tolist()]

    def occurrences(self, words: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word and item of every occurrence of a window."""
        out = []
        joined, at = words.joined()
        for s in self.searches:
            last, which = s.candidates(words.hashes, words.starts)
            if not len(last):
                continue
            ours, theirs = zip(at[last - s.length + 1].tolist(), at[last + 1].tolist(), strict=True), zip(self.at[s.ends[which] - s.length + 1].tolist(), self.at[s.ends[which] + 1].tolist(), strict=True)
            same = np.fromiter((joined[a:b] == self.joined[c:d] for (a, b), (c, d) in zip(ours, theirs, strict=True)), bool, len(last))
            out.append(np.stack([last[same] - s.length + 1, last[same], s.owners[which[same]]]))
        return tuple(np.concatenate(out, axis=1)) if out else (np.zeros(0, np.int64),) * 3


def benchmarks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = TABLE_BYTES) -> Iterator[Benchmark]:
    """The items in as many sets of tables as their size needs, a set on the driver at a time. Rows of one id are one item."""
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = max(1, -(-total // most))
    for k in range(sets):
        own = rows if sets == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(sets)) == k)
        table = own.toArrow()
        yield Benchmark([i if i is not None else "" for i in table.column("id").to_pylist()], table.column("text").combine_chunks())


_FOUND = "n_words long, runs array<struct<first:int,end:int>>, items array<string>"


def _merged(first: np.ndarray, end: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that intervals of word numbers cover."""
    edges = np.zeros(words + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, end, -1)
    inside = np.concatenate([[False], np.cumsum(edges)[:-1] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


def _lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """Values as a list for each of n rows; owner says whose they are, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def found_in(batch: pa.RecordBatch, searched: Benchmark) -> dict[str, pa.Array]:
    """n_words, runs and items of each text of a batch; what earlier passes found is in its columns runs and items, if any."""
    words = terms_of(batch.column("text"))
    n = batch.num_rows
    first, last, item = searched.occurrences(words)
    end = last + 1
    text = np.searchsorted(words.starts, first, side="right") - 1
    pairs = {(t, searched.ids[i]) for t, i in zip(text.tolist(), item.tolist(), strict=True)}
    if "runs" in batch.schema.names:
        earlier = batch.column("runs")
        owner = np.repeat(np.arange(n), np.diff(earlier.offsets.to_numpy()))
        inner = earlier.flatten()
        first = np.concatenate([first, words.starts[owner] + inner.field("first").to_numpy()])
        end = np.concatenate([end, words.starts[owner] + inner.field("end").to_numpy()])
        pairs |= {(t, i) for t, own in enumerate(batch.column("items").to_pylist()) for i in own}
    first, end = _merged(first, end, len(words.hashes))
    # a run of two texts is two runs
    cuts = np.searchsorted(words.starts, first, side="right"), np.searchsorted(words.starts, end, side="left")
    if (cuts[0] != cuts[1]).any():
        bounds = words.starts[(words.starts > 0) & (words.starts < len(words.hashes))]
        split = [np.unique(np.concatenate([[a], bounds[(bounds > a) & (bounds < b)], [b]])) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        first, end = np.concatenate([x[:-1] for x in split]), np.concatenate([x[1:] for x in split])
    owner = np.searchsorted(words.starts, first, side="right") - 1
    begin = words.starts[owner]
    runs = pa.StructArray.from_arrays([pa.array(first - begin, pa.int32()), pa.array(end - begin, pa.int32())], ["first", "end"])
    pairs = sorted(pairs)
    return {
        "n_words": pa.array(np.diff(words.starts), pa.int64()),
        "runs": _lists(owner, runs, n),
        "items": _lists(np.array([t for t, _ in pairs], np.int64), pa.array([i for _, i in pairs], pa.string()), n),
    }


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TABLE_BYTES) -> DataFrame:
    """id_col, n_words, runs (of hit words: first and end, from 0) and items (ids as strings, sorted) of every row.

    A null or empty text has no words. Items without words have no window; a null item id is an empty string; rows of
    one item id are one item. Equal rows have equal results, empty tables of either kind give no hits. Columns of other
    names are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sets = [spark.sparkContext.broadcast(b) for b in benchmarks(items, most=most)]
    for k, shared in enumerate(sets):
        through = k < len(sets) - 1
        schema = f"id {kind}, " + ("text string, " if through else "") + _FOUND
        rows = rows.mapInArrow(_pass(shared, through, _arrow_schema(spark, schema)), schema)
    return rows.withColumnRenamed("id", id_col)


def _pass(shared, through: bool, fields: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("decontaminate", dict)
        for batch in slices(batches):
            found = found_in(batch, shared.value)
            columns = [batch.column("id"), *([batch.column("text")] if through else []), *found.values()]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return run


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns and as often as they are there; texts are not shuffled."""
    for b in benchmarks(items):
        docs = docs.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(b), text_col), docs.schema)
    return docs


def _without(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("decontaminate", dict)
        for batch in slices(batches, text=text_col):
            found = found_in(pa.RecordBatch.from_arrays([batch.column(text_col)], ["text"]), shared.value)
            yield batch.filter(pa.array(np.diff(found["runs"].offsets.to_numpy()) == 0))

    return run


def report(docs: DataFrame, items: DataFrame, most: int = TABLE_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return contamination(docs, items, most=most).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB: the rows of report(), by all windows of all texts.
REPORT_SQL = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT *, least(len(w), {WINDOW}) AS l FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT id, l, array_to_string(w[s : s + l - 1], ' ') AS g FROM n, unnest(range(1, len(w) - l + 2)) AS u(s)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
dw AS (SELECT r, s, l, array_to_string(w[s : s + l - 1], ' ') AS g FROM d, (SELECT DISTINCT l FROM iw) AS x, unnest(range(1, greatest(len(w) - l + 2, 1))) AS u(s)),
m AS (SELECT r, s, dw.l, id FROM dw JOIN iw ON dw.l = iw.l AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + l)) AS u(p) GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON d.r = h.r LEFT JOIN k ON d.r = k.r
"""
