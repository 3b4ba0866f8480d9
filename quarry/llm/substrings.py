"""Operator 3: removal of repeated byte strings with a suffix array sorted deep-shallow.

Every window of LENGTH bytes has an anchor: the place of its smallest hash of GRAM bytes, the leftmost of equals. Equal
windows have equal anchors at equal places, so windows fall into runs that share an anchor, and runs of one anchor hash
are all that has to be compared. A run that occurs twice is repeated as a whole. Different runs of one anchor hash are
ordered by what follows the anchor and by what precedes it, read backwards: two sparse suffix arrays, each sorted by
multikey quicksort to a shallow depth and by blind tries below it, with the lengths of common prefixes. Two windows are
equal exactly if they reach equally far left of the anchor and lie in the same class of both arrays at those depths.

Stages, each dealt anew by a hash: runs of the texts, equal ones of a task sent once (``sent_runs``); equal runs by
their digest (``equal_runs``); anchor hashes with different runs (``different_runs``); the bytes of those runs, cut out
of the texts (``cut_runs``); the suffix arrays (``sorted_runs``); the spans beside their texts (``with_spans``). Runs and
spans travel as packed records of one part to a row, so Spark moves few rows. What a task holds is a part, a share of
all records that follows spark.sql.shuffle.partitions, whatever the groups are: equal runs are counted before they are
sent, and an anchor hash with more than HOT different runs is cut into single windows, which are counted like runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _arrow_schema, held, mix64, slices, stored

LENGTH, GRAM = 200, 48
SPAN = LENGTH - GRAM + 1
#: Different runs of an anchor hash beyond which it is cut into windows.
HOT = 40_000
#: Bytes that are hashed at once; a longer text goes in parts that overlap by a window. PLACE_BITS hold a place in them.
PIECE, PLACE_BITS = 1 << 18, 20
#: Runs that are sorted at once, and bytes to which multikey quicksort goes.
SORTED, SHALLOW = 40_000, 64
#: Records that a task gathers before it sends them.
FLUSH = 400_000
_rng = np.random.default_rng(20)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, x, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the windows in data, which is cut at ends: first window, last window, anchor, anchor hash of each run."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    up, down = _power_tables(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * up[:n], out=sums[1:])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    bits = np.uint64(PLACE_BITS)  # the same for every buffer: ties of the rest of a hash are leftmost everywhere
    ranked = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    # smallest in each stretch of SPAN grams: minima from block starts and to block ends
    blocks = -(-len(ranked) // SPAN)
    padded = np.full(blocks * SPAN, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    grid = padded.reshape(blocks, SPAN)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    least = np.minimum(after[:count], before[SPAN - 1 : SPAN - 1 + count])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    inside = np.ones(count, bool)  # windows that cross no cut
    for e in ends[:-1].tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    new = np.empty(count, bool)
    new[0] = True
    new[1:] = (place[1:] != place[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    if not len(first):
        return none, none, none, np.zeros(0, np.uint64)
    stops = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    return first, stops, place[first], grams[place[first]]


def runs(raw: list[bytes], piece: int = PIECE) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, text, offset in the text, first, last, anchor, hash): runs of some texts at once, places in these bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        data = b"".join(p for _, _, p in held)
        ends = np.cumsum([len(p) for _, _, p in held])
        first, last, anchor, hashes = anchors(np.frombuffer(data, np.uint8), ends)
        which = np.searchsorted(ends, first, side="right")
        starts = ends - np.array([len(p) for _, _, p in held])
        text = np.array([t for t, _, _ in held])[which] if len(first) else first
        offset = first - starts[which] + np.array([o for _, o, _ in held])[which] if len(first) else first
        return data, text, offset, first, last, anchor, hashes

    for i, whole in enumerate(raw):
        for at in range(0, max(1, len(whole) - LENGTH + 1), piece - LENGTH + 1):
            part = whole[at : at + piece]
            if len(part) < LENGTH:
                continue
            if size + len(part) > piece:
                yield out()
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield out()


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column("text").cast(pa.binary())]


#: A run: its anchor hash, its digest, its row's name (96 bits each), where its first window starts, windows, bytes before
#: the anchor, and how often it is known to occur (2: its places are told already). No text has more than 2**31 bytes.
RUN = np.dtype([("hash", "<u8"), ("d1", "<u8"), ("d2", "<u4"), ("k1", "<i8"), ("k2", "<i4"), ("start", "<u4"), ("windows", "u1"), ("anchor", "u1"), ("n", "u1")])
#: Repeated bytes of a row, end exclusive.
PLACE = np.dtype([("k1", "<i8"), ("k2", "<i4"), ("a", "<u4"), ("b", "<u4")])
#: Kinds of rows: places (before texts), texts; runs to be cut, hot anchor hashes; runs with their bytes, windows.
PLACES, TEXTS, RUNS, HOTS, BYTES, WINDOWS = range(6)
_DEALT = "part int, kind int, data binary, bytes binary"


#: Bytes of text of a part at most on average: some half of them in records.
PART_TEXT = 256 << 20


def _parts(docs: DataFrame) -> int:
    """The parts that records are dealt into: by the bytes of the texts, and as many as Spark's shuffles have at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_TEXT))


def _cut(x: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The records of each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(part[a]), x[order[a:b]]


def _rows(rows: list[tuple[int, int, bytes, bytes | None]], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 256], strict=True), fields, strict=True)], schema=fields)


def _by(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(np.ascontiguousarray(hashes)) % np.uint64(parts)).astype(np.int64)


def _places(x: np.ndarray) -> np.ndarray:
    """The places of whole runs."""
    out = np.empty(len(x), PLACE)
    out["k1"], out["k2"], out["a"] = x["k1"], x["k2"], x["start"]
    out["b"] = x["start"] + x["windows"].astype(np.uint32) + np.uint32(LENGTH - 1)
    return out


def equal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs: those that occur twice or more and whose places aren't told yet; and one of each digest, with n 1 or 2."""
    x = x[np.lexsort((x["d2"], x["d1"]))]
    new = np.concatenate([[True], (x["d1"][1:] != x["d1"][:-1]) | (x["d2"][1:] != x["d2"][:-1])]) if len(x) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n = np.add.reduceat(x["n"].astype(np.int64), first) if len(x) else first
    one = x[first]
    one["n"] = np.minimum(n, 2)
    return x[(n > 1)[np.cumsum(new) - 1] & (x["n"] == 1)], one


def _digests(data: bytes, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True))
    both = np.frombuffer(own, "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1].astype(np.uint32)


def sent_runs(docs: DataFrame, parts: int) -> DataFrame:
    """Runs of all texts dealt by digest, one of each digest of a flush; places of those that a flush has twice."""
    fields, piece, flush = _arrow_schema(docs.sparkSession, _DEALT), PIECE, FLUSH

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings", dict)
        gathered: list[np.ndarray] = []
        ones, places = _Sender(fields, parts, _to_digest, RUNS), _Sender(fields, parts, _to_text, PLACES)

        def out() -> Iterator[pa.RecordBatch]:
            whole, one = equal(np.concatenate(gathered))
            gathered.clear()
            yield from ones.put(one)
            yield from places.put(_places(whole))

        for batch in slices(batches):
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for data, text, offset, first, last, anchor, hashes in runs(_raw(batch), piece):
                x = np.zeros(len(first), RUN)
                if len(x):
                    x["hash"], x["k1"], x["k2"], x["start"], x["windows"], x["anchor"], x["n"] = hashes, k1[text], k2[text], offset, last - first + 1, anchor - first, 1
                    x["d1"], x["d2"] = _digests(data, first, last + LENGTH)
                    gathered.append(x)
                if sum(map(len, gathered)) >= flush:
                    yield from out()
        if gathered:
            yield from out()
        yield from ones.rest()
        yield from places.rest()

    return docs.select("k1", "k2", "text").mapInArrow(send, _DEALT)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[tuple[memoryview, bytes | None]]]]:
    """part, kind and its (data, bytes) of rows that are sorted by part and kind."""
    now, own = None, []
    for batch in batches:
        rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)
        for part, kind, data, more in rows:
            if (part, kind) != now:
                if own:
                    yield (*now, own)
                now, own = (part, kind), []
            own.append((data.as_buffer(), more.as_buffer() if more.is_valid else None))
    if own:
        yield (*now, own)


def _joined(own: list[tuple], dtype: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(d, dtype) for d, _ in own])


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of a part in the partition of its number."""
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


class _Sender:
    """Gathers records of a task, so that few rows leave it."""

    def __init__(self, fields: pa.Schema, parts: int, by, kind: int) -> None:
        self.fields, self.parts, self.by, self.kind = fields, parts, by, kind
        self.held: list[np.ndarray] = []

    def put(self, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(x)
        if sum(map(len, self.held)) >= FLUSH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        x = np.concatenate(self.held) if self.held else ()
        self.held = []
        if len(x):
            yield from _rows([(p, self.kind, r.tobytes(), None) for p, r in _cut(x, self.by(x, self.parts))], self.fields)


def _to_text(x: np.ndarray, parts: int) -> np.ndarray:
    return x["k1"] % parts


def _to_hash(x: np.ndarray, parts: int) -> np.ndarray:
    return _by(x["hash"], parts)


def _to_digest(x: np.ndarray, parts: int) -> np.ndarray:
    return _by(x["d1"], parts)


def equal_runs(sent: DataFrame, parts: int) -> DataFrame:
    """Runs by digest: the places of those that occur twice, and one of each digest dealt by anchor hash."""
    fields = _arrow_schema(sent.sparkSession, _DEALT)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, places = _Sender(fields, parts, _to_hash, RUNS), _Sender(fields, parts, _to_text, PLACES)
        for _, kind, own in _gathered(batches):
            if kind == PLACES:
                yield from places.put(_joined(own, PLACE))
            else:
                whole, one = equal(_joined(own, RUN))
                yield from places.put(_places(whole))
                yield from ones.put(one)
        yield from ones.rest()
        yield from places.rest()

    return _dealt(sent, parts).mapInArrow(count, _DEALT)


def different_runs(runs_: DataFrame, parts: int, hot: int) -> DataFrame:
    """The runs whose anchor hash has other runs too, dealt by text; anchor hashes with more than ``hot`` runs by themselves.

    A part goes through in pieces, of which one run of each anchor hash is remembered, so that a hot hash takes no memory.
    """
    fields = _arrow_schema(runs_.sparkSession, _DEALT)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Sender(fields, parts, _to_text, RUNS)
        for _, _, own in _gathered(batches):
            known, told, counts = np.zeros(0, RUN), np.zeros(0, bool), np.zeros(0, np.int64)
            for i in range(0, len(own), 4096):
                x = _joined(own[i : i + 4096], RUN)
                x, old = np.concatenate([known, x]), np.concatenate([told, np.zeros(len(x), bool)])
                n = np.concatenate([counts, np.ones(len(x) - len(known), np.int64)])
                order = np.argsort(x["hash"], kind="stable")
                x, old, n = x[order], old[order], n[order]
                new = np.concatenate([[True], x["hash"][1:] != x["hash"][:-1]])
                first = np.flatnonzero(new)
                sums = np.add.reduceat(n, first)
                several = (sums > 1)[np.cumsum(new) - 1]
                yield from wanted.put(x[several & ~old])
                known, told, counts = x[first], sums > 1, sums
            most = known["hash"][counts > hot]
            if len(most):
                yield from _rows([(0, HOTS, np.ascontiguousarray(most).tobytes(), None)], fields)
        yield from wanted.rest()

    return _dealt(runs_, parts).mapInArrow(keep, _DEALT)


def _beside(docs: DataFrame, records: DataFrame, parts: int) -> DataFrame:
    """Records and texts of a part together, records first: part, kind, data, k1, k2, doc_id, text."""
    kind = docs.schema["doc_id"].dataType
    texts = docs.select(F.pmod("k1", F.lit(parts)).cast("int").alias("part"), F.lit(TEXTS).alias("kind"), F.lit(None).cast("binary").alias("data"), "k1", "k2", "doc_id", "text")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("k1", "long"), ("k2", "int"), ("doc_id", kind), ("text", "string"))]
    return _dealt(texts.unionByName(records.select("part", F.lit(PLACES).alias("kind"), "data", *none)), parts)


def _met(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of texts with the records of each."""
    now, got, records = None, [], None
    for batch in batches:
        part, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]), [True]])).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if part[a] != now:
                now, got, records = part[a], [], None
            if kind[a] == PLACES:
                got += [np.frombuffer(x.as_buffer(), dtype).copy() for x in batch.column(2).slice(a, b - a)]
                continue
            if records is None:
                records = np.concatenate(got) if got else np.zeros(0, dtype)
                records = records[np.argsort(records["k1"], kind="stable")]
                names, got = np.ascontiguousarray(records["k1"]), []
            for one in slices(iter([batch.slice(a, b - a)])):
                k1, k2 = one.column(3).to_numpy(), one.column(4).to_numpy()
                low, high = np.searchsorted(names, k1), np.searchsorted(names, k1, side="right")
                yield one, [(own := records[i:j])[own["k2"] == k] if j > i else records[:0] for i, j, k in zip(low.tolist(), high.tolist(), k2, strict=True)]


def cut_runs(docs: DataFrame, wanted: DataFrame, hot, parts: int) -> DataFrame:
    """Runs with their bytes, dealt by anchor hash; runs of hot anchor hashes as single windows, dealt by digest."""
    fields = _arrow_schema(docs.sparkSession, _DEALT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings", dict)
        done: set[tuple[int, int]] = set()
        gathered, blobs, windows, size = [], [], [], 0
        for batch, found in _met(batches, RUN):
            for raw, own, k1, k2 in zip(_raw(batch), found, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if not len(own) or (k1, k2) in done:
                    continue
                done.add((k1, k2))  # a repeated row's runs are cut once; these are the names of one task's texts
                cut_up = np.isin(own["hash"], hot.value)
                for r in own[cut_up]:
                    x = np.zeros(int(r["windows"]), RUN)
                    begin = int(r["start"]) + np.arange(len(x), dtype=np.int64)
                    x["k1"], x["k2"], x["start"], x["windows"], x["n"] = k1, k2, begin, 1, r["n"]
                    x["d1"], x["d2"] = _digests(raw, begin, begin + LENGTH)
                    windows.append(x)
                    size += 50 * len(x)
                own = own[~cut_up]
                for a, w in zip(own["start"].tolist(), own["windows"].tolist(), strict=True):
                    blobs.append(raw[a : a + w + LENGTH - 1])
                    size += 400
                gathered.append(own)
                if size > 24 << 20:
                    yield from out(gathered, blobs, windows)
                    gathered, blobs, windows, size = [], [], [], 0
        yield from out(gathered, blobs, windows)

    def out(gathered: list[np.ndarray], blobs: list[bytes], windows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = []
        if blobs:
            x = np.concatenate(gathered)
            for p, at in _cut(np.arange(len(x)), _by(x["hash"], parts)):
                rows.append((p, BYTES, x[at].tobytes(), b"".join(blobs[i] for i in at.tolist())))
        if windows:
            x = np.concatenate(windows)
            whole, one = equal(x)
            rows += [(p, PLACES, r.tobytes(), None) for p, r in _cut(_places(whole), _to_text(whole, parts))]
            rows += [(p, WINDOWS, r.tobytes(), None) for p, r in _cut(one, _to_digest(one, parts))]
        if rows:
            yield from _rows(rows, fields)

    return _beside(docs, wanted, parts).mapInArrow(cut, _DEALT)


class BlindTrie:
    """A trie over strings of one length that keeps only branching depths; a string is compared with one other when inserted."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: int | list = 0  # a leaf is a number of a string; a node is [depth, {byte: child}, a leaf below]
        self.same: dict[int, list[int]] = {}
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node = self.strings[i], self.root
        while isinstance(node, list):  # down blindly, by branching bytes only
            node = node[1].get(s[node[0]], node[2])
        depth = common_prefix(s, self.strings[node])
        if depth == len(s):
            self.same.setdefault(node, []).append(i)
            return
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][s[depth]] = i
            return
        leaf = node[2] if isinstance(node, list) else node
        new = [depth, {s[depth]: i, self.strings[leaf][depth]: node}, leaf]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def order(self) -> tuple[list[int], list[int]]:
        """The strings' numbers in order, and the common prefix of each with the one before (0 for the first)."""
        out: list[int] = []
        common: list[int] = []
        stack: list[tuple[int | list, int]] = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, list):
                children = [node[1][c] for c in sorted(node[1])]
                stack += [(c, node[0] if j else depth) for j, c in reversed(list(enumerate(children)))]
            else:
                for j, k in enumerate([node, *self.same.get(node, ())]):
                    out.append(k)
                    common.append(len(self.strings[k]) if j else depth)
        return out, common


def common_prefix(a: bytes, b: bytes) -> int:
    """Bytes that two strings of one length have in common at their beginning."""
    different = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return len(a) - (different.bit_length() + 7) // 8


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of strings (bytes, one length) inside each group, and common prefixes with the row before; -1 between groups.

    Multikey quicksort, eight bytes a step and all parts at once, goes to SHALLOW bytes; parts that are still together
    then are ordered by a blind trie each.
    """
    n, width = strings.shape
    words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    common = np.full(n, -1, np.int64)
    part = np.cumsum(np.concatenate([[0], (np.diff(group[order]) != 0).astype(np.int64)])) if n else group
    for step in range(min(SHALLOW, width) // 8):
        sizes = np.bincount(part)
        open_ = np.flatnonzero(sizes[part] > 1)
        if not len(open_):
            break
        keys = words[order[open_], step]
        by = np.lexsort((keys, part[open_]))
        order[open_] = order[open_][by]
        keys = keys[by]
        differs = (keys[1:] != keys[:-1]) & (part[open_][1:] == part[open_][:-1]) & (np.diff(open_) == 1)
        at = open_[1:][differs]
        x = keys[1:][differs] ^ keys[:-1][differs]
        lead = np.zeros(len(x), np.int64)
        for k in range(1, 8):  # bytes of the two words that agree
            lead += (x >> np.uint64(64 - 8 * k)) == 0
        common[at] = 8 * step + lead
        new = np.zeros(n, np.int64)
        new[at] = 1
        new[1:] |= np.diff(part) != 0
        part = np.cumsum(new)
    bounds = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0, [True]])) if n else []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            own, lcp = BlindTrie([strings[i].tobytes() for i in order[a:b]]).order()
            order[a:b] = order[a:b][own]
            common[a + 1 : b] = lcp[1:]
    return order, common


def repeated_windows(group: np.ndarray, weight: np.ndarray, anchor: np.ndarray, data: list[bytes]) -> list[np.ndarray]:
    """For each run which of its windows occur twice or more among the runs of its group, weights counted."""
    n = len(data)
    right, left = np.zeros((n, LENGTH), np.uint8), np.zeros((n, LENGTH), np.uint8)
    for i, (m, d) in enumerate(zip(anchor.tolist(), data, strict=True)):
        x = np.frombuffer(d, np.uint8)
        right[i, : min(LENGTH, len(x) - m)] = x[m : m + LENGTH]
        left[i, :m] = x[:m][::-1]
    windows = np.array([len(d) for d in data]) - LENGTH + 1
    ranks = []
    for side in (right, left):
        order, common = deep_shallow(group, side)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        ranks.append((common, place))
    out = [np.zeros(w, bool) for w in windows.tolist()]
    for reach in range(SPAN):  # bytes that a window has left of the anchor
        own = np.flatnonzero((reach <= anchor) & (anchor - reach < windows))
        if not len(own):
            continue
        (common, place), (common_left, place_left) = ranks
        a = np.cumsum(common < LENGTH - reach)[place[own]]
        b = np.cumsum(common_left < reach)[place_left[own]]
        _, back = np.unique(a * (n + 1) + b, return_inverse=True)
        twice = np.bincount(back, weights=weight[own]) > 1
        for i in own[twice[back]].tolist():
            out[i][anchor[i] - reach] = True
    return out


def sorted_runs(cut: DataFrame, parts: int) -> DataFrame:
    """Places of repeated bytes from the suffix arrays of runs that occur once, and of windows of hot anchor hashes."""
    fields = _arrow_schema(cut.sparkSession, _DEALT)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Sender(fields, parts, _to_text, PLACES)
        for _, kind, own in _gathered(batches):
            if kind == PLACES:
                yield from places.put(_joined(own, PLACE))
            elif kind == WINDOWS:
                yield from places.put(_places(equal(_joined(own, RUN))[0]))
            else:
                x = _joined(own, RUN)
                order = np.argsort(x["hash"], kind="stable")
                sizes = x["windows"].astype(np.int64) + (LENGTH - 1)
                ends = np.cumsum(sizes)
                data = b"".join(b.to_pybytes() for _, b in own)
                edges = np.flatnonzero(np.concatenate([[True], x["hash"][order][1:] != x["hash"][order][:-1], [True]])).tolist()
                a = 0
                while a < len(edges) - 1:  # whole groups, about SORTED runs at once
                    b = a + 1
                    while b < len(edges) - 1 and edges[b + 1] - edges[a] <= SORTED:
                        b += 1
                    which = order[edges[a] : edges[b]]
                    group = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
                    yield from places.put(told(x[which], group, [data[e - z : e] for e, z in zip(ends[which].tolist(), sizes[which].tolist(), strict=True)]))
                    a = b
        yield from places.rest()

    def told(x: np.ndarray, group: np.ndarray, data: list[bytes]) -> np.ndarray:
        out = []
        for r, w in zip(x, repeated_windows(group, x["n"].astype(np.int64), x["anchor"].astype(np.int64), data), strict=True):
            if r["n"] == 1 and w.any():  # other runs are repeated as a whole
                edges = np.flatnonzero(np.diff(np.concatenate([[0], w.astype(np.int8), [0]])))
                start = int(r["start"])
                out += [(r["k1"], r["k2"], start + i, start + j + LENGTH - 1) for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        return np.array(out, PLACE)

    return _dealt(cut, parts).mapInArrow(sort, _DEALT)


def with_spans(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(batch of doc_id and text, raw bytes, maximal spans of repeated bytes of each text) as a batch, over docs (doc_id, text, k1, k2)."""
    spark = docs.sparkSession
    parts = _parts(docs)
    files = max(1, parts // 4)  # a task takes its parts one after another; few files are better than many small ones
    runs_ = stored(equal_runs(sent_runs(docs, parts), parts).coalesce(files), "runs")
    wanted = stored(different_runs(runs_.filter(F.col("kind") == RUNS), parts, HOT).coalesce(files), "wanted")
    most = [np.frombuffer(r["data"], "<u8") for r in wanted.filter(F.col("kind") == HOTS).select("data").collect()]
    hot = spark.sparkContext.broadcast(np.concatenate([np.zeros(0, "<u8"), *most]))  # one hash for HOT different runs at most
    known = sorted_runs(cut_runs(docs.filter(F.octet_length("text") >= LENGTH), wanted.filter(F.col("kind") == RUNS), hot, parts), parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("substrings", dict)
        for batch, found in _met(batches, PLACE):
            yield make(batch.select(["doc_id", "text"]), _raw(batch), [merged(x) for x in found])

    return _beside(docs, runs_.filter(F.col("kind") == PLACES).unionByName(known), parts).mapInArrow(merge, schema)


def merged(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in any of the places."""
    if not len(places):
        return []
    a, order = np.sort(places["a"]), np.argsort(places["a"], kind="stable")
    ends = np.maximum.accumulate(places["b"][order])
    first = np.flatnonzero(np.concatenate([[True], a[1:] > ends[:-1]]))
    return list(zip(a[first].tolist(), ends[np.concatenate([first[1:] - 1, [len(a) - 1]])].tolist(), strict=True))


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def named(docs: DataFrame) -> DataFrame:
    """doc_id and text with two hashes that name a row; equal rows have equal names and equal results."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.hash(F.lit(3), "text", "doc_id").alias("k2"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty; a text shorter than LENGTH bytes has nothing to remove; an occurrence in a repeated row counts
    like any other; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    fields = _arrow_schema(docs.sparkSession, schema)

    def cut(batch: pa.RecordBatch, raws: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        rows = []
        for doc, raw, own in zip(batch.column(0).to_pylist(), raws, spans, strict=True):
            left = kept(raw, own)
            rows.append((doc, len(raw), len(raw) - len(left), len(own), hashlib.sha256(left).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return with_spans(named(docs), cut, schema)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id and text without repeated strings; bytes of characters that were cut in two are dropped. Rows and nulls as in report."""

    def cut(batch: pa.RecordBatch, raws: list[bytes], spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        left = [kept(raw, own).decode(errors="ignore") for raw, own in zip(raws, spans, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=["doc_id", "text"])

    return with_spans(named(docs), cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")
