"""Operator 5: n-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word shingles columns of a sparse incidence matrix. Only the columns are multiplied that a
pair at or over the bound must share: a document's shingles are ordered (common ones last, then by hash) and the first
|x| - ceil(t |x|) + 1 of them enter the product. Columns are dealt out in blocks; each block adds overlap counts of
pairs of documents, the counts are summed, and pairs are discarded whose count plus what can still follow stays below
the overlap that both sizes demand. Those that are left are verified on their whole sets.

Exact copies are one row of the matrix. Near copies are contracted before the product: documents with the same
smallest shingle meet once and join the first pivot that they are verified to link with; pairs inside one contracted
group need no further look, since only components are returned, so a group of n copies costs n
comparisons instead of n**2. Pairs of different groups are all examined by the product: the result is exact, up to
collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _arrow_schema, held, mix64, slices, stored, texts_of
from quarry.llm.components import components
from quarry.llm.words import hash_words

SHINGLE, PERCENT = 5, 75
#: Cells of the table of column counts that orders the shingles: 8 MB a task, whatever the corpus. It never decides a pair.
CELLS, CELL_BLOCK = 1 << 22, 1 << 13
#: Pivots that a document is compared with where documents meet; documents of one key, over all tasks, that a salt gets,
#: and cells of the table that counts them. Tasks from which copies of one set meet.
PIVOTS, SALT_AFTER, FIRST_CELLS, TASKS = 32, 256, 1 << 18, 256
#: Pair counts that a block of columns gathers before it adds them up, and rows of one column multiplied at once.
PAIRS, TILE = 2_000_000, 1024
#: Rows of one column in a task of the product, and in a task that looks for shared columns; longer columns are dealt out.
COLUMN, HOT_COLUMN = 4096, 1_000_000
#: Percent of the smaller set that a pair must at least share in the multiplied columns, where these are enough.
AMONG = 2
#: Documents to verify up to this number are found by a broadcast of their ids (8 bytes each), more by a shuffled join.
BROADCAST_IDS = 300_000


_ONE = np.ones(1, bool)


def shingles(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a text of fewer words has one shingle of them all, one without words none."""
    hashes, starts = hash_words(texts, lower=True)
    rolled = np.zeros(0, np.uint64)
    if len(hashes) >= width:
        rolled = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            rolled *= np.uint64(0xD6E8FEB86659FD93)
            rolled += hashes[k : len(hashes) - width + 1 + k]
        rolled = mix64(rolled)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.concatenate([_ONE, own[1:] != own[:-1]])])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())], np.uint64))
        else:
            out.append(rolled[:0])
    return out


def signature(own: np.ndarray) -> int:
    """A set's name: a 64-bit hash as a signed long."""
    return xxhash.xxh3_64_intdigest(own.tobytes(), seed=1) - (1 << 63)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets reach the bound, in integers."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(large.searchsorted(small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def column_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have a shingle of each cell, and documents whose smallest shingle falls in each of FIRST_CELLS cells,
    over all documents; exact copies inside a task count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", dict)
        cells, seen = np.zeros(CELLS + FIRST_CELLS, np.uint32), set()
        for batch in slices(batches):
            sets = [s for s in shingles(texts_of(batch)) if len(s)]
            fresh = []
            for s in sets:
                if (name := signature(s)) not in seen:
                    seen.add(name)
                    fresh.append(s)
            if fresh:
                cells[:CELLS] += np.bincount((np.concatenate(fresh) >> np.uint64(42)).astype(np.int64), minlength=CELLS).astype(np.uint32)
                cells[CELLS:] += np.bincount(first_cell(np.array([s[0] for s in fresh], np.uint64)), minlength=FIRST_CELLS).astype(np.uint32)
        blocks = cells.reshape(-1, CELL_BLOCK)
        some = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.minimum(blocks[i], 65535).astype(np.uint16).tobytes() for i in some], pa.binary())], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(data.as_buffer(), np.uint16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], names=["block", "cells"])

    schema = "block int, cells binary"
    out = np.zeros(((CELLS + FIRST_CELLS) // CELL_BLOCK, CELL_BLOCK), np.int64)
    for r in docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():  # CELLS + FIRST_CELLS numbers
        out[r["block"]] += np.frombuffer(r["cells"], np.uint32)
    return out.ravel()[:CELLS], out.ravel()[CELLS:]


def first_cell(first: np.ndarray) -> np.ndarray:
    """The cell of a smallest shingle; these crowd at small hashes, so they are mixed again."""
    return (mix64(first) >> np.uint64(64 - FIRST_CELLS.bit_length() + 1)).astype(np.int64)


def salts(counts: np.ndarray, after: int) -> np.ndarray:
    """Into how many parts the documents of each cell of smallest shingles go: one for ``after`` documents over the mean."""
    return (1 + np.maximum(counts - 2 * counts.mean(), 0) // after).astype(np.uint64)


def common_cells(counts: np.ndarray) -> np.ndarray:
    """Cells whose count stands out: they hold a common shingle and come last in the order."""
    mean = counts.mean()
    return counts > mean + 6 * np.sqrt(mean) + 32


def ordered(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in the order of the product: the top bit tells common shingles, the rest is the hash."""
    late = common[(own >> np.uint64(42)).astype(np.int64)]
    return np.sort((own >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63)))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Columns of a set of n that enter the product."""
    return n - -(-percent * n // 100) + 1


_MET = "doc_id long, n long, sig long, star long, star_n long, columns array<long>"


def met(docs: DataFrame, common, parts, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n and sig; for one document of each set, as far as copies meet, also its pivot
    (star), the pivot's size and the columns that enter the product.

    Texts go once to where the documents with the same smallest shingle are, those with the fewest uncommon shingles
    first, since they make the best pivots. Copies that a task has seen before go without
    text and anywhere. A shingle of a cell that has many documents, over all tasks, is salted by the set's name and by
    the task, TASKS of them together, so that neither near copies nor copies of one set crowd in one place.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", dict)
        seen: set[int] = set()
        near = TaskContext.get().partitionId() // TASKS
        for batch in slices(batches):
            texts = texts_of(batch)
            rows = []
            for doc, text, own in zip(batch.column(0).to_pylist(), texts, shingles(texts), strict=True):
                sig = signature(own) if len(own) else 0
                if not len(own) or doc is None or sig in seen:
                    rows.append((mix_key(doc), 0, doc, len(own), sig, None))
                    continue
                seen.add(sig)
                order = ordered(own, common.value)
                n = parts.value[first_cell(own[:1])[0]]
                salt = mix64(np.array([sig + near], np.int64).view(np.uint64)) % n if n > 1 else 0
                light = int((order < np.uint64(1 << 63)).sum())
                rows.append((int(mix64(own[:1] + salt)[0] >> np.uint64(1)), light, doc, len(own), sig, text))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)

    def mix_key(doc: int | None) -> int:
        return xxhash.xxh3_64_intdigest(str(doc)) >> 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", dict)
        key, pivots, done = None, [], set()
        for batch in slices(batches):
            rows = []
            keys, texts = batch.column(0).to_pylist(), batch.column(5).to_pylist()
            full = [i for i, t in enumerate(texts) if t is not None]
            sets = dict(zip(full, shingles([texts[i] for i in full]), strict=True))
            for i, (k, doc, n, sig) in enumerate(zip(keys, *(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                if k != key:
                    key, pivots, done = k, [], set()
                if i not in sets or sig in done:
                    rows.append((doc, n, sig, None, None, None))
                    continue
                own = sets[i]
                done.add(sig)
                star = next((p for p in pivots if linked(p[1], own, percent)), None)
                if star is None:
                    star = (sig, own)
                    if len(pivots) < PIVOTS:
                        pivots.append(star)
                columns = ordered(own, common.value)[: prefix_length(n, percent)].astype(np.int64)
                rows.append((doc, n, sig, star[0], len(star[1]), columns))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    spark = docs.sparkSession
    sending = "key long, light long, doc_id long, n long, sig long, text string"
    sent, out = _arrow_schema(spark, sending), _arrow_schema(spark, _MET)
    return docs.mapInArrow(send, sending).repartition("key").sortWithinPartitions("key", "light", "sig").mapInArrow(meet, _MET)


def shared_columns(rows: DataFrame, counts: np.ndarray | None = None) -> DataFrame:
    """The incidence (o, sig, star, at) of columns that more than one pivot's group has; at is the set's size and the
    column's place in it, packed. rows: sig, star, n, columns in order. counts: documents by cell; columns of a cell with
    very many are dealt out by the set and all kept, since no task sees a whole one."""
    schema = "o long, sig long, star long, at long"
    spark = rows.sparkSession
    fields = _arrow_schema(spark, schema)
    hold = 4096
    hot = np.zeros(0, np.int64) if counts is None else np.flatnonzero(counts > max(HOT_COLUMN, 8 * counts.mean()))  # CELLS / 8 at most

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A column's rows are held until a second group shows; once more than ``hold`` are, they go on as they are."""
        held("jaccard", dict)
        tail: np.ndarray | None = None
        going = None  # a column whose rows go on at once
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], 1)
            if len(hot):
                dealt_out = np.isin(_cell(x[:, 0]), hot)
                if dealt_out.any():
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in x[dealt_out].T], schema=fields)
                    x = x[~dealt_out]
            if tail is not None and len(tail):
                x = np.concatenate([tail, x])
            bounds = np.flatnonzero(np.diff(x[:, 0])) + 1
            last = int(bounds[-1]) if len(bounds) else 0
            complete, tail = x[:last], x[last:]
            if len(complete):
                edges = np.concatenate([[0], np.flatnonzero(np.diff(complete[:, 0])) + 1])
                several = np.maximum.reduceat(complete[:, 2], edges) != np.minimum.reduceat(complete[:, 2], edges)
                if going is not None and complete[0, 0] == going:
                    several[0] = True
                chosen = complete[np.repeat(several, np.diff(np.concatenate([edges, [len(complete)]])))]
                if len(chosen):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in chosen.T], schema=fields)
            if len(tail) and (tail[0, 0] == going or len(tail) > hold):
                going = tail[0, 0]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in tail.T], schema=fields)
                tail = tail[:0]
        if tail is not None and len(tail) and (tail[0, 0] == going or tail[:, 2].min() != tail[:, 2].max()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in tail.T], schema=fields)

    at = F.shiftleft("n", 32) + F.col("pos").cast("long")
    spread = rows.select(F.posexplode("columns").alias("pos", "o"), "sig", "star", "n").select("o", "sig", "star", at.alias("at"))
    if len(hot):
        table = spark.createDataFrame([(int(c), int(counts[c] // HOT_COLUMN) + 1) for c in hot], "cell long, parts long")
        cell = F.shiftrightunsigned("o", 63 - CELLS.bit_length() + 1).bitwiseAND(F.lit(CELLS - 1))
        spread = spread.join(F.broadcast(table), cell == F.col("cell"), "left").withColumn("part", F.coalesce(F.pmod("sig", "parts"), F.lit(0).cast("long")))
        return spread.repartition("o", "part").select("o", "sig", "star", "at").sortWithinPartitions("o").mapInArrow(keep, schema)
    return spread.repartition("o").sortWithinPartitions("o").mapInArrow(keep, schema)


def _cell(o: np.ndarray) -> np.ndarray:
    """The cell of a column in the order of the product, whose top bit is not the hash's."""
    return (o.view(np.uint64) >> np.uint64(63 - CELLS.bit_length() + 1)).astype(np.int64) & (CELLS - 1)


def demand(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Overlap that two sizes must reach, and the part of it that must lie in the columns that are multiplied.

    If two sets share at least alpha columns, they share at least m among the first |x| - alpha + m of each. m is small
    enough for those columns to be in both prefixes, and large enough for chance hits to fall out.
    """
    alpha = -(-percent * (a + b) // (100 + percent))
    fits = np.minimum(alpha + percent * -a // 100 + 1, alpha + percent * -b // 100 + 1)
    return alpha, np.maximum(1, np.minimum(np.minimum(a, b) * AMONG // 100, fits))


#: A tile is two parts and a row's own part, 20 bits each.
_PART = (1 << 20) - 1


def product(incidence: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b (a < b): pairs of sets in different groups that share as much in the multiplied columns as their sizes demand.

    incidence: o, sig, group, at, rows (of the column). A task has a block of columns and adds up the counts of its pairs
    before it hands them on. A column of more than COLUMN rows is cut into parts by the set, and each pair of parts is a
    tile that goes to a task of its own.
    """
    schema = "a long, b long, shared long, need long"
    fields = _arrow_schema(incidence.sparkSession, schema)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", dict)
        parts: list[np.ndarray] = []
        size, tail = 0, None

        def tiles(x: np.ndarray) -> Iterator[np.ndarray]:
            for i in range(0, len(x), TILE):
                p = x[i : i + TILE]
                for j in range(i, len(x), TILE):
                    q = x[j : j + TILE]
                    may = p[:, None, 2] != q[None, :, 2]
                    if x[0, 4] >> 40 != (x[0, 4] >> 20) & _PART:  # two parts: pairs inside one belong to that part's own tile
                        may &= (p[:, None, 4] & _PART) != (q[None, :, 4] & _PART)
                    u, v = np.nonzero(may & (p[:, None, 1] < q[None, :, 1]))
                    yield pairs(p[u], q[v])
                    if i != j:  # the other order of the two stretches
                        u, v = np.nonzero(may & (p[:, None, 1] > q[None, :, 1]))
                        yield pairs(q[v], p[u])

        def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            (m, i), (n, j) = ((x[:, 3] >> 32, x[:, 3] & 0xFFFFFFFF) for x in (a, b))
            alpha, need = demand(m, n, percent)
            fits = 100 * np.minimum(m, n) >= percent * np.maximum(m, n)
            fits &= (i < m - alpha + need) & (j < n - alpha + need)
            return np.stack([a[fits, 1], b[fits, 1], need[fits]], 1)

        def summed() -> pa.RecordBatch:
            x = np.concatenate(parts)
            order = np.lexsort((x[:, 1], x[:, 0]))
            x = x[order]
            new = np.concatenate([[True], (x[1:, 0] != x[:-1, 0]) | (x[1:, 1] != x[:-1, 1])])
            at = np.flatnonzero(new)
            counts = np.diff(np.concatenate([at, [len(x)]]))
            return pa.RecordBatch.from_arrays([pa.array(x[at, 0]), pa.array(x[at, 1]), pa.array(counts), pa.array(x[at, 2])], schema=fields)

        def columns() -> Iterator[np.ndarray]:
            nonlocal tail
            for batch in batches:
                x = np.stack([c.to_numpy() for c in batch.columns], 1)
                x = x if tail is None else np.concatenate([tail, x])
                bounds = (np.flatnonzero((np.diff(x[:, 0]) != 0) | (np.diff(x[:, 4] >> 20) != 0)) + 1).tolist()
                yield from (x[a:b] for a, b in zip([0, *bounds[:-1]], bounds, strict=False) if b - a > 1)
                tail = x[bounds[-1] :] if bounds else x
            if tail is not None and len(tail) > 1:
                yield tail

        for column in columns():
            for tile in tiles(column):
                if len(tile):
                    parts.append(tile)
                    size += len(tile)
                if size > PAIRS:
                    yield summed()
                    parts.clear()
                    size = 0
        if parts:
            yield summed()

    parts = F.ceil(F.col("rows") / F.lit(COLUMN)).cast("long")
    own, every = F.pmod("sig", parts), F.sequence(F.lit(0).cast("long"), parts - 1)
    tile = lambda u: F.shiftleft(F.least(own, u), 40) + F.shiftleft(F.greatest(own, u), 20) + own
    dealt = incidence.select("o", "sig", "group", "at", F.explode(F.when(F.col("rows") <= COLUMN, F.array(F.lit(0).cast("long"))).otherwise(F.transform(every, tile))).alias("tile"))
    counted = dealt.repartition("o", F.shiftright("tile", 20)).sortWithinPartitions("o", "tile").mapInArrow(multiply, schema)
    return counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")


def hubs(incidence: DataFrame) -> DataFrame:
    """a, b: for every pivot the pivot whose group is the largest in most of the columns that both groups have. One pair
    a pivot at most; it only spares pairs in the product and decides nothing else."""
    sizes = incidence.groupBy("o", "star").agg(F.count("*").alias("size"))
    most = sizes.groupBy("o").agg(F.max(F.struct("size", "star")).alias("hub"))
    pairs = sizes.join(most, "o").filter("star <> hub.star").groupBy("star", F.col("hub.star").alias("hub")).agg(F.count("*").alias("n"))
    return pairs.groupBy("star").agg(F.max(F.struct("n", "hub")).alias("m")).filter("m.n > 1").select(F.col("star").alias("a"), F.col("m.hub").alias("b"))


def verified(pairs: DataFrame, docs: DataFrame, names: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that reach the bound on their whole sets. names: sig and a doc_id that has the set; a repeated id's other texts are told apart by sig."""
    spark = docs.sparkSession
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(names, "sig").select("sig", F.col("doc_id").alias("id")), "wanted")
    few = wanted.count() <= BROADCAST_IDS
    chosen = docs.join(F.broadcast(wanted) if few else wanted, docs["doc_id"] == wanted["id"]).select("sig", "text")
    fields = _arrow_schema(spark, "sig long, own binary")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", dict)
        for batch in slices(batches):
            own = shingles(texts_of(batch))
            rows = [(s, x.tobytes()) for s, x in zip(batch.column(0).to_pylist(), own, strict=True) if len(x) and signature(x) == s]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    known = stored(chosen.mapInArrow(sets, "sig long, own binary"), "sets").dropDuplicates(["sig"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("jaccard", dict)
        for b in batches:
            xs, ys = (b.column(i) for i in (2, 3))
            good = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(xs, ys, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = known.select(F.col("sig").alias("a"), F.col("own").alias("x"))
    right = known.select(F.col("sig").alias("b"), F.col("own").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text).

    Documents without words, null texts included, link with nothing; a null id takes no part in links and has a null
    component. Rows of equal ids all stay, each with the component of its own text. An empty table gives no rows.
    """
    return _classed(docs, percent).drop("sig")


def _met_rows(docs: DataFrame, percent: int) -> tuple[DataFrame, np.ndarray]:
    """The stored rows of met, and the counts of columns by cell."""
    counts, firsts = column_counts(docs)
    context = docs.sparkSession.sparkContext
    common, parts = context.broadcast(common_cells(counts)), context.broadcast(salts(firsts, SALT_AFTER))  # CELLS and FIRST_CELLS numbers
    rows = stored(met(docs, common, parts, percent), "met")
    common.destroy()
    parts.destroy()
    return rows, counts


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The join itself: a, b (names of sets, a < b) of every two different sets that reach the bound, and the membership
    doc_id, sig of every row that has words and an id.

    No pair is spared here, so a group of n near copies that all link gives n * (n - 1) / 2 pairs; copies of one set are
    one name and are not expanded. A document's number of links is the sum of the members of the sets that its own
    links with, and its own set's other members.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, counts = _met_rows(docs, percent)
    one = rows.filter("star IS NOT NULL").dropDuplicates(["sig"]).select("sig", F.col("sig").alias("star"), "n", "columns")
    incidence = stored(shared_columns(one, counts).select("o", "sig", F.col("star").alias("group"), "at"), "incidence")
    several = incidence.groupBy("o").agg(F.count("*").alias("rows")).filter("rows > 1")
    members = rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "sig")
    names = members.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    return verified(product(incidence.join(several, "o"), percent), docs, names, percent), members


def _classed(docs: DataFrame, percent: int) -> DataFrame:
    """The rows of classes with the signature of each row's set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, counts = _met_rows(docs, percent)
    sets = rows.filter("star IS NOT NULL").select("sig", "star", "star_n", "n", "columns", "doc_id")
    names = sets.groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    incidence = stored(shared_columns(sets, counts), "incidence")
    stars = sets.select("sig", "star").distinct()
    # copies of a set that met under different salts are one node
    same = sets.groupBy("sig").agg(F.min("star").alias("a"), F.max("star").alias("b")).filter("a <> b").select("a", "b")
    # a pivot is compared with the pivot of the largest group with which its own shares most columns
    first = stored(verified(hubs(incidence), docs, names, percent).union(same), "links")
    groups = components(first)
    grouped = incidence.join(groups, incidence["star"] == groups["node"], "left").withColumn("group", F.coalesce("component", "star")).select("o", "sig", "group", "at")
    # whatever is still in different groups is multiplied
    several = grouped.groupBy("o").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("rows")).filter("low <> high").select("o", "rows")
    rest = verified(product(grouped.join(several, "o"), percent), docs, names, percent)
    between = rest.join(stars.select(F.col("sig").alias("a"), F.col("star").alias("u")), "a").join(stars.select(F.col("sig").alias("b"), F.col("star").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    joined_stars = components(first.union(between))
    lone = stars.groupBy("sig").agg(F.min("star").alias("star"))
    whole = stored(lone.join(joined_stars, lone["star"] == joined_stars["node"], "left").select(F.col("sig").alias("node"), F.coalesce("component", "star").alias("component")), "classes")
    # every set's component, named by its smallest document
    named = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least")).join(whole, F.col("sig") == F.col("node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    answer = named.join(least, "component").select(F.col("sig").alias("s"), "component_id")
    joined = rows.join(answer, (rows["sig"] == answer["s"]) & (rows["n"] > 0) & rows["doc_id"].isNotNull(), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "sig")


def distinct_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one document of each class: the one of the smallest doc_id.

    Rows with a null id stay. Of the rows of one id, those go whose own text is a copy of a smaller id's, and equal texts
    are left once. Up to BROADCAST_IDS dropped ids are broadcast and no text moves; more are joined by a shuffle.
    """
    found = stored(_classed(docs, percent), "classes").filter("doc_id IS NOT NULL").withColumn("copy", F.col("component_id") != F.col("doc_id"))
    ids = stored(found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("n"), F.min("copy").alias("every"), F.max("copy").alias("some")).filter("some OR n > 1"), "ids")

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        few = gone.count() <= BROADCAST_IDS
        return rows.join(F.broadcast(gone) if few else gone, rows["doc_id"] == F.col("__id"), "left_anti")

    kept = without(docs, ids.filter("every").select("__id"))
    if ids.filter("n > 1 AND NOT every").isEmpty():
        return kept
    mixed = ids.filter("some AND NOT every").select("__id")
    gone = found.filter("copy").select(F.col("doc_id").alias("__id"), F.col("sig").alias("__gone")).join(mixed, "__id", "left_semi").distinct()
    if not mixed.isEmpty():
        schema = docs.select("*", F.lit(0).cast("long").alias("__sig")).schema

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sigs = [signature(s) if len(s) else 0 for s in shingles(texts_of(batch))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigs, pa.int64())], names=[*batch.schema.names, "__sig"])

        some = kept.join(mixed, kept["doc_id"] == F.col("__id"), "left_semi").mapInArrow(named, schema)
        some = some.join(gone, (some["doc_id"] == gone["__id"]) & (some["__sig"] == gone["__gone"]), "left_anti").drop("__sig")
        kept = without(kept, mixed).unionByName(some)
    return kept.filter("doc_id IS NULL").unionByName(kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]))
