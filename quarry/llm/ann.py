"""Operator 9: approximate nearest neighbours with a hash-prefix forest.

A pool of random hyperplanes gives every vector a row of signs; a tree's hash string is a random choice of them in a
random order, kept as an integer, and a tree is the sorted array of all strings. A query descends by binary search to
its longest matching prefix in every tree, then all trees ascend in step, one bit shorter at a time, until together
they hold their share of SEEN * n ** FALL entries, n being all rows of the table: a share that falls with n. Candidates
are ranked by exact cosine in double precision.

Rows are dealt into blocks, each with its own forest, and queries into parts; each block meets each part in one task, and
the best of all blocks are merged. A table that would fit one block is dealt into several as well. Rows travel once for a part of queries and queries once for a block, so what is sent
grows with rows times queries, by 1 / PART and 1 / BLOCK: on vectors without structure, as random ones are, no routing
of queries to a few blocks keeps the recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, BITS, POOL, SEED = 128, 24, 512, 11
#: Ascent stops when the trees of all blocks together hold SEEN * n ** FALL entries, a row counted in each tree, or every row.
SEEN, FALL = 6.0, 0.75
#: Rows of a block, queries of a part, and queries answered at once.
BLOCK, PART, QUERY_BATCH = 131_072, 131_072, 128
#: Smaller tables are dealt into so many blocks of so many rows at least.
BLOCKS, LEAST = 16, 512


class Forest:
    """Sorted hash strings of a block of vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> None:
        self.vectors = scaled(vectors)
        self.unit = self.vectors / np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.trees, self.bits = trees, bits
        rng = np.random.default_rng(seed)
        self.planes = rng.normal(size=(vectors.shape[1], max(POOL, bits))).astype(np.float32)
        self.picks = np.stack([rng.permutation(self.planes.shape[1])[:bits] for _ in range(trees)])
        codes = self.strings(self.unit).T
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """The hash string of each vector in each tree."""
        out = np.empty((len(unit), self.trees), np.int32)
        weights = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int32)
        for at in range(0, len(unit), 2048):
            signs = (unit[at : at + 2048].astype(np.float32) @ self.planes > 0).astype(np.int32)
            for t, pick in enumerate(self.picks):
                out[at : at + 2048, t] = signs[:, pick] @ weights
        return out

    def candidates(self, unit: np.ndarray, seen: float = SEEN, n: int | None = None) -> Iterator[np.ndarray]:
        """For each query the rows that share the longest prefixes with it; n are the rows of all forests, None for this one alone."""
        codes = self.strings(unit)
        low = np.empty((self.bits + 1, self.trees, len(unit)), np.int32)
        high = np.empty_like(low)
        for level in range(self.bits + 1):  # bits that are dropped from the end
            first = (codes >> level) << level
            for t in range(self.trees):
                low[level, t] = np.searchsorted(self.sorted[t], first[:, t])
                high[level, t] = np.searchsorted(self.sorted[t], first[:, t] + (1 << level))
        counts = (high - low).astype(np.int64)
        n = n or len(self.vectors)
        goal = min(seen * n**FALL * len(self.vectors) / n, self.trees * len(self.vectors))
        stop = (counts.sum(1) < goal).sum(0)
        for q, level in enumerate(stop):
            levels = np.full(self.trees, level)
            if level:  # the trees take the last step one after another, until there are enough
                gained = counts[level - 1, :, q].sum() + np.cumsum(counts[level, :, q] - counts[level - 1, :, q])
                levels[np.searchsorted(gained, goal) + 1 :] -= 1
            found = np.zeros(len(self.vectors), bool)
            for t, own in enumerate(levels.tolist()):
                found[self.order[t, low[own, t, q] : high[own, t, q]]] = True
            yield np.flatnonzero(found)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; no digit changes."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, v (array of double) of the rows that take part: an id, and a vector without null or non-finite parts that isn't zero."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "coalesce(forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')), false)"
    return v.filter(f"id IS NOT NULL AND {finite} AND exists(v, x -> x <> 0)")


def blocks_for(n: int, block: int = BLOCK) -> int:
    """Into how many blocks n rows are dealt."""
    return max(1, -(-n // block), min(BLOCKS, n // LEAST))


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, seen: float = SEEN, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by cosine, ties to the smaller id.

    is_query is a condition on ``id``. Rows with the query's id are not its candidates; vectors of other lengths than
    the query's aren't either; an empty table or no query gives no rows; with fewer than k candidates all are returned
    that the forest finds. Only the two columns are read. An infinite ``seen`` makes it exact.
    """
    rows = usable(vectors, id_col, vector_col)
    n, asked_n = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, parts = blocks_for(n, block), max(1, -(-asked_n // part))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    data = rows.withColumn("block", own(blocks, 3)).withColumn("part", every(parts)).withColumn("query", F.lit(False))
    asked = rows.filter(is_query).withColumn("block", every(blocks)).withColumn("part", own(parts, 4)).withColumn("query", F.lit(True))
    both = data.unionByName(asked).withColumn("key", F.col("block") * F.lit(parts) + F.col("part")).select("id", "v", "key", "query")
    both = both.repartitionById(blocks * parts, F.col("key")).sortWithinPartitions("query", "id")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, forests, asked_ids, asked_v = [], None, [], []
        for b in batches:  # of one block and part: its rows, then the queries
            ids, marks = b.column(0).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
            flat = b.column(1)
            for i in range(b.num_rows):
                v = np.asarray(flat[i].values)
                if not marks[i]:
                    held.append((ids[i], v))
                    continue
                if forests is None:
                    forests, held = _forests(held), []
                asked_ids.append(ids[i])
                asked_v.append(v)
                if len(asked_ids) == QUERY_BATCH:
                    yield _answer(forests, asked_ids, asked_v, k, seen, n, schema)
                    asked_ids, asked_v = [], []
        if asked_ids:
            yield _answer(forests, asked_ids, asked_v, k, seen, n, schema)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _forests(held: list[tuple[int, np.ndarray]]) -> dict[int, tuple[np.ndarray, Forest]]:
    """A forest for each length of vector."""
    out: dict[int, tuple[np.ndarray, Forest]] = {}
    for n in {len(v) for _, v in held}:
        own = [(i, v) for i, v in held if len(v) == n]
        out[n] = (np.array([i for i, _ in own]), Forest(np.stack([v for _, v in own])))
    return out


def _answer(forests: dict, ids: list[int], vectors: list[np.ndarray], k: int, seen: float, total: int, schema: pa.Schema) -> pa.RecordBatch:
    out: list[tuple[int, int, float]] = []
    for n in {len(v) for v in vectors}:
        if n not in (forests or {}):
            continue
        own, forest = forests[n]
        which = [i for i, v in enumerate(vectors) if len(v) == n]
        q = scaled(np.stack([vectors[i] for i in which]))
        norms = np.linalg.norm(q, axis=1)
        for i, one, norm, rows in zip(which, q, norms, forest.candidates(q / norms[:, None], seen, total), strict=True):
            rows = rows[own[rows] != ids[i]]
            rough = forest.unit[rows] @ (one / norm)
            if len(rows) > k:
                rows = rows[rough >= np.partition(rough, -k)[-k] - 1e-9]
            chosen = forest.vectors[rows]
            score = (chosen * one).sum(1) / (np.sqrt((chosen * chosen).sum(1)) * np.sqrt((one * one).sum()))
            for j in np.lexsort((own[rows], -score))[:k]:
                out.append((ids[i], own[rows[j]], float(score[j])))
    columns = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def report(vectors: DataFrame) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return nearest(vectors, F.col("id") % 50 == 0)
