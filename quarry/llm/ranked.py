"""Operator 13: ranked lexical search as a blocked sparse matrix product.

A is items by terms with multiplicities, B is terms by documents with int64 impacts, and the scores are A times B. One
pass over the texts makes blocks of documents: for each term of any item, its postings in the block (numbers of
documents and frequencies). Blocks are stored; the counts N, L and df come from them, and with these every posting's
impact. A task multiplies its blocks one after another by Gustavson's rows: for each item, the rows of B that its terms
name are merged into one accumulator of the block's documents. Each task keeps an item's best k so far, so what is
shuffled at the end is k rows an item and task, whatever the size of a group of equal documents or the number of hits.

What is broadcast grows with the items alone: they are taken in sets of ITEM_BYTES of text, one product after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import _arrow_schema, held, slices, stored
from quarry.llm.terms import terms_of

TOP = 10
#: Bytes of item texts of one product.
ITEM_BYTES = 16 << 20
#: Documents of a block at most (their numbers take two bytes), and postings from which on a block ends.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 20
_NONE = -(1 << 63)  # stands for a null id, which comes first
_BLOCKS = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, counts binary, docs binary, tf binary"
_KINDS = {"ids": np.int64, "lengths": np.int64, "terms": np.int32, "counts": np.int32, "docs": np.uint16, "tf": np.uint32}


@dataclass
class Items:
    """Some items as rows of A: each row's terms (numbers in ``vocabulary``, the sorted hashes) and how often it has them."""

    ids: list[int | None]
    vocabulary: np.ndarray
    rows: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list[int | None], texts: pa.Array) -> Items:
        """Rows of one id are one item."""
        terms = terms_of(texts)
        vocabulary, numbers = np.unique(terms.hashes, return_inverse=True)
        own: dict[int | None, list[np.ndarray]] = {}
        for i, a, b in zip(ids, terms.starts[:-1], terms.starts[1:], strict=True):
            own.setdefault(i, []).append(numbers[a:b])
        return cls(list(own), vocabulary, [np.unique(np.concatenate(x), return_counts=True) for x in own.values()])


def item_sets(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = ITEM_BYTES) -> Iterator[Items]:
    """The items in as many sets as their size needs, one on the driver at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = max(1, -(-total // most))
    for k in range(sets):
        table = (rows if sets == 1 else rows.filter(F.pmod(F.xxhash64("id"), F.lit(sets)) == k)).toArrow()
        yield Items.of(table.column("id").to_pylist(), table.column("text").combine_chunks())


class _Block:
    """Documents and postings that are gathered for one row of the index."""

    def __init__(self) -> None:
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.docs = self.postings = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.found.append(np.stack([term, doc + self.docs, tf]))
        self.docs, self.postings = self.docs + len(ids), self.postings + len(doc)

    def row(self) -> dict:
        """Postings in the order of terms, and inside a term of documents."""
        term, doc, tf = np.concatenate(self.found, axis=1)
        order = np.argsort(term, kind="stable")  # documents were added in order
        terms, counts = np.unique(term, return_counts=True)
        lengths = np.concatenate(self.lengths)
        arrays = {"ids": np.concatenate(self.ids), "lengths": lengths, "terms": terms, "counts": counts, "docs": doc[order], "tf": tf[order]}
        return {"n_docs": [int((lengths > 0).sum())], "n_terms": [int(lengths.sum())]} | {c: [a.astype(_KINDS[c]).tobytes()] for c, a in arrays.items()}


def index(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of all documents with a term: their ids and numbers of terms, and the postings of the terms in vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    fields = _arrow_schema(docs.sparkSession, _BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("ranked", dict)
        words, block = shared.value, _Block()
        for batch in slices(batches):
            terms = terms_of(batch.column("text"))
            lengths = np.diff(terms.starts)
            full = np.flatnonzero(lengths > 0)  # others are no documents of this search
            ids = batch.column("id").fill_null(_NONE).to_numpy()[full]
            near = np.minimum(np.searchsorted(words, terms.hashes), max(len(words) - 1, 0))
            known = words[near] == terms.hashes if len(words) else np.zeros(len(near), bool)
            doc = np.repeat(np.arange(len(full)), lengths[full])[known]
            keys, tf = np.unique(doc * len(words) + near[known], return_counts=True)
            doc, term = keys // max(len(words), 1), keys % max(len(words), 1)
            at = 0
            while at < len(full):
                end = min(at + BLOCK_DOCS - block.docs, len(full))
                a, b = np.searchsorted(doc, [at, end])
                block.add(ids[at:end], lengths[full[at:end]], doc[a:b] - at, term[a:b], tf[a:b])
                at = end
                if block.docs >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                    yield pa.RecordBatch.from_pydict(block.row(), schema=fields)
                    block = _Block()
        if block.docs:
            yield pa.RecordBatch.from_pydict(block.row(), schema=fields)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCKS)


def frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is: summed by task, then by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                df[np.frombuffer(terms, np.int32)] += np.frombuffer(counts, np.int32)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": seen.astype(np.int32), "df": df[seen]})

    out = np.zeros(size, np.int64)
    found = blocks.select("terms", "counts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Each term's weight, by the logarithm of the C library, once for each frequency."""
    seen, which = np.unique(df, return_inverse=True)
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for f in seen.tolist()], np.int64)[which]


class Best:
    """The k best of each item so far: highest scores, of equal ones the smallest ids."""

    def __init__(self, items: int, k: int) -> None:
        self.k = k
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.ids = [np.zeros(0, np.int64) for _ in range(items)]

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a block's documents; those of 0 and less don't count."""
        least = self.scores[item][-1] if len(self.scores[item]) == self.k else 1
        rows = np.flatnonzero(scores >= max(least, 1))
        if len(rows) > self.k:  # with all that tie at the k-th place
            rows = rows[scores[rows] >= np.partition(scores[rows], -self.k)[-self.k]]
        scores, ids = np.concatenate([self.scores[item], scores[rows]]), np.concatenate([self.ids[item], ids[rows]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]


def product(blocks: DataFrame, items: Items, weight: np.ndarray, n: int, total: int, k: int = TOP) -> DataFrame:
    """item_id, doc_id, score: of each task's blocks each item's k best."""
    shared = blocks.sparkSession.sparkContext.broadcast((items.rows, weight))
    numbers = items.ids
    schema = "item_id long, doc_id long, score long"
    fields = _arrow_schema(blocks.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, weight = shared.value
        best = Best(len(rows), k)
        for batch in batches:
            for i in range(batch.num_rows):
                b = {c: np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in _KINDS.items()}
                _multiply(rows, weight, b, n, total, best)
        ids = np.concatenate([*best.ids, np.zeros(0, np.int64)])
        item = [i for i, own in zip(numbers, best.ids, strict=True) for _ in own]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(ids, mask=ids == _NONE), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)]))], schema=fields)

    return blocks.select(*_KINDS).mapInArrow(run, schema)


def _multiply(rows: list, weight: np.ndarray, b: dict[str, np.ndarray], n: int, total: int, best: Best) -> None:
    """All rows of A times one block of B."""
    m = 25 + (75 * n * b["lengths"]) // total
    tf, docs = b["tf"].astype(np.int64), b["docs"].astype(np.int64)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[docs]) * np.repeat(weight[b["terms"]], b["counts"])
    place = np.concatenate([[0], np.cumsum(b["counts"])])
    row_of = np.full(len(weight), -1)
    row_of[b["terms"]] = np.arange(len(b["terms"]))
    for item, (terms, times) in enumerate(rows):
        merged = np.zeros(len(b["ids"]), np.int64)
        own = row_of[terms]
        for r, t in zip(own[own >= 0].tolist(), times[own >= 0].tolist(), strict=True):
            a, z = place[r], place[r + 1]
            merged[docs[a:z]] += t * impact[a:z]  # a document is in a row once
        best.offer(item, merged, b["ids"])


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", most: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of a score above 0, ties by ascending doc_id.

    Null texts have no terms; a document without terms doesn't count. Rows of one item id are one item with all their
    terms, a null id among them; of documents with equal ids each row is one, a null id comes first. No documents or no
    items give no rows. Columns of other names are not read.
    """
    out = None
    for own in item_sets(items, most=most):
        blocks = stored(index(docs, own.vocabulary, id_col, text_col), "postings")
        n, total = (x or 0 for x in blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first())
        found = product(blocks, own, weights(frequencies(blocks, len(own.vocabulary)), n), n, total, k)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB: the rows of report().
REPORT_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
c AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, t, count(*) AS tf FROM d, unnest(w) AS u(t) GROUP BY r, t),
f AS (SELECT t, floor(1000 * ln((2 * (SELECT n FROM c) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p GROUP BY t),
m AS (SELECT r, doc_id, 25 + (75 * len(w)::BIGINT * (SELECT n FROM c)) // (SELECT l FROM c) AS m FROM d WHERE len(w) > 0),
i AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {_TERMS} AS w FROM benchmark), unnest(w) AS u(t) GROUP BY item_id, t),
s AS (SELECT item_id, p.r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN p ON i.t = p.t JOIN f ON f.t = p.t JOIN m ON m.r = p.r GROUP BY item_id, p.r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score FROM s JOIN m ON m.r = s.r WHERE score > 0)
SELECT * FROM o WHERE rank <= {TOP}
"""
