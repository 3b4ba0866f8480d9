"""Operator 11: a Merkle manifest of a data set, with a proof for every row.

Rows become leaves on the JVM. Leaves are dealt into ranges of (source, id), so that a third of all rows in one source is
many ranges, and counts by range and source give every leaf its index in its source's tree. From there it is a combine
by key that is driven by events: a leaf or node that arrives is put by its index into its partial parent, and as soon as
the parent holds as many children as the sizes of the levels say, its digest is made and arrives in turn. Each range
does so alone. What still waits at its end, a few nodes a level at its edges, is the frontier, which is shuffled by ever
larger blocks of leaves until nothing waits; the subroots of the sources are the leaves of a last tree of the same kind.

Proofs go the other way: a made parent links back to its children, so every round hands the paths of its results down to
what it was given, to the leaves at the end. No digest but those of one range, or of one block's frontier, is in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.llm.common import _arrow_schema, stored

ARITY = 3
#: Leaves of a range; the number of levels by which blocks grow from one round of the frontier to the next.
ROWS, STEP = 200_000, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64
_KINDS = HEAD, LINK, LEAF = range(3)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def level_sizes(n: int) -> list[int]:
    """How many nodes each level of a tree of n leaves has, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Partials:
    """The partial parents of a tree of n leaves, as far as some of its nodes have arrived."""

    def __init__(self, n: int) -> None:
        self.sizes = level_sizes(n)
        self.waiting: dict[tuple[int, int], dict[int, str]] = {}
        self.links: dict[tuple[int, int], list[str]] = {}
        self.root: str | None = None

    def arrive(self, level: int, index: int, digest: str) -> None:
        """A node is there: it joins its parent, and whatever is whole by that arrives as well."""
        while level < len(self.sizes) - 1:
            parent = (level + 1, index // ARITY)
            children = self.waiting.setdefault(parent, {})
            children[index % ARITY] = digest
            if len(children) < min(ARITY, self.sizes[level] - ARITY * parent[1]):
                return
            self.links[parent] = own = [children[i] for i in range(len(children))]
            del self.waiting[parent]
            level, index, digest = *parent, _digest("".join(own))
        self.root = digest

    def frontier(self) -> list[tuple[int, int, str, bool]]:
        """level, index, digest, done of what waits for siblings, or of the root."""
        top = [] if self.root is None else [(len(self.sizes) - 1, 0, self.root, True)]
        return top + [(level - 1, ARITY * index + i, d, False) for (level, index), own in self.waiting.items() for i, d in own.items()]

    def path(self, level: int, index: int) -> tuple[str, int, int]:
        """The siblings of a node, level by level, as far up as parents were made here; and the node where that ends."""
        out = []
        while (own := self.links.get((level + 1, index // ARITY))) is not None:
            out += own[: index % ARITY] + own[index % ARITY + 1 :]
            level, index = level + 1, index // ARITY
        return "".join(out), level, index


def fold(digest: str, index: int, n: int, path: str) -> tuple[str, str]:
    """The root that follows from a node's digest, its index among n and its siblings, and what is left of the path."""
    at = 0
    for size in level_sizes(n)[:-1]:
        place = index % ARITY
        others = min(ARITY, size - index + place) - 1
        mid, end = at + _HEX * place, at + _HEX * others
        digest, at, index = _digest(path[at:mid] + digest + path[mid:end]), end, index // ARITY
    return digest, path[at:]


def leaf_of(columns: list[Column]) -> Column:
    """The digest of a row: each value with the number of its bytes before it, or a dash for null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(part(c.cast("string")) for c in columns)), 256)


@dataclass
class Grown:
    """Trees by group: their leaves in ranges, where each range's run of a group begins, the frontiers and the roots."""

    leaves: DataFrame
    heads: DataFrame
    parts: int
    rounds: list[tuple[DataFrame, int]]
    roots: DataFrame


def _schema(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _block(levels: int) -> Column:
    """The block of 3**levels leaves that a node's first leaf is in; 3**39 leaves are more than a long counts."""
    powers = ", ".join(f"{ARITY**i}L" for i in range(40))
    return F.expr(f"`index` * get(array({powers}), level) div {ARITY ** min(levels, 39)}L")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list, list[pa.RecordBatch]]]:
    """Of a sorted range: each group's head, its links and its leaves in order."""
    head, links, leaves = None, [], []
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        cuts = [*np.flatnonzero(kinds == HEAD).tolist(), batch.num_rows]
        pieces = [batch.slice(0, cuts[0])] + [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i, piece in enumerate(pieces):
            if i:
                if head is not None:
                    yield head, links, leaves
                head, links, leaves = piece.slice(0, 1).to_pylist()[0], [], []
                piece = piece.slice(1)
            n = int((piece.column("kind").to_numpy() == LINK).sum())
            if n:
                links += zip(*(piece.slice(0, n).column(c).to_pylist() for c in ("level", "index", "path")), strict=True)
            if piece.num_rows > n:
                leaves.append(piece.slice(n))
    if head is not None:
        yield head, links, leaves


def _in_ranges(grown: Grown, heads: DataFrame, links: DataFrame | None) -> DataFrame:
    """The rows of each range in one task, each group's head first, then links from above, then leaves."""
    rows = heads.withColumn("kind", F.lit(HEAD)).unionByName(grown.leaves.withColumn("kind", F.lit(LEAF)), allowMissingColumns=True)
    if links is not None:
        rows = rows.unionByName(links.withColumn("kind", F.lit(LINK)), allowMissingColumns=True)
    return rows.repartitionById(grown.parts, F.col("part")).sortWithinPartitions("part", "group", "kind", "place")


_NODES = "group {}, n long, level int, index long, digest string, done boolean, origin long"


def grow(leaves: DataFrame, order: list[str], name: str, least_parts: int = 1, rows: int = ROWS, step: int = STEP) -> Grown:
    """The trees of leaves(group, digest, any further columns), a group's leaves ascending by ``order``; equal rows stay beside each other."""
    kind = leaves.schema["group"].dataType.simpleString()
    # a number makes equal rows differ, so that a range may end between them
    leaves = stored(leaves.withColumn("__row", F.monotonically_increasing_id()), f"{name}-leaves")
    count = leaves.count()
    parts = max(least_parts, -(-count // rows), 1)
    keys = ["group", *order, "digest", "__row"]
    at = F.monotonically_increasing_id()
    ranged = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__at", at)
    ranged = ranged.withColumn("part", F.shiftright("__at", 33).cast("int")).withColumn("place", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = stored(ranged.drop("__at", "__row"), f"{name}-ranges")
    runs = ranged.groupBy("part", "group").agg(F.count("*").alias("run"))
    own, before = Window.partitionBy("group"), Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = runs.select("part", "group", F.coalesce(F.sum("run").over(before), F.lit(0)).alias("offset"), F.sum("run").over(own).alias("n"))
    heads = stored(heads, f"{name}-heads")
    schema = _NODES.format(kind)
    fields = _arrow_schema(leaves.sparkSession, schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, _, pieces in _runs(batches):
            tree = _arrived(head, pieces)
            yield _nodes(tree, head["group"], head["n"], head["part"], fields)

    def later(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        tree = Partials(n)
        for node in zip(*(table.column(c).to_pylist() for c in ("level", "index", "digest")), strict=True):
            tree.arrive(*node)
        return pa.Table.from_batches([_nodes(tree, key[0].as_py(), n, key[1].as_py(), fields)])

    grown = Grown(ranged, heads, parts, [], leaves)
    slim = Grown(ranged.select("part", "group", "place", "digest"), heads, parts, [], leaves)
    out = stored(_in_ranges(slim, heads, None).mapInArrow(first, schema), f"{name}-frontier")
    grown.roots = out.filter("done")
    levels = 0
    while ARITY ** (levels + 1) * parts <= count:  # as many as a range's leaves fill
        levels += 1
    while not out.filter("NOT done").isEmpty():
        levels += step
        nodes = out.filter("NOT done").drop("done")
        grown.rounds.append((nodes, levels))
        out = stored(nodes.groupBy("group", _block(levels).alias("block")).applyInArrow(later, schema), f"{name}-frontier")
        grown.roots = grown.roots.unionByName(out.filter("done"))
    return grown


def _arrived(head: dict, pieces: list[pa.RecordBatch]) -> Partials:
    tree, at = Partials(head["n"]), head["offset"]
    for piece in pieces:
        for digest in piece.column("digest").to_pylist():
            tree.arrive(0, at, digest)
            at += 1
    return tree


def _nodes(tree: Partials, group, n: int, origin: int, fields: pa.Schema) -> pa.RecordBatch:
    rows = tree.frontier()
    columns = [[group] * len(rows), [n] * len(rows), *([r[i] for r in rows] for i in range(4)), [origin] * len(rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def paths(grown: Grown, tops: DataFrame, more: list[str]) -> DataFrame:
    """All leaves' columns with index, n and path, and the columns ``more`` of tops(group, path): what is above each group's root."""
    fields_in = grown.leaves.schema["group"].dataType.simpleString()
    links = None
    for nodes, levels in reversed(grown.rounds):
        rows = nodes.withColumn("path", F.lit(None).cast("string"))
        if links is not None:
            rows = rows.unionByName(links.drop("part").withColumns({"digest": F.lit(None).cast("string"), "n": F.lit(None).cast("long"), "origin": F.lit(None).cast("long")}))
        links = rows.groupBy("group", _block(levels).alias("block")).applyInArrow(_down, f"group {fields_in}, level int, index long, path string, part int")
        # what a round was given came from a smaller block, or from a range
    above = tops.withColumnRenamed("group", "__group")
    heads = grown.heads.join(above, F.col("group").eqNullSafe(F.col("__group"))).drop("__group").withColumn("place", F.lit(0).cast("long"))
    carried = [c for c in grown.leaves.columns if c not in ("group", "part", "place")]
    schema = ", ".join([_schema(grown.leaves, c) for c in ("group", *carried)] + ["index long, n long, path string"] + [_schema(tops, c) for c in more])
    fields = _arrow_schema(grown.leaves.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, found, pieces in _runs(batches):
            tree, links = _arrived(head, pieces), {(level, index): path for level, index, path in found}
            at = head["offset"]
            for piece in pieces:
                own = []
                for i in range(at, at + piece.num_rows):
                    path, level, index = tree.path(0, i)
                    own.append(path + links.get((level, index), "") + head["path"])
                n = piece.num_rows
                columns = [piece.column(c) for c in ("group", *carried)] + [range(at, at + n), [head["n"]] * n, own] + [[head[c]] * n for c in more]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
                at += n

    if links is not None:
        links = links.select("group", "part", "level", "index", "path", F.lit(0).cast("long").alias("place"))
    return _in_ranges(grown, heads, links).mapInArrow(run, schema)


def _down(table: pa.Table) -> pa.Table:
    """Of one block: the path of everything that it was given, from the links of what was made in it and the paths from above."""
    above, given, group = {}, [], table.column("group")
    for level, index, digest, path, origin in zip(*(table.column(c).to_pylist() for c in ("level", "index", "digest", "path", "origin")), strict=True):
        if digest is None:
            above[level, index] = path
        else:
            given.append((level, index, digest, origin))
    tree = Partials(next(n for n in table.column("n").to_pylist() if n is not None))
    for level, index, digest, _ in given:
        tree.arrive(level, index, digest)
    out = []
    for level, index, _, origin in given:
        path, *top = tree.path(level, index)
        out.append((level, index, path + above.get(tuple(top), ""), origin))
    columns = list(zip(*out, strict=True))
    return pa.table({
        "group": pa.array([group[0].as_py()] * len(out), group.type),
        "level": pa.array(columns[0], pa.int32()),
        "index": pa.array(columns[1], pa.int64()),
        "path": pa.array(columns[2], pa.string()),
        "part": pa.array([int(x) % (1 << 31) for x in columns[3]], pa.int32()),
    })


def proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, rows: int = ROWS, step: int = STEP) -> DataFrame:
    """The manifest: doc_id, source, leaf, leaf_index and n (in its source's tree), path, subroot, rank and groups (in the tree of sources), root.

    path has the hex digests of all siblings from the leaf to the root, left to right. ``carry`` adds columns. A null id
    comes first in its source and a null source first of all; rows of one id are ordered by their digest, and equal
    rows, whose places can't be told apart, stand beside each other; an empty table gives no rows. Only the named columns are read.
    """
    spark = docs.sparkSession
    made = {"group": F.col(group_col).cast("string"), "id": F.col(id_col), "digest": leaf_of([F.col(c) for c in columns])} | (carry or {})
    leaves = docs.select(*(c.alias(name) for name, c in made.items()))
    own = grow(leaves, ["id"], "merkle", int(spark.conf.get("spark.sql.shuffle.partitions")), rows, step)
    subroots = own.roots.select(F.lit(0).alias("group"), F.col("group").alias("source"), "digest")
    top = grow(subroots, ["source"], "merkle-top", 1, rows, step)
    root = top.roots.select("group", F.lit("").alias("path"), F.col("digest").alias("root"))
    above = paths(top, root, ["root"]).select(F.col("source").alias("group"), "path", F.col("digest").alias("subroot"), F.col("index").alias("rank"), F.col("n").alias("groups"), "root")
    out = paths(own, stored(above, "merkle-above"), ["subroot", "rank", "groups", "root"])
    names = {"group": "source", "id": "doc_id", "digest": "leaf", "index": "leaf_index"}
    return out.select(*(F.col(c).alias(names.get(c, c)) for c in ("id", "group", "digest", "index", "n", "path", "subroot", "rank", "groups", "root", *(carry or {}))))


def verified(manifest: DataFrame, shown: str = "leaf") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of rows of proofs(): what the digest in ``shown`` folds to, and whether that is the root."""
    schema = f"{_schema(manifest, 'doc_id')}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    fields = _arrow_schema(manifest.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proof, folded = [], []
            for digest, index, n, rank, groups, path in zip(*(b.column(i).to_pylist() for i in range(4, 10)), strict=True):
                subroot, rest = fold(digest, index, n, path)
                folded.append(fold(subroot, rank, groups, rest)[0])
                proof.append(_digest(path))
            same = [a == c for a, c in zip(folded, b.column(3).to_pylist(), strict=True)]
            columns = [b.column(i) for i in range(4)] + [proof, folded, same]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    wanted = manifest.select("doc_id", "leaf", "subroot", "root", F.col(shown).alias("shown"), "leaf_index", "n", "rank", "groups", "path")
    return wanted.mapInArrow(run, schema)


def report(docs: DataFrame, rows: int = ROWS, step: int = STEP) -> DataFrame:
    """Every row's leaf, proof and verification, after texts of even checksums of the id have lost their line ends.

    A null id has no checksum, so its row is not tampered with; a null text stays null.
    """
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    text = F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))
    shown = leaf_of([text if c == "text" else F.col(c) for c in COLUMNS])
    return verified(proofs(docs, carry={"shown": shown}, rows=rows, step=step), "shown")


#: DuckDB: the rows of report(). Levels are made bottom up; a leaf that is shown is folded level by level with the others of its run.
REPORT_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END, CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head FROM documents),
codes AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM d WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, s, 0 AS k, 4294967295::BIGINT AS c FROM codes
  UNION ALL SELECT doc_id, s, k + 1, CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
    FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, ascii(s[k // 8 + 1])::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * len(s))),
even AS (SELECT doc_id FROM crc WHERE k = 8 * len(s) AND (xor(c, 4294967295::BIGINT) & 1) = 0),
h AS (SELECT d.doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        CASE WHEN e.doc_id IS NULL THEN text ELSE replace(text, chr(10), '') END AS t, head FROM d LEFT JOIN even e ON d.doc_id = e.doc_id),
l AS (SELECT doc_id, source, leaf, sha256(head || CASE WHEN t IS NULL THEN '-' ELSE strlen(t) || ':' || t END) AS shown,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h),
up AS (SELECT source, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL SELECT source, level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY source, level, i // 3),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, i, n, subroot AS h FROM sub
  UNION ALL SELECT level + 1, i // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3),
walk AS (SELECT row_number() OVER () AS r, doc_id, source, leaf, 0 AS level, i, shown AS h, '' AS path FROM l
  UNION ALL SELECT r, any_value(w.doc_id), any_value(w.source), any_value(w.leaf), any_value(w.level) + 1, any_value(w.i) // 3,
      sha256(string_agg(CASE WHEN u.i = w.i THEN w.h ELSE u.h END, '' ORDER BY u.i)), any_value(w.path) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> w.i), '')
    FROM walk w JOIN up u ON u.source IS NOT DISTINCT FROM w.source AND u.level = w.level AND u.i // 3 = w.i // 3 WHERE u.n > 1 GROUP BY r),
last AS (SELECT r, doc_id, source, leaf, h, path FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
over AS (SELECT r, doc_id, leaf, subroot, 0 AS level, s.i, h, path FROM last JOIN sub s ON s.source IS NOT DISTINCT FROM last.source
  UNION ALL SELECT r, any_value(w.doc_id), any_value(w.leaf), any_value(w.subroot), any_value(w.level) + 1, any_value(w.i) // 3,
      sha256(string_agg(CASE WHEN u.i = w.i THEN w.h ELSE u.h END, '' ORDER BY u.i)), any_value(w.path) || coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i <> w.i), '')
    FROM over w JOIN top u ON u.level = w.level AND u.i // 3 = w.i // 3 WHERE u.n > 1 GROUP BY r),
done AS (SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(path) AS proof_sha256, h AS folded_root, h = (SELECT h FROM top WHERE n = 1) AS verified FROM done
"""
