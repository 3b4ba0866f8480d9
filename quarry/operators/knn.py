"""Nearest neighbours and pairs by exact cosine, in DataFrame functions."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import cells
from quarry.operators.graph import written


def top_k(df: DataFrame, query: list[float], k: int = 20, vector: str = "embedding", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k rows nearest to a vector, filtered before they are ranked; adds similarity and rank. One scan and a heap of k rows a task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = df if where is None else df.filter(where)
    near = rows.withColumn("similarity", V.cosine(F.col(vector), q)).orderBy(F.col("similarity").desc(), key).limit(k)
    return near.withColumn("rank", F.row_number().over(Window.orderBy(F.col("similarity").desc(), key)))


def per_group(df: DataFrame, query: list[float], group: str, k: int = 3, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest of each group; Spark keeps k rows a group and task before the shuffle."""
    q = F.array(*(F.lit(float(x)) for x in query))
    w = Window.partitionBy(group).orderBy(F.col("similarity").desc(), key)
    return df.withColumn("similarity", V.cosine(F.col(vector), q)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def normalized(df: DataFrame, vector: str = "embedding", key: str = "vec_id", block: str | None = None) -> DataFrame:
    """id, block, v: vectors normalised once, so that a pair costs one dot product."""
    return df.select(F.col(key).alias("id"), (F.col(block) if block else F.lit(0)).alias("block"), V.l2_normalize(F.col(vector)).alias("v"))


#: Cells at most, and steps of distance that a cell's rows are told apart by before a hash deals them further.
MOST_CELLS, STEPS = 256, 64
#: A table of no more rows than the first is one tile; a larger one is cut into CHUNKS parts, more only where a part would have
#: more rows than MOST_CHUNK. A row is sent to each part that it may have partners in, so their number, which is the same for
#: tables of all sizes between, bounds what a row costs to move. Products are made for SIDE rows at once.
LEAST_CHUNK, MOST_CHUNK, CHUNKS, SIDE = 2048, 65_536, 16, 2048


@dataclass
class Tiles:
    """Rows (id, block, v, norm) in chunks c and parts, and the pairs of chunks (block, i, j), i <= j, that can hold rows within reach.

    A chunk has the rows of one cell between two distances from its centre, ``chunk`` of them or so. Pairs of chunks tell
    which products are made; what is moved are parts: neighbouring chunks together, of ``chunk`` rows each, so that a row is
    sent once to a part however many of its chunks it meets. A chunk across the border of parts is dealt to them by a
    hash. A task has two parts whatever the block's size. A block of no more rows than ``chunk`` is one chunk.
    """

    placed: DataFrame
    chunks: DataFrame | None
    apart: DataFrame | None

    @classmethod
    def of(cls, rows: DataFrame, chunk: int | None) -> Tiles:
        n = rows.count()
        chunk = chunk or (n if n <= LEAST_CHUNK else min(MOST_CHUNK, -(-n // CHUNKS)))
        if n <= chunk:
            return cls(rows.withColumn("c", F.lit(0).cast("long")), None, None)
        found = cells.Cells.of(rows, min(MOST_CELLS, 2 * -(-n // chunk)), norm="norm")
        dealt = written(found.dealt(rows, norm="norm"))
        steps = F.percentile_approx("r", [i / STEPS for i in range(1, STEPS)], 1000)
        sizes = dealt.groupBy("block", "cell").agg(F.count("*").alias("rows"), steps.alias("steps"))
        sizes = sizes.withColumn("whole", F.sum("rows").over(Window.partitionBy("block")) <= chunk)
        sizes = written(sizes.select("block", "cell", "whole", F.ceil(F.col("rows") / chunk).cast("int").alias("pieces"), "steps"))  # a row a cell: joins with it move no vectors
        step = F.size(F.filter(F.coalesce("steps", F.array().cast("array<double>")), lambda x: x < F.col("r")))
        ring = F.when(F.col("r").isNull(), 0).otherwise(F.floor(step * F.least("pieces", F.lit(STEPS)) / STEPS))
        salt = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("pieces") / F.when(F.col("r").isNull(), 1).otherwise(STEPS))))
        c = F.shiftleft((F.col("cell") + 1).cast("long"), 40) + F.shiftleft(ring.cast("long"), 30) + salt
        c = F.when(F.col("whole"), F.lit(0)).otherwise(c).cast("long").alias("c")
        some = lambda x, other: F.when(~F.col("whole"), F.col(x)).otherwise(F.lit(other)).alias(x)
        placed = dealt.join(sizes, ["block", "cell"]).select("id", "block", "v", "norm", some("cell", cells.ODD), some("r", None), c)
        chunks = placed.groupBy("block", "cell", "c").agg(F.min("r").alias("near"), F.max("r").alias("far"), F.count("*").alias("rows"))
        in_block = Window.partitionBy("block")
        chunks = chunks.withColumn("first", F.sum("rows").over(in_block.orderBy("c")) - F.col("rows")).withColumn("all", F.sum("rows").over(in_block))
        chunks = written(chunks.withColumn("parts", F.ceil(F.col("all") / chunk).cast("long")))
        at = F.expr("(first + pmod(xxhash64(id), rows)) * parts DIV all")
        placed = placed.join(chunks.select("block", "c", "rows", "first", "all", "parts"), ["block", "c"]).select("id", "block", "v", "norm", "c", at.alias("part"))
        between = rows.sparkSession.createDataFrame(found.distances() or [(0, 0, 0.0)], "cell_a int, cell_b int, d double")  # MOST_CELLS ** 2 rows
        return cls(placed, chunks, between)

    def pairs(self, reach: float | DataFrame) -> DataFrame:
        """block, i, j of the chunks that can hold rows within reach: one number, or block, c, reach of each chunk."""
        chunks = self.chunks.withColumn("reach", F.lit(reach)) if isinstance(reach, float) else self.chunks.join(reach, ["block", "c"])
        side = lambda df, s: df.select("block", *(F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "block"))
        within = (F.col("cell_a") == cells.ODD) | (F.col("d").isNotNull() & (cells.apart(F.col("d"), *(F.col(c) for c in ("near_a", "far_a", "near_b", "far_b"))) <= F.greatest("reach_a", "reach_b")))
        # whole cells first, so that chunks of cells that are too far apart are never paired
        whole = chunks.groupBy("block", "cell").agg(F.min("near").alias("near"), F.max("far").alias("far"), F.max("reach").alias("reach"))
        near = side(whole, "a").join(side(whole, "b"), "block").filter("cell_a <= cell_b").join(F.broadcast(self.apart), ["cell_a", "cell_b"], "left")
        near = near.filter(within).select("block", "cell_a", "cell_b", "d")
        tiles = near.join(side(chunks, "a"), ["block", "cell_a"]).join(side(chunks, "b"), ["block", "cell_b"])
        return tiles.filter((F.col("c_a") <= F.col("c_b")) & within).select("block", F.col("c_a").alias("i"), F.col("c_b").alias("j"))

    def met(self, pairs: DataFrame | None):
        """Both sides' rows of each pair of parts (block, p, q), cogrouped; None: a block's only chunk with itself.

        The left side has a row without id besides for each pair of chunks (c, o) whose products are to be made.
        """
        if pairs is None:
            rows = self.placed.select("block", F.lit(0).alias("p"), F.lit(0).alias("q"), "c", "id", "v", "norm")
            heads = rows.select("block", "p", "q", "c", F.col("c").alias("o")).distinct()
            left, right = rows, rows.select(*(F.col(c).alias(c) for c in rows.columns))  # the sides are of one table
        else:
            parts = self.chunks.select("block", "c", F.explode(F.expr("sequence(first * parts DIV all, (first + rows - 1) * parts DIV all)")).alias("part"))
            side = lambda c, part: parts.select("block", F.col("c").alias(c), F.col("part").alias(part))
            each = written(pairs.join(side("i", "p"), ["block", "i"]).join(side("j", "q"), ["block", "j"]).filter("p <= q").select("block", "i", "j", "p", "q"))
            heads = each.select("block", "p", "q", F.col("i").alias("c"), F.col("j").alias("o"))
            lefts = each.select("block", F.col("i").alias("c"), F.col("p").alias("part"), "q").distinct()
            rights = each.select("block", F.col("j").alias("c"), F.col("q").alias("part"), "p").distinct()
            left = self.placed.join(lefts, ["block", "c", "part"]).select("block", F.col("part").alias("p"), "q", "c", "id", "v", "norm")
            right = self.placed.select(*(F.col(c).alias(c) for c in self.placed.columns)).join(rights, ["block", "c", "part"]).select("block", "p", F.col("part").alias("q"), "c", "id", "v", "norm")
        left = left.withColumn("o", F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
        return left.groupBy("block", "p", "q").cogroup(right.groupBy("block", "p", "q"))


def _stars(a, b):
    """root, node: every node of the pairs (a, b) but the smallest of its component, with that one."""
    import numpy as np

    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        low = label.copy()
        np.minimum.at(low, label[x], label[y])
        np.minimum.at(low, label[y], label[x])
        while (low != (low := low[low])).any():
            pass
        if (low == label).all():
            break
        label = low[label]
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[label[other]], names[other]


def _products(best: int | None, threshold: float, links: bool = False):
    """A function of a tile's two sides: a, b, similarity of its pairs from the threshold on (a < b), or for every row of
    either side its ``best`` partners (a is the row), or a, b that link what the pairs link. Vectors of different lengths and with nulls have no similarity.

    Sides without chunks are one pair of them. Vectors stay as they came until a piece of them is multiplied.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def sides(side: pa.Table) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """By chunk and length of vector: ids, vectors, norms."""
        v = side.column("v").combine_chunks()
        v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
        lengths = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
        ids = side.column("id").to_numpy() if pa.types.is_integer(side.schema.field("id").type) else np.array(side.column("id").to_pylist())
        norms = side.column("norm").to_numpy() if "norm" in side.column_names else np.ones(len(ids))
        chunks = side.column("c" if "c" in side.column_names else "i").to_numpy()
        out: dict[int, dict] = {}
        for c in np.unique(chunks).tolist():
            own = out.setdefault(c, {})
            for n in set(lengths[chunks == c].tolist()) - {-1, 0}:
                which = np.flatnonzero((chunks == c) & (lengths == n))
                flat = v.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False)
                own[n] = (ids[which], flat.reshape(len(which), n), norms[which])
        return out

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, s, held = [], [], [], 0
        kind = left.schema.field("id").type
        if "o" in left.column_names:
            heads, left = left.filter(pc.is_valid(left.column("o"))), left.filter(pc.is_null(left.column("o")))
            one = heads.num_rows and heads.column("p")[0] == heads.column("q")[0]
            met = [(i, j, one and i == j) for i, j in zip(heads.column("c").to_pylist(), heads.column("o").to_pylist(), strict=True)]
        elif left.num_rows and right.num_rows:
            i, j = left.column("i")[0].as_py(), left.column("j")[0].as_py()
            met, right = [(i, j, i == j)], right.set_column(right.schema.get_field_index("i"), "i", right.column("j"))
        else:
            met = []
        every, others = sides(left), sides(right)
        unit = lambda x, norms, at, n: np.asarray(x[at : at + n], float) / norms[at : at + n, None]
        for xs, ys, same in ((every.get(i, {}), others.get(j, {}), same) for i, j, same in met):
            for n in xs.keys() & ys.keys():
                (p, x, nx), (q, y, ny) = xs[n], ys[n]
                if best is None:
                    for at, to in product(range(0, len(p), SIDE), range(0, len(q), SIDE)):  # a piece of the matrix at a time
                        own, other = p[at : at + SIDE], q[to : to + SIDE]
                        products = unit(x, nx, at, SIDE) @ unit(y, ny, to, SIDE).T
                        good = products >= threshold
                        if same:
                            good &= own[:, None] < other[None, :]
                        i, j = np.nonzero(good)
                        flip = own[i] > other[j]
                        a.append(np.where(flip, other[j], own[i]))
                        b.append(np.where(flip, own[i], other[j]))
                        if not links:
                            s.append(products[i, j])
                            continue
                        held += len(i)
                        if held > SIDE * SIDE:  # no more than a few pieces' pairs are held
                            a, b = ([part] for part in _stars(np.concatenate(a), np.concatenate(b)))
                            held = len(a[0])
                    continue
                x, y = unit(x, nx, 0, len(p)), unit(y, ny, 0, len(q))
                for own, other, u, v in [(p, q, x, y)] if same else [(p, q, x, y), (q, p, y, x)]:
                    rows = max(1, SIDE * SIDE // len(other))
                    for k, row in ((at + k, row) for at in range(0, len(own), rows) for k, row in enumerate(u[at : at + rows] @ v.T)):
                        ok = np.flatnonzero((row >= threshold) & (other != own[k]))
                        if len(ok) > best:  # those as near as the last of the best stay, for ties
                            ok = ok[row[ok] >= np.partition(row[ok], -best)[-best]]
                            ok = ok[np.lexsort((other[ok], -row[ok]))[:best]]
                        a.append(np.repeat(own[k : k + 1], len(ok)))
                        b.append(other[ok])
                        s.append(row[ok])
        if best is not None and len(met) > 1 and a:  # the best of all chunks that a row meets here
            own, other, near = np.concatenate(a), np.concatenate(b), np.concatenate(s)
            order = np.lexsort((other, -near, own))
            first = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1])) if len(order) else order
            order = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < best]
            a, b, s = [own[order]], [other[order]], [near[order]]
        join = lambda parts, t: pa.array(np.concatenate(parts), t) if parts else pa.array([], t)
        if links:
            a, b = zip(_stars(np.concatenate(a), np.concatenate(b)), strict=True) if a else ([], [])
            return pa.table({"a": join(a, kind), "b": join(b, kind)})
        return pa.table({"a": join(a, kind), "b": join(b, kind), "similarity": join(s, pa.float64())})

    return tile


def _rows(df: DataFrame, vector: str, key: str, block: str | None) -> DataFrame:
    """id, block, v, norm: vectors in their own type, which are moved with half the bytes of unit vectors in doubles, and what to divide them by."""
    n = V.norm(F.col(vector))
    rows = df.select(F.col(key).alias("id"), (F.col(block) if block else F.lit(0)).alias("block"), F.col(vector).alias("v"), F.when(n > 0, n).otherwise(F.lit(1.0)).alias("norm"))
    return rows.filter("id IS NOT NULL AND v IS NOT NULL AND block IS NOT NULL")


def tile_counts(df: DataFrame, threshold: float, vector: str = "embedding", key: str = "vec_id", block: str | None = None, chunk: int | None = None) -> DataFrame:
    """One row: kept and all pairs of chunks that similar_pairs() would look at and that there are."""
    tiles = Tiles.of(_rows(df, vector, key, block), chunk)
    if tiles.chunks is None:
        return tiles.placed.agg(F.countDistinct("block").alias("kept"), F.countDistinct("block").alias("all"))
    every = tiles.chunks.groupBy("block").count().agg(F.sum(F.col("count") * (F.col("count") + 1) / 2).cast("long").alias("all"))
    return tiles.pairs(cells.reach_of(threshold)).agg(F.count("*").alias("kept")).join(every, how="cross")  # one row each


def similar_pairs(df: DataFrame, threshold: float, vector: str = "embedding", key: str = "vec_id", block: str | None = None, chunk: int | None = None, links: bool = False) -> DataFrame:
    """a, b, similarity of all pairs (a < b) of one block with at least the threshold.

    Rows are dealt into chunks by cell and distance from its centre; pairs of chunks that are too far apart for the
    threshold are left out before any vector moves, and each of the others is one tile, whose products are one matrix
    product in numpy. Only pairs over the threshold leave a tile, by the products themselves. Equal keys are no pair.
    """
    rows = _rows(df, vector, key, block)
    rows = rows.filter(F.exists("v", lambda x: x != 0) | F.exists("v", lambda x: x.isNull())) if threshold > 0 else rows  # a zero vector's products are 0
    kind = rows.schema["id"].dataType.simpleString()
    tiles = Tiles.of(rows, chunk)
    pairs = None if tiles.chunks is None else tiles.pairs(cells.reach_of(float(threshold)))
    if links:
        return tiles.met(pairs).applyInArrow(_products(None, float(threshold), True), f"a {kind}, b {kind}")
    found = tiles.met(pairs).applyInArrow(_products(None, float(threshold)), f"a {kind}, b {kind}, similarity double")
    return found.filter("a < b")


def similar_links(df: DataFrame, threshold: float, vector: str = "embedding", key: str = "vec_id", block: str | None = None, chunk: int | None = None) -> DataFrame:
    """a, b: links that join the rows of similar_pairs() into the same components, and no others.

    A tile hands on a star for each component of its own pairs, so at most a row for each of its rows, however many pairs.
    """
    return similar_pairs(df, threshold, vector, key, block, chunk, links=True)


def self_knn(df: DataFrame, k: int, vector: str = "embedding", key: str = "vec_id", block: str | None = None, include_self: bool = False, threshold: float = -2.0, chunk: int | None = None) -> DataFrame:
    """a, b, similarity, rank: the k nearest of every row among the others of its block, ties by id.

    First each chunk meets itself, which tells every row how far its k-th neighbour is at most; of the other pairs of
    chunks only those are looked at that can hold anything closer for any row of either. A tile hands on k a row.
    """
    rows = _rows(df, vector, key, block)
    kind = rows.schema["id"].dataType.simpleString()
    schema, tiles = f"a {kind}, b {kind}, similarity double", Tiles.of(rows, chunk)
    best = _products(k, float(threshold))
    if tiles.chunks is None:
        both = tiles.met(None).applyInArrow(best, schema)
    else:
        own = written(tiles.met(tiles.chunks.select("block", F.col("c").alias("i"), F.col("c").alias("j"))).applyInArrow(best, schema))
        w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
        kth = own.withColumn("n", F.row_number().over(w)).filter(F.col("n") == k).select(F.col("a").alias("id"), F.col("similarity").alias("kth"))
        least = F.greatest(F.coalesce("kth", F.lit(-1.0)), F.lit(max(float(threshold), -1.0)))
        reach = tiles.placed.select("id", "block", "c").join(kth, "id", "left").groupBy("block", "c").agg(F.max(cells.reach_of(least)).alias("reach"))
        both = own.unionByName(tiles.met(tiles.pairs(reach).filter("i < j")).applyInArrow(best, schema))
    if include_self:
        both = both.unionByName(df.select(F.col(key).alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("similarity")))
    w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def strong_evidence(hits: DataFrame, similarity: str = "similarity", best: float = 0.72, third: float = 0.60) -> DataFrame:
    """One row: n, first, third and whether three hits are there with the first and third high enough. hits has rank."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col(similarity)))
    return hits.agg(F.count("*").alias("n"), at(1).alias("first"), at(3).alias("third")).withColumn("strong", F.coalesce((F.col("n") >= 3) & (F.col("first") >= best) & (F.col("third") >= third), F.lit(False)))


def planes(dimension: int, bits: int, tables: int, seed: int = 5) -> list[list[list[float]]]:
    """The normals of a table's hyperplanes, by table."""
    import random

    rng = random.Random(seed)
    return [[[rng.gauss(0, 1) for _ in range(dimension)] for _ in range(bits)] for _ in range(tables)]


def hyperplane_buckets(df: DataFrame, dimension: int, bits: int = 12, tables: int = 8, vector: str = "embedding", seed: int = 5) -> DataFrame:
    """df with buckets: one sign pattern a table, for an optional index on large tables (``bucket_search`` reads it)."""

    def pattern(t: int, normals: list[list[float]]) -> Column:
        value = sum(((V.dot(F.col(vector), F.array(*map(F.lit, p))) > 0).cast("long") * (1 << i) for i, p in enumerate(normals)), F.lit(0).cast("long"))
        return value + F.lit(t << bits)

    return df.withColumn("buckets", F.array(*(pattern(t, p) for t, p in enumerate(planes(dimension, bits, tables, seed)))))


def bucket_search(indexed: DataFrame, query: list[float], k: int = 20, bits: int = 12, tables: int = 8, vector: str = "embedding", key: str = "vec_id", where: Column | None = None, seed: int = 5) -> DataFrame:
    """top_k among the rows that share a bucket with the query: approximate. indexed has buckets of the same bits, tables and seed."""
    own = [sum((sum(x * y for x, y in zip(query, p, strict=True)) > 0) << i for i, p in enumerate(normals)) + (t << bits) for t, normals in enumerate(planes(len(query), bits, tables, seed))]
    near = F.arrays_overlap("buckets", F.array(*(F.lit(b).cast("long") for b in own)))
    return top_k(indexed.filter(near), query, k, vector, key, where)


def hydrate(results: DataFrame, table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Results with their vectors, which no earlier step had to carry."""
    return results.join(table.select(key, vector), key, "left")


def reuse(new: DataFrame, old: DataFrame, key: str, order_new: str, order_old: str, vector: str = "embedding") -> DataFrame:
    """new with the vectors of old rows of equal key, each old row used once; null where none is left."""
    nth = lambda by: F.row_number().over(Window.partitionBy(key).orderBy(by))
    left, right = new.withColumn("nth", nth(order_new)), old.select(key, vector, order_old).withColumn("nth", nth(order_old)).drop(order_old)
    return left.join(right, [key, "nth"], "left").drop("nth")
