"""An index of vectors that prunes: rows in a folder for each cell, of which a search reads those near its query.

Cells come from k-means on a bounded sample; every row is in its nearest centre's folder, ordered by its distance from
it. An approximate search reads the nearest cells, as a partition filter. An exact one takes the k-th similarity that
this finds and reads, besides, the cells that can hold anything closer by the triangle bound, and in them the rows at
fitting distances. What the driver holds is a centre and three numbers a cell, MOST_CELLS of them at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import cells, knn

MOST_CELLS, PROBES = 4096, 8
_CELL, _R = "__cell", "__r"


class VectorIndex:
    """The index in a folder; its columns are those of the table it was made from."""

    def __init__(self, spark: SparkSession, path: str, vector: str = "embedding", key: str = "vec_id") -> None:
        self.spark, self.path, self.vector, self.key = spark, path.rstrip("/"), vector, key
        known = spark.read.parquet(f"{self.path}/cells").collect()  # MOST_CELLS + 1 rows at most
        self.known = {r.cell: (np.array(r.centre) if r.centre is not None else None, r.n, r.near, r.far) for r in known}

    @classmethod
    def build(cls, df: DataFrame, path: str, vector: str = "embedding", key: str = "vec_id", count: int | None = None) -> VectorIndex:
        """Write df's rows by cell; ``count`` cells, or the root of the number of rows. A table without rows is a ValueError."""
        spark, path = df.sparkSession, path.rstrip("/")
        n = df.count()
        if not n:
            raise ValueError("there are no vectors to index")
        packed = df.select(F.struct("*").alias("row"), F.col(key).alias("id"), V.l2_normalize(F.col(vector)).alias("v"))
        found = cells.Cells.of(packed, min(MOST_CELLS, count or max(1, round(n**0.5))))
        dealt = found.dealt(packed).select("row.*", F.col("cell").alias(_CELL), F.col("r").alias(_R))
        dealt.hint("rebalance", F.col(_CELL)).sortWithinPartitions(_CELL, _R).write.partitionBy(_CELL).parquet(f"{path}/rows")
        centres = [(found.first[n] + i, x.tolist()) for n, c in found.centres.items() for i, x in enumerate(c)]
        counted = spark.read.parquet(f"{path}/rows").groupBy(F.col(_CELL).alias("cell")).agg(F.count("*").alias("n"), F.min(_R).alias("near"), F.max(_R).alias("far"))
        centre = spark.createDataFrame(centres, "cell int, centre array<double>")
        counted.join(F.broadcast(centre), "cell", "left").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path, vector, key)

    def rows(self, chosen: list[int] | None = None) -> DataFrame:
        """The rows of all cells or of some, whose folders alone are then read."""
        df = self.spark.read.parquet(f"{self.path}/rows")
        return df if chosen is None else df.filter(F.col(_CELL).isin(chosen))

    def distances(self, query: list[float]) -> dict[int, float]:
        """How far the query, normalised, is from each centre of its length."""
        q = np.asarray(query, float)
        q = q / (np.linalg.norm(q) or 1.0)
        return {c: float(np.linalg.norm(q - x)) for c, (x, *_) in self.known.items() if x is not None and len(x) == len(q)}

    def near(self, query: list[float], probes: int = PROBES) -> list[int]:
        """The ``probes`` nearest cells."""
        d = self.distances(query)
        return sorted(d, key=lambda c: (d[c], c))[:probes]

    def share(self, chosen: list[int]) -> float:
        """The share of all rows that some cells have."""
        return sum(self.known[c][1] for c in chosen) / max(1, sum(n for _, n, *_ in self.known.values()))

    def search(self, query: list[float], k: int = 20, probes: int = PROBES, where: Column | None = None) -> DataFrame:
        """The k nearest among the rows of the nearest cells: approximate."""
        return knn.top_k(self.rows(self.near(query, probes)).drop(_CELL, _R), query, k, self.vector, self.key, where)

    def needed(self, query: list[float], kth: float | None) -> list[int]:
        """The cells that can hold a row of at least the similarity kth; None and similarities that odd rows have as well: all."""
        if kth is None or kth <= 0 or not np.any(query):
            return sorted(self.known)
        reach = cells.reach_of(kth) + cells.MARGIN
        return sorted(c for c, d in self.distances(query).items() if max(d - self.known[c][3], self.known[c][2] - d) <= reach)

    def exact(self, query: list[float], k: int = 20, probes: int = PROBES, where: Column | None = None) -> DataFrame:
        """The k nearest of all rows, as knn.top_k gives them."""
        some = self.search(query, k, probes, where).select("similarity").collect()  # k rows
        kth = some[-1][0] if len(some) == k else None
        kth = None if kth is None else min(r[0] for r in some)
        chosen = self.needed(query, kth)
        rows = self.rows(chosen)
        if kth is not None and kth > 0 and chosen:
            d, reach = self.distances(query), cells.reach_of(kth) + cells.MARGIN
            low, high = min(d[c] for c in chosen) - reach, max(d[c] for c in chosen) + reach
            rows = rows.filter(F.col(_R).between(low, high))  # skips row groups
            own = F.element_at(F.create_map(*(x for c in chosen for x in (F.lit(c), F.lit(d[c])))), F.col(_CELL))
            rows = rows.filter(F.abs(F.col(_R) - own) <= reach)
        return knn.top_k(rows.drop(_CELL, _R), query, k, self.vector, self.key, where)
