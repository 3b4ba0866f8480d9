"""Cells of vectors: centres from a bounded sample, every row in the cell of its nearest centre, with its distance from it.

What a triangle says of two rows is said here of whole groups: rows at distances near..far from centres that are d apart
are no closer than ``apart`` tells, so that readers leave out files and joins leave out tiles without looking at a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that centres are made from at most, by smallest hash of the id; rounds of k-means.
SAMPLE, ROUNDS = 20_000, 8
#: What distances may be wrong by through rounding.
MARGIN = 1e-6
#: The cell of rows that have no distance: null, empty or zero vectors, non-finite components, lengths that no centre has.
ODD = -1


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """At most k centres of the rows of x, by Lloyd's rounds from a choice of different rows."""
    different = np.unique(x, axis=0)
    centres = different[np.random.default_rng(seed).permutation(len(different))[:k]]
    for _ in range(rounds):
        own, _ = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre, and its distance from it."""
    own = np.concatenate([np.zeros(0, np.int64), *(np.argmin((centres * centres).sum(1) - 2 * (x[a : a + 4096] @ centres.T), axis=1) for a in range(0, len(x), 4096))])
    return own, np.sqrt(((x - centres[own]) ** 2).sum(1))


class Cells:
    """Centres for each length of vector; cells are numbered through."""

    def __init__(self, centres: dict[int, np.ndarray]) -> None:
        self.centres, self.first, at = centres, {}, 0
        for n, c in sorted(centres.items()):
            self.first[n], at = at, at + len(c)
        self.count = at

    @classmethod
    def of(cls, rows: DataFrame, k: int, key: str = "id", vector: str = "v", sample: int = SAMPLE, norm: str | None = None) -> Cells:
        """Centres of a sample of rows, whose vectors are normalised or have their norm beside them: at most ``sample`` vectors come to the driver."""
        some = rows.filter(usable(F.col(vector))).select(key, vector, (F.col(norm) if norm else F.lit(1.0)).alias("__norm"))
        some = some.orderBy(F.xxhash64(key), key).limit(sample).select(vector, "__norm").toArrow()
        by: dict[int, list] = {}
        for v, n in zip(some.column(0), some.column(1).to_pylist(), strict=True):
            by.setdefault(len(v.values), []).append(v.values.to_numpy().astype(float) / n)
        return cls({n: kmeans(np.stack(v).astype(float), max(1, round(k * len(v) / len(some)))) for n, v in by.items()})

    def distances(self) -> list[tuple[int, int, float]]:
        """cell, cell, distance of all centres of one length, both ways."""
        out = []
        for n, c in self.centres.items():
            d = np.sqrt(np.maximum((c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)[None], 0))
            out += [(self.first[n] + i, self.first[n] + j, float(d[i, j]) if i != j else 0.0) for i in range(len(c)) for j in range(len(c))]
        return out

    def dealt(self, rows: DataFrame, vector: str = "v", norm: str | None = None) -> DataFrame:
        """rows with cell and r, the distance from its centre; an odd row has no r. Zero vectors are odd as well. Vectors are normalised or have their norm beside them."""
        shared = rows.sparkSession.sparkContext.broadcast((self.centres, self.first))  # k centres at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, first = shared.value
            for b in batches:
                column = b.column(b.schema.get_field_index(vector))
                lengths = pc.fill_null(pc.list_value_length(column), ODD).to_numpy(zero_copy_only=False)
                cell, r = np.full(b.num_rows, ODD, np.int32), np.full(b.num_rows, np.nan)
                for n in set(lengths.tolist()) & centres.keys():
                    which = np.flatnonzero(lengths == n)
                    x = np.asarray(column.take(pa.array(which)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n)
                    x = x / b.column(b.schema.get_field_index(norm)).to_numpy()[which, None] if norm else x
                    good = np.isfinite(x).all(1) & (np.abs(x).max(1) > 0)
                    own, distance = nearest(x[good], centres[n])
                    cell[which[good]], r[which[good]] = own + first[n], distance
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(r, mask=np.isnan(r))], names=[*b.schema.names, "cell", "r"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{kinds}, cell int, r double")


def usable(v: Column) -> Column:
    """Whether a vector has only finite components, one of them not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def apart(d: Column, near_a: Column, far_a: Column, near_b: Column, far_b: Column) -> Column:
    """No row of a is closer to one of b than this: their centres are d apart and they are near..far from them."""
    return F.greatest(F.lit(0.0), d - far_a - far_b, near_a - d - far_b, near_b - d - far_a) - F.lit(MARGIN)


def reach_of(similarity: Column | float) -> Column | float:
    """How far apart unit vectors of at least a cosine can be."""
    if isinstance(similarity, Column):
        return F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * similarity)) + F.lit(MARGIN)
    return max(0.0, 2 - 2 * similarity) ** 0.5 + MARGIN
