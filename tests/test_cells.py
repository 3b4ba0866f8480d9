"""Cells of vectors: joins that leave out tiles, and an index that leaves out folders; both against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cells, knn
from quarry.sources.vector_index import VectorIndex


def clustered(n, centres, dimension=16, spread=0.15, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dimension))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dimension))


def frame(spark, v, odd=True):
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    if odd:
        n = v.shape[1]
        rows += [(10_000, None, 0), (10_001, [1.0, 2.0], 0), (10_002, [0.0] * n, 0), (10_003, [None] * n, 1), (10_004, [float("nan")] * n, 1), (10_005, [2.0, 4.1], 0), (10_006, v[0].tolist(), 0), (None, v[0].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def units(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("threshold", [0.9, 0.35])
def test_pairs_of_clusters(spark, threshold):
    v = clustered(700, 25)
    u = units(np.vstack([v, v[:1]]))
    ids = [*range(700), 10_006]
    s = u @ u.T
    want = {(ids[i], ids[j]) for i in range(701) for j in range(i + 1, 701) if s[i, j] >= threshold} | {(10_001, 10_005)}
    df = frame(spark, v)
    assert {(r.a, r.b) for r in knn.similar_pairs(df, threshold, chunk=20).collect()} == want
    blocked = {(a, b) for a, b in want if (a % 3 if a < 10_000 else 0) == (b % 3 if b < 10_000 else 0)}
    assert {(r.a, r.b) for r in knn.similar_pairs(df, threshold, block="label", chunk=20).collect()} == blocked


def test_tiles_that_are_left_out(spark):
    """Of clusters most pairs of chunks are never looked at; of noise all that can hold a pair."""
    v = clustered(900, 30)
    r = knn.tile_counts(frame(spark, v, odd=False), 0.9, chunk=20).first()
    assert r.all > 1000 and r.kept < 0.2 * r.all
    moved = knn.Tiles.of(knn._rows(frame(spark, v, odd=False), "embedding", "vec_id", None), 20)
    assert moved.pairs(cells.reach_of(0.9)).count() == r.kept
    noise = knn.tile_counts(frame(spark, np.random.default_rng(3).normal(size=(300, 64)), odd=False), 0.35, chunk=20).first()
    assert noise.kept <= noise.all


def test_rings_of_one_cell(spark):
    """Rows of one cell at different distances from its centre: far rings don't meet near ones."""
    rng = np.random.default_rng(1)
    v = np.array([1.0] + [0.0] * 7) + np.repeat([0.01, 0.5, 3.0], 200)[:, None] * rng.normal(size=(600, 8))
    s = units(v) @ units(v).T
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= 0.99}
    assert {(r.a, r.b) for r in knn.similar_pairs(frame(spark, v, odd=False), 0.99, chunk=300).collect()} == want


@pytest.mark.parametrize("chunk", [25, 5000])
def test_nearest_of_every_row(spark, chunk):
    v = clustered(400, 12)
    u = units(v)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in knn.self_knn(frame(spark, v, odd=False), 4, chunk=chunk).collect():
        got.setdefault(r.a, []).append((r["rank"], r.b))
    for i in range(400):
        assert [b for _, b in sorted(got[i])] == np.lexsort((np.arange(400), -s[i]))[:4].tolist()
    few = knn.self_knn(frame(spark, v, odd=False), 4, threshold=0.97, chunk=chunk).collect()
    assert {(r.a, r.b) for r in few} == {(i, j) for i in range(400) for j in np.lexsort((np.arange(400), -s[i]))[:4].tolist() if s[i, j] >= 0.97}


def test_equal_rows_and_no_rows(spark):
    df = frame(spark, np.ones((60, 4)), odd=False)
    assert knn.similar_pairs(df, 1 - 1e-9, chunk=7).count() == 60 * 59 // 2
    assert knn.similar_pairs(df.filter("false"), 0.5, chunk=7).count() == 0
    assert [r.b for r in knn.self_knn(df, 2, chunk=7).filter("a = 0").orderBy("rank").collect()] == [1, 2]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    v = clustered(3000, 60)
    return v, frame(spark, v), VectorIndex.build(frame(spark, v), str(tmp_path_factory.mktemp("index")))


def folders_read(df):
    """The partition filters of the scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_index_reads_few_folders(index):
    """Recall of 0.9 and more from under a tenth of the rows."""
    v, df, idx = index
    u, hits, shares = units(v), 0, []
    for q in range(0, 3000, 150):
        near = idx.near(v[q].tolist(), 4)
        shares.append(idx.share(near))
        found = {r.vec_id for r in idx.search(v[q].tolist(), 10, 4).select("vec_id").collect()}
        hits += len(found & set(np.argsort(-(u @ u[q]))[:10].tolist()))
    assert hits >= 0.9 * 200 and np.mean(shares) < 0.1
    plan = folders_read(idx.search(v[0].tolist(), 10, 4))
    assert "__cell" in plan and idx.rows([idx.near(v[0].tolist(), 1)[0]]).inputFiles()


@pytest.mark.parametrize("where", [None, "label = 1", "vec_id < 3"])
def test_an_exact_search_reads_what_it_must(index, where):
    v, df, idx = index
    where = where and F.expr(where)
    for query in (v[5].tolist(), (v[7] + 3).tolist(), [0.0] * 16, [1.0, 2.0]):
        want = knn.top_k(df, query, 10, where=where).select("vec_id", "similarity", "rank").collect()
        got = idx.exact(query, 10, where=where).select("vec_id", "similarity", "rank").collect()
        assert sorted((r["rank"], r.vec_id, r.similarity) for r in got) == sorted((r["rank"], r.vec_id, r.similarity) for r in want)
    if where is None:
        kth = knn.top_k(df, v[5].tolist(), 10).select("similarity").collect()[-1][0]
        assert idx.share(idx.needed(v[5].tolist(), kth)) < 0.5


def test_columns_of_the_same_names(spark, tmp_path):
    df = frame(spark, clustered(80, 4), odd=False).withColumns({"cell": F.lit("c"), "r": F.lit(1), "id": F.col("vec_id"), "v": F.lit(0)})
    idx = VectorIndex.build(df, str(tmp_path / "i"), count=4)
    assert idx.exact([1.0] * 16, 5).drop("similarity", "rank").columns == df.columns
