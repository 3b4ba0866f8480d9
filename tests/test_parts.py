"""What tiles move: parts of neighbouring chunks, in the vectors' own type, as often for large tables as for small ones."""

import numpy as np
import pytest

from quarry.operators import cells, graph, knn


def frame(spark, v, labels=1):
    return spark.createDataFrame([(i, [float(x) for x in r], i % labels) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")


def moved(tiles, threshold):
    """Vectors that the two sides of all tiles have."""
    import pyarrow as pa

    size = lambda left, right: pa.table({"n": [sum(x.column("id").length() - x.column("id").null_count for x in (left, right))]})
    return sum(r.n for r in tiles.met(tiles.pairs(cells.reach_of(threshold))).applyInArrow(size, "n long").collect())


def test_a_row_moves_as_often_in_tables_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_CHUNK", 8)
    for n in (300, 1200):
        v = np.random.default_rng(n).normal(size=(n, 24))
        tiles = knn.Tiles.of(knn._rows(frame(spark, v), "embedding", "vec_id", None), None)
        assert moved(tiles, 0.3) <= (knn.CHUNKS + 1) * n  # before, once a chunk, which are 30 to 50
        assert tiles.placed.schema["v"].dataType.simpleString() == "array<float>"  # before, doubles


def test_blocks_are_cut_by_their_own_rows(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_CHUNK", 8)
    v = np.random.default_rng(3).normal(size=(640, 24))
    tiles = knn.Tiles.of(knn._rows(frame(spark, v, 40), "embedding", "vec_id", "label"), None)
    assert moved(tiles, 0.3) == 2 * 640 and tiles.chunks.count() == 40  # a block of 16 rows is one chunk; before, one for each cell


@pytest.mark.parametrize("chunk", [40, 150])
def test_copies_across_the_borders_of_parts(spark, chunk):
    """A vector with so many copies that its chunk is dealt to several parts, which meet in all pairs."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 8)).astype(np.float32)
    v[rng.permutation(500)[:250]] = v[0]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    s = u @ u.T
    assert abs(s - 0.8).min() > 1e-9
    want = {(i, j) for i in range(500) for j in range(i + 1, 500) if s[i, j] >= 0.8}
    df = frame(spark, v)
    got = knn.similar_pairs(df, 0.8, chunk=chunk).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert max(abs(r.similarity - s[r.a, r.b]) for r in got) < 1e-12
    of = lambda x: {(r.node, r.component) for r in graph.components(x).collect()}
    assert of(knn.similar_links(df, 0.8, chunk=chunk)) == of(spark.createDataFrame(sorted(want), "a long, b long"))
    near = {(r.a, r.rank): r.similarity for r in knn.self_knn(df, 3, chunk=chunk).collect()}
    np.fill_diagonal(s, -2)
    assert all(abs(near[i, k + 1] - x) < 1e-12 for i in range(500) for k, x in enumerate(np.sort(s[i])[::-1][:3])) and len(near) == 1500


def test_links_hold_few_pairs(monkeypatch):
    import pyarrow as pa

    sizes, stars = [], knn._stars
    monkeypatch.setattr(knn, "SIDE", 8)
    monkeypatch.setattr(knn, "_stars", lambda a, b: sizes.append(len(a)) or stars(a, b))
    side = pa.table({"i": [0] * 100, "j": [0] * 100, "id": list(range(100)), "v": [[1.0, 0.0]] * 100})
    found = knn._products(None, 0.5, True)(side, side)
    assert found["b"].to_pylist() == list(range(1, 100)) and set(found["a"].to_pylist()) == {0}
    assert max(sizes) <= 100 + 2 * 64  # before, all 4,950
