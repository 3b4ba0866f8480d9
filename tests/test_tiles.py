"""How many chunks a table is cut into, products by pieces, and links in place of pairs."""

import numpy as np
import pytest

from quarry.operators import graph, knn


def frame(spark, n, d=8):
    v = np.random.default_rng(n).normal(size=(n, d))
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>"), v / np.linalg.norm(v, axis=1)[:, None]


def test_chunks_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAST_CHUNK", 8)
    most = [knn.Tiles.of(knn._rows(frame(spark, n)[0], "embedding", "vec_id", None), None).chunks.count() for n in (400, 1600)]
    assert max(most) <= 4 * knn.CHUNKS  # before, 1,600 rows by 8 were some 400 chunks


@pytest.mark.parametrize("chunk", [None, 40])
def test_pieces_of_a_tile_and_links(spark, monkeypatch, chunk):
    df, v = frame(spark, 150)
    s = v @ v.T
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if s[i, j] >= 0.8}
    pairs = knn.similar_pairs(df, 0.8, chunk=chunk).collect()
    assert {(r.a, r.b) for r in pairs} == want and len(pairs) == len(want)
    links = knn.similar_links(df, 0.8, chunk=chunk)
    of = lambda x: {(r.node, r.component) for r in graph.components(x).collect()}
    assert of(links) == of(spark.createDataFrame(sorted(want), "a long, b long"))
    assert knn.similar_links(df, 2.0, chunk=chunk).count() == 0
    near = {(r.a, r.rank): r.b for r in knn.self_knn(df, 3, chunk=chunk).collect()}
    assert near == {(i, k + 1): j for i in range(150) for k, j in enumerate([j for j in np.argsort(-s[i]) if j != i][:3])}


def test_a_tile_by_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(knn, "SIDE", 7)
    v = np.random.default_rng(1).normal(size=(50, 4))
    v /= np.linalg.norm(v, axis=1)[:, None]
    side = pa.table({"i": [0] * 50, "j": [0] * 50, "id": list(range(50)), "v": [list(x) for x in v]})
    found = knn._products(None, 0.5)(side, side)
    assert set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)) == {(i, j) for i in range(50) for j in range(i + 1, 50) if v[i] @ v[j] >= 0.5}
    stars = knn._products(None, 0.5, True)(side, side)
    assert stars.num_rows < 50 < found.num_rows
    best = knn._products(2, -2.0)(side, side)
    assert best.num_rows == 100 and set(best["b"].to_pylist()[:2]) == set(np.argsort(-(v @ v[0]))[1:3].tolist())
