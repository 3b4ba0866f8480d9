"""Operators 9 and 10, and the pipeline."""

import math
from collections import Counter
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import ann, bpe, jaccard, mixing, quality, secrets

from .conftest import plain


def exact(rows, k=5):
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in usable:
        if i % 50 == 0:
            near = [(-np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)), j) for j, w in usable if j != i and len(w) == len(v)]
            out[i] = [(r + 1, j) for r, (_, j) in enumerate(sorted(near)[:k])]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None] * 16), (None, [1.0] * 16), (3200, [1.0, 2.0]), (3250, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1))
    want = exact(rows)
    for block, part in ((400, 10), (10_000, 10_000)):
        got = {}
        for r in ann.nearest(df, F.col("id") % 50 == 0, block=block, part=part, seen=math.inf).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert ann.report(df.filter("false")).count() == 0


def recall_and_share(vectors, queries):
    """Of the forest at its shipped setting: the share of the true five nearest that is found, and the rows looked at."""
    forest = ann.Forest(vectors)
    hits = seen = 0
    for q, rows in zip(queries, forest.candidates(forest.unit[queries]), strict=True):
        near = forest.unit @ forest.unit[q]
        near[q] = -2
        hits, seen = hits + len(set(np.argsort(-near)[:5].tolist()) & set(rows.tolist())), seen + len(rows)
    return hits / (5 * len(queries)), seen / (len(queries) * len(vectors))


def test_recall_of_the_forest_on_noise():
    shares = []
    for n in (1000, 6000, 30_000):
        vectors = np.random.default_rng(5).normal(size=(n, 64))
        recall, share = recall_and_share(vectors, np.arange(0, n, n // 100))
        assert recall >= 0.9
        shares.append(share)
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.45


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_recall_on_embeddings(spark, name):
    df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = exact(rows)
    got = {}
    for r in ann.report(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    found = sum(len({j for _, j in v} & {j for _, j in got[q]}) for q, v in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))


def test_huge_and_tiny_components(spark):
    """Components whose squares overflow or vanish count like any other."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 8))
    rows = [(i, (v * [1.0, 1e200, 1e-200][i % 3]).tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    for r in ann.nearest(df, F.col("id") % 50 == 0, seen=math.inf).collect():
        near = unit @ unit[r.query_id]
        near[r.query_id] = -2
        assert r.score == pytest.approx(near[r.vec_id]) and r.vec_id == np.argsort(-near)[r["rank"] - 1]


def test_mixing(docs, nothing):
    rows = mixing.report(docs).collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    total = sum(sizes.values())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets, free = {}, set(order)
    while free:  # reshare until none is above its cap
        left = 1.5 * total - sum(targets.values())
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= 2 * sizes[s]}
        targets |= {s: 2.0 * sizes[s] for s in over} if over else {s: level * weights[s] for s in free}
        free -= over or free
    assert {(r.source_size, round(r.target, 6)) for r in rows} == {(sizes[s], round(targets[s], 6)) for s in order}
    assert all(r.taken <= 2 * r.size for r in rows) and all(r.size == 0 or r.taken % r.size == 0 for r in rows)
    assert sorted(map(tuple, mixing.report(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixing.report(nothing).count() == 0
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] > 0


@pytest.mark.parametrize("most", [0, 20_000])
def test_sources_come_near_their_targets(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
    rng = random.Random(3)
    rows = [(i, "word " * rng.randint(5, 30), f"s{min(i % 7, 3)}") for i in range(4000)]
    got = mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target


def test_pipeline_does_what_its_stages_do(spark, sf):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "secret_scan", "mix_sources", "encode"]
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.report(docs, labels).collect() if r.kept}
    good = docs.filter(F.col("doc_id").isin(list(kept)))
    alone = {r.doc_id for r in jaccard.classes(good).collect() if r.doc_id == r.component_id}
    clean = secrets.redact(good.filter(F.col("doc_id").isin(list(alone))))
    size = {i: len(t.split()) for i, t in plain(clean)}
    copies = {r.doc_id: r.taken // size[r.doc_id] for r in mixing.report(clean).collect() if size[r.doc_id]}
    digest = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(clean).collect()}
    want = sorted((i, digest[i]) for i, n in copies.items() for _ in range(n))
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()) == want and len(want) > 50


def test_stages_keep_columns_and_nulls(spark, docs, sf):
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows = [(r.doc_id, r.text) for r in base.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, base, sf)
        kept[name] = [(r.doc_id, r[1]) for r in out.collect()]
        assert name == "encode" or out.columns == base.columns, name
        assert {i for i, _ in kept[name]} <= {i for i, _ in rows}, name
        assert stage(spark, base.filter("false"), sf).count() == 0
    # a base rule refuses texts of few words, so null and empty ones; near duplicates keep rows without an id, and one of each text
    assert all(t and len(t.split()) >= 50 for _, t in kept["quality_rules"])
    assert sum(i is None for i, _ in kept["near_duplicates"]) == sum(i is None for i, _ in rows)
    with_words = [t for i, t in kept["near_duplicates"] if i is not None and t and t.split()]
    assert len(with_words) == len(set(with_words)) and {i for i, t in rows if t is None} <= {i for i, _ in kept["near_duplicates"]}
    # secrets take no row away, and neither does the encoder; equal rows are mixed equally often, up to twice
    assert len(kept["secret_scan"]) == len(kept["encode"]) == len(rows)
    before, mixed = Counter(rows), Counter(kept["mix_sources"])
    assert set(mixed) <= set(before) and all(n % before[r] == 0 and n <= 2 * before[r] for r, n in mixed.items())
