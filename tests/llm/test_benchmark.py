"""Operators 12 and 13, which read the benchmark: against all windows, and against all scores."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, ranked
from quarry.llm.terms import terms_of

ITEM = "item_id long, text string, doc_id string, ids string, docs int"


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.fixture(scope="module")
def items(spark, docs):
    rng = random.Random(5)
    texts = [t for t in (r.text for r in docs.orderBy("doc_id").collect()) if t]
    out = []
    for i, t in enumerate(rng.sample(texts, 20)):
        w = t.split()
        a = rng.randrange(len(w))
        out.append((i, " ".join(w[a : a + rng.choice([1, 2, 3, 5, 9, 10, 11, 40])]).upper()))
    out += [(30, ""), (31, None), (32, " ,.; "), (33, "one two"), (33, "W5 and w7"), (None, "ONE two"), (34, "é" * 300 + "😀"), (35, texts[0]), (35, texts[0]), (36, "long " * 12)]
    return spark.createDataFrame([(*r, "x", "y", 3) for r in out], ITEM)


def hits(docs, items):
    """doc_id, n_words, n_hit, n_items, digest, contaminated by looking at every window of every item in every text."""
    windows = {}
    for r in items.collect():
        w = words(r.text)
        for s in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("" if r.item_id is None else str(r.item_id))
    lengths = {len(w) for w in windows}
    out = []
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_terms_of_every_kind_of_byte():
    texts = [None, "", "a", "A1b-C", " é\x00É ", "x" * 700 + " " + "x" * 700, *(f"u{chr(c)}v" for c in range(0x100)), "一　\U0001f600", "end"] * 3
    got = terms_of(pa.array(texts, pa.string()))
    plain = got.data.tobytes()
    for i, t in enumerate(texts):
        own = [plain[got.first[k] : got.end[k]].decode() for k in range(got.starts[i], got.starts[i + 1])]
        assert own == words(t)
    every = [w for t in texts for w in words(t)]
    assert len(set(zip(every, got.hashes.tolist(), strict=True))) == len(set(every)) == len(set(got.hashes.tolist()))


@pytest.mark.parametrize("most", [decontaminate.TABLE_BYTES, 900])
def test_hit_words(docs, items, most):
    want = hits(docs, items)
    assert sum(r[-1] for r in want) > 20
    assert same(decontaminate.report(docs, items, most).collect(), want)
    assert len(list(decontaminate.benchmarks(items, most=most))) == (1 if most > 10_000 else 4)


def test_lanes_and_blocks_of_one_text(spark, monkeypatch):
    """Windows that overlap, lie side by side and at the borders of lanes and texts; words that occur everywhere."""
    monkeypatch.setattr(decontaminate, "LANE", 7)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i, " ".join(rng.choice("ab") for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 8, 9, 10, 10, 11, 25])][2:], "item_id long, text string")
    want = hits(docs, items)
    searched = next(decontaminate.benchmarks(items))
    found = decontaminate.found_in(pa.RecordBatch.from_pydict({"text": texts}), searched)
    assert [sum(r["end"] - r["first"] for r in x) for x in found["runs"].to_pylist()] == [r[2] for r in want]
    assert same(decontaminate.report(docs, items).collect(), want)


def test_most_words_are_skipped():
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 5000))] * 4)
    searched = decontaminate.Benchmark(["1"], pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 60))]))
    looked = []
    plain = decontaminate._blocks

    def counted(hashes, at, size):
        looked.append(len(at))
        return plain(hashes, at, size)

    decontaminate._blocks = counted
    try:
        searched.occurrences(terms_of(texts))
    finally:
        decontaminate._blocks = plain
    assert sum(looked) < 20_000 / 7


def test_clean_documents_stay(docs, items, nothing):
    dirty = {(r[0], r[1]) for r in hits(docs, items) if r[-1]}
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r) for r in kept.collect()) == sorted(str(r) for r in docs.collect() if (r.doc_id, len(words(r.text))) not in dirty)
    assert decontaminate.report(nothing, items).count() == 0
    assert decontaminate.report(docs, items.filter("false")).filter("contaminated OR n_hit > 0").count() == 0


def scores(docs, items, k=10):
    """item_id, rank, doc_id, score by integers of any size."""
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    rows = [(i, w, Counter(w)) for i, w in rows if w]
    n, total = len(rows), sum(len(w) for _, w, _ in rows)
    df = Counter(t for _, _, c in rows for t in c)
    wanted = {}
    for r in items.collect():
        wanted.setdefault(r.item_id, Counter()).update(words(r.text))
    out = []
    for item, terms in wanted.items():
        found = []
        for i, w, c in rows:
            m = 25 + 75 * len(w) * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in terms.items() if t in c)
            if s > 0:
                found.append((-s, (i is not None, i or 0), i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_ranked(docs, items, nothing, monkeypatch):
    want = scores(docs, items)
    assert len({r[0] for r in want}) > 15 and any(r[2] is None for r in want)
    assert same(ranked.report(docs, items).collect(), want)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 7)
    assert same(ranked.search(docs, items, most=900).collect(), want)
    monkeypatch.setattr(ranked, "BLOCK_POSTINGS", 40)
    assert same(ranked.search(docs.coalesce(1), items, k=3).collect(), [r for r in want if r[1] <= 3])
    assert ranked.report(nothing, items).count() == 0 and ranked.report(docs, items.filter("false")).count() == 0
    assert ranked.report(docs, items.filter("item_id > 29 AND item_id < 33")).count() == 0


def test_many_equal_documents(spark):
    """Ties over blocks and tasks: the smallest ids win."""
    rows = [(i, "a b c" if i % 2 else "b c d d") for i in range(3000, 0, -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([(1, "a a a x"), (2, "d")], "item_id long, text string")
    got = ranked.report(df, items).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(1, k, 2 * k - 1) for k in range(1, 11)] + [(2, k, 2 * k) for k in range(1, 11)]


def test_sql(docs, items, spark, sf):
    tables = [(docs, items), tuple(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))]
    for d, b in tables:
        db = duckdb.connect()
        db.register("documents", d.select("doc_id", "text").toArrow())
        db.register("benchmark", b.select("item_id", "text").toArrow())
        assert same(decontaminate.report(d, b).collect(), db.sql(decontaminate.REPORT_SQL).fetchall())
        assert same(ranked.report(d, b).collect(), db.sql(ranked.REPORT_SQL).fetchall())
    assert decontaminate.report(*tables[1]).filter("contaminated").count() > 0


def test_index_counts(docs, items):
    own = next(ranked.item_sets(items))
    blocks = ranked.index(docs, own.vocabulary)
    n, total = blocks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    texts = [w for w in (words(r.text) for r in docs.collect()) if w]
    assert (n, total) == (len(texts), sum(map(len, texts)))
