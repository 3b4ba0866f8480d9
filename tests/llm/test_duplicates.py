"""Operators 3 and 5 against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, jaccard, substrings

from .conftest import plain


def removed(rows):
    """Per row: bytes, removed, spans, digest of what is kept."""
    raws = [t.encode() for _, t in rows]
    seen = Counter(r[k : k + 200] for r in raws for k in range(len(r) - 199))
    out = []
    for (i, _), r in zip(rows, raws, strict=True):
        cover = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - 199):
            if seen[r[k : k + 200]] > 1:
                cover[k : k + 200] = True
        kept = bytes(b for b, c in zip(r, cover, strict=False) if not c)
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out.append((i is not None, i or 0, len(r), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.report(df).collect())


def test_repeated_strings(docs, nothing, monkeypatch):
    want = removed(plain(docs))
    assert found(docs) == want and sum(w[3] for w in want) > 3000
    monkeypatch.setattr(substrings, "HOT", 2)  # every anchor with different runs is cut into windows
    assert found(docs) == want
    assert found(nothing) == []


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 700)
    monkeypatch.setattr(substrings, "_powers", [])
    rng = random.Random(4)
    shared = "".join(rng.choice("abcd ") for _ in range(450))
    rows = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 900))) + shared + "".join(rng.choice("abcd ") for _ in range(500))) for i in range(6)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == removed(rows)


def test_anchors_do_not_depend_on_the_buffer():
    rng = np.random.default_rng(9)
    passage = rng.integers(97, 101, 400).astype(np.uint8)
    alone = substrings.anchors(passage, np.array([400]))
    for more in (300, 20_000, 200_000):
        data = np.concatenate([rng.integers(97, 101, more).astype(np.uint8), passage])
        first, last, anchor, hashes = substrings.anchors(data, np.array([len(data)]))
        inside = {(max(a, more) - more, b - more, m - more, h) for a, b, m, h in zip(first.tolist(), last.tolist(), anchor.tolist(), hashes.tolist(), strict=True) if b >= more}
        assert {x[1:] for x in inside} >= {x[1:] for x in zip(*(y.tolist() for y in alone), strict=True)}


def test_different_runs_go_through_in_pieces(spark):
    """A hash whose runs come in several pieces is told as a whole, and once."""
    runs = np.zeros(9000, substrings.RUN)
    runs["hash"], runs["d1"], runs["k1"] = np.arange(9000) % 4500, np.arange(9000), np.arange(9000)
    runs["hash"][:3] = 9999, 9998, 7  # two hashes alone
    rows = [(0, substrings.RUNS, bytearray(r.tobytes()), None) for r in runs]
    df = spark.createDataFrame(rows, "part int, kind int, data binary, bytes binary").coalesce(1)
    out = substrings.different_runs(df, 4, 2).collect()
    told = np.concatenate([np.frombuffer(r.data, substrings.RUN) for r in out if r.kind == substrings.RUNS])
    hashes, n = np.unique(runs["hash"], return_counts=True)
    assert sorted(told["d1"].tolist()) == sorted(runs["d1"][np.isin(runs["hash"], hashes[n > 1])].tolist())
    assert [np.frombuffer(r.data, "<u8").tolist() for r in out if r.kind == substrings.HOTS] == [hashes[n > 2].tolist()]


def test_deep_shallow_order():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, (12, 200)).astype(np.uint8)
    strings = base[rng.integers(0, 12, 300)].copy()
    for row in strings:
        row[rng.integers(60, 200)] = rng.integers(97, 100)
    group = rng.integers(0, 5, 300)
    order, common = substrings.deep_shallow(group, strings)
    keys = [(group[i], strings[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for (g, a), (h, b), n in zip(keys, keys[1:], common[1:], strict=False):
        assert n == (-1 if g != h else next((k for k in range(200) if a[k] != b[k]), 200))


def test_text_without_repeats(docs):
    kept = {r.doc_id: r.text for r in substrings.deduplicated(docs.filter("doc_id < 30")).collect()}
    assert kept[0] == dict(plain(docs))[0]


def sets_of(rows):
    out = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), t.encode()))
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def classes(rows):
    sets = sets_of(rows)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    usable = [i for i, (d, _) in enumerate(rows) if d is not None and sets[i]]
    for i in usable:
        for j in usable:
            both = len(sets[i] & sets[j])
            if i < j and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i in usable:
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((d is not None, d or 0, len(s), least[root(i)] if i in set(usable) else d or 0) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def shown(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.classes(df).collect())


def test_classes(docs, nothing, monkeypatch):
    want = classes(plain(docs))
    assert shown(docs) == want and len({w[3] for w in want}) < len({w[1] for w in want}) - 5
    assert shown(nothing) == []


@pytest.mark.parametrize("column", [4096, 8])
def test_classes_of_a_large_group(spark, monkeypatch, column):
    monkeypatch.setattr(jaccard, "SALT_AFTER", 10)
    monkeypatch.setattr(jaccard, "COLUMN", column)  # of the small ones, long columns go in tiles, and hot ones are dealt out
    monkeypatch.setattr(jaccard, "HOT_COLUMN", column)
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "PAIRS", 500)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 5)
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(160):
        w = [x if rng.random() > rng.choice([0.005, 0.02, 0.05]) else f"e{rng.randint(0, 10**6)}" for x in base]
        rows.append((i, " ".join(w if i % 2 else [f"u{rng.randint(0, 10**6)}" for _ in range(60)] + passage)))
    assert shown(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == classes(rows)


def test_links_of_different_texts(spark, docs, nothing):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 999)}" for _ in range(120)]
    near = [" ".join(x if rng.random() > rng.choice([0.005, 0.03]) else f"e{rng.randint(0, 10**6)}" for x in base) for _ in range(40)]
    rows = [r for r in plain(docs) if r[0] is not None] + [(1000 + i, t) for i, t in enumerate(near + near[:5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    own = {}
    for (i, _), s in zip(rows, sets_of(rows), strict=True):
        if s:
            own.setdefault(s, set()).add(i)
    every = list(own)
    want = {frozenset([min(own[x]), min(own[y])]) for k, x in enumerate(every) for y in every[k + 1 :] if 100 * len(x & y) >= 75 * len(x | y)}
    pairs, members = jaccard.links(df)
    names, copies = {}, {}
    for r in members.collect():
        names[r.sig] = min(names.get(r.sig, r.doc_id), r.doc_id)
        copies.setdefault(r.sig, set()).add(r.doc_id)
    assert {frozenset([names[r.a], names[r.b]]) for r in pairs.collect()} == want and len(want) > 50
    assert sorted(map(sorted, copies.values())) == sorted(map(sorted, own.values()))
    assert jaccard.links(nothing)[0].count() == 0


def test_distinct_documents(docs):
    kept = jaccard.distinct_documents(docs)
    assert kept.columns == docs.columns
    want = {(d, c) for _, d, _, c in classes([r for r in plain(docs) if r[0] is not None]) if d == c}
    got = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert {d for d, _ in want} == set(got) and got.count(3) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_by_bytes(docs):
    """Equal words have equal numbers and different ones different numbers, short and long, of any build."""
    from quarry.llm import words

    def thue_morse(first, n=12):
        w = first
        for _ in range(n):
            w += w.translate(str.maketrans("ab", "ba"))
        return w

    texts = [t for _, t in plain(docs)] + [thue_morse("a"), thue_morse("b"), f"x{thue_morse('a')} x{thue_morse('b')}", "é" * 200, "é" * 100 + "e" * 200]
    sums, starts = words.hash_words(texts)
    cut = [t.encode().split() for t in texts]
    assert starts.tolist() == np.concatenate([[0], np.cumsum([len(c) for c in cut])]).tolist()
    pairs = set(zip([w for c in cut for w in c], sums.tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
