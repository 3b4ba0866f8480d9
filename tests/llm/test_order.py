"""Results that depend neither on the order of rows, nor on how they are dealt, nor on their company; and repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, jaccard, mixing, quality, secrets, substrings, tokenfile
from quarry.llm.words import hash_words

TEXT = "doc_id long, text string"


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_token_files_of_rows_of_one_id(spark):
    """Forty texts of one id, some of them twice, and others: whatever their order, each starts where it did."""
    rng = random.Random(3)
    rows = [(5, f"text number {i % 33} " * rng.randint(1, 9)) for i in range(40)] + [(i, f"other {i}") for i in range(9)] + [(None, "x"), (None, None), (5, None)]
    a = tokenfile.token_files(spark.createDataFrame(rows, TEXT))
    b = tokenfile.token_files(spark.createDataFrame(rng.sample(rows, len(rows)), TEXT).repartition(5))
    assert same(a, b) and a.count() == len(rows)


def test_a_text_has_its_score_in_any_company():
    rng = np.random.default_rng(2)
    texts = ["", *(" ".join(f"w{x}" for x in rng.integers(0, 40, n)) for n in rng.integers(1, 300, 60)), "", "one"]
    rules = quality.Rules(rng.normal(size=1 << 12), 0.0)
    whole = rules.scores(*hash_words(texts))
    assert [rules.scores(*hash_words([t]))[0] for t in texts] == whole.tolist()
    assert rules.scores(*hash_words(texts[::-1])).tolist() == whole[::-1].tolist() and whole[0] == 0


def test_quality_of_other_files_and_filters(spark, docs, labels, monkeypatch):
    """The same documents in other files, behind a filter or beside other columns have the same model."""
    monkeypatch.setattr(quality, "BITS", 10)
    plain = docs.select("doc_id", "text")
    wide = docs.withColumn("more", F.repeat("text", 3)).repartition(2).filter("doc_id IS NULL OR doc_id > -5")
    assert quality.buckets_for(plain) == quality.buckets_for(wide)
    assert same(quality.report(plain, labels), quality.report(wide, labels))


def test_repeated_rows_are_mixed_one_by_one(spark):
    """A row that is there a thousand times at a rate of 1.5 or so is taken about 1,500 times, and reruns agree."""
    rows = [(7, "five words of some text", "hot")] * 1000 + [(i, "four other words here", f"s{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, TEXT + ", source string")
    got = mixing.report(df)
    hot = got.filter("doc_id = 7 AND size = 5").agg(F.count("*"), F.sum("taken"), F.first("target")).first()
    assert hot[0] == 1000 and abs(hot[1] - hot[2]) < 0.05 * hot[2] and 0 < hot[2] % 5000
    assert same(got, mixing.report(df.orderBy(F.rand(3)).repartition(3)))


def test_small_tables_have_several_blocks(spark):
    assert [ann.blocks_for(n) for n in (0, 1, 1023, 2000, 51_282, 10**7)] == [1, 1, 1, 3, 16, 77]
    v = np.random.default_rng(8).normal(size=(2500, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found = {}
    for r in ann.report(df).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, ids in found.items():
        near = unit @ unit[q]
        near[q] = -2
        hits += len(ids & set(np.argsort(-near)[:5].tolist()))
    assert len(found) == 50 and hits >= 0.9 * 250


def test_the_share_falls_with_the_whole_table():
    """Blocks of one size look at fewer of their rows the larger the table is, and together find 0.9 of the nearest."""
    v = np.random.default_rng(6).normal(size=(24_000, 64))
    unit, shares = v / np.linalg.norm(v, axis=1, keepdims=True), []
    for n in (3000, 24_000):
        asked, found, looked = unit[:n:500], {}, 0
        for at in range(0, n, 1500):
            forest = ann.Forest(v[at : at + 1500])
            for k, rows in enumerate(forest.candidates(asked, n=n)):
                found.setdefault(k, set()).update((rows + at).tolist())
                looked += len(rows)
        shares.append(looked / (n * len(asked)))
        near = asked @ unit[:n].T
        hits = sum(len(set(np.argsort(-row)[1:6].tolist()) & found[k]) for k, row in enumerate(near))
        assert hits >= 0.9 * 5 * len(asked)
    assert shares[1] < 0.8 * shares[0]


@pytest.mark.parametrize("copies", [1, 3, 10**6])
def test_hot_values(docs, monkeypatch, copies):
    want = secrets.report(docs).collect()
    monkeypatch.setattr(secrets, "HOT_COPIES", copies)
    assert sorted(map(str, secrets.report(docs).collect())) == sorted(map(str, want))


def test_parts_grow_with_the_texts(docs, monkeypatch):
    want = substrings.report(docs).collect()
    assert substrings._parts(docs) == 4
    monkeypatch.setattr(substrings, "PART_TEXT", 5000)
    assert substrings._parts(docs) > 4
    assert sorted(map(str, substrings.report(docs).collect())) == sorted(map(str, want))


def test_distinct_documents_of_repeated_ids(spark):
    a, b = ("one two three four five six seven " + w for w in ("eight nine", "other words follow"))
    b = "quite different " + b[::-1]
    rows = [(3, a), (5, a), (5, b), (9, b), (10, "alone here"), (10, "alone here"), (None, a)]
    kept = jaccard.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(0, a), (3, a), (5, b), (10, "alone here")])


def test_repeated_words_among_very_many():
    ids = np.array([5, 0, 0, 1 << 21, 7, 8, 0, 1, 0, 9])  # no window is there twice
    assert quality.repeat_words(ids) == 0
    assert quality.repeat_words(np.concatenate([ids, [6, 0, 0, 1 << 21]])) == 6
