"""Operator 11 against a tree that is built level by level."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def levels(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def walk(tree, i, digest, siblings):
    for row in tree[:-1]:
        a = i // 3 * 3
        run = row[a : a + 3]
        siblings += run[: i - a] + run[i - a + 1 :]
        digest, i = sha("".join(run[: i - a] + [digest] + run[i - a + 1 :])), i // 3
    return digest


def manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root, verified of all rows."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = {s: levels([leaf(r, r.text) for r in own]) for s, own in by.items()}
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for s, own in by.items():
        for i, r in enumerate(own):
            even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            siblings = []
            digest = walk(trees[s], i, leaf(r, r.text.replace("\n", "") if even and r.text else r.text), siblings)
            digest = walk(top, order.index(s), digest, siblings)
            out.append((r.doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(siblings)), digest, digest == top[-1][0]))
    return out


def same(got, want):
    return sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize(("rows", "step"), [(merkle.ROWS, merkle.STEP), (4, 1)])
def test_awkward_rows(docs, rows, step):
    assert same(merkle.report(docs, rows, step).collect(), manifest(docs.collect()))


def test_many_rounds_of_the_frontier(spark):
    """One source holds most rows, others one or a few; ranges of five rows, blocks that grow by a level."""
    rows = [(i, f"text {i}\nof {i % 7}", "en", "hot" if i % 3 else f"s{i % 40}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert same(merkle.report(df, 5, 1).collect(), manifest(df.collect()))
    grown = merkle.grow(df.select(F.col("source").alias("group"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest")), ["id"], "t", 1, 5, 1)
    assert len(grown.rounds) >= 3 and grown.parts == 100


def test_one_row_no_rows_and_repeats(spark, nothing):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = spark.createDataFrame([(2, None, None, None, None)], schema)
    assert same(merkle.report(one).collect(), manifest(one.collect()))
    r = merkle.report(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("") and r.verified
    equal = spark.createDataFrame([(7, "a\nb", "en", "s", 3)] * 11, schema)
    assert same(merkle.report(equal, 2, 1).collect(), manifest(equal.collect()))
    assert merkle.report(nothing).count() == 0


def test_a_proof_is_of_its_row_alone(docs):
    by = {}
    for r in merkle.proofs(docs).collect():
        by[r.source, r.leaf_index] = r
    for r in by.values():
        subroot, rest = merkle.fold(r.leaf, r.leaf_index, r.n, r.path)
        assert subroot == r.subroot and merkle.fold(subroot, r["rank"], r.groups, rest) == (r.root, "")
        other = by[r.source, (r.leaf_index + 1) % r.n]
        if other.leaf != r.leaf:
            assert merkle.fold(other.leaf, r.leaf_index, r.n, r.path)[0] != r.subroot


def test_sql(docs, spark, sf):
    for df in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        db = duckdb.connect()
        db.register("documents", df.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
        assert same(merkle.report(df).collect(), db.sql(merkle.REPORT_SQL).fetchall())
