"""The whole search: its five lists, overlaps, limits and odd tables."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval

SCHEMA = "chunk_id long, file string, start int, end int, symbol string, symbol_type string, exported boolean, content string, embedding array<double>"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, f"f{i % 5}.ts", i * 10, i * 10 + 5, f"s{i}", "function", True, f"text {i} about parsing", [1.0, i / 50]) for i in range(40)]
    rows += [(100, "g.ts", 1, 30, "Box", "class", True, "class Box parsing", [1.0, 0.0]), (101, "g.ts", 2, 30, "open", "method", False, "open parsing", [1.0, 0.001]), (102, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_exact_symbol_is_first_and_told(chunks):
    got = retrieval.search(chunks, "parsing text", [1.0, 0.0], 8, symbol="s7").orderBy("rank").collect()
    assert got[0].symbol == "s7" and "exact symbol" in got[0].why_matched and got[0].score > 1 and [r["rank"] for r in got] == list(range(1, 9))
    assert got[0].rank_score == 1.0 and all(got[i].score >= got[i + 1].score - 0.02 for i in range(7))
    per_file = {}
    for r in got:
        per_file[r.file] = per_file.get(r.file, 0) + 1
    assert max(per_file.values()) <= 2


def test_of_rows_that_overlap_one_stays(chunks):
    got = retrieval.search(chunks, "parsing", [1.0, 0.0], 40, per_file=0, per_symbol=0).collect()
    inside = [r.symbol for r in got if r.file == "g.ts"]
    assert inside == ["open"] or inside == ["Box"]
    assert len({r.chunk_id for r in got}) == len(got)


def test_pattern_and_names(chunks):
    got = retrieval.search(chunks, "nothing", [1.0, 0.0], 20, pattern="text 3[0-9]", per_file=0).collect()
    assert {r.chunk_id for r in got} == set(range(30, 40)) and all({"pattern", "semantic similarity"} <= set(r.why_matched) for r in got)
    named = retrieval.search(chunks.withColumn("content", F.when(F.col("chunk_id") == 3, "call openFile(x)").otherwise(F.col("content"))), "openFile", None, 20).collect()
    assert [r.chunk_id for r in named] == [3, 101] and set(named[0].why_matched) == {"literal", "words"} and named[1].why_matched == ["words"]  # "open" is one of its words


def test_no_vector_no_words_and_empty(chunks):
    assert retrieval.search(chunks, "parsing", None, 5).filter(F.array_contains("why_matched", "semantic similarity")).count() == 0
    assert retrieval.search(chunks, "parsing", None, 5).count() == 5
    assert retrieval.search(chunks, "", None, 5, words=False).count() == 0
    assert retrieval.search(chunks.limit(0), "parsing", [1.0, 0.0], 5, pattern="x", reranked=True).count() == 0


def test_reranked_and_least_score(chunks):
    got = retrieval.search(chunks, "s9 parsing", [1.0, 0.0], 10, reranked=True, least=0.3).collect()
    assert got and all(r.score >= 0.3 for r in got)
    with_role = retrieval.search(chunks, "parsing", [1.0, 0.0], 40, role=F.when(F.col("file") == "f1.ts", "test").otherwise("implementation"), purpose="test", per_file=0).collect()
    assert min(r.score for r in with_role) >= 0 and max(r.score for r in with_role) <= 1.1
