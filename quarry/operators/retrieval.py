"""The whole of a search: five lists of candidates, fused, moved by role, reranked, and thinned out.

Each list is cut on its own before anything is joined, so what is fused, ordered and joined back has some 2 k + 110 rows
whatever the table's size; the chunks are scanned once for each list and once for their columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph, knn, lexical, ranking

# Scores over 1 tell that nothing was guessed.
EXACT, LITERAL, PATTERN = 1.08, 1.05, 1.04
WORDS, OTHERS = 50, 20  # most rows of the list by words, and of each of the last three


def candidates(chunks: DataFrame, query: str, vector: list[float] | None = None, k: int = 20, pattern: str | None = None, symbol: str | None = None, words: bool = True, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(semantic, others): key, score, rank, why of the nearest chunks, and of those by words, by exactly the symbol, by a
    query that looks like a name, and by the pattern, numbered on through all four.

    Without a vector (its provider failed, or none was wanted) the first is empty. A pattern also limits the nearest."""
    fits = None if pattern is None else T.matches(F.col("content"), pattern)
    one = lambda df, score, order, why: df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(key, F.lit(score).alias("score"), "rank", F.lit(why).alias("why"))
    if vector is None:
        semantic = one(chunks.limit(0), 0.0, [key], "semantic similarity")
    else:
        near = knn.top_k(chunks.filter(F.col("embedding").isNotNull()), vector, ranking.over_fetch(k, "pattern" if pattern else "search"), "embedding", key, fits)
        semantic = near.select(key, F.col("similarity").cast("double").alias("score"), "rank", F.lit("semantic similarity").alias("why"))
    place = ["file", "start", key]
    parts: list[DataFrame] = []
    if words:
        parts.append(lexical.retrieve(chunks, query, WORDS, "content", F.col("symbol"), "file", key).select(key, F.col("lexical").cast("double").alias("score"), "rank", F.lit("words").alias("why")))
    name = symbol or query.strip()
    parts.append(one(chunks.filter(F.col("symbol") == name).orderBy(*place).limit(OTHERS), EXACT, place, "exact symbol"))
    if T.looks_like_identifier(query):
        parts.append(one(chunks.filter(F.contains("content", F.lit(query.strip()))).orderBy(*place).limit(OTHERS), LITERAL, place, "literal"))
    if pattern is not None:
        parts.append(one(chunks.filter(fits).orderBy(*place).limit(OTHERS), PATTERN, place, "pattern"))
    numbered = reduce(lambda a, b: a.unionByName(b), (p.withColumn("__list", F.lit(i)) for i, p in enumerate(parts)))
    return semantic, numbered.withColumn("rank", F.row_number().over(Window.orderBy("__list", "rank"))).drop("__list")  # 110 rows at most


def search(chunks: DataFrame, query: str, vector: list[float] | None = None, k: int = 20, pattern: str | None = None, symbol: str | None = None, words: bool = True, role: Column | None = None, purpose: str = "understand", preferred: str | None = None, changed: Column | None = None, reranked: bool = False, least: float | None = None, overlap: float = 0.6, per_file: int = 2, per_symbol: int = 2, key: str = "chunk_id") -> DataFrame:
    """The k best chunks (chunk_id, file, start, end, symbol, symbol_type, exported, content, embedding and more) with score, why_matched, rank, rank_score.

    The order is: fuse, role of the file for the purpose, rerank, least score, of rows that overlap one, at most per_file rows
    a file and per_symbol a symbol. Scores are rounded to 9 places, and equal ones go by key. An empty table gives an empty
    answer; a null content, symbol or vector meets nothing."""
    semantic, others = candidates(chunks, query, vector, k, pattern, symbol, words, key)
    why = semantic.unionByName(others).groupBy(key).agg(F.array_sort(F.collect_set("why")).alias("why_matched"))
    both = ranking.fuse(semantic, others, [key], "score", "score").select(key, F.col("fused").alias("score")).join(why, key)
    rows = graph.written(chunks.join(F.broadcast(both), key))  # bounded by the lists' limits; later steps read it more than once
    if role is not None:
        rows = ranking.boost(rows, "score", role, purpose, preferred, changed)
    if reranked:
        rows = ranking.rerank(rows, query).withColumn("score", F.col("rerank")).drop("rerank")
    rows = rows.withColumn("score", F.round("score", 9))
    if least is not None:
        rows = rows.filter(F.col("score") >= least)
    order = [F.col("score").desc(), F.col(key)]
    rows = rows.withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
    kept = ranking.drop_overlaps(rows, overlap, order="__rank", slots=True).select(F.col("rank").alias("__rank"), "slot")
    rows = rows.join(kept, "__rank").drop("__rank")
    best = ranking.diversify(rows, ["slot"], per_file, per_symbol).orderBy("slot").limit(k)
    return ranking.rank_score(best, [F.col("slot")]).drop("slot")
