"""Literal and lexical retrieval: lines, matches, lines to chunks, relevance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def lines(files: DataFrame, text: str = "text", *keys: str) -> DataFrame:
    """keys, line (from 1), content: one row a line."""
    return files.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "content")).select(*keys, (F.col("at") + 1).alias("line"), "content")


def grep(files: DataFrame, pattern: str, keys: list[str], text: str = "text", fixed: bool = False, ignore_case: bool = False) -> DataFrame:
    """keys, line, content (trimmed) of every line that matches. Texts without a match are dropped before they are cut into lines."""
    if fixed:
        test = (lambda c: F.contains(F.lower(c), F.lit(pattern.lower()))) if ignore_case else (lambda c: F.contains(c, F.lit(pattern)))
    else:
        test = lambda c: c.rlike(("(?i)" if ignore_case else "") + f"(?m:{pattern})")
    return lines(files.filter(test(F.col(text))), text, *keys).filter(test(F.col("content"))).withColumn("content", F.trim("content"))


def summary(matches: DataFrame, file: str) -> DataFrame:
    """One row: matches and files."""
    return matches.agg(F.count("*").alias("matches"), F.countDistinct(file).alias("files"))


def line_to_chunk(matches: DataFrame, chunks: DataFrame, file: str = "file") -> DataFrame:
    """matches with the best chunk around each line: one with a symbol first, then the shortest, then the smallest id.

    chunks: file, chunk_id, start, end, symbol. The join is by file, the range a filter on top.
    """
    c = chunks.select(F.col(file).alias("__file"), "chunk_id", "start", "end", "symbol")
    inside = matches.join(c, (matches[file] == F.col("__file")) & F.col("line").between(F.col("start"), F.col("end")))
    w = Window.partitionBy(file, "line").orderBy((F.coalesce("symbol", F.lit("")) != "").desc(), F.col("end") - F.col("start"), "chunk_id")
    return inside.withColumn("pick", F.row_number().over(w)).filter("pick = 1").drop("pick", "__file")


def chunks_with_line(chunks: DataFrame, matches: DataFrame, file: str = "file") -> DataFrame:
    """Chunks with at least one matching line inside."""
    m = matches.select(F.col(file).alias("__file"), "line")
    return chunks.join(m, (chunks[file] == F.col("__file")) & F.col("line").between(chunks["start"], chunks["end"]), "left_semi")


def literal(files: DataFrame, chunks: DataFrame, pattern: str, limit: int = 50, max_bytes: int | None = None, file: str = "file", text: str = "text", fixed: bool = True, ignore_case: bool = False) -> DataFrame:
    """Matches with their chunks in order of file and line, and totals beside each: total, returned, truncated, exhaustive.

    With max_bytes, rows that would not fit are passed over and later, shorter ones may still come.
    """
    found = grep(files, pattern, [file], text, fixed, ignore_case)
    placed = found.join(line_to_chunk(found, chunks, file).select(file, "line", "chunk_id", "symbol"), [file, "line"], "left")
    total = found.count()
    rows = placed.orderBy(file, "line").limit(limit)
    if max_bytes is not None:
        from quarry.operators.ranking import within_budget

        rows = within_budget(rows, F.octet_length(F.concat_ws("", file, "content")) + 16, max_bytes, [file, "line"], first_always=False)
    n = rows.count()
    return rows.withColumns({"total": F.lit(total), "returned": F.lit(n), "truncated": F.lit(n < total), "exhaustive": F.lit(n == total)})


def relevance(rows: DataFrame, query: str, content: str = "content", symbol: str = "symbol", path: str = "file") -> DataFrame:
    """rows with lexical: the relevance for a query's tokens."""
    return rows.withColumn("lexical", T.lexical_relevance(T.query_tokens(query), F.col(content), F.col(symbol), F.col(path)))


def retrieve(rows: DataFrame, query: str, k: int = 50, content: str = "content", symbol: Column | None = None, path: str = "file", key: str = "chunk_id") -> DataFrame:
    """The k rows most relevant for the first 12 tokens of two or more letters; only rows with any of them are scored."""
    tokens = [t for t in T.query_tokens(query) if len(t) >= 2][:12]
    if not tokens:
        return rows.limit(0).withColumns({"lexical": F.lit(0.0), "rank": F.lit(1)})
    some = F.lower(F.col(content)).rlike("|".join(map(re.escape, tokens)))
    scored = rows.filter(some).withColumn("lexical", T.lexical_relevance(tokens, F.col(content), F.lit("") if symbol is None else symbol, F.col(path)))
    best = scored.orderBy(F.col("lexical").desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("lexical").desc(), key)))


def exact_symbol(chunks: DataFrame, name: str, k: int = 20) -> DataFrame:
    """Definitions of exactly that name; a score over 1 tells that nothing was guessed."""
    return chunks.filter(F.col("symbol") == name).withColumn("score", F.lit(1.08)).orderBy("file", "start").limit(k)


def fallback(files: DataFrame, chunks: DataFrame, query: str, k: int = 20, file: str = "file", text: str = "text") -> DataFrame:
    """For a query that looks like an identifier, chunks around its literal occurrences: score 1.05, or 1.04 for a pattern; code first."""
    fixed = T.looks_like_identifier(query)
    found = line_to_chunk(grep(files, query, [file], text, fixed=fixed), chunks, file)
    return found.dropDuplicates(["chunk_id"]).withColumn("score", F.lit(1.05 if fixed else 1.04)).orderBy("kind" if "kind" in found.columns else file, file, "line").limit(k)
