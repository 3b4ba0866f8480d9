"""Showing results: folded sources, slices, context packs and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import ids
from quarry.operators import ranking


def shake(files: DataFrame, regions: DataFrame, ranges: DataFrame, style: str = "comment") -> DataFrame:
    """file, text, hidden (lines): files with regions folded that no range of results touches.

    Lines are rows: hidden ones are those behind the signature of an untouched region; the first of a fold carries a
    note, the rest go. A region inside a folded one adds nothing. style: comment or signature-only (no note).
    """
    touched = regions.join(ranges.select(F.col("file").alias("rf"), F.col("start").alias("a"), F.col("end").alias("b")), (regions["file"] == F.col("rf")) & (regions["start"] <= F.col("b")) & (regions["end"] >= F.col("a")), "left_anti")
    folds = touched.filter("end > signature_end").select("file", (F.col("signature_end") + 1).alias("a"), F.col("end").alias("b"), "indentation")
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "content")).select("file", (F.col("at") + 1).alias("line"), "content")
    f = folds.select(F.col("file").alias("ff"), "a", "b", "indentation")
    hit = lines.join(f, (lines["file"] == F.col("ff")) & F.col("line").between(F.col("a"), F.col("b"))).groupBy("file", "line").agg(F.min(F.struct("a", (-F.col("b")).alias("nb"), "indentation")).alias("fold"))
    marked = lines.join(hit, ["file", "line"], "left")
    note = F.concat("fold.indentation", F.lit("  // ... "), (-F.col("fold.nb") - F.col("fold.a") + 1).cast("string"), F.lit(" lines hidden"))
    shown = F.when(F.col("fold").isNull(), F.col("content")).when((F.col("line") == F.col("fold.a")) & F.lit(style == "comment"), note)
    return marked.withColumn("shown", shown).groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("line", "shown")))), lambda x: x["shown"]), "\n").alias("text"),
        F.count("fold").alias("hidden"),
    )


def show(results: DataFrame, files: DataFrame, before: int = 0, after: int = 0, id_col: str = "result") -> DataFrame:
    """result, file, start, end, symbol, text, stale of result ids; stale if the symbol is no longer a word of the lines."""
    d = results.select(id_col, ids.decode_column(F.col(id_col)).alias("d")).filter("d IS NOT NULL").select(id_col, "d.*")
    joined = d.join(files.select(F.col("path").alias("file"), F.split("text", "\n").alias("lines")), "file")
    first = F.greatest(F.lit(1), F.col("start") - before)
    last = F.least(F.size("lines"), F.col("end") + after)
    text = F.array_join(F.slice("lines", first, F.greatest(F.lit(0), last - first + 1)), "\n")
    out = joined.select(id_col, "file", first.alias("start"), last.alias("end"), "symbol", text.alias("text"))
    word = F.concat(F.lit("(?<![A-Za-z0-9_])\\Q"), F.col("symbol"), F.lit("\\E(?![A-Za-z0-9_])"))
    return out.withColumn("stale", (F.col("symbol") != "") & ~F.rlike("text", word))


def structured(rows: DataFrame, score: Column, file: Column, start: Column, end: Column, symbol: Column, **more: Column) -> DataFrame:
    """Result rows: id, file, lines, symbol, score within 0 and 1 in 6 places, and more."""
    return rows.select(ids.result_id(file, start, end, symbol).alias("id"), file.alias("file"), start.alias("start"), end.alias("end"), symbol.alias("symbol"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("score"), *(c.alias(k) for k, c in more.items()))


def cards(rows: DataFrame, mode: str = "minimal") -> DataFrame:
    """JSON of result rows: minimal (or compact) has id, file, lines, symbol, kind if there is one, rank, relevance; content
    adds the text, diagnostic what is known of the ranking, full everything. Nulls are left out."""
    if mode == "full":
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("card"))
    base = [F.col("id"), F.col("file"), F.concat_ws("-", "start", "end").alias("lines"), F.when(F.col("symbol") != "", F.col("symbol")).alias("symbol"), F.col("rank"), F.col("score").alias("relevance")]
    base += [F.coalesce(*(F.col(c) for c in ("semantic_kind", "symbol_type", "kind") if c in rows.columns)).alias("kind")] if {"semantic_kind", "symbol_type", "kind"} & {*rows.columns} else []
    known = [c for c in ("distance", "metric", "language", "symbol_type", "semantic_kind", "similarity", "lexical", "fused", "rerank", "confidence", "why_matched") if c in rows.columns]
    more = [F.col("content")] if mode == "content" else [F.struct(*known).alias("diagnostic")] if mode == "diagnostic" and known else []
    return rows.select(F.to_json(F.struct(*base, *more)).alias("card"))


def graph_cards(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """JSON of edges as references, impact and traces show them: both ends with file and lines, kind and confidence."""
    end = lambda s: nodes.select(F.col("node").alias(s), F.struct(F.col("name").alias("symbol"), "file", F.concat_ws("-", "start", "end").alias("lines")).alias(f"__{s}"))
    both = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    return both.select("src", "dst", "kind", F.to_json(F.struct(F.col("__src").alias("from"), F.col("__dst").alias("to"), "kind", "confidence")).alias("card"))


def markdown(rows: DataFrame, content: str | None = "content") -> DataFrame:
    """text: one section a row, its place and symbol as heading and its content as a block."""
    head = F.concat(F.lit("### "), F.col("file"), F.lit(":"), F.concat_ws("-", "start", "end"), F.when(F.col("symbol") != "", F.concat(F.lit(" `"), F.col("symbol"), F.lit("`"))).otherwise(F.lit("")))
    return rows.select("id", F.concat(head, F.concat(F.lit("\n```\n"), F.col(content), F.lit("\n```"))).alias("text") if content else head.alias("text"))


def json_lines(rows: DataFrame, path: str) -> None:
    """Rows as lines of JSON in a folder, nulls left out."""
    rows.write.mode("overwrite").json(path)


def warning_code(message: Column) -> Column:
    """The code of a warning by what it mentions, the first that fits."""
    low = F.lower(message)
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("stale"), "INDEX_STALE").when(has("embedding", "lexical-fallback", "provider"), "EMBEDDING_FALLBACK").when(has("schema", "migration"), "INDEX_INCOMPATIBLE").when(has("file filter", "no indexed files matched"), "EMPTY_SCOPE").when(has("truncat", "budget"), "OUTPUT_TRUNCATED").otherwise("WARNING")


def segments(files: DataFrame, batch_tokens: int = 2000) -> DataFrame:
    """file, part, first, last, chars: each file cut at line ends into parts of batch_tokens at most (a longer line is a part)."""
    size = 4 * batch_tokens
    lines = files.select(F.col("path").alias("file"), F.split("text", "\n").alias("lines"))
    fold = F.expr(f"""aggregate(lines, named_struct('n', 0, 'at', 0, 'part', 0, 'out', CAST(array() AS array<int>)),
      (s, l) -> CASE WHEN s.n > 0 AND s.n + length(l) + 1 > {size} - length(file) - 80
        THEN named_struct('n', length(l) + 1, 'at', s.at + 1, 'part', s.part + 1, 'out', array_append(s.out, s.part + 1))
        ELSE named_struct('n', s.n + length(l) + 1, 'at', s.at + 1, 'part', s.part, 'out', array_append(s.out, s.part)) END, s -> s.out)""")
    each = lines.select("file", F.posexplode(F.arrays_zip("lines", fold.alias("part"))).alias("at", "x")).select("file", (F.col("at") + 1).alias("line"), F.length("x.lines").alias("n"), F.col("x.part").alias("part"))
    return each.groupBy("file", "part").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.sum(F.col("n") + 1).alias("chars"))


def audit(changed: DataFrame, results: DataFrame, files: DataFrame, batch_tokens: int = 2000, max_batches: int = 10) -> tuple[DataFrame, DataFrame]:
    """Batches of the changed files' text, and one row of coverage: files changed, represented in results, in batches, ratios, complete."""
    parts = segments(files.join(changed.select("path").distinct(), "path", "left_semi"), batch_tokens)
    w = Window.orderBy("file", "part")
    numbered = parts.withColumn("batch", F.row_number().over(w))
    taken = numbered.filter(F.col("batch") <= max_batches)
    n = changed.select("path").distinct().agg(F.count("*").alias("changed"))
    semantic = changed.select(F.col("path").alias("file")).distinct().join(results.select("file").distinct(), "file", "left_semi").agg(F.count("*").alias("represented"))
    whole = numbered.groupBy("file").agg(F.bool_and(F.col("batch") <= max_batches).alias("whole")).agg(F.count_if("whole").alias("covered"))
    ratio = lambda c: F.when(F.col("changed") == 0, F.lit(1.0)).otherwise(F.col(c) / F.col("changed"))
    cover = n.join(semantic, how="cross").join(whole, how="cross")  # one row each
    return taken, cover.withColumns({"semantic": ratio("represented"), "textual": ratio("covered"), "complete": F.col("covered") == F.col("changed")})


def uncovered(changed: DataFrame, results: DataFrame) -> DataFrame:
    """Changed files of which no result speaks."""
    return changed.select(F.col("path").alias("file")).distinct().join(results.select("file").distinct(), "file", "left_anti")


def grouped(rows: DataFrame, group: str, budget: int, content: str = "content", file: str = "file", symbol: str = "symbol", order: str = "rank") -> DataFrame:
    """Rows of each group within a token budget of its own."""
    return ranking.within_budget(rows, ranking.tokens_of(F.col(content), F.col(file), F.col(symbol)), budget, [order], [group])
