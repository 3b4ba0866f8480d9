"""Retrieval quality and small reports."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import ids
from quarry.operators import answers, graph, lexical, ranking


def read_cases(text: str) -> list[dict]:
    """Cases from JSON, or from the simple YAML form: items with query and lists under expectedFirstFiles, requiredSymbols, requiredKinds."""
    lists = ("expectedFirstFiles", "requiredSymbols", "requiredKinds")
    try:
        raw = json.loads(text)
        raw = raw["cases"] if isinstance(raw, dict) else raw
    except json.JSONDecodeError:
        raw, key = [], ""
        for line in text.splitlines():
            body = line.strip()
            if m := re.fullmatch(r"-\s+query:\s*(.+)", body):
                raw.append({"query": m[1].strip("'\"")})
            elif m := re.fullmatch(r"(\w+):\s*(\[.*\])?\s*", body):
                key = m[1]
                if raw and m[2]:
                    raw[-1][key] = [v.strip().strip("'\"") for v in m[2][1:-1].split(",") if v.strip()]
            elif (m := re.fullmatch(r"-\s+(.+)", body)) and raw and key in lists:
                raw[-1].setdefault(key, []).append(m[1].strip("'\""))
    return [{"query": c["query"], **{k: list(c.get(k, [])) for k in lists}} for c in raw]


def cases_table(spark: SparkSession, cases: list[dict]) -> DataFrame:
    """query, kind, item: what a case demands, one row each."""
    kinds = {"expectedFirstFiles": "file", "requiredSymbols": "symbol", "requiredKinds": "semantic_kind"}
    rows = [(c["query"], kinds[k], v) for c in cases for k in kinds for v in c[k]]
    return spark.createDataFrame(rows, "query string, kind string, item string")


def cases_of(rows: DataFrame, case: str = "case") -> DataFrame:
    """query, kind, item of a column of cases, each one JSON object; a text that is none gives no rows."""
    kinds = {"expectedFirstFiles": "file", "requiredSymbols": "symbol", "requiredKinds": "semantic_kind"}
    parsed = rows.select(F.from_json(case, "query string, " + ", ".join(f"{k} array<string>" for k in kinds)).alias("c")).filter("c.query IS NOT NULL")
    demands = F.array(*(F.struct(F.lit(kind).alias("kind"), F.coalesce(f"c.{k}", F.array().cast("array<string>")).alias("items")) for k, kind in kinds.items()))
    each = parsed.select(F.col("c.query").alias("query"), F.explode(demands).alias("d"))
    return each.select("query", F.col("d.kind").alias("kind"), F.explode("d.items").alias("item"))


def scores(hits: DataFrame, demanded: DataFrame, limit: int = 10, query: str = "query") -> DataFrame:
    """query, hits, relevant, found, demanded, recall, first_rank, precision, passed.

    hits: query, rank, item; demanded: query, item. Queries with no hit are there too; one that demands nothing passes.
    """
    top = hits.filter(F.col("rank") <= limit).select(query, "rank", "item")
    need = demanded.select(query, "item").distinct()
    marked = top.join(need.withColumn("good", F.lit(1)), [query, "item"], "left")
    by_query = marked.groupBy(query).agg(F.countDistinct("rank").alias("hits"), F.countDistinct(F.when(F.col("good") == 1, F.col("rank"))).alias("relevant"), F.countDistinct(F.when(F.col("good") == 1, F.col("item"))).alias("found"), F.min(F.when(F.col("good") == 1, F.col("rank"))).alias("first_rank"))
    wanted = need.groupBy(query).agg(F.count("*").alias("demanded"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = by_query.join(wanted, query, "full_outer").select(query, zero("hits"), zero("relevant"), zero("found"), zero("demanded"), "first_rank")
    recall = F.when(F.col("demanded") == 0, F.lit(1.0)).otherwise(F.col("found") / F.col("demanded"))
    precision = F.when(F.col("hits") == 0, F.lit(0.0)).otherwise(F.col("relevant") / F.col("hits"))
    return out.withColumns({"recall": recall, "precision": precision, "passed": (F.col("demanded") == F.col("found"))})


def summarize(scored: DataFrame) -> DataFrame:
    """One row: cases, passed, mean recall, mean first rank of those that have one."""
    return scored.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg("recall").alias("recall"), F.avg("first_rank").alias("first_rank"))


def benchmark(spark: SparkSession, embedders: dict[str, Callable[[list[str]], list[list[float]]]], texts: list[str], rounds: int = 3) -> DataFrame:
    """name, seconds, inputs_per_s, tokens_per_s, fastest of embedders, timed on the driver."""
    rows = []
    for name, embed in embedders.items():
        took = []
        for _ in range(rounds):
            began = time.perf_counter()
            embed(texts)
            took.append(time.perf_counter() - began)
        mean = sum(took) / len(took)
        rows.append((name, mean, len(texts) / max(mean, 1e-9), sum(-(-len(t) // 4) for t in texts) / max(mean, 1e-9)))
    best = min(rows, key=lambda r: r[1])[0] if rows else None
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "name string, seconds double, inputs_per_s double, tokens_per_s double, fastest boolean")


def investigate(hits: DataFrame, nodes: DataFrame, edges: DataFrame, symbols: int = 3, references: int = 50, impact: int = 100) -> tuple[DataFrame, DataFrame]:
    """References (symbol, src, kind) and impact (symbol, node, depth) of the symbols of the best hits (symbol, file, start, score).

    What a search found leads to what calls it and to what a change would reach; literal evidence and the context are the
    caller's next steps, by ``lexical.literal`` and ``ranking.within_budget``.
    """
    best = hits.filter(F.coalesce("symbol", F.lit("")) != "").orderBy(F.col("score").desc(), "file", "start").limit(symbols).select("symbol", "file", "start")
    placed = best.join(nodes, (nodes["name"] == best["symbol"]) & (nodes["file"] == best["file"]) & best["start"].between(nodes["start"], nodes["end"])).select("symbol", "node")
    used = edges.join(placed.select("symbol", F.col("node").alias("dst")), "dst").select("symbol", "src", "kind")
    own = [r["symbol"] for r in placed.select("symbol").distinct().collect()]  # ``symbols`` at most
    reached = [graph.impact(edges, placed.filter(F.col("symbol") == s), limit=impact).withColumn("symbol", F.lit(s)) for s in own]
    empty = placed.limit(0).select("node", F.lit(0).alias("depth"), "symbol")
    return used.distinct().orderBy("symbol", "src", "kind").limit(references * symbols), reduce(lambda a, b: a.unionByName(b), reached, empty)


def investigation(hits: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame, max_tokens: int = 8000, matches: int = 200, file: str = "file", text: str = "text") -> DataFrame:
    """The whole answer about the hits of a search (symbol, file, start, end, score, content): part, symbol, at, card.

    discovery has the ten best, references and impact those of their first three symbols, literal the lines that hold the
    name of the best symbol, evidence the hits' contents as far as max_tokens go. Files are read by one scan for that name;
    all parts but it are bounded by their limits, and it by matches."""
    order = [F.col("score").desc(), "file", "start"]
    top = hits.orderBy(*order).limit(50)
    ranked = top.withColumn("at", F.row_number().over(Window.orderBy(*order)))  # 50 rows
    place = lambda r: r.withColumns({"id": ids.result_id(F.col("file"), F.col("start"), F.col("end"), F.col("symbol")), "rank": F.col("at")})
    own = F.struct("id", "file", F.array("start", "end").alias("lines"), F.when(F.col("symbol") != "", F.col("symbol")).alias("symbol"), "rank", F.col("score").alias("relevance"))
    parts = [place(ranked.filter("at <= 10")).select(F.lit("discovery").alias("part"), "symbol", "at", F.to_json(own).alias("card"))]
    used, reached = investigate(top, nodes, edges)
    reached = reached.withColumnRenamed("symbol", "__for")
    parts.append(used.select(F.lit("references").alias("part"), "symbol", F.lit(0).alias("at"), F.to_json(F.struct(F.col("src").alias("fromId"), "kind")).alias("card")))
    parts.append(answers.impact_cards(reached, nodes, F.col("__for").alias("symbol")).select(F.lit("impact").alias("part"), "symbol", F.col("depth").alias("at"), "card"))
    best = ranked.filter(F.coalesce("symbol", F.lit("")) != "").orderBy("at").limit(1).select("symbol").first()
    if best:
        found = lexical.grep(files.withColumnRenamed(file, "file"), best["symbol"], ["file"], text, fixed=True).orderBy("file", "line").limit(matches)
        parts.append(answers.literal_cards(found).select(F.lit("literal").alias("part"), F.lit(best["symbol"]).alias("symbol"), F.col("line").alias("at"), "card"))
    kept = ranking.within_budget(ranked, ranking.tokens_of(F.col("content"), F.col("file"), F.col("symbol")), max_tokens, ["at"])
    parts.append(answers.show_cards(kept, "symbol", "at").select(F.lit("evidence").alias("part"), "symbol", "at", "card"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def token_estimate(content: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(content) / 4)


def capabilities(spark: SparkSession, variants: dict[str, dict[str, str]]) -> DataFrame:
    """name, category, languages of variants (language -> name -> category), by name."""
    rows = [(lang, name, category) for lang, own in variants.items() for name, category in own.items()]
    table = spark.createDataFrame(rows, "language string, name string, category string")
    return table.groupBy("name").agg(F.min("category").alias("category"), F.array_sort(F.collect_set("language")).alias("languages"))
