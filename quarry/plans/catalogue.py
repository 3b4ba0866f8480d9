"""Queries over the test tables, one or more for each operator, with the SQL that gives the same rows.

Every query reads whole tables. A fixed query vector (that of row 0) or a fixed query text is the query's own input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import classify, ids
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import chunking, duplicates, evaluate, graph, groups, knn, lexical, predicate, ranking, render
from quarry.operators.predicate import Condition as C
from quarry.ship import ship
from quarry.sources import embed, files, store
from quarry.streaming import watch

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
QUERY = "license version handler of the nation"


def query(sql: str | None = None):
    """Register a function as the query of its name."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def first_vector(spark: SparkSession, d: str) -> list[float]:
    row = read(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [1.0] + [0.0] * 63


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_SIM = "CASE WHEN list_dot_product(q, q) > 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 THEN list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))) ELSE 0 END"
_KNN = f"SELECT vec_id, label, {_SIM} AS s FROM embeddings, {_Q}"

# vectors


@query(f"SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_KNN}) ORDER BY s DESC, vec_id LIMIT 20")
def knn_topk(spark, d):
    return knn.top_k(read(spark, d, "embeddings"), first_vector(spark, d)).select("vec_id", r6("similarity").alias("similarity"), "rank")


@query(f"SELECT vec_id, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_KNN}) WHERE label IN (1, 2, 3) ORDER BY s DESC, vec_id LIMIT 20")
def knn_filtered(spark, d):
    return knn.top_k(read(spark, d, "embeddings"), first_vector(spark, d), where=F.col("label").isin(1, 2, 3)).select("vec_id", r6("similarity").alias("similarity"), "rank")


@query(f"SELECT label, vec_id, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM ({_KNN})) WHERE rank <= 3")
def knn_per_label(spark, d):
    return knn.per_group(read(spark, d, "embeddings"), first_vector(spark, d), "label").select("label", "vec_id", r6("similarity").alias("similarity"), "rank")


@query(f"SELECT vec_id, round(1 - (1 - s), 6) AS cosine, round(1 - (1 - s) * (1 - s) / 2, 6) AS l2, round(1 - s, 6) + 0.0::DOUBLE AS dot FROM ({_KNN})")
def distance_to_similarity(spark, d):
    q = F.array(*map(F.lit, first_vector(spark, d)))
    distance = F.lit(1.0) - V.cosine(F.col("embedding"), q)
    return read(spark, d, "embeddings").select("vec_id", *(r6(V.similarity_from_distance(distance, m)).alias(m) for m in ("cosine", "l2", "dot")))


@query("SELECT vec_id, round(n, 6) AS norm, round(CASE WHEN n > 0 THEN embedding[1]::DOUBLE / n ELSE embedding[1] END, 6) AS first FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark, d):
    return read(spark, d, "embeddings").select("vec_id", r6(V.norm(F.col("embedding"))).alias("norm"), r6(F.get(V.l2_normalize(F.col("embedding")), 0)).alias("first"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS valid FROM embeddings")
def vector_validation(spark, d):
    return read(spark, d, "embeddings").agg(F.count("*").alias("n"), F.count_if(V.is_valid(F.col("embedding"), 64)).alias("valid"))


_UNIT = "SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / n) AS v FROM (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"


@query(f"WITH u AS ({_UNIT}), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM u a, u b WHERE a.vec_id <> b.vec_id) SELECT a, b, round(s, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM p) WHERE rank <= 3")
def self_knn(spark, d):
    return knn.self_knn(read(spark, d, "embeddings"), 3).select("a", "b", r6("similarity").alias("similarity"), "rank")


_PAIRS = f"WITH u AS ({_UNIT}), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM u a, u b WHERE a.vec_id < b.vec_id AND list_dot_product(a.v, b.v) >= 0.35)"


@query(f"{_PAIRS} SELECT a, b, round(s, 6) AS similarity FROM p")
def similar_pairs(spark, d):
    return knn.similar_pairs(read(spark, d, "embeddings"), 0.35).withColumn("similarity", r6("similarity"))


@query(f"WITH u AS ({_UNIT}), p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b USING (label) WHERE a.vec_id < b.vec_id AND list_dot_product(a.v, b.v) >= 0.3) SELECT a, b, round(s, 6) AS similarity FROM p")
def similar_pairs_blocked(spark, d):
    return knn.similar_pairs(read(spark, d, "embeddings"), 0.3, block="label").withColumn("similarity", r6("similarity"))


@query(f"SELECT count(*) AS n, round(max(s) FILTER (WHERE r = 1), 6) AS first, round(max(s) FILTER (WHERE r = 3), 6) AS third, coalesce(count(*) >= 3 AND max(s) FILTER (WHERE r = 1) >= 0.72 AND max(s) FILTER (WHERE r = 3) >= 0.6, false) AS strong FROM (SELECT s, row_number() OVER (ORDER BY s DESC, vec_id) AS r FROM ({_KNN}) ORDER BY s DESC, vec_id LIMIT 20)")
def evidence_gate(spark, d):
    return knn.strong_evidence(knn.top_k(read(spark, d, "embeddings"), first_vector(spark, d))).select("n", r6("first").alias("first"), r6("third").alias("third"), "strong")


@query("""WITH n AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth FROM documents),
o AS (SELECT doc_id AS old_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS nth FROM documents WHERE source <> 'src0')
SELECT doc_id, old_id FROM n LEFT JOIN o USING (h, nth)""")
def vector_reuse(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), "source")
    old = docs.filter("source <> 'src0'").select("h", F.col("doc_id").alias("old_id"), F.col("doc_id").alias("o"))
    return knn.reuse(docs.select("doc_id", "h"), old, "h", "doc_id", "o", "old_id").select("doc_id", "old_id")


@query(f"SELECT k.vec_id, k.rank, len(e.embedding) AS dimension FROM (SELECT vec_id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_KNN}) ORDER BY s DESC, vec_id LIMIT 20) k JOIN embeddings e USING (vec_id)")
def vector_hydration(spark, d):
    hits = knn.top_k(read(spark, d, "embeddings"), first_vector(spark, d)).select("vec_id", "rank")
    return knn.hydrate(hits, read(spark, d, "embeddings")).select("vec_id", "rank", F.size("embedding").alias("dimension"))


# lines and words

_LINES = "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"


@query(f"SELECT doc_id, line, trim(content) AS content FROM ({_LINES}) WHERE contains(content, 'License')")
def literal_lines(spark, d):
    return lexical.grep(read(spark, d, "documents"), "License", ["doc_id"], fixed=True)


@query(f"SELECT doc_id, line, trim(content) AS content FROM ({_LINES}) WHERE contains(lower(content), 'licensed')")
def literal_ignore_case(spark, d):
    return lexical.grep(read(spark, d, "documents"), "LICENSED", ["doc_id"], fixed=True, ignore_case=True)


@query(f"SELECT count(*) AS matches, count(DISTINCT doc_id) AS files FROM ({_LINES}) WHERE contains(content, 'the')")
def literal_summary(spark, d):
    return lexical.summary(lexical.grep(read(spark, d, "documents"), "the", ["doc_id"], fixed=True), "doc_id")


@query(rf"SELECT doc_id, line, trim(content) AS content FROM ({_LINES}) WHERE regexp_matches(content, '(?i)\bthis\b')")
def regex_lines(spark, d):
    return lexical.grep(read(spark, d, "documents"), T.whole_word("this"), ["doc_id"], ignore_case=True)


def _chunks10(docs: DataFrame) -> DataFrame:
    lines = lexical.lines(docs, "text", "doc_id", "source").withColumn("block", F.floor((F.col("line") - 1) / 4))
    return lines.groupBy("doc_id", "source", "block").agg(F.min("line").alias("start"), F.max("line").alias("end")).select(
        F.col("doc_id").cast("string").alias("file"), F.concat_ws(":", "doc_id", "block").alias("chunk_id"), "start", "end", F.when(F.col("block") % 2 == 0, F.col("source")).otherwise(F.lit("")).alias("symbol")
    )


_C10 = "c AS (SELECT doc_id, (line - 1) // 4 AS block, min(line) AS s, max(line) AS e FROM l GROUP BY ALL)"


@query(f"WITH l AS ({_LINES}), {_C10} SELECT l.doc_id::VARCHAR AS file, l.line, concat(c.doc_id, ':', c.block) AS chunk_id FROM l JOIN c ON l.doc_id = c.doc_id AND l.line BETWEEN c.s AND c.e WHERE contains(l.content, 'the')")
def line_to_chunk(spark, d):
    docs = read(spark, d, "documents")
    found = lexical.grep(docs.withColumn("file", F.col("doc_id").cast("string")), "the", ["file"], fixed=True)
    return lexical.line_to_chunk(found, _chunks10(docs)).select("file", "line", "chunk_id")


@query(f"WITH l AS ({_LINES}), {_C10} SELECT DISTINCT concat(c.doc_id, ':', c.block) AS chunk_id FROM l JOIN c ON l.doc_id = c.doc_id AND l.line BETWEEN c.s AND c.e WHERE contains(l.content, 'License')")
def pattern_semi_join(spark, d):
    docs = read(spark, d, "documents")
    found = lexical.grep(docs.withColumn("file", F.col("doc_id").cast("string")), "License", ["file"], fixed=True)
    return lexical.chunks_with_line(_chunks10(docs), found).select("chunk_id")


_TOK = r"list_filter(string_split_regex(lower(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^A-Za-z0-9]+'), lambda x: x <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query(f"SELECT doc_id, len({_TOK.format('text')}) AS tokens FROM documents")
def token_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.identifier_tokens(F.col("text"))).cast("long").alias("tokens"))


@query(f"SELECT item_id, array_to_string(list_filter({_TOK.format('text')}, lambda x: NOT list_contains({_STOP}, x)), ' ') AS tokens FROM benchmark")
def query_tokens(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(T.tokens_without_stop_words(F.col("text")), " ").alias("tokens"))


def _relevance_sql(tokens: list[str], text: str = "text", path: str = "source") -> str:
    seen = [rf"len(regexp_extract_all(lower({text}), '\b{t}\b'))" for t in tokens]
    in_path = [f"contains(lower({path}), '{t}')::INT" for t in tokens]
    covered = " + ".join(f"({s} > 0 OR {p} > 0)::INT" for s, p in zip(seen, in_path, strict=True))
    weight = " + ".join(f"least({s}, 4) + {p}" for s, p in zip(seen, in_path, strict=True))
    return f"least(1.0::DOUBLE, ({covered}) / {float(len(tokens))}::DOUBLE * 0.7::DOUBLE + least(1.0::DOUBLE, ({weight}) / {float(max(3, 3 * len(tokens)))}::DOUBLE) * 0.3::DOUBLE)"


_TOKENS = T.query_tokens(QUERY)


@query(f"SELECT doc_id, round({_relevance_sql(_TOKENS)}, 6) AS lexical FROM documents")
def lexical_relevance(spark, d):
    return lexical.relevance(read(spark, d, "documents").withColumn("symbol", F.lit("")), QUERY, "text", "symbol", "source").select("doc_id", r6("lexical").alias("lexical"))


_LEX = f"SELECT doc_id, {_relevance_sql(_TOKENS)} AS l FROM documents WHERE regexp_matches(lower(text), '{'|'.join(_TOKENS)}')"


@query(f"SELECT doc_id, round(l, 6) AS lexical, row_number() OVER (ORDER BY l DESC, doc_id) AS rank FROM ({_LEX}) ORDER BY l DESC, doc_id LIMIT 50")
def lexical_topk(spark, d):
    return lexical.retrieve(read(spark, d, "documents"), QUERY, 50, "text", None, "source", "doc_id").select("doc_id", r6("lexical").alias("lexical"), "rank")


# ranking


def _fused(spark, d, k: int = 50) -> DataFrame:
    docs, vectors = read(spark, d, "documents"), read(spark, d, "embeddings")
    semantic = knn.top_k(vectors.join(docs.select("doc_id"), F.col("vec_id") == F.col("doc_id"), "left_semi"), first_vector(spark, d), k).select(F.col("vec_id").alias("doc_id"), "similarity", "rank")
    words = lexical.retrieve(docs, QUERY, k, "text", None, "source", "doc_id").select("doc_id", "lexical", "rank")
    return ranking.fuse(semantic, words, ["doc_id"])


_FUSED = f"""s AS (SELECT vec_id AS doc_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rs FROM ({_KNN}) WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY s DESC, vec_id LIMIT 50),
x AS (SELECT doc_id, l, row_number() OVER (ORDER BY l DESC, doc_id) AS rl FROM ({_LEX}) ORDER BY l DESC, doc_id LIMIT 50),
j AS (SELECT coalesce(s.doc_id, x.doc_id) AS doc_id, greatest(s.s, x.l) AS base, (coalesce(1.0::DOUBLE / (60 + rs), 0) + coalesce(1.0::DOUBLE / (60 + rl), 0)) / (2.0::DOUBLE / 61) AS rrf FROM s FULL JOIN x ON s.doc_id = x.doc_id),
f AS (SELECT doc_id, base, CASE WHEN base > 1 THEN base ELSE least(1, 0.65::DOUBLE * base + 0.35::DOUBLE * rrf) END AS fused FROM j)"""


@query(f"WITH {_FUSED} SELECT doc_id, round(base, 6) AS base, round(fused, 6) AS fused FROM f")
def rrf_fusion(spark, d):
    return _fused(spark, d).select("doc_id", r6("base").alias("base"), r6("fused").alias("fused"))


@query(f"""WITH {_FUSED}, w AS (SELECT f.doc_id, d.source, d.lang, f.fused, row_number() OVER (PARTITION BY d.source ORDER BY round(f.fused, 9) DESC, f.doc_id) AS n FROM f JOIN documents d USING (doc_id)),
t AS (SELECT *, row_number() OVER (ORDER BY round(fused, 9) DESC, doc_id) AS rank FROM w WHERE n <= 2 ORDER BY round(fused, 9) DESC, doc_id LIMIT 10)
SELECT doc_id, source, lang, round(fused, 6) AS score, rank, round((count(*) OVER () - rank + 1)::DOUBLE / count(*) OVER (), 6) AS rank_score FROM t""")
def hybrid_search(spark, d):
    """Flagship: nearest vectors and best words, fused, at most two of a source, ten best."""
    rows = _fused(spark, d).join(read(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id").withColumn("key", F.round("fused", 9))
    best = ranking.diversify(rows, [F.col("key").desc(), F.col("doc_id")], 2, 0, "source").orderBy(F.col("key").desc(), "doc_id").limit(10)
    return ranking.rank_score(best, [F.col("key").desc(), F.col("doc_id")]).select("doc_id", "source", "lang", r6("fused").alias("score"), "rank", "rank_score")


_PATH = "regexp_replace(url, '^[a-z]+://[^/]+/?', '')"


def _paths(spark, d) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+/?", "").alias("path"), "html")


_ROLE = rf"""CASE WHEN regexp_matches(lower(p), '{classify.ROLES[0][1]}') THEN '{classify.ROLES[0][0]}' WHEN regexp_matches(lower(p), '{classify.ROLES[1][1]}') THEN '{classify.ROLES[1][0]}'
 WHEN regexp_matches(lower(p), '{classify.ROLES[2][1]}') THEN '{classify.ROLES[2][0]}' WHEN regexp_matches(lower(p), '{classify.ROLES[3][1]}') THEN '{classify.ROLES[3][0]}' WHEN regexp_matches(lower(p), '{classify.ROLES[4][1]}') THEN '{classify.ROLES[4][0]}'
 WHEN kind = 'config' THEN 'configuration' WHEN kind = 'doc' THEN 'documentation' WHEN regexp_matches(lower(p), '{classify.CONTRACT}') THEN 'contract' ELSE 'implementation' END"""
_KIND = rf"""SELECT page_id, p, ext, CASE WHEN ext IN {classify.CONFIG_EXTENSIONS} OR regexp_matches(b, '^({"|".join(n.replace(".", "[.]") for n in classify.CONFIG_NAMES)})') OR b IN ('package.json', 'package-lock.json') THEN 'config'
 WHEN ext IN {classify.DOC_EXTENSIONS} OR b IN ('changelog', 'readme') OR regexp_matches(b, '^({"|".join(n.replace(".", "[.]") for n in classify.DOC_NAMES)})') THEN 'doc' ELSE 'code' END AS kind
 FROM (SELECT *, lower(regexp_extract(b, '^.+([.][^.]*)$', 1)) AS ext FROM (SELECT page_id, {_PATH} AS p, lower(string_split({_PATH}, '/')[-1]) AS b FROM pages))"""


@query(f"SELECT page_id, ext, kind, {_ROLE} AS role FROM ({_KIND})")
def classify_files(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("page_id", classify.extension(p).alias("ext"), classify.file_kind(p).alias("kind"), classify.file_role(p).alias("role"))


@query(f"SELECT page_id, round(least(1.1, greatest(0, 0.5 + CASE {_ROLE} WHEN 'implementation' THEN 0.05 WHEN 'test' THEN 0.06 WHEN 'contract' THEN 0.02 WHEN 'generated' THEN -0.12 WHEN 'build-artifact' THEN -0.2 ELSE 0 END))::DOUBLE, 6) AS score FROM ({_KIND})")
def role_boost(spark, d):
    rows = _paths(spark, d).withColumn("score", F.lit(0.5))
    return ranking.boost(rows, "score", classify.file_role(F.col("path")), "review").select("page_id", r6("score").alias("score"))


@query(f"""SELECT doc_id, round(greatest(0, least(1, 0.5::DOUBLE * 0.72 + {_relevance_sql(_TOKENS)} * 0.2 + ((CASE WHEN lower(lang) IN ('license', 'version', 'handler', 'of', 'nation') THEN 1 ELSE 0 END)::DOUBLE * 0.7) * 0.08
 + (({" + ".join(f"contains(lower(concat_ws(' ', source, lower(lang), text)), '{t}')::INT::DOUBLE" for t in _TOKENS if t != "handler")}) / 4.0::DOUBLE - 0.5) * 0.1)), 6) AS rerank FROM documents""")
def rerank(spark, d):
    rows = read(spark, d, "documents").withColumns({"score": F.lit(0.5), "exported": F.lit(False), "kind": F.lit("function")})
    return ranking.rerank(rows, QUERY, "score", "text", "lang", "kind", "exported", "source").select("doc_id", r6("rerank").alias("rerank"))


@query(f"""SELECT vec_id, CASE WHEN label = 0 THEN 'high' WHEN label = 1 THEN CASE WHEN s >= 0.55 THEN 'high' ELSE 'medium' END WHEN s >= 0.55 THEN 'high' WHEN s >= 0.25 THEN 'medium' ELSE CASE WHEN label >= 8 AND s > -0.1 THEN 'medium' ELSE 'low' END END AS confidence,
 (CASE WHEN label IN (0, 1) OR s >= 0.25 OR (label >= 8 AND s > -0.1) THEN false ELSE true END) AS weak FROM ({_KNN})""")
def confidence(spark, d):
    q = F.array(*map(F.lit, first_vector(spark, d)))
    rows = read(spark, d, "embeddings").withColumn("s", V.cosine(F.col("embedding"), q))
    no, zero = F.lit(False), F.lit(0)
    level = ranking.confidence(F.col("s"), F.col("label") == 0, F.col("label") == 1, (F.col("label") >= 8).cast("int"), no, no, zero, zero)
    return rows.select("vec_id", level.alias("confidence"), ranking.is_weak(level, F.col("s")).alias("weak"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS m FROM a WHERE n <= 2)
SELECT doc_id, source, lang FROM b WHERE m <= 5""")
def diversify(spark, d):
    return ranking.diversify(read(spark, d, "documents"), [F.col("n_chars").desc(), F.col("doc_id")], 2, 5, "source", "lang").select("doc_id", "source", "lang")


@query("""SELECT source, doc_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY f DESC, n_chars DESC, doc_id) AS pick FROM (SELECT *, (row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1)::INT AS f FROM documents)) WHERE pick <= 3""")
def representatives(spark, d):
    return ranking.representatives(read(spark, d, "documents"), "source", 3, "n_chars", "lang", "doc_id").select("source", "doc_id", "pick")


@query("""WITH t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM conversations),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR turn > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM t)
SELECT conv_id, role, island::BIGINT AS island, min(turn) AS start, max(turn) AS "end", count(*) AS chunks FROM i GROUP BY ALL""")
def symbol_islands(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "role", F.col("turn").alias("start"), F.col("turn").alias("end"), F.col("turn").alias("id"))
    return ranking.islands(rows, ["conv_id", "role"], 1).groupBy("conv_id", "role", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("chunks"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, greatest(1, ceil((length(text) + length(conv_id::VARCHAR) + length(role) + 80) / 4.0))::INT AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
k AS (SELECT conv_id, turn, n, cost AS used, true AS kept FROM c WHERE n = 1
 UNION ALL SELECT c.conv_id, c.turn, c.n, CASE WHEN k.used < 150 AND k.used + c.cost <= 150 THEN k.used + c.cost ELSE k.used END, k.used < 150 AND k.used + c.cost <= 150 FROM k JOIN c ON c.conv_id = k.conv_id AND c.n = k.n + 1)
SELECT conv_id, turn FROM k WHERE kept""")
def token_budget(spark, d):
    rows = read(spark, d, "conversations")
    cost = ranking.tokens_of(F.col("text"), F.col("conv_id").cast("string"), F.col("role"))
    return ranking.within_budget(rows, cost, 150, ["turn"], ["conv_id"]).select("conv_id", "turn")


@query("SELECT item_id FROM (SELECT item_id, sum(length(text)) OVER (ORDER BY item_id ROWS UNBOUNDED PRECEDING) AS s FROM benchmark) WHERE s <= 2000")
def byte_budget(spark, d):
    return ranking.prefix_budget(read(spark, d, "benchmark"), F.length("text"), 2000, ["item_id"]).select("item_id")


@query("SELECT source, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents GROUP BY source")
def token_estimates(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.sum(evaluate.token_estimate(F.col("text"))).alias("tokens"))


# predicates


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH') AND NOT (o_custkey < 10)")
def filter_all_any_none(spark, d):
    df = read(spark, d, "orders")
    p = predicate.Predicate([C("o_totalprice", "at_least", 100000), C("o_orderstatus", "not_equals", "F"), C("bad name", "equals", 1)], [[C("o_orderpriority", "equals", "1-URGENT"), C("o_orderpriority", "equals", "2-HIGH")]], [C("o_custkey", "less_than", 10)])
    return p.where(df).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND starts_with(p_type, 'S') AND NOT ends_with(p_brand, '1')")
def filter_strings(spark, d):
    return predicate.Predicate([C("p_name", "contains", "a"), C("p_type", "starts_with", "S")], [], [C("p_brand", "ends_with", "1")]).where(read(spark, d, "part")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_brand LIKE '%#1_%'")
def filter_like(spark, d):
    return predicate.Predicate([C("p_brand", "contains", "#1_")]).where(read(spark, d, "part"), compat=True).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3) AND c_acctbal > 0 AND c_acctbal <= 5000")
def filter_in(spark, d):
    p = predicate.Predicate([C("c_mktsegment", "in", ["BUILDING", "MACHINERY"]), C("c_nationkey", "not_in", [1, 2, 3]), C("c_acctbal", "greater_than", 0), C("c_acctbal", "at_most", 5000), C("c_name", "in", [])])
    return p.where(read(spark, d, "customer")).select("c_custkey")


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1'")
def filter_equality_map(spark, d):
    return predicate.equality({"lang": "en", "source": "src1"}).where(read(spark, d, "documents")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(concat(source, '/', doc_id, '.txt'), '^src1[^/]*/[^/]*\\.txt$') AND NOT regexp_matches(concat(source, '/', doc_id, '.txt'), '(^|/)[^/]*7\\.txt$')")
def glob_filter(spark, d):
    f = files.documents_as_files(read(spark, d, "documents"))
    return f.filter(predicate.in_scope(F.col("path"), ["src1*/*.txt"], ["*7.txt"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE source = 'src3'")
def directory_scope(spark, d):
    f = files.documents_as_files(read(spark, d, "documents"))
    return f.filter(predicate.in_scope(F.col("path"), under="SRC3")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def changed_filter(spark, d):
    f = files.documents_as_files(read(spark, d, "documents")).withColumnRenamed("path", "file")
    changed = f.join(read(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select(F.col("file").alias("path"))
    return predicate.changed_only(f, changed).select("doc_id")


@query("SELECT seg AS value, 'BUILDING' AS suggestion, levenshtein(lower(seg), 'building') AS distance FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer) WHERE levenshtein(lower(seg), 'building') <= levenshtein(lower(seg), 'zzzzzzzzzzzzzzzz')")
def nearest_names(spark, d):
    values = read(spark, d, "customer").select(F.col("c_mktsegment").alias("value")).distinct()
    return predicate.nearest_names(values, spark.createDataFrame([("BUILDING",), ("ZZZZZZZZZZZZZZZZ",)], "name string"))


@query(f"SELECT doc_id, source, concat('r:', translate(rtrim(base64(encode(concat(source, chr(0), '1', chr(0), len(string_split(text, chr(10))), chr(0), lang))), '='), '+/', '-_')) AS id FROM documents")
def result_id(spark, d):
    n = F.size(F.split("text", "\n"))
    return read(spark, d, "documents").select("doc_id", "source", ids.result_id(F.col("source"), F.lit(1), n, F.col("lang")).alias("id"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS text, least(4, len(string_split(text, chr(10)))) AS \"end\" FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def show_slice(spark, d):
    docs = read(spark, d, "documents")
    f = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    wanted = docs.filter(F.size(F.split("text", "\n")) >= 2).select(ids.result_id(F.col("doc_id").cast("string"), F.lit(2), F.lit(3), F.lit("")).alias("result"))
    return render.show(wanted, f, 0, 1).select(F.col("file").cast("long").alias("doc_id"), "text", F.col("end").cast("long").alias("end"))


@query("SELECT doc_id, round(greatest(0, least(1, n_chars / 5000.0))::DOUBLE, 6) AS score FROM documents")
def structured_projection(spark, d):
    rows = render.structured(read(spark, d, "documents"), F.col("n_chars") / 5000, F.col("source"), F.lit(1), F.lit(2), F.col("lang"), doc_id=F.col("doc_id"))
    return rows.select("doc_id", "score")


@query("SELECT count(*) AS n, 'WARNING' AS code FROM events")
def warning_codes(spark, d):
    return read(spark, d, "events").select(render.warning_code(F.col("event_type")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# groups, duplicates


@query(f"SELECT lang, array_to_string(list(v ORDER BY r), ' ') AS top FROM (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, v) AS r FROM (SELECT lang, unnest({_TOK.format('text')}) AS v FROM documents) GROUP BY lang, v) WHERE r <= 3 GROUP BY lang")
def top_counts(spark, d):
    return groups.top_counts(read(spark, d, "documents"), ["lang"], T.identifier_tokens(F.col("text"))).select("lang", F.array_join("top", " ").alias("top"))


_SEG = "list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.' AND NOT list_contains(['src', 'lib', 'app', 'packages', 'package', 'backend', 'frontend'], lower(x)))"
_DOMAIN = "CASE " + " ".join(f"WHEN list_has_any(list_transform(seg, lambda x: lower(x)), {list(names)}) THEN '{label}'" for label, names, _ in T.DOMAINS) + " WHEN len(seg) = 0 THEN 'related code' ELSE concat('domain / ', regexp_replace(CASE WHEN len(seg) >= 2 THEN seg[len(seg) - 1] ELSE seg[1] END, '[-_]', ' ', 'g')) END"


@query(f"SELECT page_id, {_DOMAIN} AS label FROM (SELECT page_id, {_SEG} AS seg FROM (SELECT page_id, {_PATH} AS p FROM pages))")
def domain_label(spark, d):
    return _paths(spark, d).select("page_id", T.domain_label(F.col("path")).alias("label"))


@query("SELECT source AS title, sum(n_chars)::BIGINT AS score, count(*) AS n, count(DISTINCT lang) AS files, row_number() OVER (ORDER BY sum(n_chars) DESC, count(DISTINCT lang) DESC, count(*) DESC, source) AS place FROM documents GROUP BY source")
def survey_groups(spark, d):
    rows = read(spark, d, "documents").withColumn("file", F.concat_ws("/", "source", F.concat("lang", F.lit(".txt"))))
    found = groups.survey(rows, "", "file", "n_chars", "lang")
    return found.select(F.regexp_replace("title", "^domain / ", "").alias("title"), "score", "n", "files", "place")


_COMPONENTS = f"""{_PAIRS.replace("WITH u", "WITH RECURSIVE u")}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), c AS (SELECT node, min(other) AS component FROM r GROUP BY node)"""


@query(f"{_COMPONENTS} SELECT node, component FROM c")
def cluster_components(spark, d):
    return graph.components(knn.similar_links(read(spark, d, "embeddings"), 0.35))


@query(f"{_COMPONENTS}, m AS (SELECT e.vec_id, e.label, coalesce(c.component, e.vec_id) AS cluster FROM embeddings e LEFT JOIN c ON e.vec_id = c.node), g AS (SELECT cluster, count(*) AS n, count(DISTINCT label) AS files, avg(label) AS score FROM m GROUP BY cluster) SELECT cluster, n, files, round(score, 6) AS score, round(score * log2(n + 1), 6) AS weight FROM g")
def cluster_rank(spark, d):
    vectors = read(spark, d, "embeddings")
    found = groups.clusters(knn.similar_links(vectors, 0.35), vectors.select(F.col("vec_id").alias("id")), 0.35, attach=False)
    members = found.join(vectors.select(F.col("vec_id").alias("id"), "label"), "id")
    return groups.cluster_summary(members, "label", "label").select("cluster", "n", "files", r6("score").alias("score"), r6("weight").alias("weight"))


_BIG = r"regexp_extract_all(trim(regexp_replace({0}, '\s+', ' ', 'g')), '[A-Za-z_$][A-Za-z0-9_$]*|\d+|[^\s]')"


@query(f"""WITH t AS (SELECT doc_id, source, lang, text, {_BIG.format("text")} AS k FROM documents), b AS (SELECT *, list_distinct(list_transform(range(1, len(k)), lambda i: concat(k[i], ' ', k[i + 1]))) AS g FROM t),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN len(x.k) = 0 OR len(y.k) = 0 THEN NULL WHEN x.text = y.text THEN 1 WHEN len(x.g) = 0 OR len(y.g) = 0 THEN 0
 ELSE len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) * sqrt(least(len(x.k), len(y.k))::DOUBLE / greatest(len(x.k), len(y.k))) END AS s
 FROM b x JOIN b y ON x.source = y.source AND x.lang = y.lang AND len(x.k) // 50 = len(y.k) // 50 AND x.doc_id < y.doc_id) SELECT a, b, round(s, 6) AS similarity FROM p""")
def duplicate_text_similarity(spark, d):
    found = duplicates.block_similarities(read(spark, d, "documents"), ["source", "lang"])
    return found.select("a", "b", r6("similarity").alias("similarity"))


@query(f"""WITH t AS (SELECT doc_id, text, {_BIG.format("text")} AS k FROM documents WHERE text IS NOT NULL), b AS (SELECT *, list_distinct(list_transform(range(1, len(k)), lambda i: hash(concat(k[i], ' ', k[i + 1])))) AS g FROM t WHERE len(k) > 0),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, CASE WHEN x.text = y.text THEN 1 ELSE len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) * sqrt(least(len(x.k), len(y.k))::DOUBLE / greatest(len(x.k), len(y.k))) END AS s
 FROM b x JOIN b y ON x.doc_id < y.doc_id AND 10 * least(len(x.g), len(y.g)) >= 7 * greatest(len(x.g), len(y.g)) WHERE x.text = y.text OR (len(x.g) > 0 AND len(y.g) > 0)) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.7""")
def duplicate_text_pairs(spark, d):
    """Text similarity over the whole table, without the blocks that duplicate_text_similarity has from its SQL."""
    return duplicates.text_pairs(read(spark, d, "documents")).withColumn("similarity", r6("similarity"))


@query(_SQL["duplicate_text_pairs"].rsplit(" SELECT a, b", 1)[0] + ", m AS (SELECT a.doc_id AS id, min(b.doc_id) AS rep FROM b AS a JOIN b ON a.text = b.text GROUP BY a.doc_id) SELECT a AS u, b AS v, round(s, 6) AS similarity FROM p WHERE s >= 0.7 AND a IN (SELECT rep FROM m) AND b IN (SELECT rep FROM m) UNION ALL SELECT rep, id, 1 FROM m WHERE rep <> id")
def duplicate_text_links(spark, d):
    """The pairs of different texts, one row of each text standing for its copies, and the copies: a row each."""
    near, member = duplicates.text_links(read(spark, d, "documents"))
    copies = member.filter("rep <> id").select(F.col("rep").alias("u"), F.col("id").alias("v"), F.lit(1.0).alias("similarity"))
    return near.unionByName(copies).withColumn("similarity", r6("similarity"))


@query(f"{_PAIRS} SELECT CASE WHEN s >= 0.5 THEN 'exact' WHEN s >= 0.45 THEN 'high' WHEN s >= 0.4 THEN 'medium' WHEN s >= 0.35 THEN 'low' END AS level, count(*) AS n FROM p GROUP BY ALL")
def duplicate_levels(spark, d):
    found = knn.similar_pairs(read(spark, d, "embeddings"), 0.35)
    return found.groupBy(duplicates.level(F.col("similarity"), {"exact": 0.5, "high": 0.45, "medium": 0.4, "low": 0.35}).alias("level")).agg(F.count("*").alias("n"))


def _as_chunks(spark, d) -> DataFrame:
    docs, vectors = read(spark, d, "documents"), read(spark, d, "embeddings")
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left")  # a document without a vector stays
    return joined.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("doc_id").alias("start"), (F.col("doc_id") + F.size(F.split("text", "\n"))).alias("end"), F.lit("function").alias("symbol_type"), F.col("lang").alias("symbol"), F.col("text").alias("content"), F.col("lang").alias("language"), F.lit(1).alias("complexity"), "embedding")


@query()
def duplicate_groups(spark, d):
    rows = duplicates.candidates(_as_chunks(spark, d), least_lines=1)
    found = duplicates.groups(duplicates.pairs(rows, 0.7), rows)
    return found.withColumns({"members": F.array_join("members", ","), "symbols": F.array_join("symbols", ",")})


# chunks, files, index


@query()
def text_chunks(spark, d):
    return chunking.chunk_files(files.documents_as_files(read(spark, d, "documents"))).select("file", "chunk_index", "start", "end", F.length("content").alias("chars"))


@query("""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
s AS (SELECT *, greatest(0, least(384, 8795 - length(text), floor(ceil(length(text) / 4.0) * 0.15::DOUBLE)::INT * 4)) AS n FROM t)
SELECT conv_id, turn, CASE WHEN b IS NOT NULL AND n > 0 AND b <> '' THEN concat('...', right(b, n), chr(10), chr(10), text) ELSE text END AS overlapped FROM s""")
def chunk_overlap(spark, d):
    lim = chunking.limits()
    assert lim.max == 8800 - 5 + 5 and lim.overlap == 384
    return chunking.with_overlap(read(spark, d, "conversations"), lim, "conv_id", "turn", "text").select("conv_id", "turn", "overlapped")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.h IS NULL THEN 'added' WHEN a.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS status FROM (SELECT doc_id, md5(text) AS h FROM documents WHERE lang <> 'es') a FULL JOIN (SELECT doc_id, md5(CASE WHEN source = 'src2' THEN lower(text) ELSE text END) AS h FROM documents WHERE source <> 'src0') b ON a.doc_id = b.doc_id")
def file_diff(spark, d):
    return store.difference(*_versions(spark, d), "doc_id", "hash")


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = read(spark, d, "documents")
    now = docs.filter("lang <> 'es'").select("doc_id", F.md5("text").alias("hash"))
    before = docs.filter("source <> 'src0'").select("doc_id", F.md5(F.when(F.col("source") == "src2", F.lower("text")).otherwise(F.col("text"))).alias("hash"))
    return now, before


_DIFF = _SQL["file_diff"]


@query(f"WITH x AS ({_DIFF}), w AS (SELECT count(*) AS chunks, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents WHERE lang <> 'es' AND doc_id IN (SELECT doc_id FROM x WHERE status IN ('added', 'changed'))) SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'changed') AS changed, count(*) FILTER (WHERE status = 'removed') AS removed, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, any_value(w.chunks) AS chunks, any_value(w.tokens) AS tokens, ceil(any_value(w.chunks) / 256.0)::BIGINT AS requests FROM x, w")
def index_plan(spark, d):
    now, before = (v.withColumnRenamed("doc_id", "path") for v in _versions(spark, d))
    chunks = read(spark, d, "documents").filter("lang <> 'es'").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    return store.plan(now, before, chunks)


@query(f"WITH x AS ({_DIFF}) SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'removed') AS removed, (SELECT count(*) FROM documents WHERE source <> 'src0') AS expected, (SELECT count(*) FROM labels) AS there, false AS fresh FROM x")
def index_freshness(spark, d):
    now, before = (v.withColumnRenamed("doc_id", "path") for v in _versions(spark, d))
    return store.freshness(now, before.withColumn("chunks", F.lit(1)), read(spark, d, "labels")).select("added", "removed", "expected", "there", "fresh")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def coverage_anti_join(spark, d):
    return store.missing_rows(read(spark, d, "documents"), read(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id::VARCHAR AS file FROM documents WHERE source = 'src1' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def uncovered_files(spark, d):
    changed = read(spark, d, "documents").filter("source = 'src1'").select(F.col("doc_id").cast("string").alias("path"))
    return render.uncovered(changed, read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("file")))


@query("SELECT doc_id, (n >= 50000 AND (k <= 5 OR m >= 20000 OR (ceil(n / k) >= 2000 AND m >= 10000))) AS minified FROM (SELECT doc_id, length(text) AS n, len(string_split(text, chr(10)))::DOUBLE AS k, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS m FROM documents)")
def minified_guard(spark, d):
    return read(spark, d, "documents").select("doc_id", classify.is_minified(F.col("source"), F.col("text")).alias("minified"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, d):
    return read(spark, d, "documents").filter("lang = 'en'").select("doc_id").subtract(read(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE toxic = 0")
def set_intersection(spark, d):
    return read(spark, d, "documents").filter("lang = 'en'").select("doc_id").intersect(read(spark, d, "labels").filter("toxic = 0").select("doc_id"))


# graphs


def _links(spark, d) -> DataFrame:
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1))
    return read(spark, d, "pages").select(F.col("page_id").cast("string").alias("src"), F.explode(found).alias("dst"))


@query("""WITH e AS (SELECT DISTINCT page_id::VARCHAR AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst FROM pages), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY dst), o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY src)
SELECT coalesce(i.node, o.node) AS node, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM i FULL JOIN o ON i.node = o.node""")
def graph_degree(spark, d):
    return graph.degree(_links(spark, d))


def _similar_graph(spark, d) -> DataFrame:
    return knn.similar_pairs(read(spark, d, "embeddings"), 0.35).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _start(spark) -> DataFrame:
    return spark.createDataFrame([(i,) for i in (1, 5, 9)], "node long")


@query(f"{_PAIRS} SELECT a AS src, b AS dst FROM p WHERE b IN (300, 400, 450) ORDER BY 1, 2")
def graph_references(spark, d):
    return graph.references(_similar_graph(spark, d), spark.createDataFrame([(i,) for i in (300, 400, 450)], "node long")).select("src", "dst")


@query(f"{_PAIRS.replace('WITH u', 'WITH RECURSIVE u')}, r AS (SELECT unnest([300, 400, 450])::BIGINT AS node, 0 AS depth UNION SELECT p.a, r.depth + 1 FROM r JOIN p ON p.b = r.node WHERE r.depth < 3) SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) > 0 ORDER BY depth, node LIMIT 200")
def graph_impact(spark, d):
    return graph.impact(_similar_graph(spark, d), spark.createDataFrame([(i,) for i in (300, 400, 450)], "node long"))


@query(f"{_PAIRS.replace('WITH u', 'WITH RECURSIVE u')}, r AS (SELECT unnest([1, 5, 9])::BIGINT AS node, 0 AS depth UNION SELECT p.b, r.depth + 1 FROM r JOIN p ON p.a = r.node WHERE r.depth < 4) SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) > 0")
def graph_reach(spark, d):
    return graph.reach(_similar_graph(spark, d), _start(spark), 4)


@query(f"""{_PAIRS.replace("WITH u", "WITH RECURSIVE u")}, e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r AS (SELECT a AS node, [a] AS path FROM (SELECT min(a) AS a FROM p) UNION ALL SELECT e.b, list_append(r.path, e.b) FROM r JOIN e ON e.a = r.node WHERE len(r.path) <= 4 AND NOT list_contains(r.path, e.b)),
g AS (SELECT path FROM r WHERE node = (SELECT max(node) FROM r)) SELECT array_to_string(path, '>') AS path, len(path) - 1 AS length FROM g WHERE len(path) = (SELECT min(len(path)) FROM g) ORDER BY path LIMIT 1""")
def graph_trace(spark, d):
    half = graph.written(_similar_graph(spark, d))
    edges = half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    start = half.agg(F.min("src").alias("node"))
    goal = graph.reach(edges, start, 4).agg(F.max("node").alias("node"))
    return graph.trace(edges, start, goal, 4).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


# evaluation, events


@query(f"""WITH h AS (SELECT lang AS query, row_number() OVER (PARTITION BY lang ORDER BY round({_relevance_sql(_TOKENS)}, 9) DESC, doc_id) AS rank, doc_id AS item FROM documents), t AS (SELECT * FROM h WHERE rank <= 10),
n AS (SELECT DISTINCT d.lang AS query, l.doc_id AS item FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1), m AS (SELECT t.*, n.item IS NOT NULL AS good FROM t LEFT JOIN n ON t.query = n.query AND t.item = n.item),
g AS (SELECT query, count(DISTINCT rank) AS hits, count(DISTINCT rank) FILTER (WHERE good) AS relevant, count(DISTINCT item) FILTER (WHERE good) AS found, min(rank) FILTER (WHERE good) AS first_rank FROM m GROUP BY query), w AS (SELECT query, count(*) AS demanded FROM n GROUP BY query)
SELECT g.query, hits, relevant, found, demanded, first_rank, round(found::DOUBLE / demanded, 6) AS recall, round(relevant::DOUBLE / hits, 6) AS precision, found = demanded AS passed FROM g JOIN w ON g.query = w.query""")
def eval_recall(spark, d):
    docs = read(spark, d, "documents")
    scored = lexical.relevance(docs.withColumn("symbol", F.lit("")), QUERY, "text", "symbol", "source").withColumn("key", F.round("lexical", 9))
    hits = scored.select(F.col("lang").alias("query"), F.row_number().over(Window.partitionBy("lang").orderBy(F.col("key").desc(), "doc_id")).alias("rank"), F.col("doc_id").alias("item"))
    need = read(spark, d, "labels").filter("quality = 1").join(docs.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"))
    return evaluate.scores(hits, need).withColumns({"recall": r6("recall"), "precision": r6("precision")})


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return watch.windows(read(spark, d, "events"), by=["event_type"]).withColumn("total", F.round("total", 4))


@query("SELECT w AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY w")
def event_windows_sliding(spark, d):
    return watch.windows(read(spark, d, "events"), "2 days", "1 day").select("start", "n")


@query("""WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM b GROUP BY user_id, s""")
def event_sessions(spark, d):
    return watch.sessions(read(spark, d, "events"))


@query("SELECT user_id, ts, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_state(spark, d):
    return watch.latest_state(read(spark, d, "events")).select("user_id", "ts", "event_id", "event_type")


#: Counted columns, of which Spark makes integers and SQL makes longs.
_LONGS = ("rank", "dimension", "line", "pick", "distance", "place", "length", "first_rank")


def _with_longs(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c: F.col(c).cast("long") for c in _LONGS if c in df.columns})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry.plans import more  # noqa: F401  registers its own

    return {name: _with_longs(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from quarry.plans import more  # noqa: F401  registers its own

    return dict(_SQL)
