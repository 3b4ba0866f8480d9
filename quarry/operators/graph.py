"""Symbol graphs: nodes, edges, references, impact, paths and connected components, by joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import ranking

# Words before a parenthesis that are no calls.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "super", "import")
MAX_IMPACT, IMPACT_DEPTH, TRACE_DEPTH = 200, 3, 6


def written(df: DataFrame) -> DataFrame:
    """df written and read again: ends the lineage of a loop. The folder is spark.checkpoint.dir, or on a local master our own."""
    spark: SparkSession = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quarry.loops.dir", None)
    if top is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        spark.conf.set("spark.quarry.loops.dir", top)
    folder = f"{top.rstrip('/')}/loops-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody looks for the mark
    gone_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


@lru_cache(maxsize=64)
def gone_at_exit(spark: SparkSession, folder: str) -> None:
    """Have a folder that is there removed when the application ends, by which time its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def calls(chunks: DataFrame) -> Column:
    """Call names of a chunk: the stored list, else every name before a parenthesis but keywords and the chunk's own symbol."""
    seen = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_$])([A-Za-z_$][A-Za-z0-9_$]*)\s*\("), 1))
    guessed = F.array_except(seen, F.array(*map(F.lit, NOT_CALLS), F.coalesce("symbol", F.lit(""))))
    if "calls" not in chunks.columns:
        return guessed
    stored = F.filter(F.transform(F.split(F.coalesce("calls", F.lit("")), ","), lambda t: F.trim(t)), lambda c: c != "")
    return F.when(F.size(stored) > 0, F.array_distinct(stored)).otherwise(guessed)


def edge_kind(target: Column, content: Column) -> Column:
    """What an edge is by the target's name, and for scheduled functions by the whole content; the first that fits."""
    return (
        F.when(target.rlike(r"^(api|internal)\."), "convex-api")
        .when(content.rlike(r"(?<![A-Za-z0-9_])(scheduler|runAfter|runAt|cron)(?![A-Za-z0-9_])"), "scheduled-function")
        .when(target.rlike("(?i)^(fetch|navigate|redirect|router|push|replace)$"), "route-invocation")
        .when(target.rlike("^use[A-Z0-9_]"), "hook-usage")
        .when(target.rlike("^[A-Z][A-Za-z0-9_$]*$") & content.rlike(r"<\s*[A-Z]"), "component-usage")
        .otherwise("call")
    )


def nodes(chunks: DataFrame) -> DataFrame:
    """node, name, file, start, end: one for every run of neighbouring chunks (gap 1) of a file, parent and symbol."""
    named = chunks.filter(F.coalesce("symbol", F.lit("")) != "").withColumn("parent", F.coalesce("parent", F.lit("")))
    merged = ranking.islands(named, ["file", "parent", "symbol"], 1, order="chunk_id").groupBy("file", "parent", "symbol", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    node = F.concat_ws(":", "file", "start", "end", "symbol")
    return merged.select(node.alias("node"), F.col("symbol").alias("name"), "file", "parent", "start", "end")


def placed(chunks: DataFrame, n: DataFrame) -> DataFrame:
    """chunks with src: the node that each is of, or a name of its own place where it has no symbol."""
    own = n.select(F.col("node").alias("src"), F.col("file").alias("nf"), F.col("parent").alias("np"), F.col("name").alias("ns"), F.col("start").alias("n0"), F.col("end").alias("n1"))
    c = chunks.withColumn("parent", F.coalesce("parent", F.lit(""))).withColumn("symbol", F.coalesce("symbol", F.lit("")))
    out = c.join(own, (c["file"] == own["nf"]) & (c["parent"] == own["np"]) & (c["symbol"] == own["ns"]) & c["start"].between(F.col("n0"), F.col("n1")), "left")
    return out.withColumn("called", calls(c)).withColumn("src", F.coalesce("src", F.concat_ws(":", "file", "start", "end", F.lit(""))))


def wanted(chunks: DataFrame) -> DataFrame:
    """src, file, target, kind: what placed chunks call and extend, by name."""
    called = chunks.select("src", "file", F.explode("called").alias("target"), "content").select("src", "file", "target", edge_kind(F.col("target"), F.col("content")).alias("kind"))
    bases = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_])extends\s+([A-Za-z_$][A-Za-z0-9_$]*)"), 1))
    return called.unionByName(chunks.select("src", "file", F.explode(bases).alias("target"), F.lit("inheritance").alias("kind"))).distinct()


def made(chunks: DataFrame) -> DataFrame:
    """src, file, dst, kind: tables and modules that placed chunks use, which are nodes by themselves."""
    tables = F.transform(F.regexp_extract_all("content", F.lit(r"(?<![A-Za-z0-9_])db\.(?:query|insert|patch|replace|delete|get)\s*\(\s*[\"']([^\"']+)[\"']"), 1), lambda t: F.concat(F.lit("table:"), t))
    out = chunks.select("src", "file", F.explode(tables).alias("dst"), F.lit("schema-table").alias("kind"))
    if "imports" in chunks.columns:
        modules = F.filter(F.transform(F.split(F.coalesce("imports", F.lit("")), ","), lambda t: F.trim(t)), lambda i: i != "")
        out = out.unionByName(chunks.select("src", "file", F.explode(F.transform(modules, lambda i: F.concat(F.lit("module:"), i))).alias("dst"), F.lit("import").alias("kind")))
    return out


def last_part(target: str = "target") -> Column:
    """The name behind the last dot."""
    return F.element_at(F.split(target, "[.]"), -1)


def resolved(wants: DataFrame, definitions: DataFrame) -> DataFrame:
    """wants with n2 (definitions of the name that counts), dst and confidence: the one definition of a name (high), or
    the only one in the same file (medium); null where there is none or more. definitions: node, name, file."""
    names = definitions.groupBy("name").agg(F.count("*").alias("n"), F.min("node").alias("only"))
    in_file = definitions.groupBy("name", "file").agg(F.count("*").alias("n_here"), F.min("node").alias("here"))
    full = wants.join(names.select(F.col("name").alias("target"), "n", "only"), "target", "left").withColumn("key", F.when(F.col("n").isNotNull() | (F.col("kind") == "inheritance"), F.col("target")).otherwise(last_part()))
    last = names.select(F.col("name").alias("key"), F.col("n").alias("n2"), F.col("only").alias("only2"))
    full = full.join(last, "key", "left").join(in_file.withColumnRenamed("name", "key"), ["key", "file"], "left")
    return full.withColumn("dst", F.when(F.col("n2") == 1, F.col("only2")).when(F.col("n_here") == 1, F.col("here"))).withColumn("confidence", F.when(F.col("n2") == 1, "high").when(F.col("n_here") == 1, "medium"))


def joined(found: DataFrame, own: DataFrame, *by: str) -> DataFrame:
    """src, dst, kind, confidence (and by) of what was resolved and made, each edge once."""
    every = found.filter("dst IS NOT NULL AND dst <> src").select(*by, "src", "dst", "kind", "confidence").unionByName(own.select(*by, "src", "dst", "kind", F.lit("high").alias("confidence")))
    return every.groupBy(*by, "src", "dst", "kind").agg(F.min("confidence").alias("confidence"))


def extra_nodes(own: DataFrame) -> DataFrame:
    return own.select(F.col("dst").alias("node"), F.col("dst").alias("name"), F.col("dst").alias("file"), F.lit("").alias("parent"), F.lit(0).alias("start"), F.lit(0).alias("end")).distinct()


def metrics(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: resolved, unresolved, ambiguous, coverage. missing has one row of the middle two."""
    totals = edges.agg(F.count("*").alias("resolved")).join(missing, how="cross")  # one row each
    coverage = F.when(F.col("resolved") + F.col("unresolved") + F.col("ambiguous") == 0, F.lit(1.0)).otherwise(F.col("resolved") / (F.col("resolved") + F.col("unresolved") + F.col("ambiguous")))
    return totals.withColumn("coverage", coverage)


def missing(found: DataFrame, *by: str) -> DataFrame:
    """unresolved and ambiguous (for each by) of resolved wants."""
    counts = F.count_if(F.col("dst").isNull() & (F.coalesce("n2", F.lit(0)) == 0)).alias("unresolved"), F.count_if(F.col("dst").isNull() & (F.col("n2") > 1)).alias("ambiguous")
    return found.groupBy(*by).agg(*counts) if by else found.agg(*counts)


def build(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges (src, dst, kind, confidence) and one row of metrics.

    A call goes to the one definition of its name (high), or to the only one in the same file (medium); several make it
    ambiguous, none unresolved. Superclasses resolve likewise; imports and tables have nodes of their own. chunks:
    chunk_id, file, start, end, symbol, parent, content and, if there, calls and imports.
    """
    n = written(nodes(chunks))
    at = placed(chunks, n)
    own, found = made(at), resolved(wanted(at), n)
    edges = joined(found, own)
    return n.unionByName(extra_nodes(own)), edges, metrics(edges, missing(found))


def extracted(rows: DataFrame, src: str, content: str, pattern: str) -> DataFrame:
    """src, dst: what the first group of a pattern finds in each row's content, each once."""
    found = F.array_distinct(F.regexp_extract_all(content, F.lit(pattern), 1))
    return rows.select(F.col(src).cast("string").alias("src"), F.explode(found).alias("dst")).distinct()


def references(edges: DataFrame, targets: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges into the nodes of targets(node), in order; the first ``limit`` of them if it is given."""
    found = edges.join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").orderBy("src", "dst")
    return found if limit is None else found.limit(limit)


def selected(n: DataFrame, file: str, start: int, end: int, symbol: str | None = None) -> DataFrame:
    """Nodes of a file that overlap a range of lines, of that symbol if one is given."""
    inside = (F.col("file") == file) & (F.col("start") <= end) & (F.col("end") >= start)
    return n.filter(inside & (F.col("name") == symbol) if symbol else inside)


def reach(edges: DataFrame, start: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """node, depth of all nodes that a walk along (or against) the edges reaches in at most depth steps, at its first; start is not among them."""
    src, dst = ("dst", "src") if reverse else ("src", "dst")
    step = written(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")))  # every round reads it, and drops what it meets twice
    seen = written(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        following = frontier.join(step, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = written(following.withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = written(seen.unionByName(frontier))
    return seen.filter("depth > 0")


def impact(edges: DataFrame, start: DataFrame, depth: int = IMPACT_DEPTH, limit: int = MAX_IMPACT) -> DataFrame:
    """What depends on start, nearest first."""
    return reach(edges, start, depth, reverse=True).orderBy("depth", "node").limit(limit)


def trace(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int = TRACE_DEPTH) -> DataFrame:
    """path, length: a shortest walk from start to goal of at most depth steps, the smallest by its nodes; none if there is none.

    Every node keeps only its smallest shortest path, so a round has at most one row a node.
    """
    step = written(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")))  # every round reads it, and keeps one path a node
    seen = written(start.select("node").distinct().withColumn("path", F.array("node")))
    frontier = seen
    for d in range(depth + 1):
        hit = frontier.join(goal.select("node").distinct(), "node", "left_semi")
        if d == depth or not hit.isEmpty():
            return hit.select("path", (F.size("path") - 1).alias("length")).orderBy("path").limit(1)
        following = frontier.join(step, "node").select(F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        frontier = written(following.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
        seen = written(seen.unionByName(frontier))
    return seen.limit(0)


def components(pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of pairs(a, b): labels go along the edges and jump to their label's label, until none changes."""
    edges = written(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        parent = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = written(lower.join(parent, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"), "was"))
        labels = jumped.select("node", "component")
        if jumped.filter("component <> was").isEmpty():
            return labels


def degree(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    return out.join(into, "node", "full_outer").select("node", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def top_by_degree(edges: DataFrame, k: int = 10) -> DataFrame:
    d = degree(edges)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n_in").desc(), "node"))).filter(F.col("rank") <= k)
