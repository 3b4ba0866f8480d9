"""Surveys and clusters of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import graph

# Words that say nothing in a title.
GENERIC_TITLES = ("api", "client", "clients", "service", "services", "types", "contracts", "model", "models")
THRESHOLD, ATTACH_LEAST, ATTACH_SLACK = 0.72, 0.55, 0.08


def top_counts(rows: DataFrame, group: list[str], values: Column, k: int = 3, skip: list[str] | None = None) -> DataFrame:
    """group, top: the k most frequent values of each group, lower case, ties by text."""
    each = rows.select(*group, F.explode(values).alias("v")).select(*group, F.lower(F.trim("v")).alias("v")).filter("v <> ''")
    if skip:
        each = each.filter(~F.col("v").isin(*skip))
    counted = each.groupBy(*group, "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.col("n").desc(), "v") if group else Window.orderBy(F.col("n").desc(), "v")
    best = counted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    return best.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias("top"))


def phrases(symbol: Column) -> Column:
    """The first up to four tokens of a symbol as a phrase, null for fewer than two."""
    tokens = F.slice(T.tokens_without_stop_words(F.coalesce(symbol, F.lit(""))), 1, 4)
    return F.when(F.size(tokens) >= 2, F.array_join(tokens, " "))


def survey(rows: DataFrame, query: str = "", path: str = "file", score: str = "score", symbol: str = "symbol", symbol_type: str | None = None, imports: Column | None = None) -> DataFrame:
    """title, score, n, files, terms, place: results by domain label, best sum of scores first."""
    hints = T.import_hints(imports) if imports is not None else None
    labelled = rows.withColumn("title", T.domain_label(F.col(path), hints, F.col(symbol_type) if symbol_type else None))
    words = T.tokens_without_stop_words(F.coalesce(symbol, F.lit("")))
    terms = top_counts(labelled, ["title"], F.concat(words, hints) if hints is not None else words, 8, T.query_tokens(query) or None)
    sums = labelled.groupBy("title").agg(F.sum(score).alias("score"), F.count("*").alias("n"), F.countDistinct(path).alias("files"))
    w = Window.orderBy(F.col("score").desc(), F.col("files").desc(), F.col("n").desc(), "title")
    return sums.join(terms.withColumnRenamed("top", "terms"), "title", "left").withColumn("place", F.row_number().over(w))


def combined_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Weighted mean of vector 0.6 (if positive), path 0.15, imports 0.15 (if any), attributes 0.1. Keys: v (unit vectors), path, imports, attributes."""
    vec = V.dot(a["v"], b["v"])
    total = F.when(vec > 0, F.lit(0.6)).otherwise(F.lit(0.0)) + 0.15 + 0.1
    value = F.when(vec > 0, vec * 0.6).otherwise(F.lit(0.0)) + T.path_similarity(a["path"], b["path"]) * 0.15
    value = value + T.metadata_similarity(list(zip(a["attributes"], b["attributes"], strict=True))) * 0.1
    if "imports" in a:
        some = (F.size(a["imports"]) > 0) | (F.size(b["imports"]) > 0)
        total = total + F.when(some, F.lit(0.15)).otherwise(F.lit(0.0))
        value = value + F.when(some, T.jaccard(a["imports"], b["imports"]) * 0.15).otherwise(F.lit(0.0))
    return value / total


def clusters(pairs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD, least: int = 2, attach: bool = True, vectors: DataFrame | None = None, chunk: int = 2048) -> DataFrame:
    """id, cluster of every row of nodes(id): components of pairs(a, b, similarity) over the threshold; a row alone joins
    the cluster of at least ``least`` rows to which its mean similarity is highest, if that is high enough.

    Without vectors, pairs must have every pair that counts for that mean; members that a row is not paired with count as
    0. With vectors(id, v), where similarity is the cosine of v, pairs need only those over the threshold, or links(a, b)
    of the same components (as without attaching): the mean is a
    row's product with the sum of a cluster's unit vectors. All single rows are attached at once to the clusters as they
    were, so the result does not depend on an order.
    """
    linked = graph.components(pairs.filter(F.col("similarity") >= threshold) if "similarity" in pairs.columns else pairs)
    own = nodes.select("id").join(linked.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    sizes = own.groupBy("cluster").agg(F.count("*").alias("n"))
    sized = graph.written(own.join(sizes, "cluster"))
    if not attach:
        return sized.select("id", "cluster")
    single = sized.filter("n = 1").select(F.col("id").alias("a"))
    large = sized.filter(F.col("n") >= least).select(F.col("id").alias("b"), F.col("cluster").alias("to"), "n")
    if vectors is None:
        both = pairs.select("a", "b", "similarity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
        mean = both.join(single, "a").join(large, "b").groupBy("a", "to", "n").agg(F.sum("similarity").alias("s")).withColumn("mean", F.col("s") / F.col("n"))
    else:
        mean = _means(single, large, vectors, chunk)
    good = mean.filter(F.col("mean") >= max(ATTACH_LEAST, threshold - ATTACH_SLACK) if threshold >= ATTACH_LEAST else F.col("mean") >= threshold - ATTACH_SLACK)
    best = good.groupBy("a").agg(F.max(F.struct("mean", (-F.col("to")).alias("less"))).alias("m")).select(F.col("a").alias("id"), (-F.col("m.less")).alias("to"))
    return sized.join(best, "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))


def _means(single: DataFrame, large: DataFrame, vectors: DataFrame, chunk: int) -> DataFrame:
    """a, to, mean of every single(a) and every cluster of large(b, to, n); clusters are dealt into chunks, each a key of an equi-join."""
    units = vectors.select("id", V.l2_normalize(F.col("v")).alias("v"))
    sums = large.join(units, large["b"] == units["id"]).select("to", "n", F.posexplode("v").alias("at", "x")).groupBy("to", "n", "at").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("to", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("s"))
    sums = graph.written(sums)
    tiles = max(1, -(-sums.count() // chunk))
    rows = single.join(units, F.col("a") == F.col("id")).select("a", "v", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("o"), F.pmod(F.xxhash64("a"), F.lit(64)).alias("c"))
    dealt = sums.withColumn("o", F.pmod(F.xxhash64("to"), F.lit(tiles)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    both = rows.join(dealt, ["o", "c"]).filter(F.size("v") == F.size("s"))
    return both.select("a", "to", (V.dot(F.col("v"), F.col("s")) / F.col("n")).alias("mean"))


def cluster_summary(members: DataFrame, score: str = "score", file: str = "file") -> DataFrame:
    """cluster, n, files, score (mean), weight = mean * log2(n + 1), place."""
    sums = members.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct(file).alias("files"), F.avg(score).alias("score"))
    weighted = sums.withColumn("weight", F.col("score") * F.log2(F.col("n") + 1))
    return weighted.withColumn("place", F.row_number().over(Window.orderBy(F.col("weight").desc(), "cluster")))


def cluster_titles(members: DataFrame, query: str = "", path: str = "file", symbol: str = "symbol") -> DataFrame:
    """cluster, title: its most frequent domain and the strongest symbol phrase."""
    labelled = members.withColumn("label", T.domain_label(F.col(path))).withColumn("phrase", phrases(F.col(symbol)))
    domains = top_counts(labelled, ["cluster"], F.array("label"), 1).withColumnRenamed("top", "domains")
    signals = top_counts(labelled, ["cluster"], F.array_compact(F.array("phrase")), 1, [*GENERIC_TITLES, *T.query_tokens(query)]).withColumnRenamed("top", "signals")
    named = domains.join(signals, "cluster", "full_outer")
    base = F.regexp_replace(F.get("domains", 0), "^domain / ", "")
    return named.select("cluster", F.when(F.get("signals", 0).isNull(), F.get("domains", 0)).otherwise(F.concat_ws(" / ", F.coalesce(base, F.lit("cluster")), F.get("signals", 0))).alias("title"))
