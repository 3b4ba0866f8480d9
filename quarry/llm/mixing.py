"""Operator 10: mixing sources to target weights.

Word counts are summed by source, each source's target and repetition rate follow from them, and a document is taken
floor(rate) times plus once more if a draw seeded by its id falls below the fraction; of rows that are equal in id and
text each has a draw of its own in report(), which numbers them. All of it is DataFrame code:
partial sums before the shuffle, then a join with one row a source, broadcast if there are few sources and else split by
AQE where a source is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, stored

WEIGHTS = (3, 1, 2)
#: Words to take, as a multiple of all words; most that a source gives, as a multiple of its words.
TOTAL, MOST = 1.5, 2.0
SEED = "mix-1"
#: Targets of up to so many sources are broadcast, so that texts stay where they are; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """source, source_size, target of each source of sizes(source, size).

    Sources in code-point order, null last, take the weights in turn. Shares are weight times a common level, at most
    ``most`` times the source's size; with sources ordered by cap / weight, the capped ones come first, and the level
    is what is left divided by the weights that are left. The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ordered = Window.orderBy("fills_at", "place")
    table = F.array(*map(F.lit, weights))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("place", F.row_number().over(by_name)).withColumn("weight", F.element_at(table, F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    s = s.withColumn("k", F.row_number().over(ordered))
    whole, before = Window.partitionBy(), ordered.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", left / weight_left)
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("k", "level"))).over(whole)
    s = s.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("k") < F.col("first.k"))
    return s.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def words_of(text_col: str) -> F.Column:
    """The size of a text in words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def _mark(text_col: str) -> F.Column:
    """What tells texts of one id apart."""
    return F.substring(F.md5(F.coalesce(F.col(text_col), F.lit(""))), 1, 16)


def with_copies(rows: DataFrame, sizes: DataFrame, id_col: str, source_col: str, seed: str, mark: F.Column) -> DataFrame:
    """rows with __source_size, __target and __copies, by the rates that follow from sizes(source, size). A row draws by its id and mark."""
    per_source = targets(sizes)
    per_source = stored(per_source.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target")), "targets")
    if per_source.count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), mark)
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = F.floor("__rate") + F.when(draw < F.col("__rate") - F.floor("__rate"), 1).otherwise(0)
    joined = rows.join(per_source, F.col(source_col).eqNullSafe(F.col("__source"))).withColumn("__rate", rate)
    return joined.withColumn("__copies", copies.cast("long")).drop("__source", "__rate")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """docs' columns with __source_size, __target and __copies for every row.

    A null or empty text has size 0; a source without words has target 0 and gives no copies; a null id draws as an
    empty one; rows draw by id and text, so only rows that are equal in both draw alike; an empty table gives no rows. Texts are read once to be counted and
    once to be passed on.
    """
    return with_copies(docs, docs.select(F.col(source_col).alias("source"), words_of(text_col).alias("size")), id_col, source_col, seed, _mark(text_col))


def emit(docs: DataFrame, **names: str) -> DataFrame:
    """Every document as often as the mix takes it, with docs' own columns."""
    mixed = mix(docs, **names).filter("__copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted) of every document; texts are read once.

    Rows that are equal in id, source and text are counted and numbered, and from the second on draw by their number too.
    """
    sized = stored(docs.select("doc_id", "source", words_of("text").alias("size"), _mark("text").alias("mark")), "sizes")
    counted = sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("n"))
    each = counted.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    mixed = with_copies(each, sized, "doc_id", "source", seed, F.concat("mark", F.when(F.col("nth") > 0, F.concat(F.lit(":"), F.col("nth").cast("string"))).otherwise("")))
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


#: DuckDB: the rows of report().
REPORT_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0) AS size, substr(md5(coalesce(text, '')), 1, 16) AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{", ".join(map(str, WEIGHTS))}])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}]::DOUBLE AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS place, source_size * {MOST}::DOUBLE AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS k,
        ((sum(source_size) OVER ())::DOUBLE * {TOTAL}::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min(k) AS k, arg_min(level, k) AS level FROM o WHERE level * weight < cap),
t AS (SELECT source, source_size, CASE WHEN f.k IS NULL OR o.k < f.k THEN cap ELSE f.level * weight END AS target FROM o LEFT JOIN f ON true),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, mark) - 1 AS nth FROM d),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.mark || CASE WHEN nth > 0 THEN ':' || nth ELSE '' END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
      FROM n AS d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target::DOUBLE AS target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
