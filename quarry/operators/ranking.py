"""Ranking: fusion, boosts, reranking, confidence, overlap, diversity and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import classify
from quarry.functions import text as T

RRF_K = 60
# Tokens that ask for executable code, that name no domain, and types that aren't executable.
ACTIONS = ("callback", "handler", "route", "validate", "validation", "webhook")
GENERIC = (*ACTIONS, "code", "function", "implementation", "logic", "method", "process", "processing")
NOT_EXECUTABLE = ("constant", "enum", "interface", "property", "type", "variable")


def fuse(semantic: DataFrame, lexical: DataFrame, keys: list[str], score_s: str = "similarity", score_l: str = "lexical") -> DataFrame:
    """Full outer join of two ranked lists (columns keys, score, rank): base is the larger score, fused adds reciprocal ranks.

    A base over 1 passes as it is; else fused = min(1, 0.65 base + 0.35 rrf), rrf being 1 where both lists have it first.
    """
    s = semantic.groupBy(*keys).agg(F.max(score_s).alias("s"), F.max("rank").alias("rank_s"))
    x = lexical.groupBy(*keys).agg(F.max(score_l).alias("l"), F.max("rank").alias("rank_l"))
    both = s.join(x, keys, "full_outer")
    part = lambda c: F.coalesce(1.0 / (F.lit(float(RRF_K)) + F.col(c)), F.lit(0.0))
    rrf = (part("rank_s") + part("rank_l")) / (2.0 / (RRF_K + 1))
    base = F.greatest("s", "l")
    return both.withColumn("base", base).withColumn("fused", F.when(base > 1, base).otherwise(F.least(F.lit(1.0), 0.65 * base + 0.35 * rrf)))


def boost(rows: DataFrame, score: str, role: Column, purpose: str = "understand", preferred: str | None = None, changed: Column | None = None) -> DataFrame:
    """score moved by the file's role for the purpose, and in a review by 0.08 for changed files, within 0 and 1.1."""
    extra = classify.role_boost(role, purpose, preferred)
    if changed is not None and purpose == "review":
        extra = extra + F.when(changed, F.lit(0.08)).otherwise(F.lit(0.0))
    return rows.withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(1.1), F.col(score) + extra)))


def rerank(rows: DataFrame, query: str, score: str = "score", content: str = "content", symbol: str = "symbol", symbol_type: str = "symbol_type", exported: str = "exported", path: str = "file") -> DataFrame:
    """rows with rerank: the score mixed with lexical relevance, an exact or exported symbol, coverage of the domain's
    tokens, and less for types where code is asked for. Scores over 1 pass as they are."""
    tokens = T.query_tokens(query)
    domain = [t for t in tokens if t not in GENERIC]
    sym = F.lower(F.coalesce(symbol, F.lit("")))
    exact = sym.isin(*tokens).cast("double") if tokens else F.lit(0.0)
    everything = F.lower(F.concat_ws(" ", path, sym, content))
    covered = reduce(lambda a, b: a + b, (F.contains(everything, F.lit(t)).cast("double") for t in domain)) / float(len(domain)) if len(domain) >= 2 else F.lit(0.5)
    asks = any(t in ACTIONS for t in tokens)
    penalty = F.when((exact == 0) & F.lower(F.coalesce(symbol_type, F.lit(""))).isin(*NOT_EXECUTABLE), F.lit(0.08)).otherwise(F.lit(0.0)) if asks else F.lit(0.0)
    structural = exact * 0.7 + F.coalesce(F.col(exported), F.lit(False)).cast("double") * 0.3
    value = F.col(score) * 0.72 + T.lexical_relevance(tokens, F.col(content), F.col(symbol), F.col(path)) * 0.2 + structural * 0.08 + (covered - 0.5) * 0.1 - penalty
    return rows.withColumn("rerank", F.when(F.col(score) > 1, F.col(score)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))))


def rank_score(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with rank and rank_score = (n - rank + 1) / n in 6 places. For result lists, which have been cut before."""
    n = F.count("*").over(Window.partitionBy())
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("rank_score", F.round((n - F.col("rank") + 1) / n, 6))


def confidence(score: Column, exact_symbol: Column, symbol_filter: Column, token_matches: Column, pattern: Column, kind: Column, structural: Column, strict: Column) -> Column:
    """high, medium or low by score, raised by what else matched."""
    level = F.when(score >= 0.55, 2).when(score >= 0.25, 1).otherwise(0)
    high = (strict >= 2) | (pattern & (structural >= 1)) | (kind & (pattern | symbol_filter))
    medium = symbol_filter | pattern | kind | (strict > 0) | ((token_matches > 0) & (score > -0.1))
    raised = F.when(exact_symbol | high, F.lit(2)).when(medium, F.greatest(level, F.lit(1))).otherwise(level)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), raised.cast("int") + 1)


def is_weak(level: Column, score: Column) -> Column:
    return (level == "low") & (score < 0.25)


def annotate(rows: DataFrame, reasons: dict[str, Column], matched: dict[str, tuple[Column, str, Column]]) -> DataFrame:
    """why_matched: the reasons whose condition holds; filter_matches: for each filter whether it held, how, and the value."""
    why = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in reasons.items())))
    entries = [x for name, (ok, mode, value) in matched.items() for x in (F.lit(name), F.struct(ok.alias("matched"), F.lit(mode).alias("mode"), value.cast("string").alias("value")))]
    return rows.withColumn("why_matched", F.array_distinct(why)).withColumn("filter_matches", F.create_map(*entries) if entries else F.lit(None))


def drop_overlaps(rows: DataFrame, threshold: float = 0.6, slack: float = 0.02, file: str = "file", order: str = "rank", slots: bool = False) -> DataFrame:
    """file, place, rank, start, end, score, symbol_type (and slot, the rank whose place it has) of what stays when a row that overlaps an earlier one of its file gives way.

    Rows are folded in rank order. A row meets the first kept one that it overlaps by the threshold (over 0) of the
    shorter; it takes that place if its score is better by more than slack, or about as good and the row is a method or
    function against a class, or shorter; else it goes. Rows that share no line, not even through others, have nothing
    to do with each other: a sweep over the starts cuts a file into such stretches, and each is folded alone.
    """
    item = F.struct(F.col(order).alias("rank"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"), F.coalesce("symbol_type", F.lit("")).alias("type"), F.col(order).alias("slot"))
    swept = islands(rows, [file], 0, order=order)
    folded = swept.groupBy(file, "island").agg(F.array_sort(F.collect_list(item)).alias("items"))
    ratio = "greatest(0, least(x.end, k.end) - greatest(x.start, k.start) + 1) / least(greatest(1, x.end - x.start + 1), greatest(1, k.end - k.start + 1))"
    better = f"""(x.score - k.score > {slack}D OR (abs(x.score - k.score) <= {slack}D AND ((x.type IN ('method', 'function') AND k.type = 'class') OR x.end - x.start < k.end - k.start)))"""
    expr = f"""aggregate(items, filter(items, x -> false), (kept, x) -> CASE
        WHEN NOT exists(kept, k -> {ratio} >= {threshold}D) THEN array_append(kept, x)
        ELSE transform(kept, (k, i) -> CASE
          WHEN {ratio} >= {threshold}D AND NOT exists(slice(kept, 1, i), e -> {ratio.replace('k.', 'e.')} >= {threshold}D) AND {better}
          THEN named_struct('rank', x.rank, 'start', x.start, 'end', x.end, 'score', x.score, 'type', x.type, 'slot', k.slot) ELSE k END) END)"""
    out = folded.select(file, F.explode(F.expr(expr)).alias("k"))
    place = F.row_number().over(Window.partitionBy(file).orderBy("k.slot")) - 1  # places are taken in the order of rank
    return out.select(file, place.alias("place"), "k.rank", "k.start", "k.end", "k.score", F.col("k.type").alias("symbol_type"), *([F.col("k.slot").alias("slot")] if slots else []))


def diversify(rows: DataFrame, order: list[str | Column], per_file: int = 2, per_symbol: int = 2, file: str = "file", symbol: str = "symbol") -> DataFrame:
    """At most per_file rows a file, then at most per_symbol a symbol among those; 0 sets no limit, rows without symbol none either."""
    out = rows
    if per_file > 0:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(file).orderBy(*order))).filter(F.col("__n") <= per_file).drop("__n")
    if per_symbol > 0 and symbol in rows.columns:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(symbol).orderBy(*order)))
        out = out.filter((F.coalesce(symbol, F.lit("")) == "") | (F.col("__n") <= per_symbol)).drop("__n")
    return out


def representatives(rows: DataFrame, group: str, k: int, score: str = "score", file: str = "file", key: str = "id") -> DataFrame:
    """k rows a group by score: the best of each file first, then the others."""
    first = F.row_number().over(Window.partitionBy(group, file).orderBy(F.col(score).desc(), key)) == 1
    marked = rows.withColumn("__first", first)
    w = Window.partitionBy(group).orderBy(F.col("__first").desc(), F.col(score).desc(), key)
    return marked.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k).drop("__first")


def islands(rows: DataFrame, keys: list[str], gap: int, start: str = "start", end: str = "end", order: str = "id") -> DataFrame:
    """rows with island: pieces of one key run together until one starts more than gap behind everything before."""
    w = Window.partitionBy(*keys).orderBy(start, end, order)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__new", F.coalesce((F.col(start) > before + gap).cast("int"), F.lit(1))).withColumn("island", F.sum("__new").over(w)).drop("__new")


def reconstruct(rows: DataFrame, keys: list[str], score: str = "score", gap: int = 5, order: str = "id") -> DataFrame:
    """One row an island: its whole range, how many chunks it joins, and the best chunk's id and score."""
    best = F.struct(F.col(score), -F.col(order))
    merged = islands(rows, keys, gap, order=order).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("chunks"), F.max(best).alias("best"), F.max_by(order, best).alias("best_id"))
    return merged.select(*keys, "start", "end", "chunks", F.col(f"best.{score}").alias(score), "best_id")


def tokens_of(content: Column, file: Column, symbol: Column) -> Column:
    """Estimated tokens of a result: a quarter of its characters and of 80 for its frame."""
    return F.greatest(F.lit(1), F.ceil((F.length(content) + F.length(F.coalesce(file, F.lit(""))) + F.length(F.coalesce(symbol, F.lit(""))) + 80) / 4).cast("int"))


def within_budget(rows: DataFrame, cost: Column, budget: int, order: list[str | Column], by: list[str] | None = None, first_always: bool = True) -> DataFrame:
    """Rows in order as long as they fit: one that would not is passed over, and nothing comes once the budget is full.

    by: budgets apart for each key. The first row comes in any case unless first_always is off. A cost is 1 at least.

    What is used never falls, so once a row of some cost is passed over, all later ones of that cost are: of the rows of
    cost c only the first budget // c can come. Each task keeps those before anything is shuffled, which leaves some
    budget * ln(budget) rows a key, whatever the table's size, and those are folded in order.
    """
    by = by or []
    costed = rows.withColumn("__cost", F.greatest(cost.cast("long"), F.lit(1)))
    fit = costed.filter(F.col("__cost") <= budget)
    if budget > int(rows.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):  # beyond it Spark doesn't limit in its tasks
        fit = fit.sortWithinPartitions(*by, "__cost", *order).mapInArrow(_first_of_each([*by, "__cost"], budget), fit.schema)
    nth = F.row_number().over(Window.partitionBy(*by, "__cost").orderBy(*order))
    some = fit.withColumn("__nth", nth).filter(F.col("__nth") <= budget).filter(F.col("__nth") * F.col("__cost") <= budget).drop("__nth")
    if first_always:  # a first row that fits comes anyway
        first = costed.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n") if by else costed.orderBy(*order).limit(1)
        some = some.unionByName(first.filter(F.col("__cost") > budget))
    dealt = some.repartition(*by) if by else some.coalesce(1)
    ordered = dealt.sortWithinPartitions(*by, *order)
    return ordered.mapInArrow(_fold(by, budget), ordered.schema).drop("__cost")


def _columns(batch, names: list[str]) -> list[tuple]:
    return list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)) if names else [()] * batch.num_rows


def _first_of_each(keys: list[str], budget: int):
    """Of each key of sorted batches, the last of which is a cost, the first budget // cost rows."""

    def run(batches):
        import pyarrow as pa

        now, n = object(), 0
        for batch in batches:
            keep = []
            for key in _columns(batch, keys):
                now, n = key, n + 1 if key == now else 1
                keep.append(n * key[-1] <= budget)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _fold(by: list[str], budget: int):
    """Which of the rows of sorted batches come, key by key. A row over the budget is a first one."""

    def run(batches):
        import pyarrow as pa

        now, used = object(), 0
        for batch in batches:
            keep = []
            for *key, cost in _columns(batch, [*by, "__cost"]):
                if key != now:
                    now, used = key, 0
                keep.append(used + cost <= budget or (cost > budget and used == 0))
                used += cost if keep[-1] else 0
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def truncated(content: Column, budget: int, file: Column, symbol: Column) -> Column:
    """Content cut to a budget of tokens, at a line break if one is in the second half."""
    room = F.greatest(F.lit(0), F.lit(4 * budget) - F.length(F.coalesce(file, F.lit(""))) - F.length(F.coalesce(symbol, F.lit(""))) - 80).cast("int")
    head = F.substring(content, F.lit(1), room)
    at = F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1
    return F.when(F.length(content) <= room, content).when((at >= F.floor(room / 2)) & F.contains(head, F.lit("\n")), F.substring(head, F.lit(1), at)).otherwise(head)


def over_fetch(limit: int, what: str = "search") -> int:
    """Rows to fetch for ``limit`` that are shown, since later steps drop some: twice as many, three times with a pattern,
    six times and at least 60 for a survey, eight times and at least 70 for clusters."""
    return {"search": 2 * limit, "pattern": 3 * limit, "survey": max(60, 6 * limit), "cluster": max(70, 8 * limit)}[what]


def at_least(rows: DataFrame, least: float, score: str = "similarity", rerank: str = "rerank") -> DataFrame:
    """Rows whose rerank score, or score where there is none, is at least ``least``."""
    own = F.coalesce(rerank, score) if rerank in rows.columns else F.col(score)
    return rows.filter(own >= least)


def byte_fit(rows: DataFrame, max_bytes: int, order: list[str], content: str = "content", frame: Column | None = None) -> DataFrame:
    """prefix_budget by bytes of content (and frame), and of the next row the beginning of its content that still fits; adds partial.

    Cut between characters. Only the keys and sizes of max_bytes + 1 rows at most are ever ordered.
    """
    own = F.octet_length(content) + (F.lit(0) if frame is None else frame)
    over = _overflow(rows, own, max_bytes, order)
    if over is None:
        return rows.withColumn("partial", F.lit(False))
    at, room = _at(rows, order, over), F.lit(max_bytes - over["__before"]) - (F.lit(0) if frame is None else frame)
    step = lambda s, x: F.struct((s["n"] + ((s["b"] + x <= room) & s["on"]).cast("int")).alias("n"), (s["b"] + x).alias("b"), (s["on"] & (s["b"] + x <= room)).alias("on"))
    ends = F.aggregate(F.transform(F.split(content, ""), F.octet_length), F.struct(F.lit(0).alias("n"), F.lit(0).alias("b"), F.lit(True).alias("on")), step, lambda s: s["n"])
    whole = rows.filter(F.struct(*order) < at).withColumn("partial", F.lit(False))
    cut = rows.filter((F.struct(*order) == at) & (own > 0)).limit(1).withColumn(content, F.substring(content, F.lit(1), ends)).withColumn("partial", F.lit(True))
    return whole.unionByName(cut.filter(F.length(content) > 0))


def _at(rows: DataFrame, order: list[str], row) -> Column:
    return F.struct(*(F.lit(row[c]).cast(rows.schema[c].dataType).alias(c) for c in order))


def _overflow(rows: DataFrame, size: Column, budget: int, order: list[str]):
    """The first row, by columns ascending, with which sizes add up to more than the budget: its columns and __before, the sum before it."""
    sized = rows.select(*order, size.cast("long").alias("__size")).filter("__size > 0").orderBy(*order).limit(budget + 1)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        used = 0
        for batch in batches:
            sums = used + np.cumsum(batch.column(batch.num_columns - 1).to_numpy())
            at = int(np.searchsorted(sums, budget, side="right"))
            if at < len(sums):
                one = batch.slice(at, 1)
                before = int(sums[at]) - one.column(batch.num_columns - 1)[0].as_py()
                yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([before], pa.int64())], names=[*order, "__before"])
                return
            used = int(sums[-1]) if len(sums) else used

    found = sized.coalesce(1).sortWithinPartitions(*order).mapInArrow(run, rows.select(*order, F.lit(0).cast("long").alias("__before")).schema)
    return found.first()


def prefix_budget(rows: DataFrame, size: Column, budget: int, order: list[str]) -> DataFrame:
    """The longest beginning of rows, by columns ascending, whose sizes (whole numbers from 0 on) add up to the budget at most.

    At most budget + 1 rows of any size can matter: those alone are summed, and where the sum goes over is a filter on
    the table, which itself isn't sorted. Of rows with equal columns either all stay or none.
    """
    over = _overflow(rows, size, budget, order)
    return rows if over is None else rows.filter(F.struct(*order) < _at(rows, order, over))
