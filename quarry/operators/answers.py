"""Answers of each command as JSON: cards of single results as columns, and one envelope around the first of them.

Cards are made row by row on the JVM, nulls left out, so any number can be written as lines. Only ``reply`` brings rows
together, and only as many as its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import ids
from quarry.operators import render

SCHEMA_VERSION = 2  # a fixed value


def _named(symbol: str | Column) -> Column:
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.when(c != "", c)


def _place(file: Column, start: Column, end: Column, symbol: Column) -> list[Column]:
    return [ids.result_id(file, start, end, symbol).alias("id"), file.alias("file"), F.array(start, end).alias("lines"), F.when(symbol != "", symbol).alias("symbol")]


def literal_cards(matches: DataFrame) -> DataFrame:
    """file, line, card of matches (file, line, content; start, end, symbol, kind of the chunk around, or null)."""
    has = lambda c: F.col(c) if c in matches.columns else F.lit(None)
    start, end = F.coalesce(has("start"), F.col("line")), F.coalesce(has("end"), F.col("line"))
    symbol = has("symbol").cast("string")
    card = F.struct(ids.result_id(F.col("file"), start, end, symbol).alias("id"), "file", "line", F.col("content").alias("text"), _named(symbol).alias("symbol"), has("kind").cast("string").alias("kind"))
    return matches.select("file", "line", F.to_json(card).alias("card"))


def group_cards(groups: DataFrame, representatives: DataFrame | None = None, by: str = "label", most: int = 3) -> DataFrame:
    """label, rank, card of groups (label, rank, matches, files, terms); with representatives (label, rank, id, content, file,
    start, end, symbol) the ids and contents of the first few of each group."""
    card = [F.col(by).alias("label"), F.col("rank"), F.col("matches"), F.col("files"), F.col("terms")]
    if representatives is not None:
        own = F.struct(F.col("rank").alias("at"), F.struct(*_place(F.col("file"), F.col("start"), F.col("end"), F.coalesce("symbol", F.lit(""))), F.col("content")).alias("r"))
        few = representatives.filter(F.col("rank") <= most).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(own)), lambda x: x["r"]).alias("representatives"))
        groups = groups.join(few, by, "left")
        card += [F.transform("representatives", lambda r: r["id"]).alias("representativeIds"), F.col("representatives")]
    return groups.select(F.col(by).alias("label"), "rank", F.to_json(F.struct(*card)).alias("card"))


def show_cards(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, id, card of shown slices: place, content, and whether the file is still what was indexed (stale)."""
    integrity = [F.when(F.col("stale"), "stale").otherwise("exact").alias("integrity")] if "stale" in rows.columns else []
    symbol = F.coalesce("symbol", F.lit(""))
    place = _place(F.col("file"), F.col("start"), F.col("end"), symbol)
    return rows.select(*keys, place[0], F.to_json(F.struct(*place, F.col("content"), *integrity)).alias("card"))


def duplicate_cards(groups: DataFrame, members: DataFrame, by: str = "component", code: bool = False) -> DataFrame:
    """by, card of groups (by, level, similarity, type, savings) with their members (by, file, start, end, symbol, complexity, content).

    A group's members are one card, as a reader gets it; pass groups that were cut by ``duplicates.within_tokens``."""
    one = F.struct(*_place(F.col("file"), F.col("start"), F.col("end"), F.coalesce("symbol", F.lit(""))), F.col("complexity"), *([F.col("content")] if code else []))
    chosen = members.join(groups.select(by), by, "left_semi")
    own = chosen.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("file", "start", one.alias("m")))), lambda x: x["m"]).alias("instances"))
    return groups.join(own, by).select(by, F.to_json(F.struct("level", "similarity", "type", "savings", "instances")).alias("card"))


def impact_cards(reached: DataFrame, nodes: DataFrame, *keys: str | Column) -> DataFrame:
    """keys, node, depth, card of what a change reaches (node, depth)."""
    at = nodes.select("node", "file", "start", "end", F.coalesce("name", F.lit("")).alias("symbol"))
    placed = reached.join(at, "node")
    return placed.select(*keys, "node", "depth", F.to_json(F.struct(*_place(F.col("file"), F.col("start"), F.col("end"), F.col("symbol")), F.col("depth"))).alias("card"))


def warning_cards(messages: DataFrame, message: str = "message") -> DataFrame:
    """card of warnings: code and message; empty ones are left out."""
    return messages.filter(F.col(message) != "").select(F.to_json(F.struct(render.warning_code(F.col(message)).alias("code"), F.col(message).alias("message"))).alias("card"))


def reply(cards: DataFrame, command: str, order: list[str], limit: int = 50, part: str = "results", warnings: DataFrame | None = None, exhaustive: bool = True) -> DataFrame:
    """One row, reply: the envelope of a command with its first limit cards, how many there are, and whether that is all.

    The total is counted beside the cards; what comes together in one row is bounded by limit. Warnings are few: they tell of
    one command."""
    first = cards.orderBy(*order).limit(limit).agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "card"))), lambda x: x["card"]).alias("__cards"))
    total = cards.agg(F.count("*").alias("total"))
    warned = None if warnings is None else warnings.limit(limit).agg(F.sort_array(F.collect_list("card")).alias("__warnings"))
    one = first.join(total, how="cross") if warned is None else first.join(total, how="cross").join(warned, how="cross")  # one row each
    returned = F.size("__cards")
    cut = returned < F.col("total")
    head = F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(command).alias("command"), F.when(cut, "incomplete").otherwise("complete").alias("status")))
    summary = F.to_json(F.struct("total", returned.alias("returned"), cut.alias("truncated"), (F.lit(exhaustive) & ~cut).alias("exhaustive")))
    listed = lambda name, c: F.concat(F.lit(f',"{name}":['), F.array_join(c, ","), F.lit("]"))
    told = F.lit("") if warned is None else F.when(F.size("__warnings") > 0, listed("warnings", F.col("__warnings"))).otherwise("")
    return one.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), told, F.lit(',"summary":'), summary, listed(part, F.col("__cards")), F.lit("}")).alias("reply"))
