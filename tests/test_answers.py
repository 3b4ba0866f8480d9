"""Answers as JSON, freshness in time, providers with a pace."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import answers
from quarry.sources import embed, store


def test_cards_and_reply(spark):
    lines = spark.createDataFrame([("a.ts", 3, 'x "q"', 1, 9, "run", "function"), ("b.ts", 1, "", None, None, None, None)], "file string, line int, content string, start int, end int, symbol string, kind string")
    cards = {r.file: json.loads(r.card) for r in answers.literal_cards(lines).collect()}
    assert cards["a.ts"] | {"id": 0} == {"id": 0, "file": "a.ts", "line": 3, "text": 'x "q"', "symbol": "run", "kind": "function"}
    assert set(cards["b.ts"]) == {"id", "file", "line", "text"}
    warned = answers.warning_cards(spark.createDataFrame([("index is stale",), ("",)], "message string"))
    for limit, status in ((1, "incomplete"), (2, "complete"), (9, "complete")):
        got = json.loads(answers.reply(answers.literal_cards(lines), "literal", ["file", "line"], limit, "matches", warned).first().reply)
        assert got["status"] == status and [m["file"] for m in got["matches"]] == ["a.ts", "b.ts"][:limit] and got["warnings"][0]["code"] == "INDEX_STALE"
        assert got["summary"] == {"total": 2, "returned": min(2, limit), "truncated": limit < 2, "exhaustive": limit >= 2}
    empty = json.loads(answers.reply(answers.literal_cards(lines.limit(0)), "literal", ["file", "line"]).first().reply)
    assert empty["results"] == [] and empty["status"] == "complete" and empty["summary"]["total"] == 0 and "warnings" not in empty


def test_groups_slices_and_duplicates(spark):
    g = spark.createDataFrame([("a", 1, 2, 1, ["x"]), ("b", 2, 1, 1, None)], "label string, rank int, matches int, files int, terms array<string>")
    r = spark.createDataFrame([("a", i, "f", i, i, None, f"c{i}") for i in range(1, 6)], "label string, rank int, file string, start int, end int, symbol string, content string")
    got = {x.label: json.loads(x.card) for x in answers.group_cards(g, r).collect()}
    assert [c["content"] for c in got["a"]["representatives"]] == ["c1", "c2", "c3"] and len(got["a"]["representativeIds"]) == 3
    assert set(got["b"]) == {"label", "rank", "matches", "files"} and "symbol" not in got["a"]["representatives"][0]
    shown = json.loads(answers.show_cards(r.withColumn("stale", F.col("start") == 1).filter("start = 1")).first().card)
    assert shown["integrity"] == "stale" and shown["lines"] == [1, 1] and shown["content"] == "c1"
    d = spark.createDataFrame([(7, "exact", 1.0, "text", 40)], "component long, level string, similarity double, type string, savings int")
    m = spark.createDataFrame([(7, "b", 1, 2, "s", 3, "code"), (7, "a", 5, 6, "", None, None), (8, "c", 1, 1, "", 1, "")], "component long, file string, start int, end int, symbol string, complexity int, content string")
    card = json.loads(answers.duplicate_cards(d, m, code=True).first().card)
    assert [i["file"] for i in card["instances"]] == ["a", "b"] and card["instances"][1]["content"] == "code" and "complexity" not in card["instances"][0]


def test_freshness_in_time(spark):
    counts = spark.createDataFrame([(0, 2, 0, 5, 5)], "added long, changed long, removed long, expected long, there long")
    got = store.checked_in_time(store.stale_warning(counts), 60)
    assert got["checked"] and got["stale"] and got["warning"] == "Warning: index may be stale (changed=2, missing=0, removed=0, chunkMismatch=false). Index it again."
    fresh = store.checked_in_time(store.stale_warning(counts.withColumn("changed", F.lit(0))), 60)
    assert fresh["checked"] and not fresh["stale"] and fresh["warning"] is None

    @F.udf("long")
    def slow(x):
        time.sleep(20)
        return x

    began = time.monotonic()
    late = store.checked_in_time(store.stale_warning(counts.repartition(2).withColumn("changed", slow("changed"))), 0.5)
    assert not late["checked"] and not late["stale"] and time.monotonic() - began < 15
    broken = counts.withColumn("changed", F.raise_error(F.lit("gone")).cast("long"))
    assert not store.checked_in_time(store.stale_warning(broken), 60)["checked"]


def test_a_pace_holds_in_every_window():
    now, sent = [0.0], []

    def sleep(s):
        now[0] += s

    pace = embed.Pace(3, 100, 60.0, clock=lambda: now[0], sleep=sleep)
    for tokens in (40, 40, 40, 1, 1, 1, 500, 10, 90, 1):
        pace.wait(tokens)
        sent.append((now[0], min(tokens, 100)))
    for t, _ in sent:
        inside = [n for at, n in sent if t <= at < t + 59.9]
        assert len(inside) <= 3 and sum(inside) <= 100
    assert embed.Pace(10, 1000, share=4).requests == 2


def test_long_texts_are_shortened_and_deadlines_kept():
    assert embed.shortened("x" * 400, 100) == "x" * 400 and len(embed.shortened("x" * 4000, 100)) == 380 and embed.shortened("", 1) == ""

    class Broken:
        name, dimension, seen = "b", 2, 0

        def embed(self, texts):
            Broken.seen += 1
            raise embed.RetryLater("busy", 30)

    with pytest.raises(embed.ProviderError, match="no time"):
        embed.Guarded(Broken(), deadline_s=1).embed(["a"])
    assert Broken.seen == 1
    lengths = []

    class Counts:
        name, dimension = "c", 1

        def embed(self, texts):
            lengths.extend(map(len, texts))
            return [[1.0] for _ in texts]

    embed.Guarded(Counts(), batch=2, max_tokens=10).embed(["x" * 100, "y", ""])
    assert lengths == [38, 1, 0]
