"""Folds in order, against loops over the whole list."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import ranking
from quarry.sources import store


def loop(rows, budget, first_always):
    used, out = 0, []
    for i, cost in rows:
        if used < budget and ((first_always and not out) or used + cost <= budget):
            used, out = used + cost, [*out, i]
    return out


@pytest.mark.parametrize("first_always", [True, False])
@pytest.mark.parametrize("budget", [1, 7, 40, 3000])
def test_budgets(spark, budget, first_always):
    rng = random.Random(budget)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([1, 1, 2, 5, 9, 50, 2000, 5000])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, k string, cost int").repartition(5)
    got = sorted(r.id for r in ranking.within_budget(df, F.col("cost"), budget, ["id"], first_always=first_always).collect())
    assert got == loop([(i, c) for i, _, c in rows], budget, first_always)
    down = sorted(r.id for r in ranking.within_budget(df, F.col("cost"), budget, [F.col("id").desc()], first_always=first_always).collect())
    assert down == sorted(loop([(i, c) for i, _, c in rows[::-1]], budget, first_always))
    keyed = sorted(r.id for r in ranking.within_budget(df, F.col("cost"), budget, ["id"], ["k"], first_always).collect())
    assert keyed == sorted(x for k in ("a", "b", "c", None) for x in loop([(i, c) for i, own, c in rows if own == k], budget, first_always))


def test_a_budget_of_ten_million_rows(spark):
    """No task holds more than the rows that can come: the plan has no window over everything, and little is shuffled."""
    df = spark.range(0, 10_000_000, 1, 8).select("id", (F.col("id") % 7 + 1).alias("cost"))
    out = ranking.within_budget(df, F.col("cost"), 500, ["id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan and "windowspecdefinition(id" not in plan.replace(" ", "").lower()
    assert [r.id for r in out.collect()] == loop([(i, i % 7 + 1) for i in range(2000)], 500, True)
    many = ranking.within_budget(df, F.col("cost"), 5000, ["id"])
    assert sorted(r.id for r in many.collect()) == loop([(i, i % 7 + 1) for i in range(20_000)], 5000, True)


def test_bytes_that_fit(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("aé€😀") for _ in range(rng.choice([0, 0, 1, 3, 8])))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, content string").repartition(4)
    for most in (0, 1, 5, 100, 313, 10**6):
        want, used = [], 0
        for i, t in rows:
            size = len(t.encode())
            if used + size > most:
                head = t.encode()[: most - used].decode(errors="ignore")
                want += [(i, head, True)] if head else []
                break
            used += size
            want.append((i, t, False))
        out = ranking.byte_fit(df, most, ["id"])
        assert sorted(map(tuple, out.collect())) == want
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
        whole = [i for i, _, partial in want if not partial]
        assert sorted(r.id for r in ranking.prefix_budget(df, F.octet_length("content"), most, ["id"]).collect()) == whole


def overlaps(rows, threshold=0.6, slack=0.02):
    kept = []
    for rank, start, end, score, kind in sorted(rows):
        for at, (_, s, e, old, other) in enumerate(kept):
            common = max(0, min(end, e) - max(start, s) + 1) / min(max(1, end - start + 1), max(1, e - s + 1))
            if common >= threshold:
                close = abs(score - old) <= slack and ((kind in ("method", "function") and other == "class") or end - start < e - s)
                if score - old > slack or close:
                    kept[at] = (rank, start, end, score, kind)
                break
        else:
            kept.append((rank, start, end, score, kind))
    return [(at, *k) for at, k in enumerate(kept)]


def test_overlaps_by_stretches(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        start = rng.randrange(900)
        rows.append((rng.choice("ab"), i, start, start + rng.choice([0, 3, 10, 40]), round(rng.random(), 2), rng.choice(["class", "method", "function", ""])))
    df = spark.createDataFrame(rows, "file string, rank int, start int, end int, score double, symbol_type string")
    got = {}
    for r in ranking.drop_overlaps(df).collect():
        got.setdefault(r.file, []).append((r.place, r["rank"], r.start, r.end, r.score, r.symbol_type))
    for f in "ab":
        assert sorted(got[f]) == overlaps([r[1:] for r in rows if r[0] == f])
    stretches = ranking.islands(df, ["file"], 0, order="rank").groupBy("file", "island").count()
    assert stretches.count() > 10


def test_retention(spark):
    rng = random.Random(2)
    rows = [(f"g{i:03d}", rng.randrange(50) * 1000, rng.random() < 0.1) for i in range(200)]
    df = spark.createDataFrame(rows, "generation string, modified_ms long, active boolean")
    for keep in (0, 3, 500):
        order = sorted((r for r in rows if not r[2]), key=lambda r: (-r[1], r[0]))
        want = sorted(g for g, t, _ in order[keep:] if t < 40_000 - 5000)
        assert sorted(r.generation for r in store.expired(df, keep, 5.0, 40_000).collect()) == want
