"""Store, sources and streaming."""

import json
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking
from quarry.sources import embed, files, store
from quarry.streaming import watch


def rows(spark, *r):
    return spark.createDataFrame(list(r), "id string, content string, file string, start int, end int")


def test_generations(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        s.read()
    s.publish(s.write(rows(spark, ("a:0", "x", "a", 1, 1), ("b:0", "y", "b", 1, 1))))
    s.replace_files(rows(spark, ("a:0", "new", "a", 1, 1)), spark.createDataFrame([("a",)], "file string"))
    assert {(r.id, r.content) for r in s.read().collect()} == {("a:0", "new"), ("b:0", "y")}
    s.delete(spark.createDataFrame([("b:0",)], "id string"))
    s.upsert(rows(spark, ("c:0", "z", "c", 1, 1)))
    assert sorted(r.id for r in s.read().collect()) == ["a:0", "c:0"]
    gone = s.collect_garbage(keep=1, older_s=0, now_ms=int(time.time() * 1000) + 10_000)
    assert len(gone) == 2 and s.read().count() == 2 and s.stats().first().files == 2
    with pytest.raises(store.SchemaMismatch):
        store.check_schema(s.read())


def content(s, generation=None):
    return {r.id: r.content for r in s.read(generation).collect()}


def some(spark, n, mark="x", first=0):
    return rows(spark, *((f"{i}", f"{mark}{i}", f"f{i // 4}", 1, 1) for i in range(first, first + n)))


def names(spark, *f):
    return spark.createDataFrame([(x,) for x in f], "file string")


def written_since(path, before):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file() and f not in before and not f.name.endswith(".crc"))


def test_a_change_writes_what_it_touches(spark, tmp_path):
    """One file of a table of 200 files, then of one of 2,000: the bytes written are of that file's order in both."""
    cost = []
    for n in (200, 2000):
        path = tmp_path / f"t{n}"
        s = store.Store(spark, str(path))
        big = spark.range(n * 20).select(F.col("id").cast("string").alias("id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 8).alias("content"), F.concat(F.lit("f"), (F.col("id") % n).cast("string")).alias("file"), F.lit(1).alias("start"), F.lit(1).alias("end"))
        s.publish(s.write(big, depth=5))
        before = set(path.rglob("*"))
        s.replace_files(rows(spark, ("new", "y", "f7", 1, 1)), names(spark, "f7"))
        cost.append(written_since(path, before))
        whole = sum(f.stat().st_size for f in path.rglob("*.parquet"))
        assert s.read().count() == n * 20 - 19 and [r.id for r in s.read().filter("file = 'f7'").collect()] == ["new"]
    assert cost[1] < 1.5 * cost[0] and cost[1] < 0.01 * whole


def test_untouched_segments_are_scanned_plainly(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    s.publish(s.write(some(spark, 400), depth=5))
    plan = lambda: s.read()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan()
    s.delete(names(spark, "f3"), "file")
    layout = s._layout(s._active())
    hit = [x for x in layout.segments() if x["vectors"]]
    assert len(hit) == 1 and hit[0]["dead"] == 4 and "Join" in plan()
    assert s.scan(F.col("file") == "f3").count() == 0 and s.read().count() == 396


def test_changes_against_a_plain_table(spark, tmp_path):
    """Random changes and maintenance; every generation stays as it was."""
    import random

    rng = random.Random(4)
    s, kept = store.Store(spark, str(tmp_path / "t")), {}
    s.publish(s.write(some(spark, 60)))
    now = {str(i): (f"x{i}", f"f{i // 4}") for i in range(60)}
    for step in range(8):
        kind = step % 4
        if kind == 0:
            files = {f"f{rng.randrange(18)}" for _ in range(3)}
            new = {f"n{step}-{f}": (f"r{step}", f) for f in sorted(files)[:2]}
            now = {i: v for i, v in now.items() if v[1] not in files} | new
            s.replace_files(rows(spark, *((i, c, f, 1, 1) for i, (c, f) in new.items())), names(spark, *files))
        elif kind == 1:
            new = {str(rng.randrange(80)): (f"u{step}", f"f{rng.randrange(25)}") for _ in range(9)}
            now |= new
            s.upsert(rows(spark, *((i, c, f, 1, 1) for i, (c, f) in new.items())))
        elif kind == 2:
            gone = rng.sample(sorted(now), 5)
            now = {i: v for i, v in now.items() if i not in gone}
            s.delete(spark.createDataFrame([(i,) for i in gone], "id string"))
        else:
            s.maintain(split_bytes=2500, most_dead=0.1, most_segments=2)
        kept[s._active()] = dict(now)
        assert {r.id: (r.content, r.file) for r in s.read().collect()} == now, step
    for name, rows_then in kept.items():
        assert {r.id: (r.content, r.file) for r in s.read(name).collect()} == rows_then
    assert {d >> store.DEPTH_AT for d in s._layout(s._active()).buckets} != {store.PAGE_BITS}
    s.collect_garbage(0, 0.0, 1 << 50)
    assert {r.id: (r.content, r.file) for r in s.read().collect()} == now and s.generations().count() == 1


def test_large_buckets_split_and_others_stay(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    hot = [(f"h{i}", "z" * 3000 + str(i), "hot", 1, 1) for i in range(40)]
    s.publish(s.write(rows(spark, *hot, *((f"{i}", f"{i}" * 900, f"f{i}", 1, 1) for i in range(300)))))
    before = s._layout(s._active())
    limit = int(sorted(sum(x["bytes"] for x in b["segments"]) for b in before.buckets.values())[-8])
    assert s.maintain(split_bytes=limit) and s.maintain(split_bytes=1 << 40) is None
    after = s._layout(s._active())
    grown = set(before.buckets) - set(after.buckets)
    assert grown and len(grown) < len(before.buckets)
    for label in grown:  # each split bucket's children share its bits
        depth, bits = store._numbers(label)
        mine = [c for c in after.buckets if store._numbers(c)[0] > depth and store._numbers(c)[1] % (1 << depth) == bits]
        assert sum(2.0 ** -(store._numbers(c)[0] - depth) for c in mine) == 1
    for label in set(before.buckets) & set(after.buckets):
        assert before.buckets[label] == after.buckets[label]
    for df in (s.read(), s.read().withColumn("b", after.column())):
        assert df.count() == 340
    own = s.read().filter("file = 'hot'").select(after.column().alias("b")).distinct().collect()
    assert len(own) == 1 and s.read().select(after.column()).distinct().count() <= len(after.buckets)
    s.upsert(rows(spark, ("h1", "small", "hot", 1, 1), ("new", "n", "f1", 1, 1)))
    assert content(s)["h1"] == "small" and len(content(s)) == 341
    s.maintain(split_bytes=1000)
    s.maintain(split_bytes=1000)
    assert any(b.get("whole") for b in s._layout(s._active()).buckets.values()) and len(content(s)) == 341


def test_directories_of_any_depth(spark):
    df = spark.range(500).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.xxhash64(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("h"))
    even = store.Layout.empty("{}", 4)
    deep = store.Layout.empty("{}", 4)
    for depth, bits in ((4, 3), (5, 19), (6, 51), (7, 51), (8, 51), (9, 51), (10, 51), (11, 51)):
        del deep.buckets[(depth << store.DEPTH_AT) + bits]
        for b in (bits, bits + (1 << depth)):
            deep.buckets[((depth + 1) << store.DEPTH_AT) + b] = {"segments": []}
    flat = store.Layout.empty("{}", 4)
    del flat.buckets[(4 << store.DEPTH_AT) + 1]
    flat.buckets |= {(5 << store.DEPTH_AT) + b: {"segments": []} for b in (1, 17)}
    for layout in (even, flat, deep):
        for r in df.withColumn("b", layout.column()).collect():
            depth, bits = store._numbers(r.b)
            assert r.b in layout.buckets and r.h % (1 << depth) == bits


def test_readers_see_one_generation_or_the_other(spark, tmp_path, monkeypatch):
    """At every step of a change a reader finds the table whole, and a writer that dies in between leaves it as it was."""
    s, reader, seen = store.Store(spark, str(tmp_path / "t")), store.Store(spark, str(tmp_path / "t")), []
    s.publish(s.write(some(spark, 8)))
    old = content(s)
    once, put = store.Store._put_once, store.Store._put

    def look(self, name, text):
        seen.append(content(reader))
        out = (once if name.startswith("_log/") else put)(self, name, text)
        seen.append(content(reader))
        return out

    monkeypatch.setattr(store.Store, "_put_once", look)
    s.replace_files(rows(spark, ("n", "new", "f0", 1, 1)), names(spark, "f0"))
    new = content(s)
    assert new != old and seen == [old, new]
    monkeypatch.setattr(store.Store, "_put_once", lambda *_: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError, match="died"):
        s.delete(names(spark, "f1"), "file")
    assert content(reader) == new
    monkeypatch.setattr(store.Store, "_put_once", once)
    assert reader.generations().filter("active").count() == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    """The slower of two writers does its change again on top of the other's; nothing is lost and no number is given twice."""
    a, b = (store.Store(spark, str(tmp_path / "t")) for _ in range(2))
    a.publish(a.write(some(spark, 8)))
    put, raced = store.Store._put_once, []

    def late(self, name, text):
        if self is a and name.startswith("_log/") and not raced:
            raced.append(name)
            b.upsert(rows(spark, ("from-b", "b", "f9", 1, 1), ("1", "b", "f0", 1, 1)))
        return put(self, name, text)

    monkeypatch.setattr(store.Store, "_put_once", late)
    a.upsert(rows(spark, ("from-a", "a", "f8", 1, 1), ("1", "a", "f0", 1, 1)))
    got = content(a)
    assert raced and got["from-a"] == "a" and got["from-b"] == "b" and got["1"] == "a" and len(got) == 10
    assert a._versions() == [1, 2, 3] and a.manifest()["version"] == 3
    name = a.write(some(spark, 2))
    b.delete(names(spark, "f8"), "file")
    with pytest.raises(store.Conflict):
        a.publish(name, expected=3)
    assert content(a) == content(b) != content(a, name)


def test_creation_happens_once(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    assert s._put_once("_log/x", "first") and not s._put_once("_log/x", "second")
    assert (tmp_path / "t/_log/x").read_text() == "first" and s._names("_log") == ["x"]


def test_lock(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    s.publish(s.write(rows(spark, ("a:0", "x", "a", 1, 1))))
    with s.lock(), pytest.raises(store.Locked), s.lock():
        pass
    with s.lock():
        s.renew()
        s.upsert(rows(spark, ("a:0", "y", "a", 1, 1)))
    assert content(s) == {"a:0": "y"} and s.manifest()["fence"] == 2


def test_a_lock_that_was_taken_over(spark, tmp_path):
    """The first holder can neither publish nor free the second one's lock."""
    a, b = (store.Store(spark, str(tmp_path / "t")) for _ in range(2))
    a.publish(a.write(rows(spark, ("a", "x", "a", 1, 1))))
    first = a.lock()
    first.__enter__()
    with b.lock(stale_s=-1):
        with pytest.raises(store.Fenced):
            a.upsert(rows(spark, ("a", "late", "a", 1, 1)))
        with pytest.raises(store.Fenced):
            a.renew()
        first.__exit__(None, None, None)
        with pytest.raises(store.Locked), store.Store(spark, a.path).lock():
            pass
        b.upsert(rows(spark, ("b", "y", "b", 1, 1)))
    assert content(a) == {"a": "x", "b": "y"}
    with a.lock():
        pass


def test_manifests_are_trimmed_and_marks_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LOG", 3)
    s = store.Store(spark, str(tmp_path / "t"))
    name = s.write(rows(spark, ("a", "x", "a", 1, 1)))
    for i in range(6):
        s.publish(name, marks={"feed": 5 - i})
    assert s._versions() == [4, 5, 6] and s.manifest()["marks"] == {"feed": 5}
    s.publish(name, metric="dot")
    s.upsert(rows(spark, ("b", "y", "b", 1, 1)))
    assert s.manifest()["metric"] == "dot" and s.manifest()["version"] == 8


def test_difference_and_plan(spark):
    f = lambda *r: spark.createDataFrame(list(r), "path string, size long, modified_ms long, hash string")
    now, before = f(("a", 1, 1, "h"), ("b", 2, 2, "n"), ("d", 1, 1, "x")), f(("a", 1, 1, "other"), ("b", 1, 1, "o"), ("c", 1, 1, "x"))
    assert {r.path: r.status for r in store.file_difference(now, before).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "added"}
    chunks = spark.createDataFrame([("b", "x" * 9), ("d", "y" * 4)], "file string, content string")
    p = store.plan(now, now, chunks).first()
    assert (p.added, p.changed, p.removed, p.chunks, p.requests) == (0, 0, 0, 0, 0)


def test_file_tree_and_config(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    return 'é'\n")
    (tmp_path / "node_modules/b.py").write_text("x = 1\n")
    (tmp_path / "src/empty.py").write_text(" \n")
    got = files.file_tree(spark, str(tmp_path)).collect()
    assert [(r.path, r.text) for r in got] == [("src/a.py", "def f():\n    return 'é'\n")]
    (tmp_path / ".quarryrc.json").write_text(json.dumps({"dimension": "32", "include_docs": True, "unknown": 1}))
    assert files.Config.load(str(tmp_path), dimension=None, model="m") == files.Config(dimension=32, include_docs=True, model="m")


def test_embedding(spark, tmp_path):
    e = embed.HashingEmbedder(16)
    a, b, c = e.embed(["load the user", "load the user again", "zebra"])
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    assert dot(a, a) == pytest.approx(1) and dot(a, b) > dot(a, c)
    df = spark.createDataFrame([("load the user",), (None,)], "content string")
    assert embed.embed_column(df, e).first().embedding == pytest.approx(a)
    cache = embed.QueryCache(str(tmp_path), most=1)
    assert cache.vector(e, "q") == cache.vector(e, "q")
    cache.vector(e, "r")
    assert len(list(tmp_path.glob("*.json"))) == 1
    with pytest.raises(ValueError):
        embed.check_vectors([[1.0]], 2, 1)


def test_guard_retries_then_breaks():
    class Failing:
        name, dimension = "f", 1

        def __init__(self, failures):
            self.failures = failures

        def embed(self, texts):
            self.failures -= 1
            if self.failures >= 0:
                raise OSError("down")
            return [[2.0] for _ in texts]

    assert embed.Guarded(Failing(1), pause=0).embed(["a", "b"]) == [[1.0], [1.0]]
    guarded = embed.Guarded(Failing(9), pause=0, breaker_after=2)
    for _ in range(2):
        with pytest.raises(embed.ProviderError):
            guarded.embed(["a"])


def test_incremental_stream(spark, tmp_path):
    feed = str(tmp_path / "feed")
    s = store.Store(spark, str(tmp_path / "t"))
    step = watch.incremental_index(s, lambda f: chunking.chunk_files(f).select(F.concat_ws(":", "file", "chunk_index").alias("id"), "content", "file", "start", "end"))
    put = lambda *r: spark.createDataFrame(list(r), "path string, text string, modified_ms long").coalesce(1).write.mode("append").parquet(feed)
    put(("a.txt", "one", 1), ("b.txt", "two", 1))
    watch.watch(watch.file_feed(spark, feed), step, str(tmp_path / "c"), None).awaitTermination(60)
    put(("a.txt", "three", 2))
    watch.watch(watch.file_feed(spark, feed), step, str(tmp_path / "c"), None).awaitTermination(60)
    assert {(r.file, r.content) for r in s.read().collect()} == {("a.txt", "three"), ("b.txt", "two")}


def test_backoff_gives_up():
    tries = []

    def fail(_, n):
        tries.append(n)
        raise OSError

    with pytest.raises(OSError):
        watch.Backoff(fail, 3, 0)(None, 1)
    assert len(tries) == 3
