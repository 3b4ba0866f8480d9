"""A graph that is kept up equals one that is built anew, after random changes of files."""

import random

import pytest

from quarry.operators import graph
from quarry.sources.graph_index import GraphIndex
from quarry.sources.store import Conflict

CHUNKS = "chunk_id string, file string, start int, end int, symbol string, parent string, content string, calls string, imports string"
NAMES = [f"fn{i}" for i in range(14)] + ["Base", "useThing", "Widget"]


def some_file(rng, f):
    """Chunks of a file: definitions that call, extend and import by random names, and one chunk without a symbol."""
    out, at = [], 1
    for k in range(rng.randint(1, 4)):
        name = rng.choice(NAMES)
        called = rng.sample([*NAMES, "api.fn3", "missing", "x.fn5"], 3)
        content = f"function {name}() {{ {' '.join(c + '()' for c in called)} {'extends Base' if rng.random() < 0.3 else ''} {'db.query(' + chr(39) + 'users' + chr(39) + ')' if rng.random() < 0.3 else ''} <Widget>"
        out.append((f"{f}:{k}", f, at, at + 4, name, "", content, ",".join(called) if rng.random() < 0.7 else None, rng.choice(["react", "a/b,c", "", None])))
        at += 9
    return [*out, (f"{f}:x", f, at, at, None, None, "fn1(); fn2()", None, None)]


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def same(index, chunks):
    n, edges, metrics = graph.build(chunks)
    assert rows(index.nodes(), *sorted(n.columns)) == rows(n, *sorted(n.columns))
    assert rows(index.edges(), "src", "dst", "kind", "confidence") == rows(edges, "src", "dst", "kind", "confidence")
    assert rows(index.metrics(), *sorted(metrics.columns)) == rows(metrics, *sorted(metrics.columns))


def test_equal_to_a_rebuild(spark, tmp_path):
    rng = random.Random(12)
    table = {f"f{i}": some_file(rng, f"f{i}") for i in range(12)}
    frame = lambda files: spark.createDataFrame([c for f in files for c in table.get(f, [])], CHUNKS)
    index = GraphIndex(spark, str(tmp_path / "g"))
    index.build(frame(table), "g0")
    same(index, frame(table))
    for step in range(3):
        touched = rng.sample([*table, f"new{step}"], 2)
        for f in touched:
            if rng.random() < 0.25 and f in table:
                del table[f]
            else:
                table[f] = some_file(rng, f)
        index.update(frame(touched), spark.createDataFrame([(f,) for f in touched], "file string"), f"g{step + 1}")
        same(index, frame(table))
    assert index.state()["source"] == "g3"


def test_files_that_are_looked_at_again(spark, tmp_path):
    """A body that changes without its names concerns its file alone; a second definition concerns all who call it."""
    one = lambda f, name, called: (f"{f}:0", f, 1, 5, name, "", f"{name}() {{ {called}() }}", called, None)
    table = {f"f{i}": one(f"f{i}", f"fn{i}", "fn0") for i in range(6)} | {"g": one("g", "other", "fn3")}
    index = GraphIndex(spark, str(tmp_path / "g"))
    index.build(spark.createDataFrame(list(table.values()), CHUNKS))
    update = lambda *c: {r.file for r in index.update(spark.createDataFrame(list(c), CHUNKS), spark.createDataFrame([(x[1],) for x in c], "file string")).collect()}
    assert update(one("f3", "fn3", "fn1")) == {"f3"}
    assert update(one("new", "fn0", "fn5")) == {"new", "f0", "f1", "f2", "f4", "f5"}
    table |= {"f3": one("f3", "fn3", "fn1"), "new": one("new", "fn0", "fn5")}
    same(index, spark.createDataFrame(list(table.values()), CHUNKS))
    index.stores["nodes"].delete(spark.createDataFrame([("f1",)], "file string"), "file")  # as by an update that died in between
    with pytest.raises(Conflict):
        update(one("f1", "fn1", "fn2"))
