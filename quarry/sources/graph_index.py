"""A symbol graph that is kept up: a change of files costs what it touches.

Four tables lie in stores of their own, each by the file of its rows, or by name: nodes, definitions by name, what every
file wants to call, and edges with each file's counts. When files change, their nodes and wants are made anew; names that
they defined before or define now are looked up with all their definitions; and edges are resolved again for the changed
files and for those other files alone that want a name whose definitions have changed. All else stays where it is.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import graph
from quarry.operators.graph import written
from quarry.sources.store import Conflict, Store

_TABLES = ("nodes", "definitions", "wants", "edges")


class GraphIndex:
    """The graph of a store's chunks under one folder; ``source`` is the generation of chunks that it is of."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.stores = {name: Store(spark, f"{self.path}/{name}") for name in _TABLES}
        self._top = Store(spark, f"{self.path}/top")

    def state(self) -> dict | None:
        """The four tables' generations that belong together, and source."""
        found = self._top.manifest()
        return json.loads(found["generation"]) if found else None

    def _read(self, name: str) -> DataFrame:
        return self.stores[name].read(self.state()[name], required=())

    def _publish(self, source: str, expected: int) -> None:
        now = {name: s.manifest()["generation"] for name, s in self.stores.items()}
        self._top.publish(json.dumps(now | {"source": source}), expected)

    # reading

    def nodes(self) -> DataFrame:
        """node, name, file, parent, start, end; modules and tables among them."""
        made = self._read("edges").filter("kind IN ('schema-table', 'import')")
        return self._read("nodes").unionByName(graph.extra_nodes(made))

    def edges(self) -> DataFrame:
        return self._read("edges").filter("kind <> ''").select("src", "dst", "kind", "confidence")

    def metrics(self) -> DataFrame:
        counts = self._read("edges").filter("kind = ''").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("unresolved", "ambiguous")))
        return graph.metrics(self.edges(), counts)

    # writing

    def build(self, chunks: DataFrame, source: str = "") -> None:
        """The whole graph of chunks."""
        before = (self._top.manifest() or {"version": 0})["version"]
        n = written(graph.nodes(chunks))
        wants, made = self._parts(chunks, n)
        rows = {"nodes": n, "definitions": _by_name(n), "wants": wants.unionByName(made), "edges": self._edges(wants, made, n)}
        for name, df in rows.items():
            self.stores[name].publish(self.stores[name].write(df))
        self._publish(source, before)

    def update(self, chunks: DataFrame, touched: DataFrame, source: str = "") -> DataFrame:
        """Take in a change: touched(file) are the files that are new, changed or gone, chunks their chunks as they are now.

        Returns the files whose edges were resolved again. Conflict if somebody else has changed the graph meanwhile: its
        tables are then read as they were, and the graph is built anew.
        """
        before = self._top.manifest()["version"]
        if any(s.manifest()["generation"] != self.state()[name] for name, s in self.stores.items()):
            raise Conflict(f"an update of the graph in {self.path} has not come to its end: build it anew")
        t = written(touched.select("file").distinct())
        n = written(graph.nodes(chunks))
        wants, made = (written(x) for x in self._parts(chunks, n))
        gone = self._read("nodes").join(t, "file", "left_semi")
        names = written(gone.select("name").union(n.select("name")).distinct())  # what was defined there, or is
        known = self._read("definitions").withColumnRenamed("file", "name").join(names, "name", "left_semi")
        kept = known.withColumnRenamed("in_file", "file").join(t, "file", "left_anti").select("node", "name", "file")
        now = written(kept.unionByName(n.select("node", "name", "file")))
        # a want looks at the definitions of its name, and of the name behind its last dot
        changed = written(_different(known.withColumnRenamed("in_file", "file"), now))
        others = self._read("wants").filter("target IS NOT NULL").join(t, "file", "left_anti")
        others = others.select("file", F.explode(F.array_distinct(F.array("target", graph.last_part()))).alias("name")).join(changed, "name", "left_semi")
        again = written(others.select("file").distinct())
        old = self._read("wants").join(again, "file", "left_semi")
        whole, own = old.filter("target IS NOT NULL").unionByName(wants), old.filter("target IS NULL").unionByName(made)
        self.stores["nodes"].replace_files(n, t)
        self.stores["definitions"].replace_files(_by_name(now), names.withColumnRenamed("name", "file"))
        self.stores["wants"].replace_files(wants.unionByName(made), t)
        asked = whole.select(F.explode(F.array_distinct(F.array("target", graph.last_part()))).alias("file")).distinct()
        defined = self.stores["definitions"].read(required=()).join(asked, "file", "left_semi").select("node", F.col("file").alias("name"), F.col("in_file").alias("file"))
        files = t.unionByName(again).distinct()
        self.stores["edges"].replace_files(self._edges(whole, own, written(defined)), files)
        try:
            self._publish(source, before)
        except Conflict:
            raise Conflict(f"the graph in {self.path} was changed by another writer: build it anew") from None
        return again.unionByName(t).distinct()

    @staticmethod
    def _parts(chunks: DataFrame, n: DataFrame) -> tuple[DataFrame, DataFrame]:
        """src, file, target, kind, dst of what chunks want (no dst) and make (no target)."""
        at = graph.placed(chunks, n)
        wants = graph.wanted(at).select("src", "file", "target", "kind", F.lit(None).cast("string").alias("dst"))
        return wants, graph.made(at).select("src", "file", F.lit(None).cast("string").alias("target"), "kind", "dst").distinct()

    @staticmethod
    def _edges(wants: DataFrame, made: DataFrame, definitions: DataFrame) -> DataFrame:
        """file, src, dst, kind, confidence of each edge, and a row without a kind for each file's counts."""
        found = written(graph.resolved(wants.select("src", "file", "target", "kind"), definitions.select("node", "name", "file")))
        edges = graph.joined(found, made, "file").withColumns({"unresolved": F.lit(None).cast("long"), "ambiguous": F.lit(None).cast("long")})
        none = F.lit("").alias
        counts = graph.missing(found, "file").select("file", none("src"), none("dst"), none("kind"), none("confidence"), "unresolved", "ambiguous")
        return edges.unionByName(counts)


def _by_name(n: DataFrame) -> DataFrame:
    """Definitions in the store of names, whose rows lie by name."""
    return n.select(F.col("name").alias("file"), "node", F.col("file").alias("in_file"))


def _different(before: DataFrame, now: DataFrame) -> DataFrame:
    """name of those whose definitions are other ones than before."""
    as_set = lambda df, to: df.groupBy("name").agg(F.array_sort(F.collect_set("node")).alias(to))
    both = as_set(before, "b").join(as_set(now, "n"), "name", "full_outer")
    return both.filter(~F.col("b").eqNullSafe(F.col("n"))).select("name")
