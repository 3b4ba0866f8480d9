"""Operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, duplicates, evaluate, graph, groups, knn, ranking, render


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_fusion_prefers_what_both_lists_have(spark):
    s = table(spark, [("a", 0.8, 1), ("b", 0.7, 2)], "k string, similarity double, rank int")
    x = table(spark, [("b", 0.75, 1), ("c", 1.05, 2)], "k string, lexical double, rank int")
    f = {r.k: r.fused for r in ranking.fuse(s, x, ["k"]).collect()}
    assert f["c"] == 1.05 and f["b"] > f["a"]
    assert f["b"] == pytest.approx(0.65 * 0.75 + 0.35 * (1 / 62 + 1 / 61) / (2 / 61))


def test_evidence(spark):
    strong = lambda v: knn.strong_evidence(table(spark, [(x, i + 1) for i, x in enumerate(v)], "similarity double, rank int")).first().strong
    assert strong([0.9, 0.8, 0.75]) and not strong([0.65, 0.6, 0.55]) and not strong([0.9, 0.8])


def test_budget_passes_over_what_does_not_fit(spark):
    rows = table(spark, [(1, 60), (2, 60), (3, 30), (4, 5)], "id int, n int")
    assert [r.id for r in ranking.within_budget(rows, F.col("n"), 100, ["id"]).orderBy("id").collect()] == [1, 3, 4]
    assert [r.id for r in ranking.within_budget(rows, F.col("n"), 10, ["id"]).collect()] == [1]


def _dropped(rows, threshold=0.6, slack=0.02):
    kept = []
    for rank, a, b, s, t in sorted(rows):
        for i, (_, x, y, u, v) in enumerate(kept):
            overlap = max(0, min(b, y) - max(a, x) + 1)
            if overlap / min(b - a + 1, y - x + 1) >= threshold:
                better = s - u > slack or (abs(s - u) <= slack and ((t in ("method", "function") and v == "class") or b - a < y - x))
                if better:
                    kept[i] = (rank, a, b, s, t)
                break
        else:
            kept.append((rank, a, b, s, t))
    return kept


def test_overlaps_like_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(f"f{i % 5}", i, a := rng.randint(1, 60), a + rng.randint(0, 20), rng.choice([0.5, 0.51, 0.7]), rng.choice(["class", "method"])) for i in range(80)]
    df = table(spark, rows, "file string, rank int, start int, end int, score double, symbol_type string")
    got = {(r.file, r["rank"], r.start, r.end) for r in ranking.drop_overlaps(df).collect()}
    want = {(f, k[0], k[1], k[2]) for f in {r[0] for r in rows} for k in _dropped([r[1:] for r in rows if r[0] == f])}
    assert got == want


def test_islands_and_reconstruction(spark):
    df = table(spark, [(1, "f", 1, 2, 0.3), (2, "f", 3, 4, 0.9), (3, "f", 20, 25, 0.1)], "id int, file string, start int, end int, score double")
    got = [(r.start, r.end, r.chunks, r.best_id) for r in ranking.reconstruct(df, ["file"]).orderBy("start").collect()]
    assert got == [(1, 4, 2, 2), (20, 25, 1, 3)]


def chunks(spark, rows):
    return table(spark, [(i, f, a, b, s, "", c) for i, (f, a, b, s, c) in enumerate(rows)], "chunk_id int, file string, start int, end int, symbol string, parent string, content string")


def test_graph(spark):
    c = chunks(spark, [("a.ts", 1, 5, "A", "B()"), ("b.ts", 1, 5, "B", "C() if (x)"), ("c.ts", 1, 5, "C", "done")])
    n, e, m = graph.build(c)
    names = {r.node: r.name for r in n.collect()}
    assert {(names[r.src], names[r.dst]) for r in e.collect()} == {("A", "B"), ("B", "C")}
    at = lambda s: n.filter(F.col("name") == s).select("node")
    assert [(names[r.node], r.depth) for r in graph.impact(e, at("C")).collect()] == [("B", 1), ("A", 2)]
    assert [names[x] for x in graph.trace(e, at("A"), at("C")).first().path] == ["A", "B", "C"]
    assert m.first().coverage == 1.0


def test_ambiguous_calls_make_no_edge(spark):
    c = chunks(spark, [("a.ts", 1, 5, "A", "T()"), ("b.ts", 1, 5, "T", "x"), ("c.ts", 1, 5, "T", "y")])
    _, e, m = graph.build(c)
    assert e.isEmpty() and m.first().ambiguous == 1


def test_split_symbols_are_one_node(spark):
    c = chunks(spark, [("a.ts", 130, 268, "big", "x"), ("a.ts", 269, 310, "big", "y"), ("b.ts", 1, 3, "user", "big()")])
    n, e, _ = graph.build(c)
    assert [(r.start, r.end) for r in n.filter("name = 'big'").collect()] == [(130, 310)] and e.count() == 1


def test_components_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    pairs = [(rng.randint(1, 200), rng.randint(1, 200)) for _ in range(120)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = table(spark, pairs, "a long, b long")
    for n in (1, 7):
        assert {r.node: r.component for r in graph.components(df.repartition(n)).collect()} == {x: find(x) for x in parent}


def test_similar_pairs_in_tiles(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = table(spark, rows, "vec_id long, embedding array<double>")
    one = {(r.a, r.b): round(r.similarity, 9) for r in knn.similar_pairs(df, 0.5).collect()}
    many = {(r.a, r.b): round(r.similarity, 9) for r in knn.similar_pairs(df, 0.5, chunk=16).collect()}
    assert one == many and one


def test_duplicates(spark):
    rows = [(1, "a.ts", 1, 6, "function", "loadUser", "function loadUser(a) { return a + 1 }", "ts", 2, [1.0, 0.0]), (2, "b.ts", 1, 6, "function", "loadItem", "function loadItem(b) { return b + 2 }", "ts", 2, [1.0, 0.1]), (3, "c.ts", 1, 6, "function", "other", "while (true) { throw x }", "ts", 1, [0.0, 1.0])]
    df = table(spark, rows, "id int, file string, start int, end int, symbol_type string, symbol string, content string, language string, complexity int, embedding array<double>")
    c = duplicates.candidates(df)
    g = duplicates.groups(duplicates.pairs(c), c).collect()
    assert len(g) == 1 and g[0].members == [1, 2] and g[0].level == "exact" and g[0].kind == "nearCopy" and g[0].suggested_name == "load" and g[0].savings == 6


def test_survey_and_counts(spark):
    df = table(spark, [("src/stores/a.ts", 0.5, "userStore"), ("src/stores/b.ts", 0.6, "itemStore"), ("src/middleware/x.ts", 0.9, "check")], "file string, score double, symbol string")
    got = [(r.title, r.n) for r in groups.survey(df).orderBy("place").collect()]
    assert got == [("stores / state", 2), ("middleware / guards", 1)]


def test_eval(spark):
    cases = evaluate.read_cases("cases:\n  - query: find it\n    expectedFirstFiles: [a.ts]\n    requiredSymbols:\n      - run\n")
    assert cases == [{"query": "find it", "expectedFirstFiles": ["a.ts"], "requiredSymbols": ["run"], "requiredKinds": []}]
    hits = table(spark, [("find it", 1, "b.ts"), ("find it", 2, "a.ts")], "query string, rank int, item string")
    r = evaluate.scores(hits, evaluate.cases_table(spark, cases)).first()
    assert (r.recall, r.first_rank, r.precision, r.passed) == (0.5, 2, 0.5, False)


PY = '''
import enum

class Color(enum.Enum):
    """Colours that we know of, in order."""
    RED = 1

class Box:
    """A box that holds things for a while."""

    @property
    def size(self):
        return [x for x in self.items if x and x.big or x.small]

    async def load(self, path):
        for p in path:
            if p:
                return p
'''
TS = """import { a,
  b } from "mod/x"
/** Doc. */
export class Store<T> {
  private items = new Map()
  static create(n: number) { return new Store() }
  async load(id: string): Promise<void> {
    if (id) { await a(`${id} }`) }
  }
}
export const useThing = () => { return b("}") }
namespace Deep { export function inner() { return 1 } }
interface Shape { area(): number }
"""


def test_python_chunks():
    got = {c.symbol: c for c in chunking.parse("a.py", PY).chunks}
    assert got["Color"].variant == "enum" and got["Box"].symbol_type == "class"
    assert got["size"].variant == "property" and got["size"].parent == "Box" and got["load"].is_async and got["load"].complexity == 3


def test_brace_chunks():
    got = {c.symbol: c for c in chunking.parse("a.ts", TS).chunks}
    assert got["Store"].exported and got["Store"].documented and got["create"].is_static and got["load"].parent == "Store" and got["load"].is_async
    assert got["load"].start == 7 and got["load"].end == 9 and "mod/x" in got["load"].imports and "a" in got["load"].calls
    assert got["inner"].parent == "Deep" and got["Shape"].symbol_type == "type" and got["useThing"].symbol_type == "function"


def test_vue_java_and_tests():
    vue = chunking.parse("Card.vue", "<template><b/></template>\n<script>\nexport function go() { return 12345678 }\n</script>")
    assert [c.symbol for c in vue.chunks] == ["Card", "go"] and vue.chunks[1].start == 3
    java = {c.symbol: c for c in chunking.parse("A.java", "public abstract class A {\n  @Override\n  public static int run(int x) {\n    return x > 0 ? 1 : 2;\n  }\n}\n").chunks}
    assert java["A"].is_abstract and java["run"].is_static and java["run"].complexity == 2
    tests = chunking.parse("a.test.ts", "describe('x', () => {\n  it('works', () => { expect(1) })\n})").chunks
    assert [c.symbol for c in tests] == ["x", "x > works"]


def test_chunk_sizes():
    lim = chunking.Limits(1000, 50, 60)
    long = chunking.parse("a.txt", "x" * 20000, lim).chunks
    assert len(long) > 1 and all(len(c.content) <= 1000 and c.start == c.end == 1 for c in long)
    prose = chunking.text_chunks("# A\n" + "word " * 60 + "\n\n# B\n" + "more " * 60, lim)
    assert [c.start for c in prose] == [1, 4]
    assert chunking.limits(max_tokens=512).max == 435 * 4 and chunking.limits().max == 8800


def test_overlap(spark):
    df = table(spark, [("f", 0, "a" * 1000), ("f", 1, "b" * 400)], "file string, chunk_index int, content string")
    got = [r.overlapped for r in chunking.with_overlap(df).orderBy("chunk_index").collect()]
    assert got[1] == "..." + "a" * 60 + "\n\n" + "b" * 400


def test_shake(spark):
    files = table(spark, [("a.py", PY)], "path string, text string")
    regions = chunking.fold_regions(files)
    load = regions.filter("name = 'load'").first()
    shown = render.shake(files, regions, table(spark, [("a.py", load.start, load.end)], "file string, start int, end int")).first()
    assert "return p" in shown.text and "x.big" not in shown.text and shown.hidden == 1


def test_audit(spark):
    files = table(spark, [("a", "x\n" * 500), ("b", "y")], "path string, text string")
    taken, cover = render.audit(files.select("path"), table(spark, [("a",)], "file string"), files, batch_tokens=100, max_batches=20)
    assert taken.count() == 5 and cover.first().complete and cover.first().semantic == 0.5
