"""What the queries with SQL don't reach: ignore files, buckets of the store, tiles, deadlines, cuts inside characters."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, knn, predicate, ranking
from quarry.sources import embed, files, store


def test_ignore_files(spark, tmp_path):
    tree = {
        ".gitignore": "*.tmp\n/docs/\n!keep.tmp\n# note\n\n", "src/a.py": "x = 1\n", "src/.ignore": "gen\nb.py\n", "src/b.py": "y\n", "src/gen/c.py": "z\n",
        "src/sub/b.py": "q\n", "a.tmp": "l\n", "src/keep.tmp": "k\n", "docs/r.py": "r\n", "src/docs/r.py": "r\n", "b.py": "outer\n", "node_modules/n.py": "n\n",
    }
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert sorted(r.path for r in files.file_tree(spark, str(tmp_path), hidden=False).collect()) == ["b.py", "src/a.py", "src/docs/r.py", "src/keep.tmp"]
    assert files.file_tree(spark, str(tmp_path / "node_modules")).count() == 1


def test_a_change_writes_only_its_buckets(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "t"))
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("content"), F.concat(F.lit("f"), (F.col("id") % 100).cast("string")).alias("file"), F.lit(1).alias("start"), F.lit(1).alias("end"))
    first = s.write(rows, depth=6)
    s.publish(first)
    last = s.replace_files(rows.filter("file = 'f7'").withColumn("content", F.lit("new")), spark.createDataFrame([("f7",)], "file string"))
    assert len(s.own_buckets(last)) == 1 and len(s.own_buckets(first)) > 20
    got = s.read()
    assert got.count() == 300 and got.filter("content = 'new'").count() == 3
    assert sorted(s.collect_garbage(0, 0.0, 1 << 50)) == [first] and s.read().count() == 300


@pytest.mark.parametrize("chunk", [7, 1000])
def test_tiles(spark, chunk):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = [(i, x.tolist(), i % 2) for i, x in enumerate(v)] + [(100, None, 0), (101, [1.0], 0), (102, [0.0] * 8, 0), (103, [None] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit @ unit.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.4}
    assert {(r.a, r.b) for r in knn.similar_pairs(df, 0.4, chunk=chunk).collect()} == want
    assert {(r.a, r.b) for r in knn.similar_pairs(df, 0.4, block="label", chunk=chunk).collect()} == {(i, j) for i, j in want if i % 2 == j % 2}
    near = knn.self_knn(df.filter("vec_id < 60"), 3, chunk=chunk).collect()
    for i in range(60):
        order = sorted((-s[i, j], j) for j in range(60) if j != i)[:3]
        assert [r.b for r in sorted((r for r in near if r.a == i), key=lambda r: r["rank"])] == [j for _, j in order]
    assert knn.similar_pairs(df.limit(0), 0.1).count() == 0


def test_deadline_of_a_query():
    with pytest.raises(embed.DeadlineExceeded):
        embed.within(0.05, lambda: time.sleep(1))
    assert embed.within(5, lambda: [1.0]) == [1.0]


@pytest.mark.parametrize("style", ["openai", "ollama", "gemini"])
def test_a_provider_over_http(style):
    class Answers(BaseHTTPRequestHandler):
        asked = 0

        def do_POST(self):
            Answers.asked += 1
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            texts = [r["content"]["parts"][0]["text"] for r in asked["requests"]] if style == "gemini" else asked["input"]
            if Answers.asked == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            vectors = [[float(len(t)), 1.0] for t in texts]
            body = {"embeddings": [{"values": v} for v in vectors]} if style == "gemini" else {"embeddings": vectors} if style == "ollama" else {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(vectors)))]}
            self.send_response(200 if "bad" not in texts else 400)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        e = embed.Guarded(embed.HttpEmbedder(f"http://127.0.0.1:{server.server_port}/", "m", 2, style), pause=0.01)
        out = e.embed(["", "abc"])
        assert out[0] == pytest.approx([0.0, 1.0]) and out[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and Answers.asked == 2
        with pytest.raises(ValueError):
            e.embed(["bad"])
    finally:
        server.shutdown()


def test_budget_by_bytes_cuts_between_characters(spark):
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, "éé😀"), (4, "z")], "k long, content string")
    got = [(r.k, r.content, r.partial) for r in ranking.byte_fit(df, 7, ["k"]).orderBy("k").collect()]
    assert got == [(1, "ab", False), (2, "", False), (3, "éé", True)]
    assert [r.k for r in ranking.prefix_budget(df, F.octet_length("content"), 7, ["k"]).orderBy("k").collect()] == [1, 2]
    assert ranking.prefix_budget(df, F.octet_length("content"), 100, ["k"]).count() == 4


def test_parameters():
    assert predicate.checked({"query": " q ", "limit": 5, "exact": True})["query"] == "q"
    for wrong in ({}, {"query": "q", "limit": 501}, {"query": "q", "hybrid": "yes"}, {"query": "q", "unknown": 1}, {"query": "q", "purpose": "sleep"}):
        with pytest.raises(ValueError):
            predicate.checked(wrong)


def test_normal_forms_keep_numbers_and_names_apart(spark):
    codes = {"f(1)": "$ID($$ID)", "f(x)": "$ID($ID)", "this$ foo$ 9$NUM 1. 5px": "this$ $ID$ $$ID $$ID. 5px", "x = 'a b' // c": "$ID = '$$ID'", "for (let i = 0;;) $f()": "for (let $ID = $$ID;;) $$ID()"}
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    assert {r.code: r.n for r in df.select("code", T.normal_code(F.col("code")).alias("n")).collect()} == codes
    python = df.limit(1).select(T.normal_code(F.lit("def f(self): return getattr(x, 'y') # z"), "python").alias("n")).first().n
    assert python == "def $ID(self): return getattr($ID, '$$ID')"


def test_calls_are_not_declarations():
    code = "class A {\n  run(a: string): void {\n    return go(a).then(x)\n  }\n  int area();\n}\nfunction top() { new B(); await api.get(1) }"
    assert chunking.call_targets(code) == ["go", "B", "api.get"]
