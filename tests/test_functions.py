"""Columns and small rules, held against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import classify, ids
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.operators import predicate


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_vectors(spark):
    a, b = F.array(*map(F.lit, (3.0, 4.0))), F.array(*map(F.lit, (4.0, 3.0)))
    r = one(spark, cos=V.cosine(a, b), zero=V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), other=V.cosine(a, F.array(F.lit(1.0))), unit=V.l2_normalize(a), bad=V.is_valid(F.array(F.lit(float("nan"))), 1))
    assert r.cos == pytest.approx(0.96) and r.zero == 0 and r.other == 0 and r.unit == pytest.approx([0.6, 0.8]) and not r.bad
    r = one(spark, c=V.similarity_from_distance(F.lit(0.28)), l2=V.similarity_from_distance(F.lit(1.4**0.5), "l2"), n=V.similarity_from_distance(F.lit(float("nan"))))
    assert (r.c, r.l2, r.n) == (pytest.approx(0.72), pytest.approx(0.3), 0.0)


@pytest.mark.parametrize(
    ("path", "role"),
    [("src/a.ts", "implementation"), ("src/a.test.ts", "test"), ("dist/a.js", "build-artifact"), ("src/generated/x.ts", "generated"), ("a/fixtures/x.ts", "fixture"), ("db/migrations/1.py", "migration"), ("x/types/a.ts", "contract"), ("package.json", "configuration"), ("docs/guide.md", "documentation")],
)
def test_roles(spark, path, role):
    assert one(spark, r=classify.file_role(F.lit(path))).r == role


def test_purposes_order_roles_differently(spark):
    boost = lambda role, purpose: one(spark, b=classify.role_boost(F.lit(role), purpose)).b
    assert boost("implementation", "understand") > boost("test", "understand")
    assert boost("test", "test") > boost("implementation", "test")


def test_ignored_and_globs(spark):
    paths = ["src/a.ts", "node_modules/x/a.ts", "a/b.min.js", "logs/x.txt", "x/keep.log"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.filter(~classify.is_ignored(F.col("p"))).collect()] == ["src/a.ts"]
    assert {r.p for r in df.filter(~classify.is_ignored(F.col("p"), include=("*.log",))).collect()} == {"src/a.ts", "x/keep.log"}
    got = lambda g: {r.p for r in df.filter(classify.matches_any(F.col("p"), [g])).collect()}
    assert got("*.ts") == {"src/a.ts", "node_modules/x/a.ts"} and got("src/**") == {"src/a.ts"} and got("**/*.{js,log}") == {"a/b.min.js", "x/keep.log"}


def test_minified(spark):
    df = spark.createDataFrame([("a.js", "x" * 60000), ("b.js", "short"), ("c.min.css", "x")], "p string, t string")
    assert [r.m for r in df.select(classify.is_minified(F.col("p"), F.col("t")).alias("m")).collect()] == [True, False, True]


def test_tokens(spark):
    assert T.query_tokens("getUserName from the HTTPServer") == ["user", "name", "httpserver"]
    assert one(spark, t=T.identifier_tokens(F.lit("parseXml_file2Go"))).t == ["parse", "xml", "file2", "go"]
    assert T.looks_like_identifier("getUser") and T.looks_like_identifier("a_b") and not T.looks_like_identifier("word") and not T.looks_like_identifier("two words")


def test_relevance_counts_words_symbols_and_paths(spark):
    r = one(spark, x=T.lexical_relevance(["user"], F.lit("user user superuser"), F.lit("UserName"), F.lit("a/user.ts")), none=T.lexical_relevance(["zzz"], F.lit("user"), F.lit(""), F.lit("")))
    assert r.x == pytest.approx(1.0) and r.none == 0


def test_text_similarity(spark):
    s = lambda a, b: one(spark, s=T.text_similarity(F.lit(a), F.lit(b))).s
    assert s("a b c", "a b c") == 1 and s("", "a") is None
    assert s("a b c", "a b d") == pytest.approx(1 / 3)


def test_normal_code_ignores_names_and_comments(spark):
    n = lambda c: one(spark, n=T.normal_code(F.lit(c))).n
    assert n("const a = foo(1) // x") == n("const  bb = bar(22)")
    assert n("return a") != n("throw a")


def test_paths(spark):
    r = one(spark, s=T.path_similarity(F.lit("a/b/c.ts"), F.lit("a/b/d.ts")), l=T.domain_label(F.lit("src/middleware/x.ts")), f=T.domain_label(F.lit("src/my-thing/x.ts")), p=T.common_prefix(F.array(F.lit("load_user"), F.lit("load_item"))))
    assert (r.s, r.l, r.f, r.p) == (pytest.approx(2 / 3), "middleware / guards", "domain / my thing", "load")


def test_result_ids(spark):
    row = one(spark, i=ids.result_id(F.lit("src/ä.ts"), F.lit(3), F.lit(9), F.lit("f")))
    assert ids.decode(row.i) == {"file": "src/ä.ts", "start": 3, "end": 9, "symbol": "f"}
    assert one(spark, d=ids.decode_column(F.lit(row.i))).d.asDict() == ids.decode(row.i)
    for bad in ("", "r:!!", "x:abc"):
        with pytest.raises(ValueError):
            ids.decode(bad)


def test_predicates(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, "cd", "x"), (3, "a%", "y")], "n int, s string, t string")
    got = lambda p, **k: [r.n for r in p.where(df, **k).collect()]
    C, P = predicate.Condition, predicate.Predicate
    assert got(P([C("s", "contains", "a%")])) == [3] and got(P([C("s", "contains", "a%")]), compat=True) == [1, 3]
    assert got(P([C("n", "in", [])])) == [1, 2, 3] and got(P([C("nope", "equals", 1), C("n", "at_least", 2)])) == [2, 3]
    assert got(P([], [[C("n", "equals", 1), C("n", "equals", 3)]], [C("s", "equals", "ab")])) == [3]
    assert predicate.expand_kinds("convexmut*") == ["convexMutation"] and predicate.expand_kinds("convexPrivateQuery") == ["convexInternalQuery"]
    assert predicate.suggest("asinc", ["async", "static"]) == "async"


def test_strict_imports(spark):
    assert one(spark, a=predicate.strict_imports(F.lit("react, 'lodash/fp'"), ["lodash/fp"]), b=predicate.strict_imports(F.lit("react-dom"), ["react"])) == (True, False)
