"""Statements, definitions of complexity, and how long code is dealt into chunks."""

import ast

import pytest

from quarry.operators import chunking, statements

STATEMENTS = [
    "const a = 1", "const b = x\n  .map(y => y)\n  .filter(Boolean)", "if (a) {\n  f()\n}\nelse {\n  g()\n}", "if (q)\n  h()", "foo();", "bar()", "do {\n  i++\n} while (i < 3)",
    "const o = {\n  a: 1,\n}", "for (const k of v) { t(k) }", "u()", "i++", "try { a() } catch { b() }\nfinally { c() }", "const f = (x) =>\n  x + 1", "return a &&\n  b",
]


def found(code):
    return [code[a:b] for a, b in statements.statements(code, 0, len(code))]


def test_statements_one_by_one_and_together():
    for s in STATEMENTS:
        assert found(s) == [s]
    assert found("\n".join(STATEMENTS)) == STATEMENTS
    assert found("") == [] and found(" \n;\n") == [] and found("}") == ["}"]


@pytest.mark.parametrize(
    ("code", "indexer", "language", "java"),
    [
        ("", 0, 0, 0), ("if (a && b || c) { x = a + b }", 1, 6, 3), ("do { i++ } while (i)", 1, 1, 1), ("switch (z) { case 1: case 2: return -1; default: p() }", 4, 4, 4),
        ("x.if(a).catch(b); o = { for: 1 }", 0, 0, 0), ("for (const k in o) {}", 1, 1, 1), ("a ? b : c", 0, 0, 0), ("if (a < b) { f(x => y) }", 1, 2, 1),
    ],
)
def test_scores(code, indexer, language, java):
    assert [statements.score(code, d) for d in ("indexer", "language", "java")] == [indexer, language, java]


def test_python_scores():
    count = lambda code: statements.python_score(ast.parse(code))
    assert count("if a:\n pass\nelif b:\n pass\nelse:\n if c:\n  pass") == 2
    assert count("x = a and b and c or d") == 6 and count("x = [i for i in y if i if y]") == 3 and count("x = {i for i in y if i}") == 1
    assert count("try:\n pass\nexcept A:\n pass\nwith x:\n pass\nmatch y:\n case 1:\n  pass") == 5
    with pytest.raises(ValueError):
        statements.score("", "other")


def test_pieces_lose_no_statement():
    lim = chunking.Limits(4000, 10, 10, (400, 300, 200))
    for n in (1, 3, 8, 30):
        for width in (5, 60, 500):
            body = [f'  call{k}("{"x" * width}")' for k in range(n)]
            code = "\n".join(["", "export async function big(a,", "    b) {", *body, "}", ""])
            chunks = chunking.parse("a.ts", code, lim).chunks
            assert all(c.symbol == "big" and c.exported and c.is_async for c in chunks)
            own = "".join(c.content for c in chunks)
            assert all(own.count(f"call{k}(") >= 1 for k in range(n)) and own.count("x") >= n * width
            if len(code) - 2 > 400:
                assert len(chunks) > 1 and all(c.content.startswith(("export async function big(a,\n    b) {", "// Context: big\n\nexport")) for c in chunks)
                assert chunks[-1].content.endswith("}") and chunks[-1].end == n + 4
            assert [c.start for c in chunks] == sorted(c.start for c in chunks)


def test_large_class_is_cut_before_its_first_method():
    lim = chunking.Limits(4000, 10, 10, (200, 200, 200))
    code = "export class Box {\n  size = 1\n  get(a) {\n" + "    f(a)\n" * 40 + "  }\n}\n"
    chunks = chunking.parse("a.ts", code, lim).chunks
    assert chunks[0].content == "export class Box {\n  size = 1" and chunks[0].end == 2
    assert len(chunks) > 2 and all(c.symbol == "get" and c.parent == "Box" for c in chunks[1:])


def test_small_declarations_go_to_what_names_them():
    got = chunking.parse("a.ts", "const low = 123\nconst high = low + 1\nfunction f() { return high }\nconst other = 123456\nexport const open = 123456\nfunction g() { return 1 + open }\n").chunks
    assert [c.symbol for c in got] == ["f", "other", "open", "g"] and got[0].start == 1 and got[0].content.startswith("const low")


def test_statement_without_body_and_odd_text():
    for code in ("function f() {}", "function f() {", "class A {", "const a = (", "namespace N { }", "}}}}{{{", "export function f(){" + "\u00e9;" * 3000 + "}"):
        assert chunking.parse("a.ts", code * 3).chunks is not None
