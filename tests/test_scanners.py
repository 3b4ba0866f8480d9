"""Scanners that go from one mark to the next give what a walk over every character gives; what a task holds is bounded."""

import random

import pandas as pd

from quarry.operators import chunking, statements

MARKS = ["'", '"', "`", "/", "//", "/*", "*/", "\\", "\n", " ", "[", "]", "(", ")", "{", "}", ";", "a", "if (", "x=", "else ", "do ", "while ", "f(", "=>", ",", "\u00a0", "++"]


def by_character(code):
    """blanked() a character at a time."""
    out, i, n, before = list(code), 0, len(code), ""
    while i < n:
        c = code[i]
        begin = i
        if code[i : i + 2] == "//":
            end = code.find("\n", i)
            i = end = n if end < 0 else end
        elif code[i : i + 2] == "/*":
            end = code.find("*/", i + 2)
            i = end = n if end < 0 else end + 2
        elif c in "\"'`" or (c == "/" and before in "(,=:[!&|?{};\n" and "\n" not in code[i : code.find("/", i + 1) + 1]):
            begin, end, within = i + 1, i + 1, False
            while end < n and (code[end] != c or within) and (code[end] != "\n" or c == "`"):
                within = c == "/" and (code[end] == "[" or (within and code[end] != "]"))
                end += 2 if code[end] == "\\" else 1
            before, i = c, end + 1
        else:
            before, i = before if c.isspace() else c, i + 1
            continue
        for k in range(begin, min(end, n)):
            out[k] = code[k] if code[k] == "\n" else " "
    return "".join(out)


def test_blanks_and_braces():
    rng = random.Random(4)
    for _ in range(5000):
        code = "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 40)))
        blank = by_character(code)
        assert chunking.blanked(code) == blank, code
        at, depth = rng.randint(0, len(code)), 0
        ends = (i for i in range(at, len(blank)) if not (depth := depth + (blank[i] == "{") - (blank[i] == "}")))
        assert chunking.matching(blank, at) == next(ends, len(blank) - 1), code


def test_statements_do_not_depend_on_blanks_behind_words():
    plain, wide = "a = 1;b(2)\nif (x) { y }\nz", "a  =\u00a01;b(2)\nif (x)\t{ y }\nz"
    of = lambda code: ["".join(code[x:y].split()) for x, y in statements.statements(code, 0, len(code))]
    assert of(plain) == of(wide) == ["a=1;", "b(2)", "if(x){y}", "z"]


def test_what_a_task_holds(spark, monkeypatch):
    texts = pd.Series(["x" * n for n in (3, 3, 3, 30, 1, 1, 0)] + [None])
    monkeypatch.setattr(chunking, "SOME_FILES", 3)
    monkeypatch.setattr(chunking, "SOME_CHARS", 8)
    pieces = [list(t) for _, t in chunking.some_files(texts, texts)]
    assert [len(p) for p in pieces] == [2, 1, 1, 3, 1] and [x for p in pieces for x in p] == list(texts)
    assert [list(t) for _, t in chunking.some_files(texts[:0], texts[:0])] == [[]]
    files = spark.createDataFrame([(f"f{i}.ts", f"function f{i}(a) {{ return {i} }}") for i in range(20)], "path string, text string").coalesce(1)
    assert sorted(r.symbol for r in chunking.chunk_files(files).collect()) == sorted(f"f{i}" for i in range(20))
