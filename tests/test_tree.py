"""Trees listed by the executors."""

import os

import pytest

from quarry.sources import files, tree


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "r"
    made = {
        ".gitignore": "*.log\n/only_top.py\nbuild/\n!keep.log\n", "a.py": "a = 1\n", "only_top.py": "x\n", "x.log": "x\n", "keep.log": "kept\n", ".hidden.py": "h = 1\n", "_under.py": "u = 1\n",
        "sub/only_top.py": "below\n", "sub/.ignore": "local.py\n!x.log\n", "sub/local.py": "l\n", "sub/x.log": "again\n", "sub/deep/local.py": "l\n", "sub/deep/.rgignore": "!local.py\n", "sub/deep/b?c[d]{e}*.py": "odd = 1\n",
        "sub/deep/bXc.py": "other = 1\n", "node_modules/m.js": "m\n", ".git/config": "g\n", "build/o.py": "o\n", "empty.py": " \n", "ü/ö.py": "ä = 1\n",
    }
    for path, text in made.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(text)
    os.symlink(top, top / "sub/loop")
    os.symlink(top / "a.py", top / "link.py")
    return top


WANT = {".gitignore", "a.py", ".hidden.py", "_under.py", "sub/only_top.py", "sub/.ignore", "sub/deep/.rgignore", "sub/deep/local.py", "sub/deep/b?c[d]{e}*.py", "sub/deep/bXc.py", "link.py", "ü/ö.py"}


@pytest.mark.parametrize("walk", [tree.WALK, 1])
def test_every_file_that_counts(spark, root, walk):
    found = tree.listing(spark, str(root), skip=(".git", "node_modules"), walk=walk).collect()
    assert {r.path for r in found} == WANT | {"keep.log", "empty.py", "sub/x.log"} and len(found) == len({r.path for r in found})
    assert {r.path: r.size for r in found}["a.py"] == 6


def test_trees_as_tables(spark, root):
    got = files.file_tree(spark, str(root)).collect()
    assert {r.path for r in got} == WANT and {r.path: r.text for r in got}["sub/deep/b?c[d]{e}*.py"] == "odd = 1\n"
    assert {r.path for r in files.file_tree(spark, f"file://{root}", hidden=False).collect()} == {p for p in WANT if not any(x.startswith(".") for x in p.split("/"))}
    assert {r.path for r in files.file_tree(spark, str(root), glob="b*.py").collect()} == {"sub/deep/b?c[d]{e}*.py", "sub/deep/bXc.py"}
    assert "node_modules/m.js" in {r.path for r in files.file_tree(spark, str(root), include=("node_modules/**",)).collect()}


def test_other_file_systems_are_listed_by_spark(spark, root, monkeypatch):
    """Where Python has no access; a file of a similar name doesn't come in with one that has signs of a glob."""
    (root / "sub/deep/bXc[d]{e}*.py").write_text("similar = 1\n")
    (root / ".gitignore").write_text("bX*\n*.log\nbuild/\n")

    def none(_):
        raise ValueError

    monkeypatch.setattr(tree, "opened", none)
    got = {r.path for r in files.file_tree(spark, str(root / "sub/deep")).collect()}
    assert "b?c[d]{e}*.py" in got


def test_rules_of_a_path():
    rules = (("", "*.log\nbuild/\n!keep.log\n# note\n\\!odd\n"), ("a/b", "/x.py\n!z.log\n"))
    out = {p for p in ("x.log", "a/keep.log", "build/x", "build", "a/b/x.py", "a/b/c/x.py", "a/b/z.log", "!odd", "q") if tree.ignored(p, rules)}
    assert out == {"x.log", "build/x", "a/b/x.py", "!odd"}
