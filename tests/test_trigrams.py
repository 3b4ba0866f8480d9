"""The index of trigrams: formulas of patterns, postings, and searches against scans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical
from quarry.sources import trigrams
from quarry.sources.trigrams import TrigramIndex

WORDS = ["alpha", "Beta", "gamma_ray", "delta", "über", "Straße", "ofx", "of", "x", "naïve", "License", "lic", "end.", "(call)", "İx", "Kelvin", "ab\tc"]
PATTERNS = [
    "alpha", "Licens", "beta|gamma", "(alp|del)(ha|ta)", "a.c", "ga+mma", "x*y", "[Ll]icense", r"\bdelta\b", "^alpha", r"end\.$", "(?i)LICENSE", "(?:of|lic) x", "al(?=pha)", "(?<!x)Beta",
    "über", "Stra.e", "n(a|e|i|o|u)(ï|i)ve", "(lic)?end", "lic{1}ense", "(ab|cd|ef|gh)(ij|kl|mn|op)(qr|st)", "", ".*", "d?elta", r"\(call\)", "no such words", "(delta|zzz|no)", r"\w+ta", "[a-c]lpha", "(alpha|beta.|gamma)x",
    r"ab\tc", "(ab)+", "((de|al)(lta|pha)) ",
]


def texts(n, seed=2):
    rng = random.Random(seed)
    return [None, "", "a", "of"] + ["\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts(300))] + [(None, "alpha of", "y"), (5, "alpha", "y"), (5, "alpha", "y")], "doc_id long, text string, folder string").repartition(3)
    return df, TrigramIndex.build(df, str(tmp_path_factory.mktemp("trigrams")), folder_bytes=2000)


def fits(formula, text):
    own = {int(x) for x in trigrams.trigrams([text])[1]}

    def test(f):
        if f is True:
            return True
        if isinstance(f[0], int):
            return any(f[0] <= x <= f[1] for x in own)
        return (all if f[0] == "and" else any)(map(test, f[1]))

    return test(formula)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_what_matches_satisfies_the_formula(pattern):
    formula = trigrams.of_pattern(pattern)
    for t in texts(300, 7):
        if t is not None and re.search(pattern, t, re.MULTILINE | re.IGNORECASE):
            assert fits(formula, t), t


def test_formulas():
    t = lambda s: (trigrams.code(s.encode()),) * 2
    assert trigrams.of_pattern("abcd") == ("and", [t("abc"), t("bcd")])
    assert trigrams.of_pattern("ab(c|d)") == ("or", [t("abc"), t("abd")])
    assert trigrams.of_pattern("abc.*xyz") == ("and", [t("abc"), t("xyz")])
    assert trigrams.of_pattern("ABC|xyz") == ("or", [t("abc"), t("xyz")])
    assert trigrams.of_literal("of") == (trigrams.code(b"of\0"), trigrams.code(b"of\xff"))
    for free in (r"\Qabc\E", "[abc&&[bcd]]", r"\vabc", "abc|.", "(abc)?", r"(abc)\1", "(", "a{2}", "ü"):
        assert trigrams.of_pattern(free) is True, free


def test_postings_of_any_gaps():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 1000):
        for most in (n, 300, 10**6, 2**33):
            x = np.unique(rng.integers(0, max(most, n), n))
            assert trigrams.unpacked(trigrams.packed(x)).tolist() == x.tolist()
    assert len(trigrams.packed(np.arange(1000))) == 1000


@pytest.mark.parametrize(("fixed", "ignore_case"), [(True, False), (True, True), (False, False), (False, True)])
def test_same_lines_as_a_scan(index, fixed, ignore_case):
    df, idx = index
    for pattern in WORDS if fixed else PATTERNS[::2]:
        pattern = pattern.upper() if ignore_case and fixed else pattern
        want = lexical.grep(df, pattern, ["doc_id", "folder"], fixed=fixed, ignore_case=ignore_case)
        got = idx.grep(pattern, ["doc_id", "folder"], fixed, ignore_case)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), pattern


def test_same_ranks_as_a_scan(index):
    df, idx = index
    for query in ("alpha Beta of", "no such words here", "x", "License gamma"):
        want = lexical.retrieve(df, query, 20, "text", None, "folder", "doc_id").select("doc_id", "lexical", "rank")
        assert sorted(map(str, idx.retrieve(query, 20, "folder", "doc_id").select("doc_id", "lexical", "rank").collect())) == sorted(map(str, want.collect()))


def test_texts_and_folders_that_are_read(spark, tmp_path):
    """A word of three texts among 2,000: three texts come out of the index, from three folders of forty or so."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS[:6]) for _ in range(30)) + (" Zanzibar" if i in (17, 900, 1999) else "")) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    idx = TrigramIndex.build(df, str(tmp_path / "t"), folder_bytes=8000)
    found = idx.rows(trigrams.of_literal("zanzibar"))
    every = spark.read.parquet(f"{tmp_path}/t/texts")
    assert sorted(r.doc_id for r in found.collect()) == [17, 900, 1999]
    assert len(found.inputFiles()) >= 3 and every.select("__folder").distinct().count() > 30
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "__folder" in scan.split("PartitionFilters: [")[1].split("]")[0]
    read = every.filter(F.col("__folder").isin([r[0] for r in idx.candidates(trigrams.of_literal("zanzibar")).select("__folder").distinct().collect()]))
    assert read.count() < 0.15 * 2000
    assert idx.grep("Zanzibar", ["doc_id"], fixed=True).count() == 3 and idx.grep("Zan.ibar", ["doc_id"]).count() == 3
