"""Queries over the whole of their tables, against brute force."""

import math
import random
import re

from quarry.functions import text as T
from quarry.operators import groups, knn, predicate
from quarry.plans import catalogue


def normal(code):
    reserved = "|".join(map(re.escape, T.RESERVED["javascript"]))
    steps = [
        (r"(?<![A-Za-z0-9_])\d+\.?\d*(?![A-Za-z0-9_])", "Nn"),
        (r'"[^"]*"', '"Ss"'),
        (r"'[^']*'", "'Ss'"),
        (r"`[^`]*`", "`Ss`"),
        (r"(?s)/\*.*?\*/", ""),
        (r"//.*", ""),
        (r"#.*", ""),
        (rf"(?<![A-Za-z0-9_$])(?!(?:{reserved})(?![A-Za-z0-9_$]))[A-Za-z_$][A-Za-z0-9_$]*", "$ID"),
        (r"\s+", " "),
    ]
    for pattern, to in steps:
        code = re.sub(pattern, lambda m, to=to: to, code)
    return code.strip()


def similarity(x, y):
    """Text similarity as the reference has it."""
    a, b = (re.findall(r"[A-Za-z_$][A-Za-z0-9_$]*|\d+|[^\s]", re.sub(r"\s+", " ", t).strip()) for t in (x, y))
    if not a or not b:
        return None
    if x == y:
        return 1.0
    g, h = (set(zip(t, t[1:], strict=False)) for t in (a, b))
    return len(g & h) / len(g | h) * math.sqrt(min(len(a), len(b)) / max(len(a), len(b))) if g and h else 0.0


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y, strict=True)) / math.hypot(*x) / math.hypot(*y)


def components(nodes, edges):
    """The least member of each node's component."""
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def put(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


DOCUMENTS, EMBEDDINGS = "doc_id long, text string, lang string, source string, n_chars long", "vec_id long, embedding array<float>, label int"


def test_duplicate_groups_of_documents_without_vectors(spark, tmp_path):
    rng = random.Random(11)
    texts = [" ".join(rng.choice(["if", "a", "7", "(", ")", ";", "{", "x.y", "'s'"]) for _ in range(20)) for _ in range(12)]
    docs = [(i, rng.choice(texts), rng.choice(["en", "fr"]), f"src{i % 3}") for i in range(40)]
    vectors = {i: [rng.gauss(0, 1) for _ in range(3)] for i in [*range(0, 40, 4), 90]}
    put(spark, tmp_path, "documents", [(*d, len(d[1])) for d in docs], DOCUMENTS)
    put(spark, tmp_path, "embeddings", [(i, v, 0) for i, v in vectors.items()], EMBEDDINGS)
    edges = []
    for i, x, lang, _ in docs:
        for j, y, other, _ in docs:
            if i < j and lang == other:
                u, v = normal(x), normal(y)
                if u == v:
                    edges.append((i, j))
                elif i in vectors and j in vectors and similarity(u, v) >= 0.1 and 0.8 * cosine(vectors[i], vectors[j]) + 0.2 * similarity(u, v) >= 0.7:
                    edges.append((i, j))
    least = components(range(40), edges)
    groups = [sorted(i for i in least if least[i] == c) for c in set(least.values())]
    want = sorted(",".join(map(str, g)) for g in groups if len(g) > 1)
    assert sorted(r.members for r in catalogue.duplicate_groups(spark, str(tmp_path)).collect()) == want
    assert any(i not in vectors for g in want for i in map(int, g.split(",")))


def test_cluster_attachment_means_over_all_members(spark, tmp_path):
    rng = random.Random(1)
    gauss = {i: [rng.gauss(0, 1) for _ in range(64)] for i in range(80)}
    put(spark, tmp_path, "embeddings", [(i, v, 0) for i, v in gauss.items()], EMBEDDINGS)
    s = {(i, j): cosine(gauss[i], gauss[j]) for i in gauss for j in gauss}
    least = components(gauss, [(i, j) for (i, j), x in s.items() if i < j and x >= 0.35])
    members = {c: [i for i in gauss if least[i] == c] for c in set(least.values())}
    want = dict(least)
    for i in gauss:
        means = [(sum(s[i, j] for j in m) / len(m), -c) for c, m in members.items() if len(m) > 1]
        if len(members[least[i]]) == 1 and max(means)[0] >= 0.35 - groups.ATTACH_SLACK:
            want[i] = -max(means)[1]
    assert sum(want[i] != least[i] for i in gauss) == 2
    assert {r.id: r.cluster for r in catalogue.queries()["cluster_attachment"](spark, str(tmp_path)).collect()} == want
    rows = spark.createDataFrame(list(gauss.items()), "id long, v array<double>")
    pairs = knn.similar_pairs(rows, 0.35, "v", "id")
    assert {r.id: r.cluster for r in groups.clusters(pairs, rows.select("id"), 0.35, vectors=rows, chunk=2).collect()} == want


def test_text_pairs_across_sources_languages_and_sizes(spark, tmp_path):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(n)) for n in (49, 12, 80, 3)]
    texts = ["", " ", None, "one", "one", "two", *base]
    for t in base * 12:
        w = t.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("abcdefghijkl") + "9"
        texts.append(" ".join(w + ["more", "words"][: rng.randint(0, 2)]))
    texts += base
    docs = [(i, t, rng.choice(["en", "fr"]), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    put(spark, tmp_path, "documents", docs, DOCUMENTS)
    want = {(i, j): s for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and x is not None and y is not None and (s := similarity(x, y)) is not None and s >= 0.7}
    got = [((r.a, r.b), r.similarity) for r in catalogue.duplicate_text_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {p: round(s, 6) for p, s in got} == {p: round(s, 6) for p, s in want.items()}
    across = [(i, j) for i, j in want if docs[i][2:4] != docs[j][2:4]]
    assert len(across) > 20 and any(want[p] < 1 for p in across)


def test_nearest_names_of_a_long_list(spark):
    names = spark.createDataFrame([(f"name {i:04d} and more",) for i in range(1500)] + [("target",)], "name string")
    got = predicate.nearest_names(spark.createDataFrame([("targets",)], "value string"), names).first()
    assert (got.suggestion, got.distance) == ("target", 1)
