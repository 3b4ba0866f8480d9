"""The hashing embedder against its definition, unit by unit; tokens are cut once a row."""

import hashlib
import math
import random
import re

from quarry.plans import more
from quarry.sources import embed


def defined(text, dimension):
    tokens = [t.lower() for t in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)) if t]
    v = [0.0] * dimension
    for unit, weight in [(t, 1.0) for t in tokens] + [(f"{a} {b}", 0.5) for a, b in zip(tokens, tokens[1:], strict=False)]:
        h = int.from_bytes(hashlib.md5(unit.encode(), usedforsecurity=False).digest()[:8], "little")
        v[h % dimension] += weight if h >> 63 else -weight
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else v


def test_embedder_against_its_definition(monkeypatch):
    rng = random.Random(6)
    texts = ["", "?", "a", "İstanbul KKelvin", "caféBar \ud800x"] + ["".join(rng.choice(["fooBar", "x", "9", " ", "_", "é", "HTTPServer", ".", "\n"]) for _ in range(60)) for _ in range(200)]
    for dimension in (64, 16, 7):
        assert embed.HashingEmbedder(dimension).embed(texts) == [defined(t, dimension) for t in texts]
    calls = []
    monkeypatch.setattr(embed, "_md5", lambda b, real=embed._md5: calls.append(b) or real(b))
    embed.HashingEmbedder().embed(["one two one"])
    assert calls == [b"one", b"two", b"one", b"one two", b"two one"]


def test_token_jaccard_moves_no_text(spark, tmp_path):
    rng = random.Random(8)
    docs = [(i, None if i == 4 else " ".join(rng.choice(["aB", "c", "D", "", "-", "e_f"]) for _ in range(rng.randint(0, 6))), "s", "en", 1) for i in range(30) if i != 9]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    cut = {i: None if t is None else {w.lower() for w in re.split(r"[^A-Za-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", t)) if w} for i, t, *_ in docs}
    want = {i: round(len(cut[i] & cut[i + 1]) / len(cut[i] | cut[i + 1]), 6) if cut[i] and cut[i + 1] else 0.0 for i in cut if i + 1 in cut}
    found = more.token_jaccard(spark, str(tmp_path))
    assert {r.doc_id: r.jaccard for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("xxhash64") > plan.index("Join")  # under the join, so it has no texts
