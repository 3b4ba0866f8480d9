"""The pipeline, and the scores of the text classifier, by loops that use none of the operators' own passes."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing, quality, secrets, toxicity
from quarry.llm.words import hash_words

from .test_duplicates import classes
from .test_scans import secret_spans, surface
from .test_tokens import LIBRARY


def good_ones(rows, rules):
    """Documents that pass the base rules and whose mean ratio, summed bucket by bucket, meets the threshold."""
    out = []
    for r in rows:
        n, *_, repeated = surface(r.text or "")
        if n < 50 or 100 * repeated > 50 * n:
            continue
        total = 0.0
        for part in quality._grams(*hash_words([r.text]), len(rules.ratio)):
            for bucket in part.tolist():
                total += float(rules.ratio[bucket])
        mean = total / (2 * n)
        assert abs(mean - rules.threshold) > 1e-9
        if mean >= rules.threshold:
            out.append(r)
    return out


def one_of_each(rows):
    """The row of the smallest id of each class of near copies."""
    found = classes([(r.doc_id, r.text) for r in rows])
    alone = {i for has, i, _, least in found if has and i == least}
    return [r for r in rows if r.doc_id is None or r.doc_id in alone]


def without_secrets(rows):
    """Texts with every secret replaced: base spans, and values of few owners and repositories that look random and overlap none."""
    owners, repositories = {}, {}
    for r in rows:
        for h, *_ in secrets.candidates(r.text):
            owners.setdefault(h, set()).add(r.source)
            repositories.setdefault(h, set()).add((r.source, r.lang))
    out = []
    for r in rows:
        spans = [(a, b) for a, _, b in secret_spans(r.text)]
        live = [(a, b) for h, a, b, random in secrets.candidates(r.text) if random and len(owners[h]) <= secrets.MAX_OWNERS and len(repositories[h]) <= secrets.MAX_REPOSITORIES]
        spans += [(a, b) for a, b in live if not any(x < b and a < y for x, y in spans)]
        text, at = "", 0
        for a, b in sorted(spans):
            if b <= at:
                continue
            text, at = text + (r.text[at:a] + "[SECRET]" if a >= at else ""), b
        out.append((r.doc_id, text + r.text[at:], r.source))
    return out


def mixed(rows):
    """Every row as often as its source's rate and its own draw say."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    order = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    targets, free = {}, set(order)
    while free:
        level = (mixing.TOTAL * sum(sizes.values()) - sum(targets.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] >= mixing.MOST * sizes[s]}
        targets |= {s: mixing.MOST * sizes[s] for s in over} if over else {s: level * weights[s] for s in free}
        free -= over or free
    out = []
    for i, t, s in rows:
        rate = targets[s] / sizes[s] if sizes[s] else 0.0
        key = f"{mixing.SEED}:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()[:16]}"
        draw = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / 2**32
        out += [(i, t)] * (int(rate) + (draw < rate - int(rate)))
    return out


def test_pipeline_by_loops(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = good_ones(docs.collect(), quality.fit(docs, labels))
    rows = mixed(without_secrets(one_of_each(rows)))
    want = []
    for i, t in rows:
        ids = LIBRARY.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want) and len(want) > 50 and len({i for i, _ in rows}) < docs.count()


def slow_score(model, text):
    """The classifier's probability, one window and one filter at a time, in double precision."""
    vectors = [np.mean([model.vectors[u].astype(float) for u in toxicity.subwords(w.decode())], axis=0) for w in toxicity.words_of(text)]
    z = float(model.out_bias)
    for j, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = None
            for i in range(len(vectors)):
                r = sum(float(vectors[i + k] @ model.filters[width, k][:, f]) for k in range(width) if i + k < len(vectors))
                best = r if best is None else max(best, r)
            if best is not None:
                z += float(model.out[j * toxicity.FILTERS + f]) * max(best + float(model.bias[width][f]), 0.0)
    return 1 / (1 + np.exp(-np.clip(model.scale[0] * z + model.scale[1], -30, 30)))


@pytest.mark.parametrize("chunk", [toxicity.CHUNK, 20])
def test_scores_of_the_classifier_by_loops(spark, docs, monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    model = toxicity.Classifier.new()
    model.out = rng.normal(0, 0.4, model.out.shape).astype(np.float32)
    model.bias = {w: rng.normal(0, 0.2, b.shape).astype(np.float32) for w, b in model.bias.items()}
    model.out_bias, model.scale = 0.3, (1.3, -0.2)
    texts = ["", " ", "one", "one two", "ü ß. (x) A", *(" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in rng.integers(1, 25, 12))]
    got = toxicity.Scorer(model).scores(texts)
    assert got == pytest.approx([slow_score(model, t) for t in texts], abs=1e-5) and got.max() - got.min() > 0.05
    short = docs.filter(F.length(F.coalesce("text", F.lit(""))) < 150)
    scored = sorted(round(r.score, 4) for r in toxicity.score(short, model).collect())
    assert scored == pytest.approx(sorted(slow_score(model, r.text or "") for r in short.collect()), abs=1e-3)
