"""Operators 4, 6, 7 and 8."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import pii, quality, secrets, toxicity

from .conftest import plain

KEY = "(" + "|".join(["[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "[Pp][Aa][Ss][Ss][Ww][Dd]", "[Ss][Ee][Cc][Rr][Ee][Tt]", "[Tt][Oo][Kk][Ee][Nn]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"]) + ")"


def secret_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secret_base(docs, nothing):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.report(docs).collect())
    want = []
    for i, t in plain(docs):
        s = secret_spans(t)
        digest = hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()
        want.append((i is not None, i or 0, *(sum(k == n for _, k, _ in s) for n in range(3)), digest))
    assert got == sorted(want) and sum(w[2] + w[3] + w[4] for w in want) >= 3
    assert secrets.report(nothing).count() == 0


def test_ownership_tells_examples_from_live_values(spark):
    live, copied = "Zk39fQx71LmPq04RtY", "Qw82hTs63NbVc19XzP"
    rows = [(i, f"see {copied} here", "en", f"s{i}") for i in range(6)] + [(9, f"see {live} here", "en", "s1"), (10, None, None, None)]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[9].spans == f"live:4:{4 + len(live)}" and got[9].n_live == 1
    assert got[0].spans == "" and got[0].n_copied == 1 and got[10].spans == ""


@pytest.mark.parametrize("most", [0, 100_000])
def test_secrets_are_redacted(docs, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_SPANS", most)
    got = secrets.redact(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    texts = dict(plain(got))
    secret = next(i for i, t in plain(docs) if t.startswith("key AKIA"))
    assert texts[secret] == "key [SECRET] and [SECRET]" and texts[0] == dict(plain(docs))[0]


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def test_secret_verdicts(docs):
    """Owners and repositories of every candidate value counted by hand, and what follows from them."""
    rows = [(r.doc_id, r.text or "", str(r.source), (str(r.source), str(r.lang))) for r in docs.collect()]
    rows += [(5000 + i, f"note {i} key AKIA{'ABCDEFGH' * 2} and token = zX9{'q7Lw2Rt8' * 2}{i % 2}", f"s{i % 9}", (f"s{i % 9}", "en")) for i in range(30)]
    df = docs.sparkSession.createDataFrame([(i, t, s, repository[1]) for i, t, s, repository in rows], "doc_id long, text string, source string, lang string")
    owners, repositories = {}, {}
    for _, t, owner, repository in rows:
        for h, *_ in secrets.candidates(t):
            owners.setdefault(h, set()).add(owner)
            repositories.setdefault(h, set()).add(repository)
    few = {h for h in owners if len(owners[h]) <= secrets.MAX_OWNERS and len(repositories[h]) <= secrets.MAX_REPOSITORIES}
    want = sorted((i is not None, i or 0, ",".join(f"{a}:{b}:{'copied' if h not in few else 'live' if r else 'own'}" for h, a, b, r in secrets.candidates(t))) for i, t, *_ in rows)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.verdicts) for r in secrets.report(df).collect())
    assert got == want and any("copied" in v for *_, v in want)


def pii_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def awkward(seed):
    rng = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "@", "_d@e.f", "1.2.3.4", "1.2.3.4.5", "001.0255.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "123 456", "+49 (30) 1234-567", "+1 2", "+", "é", "\x01\x02", "😀", "7" * 40, " ", "-", ".", "\n"]
    return "".join(rng.choice(parts) for _ in range(30))


def test_pii_base(spark, docs, nothing):
    rows = plain(docs) + [(1000 + i, awkward(i)) for i in range(150)] + [(2000, "1 " * 30000), (2001, "a" * 50000 + "@b.c"), (2002, "x@y." * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(df).collect())
    want = []
    for i, t in rows:
        s = pii_spans(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()
        want.append((i is not None, i or 0, *(sum(k == n for k, _, _ in s) for n in pii.BASE), digest))
    assert got == sorted(want)
    assert pii.report(nothing).count() == 0


def test_pii_plan_has_no_python(docs):
    plan = pii.report(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_boosting_selects_national_numbers(spark):
    rows = [(i, f"please call tel {200 + i}-{3000 + i} or +49 30 {2000 + i} {3000 + i} today; order {10000 + i} {2000 + i} {3000 + i} {4000 + i} {5555 + i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = pii.fit(df)
    assert models["phone_like"].threshold is not None
    spans = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert all("phone_like:16:24" in s for s in spans.values())
    assert "[PHONE_LIKE]" in pii.redact(df, models=models).first().text


def numbered(i, rng, planted):
    """Prose with valid base kinds, decoys of digits, and, where planted, a telephone number without a plus; its place."""
    n = lambda k: "".join(rng.choice("123456789") for _ in range(k))
    words = [rng.choice(["and", "the", "of", "stone", "river", "blue"]) for _ in range(30)]
    words[3] = f"+1 ({n(3)}) 555-{n(4)}" if not planted else "plain"
    words[8] = ".".join(str(rng.randint(1, 255)) for _ in range(4))
    words[12] = "".join(rng.choice("0123456789abcdef") for _ in range(24)) + "f"
    words[16] = n(20)
    words[20] = f"v{n(2)}.{n(3)}.{n(4)}"
    text = " ".join(words)
    if not planted:
        return text, None
    number = f"({n(3)}) 555-{n(4)}"
    return f"{text} {number} end", (len(text) + 1, len(text) + 1 + len(number))


def test_planted_numbers_without_a_plus(spark):
    """Trees that are fitted on other texts find held-back numbers, and nothing else."""
    rng = random.Random(5)
    learn = spark.createDataFrame([(i, numbered(i, rng, False)[0]) for i in range(120)], "doc_id long, text string")
    models = pii.fit(learn)
    assert models["phone_like"].trees and models["phone_like"].threshold is not None
    held = [numbered(i, rng, True) for i in range(80)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    found, planted = set(), {(i, *place) for i, (_, place) in enumerate(held)}
    for r in pii.personal(df, models=models).collect():
        base = {(x.k, x.a, x.b) for x in r.base}
        assert {pii.KINDS[x.k] for x in r.base} == {"ip"}
        found |= {(r.doc_id, x.a, x.b) for x in r.spans if (x.k, x.a, x.b) not in base}
    assert len(found & planted) >= 0.9 * len(planted), "recall"
    assert len(found & planted) >= 0.9 * len(found), "precision"


def test_no_threshold_without_trees(spark):
    """Examples of one class alone teach nothing, so nothing is added."""
    df = spark.createDataFrame([(i, f"call +1 (603) 555-{1000 + i} or (603) 555-1234") for i in range(20)], "doc_id long, text string")
    models = pii.fit(df)
    assert all(m.threshold is None for m in models.values() if not m.trees)
    assert all(r.n_added == 0 for r in pii.report(df).collect() if not models["phone_like"].trees)


def test_trees_learn_a_feature():
    base = dict.fromkeys(pii.FEATURES, 0)
    rows = [{**base, "keyword": k, "digits": n, "up": 10 * k, "down": 10 * (1 - k)} for k in (0, 1) for n in (5, 9)]
    prior, trees = pii.boost(rows)
    model = pii.Boosted(prior, trees, None)
    assert model.value(rows[3]) > 0 > model.value(rows[0])
    assert pii.calibrated([(2.0, 9, 0), (1.0, 1, 1), (0.0, 0, 9)]) == 1.0 and pii.calibrated([(1.0, 0, 5)]) is None


def surface(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_ratio(docs, labels):
    """Both multinomials, the ratio, every score and the verdict by loops over words and pairs."""
    from quarry.llm.common import mix64
    from quarry.llm.words import hash_words

    buckets = quality.buckets_for(docs.select("doc_id", "text"))
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality in (0, 1):
            known[r.doc_id] = max(known.get(r.doc_id, 0), r.quality)
    third = {r.doc_id: r.m for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("m")).collect()}
    place = lambda h: int(mix64(np.array([h], np.uint64))[0]) >> (64 - buckets.bit_length() + 1)
    golden, whole = 0x9E3779B97F4A7C15, 1 << 64

    def grams(t):
        h = [int(x) for x in hash_words([t])[0]]
        pairs = [mix64(np.array([(a * golden + int(mix64(np.array([b], np.uint64))[0])) % whole], np.uint64))[0] for a, b in zip(h, h[1:], strict=False)]
        return [place(x) for x in h] + [int(p) >> (64 - buckets.bit_length() + 1) for p in pairs] + ([place(h[-1])] if h else [])

    rows = [(r.doc_id, grams(r.text or "")) for r in docs.collect()]
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, own in rows:
        for g in own:
            raw[g] += 1
            target[g] += known.get(i) == 1 and third[i] > 0
    p_raw = (raw + 1) / (raw.sum() + buckets)
    weight = 5.0 * buckets * target.sum() / raw.sum() + 100.0
    ratio = np.log((target + weight * p_raw) / (target.sum() + weight)) - np.log(p_raw)
    want = sorted((i is not None, i or 0, round(float(np.mean(ratio[own])), 9) if own else 0.0) for i, own in rows)
    out = quality.judged(docs, labels).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 9)) for r in out) == want
    threshold = quality.fit(docs, labels).threshold
    assert all(r.kept == (not r.base_failed and r.score >= threshold) for r in out)


def test_quality_base(docs, labels, nothing):
    short = docs.filter(F.length(F.coalesce("text", F.lit(""))) < 3000)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.report(short, labels).collect())
    want = []
    for i, t in plain(short):
        s = surface(t)
        want.append((i is not None, i or 0, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(want)
    assert quality.report(nothing, labels).count() == 0 and quality.report(docs, labels.filter("false")).count() == docs.count()


def test_quality_ratio_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choice(words) + (rng.choice(["%%%", "&&&"]) if i % 4 == 0 else "") for _ in range(80)), None, "s", 1) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(160)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.report(docs, labels).collect() if r.kept}
    assert kept == {i for i in range(240) if i % 4}
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept


def test_threshold():
    assert quality.choose_threshold(np.array([1.0, 2.0]), np.array([-1.0, 3.0])) == 0.0
    assert quality.choose_threshold(np.array([1.0]), np.array([])) == float("-inf")


def test_toxicity_on_held_out_rows(spark, nothing, labels):
    rng = random.Random(9)
    words, bad = [f"word{i}" for i in range(400)], ["awfulia", "awfulen", "awfulor", "nasty"]
    rows = []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), "s", 1))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    truth = spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(900)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.report(docs, truth).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(i % 6 == 0, r.predicted) for i, r in got.items() if r.held_out and i < 900]
    assert sum(a == bool(b) for a, b in held) >= 0.97 * len(held)
    assert got[1000].predicted == got[1001].predicted == 0
    assert toxicity.report(nothing.select("doc_id", "text", "lang"), labels).count() == 0
