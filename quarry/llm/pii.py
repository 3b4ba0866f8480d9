"""Operator 7: personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose overlapping spans as arrays of structs, cut out of the text by one regular
expression replacement each. Base kinds (email, ip, card, phone) are validated by rule. Further candidates are scored
by small boosted trees over format and context features; a threshold calibrated for each kind selects them.

No labels of personal data exist, so the trees learn from what the rules of the base kinds know. Candidates of base
kinds are examples, valid ones of personal data, refused ones (a wrong checksum, a part over 255, too few digits) of
none. A further candidate is an example where it overlaps a valid base span: of personal data if that is of its own
family, of none if it is another's, as a piece of an address of the network is no telephone number. What overlaps no
valid span has no label and is what the model then decides on. Labels come from spans and checksums, features from the
format and the characters around, so the trees cannot repeat the rule. A family without examples of its own is scored
by trees over the examples of all. The trees are fitted on counts of feature combinations, whose number is bounded by
the features' values, and compiled to CASE expressions. Nothing is shuffled but those counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
#: Possessive quantifiers take the same text as greedy ones here, without backtracking and without recursion on long runs.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "phone_like": r"(?<![0-9])\(?[0-9]{2,5}\)?[\x20./-](?:[0-9]{2,4}[\x20.-]){0,3}[0-9]{3,4}(?![0-9])",
    "id_like": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "account_like": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "email_like": r"[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
}
ADDED = tuple(k for k in _PATTERNS if k not in BASE)
KINDS = (*BASE, *ADDED)
#: A text without these strings or matches has no span of the kind; spares the replacement.
_NEEDS = {"email": "contains(text, '@')", "phone": "contains(text, '+')", "id_like": "digits", "phone_like": "digits", "ip": "digits", "card": "digits", "account_like": "digits", "email_like": r"(contains(text, '(at)') OR contains(text, '(AT)') OR contains(text, '[at]') OR contains(text, '[AT]'))"}
#: The base kind whose valid spans are examples of personal data for candidates of an added kind.
_FAMILY = {"phone_like": "phone", "email_like": "email", "account_like": "card", "id_like": None}
#: Words before a span that speak for a kind.
_CONTEXT = {
    "email": "mail|contact|write|reach|address",
    "ip": "host|server|client|addr|login",
    "card": "card|karte|carte|tarjeta|visa|master|pay",
    "phone": "tel|phone|call|mobil|fax|cell|contact|whatsapp|anruf|appel",
    "phone_like": "tel|phone|call|mobil|fax|cell|contact|whatsapp|anruf|appel",
    "id_like": "ssn|social|tax|identi|insured|passport",
    "account_like": "iban|account|bank|konto|compte|cuenta",
    "email_like": "mail|contact|write|reach|address",
}
BEFORE, TREES, RATE, PRECISION = 24, 12, 0.3, 0.9
FEATURES = ("keyword", "glued_left", "glued_right", "separators", "digits", "first_group", "last_group", "parenthesis", "line_start")


def _sql(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def found(d: DataFrame, kind: str) -> DataFrame:
    """d with all_<kind>: array<struct<a, b, m>> of the pattern's leftmost non-overlapping matches in ``text``; code points, end exclusive.

    Matches are marked with control characters that the text is cleared of before, then the text is split at them.
    """
    marked = rf"regexp_replace(translate(text, '\u0001\u0002', '\u0003\u0003'), {_sql(_PATTERNS[kind])}, '\u0001$0\u0002')"
    end = r"substring_index(p, '\u0002', 1)"
    none = "CAST(array() AS array<struct<a:int,b:int,m:string>>)"
    d = d.withColumn("parts", F.expr(rf"CASE WHEN {_NEEDS[kind]} THEN split({marked}, '\u0001') END"))
    return d.withColumn(f"all_{kind}", F.expr(f"""
      CASE WHEN size(parts) > 1 THEN aggregate(slice(parts, 2, size(parts)), named_struct('at', length(parts[0]), 'out', {none}),
        (s, p) -> named_struct('at', s.at + length(p) - 1, 'out', array_append(s.out, named_struct('a', s.at, 'b', s.at + length({end}), 'm', {end}))),
        s -> s.out)
      ELSE {none} END""")).drop("parts")


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + CAST(CASE WHEN i % 2 = 1 THEN CAST(substring(reverse({_DIGITS}), i, 1) AS INT)
  ELSE (2 * CAST(substring(reverse({_DIGITS}), i, 1) AS INT)) % 10 + (2 * CAST(substring(reverse({_DIGITS}), i, 1) AS INT)) DIV 10 END AS INT)) % 10 = 0"""
_VALID = {
    "email": "true",
    "ip": "forall(split(x.m, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND CAST(concat('0', right(trim(LEADING '0' FROM p), 3)) AS INT) <= 255)",
    "card": f"CASE WHEN length({_DIGITS}) BETWEEN 13 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def base(docs: DataFrame) -> DataFrame:
    """docs (with a column text, null as empty) with a column of valid spans for each base kind, and the refused ones of all."""
    d = docs.withColumn("digits", F.expr("text RLIKE '[0-9]'"))
    for kind in KINDS:
        d = found(d, kind)
    for kind in BASE:
        d = d.withColumn(kind, F.expr(f"filter(all_{kind}, x -> {_VALID[kind]})"))
    return d.withColumn("valid", F.expr(f"concat({', '.join(BASE)})")).withColumn("refused", F.expr("concat(" + ", ".join(f"filter(all_{k}, x -> NOT ({_VALID[k]}) AND length({_DIGITS}) >= 5)" for k in ("ip", "card", "phone")) + ")"))


def featured(kind: str) -> str:
    """SQL: the candidates of a kind with their features as small integers; longer tells that a refused run of digits goes on around."""
    before = f"lower(substring(text, greatest(x.a - {BEFORE}, 0) + 1, least(x.a, {BEFORE})))"
    return rf"""transform(all_{kind}, x -> named_struct('a', x.a, 'b', x.b,
      'keyword', CAST({before} RLIKE '{_CONTEXT[kind]}' AS INT),
      'glued_left', CAST(x.a > 0 AND substring(text, x.a, 1) RLIKE '[A-Za-z0-9/.,:=_-]' AS INT),
      'glued_right', CAST(substring(text, x.b + 1, 2) RLIKE '^([A-Za-z0-9/=_]|[.,:-][0-9])' AS INT),
      'separators', least(length(regexp_replace(x.m, '[A-Za-z0-9]', '')), 5),
      'digits', least(length({_DIGITS}), 20),
      'first_group', least(length(regexp_extract(x.m, '[0-9]+', 0)), 7),
      'last_group', least(length(regexp_extract(x.m, '[0-9]+$', 0)), 7),
      'parenthesis', CAST(contains(x.m, '(') AS INT),
      'line_start', CAST(x.a = 0 OR substring(text, x.a, 1) = '
' AS INT),
      'longer', CAST(exists(refused, y -> y.a <= x.a AND y.b >= x.b AND y.b - y.a > x.b - x.a) AS INT)))"""


def labelled(kind: str) -> str:
    """SQL: the candidates of a kind that are examples, each with kind, label (1: personal data) and features."""
    over = lambda spans: f"exists({spans}, y -> y.a < x.b AND x.a < y.b)"
    if kind in BASE:
        label = f"CASE WHEN exists({kind}, y -> y.a = x.a) THEN 1 ELSE 0 END"
    else:
        own = _FAMILY[kind]
        others = [k for k in BASE if k != own]
        label = f"CASE WHEN {over(own) if own else 'false'} THEN 1 WHEN {over('concat(' + ', '.join(others) + ')')} THEN 0 END"
    fields = ", ".join(f"'{f}', x.{f}" for f in FEATURES)
    return f"filter(transform({featured(kind)}, x -> named_struct('kind', '{kind}', 'label', {label}, {fields})), x -> x.label IS NOT NULL)"


@dataclass(frozen=True)
class Tree:
    """Two levels: feature <= cut, then on each side another; values of the four leaves."""

    root: tuple[str, int]
    sides: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def sql(self, x: str) -> str:
        (f, c), ((g, d), (h, e)) = self.root, self.sides
        a, b, p, q = (repr(v) + "D" for v in self.leaves)
        return f"CASE WHEN {x}.{f} <= {c} THEN CASE WHEN {x}.{g} <= {d} THEN {a} ELSE {b} END ELSE CASE WHEN {x}.{h} <= {e} THEN {p} ELSE {q} END END"

    def value(self, row: dict) -> float:
        side = int(row[self.root[0]] > self.root[1])
        f, c = self.sides[side]
        return self.leaves[2 * side + int(row[f] > c)]


@dataclass(frozen=True)
class Boosted:
    """The trees of one kind, their prior, and the calibrated threshold; without trees there is no threshold, and without one nothing is selected."""

    prior: float
    trees: tuple[Tree, ...]
    threshold: float | None

    def sql(self, x: str) -> str:
        return " + ".join([repr(self.prior) + "D", *(f"({t.sql(x)})" for t in self.trees)])

    def value(self, row: dict) -> float:
        out = self.prior
        for t in self.trees:  # added in the order of the SQL, so that both give the same number
            out += t.value(row)
        return out


def boost(rows: list[dict], trees: int = TREES, rate: float = RATE) -> tuple[float, tuple[Tree, ...]]:
    """Gradient boosting with Newton leaves on weighted feature combinations; each row has the features, up and down (weights of both classes)."""
    up, down = sum(r["up"] for r in rows), sum(r["down"] for r in rows)
    prior = math.log((up + 1) / (down + 1))
    score, out = [prior] * len(rows), []
    cuts = [(f, c) for f in FEATURES for c in sorted({r[f] for r in rows})[:-1]]

    def sums(which: list[int]) -> tuple[float, float]:
        p = [1 / (1 + math.exp(-score[i])) for i in which]
        return (
            sum(rows[i]["up"] * (1 - q) - rows[i]["down"] * q for i, q in zip(which, p, strict=True)),
            sum((rows[i]["up"] + rows[i]["down"]) * q * (1 - q) for i, q in zip(which, p, strict=True)) + 1.0,
        )

    def split(which: list[int]) -> tuple[str, int]:
        def gain(cut: tuple[str, int]) -> float:
            parts = [i for i in which if rows[i][cut[0]] <= cut[1]], [i for i in which if rows[i][cut[0]] > cut[1]]
            return sum(g * g / h for g, h in map(sums, parts))

        return max(cuts, key=gain)

    if not cuts:
        return prior, ()
    for _ in range(trees):
        root = split(list(range(len(rows))))
        halves = [[i for i, r in enumerate(rows) if (r[root[0]] > root[1]) == bool(s)] for s in (0, 1)]
        sides = tuple(split(h) if h else root for h in halves)
        leaves, places = [], []
        for h, (f, c) in zip(halves, sides, strict=True):
            for s in (0, 1):
                own = [i for i in h if (rows[i][f] > c) == bool(s)]
                g, w = sums(own)
                leaves.append(rate * g / w)
                places.append(own)
        for own, v in zip(places, leaves, strict=True):
            for i in own:
                score[i] += v
        out.append(Tree(root, sides, tuple(leaves)))
    return prior, tuple(out)


def fit(docs: DataFrame) -> dict[str, Boosted]:
    """Trees and threshold for each added kind, from all documents.

    Half of the documents, by a hash of the text, fits the trees; the other half calibrates: the threshold is the lowest
    score from which on the precision reaches PRECISION there.
    """
    d = base(docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")))
    each = d.select(F.expr("pmod(xxhash64(text), 2)").alias("half"), F.explode(F.expr(f"concat({', '.join(map(labelled, KINDS))})")).alias("x"))
    counts = each.groupBy("half", "x.kind", *(F.col(f"x.{f}").alias(f) for f in FEATURES))
    table = [r.asDict() for r in counts.agg(F.sum("x.label").alias("up"), F.sum(1 - F.col("x.label")).alias("down")).collect()]  # combinations of features
    table.sort(key=lambda r: (r["kind"], r["half"], *(r[f] for f in FEATURES)))
    pooled = trained(table)
    models = {}
    for kind in ADDED:
        own = [r for r in table if r["kind"] == kind]
        models[kind] = trained(own) if sum(r["up"] for r in own) and sum(r["down"] for r in own) else pooled
    return models


def trained(rows: list[dict]) -> Boosted:
    """Trees from the first half's counts, the threshold from the other's."""
    learn, rest = ([r for r in rows if r["half"] == h] for h in (0, 1))
    if not sum(r["up"] for r in learn) or not sum(r["down"] for r in learn):
        return Boosted(0.0, (), None)
    prior, trees = boost(learn)
    model = Boosted(prior, trees, None)
    return Boosted(prior, trees, calibrated([(model.value(r), r["up"], r["down"]) for r in rest]) if trees else None)


def calibrated(scored: list[tuple[float, float, float]], precision: float = PRECISION) -> float | None:
    """The lowest score from which on at least ``precision`` of the weight is of the upper class; None if there is none."""
    best, up, down = None, 0.0, 0.0
    for s in sorted({s for s, _, _ in scored}, reverse=True):
        up += sum(u for t, u, _ in scored if t == s)
        down += sum(w for t, _, w in scored if t == s)
        if up and up / (up + down) >= precision:
            best = s
    return best


def personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: dict[str, Boosted] | None = None) -> DataFrame:
    """id_col, text_col, base and spans (arrays of struct<k, a, b>; k a place in KINDS) of every row.

    Base spans are always there; an added one only where no base span overlaps it, no refused run of digits goes on
    around it, and its score reaches the kind's threshold. A null or empty text has none. Rows stay as many as they are and nothing is shuffled, so nulls and
    repeats in id_col do not matter; other columns are not read.
    """
    models = models if models is not None else fit(docs.select(F.col(text_col).alias("text")))
    d = base(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("original"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    tagged = lambda kind, which: f"transform({which}, x -> named_struct('k', {KINDS.index(kind)}, 'a', x.a, 'b', x.b))"
    added = [
        tagged(kind, f"filter({featured(kind)}, x -> x.longer = 0 AND {m.sql('x')} >= {m.threshold!r}D AND NOT exists(valid, y -> y.a < x.b AND x.a < y.b))")
        for kind, m in models.items()
        if m.threshold is not None
    ]
    d = d.withColumn("base", F.expr(f"concat({', '.join(tagged(k, k) for k in BASE)})"))
    d = d.withColumn("spans", F.expr(f"concat({', '.join(['base', *added])})"))
    return d.select(F.col("id").alias(id_col), F.col("original").alias(text_col), "base", "spans")


def span_string(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.a, x.b)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document."""
    count = lambda k: F.expr(f"CAST(size(filter(base, x -> x.k = {BASE.index(k)})) AS LONG)").alias(f"n_{k}")
    return personal(docs).select("doc_id", *map(count, BASE), F.sha2(span_string("base"), 256).alias("base_sha256"), span_string("spans").alias("spans"), F.expr("CAST(size(spans) - size(base) AS LONG)").alias("n_added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: dict[str, Boosted] | None = None) -> DataFrame:
    """id_col and text_col with [KIND] for each selected span; of overlapping spans the first names the cut."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    cut = F.expr(f"""aggregate(array_sort(transform(spans, x -> named_struct('a', x.a, 'b', x.b, 'k', x.k))), named_struct('at', 0, 'out', ''),
      (s, x) -> CASE WHEN x.b <= s.at THEN s ELSE named_struct('at', x.b, 'out', concat(s.out,
        CASE WHEN x.a < s.at THEN '' ELSE concat(substring(`{text_col}`, s.at + 1, x.a - s.at), element_at(array({names}), x.k + 1)) END)) END,
      s -> concat(s.out, substring(`{text_col}`, s.at + 1)))""")
    return personal(docs, id_col, text_col, models).select(id_col, F.when(F.size("spans") == 0, F.col(text_col)).otherwise(cut).alias(text_col))
