"""Operator 6: secret scans with corpus-wide ownership frequency.

One pass over the texts finds the base spans and, with high recall, every value that could be a credential. The
values' hashes are then aggregated over the whole corpus by distinct repositories and owners: a value that many owners
have is a copied example, one that stays with few owners and looks random is live. Live values that no base pattern
covers are added as spans of kind ``live``. Texts are never shuffled, only hashes, offsets and counts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, stored, texts_of

KINDS = ("assign", "access", "hex", "live")
#: A value with at most this many owners and repositories can be live; with more it is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
#: Bits of entropy a character that a live-looking value has at least.
MIN_ENTROPY = 3.0
#: Rows with spans that are broadcast at most (about 100 bytes each).
BROADCAST_SPANS = 100_000
#: Copies from which on a value is hot; hot values up to this number are broadcast with their verdicts, more are joined by a shuffle.
HOT_COPIES, BROADCAST_HOT = 10_000, 1_000_000


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_either_case, ("password", "passwd", "secret", "token"))) + f"|{_either_case('api')}_?{_either_case('key')}"
_ASSIGN = re.compile(rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")
#: High recall: long runs of characters that credentials are made of.
_VALUE = re.compile("[A-Za-z0-9+/_=-]{16,}")
_DUMMY = re.compile("example|sample|placeholder|changeme|your|dummy|test|xxxx|0000|1234", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order; kind is a place in KINDS. Matches that are too short are dropped."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def random_looking(value: str) -> bool:
    """Letters and digits mixed, no dummy word, and enough entropy a character."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)) or _DUMMY.search(value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= MIN_ENTROPY


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(hash of the value, start, end, 1 if it looks random) of every value that could be a credential."""
    found = {(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12}
    found |= {m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18}
    found |= {m.span() for m in _VALUE.finditer(text)}
    return [(xxhash.xxh3_64_intdigest(v := text[a:b]) - (1 << 63), a, b, int(random_looking(v))) for a, b in sorted(found)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SCAN = "doc_id {kind}, repository string, owner string, spans array<struct<a:int,k:int,b:int>>, base_sha256 string, found array<struct<h:long,a:int,b:int,random:int>>"


def scan(docs: DataFrame, id_col: str, text_col: str, repository_cols: list[str], owner_cols: list[str]) -> DataFrame:
    """One row a document: base spans and candidates. Nulls in repository or owner columns count as one more name."""
    name = lambda cols: F.to_json(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols)))
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), name(repository_cols).alias("repository"), name(owner_cols).alias("owner"))

    def make(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch)
        spans = [base_spans(t) for t in texts]
        return {
            "doc_id": batch.column(0),
            "repository": batch.column(2),
            "owner": batch.column(3),
            "spans": [[{"a": a, "k": k, "b": b} for a, k, b in s] for s in spans],
            "base_sha256": [hashlib.sha256(joined(s).encode()).hexdigest() for s in spans],
            "found": [[dict(zip(("h", "a", "b", "random"), c, strict=True)) for c in candidates(t)] for t in texts],
        }

    return map_batches(named, ["doc_id", "text", "repository", "owner"], make, _SCAN.format(kind=kind))


def ownership(scanned: DataFrame) -> DataFrame:
    """h, owners, repositories, copies of every candidate value, over all documents; a hot value is pre-aggregated by both counts."""
    each = scanned.select("repository", "owner", F.explode("found").alias("f")).select(F.col("f.h").alias("h"), "repository", "owner")
    pairs = each.groupBy("h", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("h", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("h").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("copies"))


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repository_cols: tuple[str, ...] = ("source", "lang"),
    owner_cols: tuple[str, ...] = ("source",),
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """id_col, all (array of start, kind, end), base_sha256, n_assign, n_access, n_hex, n_live, n_copied, judged of every row.

    judged has a, b and verdict of every value that could be a credential, those inside base spans too: copied (more
    owners or repositories than a live one has), live (few of them, and it looks random) or own (few of them).

    A null or empty text has no spans. Rows are kept apart by a number given when the scan is stored, so repeated ids
    and rows stay as they are. A value's repositories and owners are counted exactly over the whole table.
    """
    scanned = stored(scan(docs, id_col, text_col, list(repository_cols), list(owner_cols)).withColumn("row", F.monotonically_increasing_id()), "secrets")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    verdict = stored(ownership(scanned).select("h", live.alias("few"), (F.col("copies") >= HOT_COPIES).alias("hot")), "verdicts")
    said = F.when(~F.col("few"), "copied").when(F.col("random") == 1, "live").otherwise("own").alias("verdict")
    each = scanned.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    judged = _with_verdicts(each, verdict).groupBy("row").agg(
        F.collect_list(F.when(F.col("few") & (F.col("random") == 1), F.struct("a", F.lit(3).alias("k"), "b"))).alias("live"),
        F.count_if(~F.col("few")).alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("a", "b", said))).alias("judged"),
    )
    out = scanned.drop("repository", "owner", "found").join(judged, "row", "left")
    bare = "filter(coalesce(live, array()), x -> NOT exists(spans, y -> y.a < x.b AND x.a < y.b))"
    count = lambda k: F.expr(f"CAST(size(filter(spans, x -> x.k = {k})) AS LONG)")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.expr(f"array_sort(concat(spans, {bare}))").alias("all"),
        "base_sha256",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.expr("CAST(size(coalesce(live, array())) AS LONG)").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("judged", F.array().cast("array<struct<a:int,b:int,verdict:string>>")).alias("judged"),
    )


def _with_verdicts(each: DataFrame, verdict: DataFrame) -> DataFrame:
    """The verdict of every row's value: rows of hot values, of which there are few, stay where they are, the others meet their verdicts by a shuffle."""
    hot = verdict.filter("hot").select("h", "few")
    n = hot.count()
    if not 0 < n <= BROADCAST_HOT:
        return each.join(verdict.drop("hot"), "h")
    marked = each.join(F.broadcast(hot), "h", "left")
    rest = marked.filter("few IS NULL").drop("few").join(verdict.filter("NOT hot").drop("hot"), "h")
    return marked.filter("few IS NOT NULL").unionByName(rest)


def span_string(spans: str) -> F.Column:
    """spans (array of start, kind, end) as kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.a, x.b)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied and verdicts (start:end:verdict, comma-joined) of every document."""
    verdicts = F.expr("array_join(transform(judged, x -> concat_ws(':', x.a, x.b, x.verdict)), ',')").alias("verdicts")
    return secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", span_string("all").alias("spans"), "n_live", "n_copied", verdicts)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with every span of every text replaced by [SECRET].

    Spans meet their rows by two hashes of id and text, so nulls and repeated ids do no harm; with up to
    BROADCAST_SPANS rows that have spans these are broadcast and no text moves, with more both sides are shuffled.
    """
    key = F.concat_ws(":", F.hex(F.xxhash64(id_col, text_col)), F.hex(F.xxhash64(F.lit(3), text_col, id_col)))
    keyed = docs.withColumn("__key", key)
    spans = secrets(keyed, "__key", text_col, **options).filter(F.size("all") > 0)
    spans = stored(spans.select("__key", F.col("all").alias("__spans")), "spans").dropDuplicates(["__key"])
    size = spans.agg(F.count("*").alias("rows"), F.sum(F.size("__spans")).alias("spans")).first()
    few = size["rows"] <= BROADCAST_SPANS and (size["spans"] or 0) <= 10 * BROADCAST_SPANS
    joined_rows = keyed.join(F.broadcast(spans) if few else spans, "__key", "left")
    return joined_rows.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(_cut(text_col))).select(*docs.columns)


def _cut(text_col: str) -> F.Column:
    """The text with [SECRET] for each span; of overlapping spans, those that start inside an earlier one only extend it."""
    return F.expr(f"""
      aggregate(__spans, named_struct('at', 0, 'out', ''),
        (s, x) -> CASE WHEN x.b <= s.at THEN s
                       ELSE named_struct('at', x.b, 'out', concat(s.out,
                         CASE WHEN x.a < s.at THEN '' ELSE concat(substring(`{text_col}`, s.at + 1, x.a - s.at), '[SECRET]') END)) END,
        s -> concat(s.out, substring(`{text_col}`, s.at + 1)))""")
