"""Operator 8: quality rules by a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed to a fixed number of buckets. Two multinomials are counted over them: one over all
documents (raw) and one over trusted documents (target). A document's score is the mean over its n-grams of
log p_target - log p_raw, so it does not depend on length. Each document is kept or not by one threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import _arrow_schema, held, map_batches, mix64, slices, stored, texts_of
from quarry.llm.words import hash_words

#: Bits of the number of buckets: the least, for less than 1 GB, and the most. Between them it grows with the root of the
#: input. What is collected and broadcast is two vectors of that length.
BITS, MOST_BITS = 16, 20
#: Labelled documents up to this number are broadcast to where they are counted (9 bytes each), more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Share of trusted documents that the threshold may reject.
LOSS = 0.001
SYMBOLS = frozenset("#*$%&|<>")


def _grams(hashes: np.ndarray, starts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and of each pair with the next word of its text; a text's last word has no pair and gets its own bucket twice."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    one = (mix64(hashes) >> shift).astype(np.int64)
    following = np.empty_like(hashes)
    following[:-1] = hashes[1:]
    two = (mix64(hashes * np.uint64(0x9E3779B97F4A7C15) + mix64(following)) >> shift).astype(np.int64)
    last = starts[1:][starts[1:] > starts[:-1]] - 1
    two[last] = one[last]
    return one, two


@dataclass
class Rules:
    """The fitted ratio of each bucket and the threshold."""

    ratio: np.ndarray
    threshold: float

    def scores(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The length-normalised ratio of each text; 0 without words."""
        if not len(hashes):
            return np.zeros(len(starts) - 1)
        one, two = _grams(hashes, starts, len(self.ratio))
        n = np.diff(starts)
        out = np.zeros(len(n))
        full = np.flatnonzero(n)
        out[full] = np.add.reduceat(self.ratio[one] + self.ratio[two], starts[full]) / (2 * n[full])  # a sum of each text's own numbers
        return out


def clean_labels(labels: DataFrame) -> DataFrame:
    """__id and trusted of every labelled id with quality 0 or 1; of rows of one id the best quality counts."""
    clean = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("trusted"))
    return clean.select(F.col("doc_id").alias("__id"), "trusted")


def buckets_for(docs: DataFrame, text_col: str = "text") -> int:
    """The number of buckets for a table, by the bytes of its texts, so that it depends on the documents alone and not on how they are stored."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return 1 << min(BITS + (size >> 30).bit_length() // 2, MOST_BITS)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> Rules:
    """Count both multinomials and choose the threshold.

    Raw counts cover every document; the target covers two thirds of all trusted labelled documents, by a hash of the
    id. The threshold, from all others, rejects at most LOSS of the trusted documents and lies halfway to the next rejected
    low-quality score, or under all of them if there are none. Their scores stay on Spark. Without labels nothing is
    rejected.
    """
    buckets = buckets or buckets_for(docs, text_col)
    every = clean_labels(labels)
    every = F.broadcast(every) if every.count() <= BROADCAST_LABELS else every
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(every, F.col("doc_id") == F.col("__id"), "left")
    marked = marked.select("text", F.when(F.col("trusted") == 1, F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) > 0).otherwise(False).alias("target"))
    fields = _arrow_schema(docs.sparkSession, "bucket int, raw long, target long")

    def count(batches):
        held("quality", dict)
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in slices(batches):
            hashes, starts = hash_words(texts_of(batch))
            if not len(hashes):
                continue
            one, two = _grams(hashes, starts, buckets)
            chosen = np.repeat(np.asarray(batch.column(1).to_pylist(), bool), np.diff(starts))
            for grams in one, two:
                raw += np.bincount(grams, minlength=buckets)
                target += np.bincount(grams[chosen], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((seen, raw[seen], target[seen]), fields, strict=True)], schema=fields)

    counts = marked.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return Rules(np.zeros(buckets), float("-inf"))
    # both are smoothed towards the raw distribution, so that a bucket that few documents have says little
    p_raw = (raw + 1) / (raw.sum() + buckets)
    weight = 5.0 * buckets * target.sum() / max(raw.sum(), 1) + 100.0
    p_target = (target + weight * p_raw) / (target.sum() + weight)
    rules = Rules(np.log(p_target) - np.log(p_raw), float("-inf"))
    rest = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(every, F.col("doc_id") == F.col("__id"))
    rest = rest.filter((F.col("trusted") == 0) | (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0))
    known = ratios(rest.select("doc_id", "trusted", "text"), rules)
    rules.threshold = threshold_of(known.groupBy("doc_id").agg(F.max("trusted").alias("trusted"), F.min("score").alias("score")))  # a row an id, however often it occurs
    return rules


def ratios(labelled: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, trusted, score of rows (doc_id, trusted, text) with words."""
    shared = labelled.sparkSession.sparkContext.broadcast(rules)
    kinds = ", ".join(f"{c} {labelled.schema[c].dataType.simpleString()}" for c in ("doc_id", "trusted"))

    def run(batches):
        held("quality", dict)
        for batch in slices(batches):
            hashes, starts = hash_words(texts_of(batch))
            own = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared.value.scores(hashes, starts))], names=["doc_id", "trusted", "score"])
            yield own.filter(pa.array(np.diff(starts) > 0))

    return labelled.mapInArrow(run, f"{kinds}, score double")


def choose_threshold(good: np.ndarray, bad: np.ndarray, loss: float = LOSS) -> float:
    """The threshold, over which documents are kept: in the widest gap of bad scores under the loss-quantile of good ones."""
    if not len(good) or not len(bad):
        return float("-inf")
    low = float(np.sort(good)[int(loss * len(good))])
    under = bad[bad < low]
    return (low + float(under.max())) / 2 if len(under) else float("-inf")


def threshold_of(known: DataFrame, loss: float = LOSS) -> float:
    """choose_threshold() of the rows of known (trusted, score), however many: the loss-quantile of the good ones and the
    largest bad score under it come to the driver, no others do."""
    known = stored(known.select("trusted", "score"), "scores")
    good, bad = known.filter("trusted = 1"), known.filter("trusted = 0")
    n = good.count()
    if not n:
        return float("-inf")
    low = nth_smallest(good, "score", int(loss * n))
    under = bad.filter(F.col("score") < low).agg(F.max("score")).first()[0]
    return choose_threshold(np.array([low]), np.array([] if under is None else [under]))


def nth_smallest(rows: DataFrame, column: str, n: int, bins: int = 4096) -> float:
    """The n-th smallest value (from 0): counts in equal bins between the least and the largest, again inside the bin that holds it."""
    while True:
        low, high = rows.agg(F.min(column), F.max(column)).first()
        width = (high - low) / bins
        if not width:
            return float(low)
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        for r in rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect():
            if n < r.n:
                break
            n -= r.n
        rows = rows.filter(at == r.bin)


def surface(text: str, hashes: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            repeated += line in seen
            seen.add(line)
    return len(text) - spaces, symbols, repeated, repeat_words(hashes)


def repeat_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more; ids are exact numbers of the words, from 0 on."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    if n <= 1 << 21:
        windows = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # three numbers don't fit 64 bits: pairs are numbered first
        windows = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1] * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def score(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score and verdict of every row, with the columns of keep.

    A null text is empty: no words, score 0. Equal rows have equal results.
    """
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (id_col, *keep)}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, verdict boolean"

    def make(batch: pa.RecordBatch) -> dict:
        held("quality", dict)
        texts = texts_of(batch)
        hashes, starts = hash_words(texts)
        scores = shared.value.scores(hashes, starts)
        rows = []
        for i, t in enumerate(texts):
            own = hashes[starts[i] : starts[i + 1]]
            _, ids = np.unique(own, return_inverse=True)
            rows.append(surface(t, ids.astype(np.int64)))
        columns = list(zip(*rows, strict=True))
        return {c: batch.column(i) for i, c in enumerate(("__0", *map(str, keep)))} | {
            "n_words": np.diff(starts),
            "word_chars": columns[0],
            "n_symbols": columns[1],
            "n_dup_lines": columns[2],
            "n_repeat_words": columns[3],
            "score": scores,
            "verdict": scores >= shared.value.threshold,
        }

    return map_batches(docs.select(id_col, *keep, F.col(text_col).alias("text")), [id_col, *keep, "text"], make, schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's base figures, score and verdict; kept only if no base rule fails and the ratio's threshold is met.

    A null or empty text has no words and fails the base rules; a null id is judged like any other; repeated rows have
    equal results; an empty table gives no rows, and without labels the ratio rejects nothing.
    """
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("verdict"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns and as often as they are there; the text is read once more and not shuffled."""
    rules = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        for batch in slices(batches):
            texts = texts_of(batch)
            hashes, starts = hash_words(texts)
            keep = shared.value.scores(hashes, starts) >= shared.value.threshold
            for i in np.flatnonzero(keep):
                own = hashes[starts[i] : starts[i + 1]]
                n = len(own)
                keep[i] = n >= 50 and 100 * repeat_words(np.unique(own, return_inverse=True)[1].astype(np.int64)) <= 50 * n
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
