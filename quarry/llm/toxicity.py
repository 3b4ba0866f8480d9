"""Operator 4: toxicity by a convolutional text classifier.

A word's vector is the mean of hashed vectors: the word itself and its beginnings, so that inflected forms share what
was learned. Filters of widths 1, 2 and 3 slide over a text's word vectors; each filter's largest response feeds a
logistic unit. Everything is trained here with numpy by minibatch Adagrad; the gradient of a maximum reaches one window
only, so a step costs little. A text's every word is scored: a table of filter responses by distinct word turns the
convolution into additions.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held, map_batches, texts_of

WIDTHS, FILTERS, DIM, TABLE = (1, 2, 3), 8, 12, 1 << 17
#: Beginnings of a word, in characters, that have vectors of their own.
BEGINNINGS = (3, 4, 5, 6, 7)
#: At most so many labelled documents of each class train the classifier, by smallest hash of the id.
MOST_TOXIC, MOST_CLEAN = 3000, 5000
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.05, 7
THRESHOLD = 0.3
#: Words whose filter responses a worker keeps, and words that go through the filters at once.
MEMO, CHUNK = 200_000, 1 << 18
_STRIP = ".,;:!?\"'()[]{}#*$%&|<>-_"


def subwords(word: str) -> list[int]:
    """Places in the table of a word's vectors; always 1 + len(BEGINNINGS), short words repeat."""
    w = word.strip(_STRIP) or word
    return [xxhash.xxh32_intdigest(f"={w}") % TABLE] + [xxhash.xxh32_intdigest(f"^{w[:k]}" if len(w) >= k else f"={w}") % TABLE for k in BEGINNINGS]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().split()


@dataclass
class Classifier:
    """Parameters: word vectors, filters (one matrix for each width and place in the window), output weights, calibration."""

    vectors: np.ndarray
    filters: dict[tuple[int, int], np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    @classmethod
    def new(cls) -> Classifier:
        rng = np.random.default_rng(SEED)
        filters = {(w, k): rng.normal(0, 0.3, (DIM, FILTERS)).astype(np.float32) for w in WIDTHS for k in range(w)}
        for f in filters.values():
            f[0] = np.abs(f[0]) + 0.5  # the first coordinate starts as the evidence of each hashed unit
        return cls(rng.normal(0, 0.05, (TABLE, DIM)).astype(np.float32), filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.0)

    def pooled(self, x: np.ndarray, starts: np.ndarray, places: bool = False):
        """Largest responses of each text (texts without words: 0), and where they are. x: word vectors, 2 zero rows after each text."""
        n = len(starts) - 1
        best = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        where = np.full(best.shape, -1, np.int64)
        first, last = starts[:-1] + 2 * np.arange(n), starts[1:] + 2 * np.arange(n)
        full = np.flatnonzero(last > first)
        if not len(full):
            return best, where
        bounds = np.stack([first[full], last[full]], 1).ravel()
        for j, w in enumerate(WIDTHS):
            r = x @ self.filters[w, 0]
            for k in range(1, w):
                r[:-k] += (x @ self.filters[w, k])[k:]
            at = slice(j * FILTERS, (j + 1) * FILTERS)
            top = np.maximum.reduceat(r, bounds, axis=0)[::2]
            best[full, at] = np.maximum(top + self.bias[w], 0)
            if places:
                owner = np.repeat(np.arange(len(full)), last[full] - first[full])
                rows = np.concatenate([np.arange(a, b) for a, b in zip(first[full], last[full], strict=True)])
                for f in range(FILTERS):
                    hit = rows[np.flatnonzero(r[rows, f] == top[owner, f])][::-1]
                    doc = np.searchsorted(first[full], hit, side="right") - 1
                    where[full[doc], j * FILTERS + f] = hit  # the first of equals stays
        return best, where

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        z = (pooled @ self.out + self.out_bias).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


def _numbered(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subword places of each distinct word (row 0 is padding), texts' words as rows of it with 2 paddings after each text, and starts."""
    numbers: dict[bytes, int] = {}
    rows: list[int] = []
    starts = [0]
    for t in texts:
        cut = words_of(t)
        rows += [numbers.setdefault(w, len(numbers) + 1) for w in cut]
        rows += [0, 0]
        starts.append(starts[-1] + len(cut))
    units = np.array([[TABLE] * (1 + len(BEGINNINGS)), *(subwords(w.decode()) for w in numbers)], np.int64)
    return units, np.array(rows, np.int64), np.array(starts, np.int64)


def train(texts: list[str], toxic: np.ndarray, langs: list[str | None]) -> Classifier:
    """Fit on four fifths of the texts; the rest calibrates the score and the thresholds by language."""
    model = Classifier.new()
    toxic = np.asarray(toxic, np.float32)
    if not len(texts) or toxic.min() == toxic.max():
        model.scale = (0.0, 3.0 if len(texts) and toxic.min() == 1 else -3.0)
        return model
    units, rows, starts = _numbered(texts)
    n, padded = len(texts), starts + 2 * np.arange(len(starts))
    fit = np.arange(n) % 5 != 4
    # evidence of each hashed unit: log odds by the number of texts that have it, shrunk where few have
    counts = np.zeros((2, TABLE + 1))
    for i in np.flatnonzero(fit):
        counts[int(toxic[i])][np.unique(units[np.unique(rows[padded[i] : padded[i + 1] - 2])])] += 1
    totals = np.array([(fit & (toxic == c)).sum() for c in (0, 1)]) + 1.0
    odds = np.log((counts[1] + 0.2) / totals[1]) - np.log((counts[0] + 0.2) / totals[0])
    seen = counts.sum(0)
    model.vectors[:, 0] = np.clip(odds * seen / (seen + 4), -4, 4)[:TABLE]
    vectors = np.vstack([model.vectors, np.zeros((1, DIM), np.float32)])
    params = [vectors, *model.filters.values(), *model.bias.values(), model.out]
    squares = [np.full(p.shape, 1e-3, np.float32) for p in params]
    keys = list(model.filters)
    rng = np.random.default_rng(SEED)
    size = 1 + len(BEGINNINGS)

    def vectors_of(r: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(r, return_inverse=True)
        return vectors[units[distinct]].mean(1)[back]

    def gather(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.concatenate([rows[padded[i] : padded[i + 1]] for i in which])
        return r, np.concatenate([[0], np.cumsum(np.diff(starts)[which])])

    def step(i: int, grad: np.ndarray, at=slice(None)) -> None:
        squares[i][at] += grad * grad
        params[i][at] -= RATE * grad / np.sqrt(squares[i][at])

    order = np.flatnonzero(fit)
    for _ in range(EPOCHS):
        rng.shuffle(order)
        for at in range(0, len(order), BATCH):
            which = order[at : at + BATCH]
            r, own = gather(which)
            x = vectors_of(r)
            best, where = model.pooled(x, own, places=True)
            z = best @ model.out + model.out_bias
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic[which]) / len(which)
            down = error[:, None] * model.out[None, :] * (best > 0)
            step(len(params) - 1, best.T @ error)
            model.out_bias -= RATE * float(error.sum())
            units_at, units_by = [], []
            for j, w in enumerate(WIDTHS):
                block = slice(j * FILTERS, (j + 1) * FILTERS)
                d, hit = down[:, block], where[:, block]
                some = (hit >= 0) & (d != 0)
                doc, f = np.nonzero(some)
                step(1 + len(keys) + j, (d * some).sum(0))
                for k in range(w):
                    i = keys.index((w, k))
                    place = hit[doc, f] + k
                    grad = np.zeros((DIM, FILTERS), np.float32)
                    np.add.at(grad.T, f, d[doc, f][:, None] * x[place])
                    units_at.append(units[r[place]].ravel())
                    units_by.append(np.repeat(d[doc, f][:, None] * model.filters[w, k].T[f] / size, size, axis=0))
                    step(1 + i, grad)
            ids, back = np.unique(np.concatenate(units_at), return_inverse=True)
            grads = np.zeros((len(ids), DIM), np.float32)
            np.add.at(grads, back, np.concatenate(units_by))
            known = ids < TABLE
            step(0, grads[known], ids[known])
    model.vectors = vectors[:TABLE]
    _calibrate(model, [i for i in range(n) if not fit[i]], gather, vectors_of, toxic, langs)
    return model


def _calibrate(model: Classifier, rest: list[int], gather, vectors_of, toxic: np.ndarray, langs: list[str | None]) -> None:
    """Platt scaling on the held-back texts, then the threshold of each language that has both classes there."""
    z = np.zeros(len(rest))
    for at in range(0, len(rest), BATCH):
        which = np.array(rest[at : at + BATCH])
        r, own = gather(which)
        z[at : at + BATCH] = model.pooled(vectors_of(r), own)[0] @ model.out + model.out_bias
    y = toxic[rest]
    if len(rest) < 20 or y.min() == y.max():
        return
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, a, b = np.where(y > 0, up, down), 1.0, 0.0
    for _ in range(300):  # plain gradient steps on two numbers
        e = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - target
        a, b = a - 0.2 * float((e * z).mean()), b - 0.2 * float(e.mean())
    model.scale = (max(a, 0.05), b)
    p = 1 / (1 + np.exp(-np.clip(model.scale[0] * z + b, -30, 30)))
    names = np.array([langs[i] or "" for i in rest])
    for name in np.unique(names):
        own, yes = p[names == name], y[names == name] > 0
        if yes.any() and not yes.all():
            cuts = np.unique(np.concatenate([[THRESHOLD], own]))
            f1 = [2 * (yes & (own >= c)).sum() / ((own >= c).sum() + yes.sum()) for c in cuts]
            good = cuts[np.array(f1) == max(f1)]
            model.thresholds[str(name)] = float(THRESHOLD if good[0] <= THRESHOLD <= good[-1] else good[0])


class Scorer:
    """Scores texts with a table of filter responses by distinct word."""

    def __init__(self, model: Classifier) -> None:
        self.model = model
        self.joined = np.concatenate([model.filters[w, k] for w in WIDTHS for k in range(w)], axis=1)
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.table = np.zeros((1, self.joined.shape[1]), np.float32)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.numbers) > MEMO:
            self.reset()
        new = [w for w in words if w not in self.numbers]
        if new:
            units = np.array([subwords(w.decode()) for w in new], np.int64)
            n = len(self.numbers)
            self.table = np.vstack([self.table[: n + 1], self.model.vectors[units].mean(1) @ self.joined])
            self.numbers.update(zip(new, range(n + 1, n + 1 + len(new)), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        cut = [words_of(t) for t in texts]
        while at < len(cut):
            end, size = at + 1, len(cut[at])
            while end < len(cut) and size + len(cut[end]) <= CHUNK:
                size += len(cut[end])
                end += 1
            out[at:end] = self.model.probability(self._pooled(cut[at:end]))
            at = end
        return out

    def _pooled(self, cut: list[list[bytes]]) -> np.ndarray:
        self._learn(set().union(*cut))
        get = self.numbers.__getitem__
        rows = np.fromiter((x for c in cut for x in (*map(get, c), 0, 0)), np.int64)
        counts = np.array([len(c) for c in cut])
        first = np.concatenate([[0], np.cumsum(counts + 2)[:-1]])
        best = np.zeros((len(cut), FILTERS * len(WIDTHS)), np.float32)
        full = np.flatnonzero(counts)
        if not len(full):
            return best
        bounds = np.stack([first[full], first[full] + counts[full]], 1).ravel()
        column = 0
        for j, w in enumerate(WIDTHS):
            r = self.table[:, column : column + FILTERS][rows]
            for k in range(1, w):
                r[:-k] += self.table[:, column + k * FILTERS : column + (k + 1) * FILTERS][rows[k:]]
            column += w * FILTERS
            best[full, j * FILTERS : (j + 1) * FILTERS] = np.maximum(np.maximum.reduceat(r, bounds, axis=0)[::2] + self.model.bias[w], 0)
        return best


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Classifier:
    """Train on a bounded sample of labelled rows that are not held out; of several labels of one id, toxic counts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = known.orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = by_hash.filter("toxic = 1").limit(most_toxic).unionByName(by_hash.filter("toxic = 0").limit(most_clean))
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "__id"))  # at most most_toxic + most_clean ids
    rows = docs.select("doc_id", "text", "lang").join(chosen, F.col("doc_id") == F.col("__id")).groupBy("doc_id").agg(F.min(F.struct("text", "lang", "toxic")).alias("r")).select("doc_id", "r.*").toPandas()
    rows = rows.assign(key=[zlib.crc32(str(d).encode()) for d in rows["doc_id"]]).sort_values(["key", "doc_id"])
    return train([t or "" for t in rows["text"]], rows["toxic"].to_numpy(), list(rows["lang"]))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, lang, score of every row; an empty or null text gets the score of no words at all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> dict:
        scorer = held(f"toxicity {id(shared.value)}", lambda: Scorer(shared.value))
        return {"doc_id": batch.column(0), "lang": batch.column(1), "score": scorer.scores(texts_of(batch))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, ["doc_id", "lang", "text"], make, f"doc_id {kind}, lang string, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (at the fixed threshold) and flagged (at the language's own) of every document."""
    model = fit(docs, labels)
    own = F.lit(THRESHOLD)
    for name, cut in sorted(model.thresholds.items()):
        own = F.when(F.coalesce(F.col("lang"), F.lit("")) == name, F.lit(cut)).otherwise(own)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= own).cast("int").alias("flagged"))
