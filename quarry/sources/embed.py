"""Embeddings: a protocol, a deterministic embedder without network, batches, checks, and a cache of query vectors."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from pathlib import Path
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import knn, ranking

try:  # for a few bytes the plain one takes a fraction of what a call of OpenSSL takes
    from _md5 import md5
except ImportError:
    from hashlib import md5

#: Seconds that a query's vector may take.
QUERY_DEADLINE_S = 15.0


class Embedder(Protocol):
    """Anything that turns texts into vectors of one dimension, in order."""

    name: str
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


_HUMP, _WORD, _md5 = re.compile("([a-z0-9])([A-Z])"), re.compile(b"[a-z0-9]+"), partial(md5, usedforsecurity=False)


class HashingEmbedder:
    """Signed feature hashing of identifier tokens and their pairs to a unit vector; the same text always gives the same."""

    name = "feature-hashing"

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        tokens = _WORD.findall(_HUMP.sub(r"\1 \2", text).encode("ascii", "replace").lower())
        if not tokens:
            return [0.0] * self.dimension
        digests = [_md5(t).digest() for t in tokens] + [_md5(b"%b %b" % pair).digest() for pair in zip(tokens, tokens[1:], strict=False)]
        h = np.frombuffer(b"".join(digests), "<u8")[::2]
        weights = np.where(np.arange(len(h)) < len(tokens), 1.0, 0.5) * np.where(h >> np.uint64(63), 1.0, -1.0)
        v = np.bincount((h % np.uint64(self.dimension)).astype(np.int64), weights, self.dimension).tolist()  # halves: sums are exact in any order
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v


class ProviderError(RuntimeError):
    """The provider failed or returned something else than it was asked for."""


class RetryLater(OSError):
    """A passing failure of a provider; ``after`` seconds if it said so."""

    def __init__(self, message: str, after: float = 0.0) -> None:
        super().__init__(message)
        self.after = after


class Pace:
    """Requests and tokens that a provider takes in a window of time; what would be more waits until the oldest leave it.

    Every Python worker keeps a pace of its own, so share is the number of tasks that embed at once. A request that has more
    tokens than the whole window goes alone."""

    def __init__(self, requests: int, tokens: int, window_s: float = 60.0, share: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.requests, self.tokens, self.window_s, self.clock, self.sleep = max(1, requests // share), max(1, tokens // share), window_s, clock, sleep
        self._sent: list[tuple[float, int]] = []

    def wait(self, tokens: int) -> None:
        tokens = min(tokens, self.tokens)
        while True:
            now = self.clock()
            self._sent = [(t, n) for t, n in self._sent if t > now - self.window_s]
            if len(self._sent) < self.requests and sum(n for _, n in self._sent) + tokens <= self.tokens:
                self._sent.append((now, tokens))
                return
            self.sleep(max(0.001, self._sent[0][0] + self.window_s - now))


def shortened(text: str, max_tokens: int) -> str:
    """text if its estimated tokens (four characters each) are no more than max_tokens, else its beginning with a margin of a twentieth."""
    tokens = -(-len(text) // 4)
    return text if tokens <= max_tokens else text[: int(max_tokens / tokens * len(text) * 0.95)]


class HttpEmbedder:
    """A remote provider over HTTP, by one of three public forms of request: ``openai`` (base/embeddings, data[].embedding),
    ``ollama`` (base/api/embed, embeddings[]) or ``gemini`` (base/models/name:batchEmbedContents, embeddings[].values).

    Answers 429 and 5xx and a lost connection are passing failures, which Guarded tries again; any other refusal is a
    ValueError. The key is read from the environment variable named by key_env where the request is made.
    """

    def __init__(self, base: str, model: str, dimension: int, style: str = "openai", key_env: str = "", timeout_s: float = 30.0) -> None:
        if style not in ("openai", "ollama", "gemini"):
            raise ValueError(f"unknown form of request: {style}")
        self.base, self.model, self.dimension, self.style, self.key_env, self.timeout_s = base.rstrip("/"), model, dimension, style, key_env, timeout_s
        self.name = f"{style}:{model}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        path = {"openai": "/embeddings", "ollama": "/api/embed", "gemini": f"/models/{self.model}:batchEmbedContents"}[self.style]
        headers = {"Content-Type": "application/json"}
        if self.key_env:
            key = os.environ[self.key_env]
            headers |= {"x-goog-api-key": key} if self.style == "gemini" else {"Authorization": f"Bearer {key}"}
        asked: dict = {"model": self.model, "input": texts}
        if self.style == "gemini":
            asked = {"requests": [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, "outputDimensionality": self.dimension} for t in texts]}
        request = urllib.request.Request(self.base + path, json.dumps(asked).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s) as answer:
                body = json.load(answer)
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                after = e.headers.get("Retry-After", "")
                raise RetryLater(f"{self.name}: {e.code}", float(after) if after.isdigit() else 0.0) from e
            raise ValueError(f"{self.name}: {e.code}") from e
        if self.style == "ollama":
            return body["embeddings"]
        if self.style == "gemini":
            return [e["values"] for e in body["embeddings"]]
        return [d["embedding"] for d in sorted(body["data"], key=lambda d: d.get("index", 0))]


class Guarded:
    """An embedder with batches, retries with growing pauses, and a breaker that fails fast for a while after repeated failures.

    Texts longer than max_tokens are shortened, requests keep to a pace, and no retry begins after deadline_s."""

    def __init__(self, inner: Embedder, batch: int = 256, retries: int = 3, pause: float = 0.5, breaker_after: int = 3, breaker_s: float = 15.0, pace: Pace | None = None, max_tokens: int | None = None, deadline_s: float = math.inf) -> None:
        self.pace, self.max_tokens, self.deadline_s = pace, max_tokens, deadline_s
        self.inner, self.batch, self.retries, self.pause, self.breaker_after, self.breaker_s = inner, batch, retries, pause, breaker_after, breaker_s
        self.name, self.dimension = inner.name, inner.dimension
        self._failures, self._open_until = 0, 0.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.max_tokens:
            texts = [shortened(t, self.max_tokens) for t in texts]
        return [v for at in range(0, len(texts), self.batch) for v in self._batch(texts[at : at + self.batch])]

    def _batch(self, texts: list[str]) -> list[list[float]]:
        if time.monotonic() < self._open_until:
            raise ProviderError(f"{self.name} failed {self._failures} times; next attempt later")
        began = time.monotonic()
        for attempt in range(self.retries + 1):
            if self.pace:
                self.pace.wait(sum(-(-len(t) // 4) for t in texts))
            try:
                out = check_vectors(self.inner.embed(texts), len(texts), self.dimension)
                self._failures = 0
                return out
            except ValueError:
                raise
            except Exception as e:
                self._failures += 1
                if self._failures >= self.breaker_after:
                    self._open_until = time.monotonic() + self.breaker_s
                if attempt == self.retries or time.monotonic() < self._open_until:
                    raise ProviderError(str(e)) from e
                delay = min(max(self.pause * 2**attempt * random.uniform(0.5, 1.0), getattr(e, "after", 0.0)), 60.0)
                if time.monotonic() - began + delay >= self.deadline_s:
                    raise ProviderError(f"{self.name}: no time for another attempt after {attempt + 1}") from e
                time.sleep(delay)
        raise AssertionError


def check_vectors(vectors: list[list[float]], n: int, dimension: int) -> list[list[float]]:
    """vectors as unit vectors; ValueError for a wrong number, a wrong dimension or numbers that aren't finite."""
    if len(vectors) != n:
        raise ValueError(f"{len(vectors)} vectors for {n} texts")
    out = []
    for v in vectors:
        if len(v) != dimension or not all(map(math.isfinite, v)):
            raise ValueError(f"expected {dimension} finite numbers")
        norm = math.sqrt(sum(x * x for x in v))
        out.append([x / norm for x in v] if norm else list(v))
    return out


def embed_column(df: DataFrame, embedder: Embedder, text: str = "content", to: str = "embedding") -> DataFrame:
    """df with the vectors of a text column, batch by batch; a null text is embedded as an empty one."""
    at = df.columns.index(text)
    schema = df.select("*", F.lit(None).cast("array<float>").alias(to)).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            vectors = embedder.embed([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, to])

    return df.mapInArrow(run, schema)


def search(table: DataFrame, query: str, embedder: Embedder, k: int = 20, vector: str = "embedding", key: str = "vec_id", where: Column | None = None, least: float | None = None, cache: QueryCache | None = None, deadline_s: float = QUERY_DEADLINE_S, pattern: str | None = None, content: str = "content", compat: bool = False) -> DataFrame:
    """The k rows nearest to a text, among those that fit a pattern: the text is embedded (or taken from the cache), then
    more rows than k are fetched, and those that the least similarity refuses fall out. DeadlineExceeded if no vector is
    there in time. With compat the pattern is looked for only among the rows that were fetched, as the reference does."""
    found = within(deadline_s, lambda: cache.vector(embedder, query) if cache else embedder.embed([query])[0])
    if pattern is not None and not compat:
        fits = T.matches(F.col(content), pattern)
        where, pattern = (fits if where is None else fits & where), None
    hits = knn.top_k(table, [float(x) for x in found], ranking.over_fetch(k, "pattern" if pattern else "search"), vector, key, where)
    hits = hits if pattern is None else hits.filter(T.matches(F.col(content), pattern))
    hits = ranking.at_least(hits, least) if least is not None else hits
    return hits.orderBy("rank").limit(k)


class DeadlineExceeded(ProviderError):
    """No vector of the query in time; the caller may fall back to words."""


def within(seconds: float, step: Callable[[], list[float]]) -> list[float]:
    """step's result, or DeadlineExceeded after the time; the step itself runs on in its thread."""
    with_thread = ThreadPoolExecutor(1)
    try:
        return with_thread.submit(step).result(timeout=seconds)
    except TimeoutError as e:
        raise DeadlineExceeded(f"no query vector within {seconds} s") from e
    finally:
        with_thread.shutdown(wait=False)


class QueryCache:
    """Vectors of queries in a folder of small files: kept for ttl_s, and the most files last used."""

    def __init__(self, folder: str, ttl_s: float = 30 * 86400, most: int = 2000) -> None:
        self.folder, self.ttl_s, self.most = Path(folder), ttl_s, most

    def _path(self, embedder: Embedder, text: str) -> Path:
        identity = json.dumps([embedder.name, embedder.dimension, text])
        return self.folder / f"{hashlib.sha256(identity.encode()).hexdigest()}.json"

    def vector(self, embedder: Embedder, text: str) -> list[float]:
        path = self._path(embedder, text)
        try:
            saved = json.loads(path.read_text())
            if time.time() - saved["at"] <= self.ttl_s and len(saved["vector"]) == embedder.dimension:
                path.touch()
                return saved["vector"]
        except (OSError, ValueError, KeyError, TypeError):
            pass
        vector = embedder.embed([text])[0]
        self.folder.mkdir(parents=True, exist_ok=True)
        temporary = path.with_suffix(".tmp")
        temporary.write_text(json.dumps({"at": time.time(), "vector": vector}))
        temporary.replace(path)
        self.prune()
        return vector

    def prune(self) -> None:
        found = sorted(self.folder.glob("*.json"), key=lambda p: p.stat().st_mtime, reverse=True)
        for p in found[self.most :]:
            p.unlink(missing_ok=True)
