"""A versioned table on plain Parquet: numbered manifests, generations, buckets that split, deletion vectors, compaction.

A commit is the creation of the next numbered manifest, which succeeds only if nobody else made it first; readers take
the highest number, so they see the whole of one generation or of the one before it. A generation's map names a page for
each of PAGES groups of buckets, and a page names the segments (folders of Parquet files) of its buckets. Rows are dealt
into buckets by the low bits of a hash of their file; a bucket that has grown splits by further bits while the others
stay as they are. A change writes its new rows as further segments, and for rows that go only their places, as deletion
vectors, which readers take off the segments that have any; so it writes what it touches, whatever the table's size.
``maintain`` rewrites buckets of many segments or many dead rows, and splits large ones.
"""

from __future__ import annotations

import copy
import hashlib
import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REQUIRED = ("id", "content", "file", "start", "end", "symbol", "embedding")
READABLE = ("id", "content", "file", "start", "end")
INDEX_ROWS, KEEP, KEEP_S = 10_000, 2, 24 * 3600
_BUCKET, _VECTOR = "__bucket", "segment string, __file string, __row long"
#: Buckets of a page agree in these low bits, and no bucket has fewer; a bucket's number is its depth in bits above DEPTH_AT and its value below.
PAGE_BITS, MOST_DEPTH, DEPTH_AT = 4, 20, 24
PAGES = 1 << PAGE_BITS
#: Bytes of a bucket beyond which it splits; dead share and segments beyond which it is written anew.
SPLIT_BYTES, MOST_DEAD, MOST_SEGMENTS = 1 << 30, 0.2, 8
#: Attempts at a commit that others keep overtaking; manifests that are kept.
ATTEMPTS, LOG = 20, 100
#: Files of a change that are looked up as a list, which skips row groups, rather than by a join.
FEW_FILES = 1000


class SchemaMismatch(ValueError):
    """Columns are missing that a table must have."""


class Locked(RuntimeError):
    """Another process writes."""


class Conflict(RuntimeError):
    """Somebody else has published since."""


class Fenced(RuntimeError):
    """The writer's lock has been taken over."""


def store_path(warehouse: str, root: str, profile: str = "") -> str:
    """The folder of a root's table; profiles are tables side by side."""
    name = hashlib.sha256(root.encode()).hexdigest()[:24]
    return f"{warehouse.rstrip('/')}/{name}" + (f"-{hashlib.sha256(profile.encode()).hexdigest()[:12]}" if profile else "")


def _new_name() -> str:
    return f"chunks_{int(time.time() * 1000):013d}_{uuid.uuid4().hex[:8]}"


def _numbers(label: int) -> tuple[int, int]:
    """depth and bits of a bucket."""
    return label >> DEPTH_AT, label & ((1 << DEPTH_AT) - 1)


class Layout:
    """A generation's buckets with their segments, and the pages that describe them.

    A segment is {path, rows, bytes, dead, vectors}: its folder, how many rows and bytes it has, how many of the rows are
    dead, and the tables that hold their places.
    """

    def __init__(self, schema: str, buckets: dict[int, dict], pages: dict[int, str]) -> None:
        self.schema, self.buckets, self.pages = schema, buckets, pages
        self.changed: set[int] = set()

    @classmethod
    def empty(cls, schema: str, depth: int) -> Layout:
        out = cls(schema, {(depth << DEPTH_AT) + bits: {"segments": []} for bits in range(1 << depth)}, {})
        out.changed = set(range(PAGES))
        return out

    def at(self, label: int) -> dict:
        """A bucket that is going to be changed."""
        self.changed.add(_numbers(label)[1] % PAGES)
        return self.buckets[label]

    def column(self) -> Column | DataFrame:
        """Each row's bucket by its file: an expression where all buckets are equally deep, else the directory as rows (slot, bucket)."""
        h = F.xxhash64("file")
        depths = {_numbers(b)[0] for b in self.buckets}
        most = max(depths)
        slot = h.bitwiseAND(F.lit((1 << most) - 1))
        if len(depths) == 1:
            return (F.lit(most << DEPTH_AT) + slot).cast("int")
        table = [0] * (1 << most)
        for label in self.buckets:
            depth, bits = _numbers(label)
            for i in range(bits, 1 << most, 1 << depth):
                table[i] = label
        if most <= 10:
            return F.get(F.array(*map(F.lit, table)), slot.cast("int"))
        labels = F.lit(b"".join(x.to_bytes(4, "big") for x in table))  # four bytes a slot, 4 MB at most
        return F.conv(F.hex(F.substring(labels, (slot * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("int")

    def segments(self, labels: Iterable[int] | None = None) -> list[dict]:
        return [s for b in (self.buckets if labels is None else labels) for s in self.buckets[b]["segments"]]


class Store:
    """A table of chunks under one folder, of which the last manifest names the generation that readers see."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self._conf)
        self._token: int | None = None

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    # files

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put_once(self, name: str, text: str) -> bool:
        """Create a file with its whole content, unless it exists: then nothing happens, and that is told.

        On a local or mounted file system it is a link, elsewhere a rename that doesn't overwrite; both are atomic there.
        """
        folder, _, last = name.rpartition("/")
        temporary = f"{folder}/.{last}-{uuid.uuid4().hex}"
        self._put(temporary, text)
        try:
            resolved = self._fs.resolvePath(self._at(temporary))
            if resolved.toUri().getScheme() == "file":
                old = self._jvm.java.io.File(resolved.toUri().getPath())
                self._jvm.java.nio.file.Files.createLink(self._jvm.java.io.File(old.getParent(), last).toPath(), old.toPath())
            else:
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._at(temporary), self._at(name), none)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(self._at(temporary), False)
        return True

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]

    # manifests

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("_log") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict | None:
        """The manifest that counts now, read once per query; None for a new table."""
        while found := self._versions():
            try:
                return self._get(f"_log/{found[-1]:012d}.json")
            except Py4JJavaError as e:  # trimmed while we looked: there are newer ones
                if "FileNotFound" not in e.java_exception.getClass().getName() or self._versions()[-1:] == found[-1:]:
                    raise
        return None

    def publish(self, generation: str, expected: int | None = None, marks: dict[str, int] | None = None, **more) -> dict:
        """Make a generation the one that readers see: the next manifest, created only if it isn't there.

        ``expected`` is the version that the generation was made from; if others have published since, that is a Conflict.
        Without it the generation follows whatever is there. ``marks`` are numbers that later manifests keep, and
        they keep ``metric``, what the vectors' distances are measured by, until another one is given.
        """
        for _ in range(ATTEMPTS):
            before = self.manifest() or {"version": 0}
            if expected is not None and before["version"] != expected:
                raise Conflict(f"version {before['version']} instead of {expected} of {self.path}")
            self._check_fence(before)
            kept = dict(before.get("marks", {}))
            for k, v in (marks or {}).items():
                kept[k] = max(v, kept.get(k, v))
            entry = {"version": before["version"] + 1, "generation": generation, "updated_ms": int(time.time() * 1000), "fence": self._token or before.get("fence", 0), "marks": kept, "metric": before.get("metric", "cosine"), **more}
            if self._put_once(f"_log/{entry['version']:012d}.json", json.dumps(entry)):
                for v in self._versions()[:-LOG]:
                    self._fs.delete(self._at(f"_log/{v:012d}.json"), False)
                return entry
        raise Conflict(f"others publish all the time in {self.path}")

    def _check_fence(self, manifest: dict) -> None:
        """A writer that holds a lock must hold the newest one, and nobody with a newer one may have published."""
        if self._token is not None and (manifest.get("fence", 0) > self._token or self._locks()[-1:] != [self._token]):
            raise Fenced(f"lock {self._token} of {self.path} was taken over")

    # generations

    def read(self, generation: str | None = None, columns: list[str] | None = None, required: tuple[str, ...] = READABLE) -> DataFrame:
        """The rows of a generation, or of the published one."""
        df = self._rows(self._layout(generation or self._active()))
        check_schema(df, required)
        return df.select(*columns) if columns else df

    def scan(self, where: Column | None = None, limit: int | None = None, columns: list[str] | None = None, generation: str | None = None) -> DataFrame:
        """Rows of a generation that fit where, of them any ``limit``, and of those the columns."""
        df = self.read(generation)
        df = df if where is None else df.filter(where)
        df = df if limit is None else df.limit(limit)
        return df.select(*columns) if columns else df

    def write(self, df: DataFrame, generation: str | None = None, append: bool = False, depth: int | None = None) -> str:
        """Rows as a new generation (or added to one); readers see it once it is published.

        A new one gets as many buckets as Spark's estimate of the rows' size needs, or 2 ** depth; later they split.
        """
        name = generation or _new_name()
        layout = self._layout(name) if append else Layout.empty(df.schema.json(), min(max(_depth_for(df) if depth is None else depth, PAGE_BITS), MOST_DEPTH))
        self._add(df, layout, name)
        self._put_layout(name, layout)
        return name

    def replace_files(self, new: DataFrame, touched: DataFrame, file: str = "file", marks: dict[str, int] | None = None) -> str:
        """A generation in which rows of touched(file) give way to new; nothing changes if that fails."""
        return self._change(touched, file, new, marks)

    def upsert(self, new: DataFrame, key: str = "id") -> str:
        """A generation in which rows of equal key give way to new."""
        return self._change(new, key, new)

    def delete(self, gone: DataFrame, key: str = "id") -> str:
        """A generation without rows of gone(key)."""
        return self._change(gone, key, None)

    def add(self, new: DataFrame, marks: dict[str, int] | None = None) -> str:
        """A generation with further rows."""

        def work(layout: Layout, name: str) -> bool:
            layout.schema = _merged(layout.schema, new.schema)
            self._add(new, layout, name)
            return True

        return self._commit(work, marks)

    def maintain(self, split_bytes: int = SPLIT_BYTES, most_dead: float = MOST_DEAD, most_segments: int = MOST_SEGMENTS) -> str | None:
        """A generation in which large buckets are split and those of many dead rows or segments are written anew; None if there is nothing to do."""

        def work(layout: Layout, name: str) -> bool:
            todo: dict[int, int] = {}  # bucket: its depth afterwards
            for label, b in layout.buckets.items():
                depth, rows = _numbers(label)[0], sum(s["rows"] for s in b["segments"])
                dead, size = sum(s["dead"] for s in b["segments"]), sum(s["bytes"] for s in b["segments"])
                live = size * (rows - dead) / max(rows, 1)
                if live > split_bytes and not b.get("whole") and depth < MOST_DEPTH:
                    todo[label] = min(MOST_DEPTH, depth + math.ceil(math.log2(live / split_bytes)))
                elif dead > most_dead * rows or len(b["segments"]) > most_segments:
                    todo[label] = depth
            if not todo:
                return False
            rows = self._rows(layout, todo)
            for label, deeper in todo.items():
                depth, bits = _numbers(label)
                layout.at(label)
                del layout.buckets[label]
                for high in range(1 << (deeper - depth)):
                    layout.buckets[(deeper << DEPTH_AT) + (high << depth) + bits] = {"segments": []}
            self._add(rows, layout, name)
            for label, deeper in todo.items():  # rows of one file can't be told apart by further bits
                depth, bits = _numbers(label)
                own = [(deeper << DEPTH_AT) + (high << depth) + bits for high in range(1 << (deeper - depth))]
                full = [x for x in own if layout.buckets[x]["segments"]]
                if deeper > depth and len(full) == 1:
                    layout.buckets[full[0]]["whole"] = True
            return True

        return self._commit(work)

    # segments and deletion vectors

    def _rows(self, layout: Layout, labels: Iterable[int] | None = None) -> DataFrame:
        """The live rows of all buckets, or of some; segments without dead rows are a plain scan."""
        schema = StructType.fromJson(json.loads(layout.schema))
        found = layout.segments(labels)
        clean = [s["path"] for s in found if not s["vectors"]]
        out = self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in clean)) if clean else None
        if any(s["vectors"] for s in found):
            live = self._placed(schema, [s for s in found if s["vectors"]]).select(*(f"`{c}`" for c in schema.names))
            out = live if out is None else out.unionByName(live)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _placed(self, schema: StructType, segments: list[dict]) -> DataFrame:
        """Live rows with __file (the end of their file's path) and __row, their place in it."""
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['path']}" for s in segments))
        rows = rows.select("*", F.substring_index("_metadata.file_path", "/", -3).alias("__file"), F.col("_metadata.row_index").alias("__row"))
        vectors = sorted({v for s in segments for v in s["vectors"]})
        if not vectors:
            return rows
        dead = self.spark.read.schema(_VECTOR).parquet(*(f"{self.path}/{v}" for v in vectors))
        return rows.join(dead.select("__file", "__row"), ["__file", "__row"], "left_anti")

    def _add(self, df: DataFrame, layout: Layout, name: str) -> None:
        """Write rows as one more segment of each bucket that they fall into; Spark splits and merges tasks by size."""
        dealt = df.withColumn(_BUCKET, layout.column())
        folder = f"{name}/{uuid.uuid4().hex}"
        dealt.hint("rebalance", F.col(_BUCKET)).sortWithinPartitions(_BUCKET, "file").write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        if not any(n.startswith(_BUCKET) for n in self._names(folder)):
            return
        rows = self.spark.read.schema(f"{_BUCKET} int").parquet(f"{self.path}/{folder}").groupBy(_BUCKET).count().collect()  # a row a bucket that is written
        for label, n in rows:
            path = f"{folder}/{_BUCKET}={label}"
            size = self._fs.getContentSummary(self._at(path)).getLength()
            layout.at(label)["segments"].append({"path": path, "rows": n, "bytes": size, "dead": 0, "vectors": []})

    def _kill(self, layout: Layout, name: str, touched: DataFrame, key: str) -> None:
        """Write the places of the rows of touched(key) as a deletion vector, of those segments alone that have any."""
        gone = touched.select(key).distinct()
        few = [r[0] for r in gone.limit(FEW_FILES + 1).collect()] if key == "file" else []
        if key == "file":  # a file tells its bucket, so other buckets aren't looked at
            labels = [r[0] for r in gone.select(layout.column()).distinct().collect()]
        else:
            labels = None
        segments = layout.segments(labels)
        if not segments:
            return
        schema = StructType.fromJson(json.loads(layout.schema))
        rows = self._placed(schema, segments)
        hit = rows.filter(F.col(key).isin(few)) if key == "file" and len(few) <= FEW_FILES else rows.join(gone, key, "left_semi")
        path = f"{name}/_dead-{uuid.uuid4().hex[:8]}"
        # the file's path ends in <write>/<bucket>/<file>, and the first two are its segment
        hit.select(F.substring_index("__file", "/", 2).alias("segment"), "__file", "__row").coalesce(max(1, len(segments) // 64)).write.parquet(f"{self.path}/{path}")
        counts = dict(self.spark.read.schema(_VECTOR).parquet(f"{self.path}/{path}").groupBy("segment").count().collect())  # a row a segment that is hit
        for label in list(layout.buckets) if labels is None else labels:
            for s in layout.buckets[label]["segments"]:
                if n := counts.get(s["path"].split("/", 1)[1]):
                    layout.at(label)
                    s["dead"] += n
                    s["vectors"] = [*s["vectors"], path]

    def _change(self, touched: DataFrame, key: str, new: DataFrame | None, marks: dict[str, int] | None = None) -> str:
        """Rows of touched(key) die and new ones come, as one commit."""

        def work(layout: Layout, name: str) -> bool:
            if new is not None:
                layout.schema = _merged(layout.schema, new.schema)
            self._kill(layout, name, touched, key)
            if new is not None:
                self._add(new, layout, name)
            return True

        return self._commit(work, marks)

    def _commit(self, work: Callable[[Layout, str], bool], marks: dict[str, int] | None = None) -> str | None:
        """Make a generation from the published one by work, and publish it; if others were faster, again from theirs."""
        for _ in range(ATTEMPTS):
            before = self.manifest()
            if before is None:
                raise FileNotFoundError(f"nothing is published in {self.path}")
            layout, name = self._layout(before["generation"]), _new_name()
            if not work(layout, name):
                return None
            self._put_layout(name, layout)
            try:
                self.publish(name, before["version"], marks)
                return name
            except (Conflict, Fenced) as e:
                self._fs.delete(self._at(name), True)
                if isinstance(e, Fenced):
                    raise
        raise Conflict(f"others publish all the time in {self.path}")

    def _active(self) -> str:
        found = (self.manifest() or {}).get("generation")
        if found is None:
            raise FileNotFoundError(f"nothing is published in {self.path}")
        return found

    # layouts

    def _layout(self, generation: str) -> Layout:
        top = self._get(f"{generation}/_map.json")
        pages = {int(k): v for k, v in top["pages"].items()}
        buckets = {int(k): b for path in pages.values() for k, b in self._get(path).items()}
        return Layout(top["schema"], buckets, pages)

    def _put_layout(self, generation: str, layout: Layout) -> None:
        """Write the pages that have changed, then the map: with it the generation exists."""
        for page in layout.changed:
            path = f"{generation}/_page-{page}-{uuid.uuid4().hex[:8]}.json"
            self._put(path, json.dumps({k: b for k, b in layout.buckets.items() if _numbers(k)[1] % PAGES == page}))
            layout.pages[page] = path
        layout.changed = set()
        self._put(f"{generation}/_map.json", json.dumps({"schema": layout.schema, "pages": layout.pages}))

    def own_buckets(self, generation: str) -> list[int]:
        """The buckets of which a generation has written segments itself; the others' are older."""
        return [b for b, found in self._layout(generation).buckets.items() if any(s["path"].startswith(f"{generation}/") for s in found["segments"])]

    def generations(self) -> DataFrame:
        """generation, modified_ms, active."""
        active = (self.manifest() or {}).get("generation")
        found = [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(self._at(".")) if s.isDirectory()] if self._fs.exists(self._at(".")) else []
        found = [(n, t) for n, t in found if n.startswith("chunks_") and self._fs.exists(self._at(f"{n}/_map.json"))]
        return self.spark.createDataFrame([(n, t, n == active) for n, t in found], "generation string, modified_ms long, active boolean")

    def collect_garbage(self, keep: int = KEEP, older_s: float = KEEP_S, now_ms: int | None = None) -> list[str]:
        """Drop inactive generations beyond the newest ``keep`` that are older than older_s, but for what a kept one uses.

        What failed commits left goes as well once it is older than KEEP_S.
        """
        now = now_ms or int(time.time() * 1000)
        every = [r["generation"] for r in self.generations().collect()]
        dropped = [r["generation"] for r in expired(self.generations(), keep, older_s, now).collect()]
        used: set[str] = set()
        for name in set(every) - set(dropped):
            layout = self._layout(name)
            used |= {*layout.pages.values(), *(s["path"] for s in layout.segments()), *(v for s in layout.segments() for v in s["vectors"])}
        lost = [s.getPath().getName() for s in self._fs.listStatus(self._at(".")) if s.isDirectory() and s.getModificationTime() < min(now, time.time() * 1000) - KEEP_S * 1000]
        for name in {*dropped, *(n for n in lost if n.startswith("chunks_") and n not in every)}:
            self._fs.delete(self._at(f"{name}/_map.json"), False)  # as a generation it is gone
            if not any(u.startswith(f"{name}/") for u in used):
                self._fs.delete(self._at(name), True)
                continue
            for first in self._names(name):
                inner = [f"{name}/{first}/{n}" for n in self._names(f"{name}/{first}")] if not first.startswith("_") else []
                for path in [p for p in (inner or [f"{name}/{first}"]) if p not in used]:
                    self._fs.delete(self._at(path), True)
        return dropped

    def stats(self) -> DataFrame:
        """One row: chunks, files."""
        return self.read().agg(F.count("*").alias("chunks"), F.countDistinct("file").alias("files"))

    # the writer's lock

    def _locks(self) -> list[int]:
        return sorted(int(n) for n in self._names("_lock") if n.isdigit())

    @contextmanager
    def lock(self, stale_s: float = 600.0):
        """One writer at a time; a lock that has not been renewed for stale_s is taken over.

        Locks are numbered, and the number is a fencing token: what is published under a lock fails once a newer lock is
        there, and letting go of a lock that was taken over frees nobody else's.
        """
        last = (self._locks() or [0])[-1]
        if last and not self._fs.exists(self._at(f"_lock/{last:012d}.free")):
            try:
                age = time.time() * 1000 - self._fs.getFileStatus(self._at(f"_lock/{last:012d}")).getModificationTime()
            except Py4JJavaError:  # its holder has let go meanwhile
                age = 0
            if age < stale_s * 1000:
                raise Locked(self.path)
        own = last + 1
        if not self._put_once(f"_lock/{own:012d}", json.dumps({"pid": os.getpid()})):
            raise Locked(self.path)
        for name in self._names("_lock"):
            if name.split(".")[0].isdigit() and int(name.split(".")[0]) < last:
                self._fs.delete(self._at(f"_lock/{name}"), False)
        before, self._token = self._token, own
        try:
            yield self
        finally:
            self._token = before
            self._put(f"_lock/{own:012d}.free", "")

    def renew(self) -> None:
        """Tell others that the lock is still in use; Fenced if it was taken over."""
        self._check_fence(self.manifest() or {})
        if self._token is not None:
            self._fs.setTimes(self._at(f"_lock/{self._token:012d}"), int(time.time() * 1000), -1)


def _depth_for(df: DataFrame) -> int:
    """Bits that keep buckets under half of what splits, by Spark's estimate of a table's size; an unknown one is told as the largest number."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return math.ceil(math.log2(max(2 * size / SPLIT_BYTES, 1))) if size < 1 << 60 else PAGE_BITS


def _merged(schema: str, other: StructType) -> str:
    """A schema with the further columns of another one."""
    own = StructType.fromJson(json.loads(schema))
    out = copy.deepcopy(own)
    for f in other:
        if f.name not in own.names:
            out.add(f.name, f.dataType, True)
    return out.json()


def check_schema(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SchemaMismatch(f"missing columns: {', '.join(missing)}")


def expired(generations: DataFrame, keep: int, older_s: float, now_ms: int) -> DataFrame:
    """generation of inactive ones beyond the newest ``keep`` and older than older_s; of ``keep`` rows the names alone are ordered."""
    inactive = generations.filter(~F.col("active"))
    newest = inactive.orderBy(F.col("modified_ms").desc(), "generation").limit(keep).select("generation")
    old = inactive.filter(F.col("modified_ms") < now_ms - int(older_s * 1000))
    return old.join(newest, "generation", "left_anti").select("generation")


def difference(now: DataFrame, before: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """key, status: added, removed, changed or unchanged, by a full outer join on the key."""
    a, b = now.select(key, F.col(mark).alias("m_now")), before.select(key, F.col(mark).alias("m_before"))
    status = F.when(F.col("m_before").isNull(), "added").when(F.col("m_now").isNull(), "removed").when(F.col("m_now") != F.col("m_before"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def file_difference(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, status of files(path, size, modified_ms, hash): equal size and time spare a look at the hash."""
    a = now.select("path", F.struct("size", "modified_ms").alias("q_now"), F.col("hash").alias("h_now"))
    b = before.select("path", F.struct("size", "modified_ms").alias("q_before"), F.col("hash").alias("h_before"))
    same = F.col("q_now").eqNullSafe(F.col("q_before")) | (F.col("h_now") == F.col("h_before"))
    status = F.when(F.col("h_before").isNull(), "added").when(F.col("h_now").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def plan(now: DataFrame, before: DataFrame, chunks: DataFrame, batch: int = 256) -> DataFrame:
    """One row: added, changed, removed, unchanged files, and for those to embed chunks, tokens and requests. chunks: file, content."""
    status = difference(now, before)
    counts = status.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed", "unchanged")))
    todo = chunks.join(status.filter(F.col("status").isin("added", "changed")).select(F.col("path").alias("file")), "file", "left_semi")
    work = todo.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.ceil(F.length("content") / 4)), F.lit(0)).alias("tokens"))
    return counts.join(work, how="cross").withColumn("requests", F.ceil(F.col("chunks") / batch))  # one row each


def universe(files: DataFrame, searched: DataFrame | None = None) -> DataFrame:
    """One row: files searched, chunks expected in all, files left out. files: path, chunks (number); searched: path, None for all."""
    marked = files.withColumn("__in", F.lit(1)) if searched is None else files.join(searched.select("path").distinct().withColumn("__in", F.lit(1)), "path", "left")
    return marked.agg(F.count("__in").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), (F.count("*") - F.count("__in")).alias("excluded"))


def cached_graph(store: Store, make) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the published generation: read from beside it, or made by make(rows) and written there once."""
    generation = store._active()
    out = []
    if not store._fs.exists(store._at(f"{generation}/_graph/edges/_SUCCESS")):
        nodes, edges = make(store.read(generation))[:2]
        nodes.write.mode("overwrite").parquet(f"{store.path}/{generation}/_graph/nodes")
        edges.write.mode("overwrite").parquet(f"{store.path}/{generation}/_graph/edges")
    for name in ("nodes", "edges"):
        out.append(store.spark.read.parquet(f"{store.path}/{generation}/_graph/{name}"))
    return out[0], out[1]


def missing_rows(documents: DataFrame, written: DataFrame, key: str = "id") -> DataFrame:
    """Documents that an interrupted build has not written yet."""
    return documents.join(written.select(key), key, "left_anti")


def freshness(now: DataFrame, before: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: counts of the difference, chunks expected and there, and whether both agree. before: path, hash, chunks (number)."""
    counts = difference(now, before).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "changed", "removed", "unchanged")))
    expected = before.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("expected")).join(chunks.agg(F.count("*").alias("there")), how="cross")
    return counts.join(expected, how="cross").withColumn("fresh", (F.col("added") + F.col("changed") + F.col("removed") == 0) & (F.col("expected") == F.col("there")))


def stale_warning(state: DataFrame, hint: str = "Index it again.") -> DataFrame:
    """freshness with stale and, if so, the warning that goes before an answer (null if not)."""
    stale = (F.col("added") + F.col("changed") + F.col("removed") > 0) | (F.col("expected") != F.col("there"))
    counts = F.format_string("changed=%d, missing=%d, removed=%d, chunkMismatch=%s", "changed", "added", "removed", (F.col("expected") != F.col("there")).cast("string"))
    text = F.concat(F.lit("Warning: index may be stale ("), counts, F.lit(f"). {hint}"))
    return state.withColumns({"stale": stale, "warning": F.when(stale, text)})


def checked_in_time(state: DataFrame, seconds: float = 2.0) -> dict:
    """The row of stale_warning as a dict with checked; if it takes longer, its jobs are cancelled and nothing is said to be stale.

    An answer must not wait for a look at all files, nor fail with it."""
    context = state.sparkSession.sparkContext
    tag = f"freshness-{uuid.uuid4().hex}"
    unknown = {"added": 0, "changed": 0, "removed": 0, "stale": False, "warning": None, "checked": False}

    def look() -> dict:
        context.addJobTag(tag)
        try:
            return state.first().asDict() | {"checked": True}
        finally:
            context.removeJobTag(tag)

    aside = ThreadPoolExecutor(1)
    try:
        return aside.submit(look).result(timeout=seconds)
    except TimeoutError:
        context.cancelJobsWithTag(tag)
        return unknown
    except PySparkException:
        return unknown
    finally:
        aside.shutdown(wait=False)
