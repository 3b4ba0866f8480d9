"""A file tree listed and read by the executors: no path of it is ever on the driver.

A folder is a row with the ignore files of the folders above it. A task walks a folder down for WALK entries, and folders
that it has not come to are the rows of the next round, dealt over all tasks; so a deep or a wide tree takes few rounds.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify
from quarry.operators.graph import written

IGNORE_FILES = (".gitignore", ".ignore", ".rgignore")
#: Entries that a task lists from one row before it hands the rest on; bytes of content that it holds at once.
WALK, HELD = 5000, 8 << 20
_RULES = "array<struct<folder:string,text:string>>"
_ENTRY = f"folder boolean, path string, size long, modified_ms long, rules {_RULES}"
_FIELDS = pa.schema([("folder", pa.bool_()), ("path", pa.string()), ("size", pa.int64()), ("modified_ms", pa.int64()), ("rules", pa.list_(pa.struct([("folder", pa.string()), ("text", pa.string())])))])


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root, for drivers and executors alike, and the root's path in it; ValueError if Python knows none."""
    try:
        return fs.FileSystem.from_uri(root) if ":/" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    except (OSError, ImportError, pa.ArrowException) as e:
        raise ValueError(f"no access to {root}") from e


@lru_cache(maxsize=1024)
def _compiled(rules: tuple[tuple[str, str], ...]) -> list[tuple[re.Pattern, bool]]:
    """Patterns of ignore files (folder, text), the outer ones first, and whether each leaves a path out."""
    out = []
    for folder, text in rules:
        for line in text.splitlines():
            rule = line.rstrip()
            if not rule or rule.startswith("#"):
                continue
            again, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
            only_folders, rule = rule.endswith("/"), rule.rstrip("/")
            anywhere = "(?:.*/)?" if "/" not in rule else ""
            out.append((re.compile((re.escape(folder) + "/" if folder else "") + anywhere + classify.glob_part(rule.removeprefix("/")) + ("/.*" if only_folders else "(?:/.*)?"), re.DOTALL), not again))
    return out


def ignored(path: str, rules: tuple[tuple[str, str], ...]) -> bool:
    """Whether ignore files leave out a path: the last rule that fits it or one of its folders counts."""
    for pattern, out in reversed(_compiled(rules)):
        if pattern.fullmatch(path):
            return out
    return False


def _children(system: fs.FileSystem, top: str, folder: str) -> list[fs.FileInfo]:
    at = f"{top}/{folder}" if folder else top
    return sorted(system.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda i: i.base_name)


def _loops(system: fs.FileSystem, at: str) -> bool:
    """Whether a folder is a link to one that it is in."""
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(at) and f"{os.path.realpath(os.path.dirname(at))}/".startswith(f"{os.path.realpath(at)}/")


def walked(system: fs.FileSystem, top: str, start: str, rules: tuple, hidden: bool, skip: frozenset[str], most: int = WALK) -> Iterator[tuple]:
    """Entries below a folder: files that no ignore file leaves out, and folders that are left for later."""
    todo, seen = deque([(start, rules)]), 0
    while todo:
        folder, above = todo.popleft()
        if seen >= most:
            yield True, folder, None, None, above
            continue
        children = _children(system, top, folder)
        seen += len(children) + 1
        texts = {i.base_name: system.open_input_stream(i.path).read().decode(errors="replace") for i in children if i.base_name in IGNORE_FILES and i.is_file}
        own = above + tuple((folder, texts[n]) for n in IGNORE_FILES if n in texts)
        for i in children:
            path = f"{folder}/{i.base_name}" if folder else i.base_name
            if i.base_name.startswith(".") and not hidden:
                continue
            if i.type == fs.FileType.Directory:
                if i.base_name not in skip and not _loops(system, i.path):
                    todo.append((path, own))
            elif i.is_file and not ignored(path, own):
                yield False, path, i.size, (i.mtime_ns or 0) // 1_000_000, ()


def listing(spark: SparkSession, root: str, hidden: bool = True, skip: tuple[str, ...] = (), walk: int = WALK) -> DataFrame:
    """path (relative to root), size, modified_ms of all files that no ignore file leaves out; links are followed but for those that lead back up.

    Folders with a name in ``skip`` aren't entered.
    """
    opened(root)
    names = frozenset(skip)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            for row in batch.to_pylist():
                rules = tuple((r["folder"], r["text"]) for r in row["rules"])
                held: list[tuple] = []
                for entry in walked(system, top, row["path"], rules, hidden, names, walk):
                    held.append(entry)
                    if len(held) == 10_000:
                        yield _entries(held)
                        held = []
                yield _entries(held)

    frontier, found = spark.createDataFrame([(True, "", None, None, [])], _ENTRY), []
    while True:
        out = written(frontier.repartition("path").mapInArrow(run, _ENTRY))
        found.append(out.filter("NOT folder").select("path", "size", "modified_ms"))
        frontier = out.filter("folder")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    rules = [[{"folder": f, "text": t} for f, t in r] for r in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns[:4], rules], _FIELDS, strict=True)], schema=_FIELDS)


def contents(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """files with the bytes of each as content; one that has gone meanwhile is left out."""
    at, schema = files.columns.index(path), files.select("*", F.lit(None).cast("binary").alias("content")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        for batch in batches:
            rows, data, size = [], [], 0
            for i, p in enumerate(batch.column(at).to_pylist()):
                try:
                    data.append(system.open_input_stream(f"{top}/{p}").read())
                except FileNotFoundError:
                    continue
                rows, size = [*rows, i], size + len(data[-1])
                if size >= HELD:
                    yield _with(batch, rows, data)
                    rows, data, size = [], [], 0
            yield _with(batch, rows, data)

    return files.mapInArrow(run, schema)


def _with(batch: pa.RecordBatch, rows: list[int], data: list[bytes]) -> pa.RecordBatch:
    part = batch.take(pa.array(rows, pa.int64()))
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])


def named(files: DataFrame, glob: str) -> DataFrame:
    """Files whose names fit a glob."""
    return files.filter(F.substring_index("path", "/", -1).rlike(fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$")))
