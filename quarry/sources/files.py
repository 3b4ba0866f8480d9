"""Sources: file trees, test tables as files, changed files, configuration."""

from __future__ import annotations

import json
import os
import re
import subprocess
from dataclasses import dataclass, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import classify
from quarry.sources import tree


def file_tree(spark: SparkSession, root: str, glob: str | None = None, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), hidden: bool = True) -> DataFrame:
    """path, size, modified_ms, text of readable files under root that aren't ignored; paths are relative to root.

    Folders are listed and files read by the executors, on every file system that Python reaches from them; on others
    Spark lists the tree, without files whose names begin with a dot or an underscore. Ignored are fixed folders and
    globs and what the rules in .gitignore, .ignore and .rgignore files say; what is ignored isn't read. ``include``
    overrides the fixed ones only; without ``hidden`` files and folders are left out whose names begin with a dot.
    """
    try:
        tree.opened(root)
    except ValueError:
        return _listed_by_spark(spark, root, glob, include, exclude)
    found = tree.listing(spark, root, hidden, () if include else classify.IGNORED_FOLDERS)
    found = tree.named(found, glob) if glob else found
    kept = found.filter((F.col("size") <= classify.MAX_BYTES) & ~classify.is_ignored(F.col("path"), include, exclude))
    text = tree.contents(kept.repartition(F.col("path")), root).select("path", "size", "modified_ms", F.col("content").cast("string").alias("text"))
    return text.filter(classify.is_readable(F.col("path"), F.col("text")))


def _listed_by_spark(spark: SparkSession, root: str, glob: str | None, include: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    top = "/" + root.split(":", 1)[-1].strip("/")
    relative = F.substring(full, F.lit(len(top) + 2), F.length(full))
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(root).select(F.col("path").alias("at"), relative.alias("path"), "length")
    listed = listed.filter((F.col("length") <= classify.MAX_BYTES) & ~classify.is_ignored(F.col("path"), include, exclude))
    folders = [r[0] for r in listed.select(F.regexp_replace("path", "/?[^/]*$", "")).distinct().collect()]
    kept = listed.filter(~ignored_by(F.col("path"), ignore_files(spark, root, folders)))
    paths = [r["at"] for r in kept.select("at").collect()]  # names alone, as Spark's own listing has them on the driver
    if not paths:
        return spark.createDataFrame([], "path string, size long, modified_ms long, text string")
    raw = spark.read.format("binaryFile").load([p.replace("{", "?").replace("[", "?").replace("*", "?") for p in paths])
    text = raw.select(relative.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_ms"), F.col("content").cast("string").alias("text"))
    text = text.join(kept.select("path"), "path", "left_semi")  # a name with a question mark may have brought in others
    return text.dropDuplicates(["path"]).filter(classify.is_readable(F.col("path"), F.col("text")))


def ignore_files(spark: SparkSession, root: str, folders: list[str]) -> list[tuple[str, str]]:
    """(folder, text) of the ignore files in folders below root and in those above them, outer ones first."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    above = {"/".join(f.split("/")[:n]) for f in folders for n in range(f.count("/") + 2)} | {""}
    out = []
    for folder in sorted(above, key=lambda f: (f.count("/") + bool(f), f)):
        for name in (".gitignore", ".ignore", ".rgignore"):
            at = jvm.org.apache.hadoop.fs.Path("/".join(x for x in (root.rstrip("/"), folder, name) if x))
            if fs.exists(at):
                stream = fs.open(at)
                out.append((folder, jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
    return out


def ignored_by(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether ignore files (folder, text), the outer ones first, leave out a path: the last rule that fits it or one of
    its folders counts, and one with a ! takes it in again."""
    out = F.lit(False)
    for folder, text in rules:
        for line in text.splitlines():
            rule = line.rstrip()
            if not rule or rule.startswith("#"):
                continue
            again, rule = rule.startswith("!"), rule.removeprefix("!").removeprefix("\\")
            only_folders, rule = rule.endswith("/"), rule.rstrip("/")
            anywhere = "/" not in rule
            pattern = "^" + (re.escape(folder) + "/" if folder else "") + ("(?:.*/)?" if anywhere else "") + classify.glob_part(rule.removeprefix("/")) + ("/.*" if only_folders else "(?:/.*)?") + "$"
            out = F.when(path.rlike(pattern), F.lit(not again)).otherwise(out)
    return out


def union_of(*parts: DataFrame) -> DataFrame:
    """Distinct rows of all parts, which have the same columns."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def indexable(files: DataFrame, include_docs: bool = False, include_config: bool = False, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), readable: Column | None = None) -> DataFrame:
    """files(path, text) that are to be indexed, with language, kind and role. readable: which texts may be, if another rule than is_readable's holds."""
    p = F.col("path")
    readable = classify.is_readable(p, F.col("text")) if readable is None else readable
    kept = files.filter(classify.should_index(p, include_docs, include_config) & ~classify.is_ignored(p, include, exclude) & readable)
    return kept.withColumns({"language": classify.language(p), "kind": classify.file_kind(p), "role": classify.file_role(p)})


def documents_as_files(documents: DataFrame) -> DataFrame:
    """The test table as files: path is source/doc_id.txt, language is lang."""
    return documents.select(F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text", F.col("lang").alias("language"), "doc_id", "source")


def changed_files(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """path of files that differ from base, that are changed and that are new, of the git work tree at root; distinct."""
    commands = [["diff", "--name-only", "--diff-filter=ACMR", "HEAD"], ["ls-files", "--others", "--exclude-standard"]]
    if base:
        commands.insert(0, ["diff", "--name-only", "--diff-filter=ACMR", f"{base}...HEAD"])
    found: set[str] = set()
    for c in commands:
        said = subprocess.run(["git", "-C", root, *c], capture_output=True, text=True, check=True)
        found.update(line for line in said.stdout.splitlines() if line)
    return spark.createDataFrame([(p,) for p in sorted(found)], "path string")


@dataclass(frozen=True)
class Config:
    """How to embed and what to index; later sources override earlier ones."""

    provider: str = "hashing"
    model: str = "feature-hashing"
    dimension: int = 64
    max_input_tokens: int | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_docs: bool = False
    include_config: bool = False

    @classmethod
    def load(cls, root: str, name: str = ".quarryrc.json", prefix: str = "QUARRY_", **flags) -> Config:
        """The file, then the environment, then flags; unknown keys and nulls are passed over."""
        found = cls()
        path = Path(root) / name
        known = cls.__dataclass_fields__
        layers = [json.loads(path.read_text()) if path.is_file() else {}, {k: os.environ[e] for k in known if (e := prefix + k.upper()) in os.environ}, flags]
        for layer in layers:
            found = replace(found, **{k: cls._typed(k, v) for k, v in layer.items() if k in known and v is not None})
        return found

    @staticmethod
    def _typed(key: str, value):
        if key in ("dimension", "max_input_tokens"):
            return int(value)
        if key.startswith("include_"):
            return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes")
        if key in ("include", "exclude"):
            return tuple(value.split(",")) if isinstance(value, str) else tuple(value)
        return value
