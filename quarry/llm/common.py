"""What the operators of this package share: shared storage, Arrow batches and plain hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarry.operators.graph import gone_at_exit

#: White space of the word definition used throughout: blank and the five ASCII controls.
SPACE = r"\x20\x09-\x0D"
#: Rows and bytes of text that are handled at once in Python.
SLICE_ROWS, SLICE_BYTES = 2048, 4 << 20
#: Rows that Spark hands to Python at once, instead of its 10,000: texts are long.
ARROW_ROWS = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master one of our own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.conf.get("spark.quarry.own.dir", None)
        if path is None:
            path = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            spark.conf.set("spark.quarry.own.dir", path)
    return f"{path.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # nobody looks for the mark
    gone_at_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def clean_shared(spark: SparkSession) -> None:
    """Remove every table that this application stored, once the results have been written; at its end it does so by itself."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one slice holds few bytes of text; a single long text stays whole."""
    for batch in batches:
        lengths = np.asarray(
            pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        )
        at, n = 0, batch.num_rows
        ends = np.cumsum(lengths)
        while at < n:
            before = ends[at - 1] if at else 0
            end = int(np.searchsorted(ends, before + most, side="right"))
            end = min(max(end, at + 1), at + SLICE_ROWS, n)
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(text).to_pylist()]


def map_batches(
    df: DataFrame, columns: list[str], make: Callable[[pa.RecordBatch], dict | None], schema: str, most: int = SLICE_BYTES
) -> DataFrame:
    """mapInArrow over df's columns, slice by slice; make returns arrays by name in the order of schema."""
    fields = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=most):
            out = make(part)
            if out is not None:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for x, f in zip(out.values(), fields, strict=True)],
                    schema=fields,
                )

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift) on unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once an application, so that workers need no copy of their own."""
    app = spark.sparkContext.applicationId
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # unless set otherwise
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="quarry-")  # of code alone; Spark serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = Path(folder) / "quarry.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((top / "quarry").rglob("*.py")):
            z.write(f, f.relative_to(top))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


_held: dict[str, object] = {}


def held(name: str, build: Callable[[], object]) -> object:
    """A worker's state from task to task: only the operator that ran last keeps any, so that memory is not taken twice."""
    if name not in _held:
        if _held:
            _held.clear()
            _give_back()
        _held[name] = build()
    return _held[name]


def _give_back() -> None:
    """Hand freed memory back to the system, which allocators otherwise keep for a worker's life."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
