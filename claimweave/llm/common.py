"""Small helpers of the package: session, tables, Arrow batches and compressed texts."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, suppress

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from claimweave.session import configure, last_settled, setting, settle

#: A sortable stand-in for a missing document id: it comes before every other.
NO_ID = -(2**63)
#: Bytes of text that a worker holds at once.
HELD_BYTES = 8 << 20

_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Apply the library's settings and give the executors' Python workers this package, once per application."""
    configure(spark)
    if spark.sparkContext.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(), "claimweave_workers.zip")  # read by the driver alone, which serves it
        with zipfile.ZipFile(archive, "w") as target:
            for folder, _, names in sorted(os.walk(package)):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        target.write(path, os.path.relpath(path, os.path.dirname(package)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(spark.sparkContext.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes() -> Column:
    """The text column as UTF-8; a null text is empty."""
    return F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")


def mapped(df: DataFrame, step: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """``mapInArrow`` with a step from one batch to column dictionaries; at the end of each task ``done`` is called and memory given back."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in step(batch):
                yield record_batch(columns, names)
        if done is not None:
            done()

    return df.mapInArrow(releasing(run), schema)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with its memory given back when the task's rows have been read."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole


def release_memory() -> None:
    """Give what a task has freed back to the system: a worker lives on, idle or in other stages, with all it keeps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def record_batch(columns: dict, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[name]) if not isinstance(columns[name], pa.Array) else columns[name] for name in names], names)


def small_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """Send at most ``rows`` rows at once to Python workers in what runs inside: for rows that are large themselves."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def chosen_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the ids and text hashes in ``wanted(wanted_id, wanted_hash, copies)``, each once, with all columns.

    Rows are found again by narrow columns, so that texts are neither read by Python workers again nor moved twice.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_, text = (f"c{docs.columns.index(name)}" for name in ("doc_id", "text"))
    every = docs.toDF(*names)

    def found(which: DataFrame) -> DataFrame:
        return every.join(which, F.col(id_).eqNullSafe(F.col("wanted_id")) & (F.xxhash64(text) == F.col("wanted_hash")), "left_semi")

    single = found(wanted.where("copies = 1"))
    several = found(wanted.where("copies > 1")).dropDuplicates([id_, text])
    return single.unionByName(several).toDF(*docs.columns)


_packers: dict[str, zstandard.ZstdCompressor | zstandard.ZstdDecompressor] = {}  # made once a process; a new one costs more than a small piece


def squeeze(data: bytes) -> bytes:
    """Compressed bytes; texts cross a shuffle in this form."""
    if "in" not in _packers:
        _packers["in"] = zstandard.ZstdCompressor(level=1)
    return _packers["in"].compress(data)


def expand(data: bytes) -> bytes:
    if "out" not in _packers:
        _packers["out"] = zstandard.ZstdDecompressor()
    return _packers["out"].decompress(data)


__all__ = ["HELD_BYTES", "NO_ID", "chosen_rows", "expand", "last_settled", "mapped", "ready", "record_batch", "release_memory", "releasing", "settle", "small_batches", "squeeze", "table", "text_bytes"]
