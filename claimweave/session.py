"""Session settings the operators rely on, and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings that change results or keep skewed joins alive. All of them can be set on a live session.
RUNTIME_CONF = {
    # Replies may repeat a JSON key; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    # One graph may hold a third of all rows: let AQE split such partitions even when a later
    # operator then needs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Have a runtime setting inside the block only."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Where none is configured, a local session gets a temporary one, deleted when Python ends; on a cluster that
    would be a different disk for every executor, so it is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="claimweave-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder


_open = threading.local()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Delete the tables settled inside when the block ends: for work that writes its results, such as a micro-batch."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        yield
    finally:
        for path in _open.paths:
            _delete(spark, path)
        _open.paths = outer


def last_settled(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, the table it settles last; all tables it settles before that are deleted."""
    outer, _open.paths = getattr(_open, "paths", None), []
    try:
        out = build()
        last = _open.paths.pop()
        if outer is not None:
            outer.append(last)
        return out
    finally:
        for path in _open.paths:
            _delete(spark, path)
        _open.paths = outer


def release(spark: SparkSession) -> None:
    """Delete every table this application settled; no DataFrame that reads one can be used afterwards."""
    _delete(spark, os.path.join(shared_dir(spark), "claimweave", spark.sparkContext.applicationId))


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a table feeds several branches or an iteration: the lineage ends at files that outlive a lost
    executor, and as parquet the readers still prune columns and push filters down. Tables lie in one folder per
    application, deleted by ``release``, or earlier if settled inside ``passing`` or ``last_settled``. The shuffle files of the write go as
    soon as it has succeeded, not when the driver next happens to collect its garbage.
    """
    spark = df.sparkSession
    path = os.path.join(
        shared_dir(spark), "claimweave", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}"
    )
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
