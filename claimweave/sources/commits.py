"""Append-only tables in committed batches.

A batch writes one folder per table, ``<table>/batch=<name>``, and then one marker, ``commits/<name>``, that makes all of them
visible at once. A batch that is written again before its marker exists replaces what a lost attempt left; one whose marker exists
is not written again. So a retry, a restart or a second run with the same name never doubles rows, and readers see whole batches.
The marker is a manifest: the rows of each table and whatever else the writer notes.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SAFE = re.compile(r"[A-Za-z0-9._-]+")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    @cached_property
    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def committed(self, batch: str | int) -> bool:
        return self._files.exists(self._path("commits", str(batch)))

    def write(self, batch: str | int, tables: dict[str, DataFrame], **notes) -> bool:
        """Write and commit a batch; False if it was committed before."""
        name = str(batch)
        if not _SAFE.fullmatch(name) or name.startswith((".", "_")):
            raise ValueError(f"not a batch name: {name!r}")
        if self.committed(name):
            return False
        rows = {}
        for table, df in tables.items():
            target = f"{self.root}/{table}/batch={name}"
            df.write.mode("overwrite").parquet(target)
            rows[table] = self.spark.read.schema(df.schema).parquet(target).count()  # from the files' footers
        self._publish(name, json.dumps({"batch": name, "rows": rows, **notes}, sort_keys=True))
        return True

    def _publish(self, name: str, manifest: str) -> None:
        """The marker appears whole: it is written under another name and renamed."""
        draft = self._path("drafts", f"{name}-{uuid.uuid4().hex}")
        out = self._files.create(draft)
        out.write(bytearray(manifest.encode()))
        out.close()
        self._files.mkdirs(self._path("commits"))
        self._files.rename(draft, self._path("commits", name))

    def batches(self) -> DataFrame:
        """``(batch, manifest)`` of every committed batch."""
        self._files.mkdirs(self._path("commits"))
        read = self.spark.read.schema("value string").format("text").option("wholetext", True).load(f"{self.root}/commits")
        return read.select(F.get_json_object("value", "$.batch").alias("batch"), F.col("value").alias("manifest"))

    def is_empty(self) -> bool:
        path = self._path("commits")
        return not self._files.exists(path) or not len(self._files.listStatus(path))

    def read(self, table: str) -> DataFrame:
        """The rows of ``table`` from committed batches, with ``batch`` as text. At least one must have been committed."""
        rows = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(f"{self.root}/{table}/batch=*")
        rows = rows.withColumn("batch", F.col("batch").cast("string"))
        return rows.join(self.batches().select("batch"), "batch", "left_semi")
