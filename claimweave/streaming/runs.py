"""Run-event logs: newline-delimited JSON with status, ping, result and error events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.replies import is_object, member, raw_string_field, strict_json
from claimweave.functions.text import none_if_empty, strip

ENDED_EARLY = "the log ends without a result"
FAILED = "failed without a message"


def read_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Log files as ``(run_id, seq, line)``; the run is the file's base name, ``seq`` the number of the line.

    A file holds one run, which its time cap keeps small, so it is read as a whole and split here.
    """
    reader = spark.readStream if streaming else spark.read
    run = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]+)?$", 1)
    files = reader.format("text").option("wholetext", True).load(path).select(run.alias("run_id"), F.split("value", r"\r?\n").alias("_lines"))
    return files.select("run_id", F.posexplode("_lines").alias("seq", "line")).withColumn("seq", F.col("seq").cast("bigint"))


def run_events(log: DataFrame) -> DataFrame:
    """``(run_id, seq, type, message, data)``; blank and unparsable lines are skipped."""
    parsed = log.withColumn("_json", strict_json(strip(F.col("line")))).where(is_object(F.col("_json")))
    data = member(F.col("_json"), "data")
    return parsed.select(
        "run_id",
        "seq",
        raw_string_field(F.col("_json"), "type").alias("type"),
        none_if_empty(raw_string_field(F.col("_json"), "message")).alias("message"),
        F.when(is_object(data), F.to_json(data)).alias("data"),
    )


def latest_status(events: DataFrame) -> DataFrame:
    """The last status message of each run. Works on batch and, in update mode, on streaming input."""
    told = events.where((F.col("type") == "status") & F.col("message").isNotNull())
    return told.groupBy("run_id").agg(F.max_by("message", "seq").alias("status"))


def run_results(events: DataFrame) -> DataFrame:
    """``(run_id, state, error, data)``: the last error wins over any result; neither means the run ended early."""
    error = F.when(F.col("type") == "error", F.coalesce("message", F.lit(FAILED)))
    data = F.when(F.col("type") == "result", F.col("data"))
    seq = F.col("seq")
    outcome = events.groupBy("run_id").agg(
        F.max_by(error, F.when(error.isNotNull(), seq)).alias("_error"),
        F.max_by(data, F.when(data.isNotNull(), seq)).alias("_data"),
    )
    failed, finished = F.col("_error").isNotNull(), F.col("_data").isNotNull()
    return outcome.select(
        "run_id",
        F.when(failed, "error").when(finished, "result").otherwise("ended early").alias("state"),
        F.when(failed, F.col("_error")).when(~finished, ENDED_EARLY).alias("error"),
        F.when(~failed, F.col("_data")).alias("data"),
    )
