"""Logs of model calls: outcomes, the winning attempt, models, cost and failures.

``attempts(graph_id, attempt, content, asked, model, status, usage)``, one row per call; ``usage`` is JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.functions.replies import kind, member, strict_json
from claimweave.functions.text import none_if_empty, strip
from claimweave.operators.replies import parse_graphs

NO_GRAPH = "no usable graph in the reply"


def retryable(status: Column) -> Column:
    """Timeouts, rate limits, server errors and dropped connections are worth another call."""
    return status.isin(0, 408, 429) | status.between(500, 599)


def same_model(asked: Column, answered: Column) -> Column:
    """Base names before the first colon agree; an unnamed answer passes."""
    base = lambda name: F.split(name, ":")[0]
    return (F.coalesce(answered, F.lit("")) == "") | (base(asked) == base(answered))


def with_outcome(attempts: DataFrame) -> DataFrame:
    """Add ``outcome`` (the failure reason, or ``ok``) and ``retry``, the judgement of the transport.

    Order: stall, dropped connection, HTTP error, error inside the stream, empty content, another model.
    ``stall`` and ``stream_error`` columns are used when present.
    """
    stall = F.col("stall") if "stall" in attempts.columns else F.lit(None).cast("string")
    stream_error = F.col("stream_error") if "stream_error" in attempts.columns else F.lit(None).cast("string")
    empty = F.coalesce(strip(F.col("content")), F.lit("")) == ""
    mismatch = F.concat(F.lit("answered by "), "model", F.lit(" instead of "), "asked")
    outcome = (
        F.when(stall.isNotNull(), stall)
        .when(F.col("status") == 0, "no connection")
        .when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string")))
        .when(stream_error.isNotNull(), F.concat(F.lit("error in the stream: "), F.substring(stream_error, 1, 200)))
        .when(empty, "blank reply")
        .when(~same_model(F.col("asked"), F.col("model")), mismatch)
        .otherwise("ok")
    )
    # Failures found inside a 200 response count as a bad gateway, except a wrong model, which is final.
    effective = (
        F.when(stall.isNotNull(), 408)
        .when(F.col("status").between(200, 299) & (stream_error.isNotNull() | empty), 502)
        .otherwise(F.col("status"))
    )
    return attempts.withColumn("outcome", outcome).withColumn("retry", (F.col("outcome") != "ok") & retryable(effective))


def outcome_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("retry").alias("retryable"))


def resolved(attempts: DataFrame, max_replies: int = 3, max_calls: int = 5) -> DataFrame:
    """The calls that count, with ``parse``, ``parsed`` and ``winner``.

    A graph's calls stop at the first reply that parses, after ``max_replies`` replies, at the first final failure,
    and after ``max_calls`` failures in a row. Only the order of the attempt numbers counts: they may start anywhere
    and leave gaps.
    """
    judged = parse_graphs(with_outcome(attempts))
    replied = F.col("outcome") == "ok"
    usable = replied & (F.col("parse") != "none")
    by_attempt = Window.partitionBy("graph_id").orderBy("attempt")
    in_a_row = Window.partitionBy("graph_id", "_replies").orderBy("attempt")
    counted = judged.withColumn("_replies", F.sum(replied.cast("int")).over(by_attempt)).withColumn(
        "_failures", F.sum((~replied).cast("int")).over(in_a_row)
    )
    stop = (
        usable
        | (replied & (F.col("_replies") == max_replies))
        | (~replied & (~F.col("retry") | (F.col("_failures") == max_calls)))
    )
    return (
        counted.withColumn("_stop", F.min(F.when(stop, F.col("attempt"))).over(Window.partitionBy("graph_id")))
        .where(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop")))
        .withColumn("winner", usable)
        .drop("_stop", "_replies", "_failures")
    )


def winners(calls: DataFrame) -> DataFrame:
    return calls.where("winner").drop("winner")


def models_by_first_use(calls: DataFrame) -> DataFrame:
    """``(graph_id, use_no, model)``: models that answered, in order of first use. Unnamed answers count as asked."""
    answered = calls.where(F.col("outcome") == "ok").withColumn("model", F.coalesce(none_if_empty(F.col("model")), "asked"))
    first = answered.groupBy("graph_id", "model").agg(F.min("attempt").alias("_first"))
    order = Window.partitionBy("graph_id").orderBy("_first")
    return first.select("graph_id", (F.row_number().over(order) - 1).cast("bigint").alias("use_no"), "model")


def cost_receipts(calls: DataFrame) -> DataFrame:
    """Replies with a usage receipt, summed numeric cost and a warning when it was not free.

    Cost values that are not numbers count zero.
    """
    calls = calls.withColumn("usage", F.when(F.col("outcome") == "ok", F.col("usage")))
    cost = member(strict_json(F.col("usage")), "cost")
    numeric = kind(cost).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    spent = F.coalesce(F.when(numeric, F.try_variant_get(cost, "$", "double")), F.lit(0.0))
    return (
        calls.withColumn("_spent", spent)
        .groupBy("graph_id")
        .agg(F.count("usage").alias("calls"), F.sum("_spent").alias("cost"))
        .withColumn("billed", F.col("cost") > 0)
    )


def failures(requests: DataFrame, calls: DataFrame) -> DataFrame:
    """Requested graphs without a usable reply, and the last reason (at most 300 characters)."""
    reason = F.when(F.col("outcome") == "ok", NO_GRAPH).otherwise(F.substring("outcome", 1, 300))
    last = calls.groupBy("graph_id").agg(F.max_by(reason, "attempt").alias("_why"))
    return (
        requests.select("graph_id").distinct()
        .join(winners(calls).select("graph_id"), "graph_id", "left_anti")
        .join(last, "graph_id", "left")
        .select("graph_id", F.coalesce("_why", F.lit("unknown")).alias("why"))
    )
