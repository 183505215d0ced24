"""Token streams of model generations: decoding, reassembly and stalls.

The batch forms below and the streaming forms share their expressions. Late-data policy of the streaming forms: a
ten-minute watermark; ``store_stream`` keeps what comes later in a side table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimweave.functions.ordering import block_of
from claimweave.functions.replies import kind, member, raw_string_field, strict_json
from claimweave.functions.text import none_if_empty, strip
from claimweave.session import passing, settle
from claimweave.sources.commits import Store
from claimweave.vocab import IDLE_SECONDS, PROGRESS_SECONDS

DELAY_SECONDS = 600
WATERMARK = f"{DELAY_SECONDS} seconds"
#: Deltas joined per block when a generation is reassembled.
DELTAS_PER_BLOCK = 10_000


def decode_lines(lines: DataFrame) -> DataFrame:
    """``data:`` lines as ``(gen_id, seq, id, model, content, reasoning, error, usage)``.

    Comments, end marks and broken JSON are skipped.
    """
    trimmed = strip(F.col("line"))
    payload = F.substring(trimmed, 7, F.length(trimmed))
    decoded = (
        lines.where(trimmed.startswith("data: ") & (payload != "[DONE]"))
        .withColumn("_json", strict_json(payload))
        .where(F.col("_json").isNotNull())
    )
    delta = F.try_variant_get("_json", "$.choices[0].delta", "variant")
    usage = member(F.col("_json"), "usage")
    error = member(F.col("_json"), "error")
    return decoded.select(
        "gen_id",
        "seq",
        none_if_empty(raw_string_field(F.col("_json"), "id")).alias("id"),
        none_if_empty(raw_string_field(F.col("_json"), "model")).alias("model"),
        none_if_empty(raw_string_field(delta, "content")).alias("content"),
        none_if_empty(raw_string_field(delta, "reasoning")).alias("reasoning"),
        F.when(_truthy(error), F.coalesce(raw_string_field(error, "message"), F.to_json(error))).alias("error"),
        F.when(kind(usage).startswith("OBJECT"), F.to_json(usage)).alias("usage"),
    )


def until_error(decoded: DataFrame) -> DataFrame:
    """Rows up to and with each generation's first error, which ends the call; later rows belong to no reply."""
    failed = decoded.where(F.col("error").isNotNull()).groupBy("gen_id").agg(F.min("seq").alias("_failed"))
    return decoded.join(failed, "gen_id", "left").where(F.col("_failed").isNull() | (F.col("seq") <= F.col("_failed"))).drop("_failed")


def _truthy(value: Column) -> Column:
    """Whether a JSON value is there and is not null, false, zero or an empty string."""
    return (kind(value) != "VOID") & ~F.coalesce(F.to_json(value).isin("false", "0", '""', "0.0"), F.lit(False))


def generation_facts(decoded: DataFrame) -> DataFrame:
    """Last id, model and usage of each generation, the first error, and the output sizes; an error ends a generation."""

    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("seq"))).alias(name)

    return until_error(decoded).groupBy("gen_id").agg(
        last("id"),
        last("model"),
        last("usage"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("error"),
        F.coalesce(F.sum(F.length("reasoning")), F.lit(0)).alias("reasoning_chars"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("content_chars"),
    )


def reassembled(deltas: DataFrame, width: int = DELTAS_PER_BLOCK) -> DataFrame:
    """``(gen_id, block, content, content_chars, reasoning_chars, empty)`` from ``deltas(gen_id, seq, ts, kind, delta)``.

    Content deltas are joined in ``seq`` order per block of ``width`` sequence numbers, so one endless generation does
    not end in one task; the blocks in order make the text. ``empty`` tells a generation without visible content.
    """
    said = F.col("kind") == "content"
    blocks = deltas.groupBy("gen_id", block_of(F.col("seq"), width).alias("block")).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.when(said, F.struct("seq", "delta"))))["delta"], ""
        ).alias("content"),
        F.sum(F.when(F.col("kind") == "reasoning", F.length("delta")).otherwise(0)).alias("reasoning_chars"),
    )
    visible = blocks.groupBy("gen_id").agg(F.bool_and(strip(F.col("content")) == "").alias("empty"))
    return blocks.withColumn("content_chars", F.length("content").cast("bigint")).join(visible, "gen_id")


def _points(deltas: DataFrame, calls: DataFrame, tokens_only: bool) -> DataFrame:
    """``(gen_id, ts)`` of what ends a silence: the call's start, its rows (or its tokens alone), and its end."""
    rows = deltas.where(F.col("kind") != "keepalive") if tokens_only else deltas
    marks = calls.select("gen_id", F.explode(F.array("started", "ended")).alias("ts")).where(F.col("ts").isNotNull())
    return rows.select("gen_id", "ts").unionByName(marks).withColumn("ts", F.col("ts").cast("timestamp"))


def silences(points: DataFrame, seconds: int) -> DataFrame:
    """Stretches of more than ``seconds`` between consecutive points: ``(gen_id, since, gap_seconds)``.

    Each point meets the previous one inside its own minute; the first of a minute meets the last point of the latest
    earlier minute that has any. A generation that fills the log is so sorted minute by minute instead of in one task.
    """
    dated = points.withColumn("_minute", F.floor(F.unix_micros("ts") / 60_000_000).cast("bigint"))
    in_minute = Window.partitionBy("gen_id", "_minute").orderBy("ts")
    ends = dated.groupBy("gen_id", "_minute").agg(F.max("ts").alias("_last"))
    # One row per generation and minute reaches this window.
    before = ends.select(
        "gen_id", "_minute", F.lag("_last").over(Window.partitionBy("gen_id").orderBy("_minute")).alias("_earlier")
    )
    chained = dated.withColumn("_previous", F.lag("ts").over(in_minute)).join(before, ["gen_id", "_minute"])
    previous = F.coalesce("_previous", "_earlier")
    gap = F.unix_micros("ts") - F.unix_micros(previous)
    return chained.where(gap > seconds * 1_000_000).select("gen_id", previous.alias("since"), (gap / 1_000_000).alias("gap_seconds"))


def idle_stalls(deltas: DataFrame, calls: DataFrame, seconds: int = IDLE_SECONDS) -> DataFrame:
    """Silences in which nothing at all arrived, before the first row and after the last one included.

    ``calls(gen_id, started, ended)``; ``ended`` is when the call was over or, for an open one, up to when the log is known.
    """
    return silences(_points(deltas, calls, tokens_only=False), seconds)


def progress_stalls(deltas: DataFrame, calls: DataFrame, seconds: int = PROGRESS_SECONDS) -> DataFrame:
    """Stretches without real tokens, keep-alives or not."""
    return silences(_points(deltas, calls, tokens_only=True), seconds)


def stall_reasons(deltas: DataFrame, calls: DataFrame, idle: int = IDLE_SECONDS, progress: int = PROGRESS_SECONDS) -> DataFrame:
    """``(gen_id, stalled_at, reason)``: when and why the first of the two watchdogs would have ended the generation."""

    def due(stalls: DataFrame, seconds: int, rank: int) -> DataFrame:
        at = F.timestamp_micros(F.unix_micros("since") + seconds * 1_000_000)
        return stalls.select("gen_id", F.struct(at.alias("at"), F.lit(rank).alias("rank")).alias("due"))

    first = (
        due(idle_stalls(deltas, calls, idle), idle, 0)
        .unionByName(due(progress_stalls(deltas, calls, progress), progress, 1))
        .groupBy("gen_id")
        .agg(F.min("due").alias("due"))
    )
    reason = F.when(F.col("due.rank") == 0, f"silent for {idle}s").otherwise(f"no tokens for {progress}s")
    return first.select("gen_id", F.col("due.at").alias("stalled_at"), reason.alias("reason"))


def stream_reassembled(deltas: DataFrame, width: int = DELTAS_PER_BLOCK, silence: int = IDLE_SECONDS) -> DataFrame:
    """Streaming reassembly: ``(gen_id, block, content, reasoning_chars, ended)`` in blocks of ``width`` sequence numbers.

    A block is emitted once nothing more came for ``silence`` seconds, after which the call counts as stalled; so a
    running generation is never cut by the clock, and state holds open blocks only. ``ended`` tells that the block
    has the generation's end mark (a row of kind ``end``).
    """
    said = F.col("kind") == "content"
    return (
        deltas.withWatermark("ts", WATERMARK)
        .groupBy("gen_id", block_of(F.col("seq"), width).alias("block"), F.session_window("ts", f"{silence} seconds"))
        .agg(
            F.array_join(F.array_sort(F.collect_list(F.when(said, F.struct("seq", "delta"))))["delta"], "").alias("content"),
            F.sum(F.when(F.col("kind") == "reasoning", F.length("delta")).otherwise(0)).alias("reasoning_chars"),
            F.bool_or(F.col("kind") == "end").alias("ended"),
        )
        .select("gen_id", "block", "content", "reasoning_chars", "ended")
    )


def stream_activity(deltas: DataFrame, seconds: int = IDLE_SECONDS, progress_only: bool = False) -> DataFrame:
    """Streaming stall detection: each stretch of activity that ended in ``seconds`` of silence without an end mark."""
    rows = deltas.where(F.col("kind") != "keepalive") if progress_only else deltas
    return (
        rows.withWatermark("ts", WATERMARK)
        .groupBy("gen_id", F.session_window("ts", f"{seconds} seconds"))
        .agg(F.count(F.lit(1)).alias("deltas"), F.bool_or(F.col("kind") == "end").alias("_ended"))
        .where(~F.col("_ended"))
        .select("gen_id", F.col("session_window.start").alias("active_from"), F.col("session_window.end").alias("stalled_at"), "deltas")
    )


def watermark(store: Store, delay_seconds: int) -> int | None:
    """Microseconds up to which rows count as late: ``delay_seconds`` before the latest time of all committed batches."""
    if store.is_empty():
        return None
    high = store.batches().agg(F.max(F.get_json_object("manifest", "$.high").cast("long"))).first()[0]
    return None if high is None else high - delay_seconds * 1_000_000


def store_stream(deltas: DataFrame, out: str, checkpoint: str, delay_seconds: int = DELAY_SECONDS) -> DataStreamWriter:
    """Append delivered rows to the tables ``deltas`` and ``late`` of a ``Store``.

    A row older than the watermark of the batches committed before its own is late; it, and a row without a time, goes to the side
    table and nowhere else. The watermark is read from the batches' markers, so a retried batch is split as it was before, and
    one whose marker exists is not written again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        store = Store(batch.sparkSession, out)
        if store.committed(batch_id):
            return
        with passing(batch.sparkSession):
            rows = settle(batch, "delivered")
            mark = watermark(store, delay_seconds)
            us = F.unix_micros(F.col("ts").cast("timestamp"))
            late = us.isNull() | (us < mark if mark is not None else F.lit(False))
            high = rows.agg(F.max(us)).first()[0]
            store.write(batch_id, {"deltas": rows.where(~late), "late": rows.where(late)}, high=high)

    return deltas.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
