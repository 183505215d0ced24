"""Stalled calls as they happen: one state per open call, with a timer on event time.

The timer stands at the moment at which the first of the two watchdogs would end the call. It fires when the stream's watermark
passes it, so a call that falls silent is reported without another row of its own, before its first row and after its last one.
The rule is that of ``deltas.stall_reasons``: a replayed log gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from claimweave.streaming.deltas import WATERMARK
from claimweave.vocab import IDLE_SECONDS, PROGRESS_SECONDS

#: How long a call that ended or was reported is remembered, so that its stragglers open no new one.
REMEMBERED_SECONDS = 3600

RESULT = "gen_id long, stalled_at timestamp, reason string"
_STATE = "any long, token long, over boolean, times array<long>, tokens array<boolean>, ends array<boolean>"


def call_events(deltas: DataFrame, calls: DataFrame) -> DataFrame:
    """``(gen_id, ts, kind)``: the rows of the calls, and their starts and ends, as one stream."""
    marks = calls.select(
        "gen_id", F.explode(F.array(F.struct(F.col("started").alias("ts"), F.lit("start").alias("kind")),
                                    F.struct(F.col("ended").alias("ts"), F.lit("over").alias("kind")))).alias("mark")
    )
    rows = deltas.select("gen_id", F.col("ts").cast("timestamp").alias("ts"), "kind")
    return rows.unionByName(marks.select("gen_id", F.col("mark.ts").cast("timestamp").alias("ts"), "mark.kind").where("ts is not null"))


class Call:
    """What is known of one call, in microseconds: its last row, its last real token, and rows that may still be reordered."""

    def __init__(self, idle: int, progress: int, state: tuple | None):
        self.idle, self.progress = idle * 1_000_000, progress * 1_000_000
        self.any, self.token, self.over, times, tokens, ends = state or (None, None, False, [], [], [])
        self.waiting = list(zip(times, tokens, ends))

    def due(self) -> tuple[int, bool] | None:
        """When the first watchdog ends the call if nothing more comes, and whether it is the one on progress."""
        if self.any is None:
            return None
        silent = (self.any + self.idle, False)
        return silent if self.token is None else min(silent, (self.token + self.progress, True))

    def advance(self, until: int) -> tuple[int, bool] | None:
        """Take the waiting rows up to the watermark in order; the stall, if there is one before it."""
        self.waiting.sort()
        while self.waiting and self.waiting[0][0] <= until:
            at, token, ends = self.waiting.pop(0)
            due = self.due()
            if due and at > due[0]:
                return due
            self.any = at
            if token:
                self.token = at
            if ends:
                self.over = True
                return None
        due = self.due()
        return due if due and until > due[0] else None

    def state(self) -> tuple:
        return (self.any, self.token, self.over, *(list(part) for part in (zip(*self.waiting) if self.waiting else ([], [], []))))


def _watch(idle: int, progress: int):
    reasons = {False: f"silent for {idle}s", True: f"no tokens for {progress}s"}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut and state.exists and state.get[2]:
            state.remove()
            return
        call = Call(idle, progress, state.get if state.exists else None)
        if not call.over:
            for batch in batches if not state.hasTimedOut else ():
                # An end mark in the rows says that the text is over; the call itself is over with its own mark.
                call.waiting += zip(batch["us"].tolist(), (~batch["kind"].isin(["keepalive"])).tolist(), (batch["kind"] == "over").tolist())
            mark = state.getCurrentWatermarkMs() * 1000
            stalled = call.advance(mark)
            if stalled:
                call.over, call.waiting = True, []
                yield pd.DataFrame({"gen_id": [key[0]], "stalled_at": [pd.Timestamp(stalled[0], unit="us")], "reason": [reasons[stalled[1]]]})
        now = max(0, state.getCurrentWatermarkMs())
        if call.over:
            call.waiting = []
            wake = now + REMEMBERED_SECONDS * 1000
        else:
            # At the deadline, or as soon as the first waiting row is safe.
            due = [call.due()[0]] if call.any is not None else []
            wake = max(now + 1, min(due + [row[0] for row in call.waiting[:1]]) // 1000)
        state.update(call.state())
        state.setTimeoutTimestamp(wake)

    return step


def stalled_calls(events: DataFrame, idle: int = IDLE_SECONDS, progress: int = PROGRESS_SECONDS, delay: str = WATERMARK) -> DataFrame:
    """``(gen_id, stalled_at, reason)`` of each call that a watchdog ends, from a stream ``events(gen_id, ts, kind)``.

    Kinds are those of the rows (``content``, ``reasoning``, ``keepalive``, ``end``), ``start`` for the begin of a call and
    ``over`` for its end. Rows may come out of order by ``delay``. State holds, for each open call, two times and the rows
    that the watermark has not passed yet; calls that are over are forgotten an hour later.
    """
    rows = events.where(F.col("gen_id").isNotNull() & F.col("ts").isNotNull()).select(
        F.col("gen_id").cast("long").alias("gen_id"), "ts", F.coalesce("kind", F.lit("")).alias("kind"), F.unix_micros("ts").alias("us")
    )
    return (
        rows.withWatermark("ts", delay)
        .groupBy("gen_id")
        .applyInPandasWithState(_watch(idle, progress), RESULT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
