"""Stalls found by timers equal those of the batch rule, and late rows go to the side table alone."""

import random

from claimweave.sources.commits import Store
from claimweave.streaming import deltas, watchdogs

EVENTS = "gen_id long, ts timestamp, kind string"
START = 1_000_000  # a stream drops rows up to its first watermark, the epoch


def replayed(spark, tmp_path, batches, name, idle=120, progress=240, delay="60 seconds"):
    source = str(tmp_path / "events")
    for batch in batches:
        frame = spark.createDataFrame(batch, "gen_id long, s double, kind string")
        frame.selectExpr("gen_id", f"timestamp_micros(cast(round((s + {START}) * 1000000) as bigint)) as ts", "kind").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        query = (
            watchdogs.stalled_calls(stream, idle, progress, delay).writeStream.outputMode("append").format("parquet")
            .option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(300)
    return sorted((r["gen_id"], r["stalled_at"].timestamp() - START, r["reason"]) for r in spark.read.parquet(str(tmp_path / name)).collect())


def test_silence_is_reported_without_a_later_row(spark, tmp_path):
    first = [(1, 0.0, "start"), (2, 0.0, "start"), (2, 10.0, "content"), (3, 0.0, "start"), (3, 5.0, "content"), (3, 9.0, "over"),
             (4, 0.0, "start"), *[(4, 60.0 * k, "keepalive") for k in range(1, 9)]]
    later = [(9, 10_000.0, "start")]  # another call moves the clock
    found = replayed(spark, tmp_path, [first, later], "stalls")
    assert found == [(1, 120.0, "silent for 120s"), (2, 130.0, "silent for 120s"), (4, 240.0, "no tokens for 240s")]


def test_stream_equals_batch_on_a_replayed_log(spark, tmp_path):
    rng = random.Random(4)
    log, calls = [], []
    for gen in range(40):
        at = started = round(rng.uniform(0, 2000), 2)
        rows = []
        for _ in range(rng.randint(0, 25)):
            at += rng.choice([1, 20, 60, 119.5, 120, 121, 150])
            rows.append((gen, at, rng.choice(["content", "reasoning", "keepalive", "keepalive"])))
        ended = at + rng.choice([0, 50, 130]) if gen % 3 else None
        calls.append((gen, started, ended))
        log += [(gen, started, "start"), *rows] + ([(gen, ended, "over")] if ended is not None else [])
    end = max(row[1] for row in log) + 10_000
    calls = [(g, a, b if b is not None else end) for g, a, b in calls]
    log.sort(key=lambda row: row[1] + rng.uniform(0, 50))  # out of order by less than the delay
    cuts = [0, 150, 151, 400, len(log)]
    batches = [log[a:b] for a, b in zip(cuts, cuts[1:])] + [[(999, end + 1000, "start")]]
    rows = spark.createDataFrame([(g, i, s, k) for i, (g, s, k) in enumerate(log) if k not in ("start", "over")], "gen_id long, seq long, s double, kind string")
    rows = rows.selectExpr("gen_id", "seq", "timestamp_micros(cast(round(s * 1000000) as bigint)) as ts", "kind")
    known = spark.createDataFrame(calls, "gen_id long, a double, b double").selectExpr(
        "gen_id", "timestamp_micros(cast(round(a * 1000000) as bigint)) as started", "timestamp_micros(cast(round(b * 1000000) as bigint)) as ended"
    )
    batch = sorted((r["gen_id"], r["stalled_at"].timestamp(), r["reason"]) for r in deltas.stall_reasons(rows, known, 120, 240).collect())
    tidy = lambda rows: [(g, round(t, 3), why) for g, t, why in rows]
    assert len(batch) > 10 and tidy(replayed(spark, tmp_path, batches, "replayed")) == tidy(batch)


def test_late_rows_go_to_the_side_table_alone(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "gen_id long, seq long, ts timestamp, kind string, delta string"
    batches = [[(1, 0, 0, "a"), (1, 1, 1000, "b")], [(1, 3, 500, "in time"), (2, 0, 100, "late"), (1, 4, None, "undated")], [(1, 5, 999, "c")]]
    for rows in batches:
        frame = spark.createDataFrame([(g, i, s, "content", d) for g, i, s, d in rows], "gen_id long, seq long, s long, kind string, delta string")
        frame.selectExpr("gen_id", "seq", "timestamp_seconds(s) as ts", "kind", "delta").coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):  # a second run without new files adds nothing
            stream = spark.readStream.schema(schema).parquet(source)
            assert deltas.store_stream(stream, out, str(tmp_path / "cp"), 600).trigger(availableNow=True).start().awaitTermination(120)
    store = Store(spark, out)
    assert sorted(r["delta"] for r in store.read("late").collect()) == ["late", "undated"]
    assert sorted(r["delta"] for r in store.read("deltas").collect()) == ["a", "b", "c", "in time"]
    text = "".join(r["content"] for r in deltas.reassembled(store.read("deltas")).orderBy("block").collect())
    assert text == "abin timec"
