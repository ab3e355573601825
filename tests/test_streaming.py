"""Streaming jobs: exactly-once over restarts and continuous loading."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from kiln.session import staging_dir
from kiln.streaming import streams as S


def _land(spark, path, lo, hi):
    spark.range(lo, hi).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("k")).write.mode(
        "overwrite").parquet(os.path.join(path, f"wave={lo}"))


def test_restart_consumes_each_file_once(spark):
    src, out, ckpt = staging_dir(spark, "s_src"), staging_dir(spark, "s_out"), staging_dir(spark, "s_ckpt")
    schema = "event_id long, k long"
    _land(spark, src, 0, 100)

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        S.run_available(stream, out, ckpt)

    run()
    run()  # nothing new: the checkpoint is the ledger
    assert S.read_batches(spark, out).count() == 100
    _land(spark, src, 100, 150)
    run()  # only the new wave
    got = S.read_batches(spark, out)
    assert got.count() == 150 and got.select("event_id").distinct().count() == 150


def test_stateful_counts_survive_restart(spark):
    src, out, ckpt = staging_dir(spark, "c_src"), staging_dir(spark, "c_out"), staging_dir(spark, "c_ckpt")
    _land(spark, src, 0, 90)

    def run():
        stream = spark.readStream.schema("event_id long, k long").option("recursiveFileLookup", True).parquet(src)
        counts = stream.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        S.run_available(counts, out, ckpt, mode="update")

    run()
    _land(spark, src, 90, 120)
    run()  # the aggregation state is restored from the checkpoint
    last = S.latest_per_key(S.read_batches(spark, out), ["k"], ["batch_id"])
    assert {r.k: r.n for r in last.collect()} == {0: 40, 1: 40, 2: 40}


def test_continuous_log_stream(spark):
    src, out, ckpt = staging_dir(spark, "l_src"), staging_dir(spark, "l_out"), staging_dir(spark, "l_ckpt")
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write('{"timestamp": "2026-01-01T10:00:00", "level": "INFO", "logger": "job", "message": "start"}\n')
        f.write('{"timestamp": "2026-01-01T10:00:05", "level": "ERROR", "logger": "job", "message": "boom",'
                ' "run_uuid": "r1", "stepruntime": 1.5}\n')
    q = S.start_log_stream(spark, src, out, ckpt, interval="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r.message: r for r in spark.read.parquet(out).collect()}
    assert rows["start"].run_uuid == "system" and rows["start"].processtype == "job"
    assert rows["boom"].run_uuid == "r1" and rows["boom"].stepruntime == 1.5


def test_event_state_ttl_forgets_finished_events(spark):
    """With a TTL, a cancelled event's state is dropped once the watermark
    passes; a later transition for the same id then starts from pending."""
    src, out, ckpt = staging_dir(spark, "t_src"), staging_dir(spark, "t_out"), staging_dir(spark, "t_ckpt")
    schema = "event_id long, seq long, action string, ts timestamp_ntz, retry_count int"
    t0 = dt.datetime(2024, 1, 1)
    waves = [
        [(1, 1, "cancel", t0, 0), (2, 1, "process", t0, 0)],
        [(3, 1, "process", t0 + dt.timedelta(days=3), 0)],  # moves the watermark far past event 1
        [(1, 2, "process", t0 + dt.timedelta(days=3, minutes=1), 0)],
    ]
    for i, rows in enumerate(waves):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(os.path.join(src, f"w={i}"))

        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        S.run_available(S.event_lifecycle(stream, state_ttl_ms=3600 * 1000, watermark="1 hour"), out, ckpt,
                        mode="update", rocksdb=True)
    final = S.latest_per_key(S.read_batches(spark, out).filter(F.col("illegal_action").isNull()),
                             ["event_id"], ["batch_id", "version"])
    got = {r.event_id: r.status for r in final.collect()}
    assert got == {1: "processing", 2: "processing", 3: "processing"}


TRANSITION = "event_id long, seq long, action string, ts timestamp_ntz, retry_count int"


def test_one_event_over_several_batches_and_a_restart(spark):
    """pending -> processing -> failed -> (illegal) -> pending -> processing -> completed, a micro-batch or more each."""
    src, out, ckpt = staging_dir(spark, "e_src"), staging_dir(spark, "e_out"), staging_dir(spark, "e_ckpt")
    at = dt.datetime(2026, 1, 1)
    steps = [("process",), ("fail", "complete"), ("retry",), ("process", "complete")]
    seq = 0
    for wave, actions in enumerate(steps):
        rows = []
        for a in actions:
            seq += 1
            rows.append((7, seq, a, at + dt.timedelta(minutes=seq), 2))
        spark.createDataFrame(rows, TRANSITION).write.parquet(os.path.join(src, f"w{wave}"))
        stream = spark.readStream.schema(TRANSITION).option("recursiveFileLookup", True).parquet(src)
        S.run_available(S.event_lifecycle(stream), out, ckpt, mode="update", rocksdb=True)
    got = S.read_batches(spark, out)
    assert got.select("batch_id").distinct().count() >= 4
    final = S.latest_per_key(got.filter("illegal_action IS NULL"), ["event_id"], ["version"]).first()
    assert (final.status, final.retry_count, final.version) == ("completed", 3, 5)
    assert final.processed_at == at + dt.timedelta(minutes=1)  # set once
    assert final.completed_at == at + dt.timedelta(minutes=6)
    assert [(r.illegal_action, r.status) for r in got.filter("illegal_action IS NOT NULL").collect()] == [("complete", "failed")]


def test_a_late_row_within_the_watermark_counts_and_one_beyond_is_reported(spark):
    src, out, ckpt = staging_dir(spark, "w_src"), staging_dir(spark, "w_out"), staging_dir(spark, "w_ckpt")
    schema = "id long, ts timestamp_ntz, status string"
    progress = []
    for wave, days in enumerate([(1, 2, 20), (15,), (3,)]):  # the watermark stands ten days before the 20th
        rows = [(wave, dt.datetime(2026, 1, day, 12), "completed") for day in days]
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(src, f"w{wave}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        progress.append(S.run_available(S.events_per_day(stream, "ts", F.col("status"), "10 days"), out, ckpt, mode="update"))
    days = S.latest_per_key(S.read_batches(spark, out), ["date"], ["batch_id"])
    assert {r.date.day: r.total for r in days.collect()} == {1: 1, 2: 1, 15: 1, 20: 1}
    assert [S.dropped_late(p) for p in progress] == [0, 0, 1]


def test_events_of_a_bucket_share_the_calls_to_the_store(spark):
    """A key a visit costs milliseconds for every event; many events a visit, none of which sees another's state."""
    src, out, ckpt = staging_dir(spark, "b_src"), staging_dir(spark, "b_out"), staging_dir(spark, "b_ckpt")
    at = dt.datetime(2026, 1, 1)
    for wave, action in enumerate(("process", "complete", "retry")):
        rows = [(i, wave, action, at + dt.timedelta(seconds=wave), i % 3) for i in range(200) if i % 2 == 0 or wave == 0]
        rows += [(None, wave, action, None, None)] if wave < 2 else []
        spark.createDataFrame(rows, TRANSITION).write.parquet(os.path.join(src, f"w{wave}"))
        stream = spark.readStream.schema(TRANSITION).option("recursiveFileLookup", True).parquet(src)
        progress = S.run_available(S.event_lifecycle(stream, buckets=4), out, ckpt, mode="update", rocksdb=True)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] <= 4
    got = S.read_batches(spark, out)
    final = S.latest_per_key(got.filter("illegal_action IS NULL"), ["event_id"], ["version", "batch_id"])
    state = {r.event_id: (r.status, r.retry_count, r.processed_at, r.completed_at, r.version) for r in final.collect()}
    assert state == {None: ("completed", 0, None, None, 2)} | {
        i: ("processing", i % 3, at, None, 1) if i % 2 else ("completed", i % 3, at, at + dt.timedelta(seconds=1), 2) for i in range(200)}
    bad = got.filter("illegal_action IS NOT NULL").collect()
    assert sorted((r.event_id, r.status, r.illegal_action) for r in bad) == [(i, "completed", "retry") for i in range(0, 200, 2)]


def test_one_timer_of_a_bucket_forgets_each_event_in_its_time(spark):
    src, out, ckpt = staging_dir(spark, "k_src"), staging_dir(spark, "k_out"), staging_dir(spark, "k_ckpt")
    at = dt.datetime(2024, 1, 1)
    waves = [[(1, 1, "cancel", at, 0), (2, 1, "cancel", at + dt.timedelta(hours=30), 0), (3, 1, "process", at, 0)],
             [(4, 1, "process", at + dt.timedelta(hours=20), 0)], [(5, 1, "process", at + dt.timedelta(hours=24), 0)],
             [(i, 2, "process", at + dt.timedelta(hours=31), 0) for i in (1, 2, 3)]]
    for i, rows in enumerate(waves):
        spark.createDataFrame(rows, TRANSITION).write.parquet(os.path.join(src, f"w={i}"))
        stream = spark.readStream.schema(TRANSITION).option("recursiveFileLookup", True).parquet(src)
        S.run_available(S.event_lifecycle(stream, 3600 * 1000, "1 hour", buckets=1), out, ckpt, mode="update", rocksdb=True)
    bad = S.read_batches(spark, out).filter("illegal_action IS NOT NULL").collect()
    assert sorted((r.event_id, r.status) for r in bad) == [(2, "cancelled"), (3, "processing")]  # event 1 was forgotten
