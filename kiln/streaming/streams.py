"""Structured Streaming versions of the import, event and rollup jobs (STR-*).

Sources are file streams (the landing zone); every query has its own
checkpoint folder under the shared checkpoint location, so a restarted or
re-run query resumes exactly where it stopped and files are consumed once.
Sinks are durable: ``foreachBatch`` writes each micro-batch to
``<out>/batch_id=<n>`` with overwrite, so a replayed batch replaces its own
output instead of duplicating it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import UTC

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kiln.functions.scalars import glob_to_regex
from kiln.operators.joins import regex_rule_hits

IGNORE_GLOBS = ["*.tmp", "*.swp", ".*", "*~"]
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


# ---------------------------------------------------------------- plumbing
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(df: DataFrame, out_path: str, checkpoint: str, mode: str = "append",
                  on_batch: Callable[[DataFrame, int, int], None] | None = None, rocksdb: bool = False) -> list:
    """Run a streaming frame over everything available now, then stop.

    Each micro-batch is written idempotently to ``out_path/batch_id=<n>``;
    ``on_batch(batch, batch_id, rows)`` gets the row count observed by that
    same write (no second pass over the batch).  With ``rocksdb`` the query's state
    lies in the RocksDB store.  Returns the progress of the last micro-batches.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        obs = Observation(f"batch_{batch_id}")
        batch.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(
            os.path.join(out_path, f"batch_id={batch_id}"))
        if on_batch is not None:
            on_batch(batch, batch_id, int(obs.get["rows"]))

    spark, key = df.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if rocksdb:
        spark.conf.set(key, ROCKSDB)
    try:  # a query keeps the store it was started with
        q = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return q.recentProgress


def read_batches(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(out_path)


def latest_per_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Final state of an update-mode stream: the last emitted row per key
    (``max_by`` over the version, a partial aggregate)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(v) for v in version])).alias("_r")).select(
        *keys, "_r.*")


# ---------------------------------------------------------------- STR-01
def file_events(spark: SparkSession, directory: str, include: list[str] | None = None,
                ignore: list[str] | None = None) -> DataFrame:
    """File-arrival events: new files whose name matches an include glob and
    no ignore glob -> (path, name, dir, extension, size, time).  File
    content is never read."""
    s = spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", True).load(directory)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ev = s.select(
        F.col("path").alias("file_path"),
        name.alias("file_name"),
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("extension"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
    )
    inc = include or ["*"]
    keep = F.lit(False)
    for g in inc:
        keep = keep | F.col("file_name").rlike(glob_to_regex(g))
    for g in (ignore if ignore is not None else IGNORE_GLOBS):
        keep = keep & ~F.col("file_name").rlike(glob_to_regex(g))
    return ev.filter(keep)


# ---------------------------------------------------------------- STR-02/09
def incremental_import(spark: SparkSession, source: str, schema: T.StructType, fmt: str, target: str, checkpoint: str,
                       transform: Callable[[DataFrame], DataFrame], events: str | None = None, run_id: str = "run",
                       options: dict[str, str] | None = None) -> None:
    """STR-02 (+STR-09): files arriving in ``source`` are parsed with an
    explicit schema, transformed, appended to ``target`` exactly once (the
    stream checkpoint is the processed-files ledger); after each batch one
    ``import_complete`` event row is appended to ``events`` keyed by
    (run_id, batch_id), so a replayed batch rewrites the same event."""
    r = spark.readStream.schema(schema).format(fmt)
    for k, v in (options or {}).items():
        r = r.option(k, v)
    stream = transform(r.load(source).withColumn("_source_file", F.col("_metadata.file_name")))

    def after(batch: DataFrame, batch_id: int, n: int) -> None:
        if events is None:
            return
        ev = spark.createDataFrame(
            [(f"{run_id}:{batch_id}", "import_complete", run_id, batch_id, n)],
            "event_key string, event_type string, run_id string, batch_id long, records long",
        )
        ev.write.mode("overwrite").parquet(os.path.join(events, f"batch_id={batch_id}"))

    run_available(stream, target, checkpoint, on_batch=after)


# ---------------------------------------------------------------- STR-07
def start_log_stream(spark: SparkSession, source: str, target: str, checkpoint: str,
                     interval: str | None = "10 seconds", schema: T.StructType | None = None,
                     options: dict[str, str] | None = None):
    """Continuous log loading: JSON log lines arriving in ``source`` are
    typed (SRC-11) and appended to ``target`` in micro-batches every
    ``interval`` (the reference buffered 100 lines or 10 s); without an interval
    it loads what is there and ends.  Returns the running ``StreamingQuery``;
    stop it with ``.stop()``."""
    from kiln.sources.files import LOG_SCHEMA

    s = spark.readStream.schema(schema or LOG_SCHEMA).options(**(options or {})).json(source)
    typed = s.select(
        F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz").alias("timestamp"), "level", "message",
        F.coalesce("run_uuid", F.lit("system")).alias("run_uuid"), F.coalesce("username", F.lit("system")).alias("username"),
        F.coalesce("processtype", "logger").alias("processtype"), "stepcounter", "stepruntime",
    )
    return (typed.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
            .outputMode("append").trigger(**({"processingTime": interval} if interval else {"availableNow": True})).start())


# ---------------------------------------------------------------- STR-03
STATE_OUT_SCHEMA = (
    "event_id long, status string, retry_count int, processed_at timestamp_ntz, completed_at timestamp_ntz, "
    "version long, illegal_action string"
)
STATE_COLUMNS = [c.split()[0] for c in STATE_OUT_SCHEMA.split(", ")]
STATE_ROW = Row(*STATE_COLUMNS)

# The event life cycle (action -> allowed source statuses -> new status).
TRANSITIONS = {
    "process": ({"pending"}, "processing"),
    "complete": ({"processing"}, "completed"),
    "fail": ({"processing"}, "failed"),
    "cancel": ({"pending", "processing"}, "cancelled"),
    "retry": ({"failed"}, "pending"),
}


TERMINAL = ("completed", "cancelled")
STATE_BUCKETS = 1024


STATE_COLUMNS_HELD = pa.schema([
    ("event_id", pa.int64()), ("status", pa.string()), ("retry_count", pa.int32()), ("processed_at", pa.timestamp("us")),
    ("completed_at", pa.timestamp("us")), ("version", pa.int64()), ("touched", pa.int64()), ("deadline", pa.int64())])


class EventLifecycle(StatefulProcessor):
    """The life cycles of a bucket of events: one typed table of them as state, and a timer that forgets finished ones.

    A call between worker and store costs as much as hundreds of transitions, so a bucket's events share the calls."""

    def __init__(self, keep_ms: int | None = None, idle_ttl_ms: int | None = None):
        self.keep_ms, self.idle_ttl_ms = keep_ms, idle_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lifecycles", "events binary", self.idle_ttl_ms)

    def _load(self) -> dict:
        """{event: (status, retries, processed, completed, version, time of the last update, deadline)}"""
        held = self.state.get()
        if held is None:
            return {}
        columns = [c.to_pylist() for c in pa.ipc.open_stream(held[0]).read_all().columns]
        return dict(zip(columns[0], zip(*columns[1:])))

    def _store(self, events: dict) -> None:
        if not events:
            self.state.clear()
            return
        columns = [list(events), *(list(c) for c in zip(*events.values()))]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, STATE_COLUMNS_HELD.types)], schema=STATE_COLUMNS_HELD)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, STATE_COLUMNS_HELD) as w:
            w.write_batch(batch)
        self.state.update((out.getvalue().to_pybytes(),))

    def _set_timer(self, events: dict) -> None:
        """One timer a bucket, at the earliest deadline."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        deadlines = [e[6] for e in events.values() if e[6] is not None]
        if deadlines:
            self.handle.registerTimer(min(deadlines))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Apply the new transitions of each of the bucket's events (in order of seq) to its state."""
        new: dict = {}
        for r in rows:
            new.setdefault(r["event_id"], []).append(r)
        events, now = self._load(), 0
        if self.idle_ttl_ms is not None:
            now = timerValues.getCurrentProcessingTimeInMs()
            events = {k: e for k, e in events.items() if e[5] + self.idle_ttl_ms > now}
        for event_id, transitions in new.items():
            transitions.sort(key=lambda r: (r["seq"] is None, r["seq"]))
            if event_id in events:
                status, retries, processed, completed, version = events[event_id][:5]
            else:
                status, retries, processed, completed, version = "pending", transitions[0]["retry_count"] or 0, None, None, 0
            for r in transitions:
                action, ts = r["action"], r["ts"]
                allowed, after = TRANSITIONS.get(action, (set(), None))
                if status not in allowed:
                    yield STATE_ROW(event_id, status, retries, processed, completed, version, action)
                    continue
                if after == "processing" and processed is None:
                    processed = ts
                if after in ("completed", "failed", "cancelled"):
                    completed = ts
                if after == "failed":
                    retries += 1
                status = after
                version += 1
            deadline = None
            if self.keep_ms is not None and status in TERMINAL:
                last = max(r["ts"] for r in transitions if r["ts"] is not None)
                deadline = int(last.replace(tzinfo=UTC).timestamp() * 1000) + self.keep_ms
            events[event_id] = (status, retries, processed, completed, version, now, deadline)
            yield STATE_ROW(event_id, status, retries, processed, completed, version, None)
        self._store(events)
        if self.keep_ms is not None:
            self._set_timer(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(at, timerValues.getCurrentWatermarkInMs() - 1)
        events = {k: e for k, e in self._load().items() if e[6] is None or e[6] > passed}
        self._store(events)
        self._set_timer(events)
        return iter([])

    def close(self) -> None:
        pass


def event_lifecycle(transitions: DataFrame, state_ttl_ms: int | None = None, watermark: str | None = None,
                    idle_ttl_ms: int | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """STR-03: keyed state over a stream of transitions
    (event_id, seq, action, ts, retry_count) -> state rows in update mode,
    plus one row per illegal transition (``illegal_action`` set), which is
    ignored by the state.

    The state lies in the RocksDB store (``run_available(..., rocksdb=True)``), on disk
    and in the checkpoint, not in the executor's heap.  By default late transitions are
    always accepted and state is kept (as the reference's queue table keeps every event).
    With ``state_ttl_ms`` a timer drops the state of a completed/cancelled event once the
    event-time watermark (``watermark`` delay) passes its last transition + TTL.  With
    ``idle_ttl_ms`` any state not updated for so long (processing time) is dropped.

    Events are dealt by the hash of their id to ``buckets`` state entries; a micro-batch reads and
    writes the entries that its events are in, whole.  The number belongs to the checkpoint."""
    if state_ttl_ms is not None and idle_ttl_ms is not None:
        raise ValueError("give either an event-time retention or an idle time")
    t = transitions.withColumn("_wts", F.col("ts").cast("timestamp"))
    mode = "None" if idle_ttl_ms is None else "ProcessingTime"
    if state_ttl_ms is not None:
        t, mode = t.withWatermark("_wts", watermark or "1 hour"), "EventTime"
    return t.withColumn("_bucket", F.pmod(F.xxhash64("event_id"), F.lit(buckets))).groupBy("_bucket").transformWithState(
        EventLifecycle(state_ttl_ms, idle_ttl_ms), STATE_OUT_SCHEMA, "Update", mode)


# ---------------------------------------------------------------- STR-04/05
def fanout(events: DataFrame, subscribers: list[dict], name_col: str | None = None) -> DataFrame:
    """STR-04: one trigger row per (event, active subscriber of its type);
    a subscriber's optional file glob must match ``name_col``.  The
    subscriber list is tiny, so every subscriber is a predicate evaluated in
    one pass (a stream-static broadcast join)."""
    conds = []
    for s in subscribers:
        if not s.get("is_active", True):
            continue
        c = F.col("event_type") == F.lit(s["event_type"])
        if s.get("file_glob") and name_col:
            c = c & F.coalesce(F.col(name_col).rlike(glob_to_regex(s["file_glob"])), F.lit(False))
        conds.append(F.when(c, F.lit(s["subscriber_id"])))
    hits = F.array_compact(F.array(*conds)) if conds else F.array().cast("array<int>")
    return events.withColumn("subscriber_id", F.explode(hits))


def trigger_counts(triggers: DataFrame, ts: str) -> DataFrame:
    """STR-05: per subscriber, trigger count and last trigger time."""
    return triggers.groupBy("subscriber_id").agg(F.count(F.lit(1)).alias("trigger_count"), F.max(ts).alias("last_triggered"))


# ---------------------------------------------------------------- STR-06/08
def events_per_day(events: DataFrame, ts: str, status: Column, watermark: str) -> DataFrame:
    """STR-06: per-day totals as a windowed streaming aggregate in update mode.

    A row no later than ``watermark`` behind the latest one changes its day's
    totals; the state of older days is purged and later rows for them are dropped
    (counted in the query's progress, see ``dropped_late``)."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))  # watermarks need an instant
    return timed.withWatermark(ts, watermark).groupBy(F.window(ts, "1 day")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
    ).select(F.col("window.start").cast("date").alias("date"), "total", "completed", "failed")


def dropped_late(progress: list) -> int:
    """Groups of late rows that the watermark dropped, over all micro-batches of a run."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def inbox_routing(messages: DataFrame, rules: list[dict], fields: dict[str, str]) -> DataFrame:
    """STR-10: per message, the ids of all matching rules (in rule order)
    and the routing label = the last matching rule (NULL when nothing
    matches, i.e. the message is unmatched).  Stateless: it runs unchanged
    on a stream, one pass per micro-batch."""
    hits = regex_rule_hits(rules, fields)
    return messages.withColumn("matched_rules", hits).withColumn(
        "label_rule", F.try_element_at(F.col("matched_rules"), F.lit(-1)))


__all__ = [
    "file_events", "incremental_import", "event_lifecycle", "fanout", "trigger_counts", "events_per_day",
    "inbox_routing", "run_available", "read_batches", "latest_per_key",
]
