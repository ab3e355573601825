"""STR-* queries: driver tables are landed as files in several waves, the
streaming job runs over them with ``availableNow`` (several micro-batches,
state carried between them), and the query returns the sink's final
content, which the oracle checks against the batch result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators import opslog as O
from kiln.plans import common as C
from kiln.plans.q_sources import ORDER_TYPES
from kiln.plans.registry import query
from kiln.plans.common import FOLDER_AND_NAME, file_sums, held_against_files
from kiln.session import hadoop_path, staging_dir
from kiln.streaming import streams as S


def _land_waves(df: DataFrame, path: str, wave: str, fmt: str = "parquet", **opts) -> None:
    """Land ``df`` as one folder per value of ``wave`` in one partitioned
    write (a file stream then sees several files and runs several micro-batches)."""
    w = df.write.mode("overwrite").partitionBy(wave)
    for k, o in opts.items():
        w = w.option(k, o)
    w.format(fmt).save(path)


def _events_stream(spark, d, name, per_trigger=2):
    """Events landed in one wave per day of the month; a stream over them."""
    src = staging_dir(spark, name)
    e = C.T(spark, d).events
    _land_waves(e.withColumn("_wave", F.dayofmonth("ts")), src, "_wave")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", per_trigger).option(
        "recursiveFileLookup", True).parquet(src)


# ------------------------------------------------------------------ STR-03
def _transitions(e):
    et = F.col("event_type")
    actions = (
        F.when(et == "view", F.array(F.lit("complete")))
        .when(et == "click", F.array(F.lit("process")))
        .when(et == "purchase", F.array(F.lit("process"), F.lit("complete")))
        .when((et == "error") & (F.col("event_id") % 2 == 0), F.array(F.lit("process"), F.lit("fail"), F.lit("retry")))
        .when(et == "error", F.array(F.lit("process"), F.lit("fail")))
        .otherwise(F.array(F.lit("cancel")))
    )
    t = e.select("event_id", "ts", (F.col("event_id") % 3).cast("int").alias("retry_count"),
                 F.posexplode(actions).alias("p", "action"))
    return t.select("event_id", (F.col("p") + 1).cast("long").alias("seq"), "action",
                    F.timestamp_add("SECOND", F.col("p") + 1, F.col("ts")).alias("ts"), "retry_count")


def _lifecycle_output(spark, d):
    """At least three micro-batches: the first transitions of all events, then the second ones, and after a restart the third."""
    src = staging_dir(spark, "transitions")
    tr = _transitions(C.T(spark, d).events)
    out, ckpt = staging_dir(spark, "lifecycle_out"), staging_dir(spark, "lifecycle_ckpt")

    def run():
        stream = spark.readStream.schema(tr.schema).option("recursiveFileLookup", True).parquet(src)
        S.run_available(S.event_lifecycle(stream), out, ckpt, mode="update", rocksdb=True)

    for wave in (1, 2, 3):
        tr.filter(F.col("seq") == wave).write.mode("overwrite").parquet(os.path.join(src, f"wave_{wave}"))
        run()  # the state of the runs before is read from the checkpoint
    batches = S.read_batches(spark, out)
    if batches.select("batch_id").distinct().count() < 3:
        raise RuntimeError("the transitions did not come in several micro-batches")
    return batches


@query(
    "str_event_state",
    """
SELECT event_id,
  CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
       WHEN 'signup' THEN 'cancelled' ELSE CASE WHEN event_id % 2 = 0 THEN 'pending' ELSE 'failed' END END AS status,
  CAST(event_id % 3 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS retry_count,
  CASE WHEN event_type IN ('click', 'purchase', 'error') THEN ts + INTERVAL 1 SECOND END AS processed_at,
  CASE WHEN event_type IN ('purchase', 'error') THEN ts + INTERVAL 2 SECOND
       WHEN event_type = 'signup' THEN ts + INTERVAL 1 SECOND END AS completed_at,
  CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1
       ELSE CASE WHEN event_id % 2 = 0 THEN 3 ELSE 2 END END AS BIGINT) AS version
FROM events""",
)
def str_event_state(spark, d):
    out = _lifecycle_output(spark, d).filter(F.col("illegal_action").isNull())
    return S.latest_per_key(out.drop("illegal_action"), ["event_id"], ["version", "batch_id"]).drop("batch_id")


@query(
    "str_event_rejects",
    "SELECT event_id, 'complete' AS illegal_action, 'pending' AS status FROM events WHERE event_type = 'view'",
)
def str_event_rejects(spark, d):
    out = _lifecycle_output(spark, d).filter(F.col("illegal_action").isNotNull())
    return out.select("event_id", "illegal_action", "status")


# ------------------------------------------------------------------ STR-04/05
# fixed values: the subscriber table (id, event type, active, optional file glob)
SUBSCRIBERS = [
    {"subscriber_id": 1, "event_type": "purchase", "is_active": True},
    {"subscriber_id": 2, "event_type": "purchase", "is_active": True},
    {"subscriber_id": 3, "event_type": "error", "is_active": True},
    {"subscriber_id": 4, "event_type": "signup", "is_active": False},
    {"subscriber_id": 5, "event_type": "click", "is_active": True, "file_glob": "part-*.parquet"},
    {"subscriber_id": 6, "event_type": "view", "is_active": True, "file_glob": "*.csv"},
]
SUBSCRIBERS_SQL = "(VALUES (1, 'purchase'), (2, 'purchase'), (3, 'error'), (5, 'click')) s(subscriber_id, event_type)"


def _fanout_stream(spark, d, name):
    ev = _events_stream(spark, d, name).withColumn("_file", F.col("_metadata.file_name"))
    return S.fanout(ev, SUBSCRIBERS, name_col="_file").select("event_id", "ts", "subscriber_id")


@query("str_fanout", f"SELECT e.event_id, s.subscriber_id FROM events e JOIN {SUBSCRIBERS_SQL} USING (event_type)")
def str_fanout(spark, d):
    out, ckpt = staging_dir(spark, "fanout_out"), staging_dir(spark, "fanout_ckpt")
    S.run_available(_fanout_stream(spark, d, "fanout_src"), out, ckpt)
    return S.read_batches(spark, out).select("event_id", "subscriber_id")


@query(
    "str_trigger_counts",
    f"SELECT s.subscriber_id, count(*) AS trigger_count, max(e.ts) AS last_triggered "
    f"FROM events e JOIN {SUBSCRIBERS_SQL} USING (event_type) GROUP BY 1",
)
def str_trigger_counts(spark, d):
    out, ckpt = staging_dir(spark, "counts_out"), staging_dir(spark, "counts_ckpt")
    S.run_available(S.trigger_counts(_fanout_stream(spark, d, "counts_src"), "ts"), out, ckpt, mode="update")
    return S.latest_per_key(S.read_batches(spark, out), ["subscriber_id"], ["batch_id"]).drop("batch_id")


# ------------------------------------------------------------------ STR-06/08
LATE_DAYS = 10
PER_DAY_SQL = f"""
, a AS (SELECT max(created_at) AS latest FROM queue WHERE event_id % 10 <> 0),
m AS (SELECT q.*, q.event_id % 10 = 0 AND CAST(q.created_at AS DATE) + INTERVAL 1 DAY <= a.latest - INTERVAL {LATE_DAYS} DAY AS late
      FROM queue q, a)
SELECT CAST(created_at AS DATE) AS "date", count(*) FILTER (WHERE NOT late) AS total,
       count(*) FILTER (WHERE status = 'completed' AND NOT late) AS completed,
       count(*) FILTER (WHERE status = 'failed' AND NOT late) AS failed, count(*) FILTER (WHERE late) AS late
FROM m GROUP BY 1"""


@query("str_events_per_day", C.with_ctes(C.QUEUE_SQL, body=PER_DAY_SQL))
def str_events_per_day(spark, d):
    """Nine tenths of the events arrive first; the rest arrives after a restart, for all days: those beyond the watermark are late."""
    src = staging_dir(spark, "perday_src")
    e = C.T(spark, d).events
    et = F.col("event_type")
    status = F.when(et == "purchase", "completed").when(et == "error", "failed").otherwise("other")
    out, ckpt = staging_dir(spark, "perday_out"), staging_dir(spark, "perday_ckpt")
    for wave, rows in (("first", F.col("event_id") % 10 != 0), ("rest", F.col("event_id") % 10 == 0)):
        e.filter(rows).write.mode("overwrite").parquet(os.path.join(src, wave))
        stream = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(src)
        S.run_available(S.events_per_day(stream, "ts", status, f"{LATE_DAYS} days"), out, ckpt, mode="update")
    counted = S.latest_per_key(S.read_batches(spark, out), ["date"], ["batch_id"]).drop("batch_id")
    arrived = spark.read.schema(e.schema).option("recursiveFileLookup", True).parquet(src).groupBy(
        F.to_date("ts").alias("date")).agg(F.count("*").alias("arrived"))
    return counted.join(arrived, "date").select("date", "total", "completed", "failed", (F.col("arrived") - F.col("total")).alias("late"))


@query(
    "str_run_rollup",
    C.with_ctes(
        C.LOGS_SQL,
        body="""
SELECT run_uuid, processtype, min("timestamp") AS starttime, count(*) AS total_steps,
       CASE WHEN max(CASE WHEN message LIKE '%ERROR%' OR message LIKE '%FAIL%' THEN 1 ELSE 0 END) > 0 THEN 'Failed'
            WHEN max(CASE WHEN message LIKE '%SUCCESS%' OR message LIKE '%COMPLETE%' THEN 1 ELSE 0 END) > 0 THEN 'Success'
            ELSE 'Running' END AS status,
       CAST(COALESCE(sum(stepruntime), 0) AS DECIMAL(18,2)) AS total_runtime
FROM logs GROUP BY run_uuid, processtype""",
    ),
)
def str_run_rollup(spark, d):
    t = C.T(spark, d)
    src = staging_dir(spark, "rollup_src")
    lg = C.logs(t)
    _land_waves(lg.withColumn("_wave", F.dayofmonth("timestamp")), src, "_wave")
    stream = spark.readStream.schema(lg.schema).option("maxFilesPerTrigger", 3).option(
        "recursiveFileLookup", True).parquet(src)
    out, ckpt = staging_dir(spark, "rollup_out"), staging_dir(spark, "rollup_ckpt")
    S.run_available(O.run_rollup(stream), out, ckpt, mode="update")
    final = S.latest_per_key(S.read_batches(spark, out), ["run_uuid", "processtype"], ["batch_id"]).drop("batch_id")
    return final.withColumn("total_runtime", F.col("total_runtime").cast("decimal(18,2)"))


# ------------------------------------------------------------------ STR-01/02/07/09
@query("str_file_events", """SELECT event_type, '.parquet' AS extension, count(*) AS records, 0 AS repeated, 0 AS wrong_size
FROM events GROUP BY event_type""")
def str_file_events(spark, d):
    """Every arrival is held against its file: the records read back from it, its size, and that it was announced once."""
    src = staging_dir(spark, "arrivals")
    e = C.T(spark, d).events
    _land_waves(e.withColumn("_wave", F.col("event_type")), src, "_wave")
    fs, p = hadoop_path(spark, os.path.join(src, "notes.tmp"))
    fs.create(p).close()  # an in-flight file the watcher must ignore
    out, ckpt = staging_dir(spark, "arrivals_out"), staging_dir(spark, "arrivals_ckpt")
    S.run_available(S.file_events(spark, src, include=["*.parquet"]), out, ckpt)
    arrived = S.read_batches(spark, out).withColumn("file", F.regexp_extract("file_path", FOLDER_AND_NAME, 1))
    return held_against_files(arrived, spark.read.schema(e.schema).option("recursiveFileLookup", True).parquet(src), "file_size").groupBy(
        F.regexp_extract("directory", "_wave=([^/]*)$", 1).alias("event_type"), "extension").agg(*file_sums())


ORDERS_CSV_SCHEMA = ("o_orderkey string, o_custkey string, o_orderstatus string, o_totalprice string, "
                     "o_orderdate string, o_orderpriority string")


def _import_orders(spark, d, with_events: bool):
    src = staging_dir(spark, "import_src")
    o = C.T(spark, d).orders
    _land_waves(o.withColumn("_wave", F.year("o_orderdate")), src, "_wave", fmt="csv", header=True,
                timestampNTZFormat="yyyy-MM-dd HH:mm:ss")
    out, ckpt = staging_dir(spark, "import_out"), staging_dir(spark, "import_ckpt")
    events = staging_dir(spark, "import_events") if with_events else None
    schema = spark.createDataFrame([], ORDERS_CSV_SCHEMA).schema

    def transform(df):
        from kiln.operators.schema import convert
        return convert(df, ORDER_TYPES).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                               "o_orderpriority")

    S.incremental_import(spark, src, schema, "csv", out, ckpt, transform, events=events, run_id="orders",
                         options={"header": "true", "maxFilesPerTrigger": "2", "recursiveFileLookup": "true"})
    return out, events


@query("str_import", "SELECT * FROM orders")
def str_import(spark, d):
    out, _ = _import_orders(spark, d, False)
    return S.read_batches(spark, out).drop("batch_id")


@query("str_import_events", "SELECT 'import_complete' AS event_type, 'orders' AS run_id, count(*) AS records FROM orders")
def str_import_events(spark, d):
    _, events = _import_orders(spark, d, True)
    return S.read_batches(spark, events).groupBy("event_type", "run_id").agg(F.sum("records").alias("records"))


@query(
    "str_logs",
    """
SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS "timestamp",
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       event_type || ' ' || props AS message, CAST(user_id AS VARCHAR) AS run_uuid, 'system' AS username,
       'kiln.' || event_type AS processtype, CAST(event_id AS VARCHAR) AS stepcounter, value AS stepruntime
FROM events""",
)
def str_logs(spark, d):
    src = staging_dir(spark, "logs_src")
    e = C.T(spark, d).events
    lines = e.select(
        F.dayofmonth("ts").alias("_wave"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("kiln."), "event_type").alias("logger"),
        F.concat("event_type", F.lit(" "), "props").alias("message"),
        F.col("user_id").cast("string").alias("run_uuid"),
        F.col("event_id").cast("string").alias("stepcounter"),
        F.col("value").alias("stepruntime"),
    )
    _land_waves(lines, src, "_wave", fmt="json")
    out, ckpt = staging_dir(spark, "logs_out"), staging_dir(spark, "logs_ckpt")
    S.start_log_stream(spark, src, out, ckpt, interval=None,
                       options={"maxFilesPerTrigger": "4", "recursiveFileLookup": "true"}).awaitTermination()
    return spark.read.parquet(out)


# ------------------------------------------------------------------ STR-10
# fixed values: inbox rules in rule order (id, subject regex, sender regex)
INBOX_RULES = [
    {"rule_id": 1, "subject": "^(the|and|le|la|et) ", "sender": None},
    {"rule_id": 2, "subject": None, "sender": "^(system|assistant)$"},
    {"rule_id": 3, "subject": "[?]", "sender": "user"},
    {"rule_id": 4, "subject": "([bad", "sender": None},
]


@query(
    "str_inbox",
    """
WITH m AS (SELECT conv_id * 1000 + turn AS message_id, text AS subject, role AS sender FROM conversations),
h AS (SELECT message_id,
        list_filter([CASE WHEN regexp_matches(subject, '(?i)^(the|and|le|la|et) ') THEN 1 END,
                     CASE WHEN regexp_matches(sender, '(?i)^(system|assistant)$') THEN 2 END,
                     CASE WHEN regexp_matches(subject, '(?i)[?]') AND regexp_matches(sender, '(?i)user') THEN 3 END],
                    lambda x: x IS NOT NULL) AS matched_rules FROM m)
SELECT message_id, matched_rules, matched_rules[-1] AS label_rule FROM h""",
)
def str_inbox(spark, d):
    src = staging_dir(spark, "inbox_src")
    c = C.T(spark, d).conversations
    msgs = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("text").alias("subject"),
        F.col("role").alias("sender"),
        (F.col("conv_id") % 4).alias("_wave"),
    )
    _land_waves(msgs, src, "_wave")
    stream = spark.readStream.schema(msgs.drop("_wave").schema).option("recursiveFileLookup", True).parquet(src)
    routed = S.inbox_routing(stream, INBOX_RULES, {"subject": "subject", "sender": "sender"})
    out, ckpt = staging_dir(spark, "inbox_out"), staging_dir(spark, "inbox_ckpt")
    S.run_available(routed.select("message_id", "matched_rules", "label_rule"), out, ckpt)
    return S.read_batches(spark, out).drop("batch_id")
