"""AGG-* and TOP-* queries over the rebound operational tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import scalars as S
from kiln.operators import opslog as O
from kiln.plans import common as C
from kiln.plans.registry import query
from kiln.tables import TABLE_NAMES

EA = C.EVENTS_AS_OF
OA = C.ORDERS_AS_OF
DEC2 = T.DecimalType(18, 2)
DEC6 = T.DecimalType(18, 6)


@query(
    "agg_run_rollup",
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
def agg_run_rollup(spark, d):
    r = O.run_rollup(C.logs(C.T(spark, d)))
    return r.withColumn("total_runtime", F.col("total_runtime").cast(DEC2))


@query(
    "agg_run_rollup_nocase",
    C.with_ctes(
        C.LOGS_SQL,
        body="""
SELECT run_uuid, processtype, min("timestamp") AS starttime, count(*) AS total_steps,
       CASE WHEN max(CASE WHEN upper(message) LIKE '%ERROR%' OR upper(message) LIKE '%FAIL%' THEN 1 ELSE 0 END) > 0 THEN 'Failed'
            WHEN max(CASE WHEN upper(message) LIKE '%SUCCESS%' OR upper(message) LIKE '%COMPLETE%' THEN 1 ELSE 0 END) > 0 THEN 'Success'
            ELSE 'Running' END AS status,
       CAST(COALESCE(sum(stepruntime), 0) AS DECIMAL(18,2)) AS total_runtime
FROM logs GROUP BY run_uuid, processtype""",
    ),
)
def agg_run_rollup_nocase(spark, d):
    r = O.run_rollup(C.logs(C.T(spark, d)), ignore_case=True)
    return r.withColumn("total_runtime", F.col("total_runtime").cast(DEC2))


@query(
    "agg_jobs_per_day",
    C.with_ctes(
        C.LOGS_SQL,
        body=f"""
SELECT CAST("timestamp" AS DATE) AS job_date, count(DISTINCT run_uuid) AS job_count
FROM logs WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 7 DAY AND processtype = 'GenericImportJob'
GROUP BY 1""",
    ),
)
def agg_jobs_per_day(spark, d):
    return O.jobs_per_day(C.logs(C.T(spark, d)), "GenericImportJob", EA, 7)


@query(
    "agg_process_dist",
    C.with_ctes(
        C.LOGS_SQL,
        body=f"""
SELECT processtype, count(DISTINCT run_uuid) AS run_count
FROM logs WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 30 DAY GROUP BY 1""",
    ),
)
def agg_process_dist(spark, d):
    return O.process_distribution(C.logs(C.T(spark, d)), EA, 30)


@query(
    "agg_runtime_stats",
    C.with_ctes(
        C.LOGS_SQL,
        body=f"""
SELECT processtype, count(*) AS step_count, CAST(avg(stepruntime) AS DECIMAL(18,6)) AS avg_runtime,
       min(stepruntime) AS min_runtime, max(stepruntime) AS max_runtime
FROM logs WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 7 DAY AND stepruntime IS NOT NULL
GROUP BY 1""",
    ),
)
def agg_runtime_stats(spark, d):
    r = O.runtime_stats(C.logs(C.T(spark, d)), EA, 7)
    return r.withColumn("avg_runtime", F.col("avg_runtime").cast(DEC6))


@query(
    "agg_system_metrics",
    C.with_ctes(
        C.LOGS_SQL,
        C.DATASETS_SQL,
        body=f"""
SELECT l.*, d.*, c.* FROM
 (SELECT count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 24 HOUR) AS total_logs_24h,
         count(DISTINCT processtype) FILTER (WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 24 HOUR) AS unique_processes,
         CAST(COALESCE(round(avg(stepruntime) FILTER (WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 24 HOUR), 2), 0) AS DECIMAL(18,2)) AS avg_runtime,
         count(DISTINCT run_uuid) FILTER (WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 24 HOUR) AS runs_24h
  FROM logs) l,
 (SELECT count(*) FILTER (WHERE createddate >= TIMESTAMP '{OA}' - INTERVAL 30 DAY) AS total_datasets_30d,
         count(*) FILTER (WHERE activated) AS total_active_datasets FROM datasets) d,
 (SELECT count(*) FILTER (WHERE s_acctbal >= 0) AS total_active_configs FROM supplier) c""",
    ),
)
def agg_system_metrics(spark, d):
    t = C.T(spark, d)
    ds = C.datasets(t).withColumn("isactive", F.col("activated"))
    cfg = t.supplier.select((F.col("s_acctbal") >= 0).alias("is_active"))
    # logs are dated in January 2024, datasets in the orders' time frame
    m = O.system_metrics(C.logs(t), ds, cfg, EA, datasets_as_of=OA)
    return m.withColumn("avg_runtime", F.col("avg_runtime").cast(DEC2))


@query(
    "agg_log_stats",
    C.with_ctes(
        C.LOGS_SQL,
        body=f"""
SELECT count(*) AS total_logs, count(DISTINCT run_uuid) AS total_runs, min("timestamp") AS oldest_log,
       max("timestamp") AS newest_log,
       count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 7 DAY) AS logs_last_7_days,
       count(*) FILTER (WHERE "timestamp" >= TIMESTAMP '{EA}' - INTERVAL 30 DAY) AS logs_last_30_days
FROM logs""",
    ),
)
def agg_log_stats(spark, d):
    return O.log_stats(C.logs(C.T(spark, d)), EA)


@query(
    "agg_pipeline_stats",
    C.with_ctes(
        C.RUNS_SQL,
        body=f"""
SELECT count(*) AS total,
       count(*) FILTER (WHERE status = 'success') AS success,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'partial') AS partial,
       count(*) FILTER (WHERE status = 'running') AS running,
       CAST(round(COALESCE(avg(epoch(completed_at - started_at)), 0), 1) AS DECIMAL(30,6)) AS avg_duration_seconds
FROM runs WHERE started_at >= TIMESTAMP '{OA}' - INTERVAL 17520 HOUR""",
    ),
)
def agg_pipeline_stats(spark, d):
    r = O.pipeline_stats(C.runs(C.T(spark, d)), OA, 17520)
    return r.withColumn("avg_duration_seconds", F.col("avg_duration_seconds").cast(T.DecimalType(30, 6)))


@query(
    "agg_event_stats",
    C.with_ctes(
        C.QUEUE_SQL,
        body="""
SELECT count(*) AS total,
       count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'processing') AS processing,
       count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'cancelled') AS cancelled
FROM queue""",
    ),
)
def agg_event_stats(spark, d):
    q = C.queue(C.T(spark, d))
    st = F.col("status")
    return O.status_counts(q, {s: st == s for s in ("pending", "processing", "completed", "failed", "cancelled")})


@query(
    "agg_events_per_day",
    C.with_ctes(
        C.QUEUE_SQL,
        body=f"""
SELECT CAST(created_at AS DATE) AS "date", count(*) AS total,
       count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'failed') AS failed
FROM queue WHERE created_at >= CAST(DATE '{EA[:10]}' - INTERVAL 14 DAY AS TIMESTAMP) GROUP BY 1""",
    ),
)
def agg_events_per_day(spark, d):
    return O.events_per_day(C.queue(C.T(spark, d)), EA, 14)


@query(
    "agg_counters",
    """
SELECT count(*) AS total,
       count(*) FILTER (WHERE c_acctbal > 0) AS active,
       count(*) FILTER (WHERE NOT (c_acctbal > 0)) AS inactive,
       count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building,
       count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS machinery,
       CAST(sum(c_nationkey) AS BIGINT) AS total_triggers
FROM customer""",
)
def agg_counters(spark, d):
    c = C.T(spark, d).customer
    b = F.col("c_acctbal")
    return O.status_counts(
        c,
        {
            "active": b > 0,
            "inactive": ~(b > 0),
            "building": F.col("c_mktsegment") == "BUILDING",
            "machinery": F.col("c_mktsegment") == "MACHINERY",
        },
        sums={"total_triggers": F.col("c_nationkey").cast("bigint")},
    )


SUITE_SQL = """suite AS (
  SELECT l_suppkey AS suite_id, l_orderkey, l_linenumber, 'test_' || l_partkey AS test_name,
         CASE l_returnflag WHEN 'N' THEN 'passed' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status,
         l_shipdate AS started_at, l_shipdate + to_days(l_linenumber) AS completed_at,
         CAST(l_quantity AS BIGINT) AS expected_records,
         CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END AS records_loaded
  FROM lineitem)"""


def _suite(t):
    li = t.lineitem
    return li.select(
        F.col("l_suppkey").alias("suite_id"),
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("test_"), F.col("l_partkey")).alias("test_name"),
        F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "R", "failed").otherwise("skipped").alias("status"),
        F.col("l_shipdate").alias("started_at"),
        F.timestamp_add("DAY", F.col("l_linenumber"), F.col("l_shipdate")).alias("completed_at"),
        F.col("l_quantity").cast("bigint").alias("expected_records"),
        F.when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("bigint")).alias("records_loaded"),
    )


@query(
    "agg_suite_summary",
    C.with_ctes(
        SUITE_SQL,
        body="""
SELECT suite_id, min(started_at) AS started_at, max(completed_at) AS completed_at,
       epoch(max(completed_at) - min(started_at)) AS duration_seconds,
       count(*) AS total_tests,
       count(*) FILTER (WHERE status = 'passed') AS passed,
       count(*) FILTER (WHERE status = 'failed') AS failed,
       count(*) FILTER (WHERE status = 'error') AS errors,
       count(*) FILTER (WHERE status = 'skipped') AS skipped,
       CAST(round(100 * CAST(count(*) FILTER (WHERE status = 'passed') AS DECIMAL(20,0)) / count(*), 2) AS DECIMAL(10,2)) AS pass_rate,
       CAST(sum(expected_records) AS BIGINT) AS total_expected_records,
       CAST(sum(records_loaded) AS BIGINT) AS total_records_loaded
FROM suite GROUP BY suite_id""",
    ),
)
def agg_suite_summary(spark, d):
    return O.suite_summary(_suite(C.T(spark, d)), "suite_id", "status", "started_at", "completed_at",
                           "expected_records", "records_loaded")


@query(
    "agg_suite_failures",
    C.with_ctes(
        SUITE_SQL,
        body="SELECT suite_id, l_orderkey, l_linenumber, test_name FROM suite WHERE status <> 'passed'",
    ),
)
def agg_suite_failures(spark, d):
    return O.suite_failures(_suite(C.T(spark, d)), "suite_id", ["l_orderkey", "l_linenumber"], F.col("test_name"), "status")


@query(
    "agg_freshness",
    """
SELECT 'orders' AS table_name, 'active' AS declared, count(*) AS row_count, min(o_orderdate) AS min_date,
       max(o_orderdate) AS max_date, max(o_orderdate) AS last_created, 'healthy' AS health FROM orders
UNION ALL
SELECT 'lineitem', 'active', count(*), min(l_shipdate), max(l_shipdate), CAST(NULL AS TIMESTAMP), 'stale_data' FROM lineitem
UNION ALL
SELECT 'events', 'waiting', count(*), min(ts), max(ts), max(ts), 'waiting_for_data' FROM events
UNION ALL
SELECT 'events_purchase', 'stub', count(*), min(ts), max(ts), max(ts), 'not_implemented'
FROM events WHERE event_type = 'purchase'
UNION ALL
SELECT 'refunds', 'active', count(*), min(ts), max(ts), max(ts), 'needs_sync' FROM events WHERE event_type = 'refund'
UNION ALL
SELECT 'returns', 'active', count(*), min(ts), max(ts), max(ts), 'no_data' FROM events WHERE event_type = 'return'""",
)
def agg_freshness(spark, d):
    t = C.T(spark, d)

    def of(event_type):
        return t.events.filter(F.col("event_type") == event_type)

    return O.freshness(
        {
            "orders": (t.orders, ["o_orderdate"], "o_orderdate"),
            "lineitem": (t.lineitem, ["l_shipdate"], None),
            "events": (t.events, ["ts"], "ts"),
            "events_purchase": (of("purchase"), ["ts"], "ts"),
            "refunds": (of("refund"), ["ts"], "ts"),
            "returns": (of("return"), ["ts"], "ts"),
        },
        {"orders": "active", "lineitem": "active", "events": "waiting", "events_purchase": "stub", "refunds": "active",
         "returns": "active"},
        {"orders": t.customer, "lineitem": of("refund"), "events": t.customer, "refunds": t.orders},
    ).select("table_name", "declared", "row_count", "min_date", "max_date", "last_created", "health")


FETCH_SQL = """fetches AS (
  SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'empty'
                      WHEN 'purchase' THEN 'not_implemented' ELSE 'success' END AS status
  FROM events)"""


@query("agg_endpoint_status", C.with_ctes(FETCH_SQL, body="SELECT status, count(*) AS endpoint_count FROM fetches GROUP BY 1"))
def agg_endpoint_status(spark, d):
    e = C.T(spark, d).events
    et = F.col("event_type")
    f = e.select(
        F.when(et == "error", "error").when(et == "signup", "empty").when(et == "purchase", "not_implemented")
        .otherwise("success").alias("status")
    )
    return O.endpoint_status(f)


@query("agg_distinct", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def agg_distinct(spark, d):
    return O.distinct_values(C.T(spark, d).part, "p_type")


@query(
    "agg_distinct_elements",
    "SELECT DISTINCT w AS value FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w IS NOT NULL AND w <> ''",
)
def agg_distinct_elements(spark, d):
    return O.distinct_elements(C.T(spark, d).part, F.split("p_name", " "))


@query(
    "agg_date_range",
    "SELECT min(CAST(ts AS DATE)) AS min_date, max(CAST(ts AS DATE)) AS max_date, count(*) AS row_count "
    "FROM events WHERE event_type = 'purchase'",
)
def agg_date_range(spark, d):
    e = C.T(spark, d).events.withColumn("d", F.to_date("ts"))
    return O.date_range(e, "d", F.col("event_type") == "purchase")


PATTERNS = {
    # fixed values: the pattern set tested against the conversation texts
    1: "[a-z]+@mail[0-9]+[.]example[.]com",
    2: "^(Et|La|Le) ([a-zé]+)",
    3: "(the|and) ([a-z]+)",
    4: "([a-z",
    5: "",
}


@query(
    "agg_pattern_summary",
    """
WITH tests AS (
  SELECT 1 AS pattern_id, regexp_matches(text, '[a-z]+@mail[0-9]+[.]example[.]com') AS m, TRUE AS v FROM conversations
  UNION ALL SELECT 2, regexp_matches(text, '^(Et|La|Le) ([a-zé]+)'), TRUE FROM conversations
  UNION ALL SELECT 3, regexp_matches(text, '(the|and) ([a-z]+)'), TRUE FROM conversations
  UNION ALL SELECT 4, FALSE, FALSE FROM conversations
  UNION ALL SELECT 5, FALSE, FALSE FROM conversations)
SELECT pattern_id, count(*) AS total, count(*) FILTER (WHERE m) AS matches, count(*) FILTER (WHERE NOT m) AS non_matches,
       CAST(round(100 * CAST(count(*) FILTER (WHERE m) AS DECIMAL(20,0)) / count(*), 1) AS DECIMAL(10,1)) AS match_rate,
       bool_or(NOT v) AS has_errors, bool_and(v) AS all_valid
FROM tests GROUP BY pattern_id""",
)
def agg_pattern_summary(spark, d):
    tests = C.T(spark, d).conversations.select(F.inline(S.regex_tests("text", PATTERNS)))
    return O.pattern_summary(tests, by=["pattern_id"])


@query(
    "agg_job_outcome",
    C.with_ctes(
        C.STEPS_SQL,
        body="""
SELECT jobrunid, bool_or(status = 'failed') AS any_failed, bool_or(status = 'success') AS any_success,
       FALSE AS any_exception,
       CASE WHEN bool_or(status = 'failed') AND bool_or(status = 'success') THEN 'partial'
            WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'success' END AS outcome
FROM steps GROUP BY jobrunid""",
    ),
)
def agg_job_outcome(spark, d):
    return O.job_outcome(C.steps(C.T(spark, d)), "jobrunid", "status")


@query(
    "agg_label_count",
    C.with_ctes(
        C.DATASETS_SQL,
        body=f"SELECT count(*) AS dataset_count FROM datasets WHERE label LIKE '%URGENT%' "
        f"AND createddate >= TIMESTAMP '{OA}' - INTERVAL 365 DAY",
    ),
)
def agg_label_count(spark, d):
    return O.label_count(C.datasets(C.T(spark, d)), "%URGENT%", OA, 365)


# ------------------------------------------------------------------ TOP-*
@query(
    "top_logs",
    C.with_ctes(
        C.LOGS_SQL,
        body="SELECT * FROM logs WHERE processtype = 'GenericImportJob' ORDER BY \"timestamp\" DESC, logentryid DESC LIMIT 20",
    ),
)
def top_logs(spark, d):
    lg = C.logs(C.T(spark, d))
    return O.newest_first(lg, "timestamp", "logentryid", 20, F.col("processtype") == "GenericImportJob")


@query(
    "top_page",
    C.with_ctes(C.RUNS_SQL, body="SELECT * FROM runs ORDER BY started_at DESC, jobrunid ASC LIMIT 20 OFFSET 40"),
)
def top_page(spark, d):
    r = C.runs(C.T(spark, d))
    return O.page(r, [F.col("started_at").desc(), F.col("jobrunid").asc()], 40, 20)


@query(
    "top_queue",
    C.with_ctes(
        C.QUEUE_SQL,
        body="SELECT * FROM queue WHERE status = 'pending' AND retry_count < max_retries "
        "ORDER BY priority, created_at, event_id LIMIT 10",
    ),
)
def top_queue(spark, d):
    return O.queue_pick(C.queue(C.T(spark, d)), 10)


@query("top_run_steps", C.with_ctes(C.STEPS_SQL, body="SELECT * FROM steps WHERE jobrunid = 3"))
def top_run_steps(spark, d):
    return O.run_steps(C.steps(C.T(spark, d)), "jobrunid", 3, ["step_order"])


@query("agg_table_sizes")
def agg_table_sizes(spark, d):
    """AGG-12's rows (from the Parquet footers) and storage size per table, the
    size from the file listing: the part of feed freshness SQL cannot state."""
    from kiln.sources.files import discover_files

    files = discover_files(spark, d, pattern=r"[a-z_]+\.parquet")
    sizes = files.groupBy(F.regexp_extract("file_name", r"^([a-z_]+)\.parquet$", 1).alias("table_name")).agg(
        F.sum("length").alias("size_bytes"), F.count(F.lit(1)).alias("files"))
    t = C.T(spark, d)
    rows = None
    for name in TABLE_NAMES:
        part = getattr(t, name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        rows = part if rows is None else rows.unionByName(part)
    return sizes.join(rows, "table_name", "left")
