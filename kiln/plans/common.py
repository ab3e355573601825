"""Rebinding of the reference's operational tables onto the driver tables.

Each stand-in exists twice: as a Spark frame (used by the queries) and as
DuckDB SQL text (used by the oracles), written independently so the two
sides check each other.  Every stand-in is a per-row projection of a driver
table, so its size grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.tables import Tables

# Fixed "now" for every look-back (the reference uses NOW(); we pass it in).
EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-09-01 00:00:00"


def T(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


def TW(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables of CPU-heavy row-local queries; their scans are as wide as the splits."""
    return Tables(spark, sf_dir)


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table of few bytes over all tasks, for work that costs milliseconds a row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


# ------------------------------------------------------------------ logs
def logs(t: Tables) -> DataFrame:
    """Log entries: one per event."""
    e = t.events
    return e.select(
        F.col("event_id").alias("logentryid"),
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("run_uuid"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("WebCollector"))
        .otherwise(F.lit("GenericImportJob"))
        .alias("processtype"),
        F.when(F.col("event_id") % 7 == 0, F.lit(None))
        .otherwise(F.col("value"))
        .cast("decimal(12,2)")
        .alias("stepruntime"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR "), F.col("props")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("Load COMPLETE "), F.col("props")))
        .when(F.col("event_type") == "signup", F.lit("signup completed successfully"))
        .otherwise(F.concat(F.upper(F.col("event_type")), F.lit(" "), F.col("props")))
        .alias("message"),
    )


LOGS_SQL = """logs AS (
  SELECT event_id AS logentryid, ts AS "timestamp", user_id AS run_uuid,
         CASE WHEN event_type IN ('view','click') THEN 'WebCollector' ELSE 'GenericImportJob' END AS processtype,
         CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS DECIMAL(12,2)) AS stepruntime,
         CASE event_type WHEN 'error' THEN 'ERROR ' || props
                         WHEN 'purchase' THEN 'Load COMPLETE ' || props
                         WHEN 'signup' THEN 'signup completed successfully'
                         ELSE upper(event_type) || ' ' || props END AS message
  FROM events)"""


# ------------------------------------------------------------------ job runs / steps
def runs(t: Tables) -> DataFrame:
    o = t.orders
    secs = F.pmod(F.floor("o_totalprice"), F.lit(86400))
    return o.select(
        F.col("o_orderkey").alias("jobrunid"),
        F.concat(F.lit("job_"), F.col("o_orderpriority")).alias("job_name"),
        F.col("o_orderdate").alias("started_at"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None))
        .otherwise(F.timestamp_add("SECOND", secs, F.col("o_orderdate")))
        .alias("completed_at"),
        F.when(F.col("o_orderstatus") == "F", F.lit("success"))
        .when(F.col("o_orderstatus") == "O", F.lit("running"))
        .otherwise(F.lit("partial"))
        .alias("status"),
    )


RUNS_SQL = """runs AS (
  SELECT o_orderkey AS jobrunid, 'job_' || o_orderpriority AS job_name, o_orderdate AS started_at,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT) % 86400) END AS completed_at,
         CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'partial' END AS status
  FROM orders)"""


def steps(t: Tables) -> DataFrame:
    li = t.lineitem
    return li.select(
        F.col("l_orderkey").alias("jobrunid"),
        F.col("l_linenumber").alias("step_order"),
        F.col("l_shipdate").alias("completed_at"),
        F.when(F.col("l_returnflag") == "N", F.lit("success"))
        .when(F.col("l_returnflag") == "R", F.lit("failed"))
        .otherwise(F.lit("skipped"))
        .alias("status"),
    )


STEPS_SQL = """steps AS (
  SELECT l_orderkey AS jobrunid, l_linenumber AS step_order, l_shipdate AS completed_at,
         CASE l_returnflag WHEN 'N' THEN 'success' WHEN 'R' THEN 'failed' ELSE 'skipped' END AS status
  FROM lineitem)"""


# ------------------------------------------------------------------ datasets
def datasets(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(
        F.col("o_orderkey").alias("datasetid"),
        F.col("o_orderkey").alias("seq"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_orderstatus").alias("datasettype"),
        (F.col("o_custkey") % 5).alias("datasource"),
        F.col("o_orderdate").cast("date").alias("datasetdate"),
        F.col("o_orderdate").alias("createddate"),
        (F.col("o_orderkey") % 7 != 0).alias("activated"),
    )


DATASETS_SQL = """datasets AS (
  SELECT o_orderkey AS datasetid, o_orderkey AS seq, o_orderpriority AS label,
         o_orderstatus AS datasettype, o_custkey % 5 AS datasource,
         CAST(o_orderdate AS DATE) AS datasetdate, o_orderdate AS createddate,
         (o_orderkey % 7 <> 0) AS activated
  FROM orders)"""


# ------------------------------------------------------------------ event queue
def queue(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        F.col("event_id"),
        F.col("event_type"),
        F.col("ts").alias("created_at"),
        F.col("user_id"),
        F.when(F.col("event_type") == "view", F.lit("pending"))
        .when(F.col("event_type") == "click", F.lit("processing"))
        .when(F.col("event_type") == "purchase", F.lit("completed"))
        .when(F.col("event_type") == "error", F.lit("failed"))
        .otherwise(F.lit("cancelled"))
        .alias("status"),
        (F.lit(1) + F.col("event_id") % 10).alias("priority"),
        (F.col("event_id") % 5).alias("retry_count"),
        F.lit(3).alias("max_retries"),
    )


QUEUE_SQL = """queue AS (
  SELECT event_id, event_type, ts AS created_at, user_id,
         CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing'
              WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status,
         1 + event_id % 10 AS priority, event_id % 5 AS retry_count, 3 AS max_retries
  FROM events)"""


# ------------------------------------------------------------------ listings held against their files
FOLDER_AND_NAME = r"([^/]*/[^/]*)$"  # a partitioned write uses one file name in several folders


def held_against_files(listed: DataFrame, stored: DataFrame, size: str) -> DataFrame:
    """Each listed file (``file``: folder and name) with the rows read back from it and its size on storage."""
    back = stored.select(F.regexp_extract("_metadata.file_path", FOLDER_AND_NAME, 1).alias("file"), F.col("_metadata.file_size").alias("_size"))
    back = back.groupBy("file").agg(F.count("*").alias("_rows"), F.max("_size").alias("_size"))
    return listed.join(back, "file", "left").withColumn("_wrong", F.coalesce(F.col(size) != F.col("_size"), F.lit(True)))


def file_sums() -> list:
    """Records read back, files listed more than once, and files whose size is wrong or unknown."""
    return [F.sum("_rows").alias("records"), (F.count("file") - F.count_distinct("file")).alias("repeated"),
            F.count_if("_wrong").alias("wrong_size")]


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
