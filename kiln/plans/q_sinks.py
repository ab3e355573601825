"""SNK-* queries: writes go to fresh staging folders under the shared
checkpoint location and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kiln.operators import sinks as K
from kiln.plans import common as C
from kiln.plans.registry import query
from kiln.session import staging_dir

EA = C.EVENTS_AS_OF


@query("snk_append", "SELECT *, 7 AS datasetid FROM orders")
def snk_append(spark, d):
    path = staging_dir(spark, "append")
    o = C.T(spark, d).orders
    n = K.append_dataset(o, path, 7)
    back = spark.read.parquet(path)
    if n != back.count():  # the observed count of the write is the loaded count
        raise RuntimeError(f"observed {n} rows but {back.count()} were readable")
    return back


UPSERT_SQL = """
WITH src AS (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, upper(c_mktsegment) AS c_mktsegment
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  UNION ALL
  SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0)
SELECT COALESCE(t.c_custkey, s.c_custkey) AS c_custkey,
       CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name,
       CASE WHEN t.c_custkey IS NOT NULL THEN t.c_nationkey ELSE s.c_nationkey END AS c_nationkey,
       CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
       CASE WHEN s.c_custkey IS NOT NULL THEN s.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment
FROM (SELECT * REPLACE (CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS c_nationkey) FROM customer) t
FULL OUTER JOIN src s ON t.c_custkey = s.c_custkey"""


def _upsert_source(c):
    changed = c.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(
        "c_custkey", "c_name", "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"),
        F.upper("c_mktsegment").alias("c_mktsegment"))
    new = c.filter(F.col("c_acctbal") < 0).select(
        (F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return changed.unionByName(new)


@query("snk_upsert", UPSERT_SQL)
def snk_upsert(spark, d):
    c = C.T(spark, d).customer
    held = c.withColumn("c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")))  # NULLs an upsert must keep
    merged = K.upsert(held, _upsert_source(c), ["c_custkey"], update_cols=["c_name", "c_acctbal", "c_mktsegment"])
    path = K.write_new_version(merged, staging_dir(spark, "upsert"), uuid.uuid4().hex[:8])
    return spark.read.parquet(path)


MERGE_BUCKETS = 16


@query(
    "snk_merge",
    """
WITH t AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS c_nationkey, c_acctbal FROM customer),
s AS (SELECT c_custkey, 'changed ' || c_name AS c_name, NULL AS c_nationkey, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END AS c_acctbal
      FROM customer WHERE c_custkey % 16 IN (3, 7) AND c_custkey % 3 = 0
      UNION ALL SELECT c_custkey + 1600000, c_name, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 16 = 3 AND c_acctbal < 0)
SELECT COALESCE(t.c_custkey, s.c_custkey) AS c_custkey,
       CASE WHEN s.c_custkey IS NOT NULL THEN s.c_name ELSE t.c_name END AS c_name,
       CASE WHEN t.c_custkey IS NOT NULL THEN t.c_nationkey ELSE s.c_nationkey END AS c_nationkey,
       CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
       COALESCE(t.c_custkey, s.c_custkey) % 16 IN (3, 7) AS rewritten
FROM t FULL OUTER JOIN s ON t.c_custkey = s.c_custkey""",
)
def snk_merge(spark, d):
    """A merge that touches two of sixteen partitions; ``rewritten``: the row's file is new."""
    c = C.T(spark, d).customer
    path = staging_dir(spark, "merge_target")
    bucket = F.col("c_custkey") % MERGE_BUCKETS
    held = c.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("c_nationkey"), "c_acctbal",
                    bucket.alias("bucket"))
    held.write.mode("overwrite").partitionBy("bucket").parquet(path)
    before = materialised_files(spark, path)
    mine = c.filter(bucket.isin(3, 7))
    changed = mine.filter(F.col("c_custkey") % 3 == 0).select(
        "c_custkey", F.concat(F.lit("changed "), "c_name").alias("c_name"), F.lit(None).cast("int").alias("c_nationkey"),
        F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"))
    new = mine.filter((bucket == 3) & (F.col("c_acctbal") < 0)).select(
        (F.col("c_custkey") + 1600000).alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal")
    K.merge_partitions(spark, path, changed.unionByName(new), ["c_custkey"], "bucket", bucket, update_cols=["c_name", "c_acctbal"])
    after = spark.read.parquet(path).withColumn("file", F.regexp_extract("_metadata.file_path", C.FOLDER_AND_NAME, 1))
    return after.join(before.withColumn("held", F.lit(True)), "file", "left").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", F.col("held").isNull().alias("rewritten"))


def materialised_files(spark, path):
    """Folder and name of a stored table's files now, kept apart from later changes of it."""
    out = staging_dir(spark, "files")
    spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select(
        F.regexp_extract("path", C.FOLDER_AND_NAME, 1).alias("file")).write.mode("overwrite").parquet(out)
    return spark.read.schema("file string").parquet(out)


@query(
    "snk_insert_ignore",
    """
SELECT s.* FROM (
  SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, upper(c_mktsegment) AS c_mktsegment
  FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
  UNION ALL
  SELECT c_custkey + 1000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal < 0) s
WHERE s.c_custkey NOT IN (SELECT c_custkey FROM customer)""",
)
def snk_insert_ignore(spark, d):
    c = C.T(spark, d).customer
    return K.insert_ignore(c, _upsert_source(c), ["c_custkey"])


@query(
    "snk_create",
    """
SELECT * FROM (VALUES (1, 'id', 'bigint'), (2, 'datasetid', 'bigint'), (3, 'col_2nd_flag', 'boolean'),
                      (4, 'l_extendedprice', 'decimal(12,2)'), (5, 'l_orderkey', 'int'), (6, 'l_quantity', 'int'),
                      (7, 'l_shipdate', 'string'), (8, 'created_date', 'timestamp_ntz'), (9, 'created_by', 'string'),
                      (10, 'modified_date', 'timestamp_ntz'), (11, 'modified_by', 'string'))
  t(position, column_name, data_type)""",
)
def snk_create(spark, d):
    li = C.T(spark, d).lineitem
    sample = li.select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.col("l_quantity").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("string").alias("l_extendedprice"),
        F.col("l_shipdate").cast("string").alias("l_shipdate"),
        F.when(F.col("l_returnflag") == "R", "t").otherwise("f").alias("2nd Flag"),
    )
    return K.schema_rows(spark, K.table_schema_from_sample(sample))


@query(
    "snk_add_column",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS VARCHAR) AS source_system, "
    "CAST(NULL AS VARCHAR) AS col_2024_flag FROM customer",
)
def snk_add_column(spark, d):
    c = C.T(spark, d).customer
    name = f"kiln_customer_{uuid.uuid4().hex[:8]}"
    path = staging_dir(spark, "table")
    c.write.mode("overwrite").parquet(path)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    try:
        K.add_columns(spark, name, ["Source System", "c_name", "2024 flag"])
        return spark.read.schema(spark.table(name).schema).parquet(path)
    finally:
        spark.sql(f"DROP TABLE {name}")  # its files stay under the path


@query(
    "snk_csv_lines",
    C.with_ctes(
        C.LOGS_SQL,
        body="""SELECT CAST(logentryid AS VARCHAR) || ',' || strftime("timestamp", '%Y-%m-%d %H:%M:%S.%f') || ',' ||
       '"' || replace(message, '"', '""') || '"' AS csv_line FROM logs""",
    ),
)
def snk_csv_lines(spark, d):
    lg = C.logs(C.T(spark, d)).select(
        "logentryid", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "message")
    return K.csv_line(lg, quote_cols=["message"])


@query(
    "snk_archive_names",
    """
SELECT o_orderkey, file_name,
       CASE WHEN n = 0 THEN file_name ELSE regexp_replace(file_name, '\\.[^.]*$', '') || '_' || n || '.csv' END AS archive_name
FROM (SELECT o_orderkey, 'report_' || replace(o_orderpriority, ' ', '') || '.csv' AS file_name,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS n FROM orders)""",
)
def snk_archive_names(spark, d):
    o = C.T(spark, d).orders
    files = o.select("o_orderkey", F.concat(F.lit("report_"), F.replace("o_orderpriority", F.lit(" "), F.lit("")),
                                            F.lit(".csv")).alias("file_name"))
    # chunks of keys keep a file name shared by many files spread over tasks
    return K.archive_names(files, "file_name", ["o_orderkey"], F.floor(F.col("o_orderkey") / K.ARCHIVE_CHUNK))


@query(
    "snk_purge_preview",
    f"""SELECT count(*) AS rows_to_purge, min(ts) AS oldest, max(ts) AS newest FROM events
WHERE ts < TIMESTAMP '{EA}' - INTERVAL 20 DAY""",
)
def snk_purge_preview(spark, d):
    return K.purge_preview(C.T(spark, d).events, "ts", 20, EA)


@query("snk_purge_kept", f"SELECT * FROM events WHERE ts >= TIMESTAMP '{EA}' - INTERVAL 20 DAY")
def snk_purge_kept(spark, d):
    kept, _ = K.purge_split(C.T(spark, d).events, "ts", 20, EA)
    return kept


@query(
    "snk_purge_partitions",
    f"""SELECT *, ts < TIMESTAMP '{EA}' - INTERVAL 468 HOUR AS purged,
       ts >= TIMESTAMP '{EA}' - INTERVAL 468 HOUR AND CAST(ts AS DATE) > CAST(TIMESTAMP '{EA}' - INTERVAL 468 HOUR AS DATE) AS untouched
FROM events""",
)
def snk_purge_partitions(spark, d):
    """Retention of 20 days before noon on a table by day: exported rows, and kept ones with whether their file is still the old one."""
    base = staging_dir(spark, "retention")
    path = f"{base}/events"
    C.T(spark, d).events.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    before = materialised_files(spark, path)
    as_of = "2024-01-31 12:00:00"
    done = K.drop_old_partitions(spark, path, "ts", "day", 20, as_of, f"{base}/archive")
    kept = spark.read.parquet(path).withColumn("file", F.regexp_extract("_metadata.file_path", C.FOLDER_AND_NAME, 1)).join(
        before.withColumn("held", F.lit(True)), "file", "left")
    schema = spark.read.parquet(path).schema
    old = spark.read.schema(schema).option("header", True).option("escape", '"').csv(done["export"])
    return kept.drop("file", "day").withColumn("untouched", F.coalesce("held", F.lit(False))).drop("held").withColumn(
        "purged", F.lit(False)).unionByName(old.drop("day").withColumns({"untouched": F.lit(False), "purged": F.lit(True)}))


@query(
    "snk_export_csv",
    C.with_ctes(
        C.LOGS_SQL,
        body="""SELECT CAST(logentryid AS VARCHAR) AS logentryid, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
       processtype, message FROM logs""",
    ),
)
def snk_export_csv(spark, d):
    lg = C.logs(C.T(spark, d)).select("logentryid", F.date_trunc("second", "timestamp").cast("timestamp_ntz").alias("timestamp"),
                                      "processtype", "message")
    base = staging_dir(spark, "export")
    path = K.export_csv(lg, base, "Log Export: events/all", "20260101_120000")
    if not path.endswith("Log_Export__events_all_20260101_120000"):
        raise RuntimeError(f"unexpected export name {path}")
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@query(
    "snk_unprocessed",
    """SELECT 'order_' || o_orderkey || '.csv' AS file_name FROM orders WHERE o_orderstatus <> 'F'""",
)
def snk_unprocessed(spark, d):
    o = C.T(spark, d).orders
    landed = o.select(F.concat(F.lit("order_"), "o_orderkey", F.lit(".csv")).alias("file_name"))
    ledger = o.filter(F.col("o_orderstatus") == "F").select(
        F.concat(F.lit("order_"), "o_orderkey", F.lit(".csv")).alias("file_name"))
    return K.unprocessed(landed, ledger)


@query("snk_truncate", "SELECT * FROM customer WHERE c_custkey IS NULL AND c_custkey IS NOT NULL")
def snk_truncate(spark, d):
    path = staging_dir(spark, "truncate")
    C.T(spark, d).customer.write.mode("overwrite").parquet(path)
    K.truncate_path(spark, path)
    return spark.read.parquet(path)
