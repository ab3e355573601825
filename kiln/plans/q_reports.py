"""SQL-01/02 (user SQL, report templates), UDF-01/04 + AGG-21 (the import
job and its metrics), FEED-10 and SNK-07 queries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln import imports as IM
from kiln import jobs as JB
from kiln.operators import feeds as FD
from kiln.operators import reports as R
from kiln.operators import sinks as K
from kiln.plans import common as C
from kiln.plans.q_streaming import _land_waves
from kiln.plans.registry import query
from kiln.session import path_exists, staging_dir
from kiln.sources import files as FS
from kiln.sources import payloads as PL
from kiln.tables import register_views

ADHOC = """SELECT o_orderstatus, o_orderpriority, count(*) AS orders, max(o_totalprice) AS max_total
FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY o_orderstatus, o_orderpriority"""


@query("sql_adhoc", ADHOC)
def sql_adhoc(spark, d):
    register_views(spark, d)
    return R.run_select(spark, ADHOC)


TEMPLATE = """<h1>Daily status</h1>
{{SQL:SELECT o_orderstatus, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY o_orderstatus}}
<p>Never runs:</p>{{SQL: update orders set o_orderstatus = 'X'}}
{{SQL:SELECT no_such_column FROM orders}}
{{SQL:SELECT c_mktsegment,
        count(*) AS customers,
        max(c_acctbal) AS top_balance
 FROM customer GROUP BY c_mktsegment}}"""


@query(
    "report_blocks",
    r"""
SELECT 1 AS block_no, 'ok' AS status,
       '{"o_orderstatus":"' || o_orderstatus || '","n":"' || format('{:,}', count(*)) || '","latest":"'
       || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') || '"}' AS cells_json
FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 2, 'error', NULL
UNION ALL SELECT 3, 'error', NULL
UNION ALL
SELECT 4, 'ok', '{"c_mktsegment":"' || c_mktsegment || '","customers":"' || format('{:,}', count(*))
       || '","top_balance":"' || format('{:,.2f}', max(c_acctbal)) || '"}'
FROM customer GROUP BY c_mktsegment""",
)
def report_blocks(spark, d):
    register_views(spark, d)
    return R.report_rows(spark, TEMPLATE)


@query(
    "report_export",
    """
SELECT 1 AS block_no, o_orderstatus AS name, CAST(count(*) AS VARCHAR) AS n, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS top
FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT 4, c_mktsegment, CAST(count(*) AS VARCHAR), NULL FROM customer GROUP BY c_mktsegment""",
)
def report_export(spark, d):
    register_views(spark, d)
    paths = R.export_report(spark, TEMPLATE, staging_dir(spark, "report"), "Daily status", "20260101_120000")
    first, last = (spark.read.option("header", True).csv(paths[i]) for i in (1, 4))
    return first.select(F.lit(1).alias("block_no"), F.col("o_orderstatus").alias("name"), "n", F.col("latest").alias("top")).unionByName(
        last.select(F.lit(4).alias("block_no"), F.col("c_mktsegment").alias("name"), F.col("customers").alias("n"),
                    F.lit(None).cast("string").alias("top")))


# ------------------------------------------------------------------ UDF-01/04, AGG-21
def _land_orders_csv(spark, d):
    src = staging_dir(spark, "import_csv")
    o = C.T(spark, d).orders
    # one folder per priority: every file's first record carries its priority
    _land_waves(o.withColumn("_wave", F.col("o_orderpriority")), src, "_wave", fmt="csv", header=True,
                timestampNTZFormat="yyyy-MM-dd HH:mm:ss")
    return src


def _spec(src, target, dataset_id=11):
    return JB.ImportSpec(
        config_name="Orders_Import", source_directory=src, target_path=target, file_type="csv",
        file_pattern=r"part-", strategy=1, label_source="file_content", label_location="o_orderpriority",
        date_source="static", date_location="2026-01-01", dataset_id=dataset_id,
        run_ts="2026-01-01 12:00:00",
    )


@query(
    "import_generic",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
       CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       o_orderpriority, o_orderpriority AS dataset_label, DATE '2026-01-01' AS file_date,
       'etl_user' AS created_by, TIMESTAMP '2026-01-01 12:00:00' AS created_date, 11 AS datasetid
FROM orders""",
)
def import_generic(spark, d):
    src = _land_orders_csv(spark, d)
    target = os.path.join(staging_dir(spark, "import_target"), "orders")
    JB.GenericImport(spark, _spec(src, target)).run()
    return spark.read.parquet(target).drop("source_file")


# ------------------------------------------------------------------ UDF-01: column strategies
STRATEGY_TARGET = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("o_note", T.StringType()),
    T.StructField("datasetid", T.IntegerType()), T.StructField("created_by", T.StringType()),
])


def _import_orders(spark, d, strategy, *halves):
    """Import two CSV folders of orders whose headers differ in order and columns, beside a file of another name."""
    src = staging_dir(spark, f"import_strategy{strategy}")
    o = C.T(spark, d).orders
    for i, columns in enumerate(halves):
        price = F.col("o_totalprice").cast("string")
        if i == 1:  # text that is no price, for the target's numeric column
            price = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(price)
        part = o.filter(F.col("o_orderkey") % 2 == i).withColumn("o_totalprice", price).select(*columns)
        part.write.option("header", True).csv(os.path.join(src, "wanted", f"half={i}"))
    target = os.path.join(staging_dir(spark, f"import_strategy{strategy}_out"), "orders")
    spec = JB.ImportSpec(config_name=f"Orders_{strategy}", source_directory=src, target_path=target, file_pattern=r"part-.*\.csv$",
                         strategy=strategy, target_schema=STRATEGY_TARGET, run_ts="2026-01-01 12:00:00")
    job = JB.GenericImport(spark, spec)
    job.run()
    return spark.read.schema(job.table_schema).parquet(target).drop("source_file", "file_date", "created_date", "dataset_label")


STRATEGY_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice, {status} AS o_orderstatus,
       CAST(NULL AS VARCHAR) AS o_note, {extra} 'etl_user' AS created_by, 1 AS datasetid,
       CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'n/a' END AS bad_price
FROM orders"""


def _bad_price(df):
    return df.withColumn("bad_price", F.col("unfit_values")["o_totalprice"]).drop("unfit_values")


@query("import_strategy1", STRATEGY_SQL.format(
    status="CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END",
    extra="CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS o_orderpriority,"))
def import_strategy1(spark, d):
    return _bad_price(_import_orders(spark, d, 1, ["o_orderkey", "o_totalprice", "o_orderpriority"],
                                     ["o_orderstatus", "o_totalprice", "o_orderkey"]))


@query("import_strategy2", STRATEGY_SQL.format(status="CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END", extra=""))
def import_strategy2(spark, d):
    return _bad_price(_import_orders(spark, d, 2, ["o_orderkey", "o_totalprice", "o_orderpriority"],
                                     ["o_orderstatus", "o_totalprice", "o_orderkey"]))


@query("import_strategy3", STRATEGY_SQL.format(status="o_orderstatus", extra=""))
def import_strategy3(spark, d):
    return _bad_price(_import_orders(spark, d, 3, ["o_orderkey", "o_totalprice", "o_orderstatus"],
                                     ["o_orderstatus", "o_totalprice", "o_orderkey"]))


@query("agg_load_metrics", "SELECT 'Orders_Import' AS config_name, CAST(11 AS BIGINT) AS dataset_id, "
                           "count(DISTINCT o_orderpriority) AS files, count(*) AS extracted, count(*) AS loaded, 'Active' AS status FROM orders")
def agg_load_metrics(spark, d):
    src = _land_orders_csv(spark, d)
    target = os.path.join(staging_dir(spark, "import_metrics"), "orders")
    m = JB.GenericImport(spark, _spec(src, target)).run()
    return JB.metrics_frame(spark, m)


@query("dry_run", "SELECT 'Orders_Import' AS config_name, CAST(11 AS BIGINT) AS dataset_id, "
                  "count(DISTINCT o_orderpriority) AS files, count(*) AS extracted, count(*) AS loaded, 'DryRun' AS status FROM orders")
def dry_run(spark, d):
    src = _land_orders_csv(spark, d)
    target = os.path.join(staging_dir(spark, "import_dry"), "orders")
    m = JB.GenericImport(spark, _spec(src, target)).run(dry_run=True)
    if path_exists(spark, target):
        raise RuntimeError("a dry run wrote data")
    return JB.metrics_frame(spark, m)


# ------------------------------------------------------------------ UDF-01: the whole job, killed and run again
class _KilledAfterWrite(IM.DatasetImport):
    def after_write(self):
        raise InterruptedError("killed after the write")


def _job_runs(spark, d):
    """Two datasets of CSV files; the first run of each is killed after its write, the later runs resume and repeat it."""
    base = staging_dir(spark, "import_job")
    o = C.T(spark, d).orders
    waves = [
        (21, "2026-01-01", ["o_orderkey", "o_totalprice", "o_orderpriority"]),
        (22, "2026-01-02", ["o_orderpriority", "o_orderstatus", "o_orderkey"]),
    ]
    for i, (dataset_id, day, columns) in enumerate(waves):
        part = o.filter(F.col("o_orderkey") % 2 == i).select(*columns)
        part.write.mode("append").option("header", True).partitionBy("o_orderpriority").csv(os.path.join(base, "inbox"))
        spec = JB.ImportSpec(
            config_name="Orders_Job", source_directory=os.path.join(base, "inbox"), target_path=os.path.join(base, "orders"),
            file_pattern=r"part-.*\.csv$", label_location="orders", date_location=day, dataset_id=dataset_id, run_ts=f"{day} 12:00:00")
        folders = (os.path.join(base, "state"), os.path.join(base, "archive"))
        try:
            _KilledAfterWrite(spark, spec, *folders).run()
        except InterruptedError:
            pass
        for _ in range(2):
            job = IM.DatasetImport(spark, spec, *folders)
            job.run()
    return base, job


@query(
    "import_job",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS DECIMAL(12,2)) END AS o_totalprice,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS o_orderstatus, 21 + o_orderkey % 2 AS datasetid FROM orders""",
)
def import_job(spark, d):
    base, job = _job_runs(spark, d)
    return spark.read.schema(job.target_columns_after()).parquet(os.path.join(base, "orders")).select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"),
        "o_orderstatus", F.col("datasetid").cast("bigint").alias("datasetid"))


@query(
    "import_job_ledger",
    """SELECT 21 + o_orderkey % 2 AS datasetid, count(*) AS loaded, 'orders' AS label,
       CASE WHEN o_orderkey % 2 = 0 THEN DATE '2026-01-01' ELSE DATE '2026-01-02' END AS datasetdate,
       o_orderkey % 2 = 1 AS isactive, CASE WHEN o_orderkey % 2 = 1 THEN 'Active' ELSE 'Inactive' END AS status,
       CAST(1 AS BIGINT) AS events, count(*) AS event_records, CAST(0 AS BIGINT) AS files_not_archived
FROM orders GROUP BY o_orderkey % 2""",
)
def import_job_ledger(spark, d):
    base, job = _job_runs(spark, d)
    led = job.ledger
    events = led.read("event", IM.EVENTS).groupBy("datasetid").agg(
        F.count("*").alias("events"), F.sum(F.get_json_object("event_data", "$.records_loaded").cast("bigint")).alias("event_records"))
    archived = FS.discover_files(spark, os.path.join(base, "archive")).select(F.col("file_name").alias("archive_name"))
    moves = led.read("archive", IM.FILES + ", archive_name string")
    left = moves.join(archived.withColumn("there", F.lit(1)), "archive_name", "left").groupBy("datasetid").agg(
        F.count_if(F.col("there").isNull()).alias("files_not_archived"))
    loads = led.read("load", "loaded long").select("datasetid", "loaded")
    return job.datasets().select("datasetid", "label", "datasetdate", "isactive", "status").join(loads, "datasetid").join(
        events, "datasetid").join(left, "datasetid")


# ------------------------------------------------------------------ FEED-10 / SNK-07
@query(
    "feed_passthrough",
    "SELECT CAST(event_id AS VARCHAR) AS seriesId, event_type AS keyId, CAST(value AS VARCHAR) AS value FROM events",
)
def feed_passthrough(spark, d):
    e = C.T(spark, d).events
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("event_id").cast("string").alias("seriesId"), F.col("event_type").alias("keyId"),
        F.col("value").cast("string").alias("value"))).alias("timeseries")).alias("pd")))
    recs = PL.extract_path(e.select(doc.alias("payload")), "payload", "pd.timeseries")
    return FD.passthrough(recs, ["seriesId", "keyId", "value"])


@query("snk_land_json", "SELECT event_id, event_type, value FROM events")
def snk_land_json(spark, d):
    e = C.T(spark, d).events.select("event_id", "event_type", "value")
    base = staging_dir(spark, "landing")
    path = K.land_json(e, base, "newyorkfed", "NewYorkFed_Events_Latest", "20260101_120000")
    if not path.endswith("newyorkfed_events_latest_20260101_120000"):
        raise RuntimeError(f"unexpected landing name {path}")
    return spark.read.schema("event_id long, event_type string, value double").json(path)
