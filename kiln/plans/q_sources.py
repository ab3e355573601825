"""File sources (SRC-01..07, SRC-11): driver tables are landed as files in
a fresh staging folder under the shared checkpoint location, then scanned
back with the library readers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from kiln.operators import schema as P
from kiln.plans import common as C
from kiln.plans.registry import query
from kiln.session import staging_dir
from kiln.sources import files as FS
from kiln.sources import workbooks as WB

ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double", "o_orderdate": "timestamp_ntz",
}


def _typed_orders(df):
    return P.convert(df, ORDER_TYPES).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("src_csv", "SELECT * FROM orders")
def src_csv(spark, d):
    path = staging_dir(spark, "csv")
    o = C.T(spark, d).orders
    (o.write.mode("overwrite").option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .csv(path))
    return _typed_orders(FS.scan_csv(spark, path, pattern=r"part-"))


# records of a landed file that can't be split: such files are read whole or by one task
FILE_ROWS = 20_000


def _json_arrays(most: int):
    """Joins the JSON lines of a partition into JSON arrays of at most ``most`` records."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines: list[str] = []
        for pdf in it:
            lines.extend(pdf["line"].tolist())
            while len(lines) >= most:
                yield pd.DataFrame({"value": ["[" + ",".join(lines[:most]) + "]"]})
                del lines[:most]
        if lines:
            yield pd.DataFrame({"value": ["[" + ",".join(lines) + "]"]})

    return run


def _land_json_arrays(spark, df, name):
    """One array a file."""
    path = staging_dir(spark, name)
    lines = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                                {"timestampFormat": "yyyy-MM-dd HH:mm:ss"}).alias("line"))
    lines.mapInPandas(_json_arrays(FILE_ROWS), "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


@query("src_json_records", "SELECT * FROM orders")
def src_json_records(spark, d):
    o = C.T(spark, d).orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    path = _land_json_arrays(spark, o, "json")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, " \
             "o_orderdate string, o_orderpriority string"
    df = FS.scan_json_records(spark, path, schema=spark.createDataFrame([], schema).schema)
    return _typed_orders(df)


@query("src_json_blob", "SELECT count(*) AS n_records, 'JSON' AS blob_type FROM orders")
def src_json_blob(spark, d):
    o = C.T(spark, d).orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    path = _land_json_arrays(spark, o, "jsonblob")
    b = FS.scan_json_blob(spark, path)
    return b.agg(
        F.sum(F.json_array_length("raw_data")).cast("bigint").alias("n_records"),
        F.max(P.blob_type("raw_data")).alias("blob_type"),
    )


CUSTOMER_TYPES = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}


@query("src_xml_records", "SELECT * FROM customer")
def src_xml_records(spark, d):
    path = staging_dir(spark, "xml")
    c = C.T(spark, d).customer
    c.write.mode("overwrite").format("xml").option("rowTag", "customer").option("rootTag", "customers").save(path)
    df = FS.scan_xml_records(spark, path, "customer")
    return P.convert(df, CUSTOMER_TYPES).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("src_xml_blob", """SELECT count(*) AS records, 0 AS not_well_formed, 0 AS without_records, 0 AS repeated, 0 AS wrong_size
FROM customer""")
def src_xml_blob(spark, d):
    """Every blob is held against its file: one row a file, of the file's size."""
    path = staging_dir(spark, "xmlblob")
    c = C.T(spark, d).customer
    (c.write.mode("overwrite").format("xml").option("rowTag", "customer").option("rootTag", "customers")
     .option("maxRecordsPerFile", FILE_ROWS).save(path))
    blobs = FS.scan_xml_blob(spark, path, row_tag="customer").withColumn("file", F.regexp_extract("_path", C.FOLDER_AND_NAME, 1))
    listed = FS.discover_files(spark, path, pattern="part-").select(
        F.regexp_extract("path", C.FOLDER_AND_NAME, 1).alias("file"), F.col("length").alias("size"))
    return listed.join(blobs, "file", "left").agg(
        F.sum(F.regexp_count("raw_data", F.lit("<customer>"))).alias("records"),
        F.count_if(~F.coalesce("well_formed", F.lit(False))).alias("not_well_formed"),
        F.count_if(~F.coalesce("has_records", F.lit(False))).alias("without_records"),
        (F.count("file") - F.count_distinct("file")).alias("repeated"),
        F.count_if(F.octet_length("raw_data") != F.col("size")).alias("wrong_size"))


@query("src_discover", """SELECT o_orderstatus, count(*) AS records, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS wrong_size FROM orders GROUP BY o_orderstatus""")
def src_discover(spark, d):
    """Every listed file is held against storage: the records read back from it, its size, and that it was listed once."""
    path = staging_dir(spark, "discover")
    o = C.T(spark, d).orders
    o.write.mode("overwrite").partitionBy("o_orderstatus").parquet(path)
    found = FS.discover_files(spark, path, pattern=r"part-[0-9]+").withColumn("file", F.regexp_extract("path", C.FOLDER_AND_NAME, 1))
    return C.held_against_files(found, spark.read.schema(o.schema).parquet(path), "length").groupBy(
        F.regexp_extract("path", "o_orderstatus=([^/]*)/", 1).alias("o_orderstatus")).agg(*C.file_sums())


@query(
    "src_logs",
    """
SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS "timestamp",
       CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
       event_type || ' ' || props AS message,
       CASE WHEN event_type = 'view' THEN 'system' ELSE CAST(user_id AS VARCHAR) END AS run_uuid,
       CASE WHEN event_type IN ('view', 'click') THEN 'system' ELSE 'user' || user_id END AS username,
       CASE WHEN event_type = 'signup' THEN 'kiln.' || event_type ELSE 'Proc_' || event_type END AS processtype,
       CAST(event_id AS VARCHAR) AS stepcounter, value AS stepruntime
FROM events""",
)
def src_logs(spark, d):
    path = staging_dir(spark, "logs")
    e = C.T(spark, d).events
    et = F.col("event_type")
    lines = e.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(et == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("kiln."), et).alias("logger"),
        F.concat(et, F.lit(" "), "props").alias("message"),
        F.when(et != "view", F.col("user_id").cast("string")).alias("run_uuid"),
        F.when(~et.isin("view", "click"), F.concat(F.lit("user"), "user_id")).alias("username"),
        F.when(et != "signup", F.concat(F.lit("Proc_"), et)).alias("processtype"),
        F.col("event_id").cast("string").alias("stepcounter"),
        F.col("value").alias("stepruntime"),
    )
    lines.write.mode("overwrite").json(path)
    return FS.scan_json_logs(spark, path)


@query("src_xlsx", "SELECT * FROM customer")
def src_xlsx(spark, d):
    """Workbooks written by the data source and read as records by their headers."""
    path = staging_dir(spark, "xlsx")
    c = C.T(spark, d).customer
    WB.write_workbooks(c, path, max_rows=FILE_ROWS)
    return P.convert(FS.widen(FS.scan_xlsx(spark, path), c.columns).select(*c.columns), CUSTOMER_TYPES).select(*c.columns)


@query("src_workbooks", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand || chr(1) || '_x0041_ <&> ' || p_type AS marked,
       CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS even_size FROM part""")
def src_workbooks(spark, d):
    """UDF-02: the workbook source as a reader that a user plugs in; texts come back as they were, NULL included."""
    path = staging_dir(spark, "workbooks")
    size = F.col("p_size")
    WB.write_workbooks(C.T(spark, d).part.select(
        "p_partkey", "p_name", F.concat("p_brand", F.lit("\x01_x0041_ <&> "), "p_type").alias("marked"),
        F.when(size % 2 == 0, size).alias("even_size")), path)
    FS.register_reader("workbooks", WB.scan_workbooks)
    return FS.read(spark, "workbooks", path).drop("file_path", "row_number", "file_name")
