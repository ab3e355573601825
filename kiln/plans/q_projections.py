"""PRJ-* queries: names, inference, alignment, conversion, patching."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import scalars as S
from kiln.operators import schema as P
from kiln.plans import common as C
from kiln.plans.registry import query


@query(
    "prj_sanitize",
    r"""
WITH n AS (SELECT p_partkey, p_size || ' ' || p_name || '-' || p_brand || ' (' || p_type || ')' AS raw FROM part),
s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(raw), '[^\pL\pN_]', '_', 'g'), '_+', '_', 'g'), '_') AS c FROM n)
SELECT p_partkey, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'col_' || c ELSE c END AS column_name FROM s""",
)
def prj_sanitize(spark, d):
    p = C.T(spark, d).part
    raw = F.concat_ws("", F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit("-"), "p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return p.select("p_partkey", S.sanitize_name_expr(raw).alias("column_name"))


INFER_SQL = r"""
WITH s AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_quantity AS VARCHAR) AS l_quantity,
         CAST(l_extendedprice AS VARCHAR) AS l_extendedprice, l_returnflag,
         CASE WHEN l_returnflag = 'R' THEN 'true' WHEN l_returnflag = 'N' THEN 'f' ELSE '' END AS l_flag,
         CAST(l_shipdate AS VARCHAR) AS l_shipdate, CAST(l_orderkey * 1000000 AS VARCHAR) AS big_key,
         repeat('x', CAST(l_linenumber * 20 AS INTEGER)) AS l_comment,
         CASE WHEN l_linenumber = 1 THEN '  ' ELSE '' END AS l_blank, '' AS l_empty
  FROM lineitem),
u AS (UNPIVOT s ON COLUMNS(*) INTO NAME column_name VALUE v),
t AS (SELECT column_name, trim(v) AS v FROM u WHERE v IS NOT NULL AND v <> ''),
c AS (SELECT column_name, v,
             lower(v) IN ('true','false','t','f') AS is_bool,
             CASE WHEN lower(v) IN ('true','false','t','f') THEN NULL ELSE TRY_CAST(v AS DOUBLE) END AS num FROM t),
a AS (SELECT column_name,
             bool_or(is_bool) AS b,
             bool_or(num IS NOT NULL AND NOT isnan(num) AND NOT isinf(num) AND num = floor(num)) AS i,
             bool_or(num IS NOT NULL AND NOT (NOT isnan(num) AND NOT isinf(num) AND num = floor(num))) AS f,
             max(CASE WHEN regexp_full_match(v, '-?[0-9]+') THEN abs(CAST(v AS DECIMAL(38,0))) END) AS m,
             max(length(v)) AS l
      FROM c GROUP BY column_name),
names AS (SELECT unnest(['l_orderkey','l_quantity','l_extendedprice','l_returnflag','l_flag','l_shipdate','big_key',
                         'l_comment','l_blank','l_empty']) AS column_name)
SELECT n.column_name,
  CASE WHEN a.column_name IS NULL THEN 'TEXT'
       WHEN COALESCE(b, FALSE) AND NOT COALESCE(i, FALSE) AND NOT COALESCE(f, FALSE) THEN 'BOOLEAN'
       WHEN COALESCE(f, FALSE) THEN 'NUMERIC(12,2)'
       WHEN COALESCE(i, FALSE) THEN CASE WHEN COALESCE(m, 0) > 2147483647 THEN 'BIGINT' ELSE 'INTEGER' END
       WHEN COALESCE(l, 0) <= 50 THEN 'VARCHAR(50)'
       WHEN COALESCE(l, 0) <= 100 THEN 'VARCHAR(100)'
       WHEN COALESCE(l, 0) <= 255 THEN 'VARCHAR(255)'
       ELSE 'TEXT' END AS inferred_type
FROM names n LEFT JOIN a USING (column_name)"""


@query("prj_infer_types", INFER_SQL)
def prj_infer_types(spark, d):
    li = C.TW(spark, d).lineitem
    s = li.select(
        F.col("l_orderkey").cast("string").alias("l_orderkey"),
        F.col("l_quantity").cast("string").alias("l_quantity"),
        F.col("l_extendedprice").cast("string").alias("l_extendedprice"),
        "l_returnflag",
        F.when(F.col("l_returnflag") == "R", "true").when(F.col("l_returnflag") == "N", "f").otherwise("").alias("l_flag"),
        F.col("l_shipdate").cast("string").alias("l_shipdate"),
        (F.col("l_orderkey") * 1000000).cast("string").alias("big_key"),
        F.repeat(F.lit("x"), F.col("l_linenumber") * 20).alias("l_comment"),
        F.when(F.col("l_linenumber") == 1, "  ").otherwise("").alias("l_blank"),
        F.lit("").alias("l_empty"),
    )
    return P.infer_types(s)


@query(
    "prj_blob_type",
    """
SELECT 'events' AS source, event_id AS id,
       CASE WHEN (starts_with(ltrim(props), '{') OR starts_with(ltrim(props), '[')) AND json_valid(props) THEN 'JSON'
            WHEN starts_with(ltrim(props), '<?xml') THEN 'XML' ELSE 'TEXT' END AS blob_type FROM events
UNION ALL
SELECT 'pages', page_id,
       CASE WHEN (starts_with(ltrim(html), '{') OR starts_with(ltrim(html), '[')) AND json_valid(html) THEN 'JSON'
            WHEN starts_with(ltrim(html), '<?xml') THEN 'XML' ELSE 'TEXT' END FROM pages""",
)
def prj_blob_type(spark, d):
    t = C.T(spark, d)
    a = t.events.select(F.lit("events").alias("source"), F.col("event_id").alias("id"), P.blob_type("props").alias("blob_type"))
    b = t.pages.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), P.blob_type("html").alias("blob_type"))
    return a.unionByName(b)


def _strategy_source(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment", F.lower("c_mktsegment").alias("segment_code"))


@query(
    "prj_strategy1",
    """SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment,
              lower(c_mktsegment) AS segment_code FROM customer""",
)
def prj_strategy1(spark, d):
    t = C.T(spark, d)
    rows, _ = P.align_auto_add(_strategy_source(t), t.customer.schema)
    return rows


@query(
    "prj_strategy2",
    """SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment
       FROM customer""",
)
def prj_strategy2(spark, d):
    t = C.T(spark, d)
    return P.align_ignore_extra(_strategy_source(t), t.customer.schema)


@query(
    "prj_strategy3",
    """SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment
       FROM customer""",
)
def prj_strategy3(spark, d):
    t = C.T(spark, d)
    return P.align_strict(_strategy_source(t).drop("segment_code"), t.customer.schema)


@query(
    "prj_nested_json",
    "SELECT vec_id, label, len(embedding) AS n_values, TRUE AS roundtrip_ok FROM embeddings",
)
def prj_nested_json(spark, d):
    e = C.T(spark, d).embeddings
    j = P.nested_to_json(e)
    back = F.from_json("embedding", "array<float>")
    return j.join(e.select("vec_id", F.col("embedding").alias("orig")), "vec_id").select(
        "vec_id", "label", F.json_array_length("embedding").cast("bigint").alias("n_values"),
        F.coalesce(back == F.col("orig"), F.lit(False)).alias("roundtrip_ok"),
    )


@query(
    "prj_audit",
    "SELECT o_orderkey, 'etl_user' AS created_by, TIMESTAMP '2026-01-01 12:00:00' AS created_date, "
    "'etl_user' AS modified_by, TIMESTAMP '2026-01-01 12:00:00' AS modified_date FROM orders",
)
def prj_audit(spark, d):
    o = C.T(spark, d).orders.select("o_orderkey")
    return P.add_audit(o, "etl_user", "2026-01-01 12:00:00", with_modified=True)


FILES_SQL = """files AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'F' THEN 'Strategy1_' || replace(substr(o_orderpriority, 3), ' ', '') || '_'
              ELSE replace(substr(o_orderpriority, 3), ' ', '') || '_' END
         || strftime(o_orderdate, '%Y%m%d') || 'T' || '120000' || '.csv' AS file_name
  FROM orders)"""


def _files(t):
    o = t.orders
    tail = F.concat(F.replace(F.substring("o_orderpriority", 3, 100), F.lit(" "), F.lit("")), F.lit("_"))
    head = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Strategy1_"), tail)).otherwise(tail)
    return o.select("o_orderkey", F.concat(head, F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T120000.csv")).alias("file_name"))


@query(
    "prj_file_label",
    C.with_ctes(
        FILES_SQL,
        body="""SELECT o_orderkey, COALESCE(NULLIF(string_split(regexp_replace(file_name, '\\.[^.]*$', ''), '_')[1], ''),
                 regexp_replace(file_name, '\\.[^.]*$', '')) AS label,
       COALESCE(string_split(regexp_replace(file_name, '\\.[^.]*$', ''), '_')[5],
                regexp_replace(file_name, '\\.[^.]*$', '')) AS label_out_of_range
FROM files""",
    ),
)
def prj_file_label(spark, d):
    f = _files(C.T(spark, d))
    return f.select("o_orderkey", P.label_from_name("file_name", 0).alias("label"),
                    P.label_from_name("file_name", 4).alias("label_out_of_range"))


@query(
    "prj_file_date",
    C.with_ctes(
        FILES_SQL,
        body="""SELECT o_orderkey,
       COALESCE(CAST(try_strptime(string_split(regexp_replace(file_name, '\\.[^.]*$', ''), '_')[2], '%Y%m%dT%H%M%S') AS DATE),
                DATE '2026-01-01') AS file_date
FROM files""",
    ),
)
def prj_file_date(spark, d):
    f = _files(C.T(spark, d))
    return f.select("o_orderkey", P.date_from_name("file_name", 1, "yyyyMMddTHHmmss", "2026-01-01").alias("file_date"))


@query("prj_rename", "SELECT p_partkey AS part_id, p_name AS title, p_brand, p_type AS object_type, p_size, p_retailprice FROM part")
def prj_rename(spark, d):
    p = C.T(spark, d).part
    return P.rename(p, {"p_partkey": "part_id", "p_name": "title", "p_type": "object_type", "missing": "ignored"})


@query(
    "prj_convert",
    """
SELECT event_id, TRY_CAST(v AS DOUBLE) AS value, CASE WHEN TRY_CAST(v AS DOUBLE) IS NULL THEN v END AS value__raw,
       CAST(try_strptime(dt, '%Y-%m-%d') AS DATE) AS day, CASE WHEN try_strptime(dt, '%Y-%m-%d') IS NULL THEN dt END AS day__raw
FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS v,
             CASE WHEN event_id % 17 = 0 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS dt FROM events)""",
)
def prj_convert(spark, d):
    e = C.T(spark, d).events
    s = e.select(
        "event_id",
        F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.when(F.col("event_id") % 17 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
    )
    return P.convert(s, {"value": "double", "day": lambda c: S.parse_date(c)})


@query("prj_filter", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
def prj_filter(spark, d):
    li = C.T(spark, d).lineitem
    return P.filter_records(li, (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))


@query(
    "prj_optional_filters",
    "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1999-06-01'",
)
def prj_optional_filters(spark, d):
    o = C.T(spark, d).orders
    return P.optional_filters(
        o,
        status=F.col("o_orderstatus") == "O",
        since=F.col("o_orderdate") >= F.lit("1999-06-01").cast("timestamp_ntz"),
        job_name=None,
    )


@query(
    "prj_patch",
    """
SELECT c.c_custkey, COALESCE(ch.c_name, c.c_name) AS c_name, c.c_nationkey,
       COALESCE(ch.c_acctbal, c.c_acctbal) AS c_acctbal, c.c_mktsegment
FROM customer c LEFT JOIN (
  SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN upper(c_name) END AS c_name,
         CASE WHEN c_nationkey < 10 THEN c_acctbal + 100 END AS c_acctbal FROM customer WHERE c_mktsegment <> 'AUTOMOBILE') ch
ON ch.c_custkey = c.c_custkey""",
)
def prj_patch(spark, d):
    c = C.T(spark, d).customer
    changes = c.filter(F.col("c_mktsegment") != "AUTOMOBILE").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 5000, F.upper("c_name")).alias("c_name"),
        F.when(F.col("c_nationkey") < 10, F.col("c_acctbal") + 100).alias("c_acctbal"),
    )
    return P.patch(c, changes, "c_custkey")

