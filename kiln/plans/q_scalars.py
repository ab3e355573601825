"""SCL-* scalar functions applied over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.functions import scalars as S
from kiln.plans import common as C
from kiln.plans.registry import query

OA = C.ORDERS_AS_OF


def _date_text(e):
    return (
        F.when(F.col("event_id") % 11 == 0, F.lit(""))
        .when(F.col("event_id") % 13 == 0, F.lit("2024-13-45"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )


@query(
    "scl_parse_date",
    """
SELECT event_id, CAST(try_strptime(NULLIF(s, ''), '%Y-%m-%d') AS DATE) AS parsed
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '2024-13-45'
                            ELSE strftime(ts, '%Y-%m-%d') END AS s FROM events)""",
)
def scl_parse_date(spark, d):
    e = C.T(spark, d).events
    return e.select("event_id", S.parse_date(_date_text(e)).alias("parsed"))


@query(
    "scl_parse_numeric",
    """
SELECT l_orderkey, l_linenumber,
       TRY_CAST(replace(CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE format('{:,.2f}', l_extendedprice) END, ',', '') AS DOUBLE) AS amount
FROM lineitem""",
)
def scl_parse_numeric(spark, d):
    li = C.T(spark, d).lineitem
    txt = F.when(F.col("l_linenumber") == 7, F.lit("n/a")).otherwise(F.format_number("l_extendedprice", 2))
    return li.select("l_orderkey", "l_linenumber", S.parse_numeric(txt).alias("amount"))


@query(
    "scl_safe_num",
    """
SELECT event_id,
       CAST(CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 7 END AS DECIMAL(18,6)) AS safe_float,
       CAST(trunc(CASE WHEN event_id % 9 = 0 THEN NULL ELSE value * 3 END) AS BIGINT) AS safe_int
FROM events""",
)
def scl_safe_num(spark, d):
    e = C.T(spark, d).events
    nan = F.lit(float("nan"))
    v = F.when(F.col("event_id") % 9 == 0, nan).otherwise(F.col("value"))
    return e.select("event_id", S.safe_float(v / 7).alias("safe_float"), S.safe_int(v * 3).alias("safe_int"))


@query(
    "scl_term_days",
    """
SELECT l_orderkey, l_linenumber, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS term_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def scl_term_days(spark, d):
    t = C.T(spark, d)
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", S.term_days("l_shipdate", "o_orderdate").alias("term_days"))


@query(
    "scl_duration",
    C.with_ctes(
        C.RUNS_SQL,
        body=f"SELECT jobrunid, epoch(COALESCE(completed_at, TIMESTAMP '{OA}') - started_at) AS duration_seconds FROM runs",
    ),
)
def scl_duration(spark, d):
    r = C.runs(C.T(spark, d))
    return r.select("jobrunid", S.duration_seconds("started_at", "completed_at", OA).alias("duration_seconds"))


@query(
    "scl_format_duration",
    C.with_ctes(
        C.RUNS_SQL,
        body="""
SELECT jobrunid,
  CASE WHEN s IS NULL OR s < 0 THEN 'N/A'
       WHEN s < 60 THEN printf('%.1fs', s)
       WHEN s < 3600 THEN printf('%dm %ds', CAST(floor(s / 60) AS BIGINT), CAST(floor(s) AS BIGINT) % 60)
       ELSE printf('%dh %dm', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT)) END AS duration_text
FROM (SELECT jobrunid, epoch(completed_at - started_at) AS s FROM runs)""",
    ),
)
def scl_format_duration(spark, d):
    r = C.runs(C.T(spark, d))
    s = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return r.select("jobrunid", S.format_duration(s).alias("duration_text"))


@query(
    "scl_truncate",
    "SELECT conv_id, turn, CASE WHEN length(text) > 50 THEN left(text, 47) || '...' ELSE text END AS preview FROM conversations",
)
def scl_truncate(spark, d):
    c = C.T(spark, d).conversations
    return c.select("conv_id", "turn", S.truncate_text("text", 50).alias("preview"))


@query(
    "scl_yes_no",
    """
SELECT o.o_orderkey, CASE WHEN c.c_acctbal IS NULL THEN 'N/A' WHEN c.c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS positive_balance,
       COALESCE(strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S'), 'N/A') AS ordered_at
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""",
)
def scl_yes_no(spark, d):
    t = C.T(spark, d)
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("o_orderkey", S.yes_no(F.col("c_acctbal") > 0).alias("positive_balance"),
                    S.format_datetime("o_orderdate").alias("ordered_at"))


@query(
    "scl_cell_format",
    """
SELECT format('{:,}', o_orderkey) AS o_orderkey, format('{:,.2f}', o_totalprice) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderstatus,
       CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS finished
FROM orders""",
)
def scl_cell_format(spark, d):
    o = C.T(spark, d).orders.withColumn("finished", F.col("o_orderstatus") == "F")
    cols = ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "finished"]
    return o.select(*[S.format_cell(c, o.schema[c].dataType).alias(c) for c in cols])


@query(
    "scl_multi_ilike",
    "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE '%red%' OR p_type ILIKE '%red%'",
)
def scl_multi_ilike(spark, d):
    p = C.T(spark, d).part
    return p.filter(S.contains_any(["p_name", "p_brand", "p_type"], "RED")).select("p_partkey")


@query("scl_array_contains", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')")
def scl_array_contains(spark, d):
    p = C.T(spark, d).part
    return p.filter(S.has_element(F.split("p_name", " "), "ring")).select("p_partkey", "p_name")


@query(
    "scl_prefix",
    "SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN 'group_1' ELSE 'other' END AS source_group FROM documents",
)
def scl_prefix(spark, d):
    doc = C.T(spark, d).documents
    return doc.select("doc_id", F.when(S.has_prefix("source", "src1"), "group_1").otherwise("other").alias("source_group"))


@query(
    "scl_regex_test",
    """
SELECT conv_id, turn, TRUE AS is_valid, regexp_matches(text, '(the|and) ([a-z]+)') AS matches,
       CASE WHEN regexp_matches(text, '(the|and) ([a-z]+)') THEN regexp_extract(text, '(the|and) ([a-z]+)') END AS match_text,
       CASE WHEN regexp_matches(text, '(the|and) ([a-z]+)') THEN regexp_extract(text, '(the|and) ([a-z]+)', 1) END AS group_1,
       CASE WHEN regexp_matches(text, '(the|and) ([a-z]+)') THEN regexp_extract(text, '(the|and) ([a-z]+)', 2) END AS group_2
FROM conversations""",
)
def scl_regex_test(spark, d):
    c = C.T(spark, d).conversations
    r = c.select("conv_id", "turn", S.regex_test("text", "(the|and) ([a-z]+)").alias("r"))
    return r.select(
        "conv_id", "turn", "r.is_valid", "r.matches", "r.match_text",
        F.try_element_at("r.groups", F.lit(1)).alias("group_1"), F.try_element_at("r.groups", F.lit(2)).alias("group_2"),
    )


@query(
    "scl_glob_test",
    """
SELECT page_id, regexp_full_match(regexp_extract(url, '[^/]*$'), '[0-9].*\\.html') AS is_html,
       regexp_full_match(regexp_extract(url, '[^/]*$'), '[0-9][0-9].') AS short_id
FROM pages""",
)
def scl_glob_test(spark, d):
    p = C.T(spark, d).pages.withColumn("fname", F.regexp_extract("url", "[^/]*$", 0))
    return p.select("page_id", S.glob_test("fname", "[0-9]*.html").alias("is_html"),
                    S.glob_test("fname", "[0-9][0-9]?").alias("short_id"))


@query(
    "scl_date_prefix",
    "SELECT event_id, strftime(ts, '%Y%m%d') || '_' || 'report_' || event_id || '.csv' AS file_name FROM events",
)
def scl_date_prefix(spark, d):
    e = C.T(spark, d).events
    return e.select("event_id", S.date_prefixed_name("ts", F.concat(F.lit("report_"), "event_id", F.lit(".csv"))).alias("file_name"))


@query(
    "scl_array_literal",
    """SELECT p_partkey, '{' || array_to_string(list_transform(string_split(p_name, ' '), lambda x: '"' || x || '"'), ',') || '}' AS name_array
FROM part""",
)
def scl_array_literal(spark, d):
    p = C.T(spark, d).part
    return p.select("p_partkey", S.array_literal(F.split("p_name", " ")).alias("name_array"))


@query("scl_slug", "SELECT p_partkey, lower(replace('NewYorkFed_' || p_type || '_Latest', 'NewYorkFed_', '')) AS slug FROM part")
def scl_slug(spark, d):
    p = C.T(spark, d).part
    name = F.concat(F.lit("NewYorkFed_"), "p_type", F.lit("_Latest"))
    return p.select("p_partkey", S.slug(name, "NewYorkFed_").alias("slug"))


@query(
    "scl_split_trim",
    """SELECT c_custkey, list_filter(list_transform(string_split(c_name || ' , ' || c_mktsegment || ',', ','), lambda x: trim(x)), lambda x: x <> '') AS recipients
FROM customer""",
)
def scl_split_trim(spark, d):
    c = C.T(spark, d).customer
    s = F.concat("c_name", F.lit(" , "), "c_mktsegment", F.lit(","))
    return c.select("c_custkey", S.split_trim(s).alias("recipients"))


@query(
    "scl_sql_blocks",
    r"""SELECT p_partkey, regexp_extract_all('Head {{SQL:SELECT ' || p_name || E'\n FROM part}} mid {{SQL:' || p_type || '}} tail',
                                         '(?s)\{\{SQL:(.*?)\}\}', 1) AS blocks FROM part""",
)
def scl_sql_blocks(spark, d):
    p = C.T(spark, d).part
    tpl = F.concat(F.lit("Head {{SQL:SELECT "), "p_name", F.lit("\n FROM part}} mid {{SQL:"), "p_type", F.lit("}} tail"))
    return p.select("p_partkey", S.sql_blocks(tpl).alias("blocks"))


@query(
    "prj_first_truthy",
    """
SELECT o_orderkey,
       COALESCE(NULLIF(CASE WHEN o_orderstatus = 'P' THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END, ''),
                strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d')) AS swap_date,
       COALESCE(NULLIF(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END, 0), -1.0) AS amount
FROM orders""",
)
def prj_first_truthy(spark, d):
    o = C.T(spark, d).orders
    a = F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    b = F.date_format(F.date_add("o_orderdate", 1), "yyyy-MM-dd")
    amt = F.when(F.col("o_orderstatus") == "O", F.lit(0.0)).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", S.first_truthy(a, b).alias("swap_date"), S.first_truthy(amt, F.lit(-1.0)).alias("amount"))

