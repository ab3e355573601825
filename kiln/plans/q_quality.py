"""DQ-* audits and SET-* queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import quality as Q
from kiln.plans import common as C
from kiln.plans.registry import query


@query(
    "dq_unique",
    "SELECT o_custkey, o_orderdate, count(*) AS row_count FROM orders GROUP BY ALL HAVING count(*) > 1",
)
def dq_unique(spark, d):
    return Q.unique_violations(C.T(spark, d).orders, ["o_custkey", "o_orderdate"])


@query(
    "dq_fk",
    """
SELECT 'lineitem.l_orderkey' AS rule_id, l_orderkey AS key_value FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey)
UNION ALL
SELECT 'events.user_id', user_id FROM events e
WHERE user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = e.user_id)""",
)
def dq_fk(spark, d):
    t = C.T(spark, d)
    a = Q.fk_violations(t.lineitem, t.orders, "l_orderkey", "o_orderkey").select(
        F.lit("lineitem.l_orderkey").alias("rule_id"), F.col("l_orderkey").alias("key_value"))
    b = Q.fk_violations(t.events, t.supplier, "user_id", "s_suppkey").select(
        F.lit("events.user_id").alias("rule_id"), F.col("user_id").alias("key_value"))
    return a.unionByName(b)


@query(
    "dq_not_null",
    C.with_ctes(
        C.LOGS_SQL,
        body="""UNPIVOT (SELECT count(*) FILTER (WHERE logentryid IS NULL) AS logentryid,
                        count(*) FILTER (WHERE "timestamp" IS NULL) AS "timestamp",
                        count(*) FILTER (WHERE stepruntime IS NULL) AS stepruntime,
                        count(*) FILTER (WHERE message IS NULL) AS message FROM logs)
ON COLUMNS(*) INTO NAME column_name VALUE null_count""",
    ),
)
def dq_not_null(spark, d):
    return Q.null_counts(C.logs(C.T(spark, d)), ["logentryid", "timestamp", "stepruntime", "message"])


@query(
    "dq_overflow",
    """
SELECT rule_id, p_partkey FROM (
  SELECT 'p_name > VARCHAR(10)' AS rule_id, p_partkey FROM part WHERE length(p_name) > 10
  UNION ALL
  SELECT 'p_retailprice > NUMERIC(6,2)', p_partkey FROM part WHERE TRY_CAST(p_retailprice AS DECIMAL(6,2)) IS NULL)""",
)
def dq_overflow(spark, d):
    p = C.T(spark, d).part
    return Q.overflow_violations(p, "p_partkey", {"p_name": 10}, {"p_retailprice": (6, 2)})


@query(
    "dq_checks",
    C.with_ctes(
        C.RUNS_SQL,
        body="""
SELECT rule_id, jobrunid FROM (
  SELECT 'status_enum' AS rule_id, jobrunid FROM runs WHERE NOT (status IN ('success', 'failed', 'partial', 'running'))
  UNION ALL SELECT 'date_order', jobrunid FROM runs WHERE NOT (completed_at >= started_at)
  UNION ALL SELECT 'completed_required', jobrunid FROM runs WHERE NOT (status = 'running' OR completed_at IS NOT NULL)
  UNION ALL SELECT 'same_day', jobrunid FROM runs WHERE NOT (CAST(completed_at AS DATE) = CAST(started_at AS DATE))
  UNION ALL SELECT 'job_name_shape', jobrunid FROM runs WHERE NOT regexp_matches(job_name, '^job_[0-9]-[A-Z ]+$'))""",
    ),
)
def dq_checks(spark, d):
    r = C.runs(C.T(spark, d))
    rules = {
        "status_enum": F.col("status").isin("success", "failed", "partial", "running"),
        "date_order": F.col("completed_at") >= F.col("started_at"),
        "completed_required": (F.col("status") == "running") | F.col("completed_at").isNotNull(),
        "same_day": F.to_date("completed_at") == F.to_date("started_at"),
        "job_name_shape": F.col("job_name").rlike("^job_[0-9]-[A-Z ]+$"),
    }
    return Q.rule_violations(r, "jobrunid", rules)


@query(
    "dq_reconcile",
    """
WITH e AS (SELECT o_orderkey, CAST(1 + floor(o_totalprice / 100000) AS BIGINT) AS expected FROM orders),
a AS (SELECT l_orderkey AS o_orderkey, count(*) AS loaded FROM lineitem GROUP BY 1)
SELECT e.o_orderkey, expected, loaded,
       CASE WHEN loaded IS NULL THEN 'error' WHEN loaded = expected THEN 'passed' ELSE 'failed' END AS result,
       CASE WHEN loaded IS NULL THEN 'NOT_LOADED' WHEN loaded <> expected THEN 'RECORD_COUNT_MISMATCH' END AS error_code
FROM e LEFT JOIN a USING (o_orderkey)""",
)
def dq_reconcile(spark, d):
    t = C.T(spark, d)
    exp = t.orders.select("o_orderkey", (F.lit(1) + F.floor(F.col("o_totalprice") / 100000)).cast("bigint").alias("expected"))
    act = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("loaded"))
    return Q.reconcile(exp, act, "o_orderkey")


@query(
    "dq_retention",
    """
WITH stored AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'etl_user' END AS created_by,
                       o_orderdate AS created_date FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT o_orderkey, 'missing' AS problem FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM stored)
UNION ALL SELECT o_orderkey, 'null created_by' FROM stored WHERE created_by IS NULL
UNION ALL SELECT o_orderkey, 'null created_date' FROM stored WHERE created_date IS NULL""",
)
def dq_retention(spark, d):
    o = C.T(spark, d).orders
    stored = o.filter(F.col("o_orderpriority") != "5-LOW").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.lit("etl_user")).alias("created_by"),
        F.col("o_orderdate").alias("created_date"))
    return Q.retention_violations(o, stored, "o_orderkey", ["created_by", "created_date"])


# ------------------------------------------------------------------ SET-*
@query(
    "set_suggestions",
    """
SELECT 'brand' AS field, p_brand AS value FROM part WHERE p_brand IS NOT NULL
UNION SELECT 'type', p_type FROM part WHERE p_type IS NOT NULL
UNION SELECT 'word', unnest(string_split(p_name, ' ')) FROM part
UNION SELECT 'segment', c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL""",
)
def set_suggestions(spark, d):
    t = C.T(spark, d)
    # one scan per table: unpivot the label columns instead of one scan per label
    p = t.part.select("p_brand", "p_type", F.explode(F.split("p_name", " ")).alias("word"))
    pv = p.unpivot([], ["p_brand", "p_type", "word"], "field", "value").select(
        F.when(F.col("field") == "p_brand", "brand").when(F.col("field") == "p_type", "type").otherwise("word").alias("field"),
        "value")
    c = t.customer.select(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"))
    return pv.unionByName(c).filter(F.col("value").isNotNull()).distinct()


@query(
    "set_concat",
    """
SELECT o_orderkey, o_orderstatus, o_totalprice, NULL::VARCHAR AS o_orderpriority FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, o_orderstatus, NULL::DOUBLE, o_orderpriority FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'P'""",
)
def set_concat(spark, d):
    o = C.T(spark, d).orders
    parts = [
        o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus", "o_totalprice"),
        o.filter(F.col("o_orderstatus") == "O").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
        o.filter(F.col("o_orderstatus") == "P").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


