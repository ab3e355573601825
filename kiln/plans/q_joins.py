"""JOIN-* queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import joins as J
from kiln.operators import opslog as O
from kiln.plans import common as C
from kiln.plans.registry import query

OA = C.ORDERS_AS_OF


@query(
    "join_parent_child",
    C.with_ctes(
        C.RUNS_SQL,
        C.STEPS_SQL,
        body=f"""
SELECT r.jobrunid, r.job_name, r.started_at, r.completed_at, r.status,
       epoch(COALESCE(r.completed_at, TIMESTAMP '{OA}') - r.started_at) AS duration_seconds,
       count(s.jobrunid) AS step_count,
       CAST(sum(CASE WHEN s.status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS steps_success,
       CAST(sum(CASE WHEN s.status = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS steps_failed
FROM runs r LEFT JOIN steps s ON s.jobrunid = r.jobrunid
GROUP BY ALL""",
    ),
)
def join_parent_child(spark, d):
    t = C.T(spark, d)
    return O.parent_child_rollup(C.runs(t), C.steps(t), "jobrunid", "jobrunid", OA)


@query(
    "join_inner_star",
    """
SELECT s.s_suppkey, s.s_name, n.n_name, r.r_name,
       s.s_name || ' (' || n.n_name || ', ' || r.r_name || ')' AS display_name,
       CASE WHEN s.s_acctbal < 0 THEN 'negative' WHEN s.s_acctbal < 5000 THEN 'low' ELSE 'high' END AS balance_class
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
)
def join_inner_star(spark, d):
    t = C.T(spark, d)
    j = J.star_join(
        t.supplier,
        [(t.nation, F.col("s_nationkey") == F.col("n_nationkey")), (t.region, F.col("n_regionkey") == F.col("r_regionkey"))],
    )
    b = F.col("s_acctbal")
    return j.select(
        "s_suppkey",
        "s_name",
        "n_name",
        "r_name",
        F.concat("s_name", F.lit(" ("), "n_name", F.lit(", "), "r_name", F.lit(")")).alias("display_name"),
        F.when(b < 0, "negative").when(b < 5000, "low").otherwise("high").alias("balance_class"),
    )


@query(
    "join_left_lookup",
    """
SELECT o.o_orderkey, o.o_orderdate, o.o_orderstatus, c.c_name, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0
WHERE o.o_orderstatus = 'F' AND o.o_orderdate >= TIMESTAMP '1998-01-01'
ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 50""",
)
def join_left_lookup(spark, d):
    t = C.T(spark, d)
    cust = t.customer.filter(F.col("c_acctbal") > 0).select("c_custkey", "c_name", "c_mktsegment")
    filters = [F.col("o_orderstatus") == "F", F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")]
    o = t.orders
    for p in filters:
        o = o.filter(p)
    j = J.star_join(o, [(cust, F.col("o_custkey") == F.col("c_custkey"))], how="left")
    return O.newest_first(j, "o_orderdate", "o_orderkey", 50).select(
        "o_orderkey", "o_orderdate", "o_orderstatus", "c_name", "c_mktsegment"
    )


@query(
    "join_polymorphic",
    """
SELECT e.event_id, e.event_type, e.user_id,
       CASE e.event_type WHEN 'signup' THEN c.c_name WHEN 'click' THEN s.s_name WHEN 'purchase' THEN p.p_name END AS target_name
FROM events e
LEFT JOIN customer c ON e.event_type = 'signup' AND c.c_custkey = e.user_id
LEFT JOIN supplier s ON e.event_type = 'click' AND s.s_suppkey = e.user_id
LEFT JOIN part p ON e.event_type = 'purchase' AND p.p_partkey = e.user_id""",
)
def join_polymorphic(spark, d):
    t = C.T(spark, d)
    e = t.events.select("event_id", "event_type", "user_id")
    return J.polymorphic_lookup(
        e,
        "event_type",
        "user_id",
        {
            "signup": (t.customer, "c_custkey", "c_name"),
            "click": (t.supplier, "s_suppkey", "s_name"),
            "purchase": (t.part, "p_partkey", "p_name"),
        },
    )


@query("join_semi", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def join_semi(spark, d):
    t = C.T(spark, d)
    return J.semi(t.customer.select("c_custkey", "c_name"), t.orders, F.col("c_custkey") == F.col("o_custkey"))


@query(
    "join_anti",
    "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
)
def join_anti(spark, d):
    t = C.T(spark, d)
    return J.anti(t.customer.select("c_custkey", "c_name"), t.orders, F.col("c_custkey") == F.col("o_custkey"))


# fixed values: inbox-style routing rules (id, subject regex, sender regex)
MAIL_RULES = [
    {"rule_id": 1, "subject": "license", "sender": None},
    {"rule_id": 2, "subject": "@mail[0-9]+[.]example", "sender": "src1[0-9]"},
    {"rule_id": 3, "subject": None, "sender": "^src[0-4]$"},
    {"rule_id": 4, "subject": "([unclosed", "sender": None},
    {"rule_id": 5, "subject": "^(the|and|der|die|das) ", "sender": None},
]


@query(
    "join_regex",
    """
SELECT doc_id, rule_id FROM documents, (VALUES (1), (2), (3), (5)) r(rule_id)
WHERE (rule_id = 1 AND regexp_matches(text, '(?i)license'))
   OR (rule_id = 2 AND regexp_matches(text, '(?i)@mail[0-9]+[.]example') AND regexp_matches(source, '(?i)src1[0-9]'))
   OR (rule_id = 3 AND regexp_matches(source, '(?i)^src[0-4]$'))
   OR (rule_id = 5 AND regexp_matches(text, '(?i)^(the|and|der|die|das) '))""",
)
def join_regex(spark, d):
    docs = C.TW(spark, d).documents
    return J.regex_rule_join(docs, MAIL_RULES, {"subject": "text", "sender": "source"}, "doc_id")


# fixed values: subscriber file globs matched against the last URL segment
GLOB_RULES = [
    {"rule_id": 1, "pattern": "*.html"},
    {"rule_id": 2, "pattern": "[0-4]??"},
    {"rule_id": 3, "pattern": "*#top"},
    {"rule_id": 4, "pattern": None},
    {"rule_id": 5, "pattern": "[!0-9]*"},
]


@query(
    "join_glob",
    """
WITH f AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS fname FROM pages)
SELECT page_id, rule_id FROM f, (VALUES (1), (2), (3), (4), (5)) r(rule_id)
WHERE (rule_id = 1 AND regexp_full_match(fname, '.*\\.html'))
   OR (rule_id = 2 AND regexp_full_match(fname, '[0-4]..'))
   OR (rule_id = 3 AND regexp_full_match(fname, '.*#top'))
   OR rule_id = 4
   OR (rule_id = 5 AND regexp_full_match(fname, '[^0-9].*'))""",
)
def join_glob(spark, d):
    p = C.T(spark, d).pages.select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("fname"))
    return J.glob_rule_join(p, GLOB_RULES, "fname", "page_id")


# fixed values: attachment rules (a glob, two regexes, two texts that are no regex)
ATTACHMENT_RULES = [
    {"rule_id": 1, "pattern": "*.HTML"},
    {"rule_id": 2, "pattern": "^[0-4]"},
    {"rule_id": 3, "pattern": "#TOP$"},
    {"rule_id": 4, "pattern": "[0"},
    {"rule_id": 5, "pattern": "1#Top("},
]


@query(
    "join_attachments",
    """
WITH f AS (SELECT page_id, regexp_extract(url, '[^/]*$') || CASE WHEN page_id % 3 = 0 THEN '[0].1#TOP(' ELSE '' END AS fname FROM pages)
SELECT page_id, rule_id FROM f, (VALUES (1), (2), (3), (4), (5)) r(rule_id)
WHERE (rule_id = 1 AND fname LIKE '%.HTML')
   OR (rule_id = 2 AND regexp_matches(fname, '^[0-4]'))
   OR (rule_id = 3 AND regexp_matches(fname, '(?i)#top$'))
   OR (rule_id = 4 AND contains(fname, '[0'))
   OR (rule_id = 5 AND contains(lower(fname), '1#top('))""",
)
def join_attachments(spark, d):
    marked = F.when(F.col("page_id") % 3 == 0, "[0].1#TOP(").otherwise("")
    p = C.T(spark, d).pages.select("page_id", F.concat(F.regexp_extract("url", "[^/]*$", 0), marked).alias("fname"))
    return J.attachment_rule_join(p, ATTACHMENT_RULES, "fname", "page_id")


@query(
    "join_update_from",
    """
SELECT o_orderkey, o_orderstatus,
       o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_return
FROM orders""",
)
def join_update_from(spark, d):
    t = C.T(spark, d)
    returned = t.lineitem.filter(F.col("l_returnflag") == "R")
    return J.flag_present(t.orders.select("o_orderkey", "o_orderstatus"), returned, "o_orderkey", "l_orderkey", "has_return")


@query(
    "join_prev_row",
    """
SELECT event_id, user_id, ts, event_type,
       last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_purchase_ts
FROM events""",
)
def join_prev_row(spark, d):
    e = C.T(spark, d).events.select("event_id", "user_id", "ts", "event_type")
    return J.previous_match(
        e, "user_id", "ts", "event_id", F.col("event_type") == "purchase", F.col("ts"), "prev_purchase_ts", F.to_date("ts")
    )


@query(
    "join_usage",
    """
SELECT n.n_nationkey, n.n_name, n.n_regionkey, COALESCE(u.cnt, 0) AS usage_count, COALESCE(u.cnt, 0) = 0 AS can_delete
FROM nation n LEFT JOIN (SELECT c_nationkey, count(*) AS cnt FROM customer GROUP BY 1) u ON u.c_nationkey = n.n_nationkey""",
)
def join_usage(spark, d):
    t = C.T(spark, d)
    return J.usage_counts(t.nation, "n_nationkey", t.customer, "c_nationkey")


def _messages(t):
    c = t.conversations
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("text").alias("subject"),
        F.col("role").alias("sender"),
    )


MESSAGES_SQL = """messages AS (SELECT conv_id * 1000 + turn AS message_id, text AS subject, role AS sender
                    FROM conversations)"""

# fixed values: rules routing conversation messages
MSG_RULES = [
    {"rule_id": 1, "subject": "^(the|and|le|la|et) ", "sender": None},
    {"rule_id": 2, "subject": None, "sender": "^system$"},
    {"rule_id": 3, "subject": "[?]", "sender": "user"},
]


@query(
    "join_unmatched",
    C.with_ctes(
        MESSAGES_SQL,
        body="""
SELECT message_id FROM messages
WHERE NOT (regexp_matches(subject, '(?i)^(the|and|le|la|et) ')
        OR regexp_matches(sender, '(?i)^system$')
        OR (regexp_matches(subject, '(?i)[?]') AND regexp_matches(sender, '(?i)user')))""",
    ),
)
def join_unmatched(spark, d):
    m = _messages(C.T(spark, d))
    matched = J.regex_rule_join(m, MSG_RULES, {"subject": "subject", "sender": "sender"}, "message_id")
    return J.anti(m.select("message_id"), matched, "message_id")


@query(
    "join_gaps",
    """
WITH days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
rng AS (SELECT user_id, min(d) AS lo, max(d) AS hi FROM days GROUP BY 1),
cand AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS gap_date FROM rng)
SELECT c.user_id, c.gap_date FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM days x WHERE x.user_id = c.user_id AND x.d = c.gap_date)""",
)
def join_gaps(spark, d):
    return J.date_gaps(C.T(spark, d).events, "user_id", "ts")
