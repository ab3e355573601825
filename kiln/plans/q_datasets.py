"""WIN-* and CAL-* queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import calendar as K
from kiln.operators import datasets as D
from kiln.operators import opslog as O
from kiln.plans import common as C
from kiln.plans.registry import query

KEYS = ["label", "datasettype", "datasource"]
# sequence values per ordered chunk of a key (the tests use small ones to exercise the carry)
CHUNK_ROWS = 1 << 20

RESOLVED_SQL = """
r AS (SELECT *, max(datasetdate) OVER (PARTITION BY label, datasettype, datasource ORDER BY seq
                                       ROWS UNBOUNDED PRECEDING) AS run_max_date FROM datasets),
o AS (SELECT *, activated AND datasetdate >= run_max_date AS activation_ok FROM r),
n AS (SELECT *, first_value(CASE WHEN activation_ok THEN createddate END IGNORE NULLS)
                  OVER (PARTITION BY label, datasettype, datasource ORDER BY seq
                        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ok FROM o),
l AS (SELECT label, datasettype, datasource, max(seq) AS last_ok FROM o WHERE activation_ok GROUP BY ALL),
resolved AS (
  SELECT n.datasetid, n.seq, n.label, n.datasettype, n.datasource, n.datasetdate, n.createddate, n.activated,
         n.run_max_date, n.activation_ok, COALESCE(n.seq = l.last_ok, FALSE) AS isactive,
         CASE WHEN NOT n.activated THEN 'New'
              WHEN n.activation_ok AND COALESCE(n.seq = l.last_ok, FALSE) THEN 'Active'
              WHEN n.activation_ok THEN 'Inactive' ELSE 'Active' END AS status,
         n.createddate AS efffrom,
         CASE WHEN n.activation_ok AND NOT COALESCE(n.seq = l.last_ok, FALSE) THEN n.next_ok
              ELSE TIMESTAMP '9999-01-01 00:00:00' END AS effthru
  FROM n LEFT JOIN l USING (label, datasettype, datasource))"""


def _resolved(spark, d):
    return D.resolve_active(C.datasets(C.T(spark, d)), KEYS, chunk_rows=CHUNK_ROWS)


@query("win_active_dataset", C.with_ctes(C.DATASETS_SQL, RESOLVED_SQL, body="SELECT * FROM resolved"))
def win_active_dataset(spark, d):
    return _resolved(spark, d)


@query(
    "win_as_of",
    C.with_ctes(
        C.DATASETS_SQL,
        RESOLVED_SQL,
        body="""
SELECT *, CASE WHEN effthru > TIMESTAMP '1998-06-01' THEN 'Current' ELSE 'Expired' END AS validity,
       CASE WHEN isactive THEN 'Yes' ELSE 'No' END AS active_text,
       CAST(date_diff('day', datasetdate, DATE '1998-06-01') AS INTEGER) AS age_days
FROM resolved WHERE efffrom <= TIMESTAMP '1998-06-01' AND TIMESTAMP '1998-06-01' <= effthru""",
    ),
)
def win_as_of(spark, d):
    return D.as_of(_resolved(spark, d), "1998-06-01 00:00:00")


@query(
    "win_lifecycle",
    C.with_ctes(
        C.DATASETS_SQL,
        C.STEPS_SQL,
        body="""
, oc AS (SELECT jobrunid AS datasetid,
               CASE WHEN bool_or(status = 'failed') AND bool_or(status = 'success') THEN 'partial'
                    WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'success' END AS outcome
        FROM steps GROUP BY 1),
j AS (SELECT d.datasetid, d.label, d.datasettype, d.datasource, oc.outcome,
             NULLIF(concat_ws('; ',
               CASE WHEN d.datasettype NOT IN ('F', 'O') THEN 'unknown type: ' || d.datasettype END,
               CASE WHEN d.datasource NOT IN (SELECT r_regionkey FROM region) THEN 'unknown source: ' || d.datasource END), '') AS error
      FROM datasets d LEFT JOIN oc USING (datasetid))
SELECT *, CASE WHEN error IS NOT NULL THEN 'Error' WHEN outcome IS NULL THEN 'New'
               WHEN outcome = 'failed' THEN 'Failed' ELSE 'Active' END AS status
FROM j""",
    ),
)
def win_lifecycle(spark, d):
    t = C.T(spark, d)
    ds = C.datasets(t).select("datasetid", "label", "datasettype", "datasource")
    oc = O.job_outcome(C.steps(t), "jobrunid", "status").select(F.col("jobrunid").alias("datasetid"), "outcome")
    # fixed values: the dataset types the type lookup knows
    types = spark.createDataFrame([("F",), ("O",)], "type_code string")
    return D.lifecycle(
        ds, oc, "datasetid", "outcome",
        {"type": (types, "type_code", F.col("datasettype")), "source": (t.region, "r_regionkey", F.col("datasource"))},
    )


# ------------------------------------------------------------------ calendar
CAL_SQL = """
b AS (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders),
d AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS calendar_date FROM b),
h AS (SELECT calendar_date,
        CASE WHEN month(calendar_date) = 1 AND day(calendar_date) = 1 THEN 'New Year''s Day'
             WHEN month(calendar_date) = 1 AND dayofweek(calendar_date) = 1 AND day(calendar_date) BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day'
             WHEN month(calendar_date) = 2 AND dayofweek(calendar_date) = 1 AND day(calendar_date) BETWEEN 15 AND 21 THEN 'Presidents'' Day'
             WHEN month(calendar_date) = 5 AND dayofweek(calendar_date) = 1 AND day(calendar_date) >= 25 THEN 'Memorial Day'
             WHEN month(calendar_date) = 7 AND day(calendar_date) = 4 THEN 'Independence Day'
             WHEN month(calendar_date) = 9 AND dayofweek(calendar_date) = 1 AND day(calendar_date) <= 7 THEN 'Labor Day'
             WHEN month(calendar_date) = 11 AND dayofweek(calendar_date) = 4 AND day(calendar_date) BETWEEN 22 AND 28 THEN 'Thanksgiving Day'
             WHEN month(calendar_date) = 12 AND day(calendar_date) = 25 THEN 'Christmas Day' END AS holiday_name
      FROM d),
c AS (SELECT calendar_date, dayname(calendar_date) AS day_name, CAST(dayofweek(calendar_date) AS INTEGER) AS day_number,
             holiday_name IS NOT NULL AS is_holiday, holiday_name,
             dayofweek(calendar_date) BETWEEN 1 AND 5 AND holiday_name IS NULL AS is_business_day FROM h),
cal AS (SELECT *, max(CASE WHEN is_business_day THEN calendar_date END)
                    OVER (ORDER BY calendar_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_business_date
        FROM c)"""


def _days(t):
    o = t.orders
    rng = o.agg(F.min("o_orderdate").cast("date").alias("lo"), F.max("o_orderdate").cast("date").alias("hi"))
    return rng.select(F.explode(F.sequence("lo", "hi")).alias("calendar_date"))


def _calendar(t):
    return K.business_calendar(_days(t))


@query("cal_business", C.with_ctes(CAL_SQL, body="SELECT * FROM cal"))
def cal_business(spark, d):
    return _calendar(C.T(spark, d))


@query(
    "cal_attach",
    C.with_ctes(
        CAL_SQL,
        body="""SELECT o.o_orderkey, c.calendar_date, c.day_name, c.is_business_day, c.is_holiday, c.previous_business_date
FROM orders o LEFT JOIN cal c ON CAST(o.o_orderdate AS DATE) = c.calendar_date""",
    ),
)
def cal_attach(spark, d):
    t = C.T(spark, d)
    cal = _calendar(t)
    j = K.attach_calendar(t.orders, F.col("o_orderdate"), cal)
    return j.select("o_orderkey", "calendar_date", "day_name", "is_business_day", "is_holiday", "previous_business_date")


@query(
    "agg_holidays",
    C.with_ctes(
        CAL_SQL,
        body="""SELECT count(*) AS total, count(*) FILTER (WHERE calendar_date >= DATE '1999-01-01') AS upcoming,
       count(*) FILTER (WHERE calendar_date < DATE '1999-01-01') AS past FROM cal WHERE is_holiday""",
    ),
)
def agg_holidays(spark, d):
    return K.holiday_stats(K.holidays_in(_days(C.T(spark, d))), "1999-01-01")


@query(
    "cal_upcoming",
    C.with_ctes(
        CAL_SQL,
        body="""SELECT calendar_date AS holiday_date, holiday_name FROM cal
WHERE is_holiday AND calendar_date >= DATE '1999-01-01' ORDER BY calendar_date LIMIT 5""",
    ),
)
def cal_upcoming(spark, d):
    return K.upcoming(K.holidays_in(_days(C.T(spark, d))), "1999-01-01", 5)


@query(
    "cal_holiday_load",
    """
WITH b AS (SELECT event_id,
             CASE WHEN event_id % 97 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%d') END AS date_text,
             CASE WHEN event_id % 89 = 0 THEN '' ELSE event_type END AS holiday_name FROM events),
p AS (SELECT *, CAST(try_strptime(NULLIF(trim(date_text), ''), '%Y-%m-%d') AS DATE) AS holiday_date FROM b),
f AS (SELECT holiday_date, min(event_id) AS first_id FROM p WHERE holiday_date IS NOT NULL GROUP BY 1),
ex AS (SELECT DATE '2024-01-01' AS d UNION ALL SELECT DATE '2024-01-15'),
r AS (SELECT p.event_id, p.holiday_date, p.holiday_name,
        CASE WHEN date_text IS NULL OR trim(date_text) = '' THEN 'missing date'
             WHEN p.holiday_date IS NULL THEN 'invalid date: ' || date_text
             WHEN p.holiday_date IN (SELECT d FROM ex) THEN 'already exists: ' || date_text
             WHEN p.event_id <> f.first_id THEN 'duplicate in batch: ' || date_text END AS reason
      FROM p LEFT JOIN f USING (holiday_date))
SELECT event_id, holiday_date, holiday_name, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS load_status, reason
FROM r""",
)
def cal_holiday_load(spark, d):
    t = C.T(spark, d)
    e = t.events
    batch = e.select(
        "event_id",
        F.when(F.col("event_id") % 97 == 0, "not-a-date").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date_text"),
        F.when(F.col("event_id") % 89 == 0, "").otherwise(F.col("event_type")).alias("holiday_name"),
    )
    jan = K.date_range_frame(spark, "2024-01-01", "2024-01-31")
    existing = K.holidays_in(jan)
    return K.holiday_load(batch, existing, "event_id", "date_text", "holiday_name")
