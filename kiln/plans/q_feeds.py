"""FEED-*, MKT-* and payload-source (SRC-08..15) queries.

Every query first lands payload documents built from a driver table with
``to_json`` (one document per source row, so no group is ever collected),
then runs the real transform on them.  The oracle computes the expected
typed rows directly from the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import feeds as FD
from kiln.plans import common as C
from kiln.plans.registry import query
from kiln.session import staging_dir
from kiln.sources import payloads as PL


def _doc(root: str, *fields):
    """JSON text ``{"<root>": [ {fields} ]}`` (root may be dotted)."""
    node = F.array(F.struct(*fields))
    for part in reversed(root.split(".")):
        node = F.struct(node.alias(part))
    return F.to_json(node)


def _d(c):
    return F.date_format(c, "yyyy-MM-dd")


def _records(df, root):
    return PL.extract_path(df.select(F.col("payload")), "payload", root)


# ------------------------------------------------------------------ FEED-01
def _reference_rates_payloads(spark, d):
    e = C.TW(spark, d).events
    v = F.col("value")
    view = F.col("event_type") == "view"
    payload = _doc(
        "refRates",
        F.col("event_type").alias("type"),
        F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(_d("ts")).alias("effectiveDate"),
        F.round(v, 2).alias("percentRate"),
        F.round(v * 10).alias("volumeInBillions"),
        F.round(v - 1, 2).alias("percentile1"),
        F.round(v - 0.25, 2).alias("percentile25"),
        F.round(v + 0.25, 2).alias("percentile75"),
        F.round(v + 1, 2).alias("percentile99"),
        F.when(view, F.lit(5.25)).alias("targetRangeFrom"),
        F.when(view, F.lit(5.5)).alias("targetRangeTo"),
    )
    return e.withColumn("payload", payload)


@query(
    "feed_reference_rates",
    """
SELECT event_type AS rate_type, CAST(ts AS DATE) AS effective_date,
       CAST(round(value, 2) AS DECIMAL(10,4)) AS rate_percent, CAST(round(value * 10) AS DECIMAL(15,2)) AS volume_billions,
       CAST(round(value - 1, 2) AS DECIMAL(10,4)) AS percentile_1, CAST(round(value - 0.25, 2) AS DECIMAL(10,4)) AS percentile_25,
       CAST(round(value + 0.25, 2) AS DECIMAL(10,4)) AS percentile_75, CAST(round(value + 1, 2) AS DECIMAL(10,4)) AS percentile_99,
       CASE WHEN event_type = 'view' THEN CAST(5.25 AS DECIMAL(10,4)) END AS target_range_from,
       CASE WHEN event_type = 'view' THEN CAST(5.5 AS DECIMAL(10,4)) END AS target_range_to
FROM events WHERE event_id % 11 <> 0""",
)
def feed_reference_rates(spark, d):
    return FD.reference_rates(FD.feed_records(_reference_rates_payloads(spark, d), "payload", "refRates", "reference_rates"))


# ------------------------------------------------------------------ FEED-02
@query(
    "feed_soma",
    """
SELECT CAST(l_shipdate AS DATE) AS as_of_date, l_returnflag AS security_type, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip,
       'part ' || l_partkey AS security_description, CAST(l_shipdate + INTERVAL 3650 DAY AS DATE) AS maturity_date,
       CAST(l_extendedprice AS DECIMAL(20,2)) AS par_value, CAST(l_extendedprice - l_quantity AS DECIMAL(20,2)) AS current_face_value
FROM lineitem WHERE l_orderkey % 31 <> 0""",
)
def feed_soma(spark, d):
    return FD.soma_holdings(_soma_records(spark, d))


def _soma_records(spark, d):
    li = C.TW(spark, d).lineitem
    payload = _doc(
        "soma.holdings",
        F.when(F.col("l_orderkey") % 31 == 0, F.concat(F.lit("n/a "), "l_orderkey", F.lit("-"), "l_linenumber"))
        .otherwise(_d("l_shipdate")).alias("asOfDate"),
        F.col("l_returnflag").alias("securityType"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("cusip"),
        F.concat(F.lit("part "), "l_partkey").alias("securityDescription"),
        _d(F.date_add("l_shipdate", 3650)).alias("maturityDate"),
        F.format_number("l_extendedprice", 2).alias("parValue"),
        F.format_number(F.col("l_extendedprice") - F.col("l_quantity"), 2).alias("currentFaceValue"),
    )
    return FD.feed_records(li.select(payload.alias("payload")), "payload", "soma.holdings", "soma")


@query(
    "feed_soma_rejects",
    """SELECT 'n/a ' || l_orderkey || '-' || l_linenumber AS as_of_text, 'unparseable date' AS reason
FROM lineitem WHERE l_orderkey % 31 = 0""",
)
def feed_soma_rejects(spark, d):
    bad = FD.date_rejects(_soma_records(spark, d), "soma")
    return bad.select(F.get_json_object("raw_record", "$.asOfDate").alias("as_of_text"), "reason")


# ------------------------------------------------------------------ FEED-03
def _repo_payloads(spark, d):
    o = C.TW(spark, d).orders
    payload = _doc(
        "repo.operations",
        F.when(F.col("o_orderstatus") == "O", F.lit("Reverse Repo"))
        .otherwise(F.concat(F.lit("Repo "), "o_orderpriority")).alias("operationType"),
        _d("o_orderdate").alias("operationDate"),
        _d(F.date_add("o_orderdate", 7)).alias("maturityDate"),
        F.concat(F.lit("RP"), "o_orderkey").alias("operationId"),
        F.lit(7).alias("termCalenderDays"),
        F.col("o_orderstatus").alias("auctionStatus"),
        F.col("o_totalprice").alias("totalAmtSubmitted"),
        (F.col("o_totalprice") - 100).alias("totalAmtAccepted"),
    )
    return o.withColumn("payload", payload)


@query(
    "feed_repo",
    """
SELECT CAST(o_orderdate AS DATE) AS operation_date,
       replace(lower(CASE WHEN o_orderstatus = 'O' THEN 'Reverse Repo' ELSE 'Repo ' || o_orderpriority END), ' ', '') AS operation_type,
       'RP' || o_orderkey AS operation_id, CAST(o_orderdate + INTERVAL 7 DAY AS DATE) AS maturity_date, 7 AS term_days,
       o_orderstatus AS operation_status, CAST(o_totalprice AS DECIMAL(20,2)) AS amount_submitted,
       CAST(o_totalprice - 100 AS DECIMAL(20,2)) AS amount_accepted, CAST(NULL AS DECIMAL(10,4)) AS award_rate
FROM orders""",
)
def feed_repo(spark, d):
    return FD.repo_operations(FD.feed_records(_repo_payloads(spark, d), "payload", "repo.operations", "repo"))


def _lines_parts(t):
    return t.lineitem.join(t.part.select("p_partkey", "p_name", "p_type"),
                           F.col("l_partkey") == F.col("p_partkey"))


# ------------------------------------------------------------------ FEED-04
def _mbs_payloads(spark, d):
    j = _lines_parts(C.TW(spark, d))
    payload = _doc(
        "ambs.auctions",
        _d("l_shipdate").alias("operationDate"),
        F.when(F.col("l_returnflag") == "R", "Sale").otherwise("Purchase").alias("operationType"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("cusip"),
        F.col("p_name").alias("securityDescription"),
        _d(F.date_add("l_shipdate", 2)).alias("settlementDate"),
        _d(F.date_add("l_shipdate", 365)).alias("maturityDate"),
        F.col("l_extendedprice").alias("operationAmount"),
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("totalAmtAccepted"),
    )
    return j.withColumn("payload", payload)


@query(
    "feed_mbs",
    """
SELECT CAST(l_shipdate AS DATE) AS operation_date, CASE WHEN l_returnflag = 'R' THEN 'Sale' ELSE 'Purchase' END AS operation_type,
       lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, p_name AS security_description,
       CAST(l_shipdate + INTERVAL 2 DAY AS DATE) AS settlement_date, CAST(l_shipdate + INTERVAL 365 DAY AS DATE) AS maturity_date,
       CAST(l_extendedprice AS DECIMAL(20,2)) AS operation_amount, CAST(l_extendedprice - l_quantity AS DECIMAL(20,2)) AS total_accepted
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def feed_mbs(spark, d):
    return FD.agency_mbs(FD.feed_records(_mbs_payloads(spark, d), "payload", "ambs.auctions", "mbs"))


# ------------------------------------------------------------------ FEED-07
def _treasury_payloads(spark, d):
    j = _lines_parts(C.TW(spark, d))
    payload = _doc(
        "treasury.auctions",
        _d("l_shipdate").alias("operationDate"),
        F.concat(F.lit("Outright "), "l_linestatus").alias("operationType"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("cusip"),
        F.col("p_name").alias("securityDescription"),
        _d(F.date_sub("l_shipdate", 30)).alias("issueDate"),
        _d(F.date_add("l_shipdate", 3650)).alias("maturityDate"),
        F.col("l_discount").alias("couponRate"),
        F.col("p_type").alias("securityTerm"),
        F.col("l_extendedprice").alias("operationAmount"),
        (F.col("l_extendedprice") + F.col("l_quantity")).alias("totalAmtSubmitted"),
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("totalAmtAccepted"),
        (F.col("l_quantity") + 0.5).alias("highPrice"),
        F.col("l_quantity").alias("lowPrice"),
        F.col("l_tax").alias("stopOutRate"),
    )
    return j.withColumn("payload", payload)


@query(
    "feed_treasury",
    """
SELECT CAST(l_shipdate AS DATE) AS operation_date, 'Outright ' || l_linestatus AS operation_type,
       lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, p_name AS security_description,
       CAST(l_shipdate - INTERVAL 30 DAY AS DATE) AS issue_date, CAST(l_shipdate + INTERVAL 3650 DAY AS DATE) AS maturity_date,
       CAST(l_discount AS DECIMAL(10,4)) AS coupon_rate, p_type AS security_term,
       CAST(l_extendedprice AS DECIMAL(20,2)) AS operation_amount, CAST(l_extendedprice + l_quantity AS DECIMAL(20,2)) AS total_submitted,
       CAST(l_extendedprice - l_quantity AS DECIMAL(20,2)) AS total_accepted, CAST(l_quantity + 0.5 AS DECIMAL(15,6)) AS high_price,
       CAST(l_quantity AS DECIMAL(15,6)) AS low_price, CAST(l_tax AS DECIMAL(10,4)) AS stop_out_rate
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def feed_treasury(spark, d):
    return FD.treasury_operations(FD.feed_records(_treasury_payloads(spark, d), "payload", "treasury.auctions", "treasury"))


def _order_lines(t):
    # the fact side is widened for the per-row JSON work (AQE may broadcast
    # the orders, and then the line scan alone decides the parallelism); the
    # order side is read as is (it is joined, not processed row by row)
    return t.lineitem.join(C.T(t.spark, t.sf_dir).orders, F.col("l_orderkey") == F.col("o_orderkey"))


# ------------------------------------------------------------------ FEED-05
def _fx_swaps_payloads(spark, d):
    t = C.TW(spark, d)
    dims = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_nationkey")
    j = _order_lines(t).join(dims, F.col("o_custkey") == F.col("c_custkey"))
    partial = F.col("o_orderstatus") == "P"
    ccy = F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    payload = _doc(
        "fxSwaps.operations",
        F.when(partial, F.lit("")).otherwise(_d("o_orderdate")).alias("swapDate"),
        _d(F.date_add("o_orderdate", 1)).alias("operationDate"),
        _d("l_shipdate").alias("maturityDate"),
        F.col("c_name").alias("counterparty"),
        F.when(F.col("l_linenumber") % 2 == 0, ccy).alias("currencyCode"),
        ccy.alias("currency"),
        F.col("l_extendedprice").alias("usdAmount"),
        (F.col("l_extendedprice") + 1000).alias("foreignCurrencyAmount"),
        (F.lit(1) + F.col("l_discount")).alias("exchangeRate"),
    )
    return j.withColumn("payload", payload)


@query(
    "feed_fx_swaps",
    """
SELECT COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END,
                CAST(o_orderdate + INTERVAL 1 DAY AS DATE)) AS swap_date,
       c_name AS counterparty, 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS currency_code, CAST(l_shipdate AS DATE) AS maturity_date,
       CAST(date_diff('day', COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END,
                                 CAST(o_orderdate + INTERVAL 1 DAY AS DATE)), CAST(l_shipdate AS DATE)) AS INTEGER) AS term_days,
       CAST(l_extendedprice AS DECIMAL(20,2)) AS usd_amount, CAST(l_extendedprice + 1000 AS DECIMAL(20,2)) AS foreign_currency_amount,
       CAST(1 + l_discount AS DECIMAL(15,6)) AS exchange_rate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
)
def feed_fx_swaps(spark, d):
    return FD.fx_swaps(FD.feed_records(_fx_swaps_payloads(spark, d), "payload", "fxSwaps.operations", "fx_swaps"))


# ------------------------------------------------------------------ FEED-06
def _sec_lending_payloads(spark, d):
    j = _order_lines(C.TW(spark, d))
    payload = _doc(
        "seclending.operations",
        _d("o_orderdate").alias("operationDate"),
        F.lit("Lending").alias("operationType"),
        F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("cusip"),
        F.concat(F.lit("part "), "l_partkey").alias("securityDescription"),
        _d("o_orderdate").alias("loanDate"),
        _d("l_shipdate").alias("returnDate"),
        F.when(F.col("l_returnflag") == "A", F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("totalParAmtAccepted"),
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("parAmount"),
        F.col("l_tax").alias("feeRate"),
        F.col("o_orderstatus").alias("operationStatus"),
    )
    return j.withColumn("payload", payload)


@query(
    "feed_sec_lending",
    """
SELECT CAST(o_orderdate AS DATE) AS operation_date, 'Lending' AS operation_type, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip,
       'part ' || l_partkey AS security_description, CAST(o_orderdate AS DATE) AS loan_date, CAST(l_shipdate AS DATE) AS return_date,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS term_days,
       CAST(CASE WHEN l_returnflag = 'A' THEN l_extendedprice - l_quantity ELSE l_extendedprice END AS DECIMAL(20,2)) AS par_amount,
       CAST(l_tax AS DECIMAL(10,4)) AS fee_rate, o_orderstatus AS operation_status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def feed_sec_lending(spark, d):
    return FD.securities_lending(FD.feed_records(_sec_lending_payloads(spark, d), "payload", "seclending.operations", "sec_lending"))


# ------------------------------------------------------------------ FEED-08
def _guide_sheets_payloads(spark, d):
    j = _order_lines(C.TW(spark, d))

    def detail(sec, suffix):
        return F.struct(
            F.lit(sec).alias("secType"),
            F.concat(F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit(suffix)).alias("cusip"),
            _d("l_shipdate").alias("issueDate"),
            _d(F.date_add("l_shipdate", 3650)).alias("maturityDate"),
            F.col("l_discount").alias("percentCouponRate"),
            F.col("l_quantity").alias("settlementPrice"),
            F.col("l_tax").alias("accruedInterest"),
        )

    first = F.struct(
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(_d("o_orderdate")).alias("reportWeeksFromDate"),
        F.col("o_orderpriority").alias("title"),
        F.array(detail("Note", ""), detail("Bond", "B")).alias("details"),
    )
    ignored = F.struct(
        _d("l_shipdate").alias("reportWeeksFromDate"), F.lit("ignored").alias("title"),
        F.array(detail("Bill", "X")).alias("details"),
    )
    payload = F.to_json(F.struct(F.struct(F.array(first, ignored).alias("si")).alias("guidesheet")))
    return j.withColumn("payload", payload)


@query(
    "feed_guide_sheets",
    """
SELECT CAST(o_orderdate AS DATE) AS publication_date, o_orderpriority AS guide_type, sec_type AS security_type,
       lpad(CAST(l_partkey AS VARCHAR), 9, '0') || suffix AS cusip, CAST(l_shipdate AS DATE) AS issue_date,
       CAST(l_shipdate + INTERVAL 3650 DAY AS DATE) AS maturity_date, CAST(l_discount AS DECIMAL(10,4)) AS coupon_rate,
       CAST(l_quantity AS DECIMAL(15,6)) AS settlement_price, CAST(l_tax AS DECIMAL(15,6)) AS accrued_interest
FROM lineitem JOIN orders ON l_orderkey = o_orderkey,
     (VALUES ('Note', ''), ('Bond', 'B')) s(sec_type, suffix)
WHERE o_orderstatus <> 'P'""",
)
def feed_guide_sheets(spark, d):
    return FD.guide_sheets(_guide_sheets_payloads(spark, d), "payload")


# ------------------------------------------------------------------ FEED-01..08: rows and rejects in one pass
def _damaged(payloads, key, field):
    """The payloads; of every 31st key the date field holds text that names the key."""
    bad = F.regexp_replace("payload", F.lit(f'"{field}":"[^"]*"'), F.concat(F.lit(f'"{field}":"n/a '), key.cast("string"), F.lit('"')))
    return payloads.withColumn("payload", F.when(key % 31 == 0, bad).otherwise(F.col("payload")))


def _rejects(spark, payloads, transform, root, feed, field, key):
    """The feed split in one write; its rejects, and one row with the number of rows accepted beside them."""
    damaged = _damaged(payloads, key, field)
    records = damaged if root is None else FD.feed_records(damaged, "payload", root, feed)
    out = staging_dir(spark, f"feed_{feed}")
    counts = FD.split_feed(transform, records, out)
    split = spark.read.parquet(out)
    accepted = FD.accepted_rows(split).agg(F.count("*").alias("rows"))
    rejected = FD.rejected_rows(split).select(
        F.get_json_object("raw_record", f"$.{field}").alias("bad_text"), "reason", F.lit(1).cast("long").alias("rows"))
    same = F.when(F.col("rows") == counts["accepted"], "accepted, as observed").otherwise("accepted, not as observed")
    return rejected.unionByName(accepted.select(F.lit(None).cast("string").alias("bad_text"), same.alias("reason"), "rows"))


def _rejects_sql(source, key, reason=FD.BAD_DATE, ok="TRUE", copies=1):
    return f"""
SELECT 'n/a ' || {key} AS bad_text, '{reason}' AS reason, CAST(1 AS BIGINT) AS rows FROM {source}, range({copies}) WHERE {key} % 31 = 0
UNION ALL SELECT NULL, 'accepted, as observed', count(*) FROM {source}, range({copies}) WHERE {key} % 31 <> 0 AND {ok}"""


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


@query("feed_reference_rates_rejects", """
SELECT CASE WHEN event_id % 31 = 0 THEN 'n/a ' || event_id ELSE '' END AS bad_text, 'missing or unparseable date' AS reason,
       CAST(1 AS BIGINT) AS rows FROM events WHERE event_id % 31 = 0 OR event_id % 11 = 0
UNION ALL SELECT NULL, 'accepted, as observed', count(*) FROM events WHERE event_id % 31 <> 0 AND event_id % 11 <> 0""")
def feed_reference_rates_rejects(spark, d):
    return _rejects(spark, _reference_rates_payloads(spark, d), FD.reference_rates, "refRates", "reference_rates", "effectiveDate", F.col("event_id"))


@query("feed_repo_rejects", _rejects_sql("orders", "o_orderkey"))
def feed_repo_rejects(spark, d):
    return _rejects(spark, _repo_payloads(spark, d), FD.repo_operations, "repo.operations", "repo", "operationDate", F.col("o_orderkey"))


@query("feed_mbs_rejects", _rejects_sql("lineitem JOIN part ON l_partkey = p_partkey", "l_orderkey"))
def feed_mbs_rejects(spark, d):
    return _rejects(spark, _mbs_payloads(spark, d), FD.agency_mbs, "ambs.auctions", "mbs", "settlementDate", F.col("l_orderkey"))


@query("feed_fx_swaps_rejects", _rejects_sql(f"{LINES} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", "l_orderkey"))
def feed_fx_swaps_rejects(spark, d):
    return _rejects(spark, _fx_swaps_payloads(spark, d), FD.fx_swaps, "fxSwaps.operations", "fx_swaps", "maturityDate", F.col("l_orderkey"))


@query("feed_sec_lending_rejects", _rejects_sql(LINES, "l_orderkey"))
def feed_sec_lending_rejects(spark, d):
    return _rejects(spark, _sec_lending_payloads(spark, d), FD.securities_lending, "seclending.operations", "sec_lending", "returnDate", F.col("l_orderkey"))


@query("feed_treasury_rejects", _rejects_sql("lineitem JOIN part ON l_partkey = p_partkey", "l_orderkey"))
def feed_treasury_rejects(spark, d):
    return _rejects(spark, _treasury_payloads(spark, d), FD.treasury_operations, "treasury.auctions", "treasury", "issueDate", F.col("l_orderkey"))


@query("feed_guide_sheets_rejects", """
SELECT CASE WHEN l_orderkey % 31 = 0 THEN 'n/a ' || l_orderkey ELSE strftime(l_shipdate, '%Y-%m-%d') END AS bad_text,
       'missing or unparseable date' AS reason, CAST(1 AS BIGINT) AS rows
FROM lineitem JOIN orders ON l_orderkey = o_orderkey, range(2) WHERE l_orderkey % 31 = 0 OR o_orderstatus = 'P'
UNION ALL SELECT NULL, 'accepted, as observed', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey, range(2)
WHERE l_orderkey % 31 <> 0 AND o_orderstatus <> 'P'""")
def feed_guide_sheets_rejects(spark, d):
    def transform(payloads, both):
        return FD.guide_sheets(payloads, "payload", both=both)

    return _rejects(spark, _guide_sheets_payloads(spark, d), transform, None, "guide_sheets", "issueDate", F.col("l_orderkey"))


# ------------------------------------------------------------------ FEED-09
@query(
    "feed_counterparties",
    """
SELECT name AS counterparty_name, 'Central Bank' AS counterparty_type, TRUE AS is_active
FROM (SELECT unnest([c_name, '', c_mktsegment]) AS name FROM customer) WHERE name <> ''""",
)
def feed_counterparties(spark, d):
    c = C.TW(spark, d).customer
    payload = F.to_json(F.struct(F.array("c_name", F.lit(""), "c_mktsegment").alias("counterparties")))
    return FD.counterparties(_records(c.select(payload.alias("payload")), "counterparties"))


# ------------------------------------------------------------------ FEED-11
@query(
    "feed_sonia",
    """
SELECT CAST(ts AS DATE) AS effective_date, CAST(CAST(round(value / 10, 4) AS VARCHAR) AS DOUBLE)::DECIMAL(10,4) AS rate_percent
FROM events WHERE event_id % 13 <> 0""",
)
def feed_sonia(spark, d):
    e = C.TW(spark, d).events
    rate = F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).otherwise(F.round(F.col("value") / 10, 4).cast("string"))
    rec = F.to_json(F.struct(F.date_format("ts", "dd MMM yyyy").alias("date"), rate.alias("rate")))
    recs = e.select(rec.alias("payload"))
    return FD.sonia_rates(PL.extract_path(recs, "payload", ""))


# ------------------------------------------------------------------ FEED-12/13
PRICE_SQL = """ticks AS (
  SELECT event_id, user_id, ts, event_type, value, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'T' || user_id END AS symbol
  FROM events)"""


def _ticks(t):
    e = t.events
    return e.withColumn("symbol", F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.concat(F.lit("T"), "user_id")))


@query(
    "feed_crypto",
    C.with_ctes(
        PRICE_SQL,
        body="""SELECT symbol, 'coin-' || user_id AS coin_id, CAST(ts AS DATE) AS price_date,
       CAST(value AS DECIMAL(18,6)) AS open, CAST(value * 1.1 AS DECIMAL(18,6)) AS high,
       CAST(value * 0.9 AS DECIMAL(18,6)) AS low, CAST(value AS DECIMAL(18,6)) AS close
FROM ticks WHERE symbol IS NOT NULL""",
    ),
)
def feed_crypto(spark, d):
    k = _ticks(C.TW(spark, d))
    v = F.col("value")
    rec = F.to_json(F.struct(
        "symbol", F.concat(F.lit("coin-"), "user_id").alias("coin_id"), _d("ts").alias("price_date"),
        v.alias("open"), (v * 1.1).alias("high"), (v * 0.9).alias("low"), v.alias("close"),
    ))
    return FD.crypto_ohlc(PL.extract_path(k.select(rec.alias("payload")), "payload", ""))


@query(
    "feed_prices",
    C.with_ctes(
        PRICE_SQL,
        body="""SELECT symbol, 'tk' || user_id AS ticker, event_type AS category, CAST(ts AS DATE) AS price_date,
       CAST(value AS DECIMAL(18,6)) AS open, CAST(value + 1 AS DECIMAL(18,6)) AS high,
       CAST(value - 1 AS DECIMAL(18,6)) AS low, CAST(value AS DECIMAL(18,6)) AS close, event_id * 100 AS volume
FROM ticks WHERE symbol IS NOT NULL""",
    ),
)
def feed_prices(spark, d):
    k = _ticks(C.TW(spark, d))
    v = F.col("value")
    rec = F.to_json(F.struct(
        "symbol", F.concat(F.lit("tk"), "user_id").alias("ticker"), F.col("event_type").alias("category"),
        _d("ts").alias("price_date"), v.alias("open"), (v + 1).alias("high"), (v - 1).alias("low"), v.alias("close"),
        (F.col("event_id") * 100).alias("volume"),
    ))
    return FD.prices(PL.extract_path(k.select(rec.alias("payload")), "payload", ""), ["ticker", "category"])


# ------------------------------------------------------------------ MKT-*
@query(
    "mkt_latest",
    C.with_ctes(
        C.LOGS_SQL,
        body="""SELECT run_uuid, arg_max(logentryid, ("timestamp", logentryid)) AS logentryid,
       max("timestamp") AS "timestamp", arg_max(stepruntime, ("timestamp", logentryid)) AS stepruntime
FROM logs WHERE stepruntime IS NOT NULL GROUP BY run_uuid""",
    ),
)
def mkt_latest(spark, d):
    lg = C.logs(C.TW(spark, d)).select("run_uuid", "logentryid", "timestamp", "stepruntime")
    return FD.latest_non_null(lg, "run_uuid", ["timestamp", "logentryid"], "stepruntime")


@query(
    "mkt_enrich",
    """
SELECT e.event_id, e.symbol, c.c_name AS symbol_name, n.n_name AS region
FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -user_id ELSE user_id END AS symbol FROM events) e
JOIN customer c ON e.symbol = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""",
)
def mkt_enrich(spark, d):
    t = C.TW(spark, d)
    dim = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("c_name").alias("symbol_name"), F.col("n_name").alias("region"))
    # some prices have no ticker, some one that no symbol has
    ticker = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 13 == 0, -F.col("user_id")).otherwise(F.col("user_id"))
    j = FD.enrich_symbols(t.events.select("event_id", ticker.alias("symbol")), "symbol", dim, "c_custkey")
    return j.select("event_id", "symbol", "symbol_name", "region")


OHLC_SQL = """SELECT {keys}, CAST(arg_min(value, (ts, event_id)) AS DECIMAL(18,6)) AS open,
       CAST(max(value * 1.1) AS DECIMAL(18,6)) AS high, CAST(min(value * 0.9) AS DECIMAL(18,6)) AS low,
       CAST(arg_max(value, (ts, event_id)) AS DECIMAL(18,6)) AS close, CAST(max(ts) AS DATE) AS price_date
FROM events GROUP BY {keys}"""


@query("mkt_ohlc", OHLC_SQL.format(keys="user_id"))
def mkt_ohlc(spark, d):
    e = C.TW(spark, d).events
    v = F.col("value")
    return FD.ohlc(e, ["user_id"], "ts", "event_id", v, v * 1.1, v * 0.9, v)


@query("mkt_ohlc_daily", OHLC_SQL.replace("SELECT {keys}", "SELECT user_id, CAST(ts AS DATE) AS day").format(
    keys="user_id, CAST(ts AS DATE)"))
def mkt_ohlc_daily(spark, d):
    e = C.TW(spark, d).events.withColumn("day", F.to_date("ts"))
    v = F.col("value")
    return FD.ohlc(e, ["user_id", "day"], "ts", "event_id", v, v * 1.1, v * 0.9, v)


# ------------------------------------------------------------------ SRC-08..15
@query("src_json_path", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events")
def src_json_path(spark, d):
    e = C.TW(spark, d).events
    payload = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(
        F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("bigint").alias("value"))).alias("items"))
        .alias("results")).alias("data")))
    recs = PL.extract_path(e.select(payload.alias("payload")), "payload", "data.results.items")
    return recs.select(PL.field("id", "bigint").alias("id"), PL.field("value", "bigint").alias("value"))


@query(
    "src_suppressed",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events""",
)
def src_suppressed(spark, d):
    e = C.TW(spark, d).events
    txt = F.when(F.col("event_type") == "error", F.regexp_replace("props", r":\s*[0-9]+", ": *")).otherwise(F.col("props"))
    clean = PL.null_suppressed(txt)
    return e.select("event_id", F.try_variant_get(F.try_parse_json(clean), "$.k", "bigint").alias("k"))


@query(
    "src_pages",
    """
WITH stops AS (SELECT user_id, min((ts, event_id)) AS stop FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT e.user_id AS endpoint, e.event_id AS id, e.value AS value
FROM events e LEFT JOIN stops s USING (user_id)
WHERE e.event_type <> 'error' AND (s.stop IS NULL OR (e.ts, e.event_id) < s.stop)""",
)
def src_pages(spark, d):
    e = C.TW(spark, d).events
    rec = F.array(F.struct(F.col("event_id").alias("id"), F.col("value").alias("value")))
    empty = F.array().cast("array<struct<id:bigint,value:double>>")
    et = F.col("event_type")
    payload = (
        F.when(et == "error", F.to_json(F.struct(empty.alias("results"))))
        .when(et == "click", F.to_json(F.struct(rec.alias("data"))))
        .otherwise(F.to_json(F.struct(rec.alias("results"))))
    )
    pages = e.select(F.col("user_id").alias("endpoint"), "ts", "event_id", payload.alias("payload"))
    rows = PL.combine_pages(pages, "endpoint", ["ts", "event_id"], "payload")
    return rows.select("endpoint", PL.field("id", "bigint").alias("id"), PL.field("value", "double").alias("value"))


@query(
    "src_melt",
    """SELECT event_id, event_type AS ticker, value AS open, value + 1 AS close, CAST(user_id AS DOUBLE) AS volume
FROM events""",
)
def src_melt(spark, d):
    e = C.TW(spark, d).events
    # a wide price panel: one row per tick, columns <field>|<ticker> for every ticker; the
    # tickers are its schema, which the driver has to know, and not rows
    tickers = sorted(r[0] for r in e.select("event_type").distinct().collect())
    cols = []
    for tk in tickers:
        mine = F.col("event_type") == tk
        cols += [
            F.when(mine, F.col("value")).alias(f"open|{tk}"),
            F.when(mine, F.col("value") + 1).alias(f"close|{tk}"),
            F.when(mine, F.col("user_id").cast("double")).alias(f"volume|{tk}"),
        ]
    wide = e.select("event_id", *cols)
    long = PL.melt_panel(wide, ["event_id"], [c for c in wide.columns if c != "event_id"])
    return long.filter(F.col("open").isNotNull())


@query(
    "src_html_cards",
    r"""
WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li\b[^>]*>.*?</li>|<p\b[^>]*>.*?</p>')) AS block,
                  generate_subscripts(regexp_extract_all(html, '(?is)<li\b[^>]*>.*?</li>|<p\b[^>]*>.*?</p>'), 1) AS position
           FROM pages)
SELECT page_id, CAST(position AS INTEGER) AS position,
       NULLIF(trim(regexp_extract(block, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1)), '') AS image_url,
       NULLIF(trim(regexp_extract(block, '(?is)<a\b[^>]*>(.*?)</a>', 1)), '') AS alt_text,
       NULLIF(trim(regexp_replace(regexp_extract(block, '(?is)<b\b[^>]*>(.*?)</b>', 1), '<[^>]*>', '', 'g')), '') AS caption
FROM b WHERE NULLIF(trim(regexp_extract(block, '(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1)), '') IS NOT NULL""",
)
def src_html_cards(spark, d):
    p = C.TW(spark, d).pages
    return PL.extract_cards(
        p, "page_id", "html",
        card=r"(?is)<li\b[^>]*>.*?</li>|<p\b[^>]*>.*?</p>",
        image=r'(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"',
        alt=r"(?is)<a\b[^>]*>(.*?)</a>",
        caption=r"(?is)<b\b[^>]*>(.*?)</b>",
    )


@query(
    "src_search",
    """
SELECT 'ids-' || p_partkey AS manifest_id, p_name AS title, COALESCE(p_type, '') AS object_type,
       CASE WHEN p_size % 2 = 0 THEN '' ELSE CAST(1900 + p_size AS VARCHAR) END AS date,
       CAST(p_size % 3 AS INTEGER) AS media_count,
       CASE WHEN p_size % 3 = 0 THEN '' ELSE 'ids-' || p_partkey END AS first_media_id
FROM part""",
)
def src_search(spark, d):
    p = C.TW(spark, d).part
    n = F.col("p_size") % 3
    media = F.filter(
        F.array(F.struct(F.concat(F.lit("ids-"), "p_partkey").alias("id")),
                F.struct(F.concat(F.lit("ids2-"), "p_partkey").alias("id"))),
        lambda x, i: i < n,
    )
    doc = F.to_json(F.struct(
        F.concat(F.lit("ids-"), "p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("objectType"),
        F.when(F.col("p_size") % 2 == 1, (F.lit(1900) + F.col("p_size")).cast("string")).alias("date"),
        media.alias("media"),
    ))
    return PL.flatten_search(p.select(doc.alias("payload")), "payload")


@query(
    "src_bindings",
    """
SELECT id, arg_min(title, page_id) AS title FROM (
  SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]*$') AS id,
         regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages)
GROUP BY id""",
)
def src_bindings(spark, d):
    p = C.TW(spark, d).pages.select("page_id", "url", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
    return PL.flatten_bindings(p, "url", "title", "page_id")
