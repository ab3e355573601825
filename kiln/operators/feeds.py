"""Feed transforms (FEED-*) and market-price operators (MKT-*).

Each feed transform takes the records of landed payloads (a VARIANT column
``record``, see ``sources.payloads.extract_path``) and returns the typed
target rows.  A row whose required field is missing or unparseable is
dropped from the output and kept as a reject instead of failing the
batch; ``split_feed`` writes both sides in one pass.  Columns are typed to the target tables (DECIMAL(p, s) as declared).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.scalars import first_truthy, has_java_suffix, parse_date, parse_numeric, term_days
from kiln.sources.payloads import RECORD, element_texts, field, fits, node_of, node_text, open_records, opened, text_at, text_fields, typed_doc

D104 = "decimal(10,4)"
D152 = "decimal(15,2)"
D156 = "decimal(15,6)"
D186 = "decimal(18,6)"
D202 = "decimal(20,2)"


# The fields each feed reads.
FIELDS = {
    "reference_rates": ("type", "effectiveDate", "percentRate", "volumeInBillions", "percentile1", "percentile25", "percentile75",
                        "percentile99", "targetRangeFrom", "targetRangeTo"),
    "soma": ("asOfDate", "securityType", "cusip", "securityDescription", "maturityDate", "parValue", "currentFaceValue"),
    "repo": ("operationDate", "operationType", "operationId", "maturityDate", "termCalenderDays", "auctionStatus", "totalAmtSubmitted",
             "totalAmtAccepted"),
    "mbs": ("operationDate", "operationType", "cusip", "securityDescription", "settlementDate", "maturityDate", "operationAmount",
            "totalAmtAccepted"),
    "fx_swaps": ("swapDate", "operationDate", "counterparty", "currencyCode", "currency", "maturityDate", "usdAmount",
                 "foreignCurrencyAmount", "exchangeRate"),
    "sec_lending": ("operationDate", "operationType", "cusip", "securityDescription", "loanDate", "returnDate", "totalParAmtAccepted",
                    "parAmount", "feeRate", "operationStatus"),
    "treasury": ("operationDate", "operationType", "cusip", "securityDescription", "issueDate", "maturityDate", "couponRate",
                 "securityTerm", "operationAmount", "totalAmtSubmitted", "totalAmtAccepted", "highPrice", "lowPrice", "stopOutRate"),
    "guide_sheets": ("secType", "cusip", "issueDate", "maturityDate", "percentCouponRate", "settlementPrice", "accruedInterest"),
}
# The date fields of the feeds; text there that is no date makes a record a reject, a blank is NULL.
DATE_FIELDS = {
    "reference_rates": ("effectiveDate",),
    "soma": ("asOfDate", "maturityDate"),
    "repo": ("operationDate", "maturityDate"),
    "mbs": ("operationDate", "settlementDate", "maturityDate"),
    "fx_swaps": ("swapDate", "operationDate", "maturityDate"),
    "sec_lending": ("operationDate", "loanDate", "returnDate"),
    "treasury": ("operationDate", "issueDate", "maturityDate"),
    "guide_sheets": ("issueDate", "maturityDate"),
}
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
BAD_DATE, NO_DATE = "unparseable date", "missing or unparseable date"


def _text(name: str) -> Column:
    return F.col(RECORD)["f"][name]


def _date(name: str) -> Column:
    return F.col(RECORD)["d"][name]


def iso_date(text: Column) -> Column:
    """``parse_date``; ten characters of the common form are cast, which costs a fraction of a formatter's parse."""
    return F.when(F.rlike(text, F.lit(r"\A(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z")), text.try_cast("date")).otherwise(parse_date(text))


def _dates(feed: str):
    """The feed's date fields as dates, of a record's text fields."""
    return lambda f: F.struct(*[iso_date(f[n]).alias(n) for n in DATE_FIELDS[feed]])


def _num(name: str, dtype: str) -> Column:
    text = F.when(~has_java_suffix(_text(name)), _text(name))
    return text.try_cast("decimal(38,10)").try_cast(dtype) if dtype == "int" else text.try_cast(dtype)


def _keep_valid(df: DataFrame, required: Column) -> DataFrame:
    return df.filter(F.coalesce(required, F.lit(False)))


def feed_records(payloads: DataFrame, json_col: str, path: str, feed: str) -> DataFrame:
    """The records of a feed's landed documents, each parsed once."""
    return open_records(payloads, json_col, path, FIELDS[feed], _dates(feed), lambda r: ~_dates_sound(feed, r))


def _opened(records: DataFrame, feed: str) -> DataFrame:
    """Records as ``feed_records`` gives them; those of ``extract_path`` (VARIANT) are turned into them."""
    if not isinstance(records.schema[RECORD].dataType, T.VariantType):
        return records
    fields = F.struct(*[field(n).alias(n) for n in FIELDS[feed]])
    return records.select(*[c for c in records.columns if c != RECORD],
                          F.struct(F.to_json(F.col(RECORD)).alias("raw"), fields.alias("f")).alias(RECORD)).withColumn(
        RECORD, F.struct(f"{RECORD}.raw", f"{RECORD}.f", _dates(feed)(F.col(RECORD)["f"]).alias("d")))


def _dates_sound(feed: str, record: Column | None = None) -> Column:
    """No date field of the record holds text that isn't a date; a reference rate has a date."""
    record = F.col(RECORD) if record is None else record

    def sound(name: str) -> Column:
        return (F.coalesce(record["f"][name], F.lit("")) == "") | record["d"][name].isNotNull()

    if feed == "reference_rates":
        return record["d"]["effectiveDate"].isNotNull()
    return reduce(lambda a, b: a & b, [sound(n) for n in DATE_FIELDS[feed]])


def _outcome(records: DataFrame, feed: str, sound: Column, reason: str, columns: list[Column], both: bool) -> DataFrame:
    """The typed rows of the sound records; with ``both`` all records as (outcome, row, raw_record, reason)."""
    rows = _opened(records, feed)
    ok = F.coalesce(sound, F.lit(False))
    if not both:
        return rows.filter(ok).select(*columns)
    return rows.select(
        F.when(ok, "accepted").otherwise("rejected").alias("outcome"), F.when(ok, F.struct(*columns)).alias("row"),
        F.when(~ok, F.col(RECORD)["raw"]).alias("raw_record"), F.when(~ok, F.lit(reason)).alias("reason"))


def split_feed(transform, records: DataFrame, out: str) -> dict:
    """One pass over a feed: a single write, partitioned by outcome, holds the typed rows and the rejects.

    Returns the counts, observed by the write; ``accepted_rows`` and ``rejected_rows`` read the two sides.
    """
    counts = Observation()
    rows = transform(records, both=True).observe(
        counts, F.count_if(F.col("outcome") == "accepted").alias("accepted"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    # a writer for each outcome is open at once, so that no task sorts its rows by outcome
    conf = rows.sparkSession.conf
    writers = conf.get(WRITERS, None)
    conf.set(WRITERS, "2")
    try:
        rows.write.mode("overwrite").partitionBy("outcome").parquet(out)
    finally:
        conf.unset(WRITERS) if writers is None else conf.set(WRITERS, writers)
    return dict(counts.get)


def accepted_rows(split: DataFrame) -> DataFrame:
    return split.filter(F.col("outcome") == "accepted").select("row.*")


def rejected_rows(split: DataFrame) -> DataFrame:
    return split.filter(F.col("outcome") == "rejected").select("raw_record", "reason")


def date_rejects(records: DataFrame, feed: str) -> DataFrame:
    """The records of a feed that its transform skips for an unparseable date."""
    return rejected_rows(_outcome(records, feed, _dates_sound(feed), BAD_DATE, [F.lit(None).alias("none")], True))


# ---------------------------------------------------------------- FEED-01..10
def reference_rates(records: DataFrame, both: bool = False) -> DataFrame:
    """FEED-01: rows without an effective date are skipped."""
    return _outcome(records, "reference_rates", _dates_sound("reference_rates"), NO_DATE, [
        _text("type").alias("rate_type"),
        _date("effectiveDate").alias("effective_date"),
        _num("percentRate", D104).alias("rate_percent"),
        _num("volumeInBillions", D152).alias("volume_billions"),
        _num("percentile1", D104).alias("percentile_1"),
        _num("percentile25", D104).alias("percentile_25"),
        _num("percentile75", D104).alias("percentile_75"),
        _num("percentile99", D104).alias("percentile_99"),
        _num("targetRangeFrom", D104).alias("target_range_from"),
        _num("targetRangeTo", D104).alias("target_range_to"),
    ], both)


def soma_holdings(records: DataFrame, both: bool = False) -> DataFrame:
    """FEED-02: par / face values arrive as text with thousands commas."""
    return _outcome(records, "soma", _dates_sound("soma"), BAD_DATE, [
        _date("asOfDate").alias("as_of_date"),
        _text("securityType").alias("security_type"),
        _text("cusip").alias("cusip"),
        _text("securityDescription").alias("security_description"),
        _date("maturityDate").alias("maturity_date"),
        parse_numeric(_text("parValue")).cast(D202).alias("par_value"),
        parse_numeric(_text("currentFaceValue")).cast(D202).alias("current_face_value"),
    ], both)


def repo_operations(records: DataFrame, both: bool = False) -> DataFrame:
    """FEED-03: repo and reverse repo; type lower-cased without spaces."""
    return _outcome(records, "repo", _dates_sound("repo"), BAD_DATE, [
        _date("operationDate").alias("operation_date"),
        F.replace(F.lower(F.coalesce(_text("operationType"), F.lit(""))), F.lit(" "), F.lit("")).alias("operation_type"),
        _text("operationId").alias("operation_id"),
        _date("maturityDate").alias("maturity_date"),
        _num("termCalenderDays", "int").alias("term_days"),
        _text("auctionStatus").alias("operation_status"),
        _num("totalAmtSubmitted", D202).alias("amount_submitted"),
        _num("totalAmtAccepted", D202).alias("amount_accepted"),
        F.lit(None).cast(D104).alias("award_rate"),
    ], both)


def agency_mbs(records: DataFrame, both: bool = False) -> DataFrame:
    """FEED-04."""
    return _outcome(records, "mbs", _dates_sound("mbs"), BAD_DATE, [
        _date("operationDate").alias("operation_date"),
        _text("operationType").alias("operation_type"),
        _text("cusip").alias("cusip"),
        _text("securityDescription").alias("security_description"),
        _date("settlementDate").alias("settlement_date"),
        _date("maturityDate").alias("maturity_date"),
        _num("operationAmount", D202).alias("operation_amount"),
        _num("totalAmtAccepted", D202).alias("total_accepted"),
    ], both)


def fx_swaps(records: DataFrame, both: bool = False) -> DataFrame:
    """FEED-05: swap date falls back to the operation date, currency code to
    currency; term days = maturity - swap."""
    swap = F.when(_text("swapDate") != "", _date("swapDate")).otherwise(_date("operationDate"))
    mat = _date("maturityDate")
    return _outcome(records, "fx_swaps", _dates_sound("fx_swaps"), BAD_DATE, [
        swap.alias("swap_date"),
        _text("counterparty").alias("counterparty"),
        first_truthy(_text("currencyCode"), _text("currency")).alias("currency_code"),
        mat.alias("maturity_date"),
        term_days(mat, swap).alias("term_days"),
        _num("usdAmount", D202).alias("usd_amount"),
        _num("foreignCurrencyAmount", D202).alias("foreign_currency_amount"),
        _num("exchangeRate", D156).alias("exchange_rate"),
    ], both)


def securities_lending(records: DataFrame, both: bool = False) -> DataFrame:
    """FEED-06: term days = return - loan; par amount falls back (0 falls
    through, as Python's ``or`` does)."""
    loan, ret = _date("loanDate"), _date("returnDate")
    return _outcome(records, "sec_lending", _dates_sound("sec_lending"), BAD_DATE, [
        _date("operationDate").alias("operation_date"),
        _text("operationType").alias("operation_type"),
        _text("cusip").alias("cusip"),
        _text("securityDescription").alias("security_description"),
        loan.alias("loan_date"),
        ret.alias("return_date"),
        term_days(ret, loan).alias("term_days"),
        first_truthy(_num("totalParAmtAccepted", "double"), _num("parAmount", "double")).cast(D202).alias("par_amount"),
        _num("feeRate", D104).alias("fee_rate"),
        _text("operationStatus").alias("operation_status"),
    ], both)


def treasury_operations(records: DataFrame, both: bool = False) -> DataFrame:
    """FEED-07: 14 typed columns."""
    return _outcome(records, "treasury", _dates_sound("treasury"), BAD_DATE, [
        _date("operationDate").alias("operation_date"),
        _text("operationType").alias("operation_type"),
        _text("cusip").alias("cusip"),
        _text("securityDescription").alias("security_description"),
        _date("issueDate").alias("issue_date"),
        _date("maturityDate").alias("maturity_date"),
        _num("couponRate", D104).alias("coupon_rate"),
        _text("securityTerm").alias("security_term"),
        _num("operationAmount", D202).alias("operation_amount"),
        _num("totalAmtSubmitted", D202).alias("total_submitted"),
        _num("totalAmtAccepted", D202).alias("total_accepted"),
        _num("highPrice", D156).alias("high_price"),
        _num("lowPrice", D156).alias("low_price"),
        _num("stopOutRate", D104).alias("stop_out_rate"),
    ], both)


def guide_sheets(payloads: DataFrame, json_col: str, path: str = "guidesheet.si", both: bool = False) -> DataFrame:
    """FEED-08: only the FIRST object at ``path`` of each document is used;
    its header fields repeat on every element of its ``details``; a document
    whose first object has no publication date yields nothing."""
    names = FIELDS["guide_sheets"]
    docs = payloads.select(F.col(json_col).alias("_text"), typed_doc(
        json_col, path, f"struct<reportWeeksFromDate: string, title: string, details: array<{text_fields(names)}>>").alias("_doc"))
    docs = docs.withColumn("_published", iso_date(F.get(node_of(F.col("_doc"), path), F.lit(0))["reportWeeksFromDate"]))

    # the header's fields are made with the records, so that a filter on them can't move below the parsing
    def rows_of(header, published, details):
        return opened(details, _dates("guide_sheets"), published.alias("publication_date"), F.coalesce(header["title"], F.lit("SI")).alias("guide_type"))

    def texts_of(header):
        listed = F.startswith(F.ltrim(header["details"]), F.lit("["))
        return F.when(listed, element_texts(header["details"])).otherwise(F.array().cast("array<string>"))

    first = F.from_json(F.get(element_texts(node_text("_text", path)), F.lit(0)), "struct<reportWeeksFromDate: string, title: string, details: string>")
    head = F.get(node_of(F.col("_doc"), path), F.lit(0))
    found = F.when(fits(F.col("_doc")), rows_of(head, F.col("_published"), head["details"])).otherwise(F.flatten(F.transform(
        F.array(first), lambda h: rows_of(h, iso_date(h["reportWeeksFromDate"]), F.transform(texts_of(h), lambda r: F.from_json(r, text_fields(names)))))))
    def sound_in(record):
        return record["publication_date"].isNotNull() & _dates_sound("guide_sheets", record)

    raw = text_at(typed_doc("_text", path, "struct<details: array<string>>"), lambda d: F.get(node_of(d, path), F.lit(0))["details"],
                  F.element_at(F.transform(F.array(first), texts_of), 1))
    rows = docs.select("_text", F.posexplode(found).alias("_at", "_r")).select(
        F.struct(F.when(~sound_in(F.col("_r")), raw).alias("raw"), "_r.f", "_r.d").alias(RECORD), "_r.publication_date", "_r.guide_type")
    sound = F.col("publication_date").isNotNull() & _dates_sound("guide_sheets")
    return _outcome(rows, "guide_sheets", sound, NO_DATE, [
        F.col("publication_date"),
        F.col("guide_type"),
        _text("secType").alias("security_type"),
        _text("cusip").alias("cusip"),
        _date("issueDate").alias("issue_date"),
        _date("maturityDate").alias("maturity_date"),
        _num("percentCouponRate", D104).alias("coupon_rate"),
        _num("settlementPrice", D156).alias("settlement_price"),
        _num("accruedInterest", D156).alias("accrued_interest"),
    ], both)


def _variant_date(name: str) -> Column:
    return parse_date(field(name))


def counterparties(records: DataFrame) -> DataFrame:
    """FEED-09: a list of names -> rows; empty names skipped."""
    name = F.try_variant_get(F.col(RECORD), "$", "string")
    out = records.select(
        name.alias("counterparty_name"), F.lit("Central Bank").alias("counterparty_type"), F.lit(True).alias("is_active")
    )
    return _keep_valid(out, F.coalesce(F.col("counterparty_name"), F.lit("")) != "")


DEFAULT_SERIES_BREAK = "SBN2024"  # fixed value: dealer statistics default series break


def series_break(available: list[str] | None) -> str:
    """FEED-10: the series break requested for dealer statistics: the first
    one the endpoint lists, else the default."""
    return available[0] if available else DEFAULT_SERIES_BREAK


def passthrough(records: DataFrame, columns: list[str]) -> DataFrame:
    """FEED-10: no transform; the named fields as text, typed later by the
    target table's import strategy."""
    return records.select(*[field(c).alias(c) for c in columns])


# ---------------------------------------------------------------- FEED-11..13
def sonia_rates(records: DataFrame) -> DataFrame:
    """FEED-11: 'dd MMM yyyy' dates; rows with a missing date or a
    non-numeric rate are skipped."""
    d = field("date")
    r = field("rate")
    out = records.select(
        F.try_to_timestamp(d, F.lit("dd MMM yyyy")).cast("date").alias("effective_date"),
        r.try_cast("double").alias("_rate"),
        d.alias("_d"),
        r.alias("_r"),
    )
    ok = (F.coalesce(F.col("_d"), F.lit("")) != "") & (F.coalesce(F.col("_r"), F.lit("")) != "") & F.col("_rate").isNotNull()
    return _keep_valid(out, ok & F.col("effective_date").isNotNull()).select(
        "effective_date", F.col("_rate").cast(D104).alias("rate_percent")
    )


def crypto_ohlc(records: DataFrame) -> DataFrame:
    """FEED-12: symbol and price date are required."""
    out = records.select(
        field("symbol").alias("symbol"),
        field("coin_id").alias("coin_id"),
        _variant_date("price_date").alias("price_date"),
        *[field(c, D186).alias(c) for c in ("open", "high", "low", "close")],
    )
    return _keep_valid(out, F.col("symbol").isNotNull() & (F.col("symbol") != "") & F.col("price_date").isNotNull())


def prices(records: DataFrame, attributes: list[str], with_volume: bool = True) -> DataFrame:
    """FEED-13: commodities / US indexes / global indexes / sector ETFs: one
    parametrised transform, the attribute columns differ per feed."""
    cols = [field("symbol").alias("symbol"), *[field(a).alias(a) for a in attributes], _variant_date("price_date").alias("price_date")]
    cols += [field(c, D186).alias(c) for c in ("open", "high", "low", "close")]
    if with_volume:
        cols.append(field("volume", "bigint").alias("volume"))
    out = records.select(*cols)
    return _keep_valid(out, F.col("symbol").isNotNull() & (F.col("symbol") != "") & F.col("price_date").isNotNull())


# ---------------------------------------------------------------- MKT-*
def latest_non_null(df: DataFrame, key: str, ts: list[str], col: str) -> DataFrame:
    """MKT-01: per key, the latest row with a non-NULL ``col``:
    ``max_by(struct(*), (ts...))`` is a partial aggregate (no sort, no window),
    so a hot key costs one partial row per task."""
    rec = F.struct(*[F.col(c) for c in df.columns if c != key])
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(key)
        .agg(F.max_by(rec, F.struct(*[F.col(t) for t in ts])).alias("_r"))
        .select(key, "_r.*")
    )


def enrich_symbols(df: DataFrame, ticker: str, dim: DataFrame, dim_key: str) -> DataFrame:
    """MKT-02: ticker -> symbol attributes; unknown tickers dropped;
    the planner picks the join by the sizes."""
    return df.join(dim, F.col(ticker) == F.col(dim_key), "inner")


def ohlc(df: DataFrame, keys: list[str], ts: str, tiebreak: str, open_: Column, high: Column, low: Column,
         close: Column, digits: int = 6) -> DataFrame:
    """MKT-03: first open, max high, min low, last close, dated by the last
    candle (UTC).  ``min_by``/``max_by`` on (ts, tiebreak): all partial
    aggregates."""
    order = F.struct(F.col(ts), F.col(tiebreak))
    dec = f"decimal(18,{digits})"
    return df.groupBy(*keys).agg(
        F.min_by(open_, order).cast(dec).alias("open"),
        F.max(high).cast(dec).alias("high"),
        F.min(low).cast(dec).alias("low"),
        F.max_by(close, order).cast(dec).alias("close"),
        F.to_date(F.max(ts)).alias("price_date"),
    )
