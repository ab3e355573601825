"""Feeds parse a document once, and a filter on their rows never parses it again."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from kiln.operators import feeds as FD
from kiln.session import staging_dir


def _plan(df) -> str:
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended")
    return text[text.index("== Optimized"):text.index("== Physical")]


def _made(spark):
    """Documents made by an expression that the plan shows, over a join."""
    left, right = spark.range(3), spark.range(3).withColumnRenamed("id", "k")
    return left.join(right, F.col("id") == F.col("k")).select(F.to_json(F.struct("id", "k")).alias("p"))


def test_guide_sheets_build_and_parse_a_document_once(spark):
    plan = _plan(FD.guide_sheets(_made(spark), "p"))
    assert plan.count("StructsToJson") == 1
    assert not [line for line in plan.split("\n") if "Join" in line and "from_json" in line]


def test_feed_dates_are_parsed_where_the_record_is_opened(spark):
    plan = _plan(FD.treasury_operations(FD.feed_records(_made(spark), "p", "treasury.auctions", "treasury")))
    assert not [line for line in plan.split("\n") if "Filter" in line and "gettimestamp" in line]


def _rejected(spark, *docs):
    recs = FD.feed_records(spark.createDataFrame([(d,) for d in docs], "p string"), "p", "a.b", "treasury")
    return sorted((r.raw_record or "", r.outcome, str(r.row and r.row.operation_date)) for r in FD.treasury_operations(recs, both=True).collect())


def test_documents_of_other_shapes_keep_their_records(spark):
    bad = '{"cusip":"x","issueDate":"soon","couponRate":1.50}'
    raw = '{"cusip":"x","issueDate":"soon","couponRate":1.5}'
    good = '{"operationDate":"2026-01-02","cusip":"é"}'
    yes, no = ("", "accepted", "2026-01-02"), (raw, "rejected", "None")
    assert _rejected(spark, '{"a":{"b":[%s,%s]}}' % (good, bad)) == [yes, no]
    assert _rejected(spark, '{"a":{"b":%s}}' % good, '{"a":{"b":%s}}' % bad) == [yes, no]
    assert _rejected(spark, '{"a":{"b":[%s,3]}}' % good) == [yes, ("", "accepted", "None")]
    assert _rejected(spark, None, "", "no", "{}", '{"a":{"b":null}}', '{"a":{"b":[]}}', '{"a":{"b":[{"cusip":') == []


def test_iso_dates_are_those_of_the_format(spark):
    texts = ["2026-01-02", "2024-02-29", "2026-02-30", "2026-1-2", "2026-01-02 ", "2026-01-02\n", "2026", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.select(F.col("i"), FD.iso_date(F.col("t")).alias("d")).orderBy("i").select("d").collect()]
    assert got == [dt.date(2026, 1, 2), dt.date(2024, 2, 29)] + [None] * 7


def test_split_feed_sorts_nothing_and_leaves_the_setting(spark, monkeypatch):
    seen, write = [], DataFrameWriter.parquet
    before = spark.conf.get(FD.WRITERS, None)

    def parquet(self, *args, **kw):
        seen.append(spark.conf.get(FD.WRITERS, None))
        return write(self, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    docs = spark.createDataFrame([('{"a":{"b":[{"cusip":"1"},{"cusip":"2","issueDate":"soon"}]}}',)] * 5, "p string")
    out = staging_dir(spark, "split")
    assert FD.split_feed(FD.treasury_operations, FD.feed_records(docs, "p", "a.b", "treasury"), out) == {"accepted": 5, "rejected": 5}
    assert seen == ["2"] and spark.conf.get(FD.WRITERS, None) == before
    assert FD.rejected_rows(spark.read.parquet(out)).count() == 5
