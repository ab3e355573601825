"""The workbook data source: round trips, limits, retries and aborts."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kiln.sources import files as FS
from kiln.sources import workbooks as WB


def _files(path):
    return sorted(n for n in os.listdir(path) if n.endswith(".xlsx"))


def test_texts_nulls_and_lineage_come_back(spark, tmp_path):
    rows = [("1", "a<b>&\"'", None), ("2", " x\r\n\ty\x01 ", ""), ("3", "_x0041_ _x  \U0001f600", "long " * 20_000), (None, None, None)]
    df = spark.createDataFrame(rows, "id string, t string, `a b` string").coalesce(1)
    WB.write_workbooks(df, f"{tmp_path}/w")
    got = WB.scan_workbooks(spark, f"{tmp_path}/w")
    assert [tuple(r) for r in got.select("id", "t", "a b").orderBy("id").collect()] == rows[:3]  # a row without a value is none
    assert {r.row_number for r in got.collect()} == {1, 2, 3} and {r.file_name for r in got.collect()} == set(_files(tmp_path / "w"))
    records = spark.read.format(WB.FORMAT).load(f"file://{tmp_path}/w")
    assert records.columns == ["file_path", "row_number", "record"] and records.where("record['id'] = '2'").first().record["a b"] == ""
    assert FS.scan_xlsx(spark, f"{tmp_path}/w").count() == 3


def test_sheets_are_cut_at_their_limit_and_appended_or_replaced(spark, tmp_path):
    path = f"{tmp_path}/w"
    WB.write_workbooks(spark.range(10_000).coalesce(1), path, max_rows=3000)
    assert len(_files(path)) == 4 and not [n for n in os.listdir(f"{path}/_temporary")]
    per = WB.scan_workbooks(spark, path).groupBy("file_name").count().collect()
    assert sorted(r["count"] for r in per) == [1000, 3000, 3000, 3000]
    WB.write_workbooks(spark.range(10_000, 10_005), path)
    assert WB.scan_workbooks(spark, path).select(F.sum(F.col("id").cast("bigint"))).first()[0] == sum(range(10_005))
    WB.write_workbooks(spark.range(7), path, mode="overwrite")
    assert WB.scan_workbooks(spark, path).count() == 7
    with pytest.raises(Exception, match="max_rows"):
        WB.write_workbooks(spark.range(1), path, max_rows=1 << 20)


def test_a_failed_write_leaves_nothing_and_keeps_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/w"
    WB.write_workbooks(spark.range(3), path)
    with pytest.raises(Exception, match="planted"):
        bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 90, F.raise_error(F.lit("planted"))).otherwise(F.col("id")).alias("id"))
        WB.write_workbooks(bad, path, mode="overwrite")
    assert WB.scan_workbooks(spark, path).count() == 3 and not os.listdir(f"{path}/_temporary")


def test_headers_of_different_files_patterns_and_empty_folders(spark, tmp_path):
    for name, header, rows in (("A_1.xlsx", ["x", ""], [["1", "2"], [None, ""]]), ("B_1.xlsx", ["y"], []), ("B_2.xlsx", ["x", "z"], [["3", None]])):
        (tmp_path / name).write_bytes(FS.xlsx_bytes(header, rows))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "C.xlsx").write_bytes(FS.xlsx_bytes(["q"], [["9"]]))
    assert WB.column_names(spark, str(tmp_path)) == ["column_1", "x", "y", "z"]
    assert WB.column_names(spark, str(tmp_path), "B_") == ["x", "y", "z"]
    got = WB.scan_workbooks(spark, str(tmp_path)).select("file_name", "x", "column_1", "y", "z").orderBy("x").collect()
    assert [tuple(r) for r in got] == [("A_1.xlsx", "1", "2", None, None), ("B_2.xlsx", "3", None, None, None)]
    assert WB.scan_workbooks(spark, str(tmp_path), "B_", columns=["z"]).count() == 1
    read = spark.read.format(WB.FORMAT).option("recursive", "true").load(str(tmp_path))
    assert read.where("record['q'] = '9'").count() == 1
    (tmp_path / "none").mkdir()
    assert WB.scan_workbooks(spark, str(tmp_path / "none")).count() == 0


def test_small_files_share_a_task(spark, tmp_path):
    WB.write_workbooks(spark.range(0, 100, 1, 10), f"{tmp_path}/w")
    assert len(_files(tmp_path / "w")) == 10
    assert WB.scan_workbooks(spark, f"{tmp_path}/w").rdd.getNumPartitions() == 1
