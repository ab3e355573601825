"""The file-import regression corpus: files of every supported type are
landed by this helper with their real names, imported by the config-driven
job, and checked row by row (the reference only compared counts)."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import types as T

from kiln import jobs as JB
from kiln.session import staging_dir
from kiln.sources import files as FS


def _write(path: str, text: str | bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode("utf-8"))


@pytest.fixture(scope="module")
def landing(spark):
    root = staging_dir(spark, "corpus")
    _write(f"{root}/csv/Strategy1_Products_20260101T120000.csv",
           "﻿Product Name,Price,Quantity,Category\nWidget,9.99,5,Tools\nGadget,19.50,3,Tools\n"
           "Bolt,0.25,100,Hardware\nNut,0.10,250,Hardware\n\"Big, Box\",5.00,,Storage\n")
    _write(f"{root}/csv_empty/EmptyFile_20260101T160000.csv", "field1,field2,field3\n")
    _write(f"{root}/csv_named/MetadataFilename_20260101T150000.csv", "item,value\napple,1\npear,2\n")
    _write(f"{root}/json/ArrayFormat_20260104T120000.json",
           json.dumps([{"product_id": i, "name": f"p{i}", "price": i * 1.5} for i in range(1, 7)]))
    _write(f"{root}/json_blob/ObjectFormat_20260104T130000.json", json.dumps({"report": {"rows": [1, 2]}, "ok": True}))
    _write(f"{root}/xml/StructuredXML_20260105T120000.xml",
           "<?xml version='1.0'?><items><item id='1'><id>1</id><name>a</name><category>x</category></item>"
           "<item><id>2</id><name>b</name><category>y</category></item>"
           "<item><id>3</id><name>c</name><category>z</category></item><item></item></items>")
    _write(f"{root}/xml_blob/BlobXML_20260105T130000.xml", "<?xml version='1.0'?><doc><p>free text</p></doc>")
    rows = [[i, f"v{i}", i * 2, f"w{i}"] for i in range(1, 1001)]
    _write(f"{root}/xlsx/LargeFile_20260101T160000.xlsx", FS.xlsx_bytes(["row_id", "data_col1", "data_col2", ""], rows))
    _write(f"{root}/xlsx/DateContent_20260101T150000.xlsx",
           FS.xlsx_bytes(["report_date", "metric_name", "value", "notes"],
                         [["2026-01-03", "m", 1, "n"], ["2026-02-01", "k", 2, None]]))
    return root


def _run(spark, landing, sub, target_name, **kw):
    target = os.path.join(staging_dir(spark, "corpus_out"), target_name)
    spec = JB.ImportSpec(config_name=target_name, source_directory=os.path.join(landing, sub), target_path=target,
                         default_date="2026-06-30", run_ts="2026-01-01 00:00:00", **kw)
    metrics = JB.GenericImport(spark, spec).run()
    return metrics, (spark.read.parquet(target) if metrics["loaded"] else None)


def test_csv_label_and_date_from_name(spark, landing):
    m, df = _run(spark, landing, "csv", "products", label_source="filename", label_location="0",
                 date_source="filename", date_location="1", date_format="yyyyMMddTHHmmss")
    assert m["loaded"] == 5 and m["files"] == 1
    r = df.orderBy("product_name").collect()
    assert r[0].product_name == "Big, Box" and r[0].quantity is None  # quoted comma, empty field -> NULL
    assert {x.dataset_label for x in r} == {"Strategy1"}
    # token 1 of 'Strategy1_Products_<ts>' is 'Products': the date falls back
    assert {x.file_date for x in r} == {dt.date(2026, 6, 30)}
    assert {x.source_file for x in r} == {"Strategy1_Products_20260101T120000.csv"}


def test_date_from_name_when_token_is_timestamp(spark, landing):
    m, df = _run(spark, landing, "csv_named", "named", label_source="filename", label_location="0",
                 date_source="filename", date_location="1", date_format="yyyyMMddTHHmmss")
    assert m["loaded"] == 2
    assert {(r.dataset_label, r.file_date) for r in df.collect()} == {("MetadataFilename", dt.date(2026, 1, 1))}


def test_empty_csv_loads_nothing(spark, landing):
    m, _ = _run(spark, landing, "csv_empty", "empty")
    assert m["loaded"] == 0


def test_json_array_records(spark, landing):
    m, df = _run(spark, landing, "json", "json_rows", file_type="json", date_source="filename", date_location="1",
                 date_format="yyyyMMddTHHmmss")
    assert m["loaded"] == 6
    assert sorted(r.product_id for r in df.collect()) == [1, 2, 3, 4, 5, 6]


def test_json_object_blob(spark, landing):
    m, df = _run(spark, landing, "json_blob", "json_blob", file_type="json_blob")
    assert m["loaded"] == 1
    r = df.first()
    assert json.loads(r.raw_data)["ok"] is True and r.source_file == "ObjectFormat_20260104T130000.json"


def test_xml_records_drop_empty_rows_and_attributes(spark, landing):
    m, df = _run(spark, landing, "xml", "xml_rows", file_type="xml", row_tag="item")
    assert m["loaded"] == 3
    assert sorted((r.id, r.name) for r in df.collect()) == [("1", "a"), ("2", "b"), ("3", "c")]
    assert not any(c.startswith("_attr") for c in df.columns)


def test_xml_blob(spark, landing):
    m, df = _run(spark, landing, "xml_blob", "xml_blob", file_type="xml_blob", row_tag="row")
    r = df.first()
    assert m["loaded"] == 1 and r.well_formed and not r.has_records


def test_xlsx_workbooks(spark, landing):
    recs = FS.scan_xlsx(spark, os.path.join(landing, "xlsx"), pattern="LargeFile")
    assert recs.count() == 1000
    first = recs.orderBy("row_number").first().record
    assert first == {"row_id": "1", "data_col1": "v1", "data_col2": "2", "column_3": "w1"}
    m, df = _run(spark, landing, "xlsx", "dated", file_type="xlsx", file_pattern="DateContent",
                 date_source="file_content", date_location="report_date", date_format="yyyy-MM-dd")
    assert m["loaded"] == 2 and {r.file_date for r in df.collect()} == {dt.date(2026, 1, 3)}


def test_discover_is_anchored_at_start(spark, landing):
    names = [r.file_name for r in FS.discover_files(spark, landing, pattern=r"Strategy1_.*\.csv").collect()]
    assert names == ["Strategy1_Products_20260101T120000.csv"]
    assert FS.discover_files(spark, landing, pattern=r"Products").count() == 0


def test_dry_run_writes_nothing(spark, landing):
    target = os.path.join(staging_dir(spark, "dry"), "t")
    spec = JB.ImportSpec(config_name="dry", source_directory=os.path.join(landing, "csv"), target_path=target)
    m = JB.GenericImport(spark, spec).run(dry_run=True)
    assert m["loaded"] == 5 and m["status"] == "DryRun" and not os.path.exists(target)


def test_csv_files_are_read_by_their_own_header(spark, landing):
    _write(f"{landing}/csv_mixed/Import_1.csv", "id,name\n1,apple\n")
    _write(f"{landing}/csv_mixed/Import_2.csv", "name,id,extra\npear,2,x\n")
    _write(f"{landing}/csv_mixed/Import_[3] 100%.csv", "id\n3\n")
    _write(f"{landing}/csv_mixed/Other.csv", "unrelated,columns\n7,8\n")
    df = FS.scan_csv(spark, f"{landing}/csv_mixed", pattern=r"Import_")
    assert sorted((r.id, r.name, r.extra) for r in df.collect()) == [("1", "apple", None), ("2", "pear", "x"), ("3", None, None)]
    assert set(df.columns) == {"id", "name", "extra", "_file", "_path", "_pos"}


def test_strict_strategy_ignores_lineage_and_refuses_extra_columns(spark, landing):
    full = T.StructType([T.StructField(c, T.StringType()) for c in ("item", "value", "datasetid", "created_by")])
    m, df = _run(spark, landing, "csv_named", "strict_ok", strategy=3, target_schema=full)
    assert m["loaded"] == 2 and m["files"] == 1 and "source_file" in df.columns
    with pytest.raises(ValueError, match="value"):
        _run(spark, landing, "csv_named", "strict_bad", strategy=3, target_schema=T.StructType(full.fields[:1]))
