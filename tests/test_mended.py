"""Cases that once gave wrong answers."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from kiln.functions import scalars as SC
from kiln.operators import artwork as A
from kiln.operators import reports as R
from kiln.operators import schema as P
from kiln.sources import files as FS


def test_cte_names_are_known_inside_their_query_only(spark):
    spark.range(3).createOrReplaceTempView("shown")
    name = "kiln_secret"
    spark.sql(f"CREATE TABLE {name} USING parquet AS SELECT 42 AS x")
    try:
        for sql in (
            f"SELECT s.x FROM {name} s, (WITH {name} AS (SELECT 1 AS y) SELECT * FROM {name}) t",
            f"SELECT * FROM (WITH a AS (SELECT * FROM {name}), {name} AS (SELECT 1) SELECT * FROM a) t",
            f"WITH a AS (WITH {name} AS (SELECT 1 AS x) SELECT * FROM {name}) SELECT * FROM {name}",
            f"SELECT id FROM shown WHERE id IN (WITH {name} AS (SELECT 1 AS x) SELECT x FROM {name}) AND EXISTS (SELECT 1 FROM {name})",
        ):
            with pytest.raises(R.QueryRejected):
                R.run_select(spark, sql if sql.startswith("SELECT") else f"SELECT * FROM ({sql}) q")
        for sql, rows in (
            ("WITH a AS (SELECT * FROM shown), b AS (SELECT * FROM a) SELECT a.id FROM a JOIN b USING (id)", 3),
            ("WITH a AS (WITH c AS (SELECT * FROM shown) SELECT * FROM c) SELECT * FROM a WHERE id IN (SELECT id FROM a)", 3),
            ("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT * FROM r", 4),
            (f"WITH {name} AS (SELECT 1 AS x) SELECT * FROM {name}", 1),
        ):
            assert R.run_select(spark, f"SELECT * FROM ({sql}) q").count() == rows, sql
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_java_patterns_are_counted_by_java(spark):
    df = spark.createDataFrame([("Ärger 12",)], "s string")
    got = df.select(SC.regex_test("s", r"(\p{L}+) (\d+)").alias("r")).first()["r"]
    assert (got["is_valid"], got["groups"]) == (True, ["Ärger", "12"])


def test_footnote_numbers_of_any_length(spark):
    big = "9" * 30
    doc = '{"metadata": [' + ",".join(
        '{"label": "Provenance", "value": "%s"}' % v for v in ("1900", f"Holder [{big}] [007]", "Notes:", f"[{big}] far", "[7] near")) + "]}"
    got = A.provenance_chain(spark.createDataFrame([(1, doc)], "id int, j string"), "j", ["id"]).first()
    assert (got["holder_name"], got["acquisition_notes"]) == ("Holder", "far; near")


def test_patch_never_multiplies_rows(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], "k int, s string, n int")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, None, 9, 2), (1, "y", None, 3), (2, None, None, 1)], "k int, s string, n int, at int")
    got = sorted(map(tuple, P.patch(target, changes, "k", order="at").collect()))
    assert got == [(1, "y", 9), (2, "b", 2), (3, "c", 3)]
    one = changes.filter("at = 1").drop("at")
    assert sorted(map(tuple, P.patch(target, one, "k").collect())) == [(1, "x", 1), (2, "b", 2), (3, "c", 3)]
    with pytest.raises(Exception, match="several changes of key 1"):
        P.patch(target, changes.drop("at"), "k").collect()


def test_csv_header_with_a_quoted_line_break(spark, tmp_path):
    with open(os.path.join(tmp_path, "a.csv"), "w") as f:
        f.write('id,"long\nname"\n1,x\n')
    with open(os.path.join(tmp_path, "b.csv"), "w") as f:
        f.write("id,other\n2,y\n")
    got = FS.scan_csv(spark, str(tmp_path))
    assert set(got.columns) == {"id", "long\nname", "other", "_file", "_path", "_pos"}
    rows = got.select("id", F.col("`long\nname`").alias("n"), "other").collect()
    assert sorted((r["id"], r["n"], r["other"]) for r in rows) == [("1", "x", None), ("2", None, "y")]


def _operators(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_calendar_and_patterns_read_their_table_once(spark, tmp_path):
    from kiln.functions import scalars as S
    from kiln.operators import calendar as K
    from kiln.operators import opslog as O

    spark.range(1).select(F.explode(F.expr("sequence(date'2024-12-20', date'2025-01-03')")).alias("calendar_date")).write.parquet(f"{tmp_path}/days")
    days = spark.read.parquet(f"{tmp_path}/days")
    ruled = K.business_calendar(days)
    assert _operators(ruled).count("FileScan") == 1
    listed = K.business_calendar(days, K.holidays_in(days))
    assert sorted(map(str, ruled.select(sorted(ruled.columns)).collect())) == sorted(map(str, listed.select(sorted(ruled.columns)).collect()))
    previous = {str(r.calendar_date): str(r.previous_business_date) for r in ruled.collect()}
    assert previous["2024-12-20"] == "None" and previous["2024-12-26"] == "2024-12-24"
    assert previous["2024-12-30"] == "2024-12-27" and previous["2025-01-02"] == "2024-12-31"

    spark.createDataFrame([("ab",), ("cd",), (None,)], "text string").write.parquet(f"{tmp_path}/texts")
    texts = spark.read.parquet(f"{tmp_path}/texts")
    found = O.pattern_summary(texts.select(F.inline(S.regex_tests("text", {1: "a(.)", 2: "(", 3: r"\p{L}+"}))), by=["pattern_id"])
    assert _operators(found).count("FileScan") == 1
    got = {r.pattern_id: (r.total, r.matches, r.non_matches, float(r.match_rate), r.has_errors, r.all_valid) for r in found.collect()}
    assert got == {1: (3, 1, 2, 33.3, False, True), 2: (3, 0, 3, 0.0, True, False), 3: (3, 2, 1, 66.7, False, True)}


def test_melted_panels_keep_repeated_ids_and_missing_fields(spark):
    from kiln.sources import payloads as PL

    wide = spark.createDataFrame([(1, 1.0, 2.0, 5), (1, 3.0, None, 6)], "id int, `open|A.B` double, `open|C` double, `volume|C` int")
    long = PL.melt_panel(wide, ["id"], wide.columns[1:])
    assert "Exchange" not in _operators(long) and long.dtypes[2:] == [("open", "double"), ("volume", "int")]
    assert sorted(map(tuple, long.collect()), key=str) == sorted(
        [(1, "A.B", 1.0, None), (1, "C", 2.0, 5), (1, "A.B", 3.0, None), (1, "C", None, 6)], key=str)


def test_xml_probe_holds_no_list_of_records(spark, tmp_path):
    for k, text in enumerate(("<a><c>1</c><c/></a>", "<a><b>1</b></a>", "<a><c>1</b></a>", "<a><c><x>1</x></c></a>")):
        with open(os.path.join(tmp_path, f"{k}.xml"), "w") as f:
            f.write(text)
    got = FS.scan_xml_blob(spark, str(tmp_path), "c").orderBy("source_file")
    assert [(r.well_formed, r.has_records) for r in got.collect()] == [(True, True), (True, False), (False, False), (True, True)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "from_xml(StructField(c,StringType" in plan


def test_landed_files_hold_a_bounded_number_of_records(spark, tmp_path, monkeypatch):
    from kiln.plans import q_sources as Q

    monkeypatch.setattr(Q, "FILE_ROWS", 30)
    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.5D AS o_totalprice",
                                "timestamp_ntz'2024-01-01 00:00:00' AS o_orderdate", "'1' AS o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(100).selectExpr("id AS c_custkey", "'n' AS c_name", "1 AS c_nationkey", "1.5D AS c_acctbal", "'m' AS c_mktsegment").coalesce(
        1).write.parquet(f"{tmp_path}/customer.parquet")
    landed = []
    monkeypatch.setattr(Q, "staging_dir", lambda spark, name: landed.append(f"{tmp_path}/{name}") or landed[-1])
    assert Q.src_json_records(spark, str(tmp_path)).count() == Q.src_xlsx(spark, str(tmp_path)).count() == 100
    assert Q.src_json_blob(spark, str(tmp_path)).first()["n_records"] == Q.src_xml_blob(spark, str(tmp_path)).first()["records"] == 100
    for path in landed:
        assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 4, path


def test_a_workbook_is_read_row_by_row():
    import itertools
    import tracemalloc

    data = FS.xlsx_bytes(["a", "b"], [[i, "x" * 20] for i in range(30_000)])
    tracemalloc.start()
    assert len(list(itertools.islice(FS.xlsx_rows(data), 5))) == 5 and sum(1 for _ in FS.xlsx_rows(data)) == 30_001
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_manifests_of_a_small_table_are_parsed_by_many_tasks(spark):
    from kiln.plans import q_artwork as Q

    assert Q.art_exhibitions(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
