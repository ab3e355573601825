"""The restartable import, the pruned merge and retention by partition."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from kiln import imports as IM
from kiln.jobs import ImportSpec
from kiln.operators import sinks as K


def land(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def job(spark, base, dataset_id, kind=IM.DatasetImport, **kw):
    spec = ImportSpec(config_name="Demo", source_directory=f"{base}/inbox", target_path=f"{base}/table", file_pattern=r".*\.csv$",
                      label_location="demo", date_location=f"2026-01-{dataset_id:02d}", dataset_id=dataset_id, run_ts="2026-01-01 00:00:00")
    return kind(spark, spec, f"{base}/state", f"{base}/archive", **kw)


def table(spark, j):
    return sorted(map(tuple, spark.read.schema(j.target_columns_after()).parquet(j.spec.target_path).select("a", "b", "datasetid").collect()),
                  key=repr)


KILLS = ["load_dataset", "after_write", "record_dataset", "emit_event"]


@pytest.mark.parametrize("where", KILLS + ["archive"])
def test_a_killed_job_resumes_without_doubling(spark, tmp_path, monkeypatch, where):
    base = str(tmp_path)
    land(f"{base}/inbox", "x.csv", "a,b\n1,one\n2,two\n")
    land(f"{base}/inbox/sub", "x.csv", "b,a\nthree,3\n")
    land(f"{base}/inbox", "other.txt", "no part of it")

    def die(*a, **k):
        raise InterruptedError(where)

    with monkeypatch.context() as m:
        if where == "archive":
            m.setattr(IM, "archive_files", die)
        else:
            m.setattr(IM.DatasetImport, where, die)
        with pytest.raises(InterruptedError):
            job(spark, base, 1).run()
    land(f"{base}/inbox", "late.csv", "a,b\n9,late\n")  # belongs to the next dataset
    for _ in range(2):
        first = job(spark, base, 1)
        assert first.run()["loaded"] == 3
    assert table(spark, first) == [(1, "one", 1), (2, "two", 1), (3, "three", 1)]
    assert sorted(os.listdir(f"{base}/archive")) == ["x.csv", "x_1.csv"]
    second = job(spark, base, 2)
    assert second.run()["files"] == 1
    assert (9, "late", 2) in table(spark, second) and len(table(spark, second)) == 4
    assert job(spark, base, 3).run()["status"] == "NoFiles"
    led = second.ledger
    assert sorted(r["datasetid"] for r in led.read("event", IM.EVENTS).collect()) == [1, 2]
    got = {r["datasetid"]: (r["isactive"], r["status"]) for r in second.datasets().collect()}
    assert got == {1: (False, "Inactive"), 2: (True, "Active")}
    assert sorted(os.listdir(f"{base}/inbox")) == ["other.txt", "sub"]


def test_the_same_name_landed_again_and_new_columns(spark, tmp_path):
    base = str(tmp_path)
    name = "kiln_import_" + os.path.basename(base).replace("-", "_")
    try:
        land(f"{base}/inbox", "day.csv", "a,b,modified_by\n1,x,me\n")
        job(spark, base, 1, table=name).run()
        land(f"{base}/inbox", "day.csv", "a,b,c\n2,y,new\nzzz,z,new\n")
        last = job(spark, base, 2, table=name)
        assert last.run()["loaded"] == 2
        assert sorted(os.listdir(f"{base}/archive")) == ["day.csv", "day_1.csv"]
        rows = spark.table(name).select("datasetid", "a", "b", "c", "unfit_values").collect()
        assert sorted((r["datasetid"], r["a"], r["b"], r["c"], (r["unfit_values"] or {}).get("a")) for r in rows if r["a"]) == [
            (1, 1, "x", None, None), (2, 2, "y", "new", None)]
        assert [(r["b"], r["unfit_values"]["a"]) for r in rows if r["a"] is None] == [("z", "zzz")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_failed_load_is_recorded(spark, tmp_path):
    base = str(tmp_path)
    land(f"{base}/inbox", "x.csv", "a,b\n1,one\n")

    class Broken(IM.DatasetImport):
        def transform(self, df):
            raise ValueError("broken")

    with pytest.raises(ValueError):
        job(spark, base, 1, Broken).run()
    assert [r["load_status"] for r in job(spark, base, 1).datasets().collect()] == ["Failed"]
    job(spark, base, 1).run()
    assert [r["load_status"] for r in job(spark, base, 1).datasets().collect()] == ["Active"]


def test_an_empty_dataset_replaces_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    K.commit_dataset(spark.range(5), path, 1)
    K.commit_dataset(spark.range(3), path, 2)
    K.commit_dataset(spark.range(0), path, 1)
    assert sorted((r["id"], r["datasetid"]) for r in spark.read.parquet(path).collect()) == [(0, 2), (1, 2), (2, 2)]


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_merge_reads_and_rewrites_touched_partitions_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    held = [(k, None if k % 4 == 0 else k, "old") for k in range(40)]
    spark.createDataFrame(held, "k int, v int, s string").withColumn("p", F.col("k") % 8).write.partitionBy("p").parquet(path)
    before = files_of(path)
    plans = []
    plain = K.upsert

    def watched(target, *a, **k):
        plans.append(target._jdf.queryExecution().executedPlan().toString())
        return plain(target, *a, **k)

    monkeypatch.setattr(K, "upsert", watched)
    src = spark.createDataFrame([(3, None, "new", 1), (3, 33, "newer", 2), (4, 4, "filled", 1), (803, None, None, 1)], "k int, v int, s string, at int")
    touched = K.merge_partitions(spark, path, src, ["k"], "p", F.col("k") % 8, order="at")
    assert touched == [3, 4]
    assert "PartitionFilters: [p#" in plans[0] and "IN (" in plans[0], plans[0]
    after = files_of(path)
    same = {f for f in before if before[f] == after.get(f)}
    assert {f.split("p=")[1][0] for f in same} == set("012567") and not any("p=3" in f or "p=4" in f for f in same)
    want = {k: (v, s) for k, v, s in held} | {3: (33, "newer"), 4: (4, "filled"), 803: (None, None)}
    got = {r["k"]: (r["v"], r["s"]) for r in spark.read.parquet(path).collect()}
    assert got == want
    assert K.merge_partitions(spark, path, src.limit(0), ["k"], "p", F.col("k") % 8) == []


def test_retention_removes_days_and_rewrites_the_boundary_only(spark, tmp_path):
    base = str(tmp_path)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i)) for i in range(80)] + [(900, None)]
    spark.createDataFrame(rows, "id int, ts timestamp_ntz").withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(f"{base}/t")
    before = files_of(f"{base}/t")
    done = K.drop_old_partitions(spark, f"{base}/t", "ts", "day", 10, "2024-01-15 12:00:00", f"{base}/out")
    cutoff = dt.datetime(2024, 1, 5, 12)
    assert len(done["removed"]) == 4 and str(done["rewritten"]) == "2024-01-05"
    kept = {r["id"] for r in spark.read.parquet(f"{base}/t").collect()}
    assert kept == {i for i, t in rows if t is None or t >= cutoff}
    old = {int(r["id"]) for r in spark.read.option("header", True).csv(done["export"]).collect()}
    assert old == {i for i, t in rows if t is not None and t < cutoff}
    after = files_of(f"{base}/t")
    assert all(before[f] == after[f] for f in before if "day=2024-01-0" not in f)
    again = K.drop_old_partitions(spark, f"{base}/t", "ts", "day", 10, "2024-01-15 12:00:00", f"{base}/out")
    assert again["removed"] == [] and again["rewritten"] is None
    assert {r["id"] for r in spark.read.parquet(f"{base}/t").collect()} == kept
