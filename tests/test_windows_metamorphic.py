"""Order-dependent operators against step-by-step simulations, and
metamorphic checks: the chunking used to spread hot keys must not change
any result."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiln.operators import datasets as D
from kiln.operators import joins as J
from kiln.operators import windows as WN


def simulate_trigger(rows):
    """Replay the single-active trigger one activation at a time."""
    state = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        state[r["seq"]] = {"isactive": False, "status": "New", "effthru": None}
        if not r["activated"]:
            continue
        key = r["key"]
        max_date = max(x["date"] for x in rows if x["key"] == key and x["seq"] <= r["seq"])
        if r["date"] < max_date:
            state[r["seq"]].update(isactive=False, status="Active")  # reverted, status kept
        else:
            for x in rows:
                s = state.get(x["seq"])
                if x["key"] == key and x["seq"] != r["seq"] and s and s["isactive"]:
                    s.update(isactive=False, status="Inactive", effthru=r["ts"])
            state[r["seq"]].update(isactive=True, status="Active")
    return state


@pytest.mark.parametrize("chunk", [1, 3, 17, 1 << 20])
def test_resolve_active_equals_trigger_replay(spark, chunk):
    rnd = random.Random(7)
    rows = []
    for seq in range(1, 301):
        key = rnd.choice(["a", "b", None])  # NULL is a key like any other
        rows.append({"seq": seq, "key": key, "date": dt.date(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 40)),
                     "activated": rnd.random() > 0.2, "ts": dt.datetime(2021, 1, 1) + dt.timedelta(hours=seq)})
    df = spark.createDataFrame([(r["seq"], r["key"], r["date"], r["activated"], r["ts"]) for r in rows],
                               "seq long, key string, datasetdate date, activated boolean, createddate timestamp_ntz")
    got = {r.seq: r for r in D.resolve_active(df, ["key"], chunk_rows=chunk).collect()}
    want = simulate_trigger(rows)
    far = dt.datetime(9999, 1, 1)
    for seq, w in want.items():
        g = got[seq]
        assert g.isactive == w["isactive"], seq
        assert g.status == w["status"], seq
        assert g.effthru == (w["effthru"] or far), seq
    # at most one active dataset per key
    assert sum(1 for g in got.values() if g.isactive) <= 3


@pytest.mark.parametrize("bucket", ["day", "hour", "const"])
def test_previous_match_bucket_invariance(spark, bucket):
    rnd = random.Random(3)
    data = [(i, rnd.randint(1, 4), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 5000)),
             rnd.choice(["buy", "view"])) for i in range(400)]
    df = spark.createDataFrame(data, "id long, user long, ts timestamp_ntz, kind string")
    b = {"day": F.to_date("ts"), "hour": F.date_trunc("hour", "ts"), "const": F.lit(0)}[bucket]
    got = {r.id: r.prev for r in J.previous_match(df, "user", "ts", "id", F.col("kind") == "buy", F.col("id"), "prev",
                                                  b).collect()}
    w = W.partitionBy("user").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, -1)
    want = {r.id: r.prev for r in df.withColumn("prev", F.last(F.when(F.col("kind") == "buy", F.col("id")),
                                                               ignorenulls=True).over(w)).collect()}
    assert got == want


@pytest.mark.parametrize("chunk", [1, 5, 1000])
def test_chunked_row_number(spark, chunk):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 3).alias("k"))
    got = {r.id: r.rn for r in WN.row_number(df, ["k"], ["id"], F.floor(F.col("id") / chunk), "rn").collect()}
    w = W.partitionBy("k").orderBy("id")
    want = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    assert got == want


def test_repartitioning_does_not_change_rollups(spark, small_dir):
    """Metamorphic: the same query over a re-partitioned input agrees."""
    from kiln.operators import opslog as O
    from kiln.plans import common as C

    t = C.T(spark, small_dir)
    a = O.run_rollup(C.logs(t)).collect()
    b = O.run_rollup(C.logs(t).repartition(13)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_resolve_active_has_few_exchanges(spark):
    df = spark.range(1000).select(
        F.col("id").alias("seq"), (F.col("id") % 3).alias("key"), F.lit(dt.date(2020, 1, 1)).alias("datasetdate"),
        F.lit(True).alias("activated"), F.lit(dt.datetime(2021, 1, 1)).alias("createddate"))
    plan = D.resolve_active(df, ["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 2 and plan.count("Exchange hashpartitioning") + plan.count("BroadcastExchange") <= 4, plan


def test_a_hot_key_is_spread_over_chunks(spark):
    """A key with a third of all rows lies in as many window groups as it has chunks."""
    df = spark.range(3000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("key"),
        F.expr("date_add(DATE '2020-01-01', int(id % 50))").alias("datasetdate"), F.lit(True).alias("activated"),
        F.lit(dt.datetime(2021, 1, 1)).alias("createddate"))
    one = D.resolve_active(df, ["key"]).orderBy("seq").collect()
    many = D.resolve_active(df, ["key"], chunk_rows=100).orderBy("seq").collect()
    assert one == many
    groups = WN.chunked(df, ["key"], F.floor(F.col("seq") / 100)).filter("key = -1").groupBy("_at").count()
    assert groups.count() == 30 and groups.agg(F.max("count")).first()[0] <= 34


def test_no_window_fills_its_frame_anew_for_every_row(spark):
    """A frame that ends at the last row costs the square of its rows (a chunk of a key holds many)."""
    df = spark.range(10).selectExpr("id AS seq", "id % 2 AS key", "date'2024-01-01' AS datasetdate", "id % 3 <> 0 AS activated",
                                    "timestamp_ntz'2024-01-01 00:00:00' AS createddate")
    for got in (D.resolve_active(df, ["key"]),
                WN.next_match(df, ["key"], "seq", F.col("activated"), F.col("seq"), F.floor(F.col("seq") / 4), "next")):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition" in plan and "unboundedfollowing" not in plan
