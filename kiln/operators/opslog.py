"""Operations analytics over run logs, job runs/steps, datasets and events.

AGG-* and TOP-*.  Every function takes and returns a lazy DataFrame; all
aggregates are algebraic (partial aggregation before the shuffle), so a hot
key costs one partial row per task, never a whole group in one task.
Look-backs take an explicit ``as_of`` literal instead of NOW().
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.scalars import duration_seconds


def _ts(v: str) -> Column:
    return F.lit(v).cast("timestamp_ntz")


def _since_hours(as_of: str, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(-hours), _ts(as_of))


def _since_days(as_of: str, days: int) -> Column:
    return F.timestamp_add("DAY", F.lit(-days), _ts(as_of))


# ---------------------------------------------------------------- AGG-01
def run_rollup(
    logs: DataFrame,
    run: str = "run_uuid",
    process: str = "processtype",
    ts: str = "timestamp",
    message: str = "message",
    runtime: str = "stepruntime",
    ignore_case: bool = False,
) -> DataFrame:
    """One row per (run, process): start, step count, status, total runtime.

    Status: any ERROR/FAIL message -> Failed; else any SUCCESS/COMPLETE ->
    Success; else Running.  The scan is case-sensitive like the reference
    unless ``ignore_case``.
    """
    msg = F.upper(F.col(message)) if ignore_case else F.col(message)
    is_fail = msg.contains("ERROR") | msg.contains("FAIL")
    is_ok = msg.contains("SUCCESS") | msg.contains("COMPLETE")
    return (
        logs.groupBy(run, process)
        .agg(
            F.min(ts).alias("starttime"),
            F.count(F.lit(1)).alias("total_steps"),
            F.max(F.when(is_fail, 1).otherwise(0)).alias("_fail"),
            F.max(F.when(is_ok, 1).otherwise(0)).alias("_ok"),
            F.coalesce(F.sum(runtime), F.lit(0.0)).alias("total_runtime"),
        )
        .withColumn(
            "status",
            F.when(F.col("_fail") > 0, "Failed").when(F.col("_ok") > 0, "Success").otherwise("Running"),
        )
        .drop("_fail", "_ok")
    )


# ---------------------------------------------------------------- AGG-02..04
def jobs_per_day(logs: DataFrame, process: str, as_of: str, days: int, ts: str = "timestamp") -> DataFrame:
    """Exact distinct runs per day for one process over the last ``days``."""
    return (
        logs.filter((F.col(ts) >= _since_days(as_of, days)) & (F.col("processtype") == process))
        .groupBy(F.to_date(ts).alias("job_date"))
        .agg(F.count_distinct("run_uuid").alias("job_count"))
    )


def process_distribution(logs: DataFrame, as_of: str, days: int, ts: str = "timestamp") -> DataFrame:
    return (
        logs.filter(F.col(ts) >= _since_days(as_of, days))
        .groupBy("processtype")
        .agg(F.count_distinct("run_uuid").alias("run_count"))
    )


def runtime_stats(logs: DataFrame, as_of: str, days: int, ts: str = "timestamp") -> DataFrame:
    return (
        logs.filter((F.col(ts) >= _since_days(as_of, days)) & F.col("stepruntime").isNotNull())
        .groupBy("processtype")
        .agg(
            F.count(F.lit(1)).alias("step_count"),
            F.avg("stepruntime").alias("avg_runtime"),
            F.min("stepruntime").alias("min_runtime"),
            F.max("stepruntime").alias("max_runtime"),
        )
    )


# ---------------------------------------------------------------- AGG-05/06
def combine_single_rows(frames: list[DataFrame]) -> DataFrame:
    """Put single-row aggregates side by side without a join: union them
    with NULLs for the other frames' columns and take ``max`` per column
    (each column is non-NULL in exactly one frame)."""
    types = {}
    for f in frames:
        for fld in f.schema.fields:
            types[fld.name] = fld.dataType
    parts = [f.select(*[F.col(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])
             for f in frames]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(*[F.max(c).alias(c) for c in types])


def system_metrics(logs: DataFrame, datasets: DataFrame, configs: DataFrame, as_of: str,
                   datasets_as_of: str | None = None) -> DataFrame:
    """Six scalars over three tables in one pass per table (plus the count of
    distinct runs in the last 24 h), combined into one row."""
    last24 = F.col("timestamp") >= _since_hours(as_of, 24)
    lg = logs.filter(last24).agg(  # every log figure is of the last 24 h: prune the scan
        F.count_if(last24).alias("total_logs_24h"),
        F.count_distinct(F.when(last24, F.col("processtype"))).alias("unique_processes"),
        F.coalesce(
            F.round(F.avg(F.when(last24, F.col("stepruntime"))).cast(T.DecimalType(30, 10)), 2),
            F.lit(0).cast(T.DecimalType(30, 2)),
        ).alias("avg_runtime"),
        F.count_distinct(F.when(last24, F.col("run_uuid"))).alias("runs_24h"),
    )
    ds = datasets.agg(
        F.count_if(F.col("createddate") >= _since_days(datasets_as_of or as_of, 30)).alias("total_datasets_30d"),
        F.count_if(F.col("isactive")).alias("total_active_datasets"),
    )
    cf = configs.agg(F.count_if(F.col("is_active")).alias("total_active_configs"))
    return combine_single_rows([lg, ds, cf])


def log_stats(logs: DataFrame, as_of: str, ts: str = "timestamp") -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("total_logs"),
        F.count_distinct("run_uuid").alias("total_runs"),
        F.min(ts).alias("oldest_log"),
        F.max(ts).alias("newest_log"),
        F.count_if(F.col(ts) >= _since_days(as_of, 7)).alias("logs_last_7_days"),
        F.count_if(F.col(ts) >= _since_days(as_of, 30)).alias("logs_last_30_days"),
    )


# ---------------------------------------------------------------- AGG-07..10
def pipeline_stats(runs: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Counts by status and the average duration of finished runs."""
    r = runs.filter(F.col("started_at") >= _since_hours(as_of, hours))
    dur = (F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6
    return r.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "partial").alias("partial"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.round(F.coalesce(F.avg(dur), F.lit(0.0)).cast(T.DecimalType(30, 6)), 1).alias("avg_duration_seconds"),
    )


def status_counts(df: DataFrame, predicates: Mapping[str, Column], total: str = "total",
                  sums: Mapping[str, Column] | None = None) -> DataFrame:
    """AGG-08/AGG-10: one row of conditional counts, and of sums (0 without values), in a single pass."""
    cols = [F.count(F.lit(1)).alias(total)] if total else []
    cols += [F.count_if(p).alias(name) for name, p in predicates.items()]
    cols += [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in (sums or {}).items()]
    return df.agg(*cols)


def events_per_day(events: DataFrame, as_of: str, days: int, ts: str = "created_at") -> DataFrame:
    """AGG-09: whole-day look-back (CURRENT_DATE - n)."""
    start = F.date_sub(F.to_date(_ts(as_of)), days)
    return (
        events.filter(F.col(ts) >= start.cast("timestamp_ntz"))
        .groupBy(F.to_date(ts).alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status") == "completed").alias("completed"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        )
    )


# ---------------------------------------------------------------- AGG-11
def suite_summary(results: DataFrame, suite: str, status: str, start: str, end: str, expected: str, loaded: str) -> DataFrame:
    """Per suite: time span, counts by outcome, pass rate and the sums of the
    expected and loaded records (all algebraic aggregates, partially aggregated
    before the shuffle)."""
    s = F.col(status)
    dur = (F.unix_micros(F.max(end).cast("timestamp")) - F.unix_micros(F.min(start).cast("timestamp"))) / 1e6
    n = F.count(F.lit(1))
    passed = F.count_if(s == "passed")
    return results.groupBy(suite).agg(
        F.min(start).alias("started_at"),
        F.max(end).alias("completed_at"),
        dur.alias("duration_seconds"),
        n.alias("total_tests"),
        passed.alias("passed"),
        F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "error").alias("errors"),
        F.count_if(s == "skipped").alias("skipped"),
        F.round((F.lit(100).cast(T.DecimalType(20, 0)) * passed) / n, 2).cast(T.DecimalType(10, 2)).alias("pass_rate"),
        F.sum(expected).alias("total_expected_records"),
        F.sum(loaded).alias("total_records_loaded"),
    )


def suite_failures(results: DataFrame, suite: str, test_id: list[str], test_name: Column, status: str) -> DataFrame:
    """The tests of every suite that did not pass (failed, error, skipped) as rows keyed by (suite, test id).

    The reference returns them as one ordered array per suite; a suite can
    hold any number of failures, so we keep them as rows (ordered by the
    test id when read) instead of collecting a whole group into one value.
    """
    return results.filter(F.col(status) != "passed").select(suite, *test_id, test_name.alias("test_name"))


# ---------------------------------------------------------------- AGG-12/13
def freshness(tables: Mapping[str, tuple[DataFrame, list[str], str | None]], declared: Mapping[str, str],
              upstream: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: row count, min/max of the first non-null candidate date
    column, last created, and its health: a feed declared ``stub`` or
    ``waiting`` says so; for the others it follows from whether the table and
    its upstream records (``upstream[name]``; absent: none) hold any row."""
    parts = []
    for name, (df, date_cols, created) in tables.items():
        dates = F.coalesce(*[F.col(c).cast("timestamp_ntz") for c in date_cols])
        made = F.col(created) if created else F.lit(None)
        own = df.agg(F.count(F.lit(1)).alias("row_count"), F.min(dates).alias("min_date"), F.max(dates).alias("max_date"),
                     F.max(made.cast("timestamp_ntz")).alias("last_created"), F.lit(False).alias("_up"))
        if name in upstream:  # a presence probe: one row is enough
            probe = upstream[name].limit(1).select(
                F.lit(0).cast("long").alias("row_count"), *[F.lit(None).cast("timestamp_ntz").alias(c)
                                                            for c in ("min_date", "max_date", "last_created")],
                F.lit(True).alias("_up"))
            own = own.unionByName(probe)
        parts.append(own.withColumns({"table_name": F.lit(name), "declared": F.lit(declared.get(name, "unknown"))}))
    out = reduce(DataFrame.unionByName, parts).groupBy("table_name", "declared").agg(
        F.sum("row_count").alias("row_count"), *[F.max(c).alias(c) for c in ("min_date", "max_date", "last_created")],
        F.bool_or("_up").alias("_up"))
    held, there = F.col("row_count") > 0, F.col("_up")
    return out.withColumn(
        "health",
        F.when(F.col("declared") == "stub", "not_implemented")
        .when(F.col("declared") == "waiting", "waiting_for_data")
        .when(held & there, "healthy")
        .when(held, "stale_data")
        .when(there, "needs_sync")
        .otherwise("no_data"),
    ).drop("_up")


def endpoint_status(fetches: DataFrame, outcome: str = "status") -> DataFrame:
    return fetches.groupBy(outcome).agg(F.count(F.lit(1)).alias("endpoint_count"))


# ---------------------------------------------------------------- AGG-14..20
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct()


def distinct_elements(df: DataFrame, arr: Column, name: str = "value") -> DataFrame:
    return df.select(F.explode(arr).alias(name)).filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()


def date_range(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    if where is not None:
        df = df.filter(where)
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"), F.count(F.lit(1)).alias("row_count"))


def pattern_summary(tested: DataFrame, result: str = "result", by: list[str] | None = None) -> DataFrame:
    """AGG-18: sums of the test results, over all rows or per ``by``."""
    r = F.col(result)
    n = F.count(F.lit(1))
    m = F.count_if(r["matches"])
    return tested.groupBy(*(by or [])).agg(
        n.alias("total"),
        m.alias("matches"),
        (n - m).alias("non_matches"),
        F.round(F.try_divide(m * F.lit(100).cast(T.DecimalType(20, 0)), n), 1).cast(T.DecimalType(10, 1)).alias(
            "match_rate"
        ),
        F.coalesce(F.bool_or(r["error"].isNotNull()), F.lit(False)).alias("has_errors"),
        F.coalesce(F.bool_and(r["is_valid"]), F.lit(True)).alias("all_valid"),
    )


def job_outcome(steps: DataFrame, run: str, status: str, exception: Column | None = None) -> DataFrame:
    """AGG-19: failed if an exception or only failures; partial if failures
    and successes; else success."""
    s = F.col(status)
    agg = steps.groupBy(run).agg(
        F.bool_or(s == "failed").alias("any_failed"),
        F.bool_or(s == "success").alias("any_success"),
        (F.bool_or(exception) if exception is not None else F.lit(False)).alias("any_exception"),
    )
    return agg.withColumn(
        "outcome",
        F.when(F.col("any_exception"), "failed")
        .when(F.col("any_failed") & F.col("any_success"), "partial")
        .when(F.col("any_failed"), "failed")
        .otherwise("success"),
    )


def label_count(datasets: DataFrame, pattern: str, as_of: str, days: int) -> DataFrame:
    return datasets.filter(
        F.col("label").like(pattern) & (F.col("createddate") >= _since_days(as_of, days))
    ).agg(F.count(F.lit(1)).alias("dataset_count"))


# ---------------------------------------------------------------- TOP-*
def newest_first(df: DataFrame, ts: str, tiebreak: str, k: int, where: Column | None = None) -> DataFrame:
    """TOP-01: TakeOrderedAndProject (k rows per task, merged) with a unique
    tiebreak so the result is deterministic."""
    if where is not None:
        df = df.filter(where)
    return df.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(k)


def page(df: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """TOP-02: LIMIT/OFFSET page over a total order."""
    return df.orderBy(*order).offset(offset).limit(size)


def keyset_page(df: DataFrame, order: list[tuple[str, bool]], after: tuple | None, size: int) -> DataFrame:
    """TOP-02 for deep pages: the next ``size`` rows strictly after the
    last row of the previous page (``after`` = its sort-key values), so no
    OFFSET rows are produced and thrown away.  ``order`` is a list of
    (column, descending) pairs ending in a unique column."""
    if after is not None:
        cond = None
        for i, (c, desc) in enumerate(order):
            beyond = F.col(c) < F.lit(after[i]) if desc else F.col(c) > F.lit(after[i])
            prefix_eq = [F.col(order[j][0]) == F.lit(after[j]) for j in range(i)]
            term = beyond
            for e in prefix_eq:
                term = term & e
            cond = term if cond is None else cond | term
        df = df.filter(cond)
    return df.orderBy(*[F.col(c).desc() if d else F.col(c).asc() for c, d in order]).limit(size)


def queue_pick(queue: DataFrame, batch: int = 10) -> DataFrame:
    """TOP-03: pending events with retries left, by (priority, created)."""
    return (
        queue.filter((F.col("status") == "pending") & (F.col("retry_count") < F.col("max_retries")))
        .orderBy("priority", "created_at", "event_id")
        .limit(batch)
    )


def run_steps(steps: DataFrame, run_col: str, run_id, order: list[str]) -> DataFrame:
    """TOP-04: the steps of one run in order."""
    return steps.filter(F.col(run_col) == F.lit(run_id)).orderBy(*order)


def parent_child_rollup(parents: DataFrame, children: DataFrame, key: str, child_key: str, as_of: str) -> DataFrame:
    """JOIN-04: pre-aggregate the child by key (partial aggregation), then one
    left join, so the join sees at most one child row per parent."""
    kids = children.groupBy(F.col(child_key).alias(key)).agg(
        F.count(F.lit(1)).alias("step_count"),
        F.count_if(F.col("status") == "success").alias("steps_success"),
        F.count_if(F.col("status") == "failed").alias("steps_failed"),
    )
    return parents.join(kids, key, "left").select(
        *[F.col(c) for c in parents.columns],
        duration_seconds("started_at", "completed_at", as_of).alias("duration_seconds"),
        F.coalesce("step_count", F.lit(0)).alias("step_count"),
        F.coalesce("steps_success", F.lit(0)).alias("steps_success"),
        F.coalesce("steps_failed", F.lit(0)).alias("steps_failed"),
    )
