"""Dataset versioning: single active dataset per key (WIN-01..03).

The reference enforces "at most one active dataset per (label, type,
source)" with a row trigger that runs at every activation.  Replayed over an
explicit activation sequence it is a running computation:

* activation of D succeeds iff D.date >= max(date) of all datasets of the
  key created up to and including D (never-activated ones count too);
* the last successful activation of a key is the active dataset; every
  earlier successful one was deactivated (status Inactive) when the next
  successful activation happened, which sets its effective-thru;
* a failed activation leaves the dataset inactive but keeps status Active
  (the reference's quirk, kept on purpose).

Everything is expressed with chunked windows (see ``windows``) so a key
holding a large share of the datasets is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.windows import after_in_chunk, chunked, in_chunk

FAR_FUTURE = "9999-01-01 00:00:00"


def resolve_active(
    datasets: DataFrame,
    keys: list[str],
    seq: str = "seq",
    date: str = "datasetdate",
    activated: str = "activated",
    event_ts: str = "createddate",
    chunk_rows: int = 1 << 20,
) -> DataFrame:
    """Adds run_max_date, activation_ok, isactive, status, efffrom, effthru.

    One scan over chunk summaries carries the latest date forward and the next
    activation back.  Inside a chunk an activation stands if its date is the
    latest so far; dates of such activations never fall, so of a chunk the summary
    needs only the first of each date - if no row of a later date stands before
    it - and the one that counts is the first not below the date carried in.
    A summary has at most one entry a date.
    """
    chunk = F.floor(F.col(seq) / F.lit(chunk_rows))
    # a struct, so that a next activation without a time still counts as one
    d = chunked(datasets, keys, chunk).withColumn("_ts", F.struct(F.col(event_ts).alias("ts")))
    first = F.struct(F.col(seq).alias("seq"), F.col("_ts").alias("ts"))
    dates = d.groupBy("_at", F.col(date).alias("_date")).agg(
        F.min(seq).alias("_seen"), F.min(F.when(F.col(activated), first)).alias("_first"))
    # by key from here on: one exchange serves the chunk's summary and the scan over chunks
    dates = dates.select(F.col("_at.key").alias("_key"), F.col("_at.chunk").alias("_chunk"), "_date", "_seen", "_first").repartition("_key")
    steps = dates.groupBy("_key", "_chunk").agg(
        F.max("_date").alias("_latest"),
        F.sort_array(F.collect_list(F.struct(F.col("_date").alias("date"), "_seen", "_first"))).alias("_dates"))
    # from the latest date back: the least sequence value of all later dates stops older ones
    standing = F.aggregate(
        F.reverse(F.filter("_dates", lambda s: s["date"].isNotNull())),
        F.struct(F.lit(None).cast(datasets.schema[seq].dataType).alias("stop"),
                 F.lit(None).cast(T.StructType([T.StructField("ts", datasets.schema[event_ts].dataType)])).alias("ts")),
        lambda a, s: F.when(
            (s["date"] >= F.coalesce(F.col("_carried"), s["date"])),
            F.struct(F.least(a["stop"], s["_seen"]).alias("stop"),
                     F.when((s["_first"]["seq"] < a["stop"]) | (s["_first"].isNotNull() & a["stop"].isNull()), s["_first"]["ts"])
                     .otherwise(a["ts"]).alias("ts")),
        ).otherwise(a),
    )["ts"]
    by_key = Window.partitionBy("_key").orderBy("_chunk")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("_key").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = steps.withColumn("_carried", F.max("_latest").over(before)).withColumn("_standing", standing).select(
        F.struct(F.col("_key").alias("key"), F.col("_chunk").alias("chunk")).alias("_at"), "_carried",
        F.last("_standing", ignorenulls=True).over(after).alias("_later"))
    d = d.withColumns({"_in": F.max(date).over(in_chunk([seq])), "_nth": F.row_number().over(in_chunk([seq]))}).join(carry, "_at")
    d = d.withColumn("run_max_date", F.greatest("_in", "_carried"))
    d = d.withColumn("activation_ok", F.col(activated) & (F.col(date) >= F.col("run_max_date")))
    d = d.withColumn("_next_ok", F.coalesce(
        F.last(F.when(F.col("activation_ok"), F.col("_ts")), ignorenulls=True).over(after_in_chunk("_nth")), F.col("_later")))
    isactive = F.coalesce(F.col("activation_ok"), F.lit(False)) & F.col("_next_ok").isNull()
    status = (
        F.when(~F.col(activated), "New")
        .when(F.col("activation_ok") & isactive, "Active")
        .when(F.col("activation_ok"), "Inactive")
        .otherwise("Active")
    )
    effthru = F.when(F.col("activation_ok") & ~isactive, F.col("_next_ok.ts")).otherwise(
        F.lit(FAR_FUTURE).cast("timestamp_ntz")
    )
    return d.select(
        *datasets.columns,
        "run_max_date",
        "activation_ok",
        isactive.alias("isactive"),
        status.alias("status"),
        F.col(event_ts).alias("efffrom"),
        effthru.alias("effthru"),
    )


def as_of(resolved: DataFrame, t: str, date: str = "datasetdate") -> DataFrame:
    """WIN-02: versions effective at ``t`` with display columns."""
    ts = F.lit(t).cast("timestamp_ntz")
    return resolved.filter((F.col("efffrom") <= ts) & (ts <= F.col("effthru"))).select(
        *resolved.columns,
        F.when(F.col("effthru") > ts, "Current").otherwise("Expired").alias("validity"),
        F.when(F.col("isactive"), "Yes").otherwise("No").alias("active_text"),
        F.date_diff(ts.cast("date"), F.col(date)).alias("age_days"),
    )


def lifecycle(
    datasets: DataFrame,
    outcomes: DataFrame,
    key: str,
    outcome: str,
    lookups: dict[str, tuple[DataFrame, str, Column]],
) -> DataFrame:
    """WIN-03: status from the load outcome (no load -> New, failed ->
    Failed, else Active); every lookup (type, source, ...) must resolve,
    otherwise the dataset is in Error with a message naming the value.

    ``lookups`` maps a name to (reference frame, reference key, dataset
    column); reference frames are small and resolved by left joins.
    """
    d = datasets.join(outcomes.select(key, outcome), key, "left")
    errors = []
    for name, (ref, ref_key, col) in lookups.items():
        tag = f"_has_{name}"
        r = ref.select(F.col(ref_key).alias(f"_ref_{name}")).distinct().withColumn(tag, F.lit(True))
        d = d.join(r, col == F.col(f"_ref_{name}"), "left").drop(f"_ref_{name}")
        errors.append(F.when(F.col(tag).isNull(), F.concat(F.lit(f"unknown {name}: "), col.cast("string"))))
        d = d.withColumn(f"_err_{name}", errors[-1]).drop(tag)
    err_cols = [F.col(f"_err_{n}") for n in lookups]
    err = F.concat_ws("; ", *err_cols)
    d = d.withColumn("error", F.nullif(err, F.lit("")))
    status = (
        F.when(F.col("error").isNotNull(), "Error")
        .when(F.col(outcome).isNull(), "New")
        .when(F.col(outcome) == "failed", "Failed")
        .otherwise("Active")
    )
    return d.withColumn("status", status).drop(*[f"_err_{n}" for n in lookups])
