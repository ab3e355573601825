"""Writes: append, upsert, insert-if-absent, DDL, landing, export, purge
(SNK-*).

Parquet tables cannot be updated in place, so row-level changes are
expressed as DataFrames (the rows to append, or the merged table) and
written to a NEW location; a table is never overwritten while the same
plan still reads it.  Counts come from ``DataFrame.observe`` on the write
itself, not from a second job.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.schema import infer_types, sanitize_name, spark_type
from kiln.operators.windows import row_number, running_sum
from kiln.session import hadoop_path, staging_dir

AUDIT_FIELDS = [
    T.StructField("created_date", T.TimestampNTZType(), True),
    T.StructField("created_by", T.StringType(), True),
    T.StructField("modified_date", T.TimestampNTZType(), True),
    T.StructField("modified_by", T.StringType(), True),
]


# ---------------------------------------------------------------- SNK-01
def stamp_dataset(df: DataFrame, dataset_id: int, columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``datasetid`` and align to the target's column order."""
    out = df.withColumn("datasetid", F.lit(dataset_id).cast("bigint"))
    if columns:
        out = out.select(*[F.col(c) if c in out.columns else F.lit(None).alias(c) for c in columns])
    return out


def append_dataset(df: DataFrame, path: str, dataset_id: int, fmt: str = "parquet") -> int:
    """SNK-01: stamp, append under ``datasetid=<id>`` and return the number
    of rows written (observed during the write)."""
    obs = Observation(f"append_{dataset_id}")
    stamped = stamp_dataset(df, dataset_id).observe(obs, F.count(F.lit(1)).alias("rows"))
    stamped.write.mode("append").partitionBy("datasetid").format(fmt).save(path)
    return int(obs.get["rows"])


def commit_dataset(df: DataFrame, path: str, dataset_id: int, fmt: str = "parquet") -> None:
    """SNK-01 as a commit: a dataset is one partition, replaced as a whole.

    A load that failed, or was killed after its write, is simply run again: rows never
    double and other datasets' files stay untouched.
    """
    stamped = stamp_dataset(df, dataset_id)
    rows = Observation(f"commit_{dataset_id}")
    out = stamped.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("datasetid").format(fmt).save(path)
    if not rows.get["rows"]:  # an empty write replaces no partition
        fs, p = hadoop_path(df.sparkSession, f"{path.rstrip('/')}/datasetid={dataset_id}")
        fs.delete(p, True)


# ---------------------------------------------------------------- SNK-02/03
def first_arrival(df: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    """One row per key: the earliest by ``order`` (a partial ``min_by``
    aggregate), or any one row when no order is given."""
    if order is None:
        return df.dropDuplicates(list(keys))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def last_arrival(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None,
           order: str | None = None) -> DataFrame:
    """SNK-02: the target after ``INSERT ... ON CONFLICT (keys) DO UPDATE``.

    The source is reduced to one row per key first (the latest by ``order``).
    A full outer join on the keys then takes, per column, the source value
    when the source has the key and the column is updatable, else the
    target's.  Write the result to a new location (``write_new_version``).
    """
    src = last_arrival(source, keys, order) if order else source.dropDuplicates(list(keys))
    src = src.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in target.columns if c not in keys and c in src.columns],
                     F.lit(True).alias("_s_hit"))
    j = target.withColumn("_t_hit", F.lit(True)).join(src, list(keys), "full_outer")
    upd = set(update_cols) if update_cols is not None else {c for c in target.columns if c not in keys}
    cols = []
    for c in target.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in upd and f"_s_{c}" in src.columns:
            cols.append(F.when(F.col("_s_hit"), F.col(f"_s_{c}")).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
        elif f"_s_{c}" in src.columns:
            # not updatable: an existing row keeps its value, NULL included
            cols.append(F.when(F.col("_t_hit"), F.col(c)).otherwise(F.col(f"_s_{c}")).cast(target.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def merge_partitions(spark: SparkSession, path: str, source: DataFrame, keys: Sequence[str], partition: str, bucket: Column,
                     update_cols: Sequence[str] | None = None, order: str | None = None) -> list:
    """SNK-02 on a table stored in partitions: only the partitions that hold a key of the source are read and rewritten.

    The table at ``path`` is partitioned by ``partition``, whose value is ``bucket``, an
    expression of the keys; so an existing row of a key can be nowhere else.  The
    touched partitions' values (metadata, not rows) prune the scan and are returned; their merged rows
    are written aside first and then replace the partitions, so a failed
    merge leaves either the old table or a complete copy to apply again.  Files of all
    other partitions are neither read nor changed.
    """
    src = source.withColumn(partition, bucket)
    touched = [r[0] for r in src.select(partition).distinct().collect()]
    if not touched:
        return []
    table = spark.read.parquet(path)
    hit = F.col(partition).isin([t for t in touched if t is not None])
    if None in touched:
        hit = hit | F.col(partition).isNull()
    merged = upsert(table.filter(hit), src, [*keys, partition], update_cols, order)
    aside = staging_dir(spark, "merge")
    merged.write.mode("overwrite").partitionBy(partition).parquet(aside)
    copy = spark.read.schema(table.schema).parquet(aside)
    copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    spark.catalog.refreshByPath(path)
    return sorted(touched, key=lambda t: (t is None, t))


def insert_ignore(target: DataFrame, source: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """SNK-03: rows to append for ``INSERT ... ON CONFLICT DO NOTHING``: the
    first arrival per key that the target does not hold yet (left anti join
    on the keys)."""
    first = first_arrival(source, keys, order)
    return first.join(target.select(*keys).distinct(), list(keys), "left_anti")


def write_new_version(df: DataFrame, base: str, version: str, fmt: str = "parquet") -> str:
    """Write ``df`` to ``<base>/v=<version>`` (never over the input)."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").format(fmt).save(path)
    return path


# ---------------------------------------------------------------- SNK-04..06
def truncate(spark: SparkSession, table: str) -> None:
    """SNK-04 for catalog (managed) tables."""
    spark.sql(f"TRUNCATE TABLE {table}")


def truncate_path(spark: SparkSession, path: str, fmt: str = "parquet") -> None:
    """SNK-04 for a table stored at a path: an empty overwrite that keeps
    the schema (readers see the same columns, zero rows)."""
    schema = spark.read.format(fmt).load(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").format(fmt).save(path)


def table_schema_from_sample(df: DataFrame, key: str = "id") -> T.StructType:
    """SNK-05: key + datasetid + inferred business columns (sorted by name)
    + audit columns.  Inference is one aggregate pass (PRJ-02)."""
    inferred = {r["column_name"]: r["inferred_type"] for r in infer_types(df).collect()}
    fields = [T.StructField(key, T.LongType(), False), T.StructField("datasetid", T.LongType(), True)]
    for name in sorted(inferred):
        fields.append(T.StructField(sanitize_name(name), spark_type(inferred[name]), True))
    return T.StructType(fields + AUDIT_FIELDS)


def schema_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A schema as (position, column_name, data_type) rows."""
    return spark.createDataFrame(
        [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(schema.fields)],
        "position int, column_name string, data_type string",
    )


def create_table(spark: SparkSession, table: str, schema: T.StructType, location: str | None = None) -> None:
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet{loc}")


def add_columns(spark: SparkSession, table: str, names: Sequence[str]) -> list[str]:
    """SNK-06: add missing columns as text; existing rows read NULL."""
    have = {c.lower() for c in spark.table(table).columns}
    new = [sanitize_name(n) for n in names if sanitize_name(n) not in have]
    if new:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{n}` string' for n in new)})")
    return new


# ---------------------------------------------------------------- SNK-07/08
SOURCE_PREFIXES = {
    # fixed values: config-name prefixes removed from landing-file slugs
    "newyorkfed": "NewYorkFed_",
    "bankofengland": "BankOfEngland_",
    "yfinance": "YFinance_",
    "coingecko": "CoinGecko_",
    "iiif": "IIIF_",
}


def landing_name(source: str, config_name: str, ts: str) -> str:
    slug = config_name.replace(SOURCE_PREFIXES.get(source, ""), "").lower()
    return f"{source}_{slug}_{ts}"


def land_json(df: DataFrame, base: str, source: str, config_name: str, ts: str) -> str:
    """SNK-07: write the records as JSON lines under the landing name."""
    path = os.path.join(base, source, landing_name(source, config_name, ts))
    df.write.mode("errorifexists").json(path)
    return path


def export_name(name: str, ts: str) -> str:
    return re.sub(r"[^\w\-_]", "_", name) + f"_{ts}"


def csv_line(df: DataFrame, quote_cols: Sequence[str] | None = None) -> DataFrame:
    """The CSV text of every row (header order = column order); quoted
    columns have '"' doubled, NULL -> empty field.  Used for previews and
    tests; ``export_csv`` writes the same through the CSV writer."""
    qc = set(quote_cols if quote_cols is not None else df.columns)
    parts = []
    for c in df.columns:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        if c in qc:
            v = F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))
        parts.append(v)
    return df.select(F.concat_ws(",", *parts).alias("csv_line"))


WHOLE_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def export_csv(df: DataFrame, base: str, name: str, ts: str, time_format: str = "yyyy-MM-dd HH:mm:ss") -> str:
    """SNK-08: one directory per result set, header + rows."""
    path = os.path.join(base, export_name(name, ts))
    (df.write.mode("errorifexists").option("header", True).option("escape", '"')
     .option("timestampNTZFormat", time_format).option("timestampFormat", time_format).csv(path))
    return path


# ---------------------------------------------------------------- SNK-09
ARCHIVE_CHUNK = 1 << 20


def _name_parts(name: Column) -> tuple[Column, Column]:
    return F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)


def _free_number_gaps(names: DataFrame, name_col: str) -> DataFrame:
    """_stem, _ext and _pos (how many free numbers lie below) of every name of the form stem_<n>.ext."""
    stem, ext = _name_parts(F.col(name_col))
    numbered = names.select(stem.alias("_full"), ext.alias("_ext")).select(
        F.regexp_extract("_full", r"^(.*)_([1-9][0-9]*)$", 1).alias("_stem"), "_ext",
        F.regexp_extract("_full", r"^(.*)_([1-9][0-9]*)$", 2).try_cast("bigint").alias("_no"),
    ).filter(F.col("_no").isNotNull()).distinct()
    ranked = row_number(numbered, ["_stem", "_ext"], ["_no"], F.floor(F.col("_no") / ARCHIVE_CHUNK), "_rank")
    return ranked.select("_stem", "_ext", (F.col("_no") - F.col("_rank")).alias("_pos"))


def archive_names(files: DataFrame, name_col: str, order: list[str], chunk: Column,
                  archived: DataFrame | None = None) -> DataFrame:
    """SNK-09: archive file names that collide neither with the archive nor
    with each other.

    The first file of a name (by ``order``) keeps it unless the archive holds
    it; the others get the free numbers ``_1``, ``_2``... before the extension,
    in order.  A number is free if neither the archive nor any file of the batch
    has that name.  Different names never share a numbered one, as the number
    is its last part.

    Both numberings are chunked (see ``windows``), so a name shared by a huge
    number of files is still spread over many tasks.
    """
    stem, ext = _name_parts(F.col(name_col))
    f = files.withColumns({"_stem": stem, "_ext": ext})
    f = row_number(f, ["_stem", "_ext"], order, chunk, "_n")
    names = files.select(name_col)
    if archived is not None:
        held = archived.select(F.col(name_col).alias("_held")).distinct()
        f = f.join(held, F.col(name_col) == F.col("_held"), "left").withColumn("_n", F.col("_n") + F.col("_held").isNotNull().cast("int"))
        names = names.unionByName(archived.select(name_col))
    # the k-th further file takes number k + (taken numbers with fewer than k free ones below)
    asks = f.select(*files.columns, "_stem", "_ext", (F.col("_n") - 1).cast("bigint").alias("_pos"), F.lit(0).alias("_taken"))
    taken = _free_number_gaps(names, name_col).withColumn("_taken", F.lit(1))
    d = running_sum(asks.unionByName(taken, allowMissingColumns=True), ["_stem", "_ext"], ["_pos", "_taken"],
                    F.col("_taken"), F.floor(F.col("_pos") / ARCHIVE_CHUNK), "_below").filter("_taken = 0")
    number = (F.col("_pos") + F.col("_below")).cast("string")
    return d.select(
        *files.columns,
        F.when(F.col("_pos") == 0, F.col(name_col)).otherwise(F.concat("_stem", F.lit("_"), number, "_ext")).alias("archive_name"),
    )


def unprocessed(files: DataFrame, ledger: DataFrame, key: str = "file_name") -> DataFrame:
    """Batch form of the processed-files ledger: files not consumed yet."""
    return files.join(ledger.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- SNK-10
def purge_split(df: DataFrame, ts: str, days: int, as_of: str) -> tuple[DataFrame, DataFrame]:
    """SNK-10: (kept, purged) for rows older than ``days`` before ``as_of``."""
    cutoff = F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp_ntz"))
    old = F.col(ts) < cutoff
    return df.filter(~old | F.col(ts).isNull()), df.filter(old)


def purge_preview(df: DataFrame, ts: str, days: int, as_of: str) -> DataFrame:
    _, purged = purge_split(df, ts, days, as_of)
    return purged.agg(F.count(F.lit(1)).alias("rows_to_purge"), F.min(ts).alias("oldest"), F.max(ts).alias("newest"))


def drop_old_partitions(spark: SparkSession, path: str, ts: str, day: str, days: int, as_of: str, archive: str) -> dict:
    """SNK-10 on a table partitioned by the date ``day`` of ``ts``: old partitions go, kept ones aren't rewritten.

    The old rows are exported as CSV first; a failed export removes nothing.  Partitions before the
    cutoff's day are removed as folders; only the day in which the cutoff falls is
    rewritten, by its own rows.  Running it again removes nothing more.
    Returns the export's path, the removed days and the rewritten one.
    """
    table = spark.read.parquet(path)
    cutoff = spark.range(1).select(F.timestamp_add("DAY", F.lit(-days), F.lit(as_of).cast("timestamp_ntz")).alias("t")).first()["t"]
    boundary = cutoff.date()
    kept, old = purge_split(table, ts, days, as_of)
    pruned = old.filter(F.col(day) <= F.lit(boundary))
    names = sorted(r[0] for r in table.select(day).filter(F.col(day) <= F.lit(boundary)).distinct().collect())
    if not names:
        return {"export": None, "removed": [], "rewritten": None}
    exported = export_csv(pruned, archive, "purged", cutoff.strftime("%Y%m%d_%H%M%S") + "_" + uuid.uuid4().hex[:8], WHOLE_TIME)
    rewritten = None
    if boundary in names and not pruned.filter(F.col(day) == F.lit(boundary)).isEmpty():
        rest = kept.filter(F.col(day) == F.lit(boundary))
        if not rest.isEmpty():
            rewritten = boundary
            aside = staging_dir(spark, "purge")
            rest.write.mode("overwrite").partitionBy(day).parquet(aside)
            spark.read.schema(table.schema).parquet(aside).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
        removed = [n for n in names if n < boundary] + ([boundary] if rewritten is None else [])
    else:
        removed = [n for n in names if n < boundary]
    for n in removed:
        fs, p = hadoop_path(spark, f"{path.rstrip('/')}/{day}={n}")
        fs.delete(p, True)
    spark.catalog.refreshByPath(path)
    return {"export": exported, "removed": removed, "rewritten": rewritten}


def purge(df: DataFrame, ts: str, days: int, as_of: str, archive: str, base: str, version: str) -> tuple[str, str]:
    """SNK-10 as a whole: the old rows are exported as CSV under ``archive``,
    then the kept rows are written as a new version of the table under
    ``base``.  Returns both paths; a failed export leaves no new version."""
    kept, old = purge_split(df, ts, days, as_of)
    exported = export_csv(old, archive, "purged", version, WHOLE_TIME)
    return exported, write_new_version(kept, base, version)
