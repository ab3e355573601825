"""Job protocol and the config-driven file import (UDF-01..04, AGG-21).

A job is ``extract -> transform -> load``; every stage passes a lazy
DataFrame, so the whole import is ONE Spark plan that runs at the write.
Load metrics (records extracted / transformed / loaded, files) are
``DataFrame.observe`` metrics collected by that same write, never by a
second job.  A dry run builds the identical plan and drives it into the
``noop`` sink: all parsing and transforms run, nothing is written.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators import schema as P
from kiln.operators.sinks import commit_dataset, stamp_dataset
from kiln.sources import files as FS
from kiln.sources.workbooks import column_names


class Job(Protocol):
    """UDF-01: a pluggable job life cycle."""

    def extract(self, spark: SparkSession) -> DataFrame: ...

    def transform(self, df: DataFrame) -> DataFrame: ...

    def load(self, df: DataFrame) -> dict: ...


@dataclass(frozen=True)
class ImportSpec:
    """One import configuration (the reference's config row)."""

    config_name: str
    source_directory: str
    target_path: str
    file_type: str = "csv"  # csv | json | json_blob | xml | xml_blob | xlsx
    file_pattern: str | None = None
    strategy: int = 1  # 1 auto-add columns, 2 ignore extra, 3 strict
    label_source: str = "static"  # filename | file_content | static
    label_location: str | None = None
    date_source: str = "static"
    date_location: str | None = None
    date_format: str = "yyyy-MM-dd"
    delimiter: str = "_"
    default_date: str = "1970-01-01"
    dataset_id: int = 1
    row_tag: str | None = None
    user: str = "etl_user"
    run_ts: str = "1970-01-01 00:00:00"
    target_schema: T.StructType | None = None
    reader_options: dict = field(default_factory=dict)


# Columns the import itself writes: no part of the source's or the target's own columns.
LINEAGE = ("dataset_label", "file_date", "source_file", "created_by", "created_date", "modified_by", "modified_date", "_path")
SYSTEM = ("datasetid", "unfit_values")


def _const(v) -> F.Column:
    return F.lit(v)


class GenericImport:
    """UDF-01 instance: the config-driven file import (flow A)."""

    def __init__(self, spark: SparkSession, spec: ImportSpec):
        self.spark = spark
        self.spec = spec
        self.obs_load = Observation(f"load_{spec.config_name}")
        self.table_schema = spec.target_schema

    # ---- extract: reader registry (UDF-02)
    def extract(self, spark: SparkSession | None = None) -> DataFrame:
        s = self.spec
        kw = {"pattern": s.file_pattern}
        if s.file_type in ("xml", "xml_blob"):
            kw["row_tag"] = s.row_tag
        df = FS.read(spark or self.spark, s.file_type, s.source_directory, **kw)
        if s.file_type == "xlsx":
            cols = column_names(spark or self.spark, s.source_directory, s.file_pattern)
            df = FS.widen(df, cols).withColumnsRenamed({"file_name": "_file", "file_path": "_path", "row_number": "_pos"})
        elif s.file_type.endswith("_blob"):
            df = df.withColumnRenamed("source_file", "_file").withColumn("_pos", F.lit(0).cast("long"))
        return df

    # ---- transform: lineage, names, nested -> JSON, audit, strategy
    def transform(self, df: DataFrame) -> DataFrame:
        s = self.spec
        df = self._label_and_date(df)
        keep = [c for c in df.columns if c not in ("_file", "_path", "_pos", "_label", "_date")]
        names = P.sanitize_columns(df.select(*keep)).columns  # metadata only; raises on collisions
        df = df.select(
            *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
            F.col("_label").alias("dataset_label"), F.col("_date").alias("file_date"), F.col("_file").alias("source_file"),
            F.col("_path").alias("_path"),
        )
        df = P.nested_to_json(df)
        df = P.add_audit(df, s.user, s.run_ts)
        if s.target_schema is not None:
            df = self._align(df, s.target_schema)
        return df

    def _align(self, df: DataFrame, target: T.StructType) -> DataFrame:
        """Apply the column strategy to the source's own columns.

        Lineage and audit columns are no part of the comparison and keep their
        types.  Values the target's types can't hold go to ``unfit_values``.
        ``self.table_schema`` is the target after the load (strategy 1 adds columns).
        """
        s = self.spec
        data = df.drop(*LINEAGE)
        wanted = T.StructType([f for f in target.fields if f.name not in (*LINEAGE, *SYSTEM)])
        if s.strategy == 1:
            _, wanted = P.align_auto_add(data, wanted)
        elif s.strategy == 3:
            P.align_strict(data, wanted)
        kept = T.StructType([df.schema[c] for c in LINEAGE if c in df.columns])
        out = df.withColumn("unfit_values", P.unfit(df, wanted))
        whole = T.StructType([*wanted.fields, *kept.fields, out.schema["unfit_values"]])
        self.table_schema = T.StructType([f for f in whole.fields if f.name != "_path"])
        return P.align_ignore_extra(out, whole)

    def _label_and_date(self, df: DataFrame) -> DataFrame:
        s = self.spec
        if s.label_source == "filename":
            df = df.withColumn("_label", P.label_from_name(F.col("_file"), int(s.label_location or 0), s.delimiter))
        elif s.label_source == "file_content":
            df = FS.with_first_record_value(df, s.label_location, "_label")
        else:
            df = df.withColumn("_label", _const(s.label_location or s.config_name))
        if s.date_source == "filename":
            df = df.withColumn("_date", P.date_from_name(F.col("_file"), int(s.date_location or 0), s.date_format,
                                                         s.default_date, s.delimiter))
        elif s.date_source == "file_content":
            df = FS.with_first_record_value(df, s.date_location, "_date_txt")
            df = df.withColumn("_date", P.date_from_text(F.col("_date_txt"), s.date_format, s.default_date)).drop("_date_txt")
        else:
            df = df.withColumn("_date", P.date_from_text(_const(s.date_location), s.date_format, s.default_date)
                               if s.date_location else F.lit(s.default_date).cast("date"))
        return df

    # ---- load: stamp the dataset and commit it as a whole; metrics from the write itself
    def load(self, df: DataFrame, dry_run: bool = False) -> dict:
        s = self.spec
        # the transform never drops records, so extracted == loaded; files are counted in the listing
        files = FS.discover_files(self.spark, s.source_directory, s.file_pattern).count()
        out = df.observe(self.obs_load, F.count(F.lit(1)).alias("loaded")).drop("_path")
        if dry_run:
            stamp_dataset(out, s.dataset_id).write.format("noop").mode("overwrite").save()
        else:
            commit_dataset(out, s.target_path, s.dataset_id)
        rows = int(self.obs_load.get["loaded"])
        return {"files": int(files), "extracted": rows, "loaded": rows}

    def run(self, dry_run: bool = False) -> dict:
        """Returns a result row (the reference's run returns nothing, so
        its completion event was never emitted)."""
        metrics = self.load(self.transform(self.extract()), dry_run=dry_run)
        metrics.update({"config_name": self.spec.config_name, "dataset_id": self.spec.dataset_id,
                        "status": "Active" if not dry_run else "DryRun"})
        return metrics


def metrics_frame(spark: SparkSession, metrics: dict) -> DataFrame:
    """AGG-21: a run's metrics as one row."""
    return spark.createDataFrame(
        [(metrics["config_name"], metrics["dataset_id"], metrics["files"], metrics["extracted"], metrics["loaded"],
          metrics["status"])],
        "config_name string, dataset_id long, files long, extracted long, loaded long, status string",
    )
