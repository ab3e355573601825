"""The whole import as one restartable job (UDF-01 with SNK-01, SNK-05, SNK-06, SNK-09 and the completion event).

A run takes the files that no earlier dataset took, creates or evolves the target,
commits the dataset's rows as one partition, archives the files under names that
never collide, records the dataset and emits one ``import_complete`` event.

Each step leaves its facts in the ledger: Parquet folders with one partition a
dataset, replaced as a whole.  A run that was killed is started again with the same
dataset id and goes on after the last step whose facts are there; running a
finished dataset again changes nothing.  The steps, in order:

  files     path, uri, name, length and time of each file taken; what lands later waits for the next dataset
  schema    the target's columns after the load
  load      files and rows
  moves     the archive name of each file, fixed before the first one moves
  archive   the same, when all have moved
  dataset   label, date and status of the dataset (also ``Failed``)
  event     the completion event
"""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.jobs import GenericImport, ImportSpec
from kiln.operators import sinks as K
from kiln.operators.datasets import resolve_active
from kiln.session import hadoop_path, path_exists
from kiln.sources import files as FS

SAMPLE_ROWS = 5
FILES = "path string, uri string, file_name string, length long, modified timestamp"
DATASETS = "config_name string, label string, datasettype string, datasource string, datasetdate date, createddate timestamp_ntz, status string, activated boolean"
EVENTS = "event_type string, event_source string, event_data string, status string, created_at timestamp_ntz"


class Ledger:
    """Facts of the steps of all datasets under one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def done(self, step: str, dataset_id: int) -> bool:
        return path_exists(self.spark, f"{self.base}/{step}/datasetid={dataset_id}")

    def record(self, step: str, dataset_id: int, facts: DataFrame) -> None:
        K.commit_dataset(facts, f"{self.base}/{step}", dataset_id)

    def read(self, step: str, schema: str) -> DataFrame:
        """Facts of all datasets (none yet: no rows)."""
        whole = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("datasetid", T.LongType())])
        if not path_exists(self.spark, f"{self.base}/{step}"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.base}/{step}")

    def of(self, step: str, schema: str, dataset_id: int) -> DataFrame:
        return self.read(step, schema).filter(F.col("datasetid") == dataset_id).drop("datasetid")


def archive_files(spark: SparkSession, moves: DataFrame, archive: str) -> None:
    """Rename each file of ``moves`` (path, archive_name) into the archive; a file that has moved already is left alone.

    Renames are calls to the file system's name service; the list is streamed, never held.
    """
    fs, folder = hadoop_path(spark, archive)
    fs.mkdirs(folder)
    for r in moves.select("path", "archive_name").toLocalIterator():
        _, src = hadoop_path(spark, r["path"])
        _, dst = hadoop_path(spark, f"{archive.rstrip('/')}/{r['archive_name']}")
        if fs.exists(src):
            if fs.exists(dst) or not fs.rename(src, dst):
                raise FileExistsError(f"{r['path']} can't move to {r['archive_name']}")
        elif not fs.exists(dst):
            raise FileNotFoundError(r["path"])


class DatasetImport(GenericImport):
    """One dataset of a configured import, from new files to the completion event."""

    def __init__(self, spark: SparkSession, spec: ImportSpec, state: str, archive: str, table: str | None = None,
                 dataset_type: str = "import", data_source: str = "files"):
        super().__init__(spark, spec)
        self.ledger, self.archive, self.table = Ledger(spark, state), archive, table
        self.dataset_type, self.data_source = dataset_type, data_source

    # ---- files
    def take_files(self) -> DataFrame:
        """Files of the source folder that no dataset has taken (the same name landed again is another file)."""
        s = self.spec
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(s.source_directory).select(
            "path", F.col("_metadata.file_path").alias("uri"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
            "length", F.col("modificationTime").alias("modified"))
        if s.file_pattern:
            listed = listed.filter(F.col("file_name").rlike(FS._anchored(s.file_pattern)))
        taken = self.ledger.read("files", FILES).filter(F.col("datasetid") != s.dataset_id)
        return listed.join(taken, ["path", "length", "modified"], "left_anti")

    def extract(self, spark: SparkSession | None = None) -> DataFrame:
        files = self.ledger.of("files", FILES, self.spec.dataset_id)
        names = files.select(F.explode(F.array_distinct(F.array("path", "uri"))).alias("_path"))
        return super().extract(spark).join(names, "_path", "left_semi")

    # ---- target
    def target_columns(self) -> T.StructType | None:
        """The target's columns after the loads so far; they only ever get more."""
        rows = self.ledger.read("schema", "position int, column_name string, data_type string").filter(
            F.col("datasetid") != self.spec.dataset_id)
        last = rows.groupBy("datasetid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("datasetid")).first()
        if last is None:
            return None
        found = rows.filter(F.col("datasetid") == last["datasetid"]).orderBy("position").collect()
        return T.StructType([T.StructField(r["column_name"], T._parse_datatype_string(r["data_type"])) for r in found])

    def target_columns_after(self) -> T.StructType:
        """All columns of the target, as recorded by this dataset's load."""
        rows = self.ledger.of("schema", "position int, column_name string, data_type string", self.spec.dataset_id)
        return T.StructType([T.StructField(r["column_name"], T._parse_datatype_string(r["data_type"])) for r in rows.orderBy("position").collect()]
                            + [T.StructField("datasetid", T.LongType())])

    def prepare_target(self) -> None:
        """Create the target from a few records if there is none, else take its columns."""
        columns = self.target_columns() or self.spec.target_schema
        if columns is None:
            sample = super().transform(self.extract()).drop("_path", "dataset_label", "file_date", "source_file", "created_by", "created_date")
            inferred = K.table_schema_from_sample(sample.limit(SAMPLE_ROWS))
            columns = T.StructType([f for f in inferred.fields if f.name not in ("id", "datasetid", *(a.name for a in K.AUDIT_FIELDS))])
        self.spec = replace(self.spec, target_schema=columns)

    def sync_catalog(self) -> None:
        """Create the catalog table, or add the columns the load brought, and show it the dataset's partition."""
        fields = [f for f in self.table_schema.fields if f.name != "datasetid"]
        if not self.spark.catalog.tableExists(self.table):
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
            self.spark.sql(f"CREATE TABLE {self.table} ({cols}, datasetid BIGINT) USING parquet PARTITIONED BY (datasetid) "
                           f"LOCATION '{self.spec.target_path}'")
        else:
            have = {c.lower() for c in self.spark.table(self.table).columns}
            new = [f for f in fields if f.name.lower() not in have]
            if new:
                cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
                self.spark.sql(f"ALTER TABLE {self.table} ADD COLUMNS ({cols})")
        self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS PARTITION (datasetid={self.spec.dataset_id})")
        self.spark.catalog.refreshTable(self.table)

    # ---- load
    def load_dataset(self) -> None:
        s, led = self.spec, self.ledger
        self.prepare_target()
        ident = F.col("_path")
        about = self.spark.createDataFrame([(s.dataset_id,)], "datasetid long")
        df = self.transform(self.extract())
        obs = self.obs_load
        out = df.observe(obs, F.count(F.lit(1)).alias("loaded"), F.min_by("dataset_label", ident).alias("label"),
                         F.min_by("file_date", ident).alias("date"))
        led.record("schema", s.dataset_id, K.schema_rows(self.spark, self.table_schema))
        K.commit_dataset(out.drop("_path"), s.target_path, s.dataset_id)
        m = obs.get
        files = led.of("files", FILES, s.dataset_id).count()
        facts = about.select(F.lit(s.config_name).alias("config_name"), F.lit(files).cast("long").alias("files"),
                             F.lit(m["loaded"]).cast("long").alias("loaded"), F.lit(m["label"]).cast("string").alias("label"),
                             F.lit(m["date"]).cast("date").alias("datasetdate"))
        self.after_write()
        led.record("load", s.dataset_id, facts)

    def after_write(self) -> None:
        """Called between the rows' commit and its record; subclasses may use it."""

    # ---- record and event
    def record_dataset(self, status: str, label: str | None = None, date=None) -> None:
        s = self.spec
        row = (s.config_name, label, self.dataset_type, self.data_source, date, None, status, status == "Active")
        one = self.spark.createDataFrame([row], DATASETS).withColumn("createddate", F.lit(s.run_ts).cast("timestamp_ntz"))
        self.ledger.record("dataset", s.dataset_id, one)

    def emit_event(self, facts: dict) -> None:
        s = self.spec
        data = json.dumps({"config_name": s.config_name, "files_processed": facts["files"], "records_loaded": facts["loaded"],
                           "dataset_id": s.dataset_id})
        one = self.spark.createDataFrame([("import_complete", f"generic_import:{s.config_name}", data, "pending", None)], EVENTS)
        self.ledger.record("event", s.dataset_id, one.withColumn("created_at", F.lit(s.run_ts).cast("timestamp_ntz")))

    def run(self, dry_run: bool = False) -> dict:
        """Run or resume the dataset; returns its load facts."""
        if dry_run:
            return super().run(dry_run=True)
        s, led = self.spec, self.ledger
        if not led.done("files", s.dataset_id):
            led.record("files", s.dataset_id, self.take_files())
            if not led.done("files", s.dataset_id):
                return {"config_name": s.config_name, "dataset_id": s.dataset_id, "files": 0, "extracted": 0, "loaded": 0, "status": "NoFiles"}
        if not led.done("load", s.dataset_id):
            try:
                self.load_dataset()
            except Exception:
                self.record_dataset("Failed")
                raise
            if self.table:
                self.sync_catalog()
        facts = led.of("load", "config_name string, files long, loaded long, label string, datasetdate date", s.dataset_id).first().asDict()
        if not led.done("moves", s.dataset_id):
            files = led.of("files", FILES, s.dataset_id)
            held = self.spark.createDataFrame([], "file_name string")
            if path_exists(self.spark, self.archive):
                held = FS.discover_files(self.spark, self.archive).select("file_name")
            order = F.floor(F.unix_timestamp("modified") / 3600)  # ordered chunks of a name: hours
            led.record("moves", s.dataset_id, K.archive_names(files, "file_name", ["modified", "path"], order, held))
        if not led.done("archive", s.dataset_id):
            moves = led.of("moves", FILES + ", archive_name string", s.dataset_id)
            archive_files(self.spark, moves, self.archive)
            led.record("archive", s.dataset_id, moves)
        if not led.done("event", s.dataset_id):
            self.record_dataset("Active", facts["label"], facts["datasetdate"])
            self.emit_event(facts)
        return {"config_name": s.config_name, "dataset_id": s.dataset_id, "files": facts["files"], "extracted": facts["loaded"],
                "loaded": facts["loaded"], "status": "Active"}

    def datasets(self) -> DataFrame:
        """All datasets of the ledger with the one active in each (label, type, source)."""
        d = self.ledger.read("dataset", DATASETS).withColumnRenamed("status", "load_status")
        return resolve_active(d, ["label", "datasettype", "datasource"], seq="datasetid")
