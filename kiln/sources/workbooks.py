"""Workbooks as a Python data source (SRC-06, UDF-02): ``spark.read.format("kiln_xlsx")`` and the same for writes.

Reading: files are dealt to tasks by size; a task streams the active sheet of one workbook after the
other, row by row, so a sheet is never held whole.  The first row holds the column names (blank:
``column_<i>``).  Without a schema a row is (file_path, row_number, record), with ``record`` a map of
text; with one, each text column is the cell under that name (NULL if the file has no such
column) and ``file_path`` and ``row_number`` may be among the columns.  Rows without any value are
skipped.  ``pattern`` is matched at the start of the file name, ``recursive`` reads sub-folders too,
``part=headers`` reads the names only.

Writing: a task streams its rows into workbooks of at most ``max_rows`` rows (a sheet's limit by
default) under ``_temporary``; the commit moves the files of the successful attempts into the folder, an
abort or a lost attempt leaves nothing that a reader sees.  NULL is an empty cell; characters that XML has
no place for are written as ``_xHHHH_``.

Storage is reached through pyarrow's file systems: local paths, ``hdfs://``, ``s3://`` (also spelled ``s3a://``), ``gs://``.
A folder without workbooks has no rows.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from kiln.session import local_path
from kiln.sources.files import _NS, _REL, _cell_text, _col_index, xlsx_parts

FORMAT = "kiln_xlsx"
RECORD_SCHEMA = "file_path string, row_number bigint, record map<string,string>"
HEADER_SCHEMA = "file_path string, row_number bigint, name string"
MAX_ROWS = (1 << 20) - 1  # fixed value: rows of a sheet below its header
SPLIT_BYTES = 32 << 20
BATCH_ROWS = 4096
_UNFIT = re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    local = local_path(path)
    if local is not None:
        return pafs.LocalFileSystem(), local
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def _text(v: str) -> str:
    return escape(_UNFIT.sub(lambda m: f"_x{ord(m.group()):04X}_", v))


def _value(v: str | None) -> str | None:
    return v if v is None or "_x" not in v else _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), v)


def _sheet_name(z: zipfile.ZipFile) -> str:
    book = ET.fromstring(z.read("xl/workbook.xml"))
    view = book.find(f"{_NS}bookViews/{_NS}workbookView")
    sheets = book.findall(f"{_NS}sheets/{_NS}sheet")
    active = sheets[int(view.get("activeTab", "0")) if view is not None else 0]
    for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if "xl/_rels/workbook.xml.rels" in z.namelist() else ():
        if r.get("Id") == active.get(_REL + "id"):
            target = r.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def _strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as f:
        return ["".join(t.text or "" for t in x.iter(_NS + "t")) for _, x in ET.iterparse(f) if x.tag == _NS + "si"]


def sheet_rows(f) -> Iterator[dict[int, str | None]]:
    """The rows of the active sheet, {column: text}, one after the other."""
    with zipfile.ZipFile(f) as z:
        shared = _strings(z)
        with z.open(_sheet_name(z)) as sheet:
            data = None
            for event, x in ET.iterparse(sheet, ("start", "end")):
                if event == "start":
                    data = x if x.tag == _NS + "sheetData" else data
                elif x.tag == _NS + "row":
                    yield {(_col_index(c.get("r")) if c.get("r") else i): _value(_cell_text(c, shared)) for i, c in enumerate(x.iter(_NS + "c"))}
                    data.clear()  # rows already read


def sheet_records(f) -> Iterator[tuple[int, dict[str, str | None]]]:
    """(0, the header's names) and (row number, record) of every row with a value."""
    rows = sheet_rows(f)
    first = next(rows, {})
    names = [first.get(i) or f"column_{i}" for i in range(max(first, default=-1) + 1)]
    yield 0, dict.fromkeys(names)
    for n, row in enumerate(rows, 1):
        if any(row.get(i) not in (None, "") for i in range(len(names))):
            yield n, {name: row.get(i) for i, name in enumerate(names)}


@dataclass
class Files(InputPartition):
    paths: list[str]


class WorkbookReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.pattern, self.headers = options["path"], options.get("pattern"), options.get("part") == "headers"
        self.recursive = options.get("recursive", "false") == "true"
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(root)
        infos = [found] if found.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=self.recursive))
        below = len(root.rstrip("/")) + 1
        out: list[Files] = []
        room = 0
        for i in sorted(infos, key=lambda i: i.path):
            hidden = any(p.startswith(("_", ".")) for p in i.path[below:].split("/"))
            if not i.is_file or hidden or not i.path.endswith(".xlsx") or (self.pattern and not re.match(self.pattern, i.base_name)):
                continue
            if not out or i.size > room:
                out.append(Files([]))
                room = SPLIT_BYTES
            out[-1].paths.append(i.path)
            room -= i.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.path)
        rows: list[tuple] = []
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for n, record in sheet_records(f):
                    if self.headers:
                        rows += [(path, 0, name) for name in record]
                        break
                    if n:
                        rows.append(tuple(
                            path if c == "file_path" else n if c == "row_number" else list(record.items()) if t.startswith("map") else record.get(c)
                            for c, t in self.columns))
                    if len(rows) == BATCH_ROWS:
                        yield self._batch(rows)
                        rows = []
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"bigint": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}
        arrays = [pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(self.columns)]
        return pa.RecordBatch.from_arrays(arrays, names=[c for c, _ in self.columns])


@dataclass
class Written(WriterCommitMessage):
    names: list[str]
    rows: int


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.path, self.overwrite, self.names = options["path"], overwrite, schema.names
        self.max_rows = int(options.get("max_rows", MAX_ROWS))
        if not 0 < self.max_rows <= MAX_ROWS:
            raise ValueError(f"max_rows must be 1 to {MAX_ROWS}")
        self.job = uuid.uuid4().hex

    def _temporary(self) -> tuple[pafs.FileSystem, str, str]:
        fs, root = file_system(self.path)
        root = root.rstrip("/")
        return fs, root, f"{root}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, _, temporary = self._temporary()
        fs.create_dir(temporary, recursive=True)
        task = TaskContext.get()
        done = Written([], 0)
        rest = (batch.slice(lo, BATCH_ROWS) for batch in iterator for lo in range(0, batch.num_rows, BATCH_ROWS))
        batch = next(rest, None)
        while batch is not None:
            name = f"part-{task.partitionId():05d}-{len(done.names):03d}-{task.taskAttemptId()}-{self.job}.xlsx"
            room = self.max_rows
            with fs.open_output_stream(f"{temporary}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                head, tail, others = xlsx_parts()
                for part, content in others.items():
                    z.writestr(part, content)
                with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
                    sheet.write((head + self._row(self.names)).encode())
                    while batch is not None and room:
                        now = batch.slice(0, room)
                        columns = [c.cast(pa.string()).to_pylist() for c in now.columns]
                        sheet.write("".join(map(self._row, zip(*columns))).encode())
                        room -= now.num_rows
                        done.rows += now.num_rows
                        batch = batch.slice(now.num_rows) if now.num_rows < batch.num_rows else next(rest, None)
                    sheet.write(tail.encode())
            done.names.append(name)
        return done

    @staticmethod
    def _row(values) -> str:
        # cells without a reference follow each other, so an empty one keeps its place
        return "<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>' for v in values) + "</row>"

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root, temporary = self._temporary()
        fs.create_dir(root, recursive=True)
        old = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file and i.path.endswith(".xlsx")] if self.overwrite else []
        for name in (n for m in messages if m for n in m.names):
            fs.move(f"{temporary}/{name}", f"{root}/{name}")
        for path in old:
            fs.delete_file(path)
        self._clear(fs, temporary)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _, temporary = self._temporary()
        self._clear(fs, temporary)

    @staticmethod
    def _clear(fs: pafs.FileSystem, temporary: str) -> None:
        if fs.get_file_info(temporary).type != pafs.FileType.NotFound:
            fs.delete_dir(temporary)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return HEADER_SCHEMA if self.options.get("part") == "headers" else RECORD_SCHEMA

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def column_names(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """The names in the headers of all workbooks: the folder's schema.  Reads each file up to its first row."""
    register(spark)
    read = spark.read.format(FORMAT).option("part", "headers")
    if pattern:
        read = read.option("pattern", pattern)
    return sorted(r["name"] for r in read.load(path).select("name").distinct().collect())


def scan_workbooks(spark: SparkSession, path: str, pattern: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A folder of workbooks as text columns, with ``file_path``, ``row_number`` and ``file_name``."""
    register(spark)
    names = column_names(spark, path, pattern) if columns is None else columns
    lineage = [T.StructField("file_path", T.StringType()), T.StructField("row_number", T.LongType())]
    schema = T.StructType([*lineage, *(T.StructField(c, T.StringType()) for c in names)])
    read = spark.read.format(FORMAT).schema(schema)
    if pattern:
        read = read.option("pattern", pattern)
    return read.load(path).withColumn("file_name", F.regexp_extract("file_path", r"([^/]*)$", 1))


def write_workbooks(df: DataFrame, path: str, mode: str = "append", max_rows: int = MAX_ROWS) -> None:
    """``df`` as workbooks; every column as Spark prints it."""
    register(df.sparkSession)
    text = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.write.format(FORMAT).mode(mode).option("max_rows", str(max_rows)).save(path)
