"""Landed files -> DataFrames (SRC-01..07, SRC-11).

Readers are registered by file type (UDF-02) and all return a DataFrame
with the lineage columns ``_file`` (file name) and ``_pos`` (an increasing
position of the record inside its file, used to find a file's first
record).  Formats that cannot be split (multi-line CSV/JSON, whole-text
blobs, workbooks) parallelise by file.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _anchored(pattern: str | None) -> str | None:
    """File-name patterns match at the start only (like ``re.match``)."""
    return None if not pattern else "^(?:" + pattern + ")"


def _with_lineage(df: DataFrame, pattern: str | None) -> DataFrame:
    out = df.withColumns(
        {"_file": F.col("_metadata.file_name"), "_path": F.col("_metadata.file_path"),
         "_pos": F.monotonically_increasing_id()}
    )
    p = _anchored(pattern)
    return out.filter(F.col("_file").rlike(p)) if p else out


def _csv_names(header: str) -> list[str]:
    """Column names of a header line; unnamed and repeated ones get their position, as Spark's reader does."""
    names = next(csv.reader([header.lstrip("\ufeff")]), [])
    lowered = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _as_glob(uri: str) -> str:
    """A file of ``_metadata`` as a path to read: Spark reports paths percent-encoded and takes them as glob patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def csv_layouts(spark: SparkSession, path: str, pattern: str | None = None) -> dict[tuple[str, ...], list[str]]:
    """The files of every header: {column names: file paths}.

    One pass over the text finds each file's first line (``min_by`` with partial
    aggregation, one row per file); the driver gets a path and a header per
    file, which is what its own file listing holds as well.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_pos"))
    p = _anchored(pattern)
    # splits begin in the order of the blocks of a file, so only block 0 can hold its first line
    first = (lines.filter(F.col("_file").rlike(p)) if p else lines).filter(F.col("_block") == 0)
    found = first.groupBy("_path").agg(F.min_by("value", "_pos").alias("header")).collect()
    layouts: dict[tuple[str, ...], list[str]] = {}
    for r in sorted(found, key=lambda r: r["_path"]):
        names = _csv_names(r["header"])
        if r["header"].count('"') % 2:  # a quoted name goes on in the next line: the reader itself finds its end
            names = spark.read.option("header", True).option("multiLine", True).csv(_as_glob(r["_path"])).columns
        layouts.setdefault(tuple(names), []).append(r["_path"])
    return layouts


def scan_csv(spark: SparkSession, path: str, pattern: str | None = None, schema: T.StructType | None = None,
             multi_line: bool = True) -> DataFrame:
    """SRC-01: comma-separated, header row, BOM stripped, every column text.
    Unquoted empty fields and missing trailing fields are NULL.

    Every file is read by its own header: files of one header are one scan, and
    the scans are united by column name (a column a file lacks is NULL).  A
    given ``schema`` states that all files share that layout, which saves the
    pass over the headers.  ``multi_line=False`` lets large files be split when no
    value holds a line break.
    """
    r = spark.read.option("header", True).option("multiLine", multi_line).option("recursiveFileLookup", True)
    r = r.option("encoding", "UTF-8").option("mode", "PERMISSIVE")
    if schema is not None:
        return _with_lineage(r.schema(schema).csv(path), pattern)
    layouts = csv_layouts(spark, path, pattern)
    if not layouts:
        return _with_lineage(r.csv(path), pattern)
    scans = []
    for names, files in sorted(layouts.items()):
        columns = T.StructType([T.StructField(n, T.StringType()) for n in names])
        paths = [_as_glob(f) for f in files]
        scans.append(_with_lineage(r.schema(columns).csv(paths), None))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    order = [c for c in united.columns if c not in ("_file", "_path", "_pos")]
    return united.select(*[F.col(f"`{c}`") for c in order], "_file", "_path", "_pos")


def scan_json_records(spark: SparkSession, path: str, pattern: str | None = None,
                      schema: T.StructType | None = None) -> DataFrame:
    """SRC-02: each file holds a JSON array; one row per element."""
    r = spark.read.option("multiLine", True).option("recursiveFileLookup", True)
    if schema is not None:
        r = r.schema(schema)
    return _with_lineage(r.json(path), pattern)


def scan_blob(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SRC-03/SRC-05: one row per file: (raw_data, source_file)."""
    df = spark.read.text(path, wholetext=True)
    df = _with_lineage(df, pattern)
    return df.select(F.col("value").alias("raw_data"), F.col("_file").alias("source_file"), "_path")


def scan_json_blob(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SRC-03 with the JSON parsed once into VARIANT (NULL if unparseable)."""
    b = scan_blob(spark, path, pattern)
    return b.withColumn("raw_json", F.try_parse_json("raw_data"))


def scan_xml_records(spark: SparkSession, path: str, row_tag: str, pattern: str | None = None,
                     schema: T.StructType | None = None) -> DataFrame:
    """SRC-04: children of the root are rows, their children are text
    columns; attributes ignored; rows whose fields are all empty dropped."""
    r = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False).option("recursiveFileLookup", True)
    r = r.option("attributePrefix", "_attr_").option("excludeAttribute", True)
    if schema is not None:
        r = r.schema(schema)
    df = _with_lineage(r.load(path), pattern)
    data_cols = [c for c in df.columns if c not in ("_file", "_path", "_pos") and not c.startswith("_attr_")]
    any_value = F.lit(False)
    for c in data_cols:
        any_value = any_value | (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return df.select(*data_cols, "_file", "_path", "_pos").filter(any_value)


def scan_xml_blob(spark: SparkSession, path: str, row_tag: str | None = None, pattern: str | None = None) -> DataFrame:
    """SRC-05: the raw text as one row; ``well_formed`` / ``has_records``
    tell whether it parses (a permissive ``from_xml`` probe, which never
    fails the job) and holds at least one ``row_tag`` record; the load
    keeps it as a blob otherwise."""
    b = scan_blob(spark, path, pattern)

    def probe(fields: str):
        return F.from_xml(F.col("raw_data"), f"struct<{fields}_bad: string>",
                          {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})

    # one text, not a list: the parser copies the list for every record
    b = b.withColumn("_probe", probe(f"`{row_tag}`: string, " if row_tag else ""))
    ok = F.col("_probe._bad").isNull() & F.col("raw_data").isNotNull() & (F.trim("raw_data") != "")
    has = ok
    if row_tag:  # the last record stands there; it may be empty, then all are listed
        listed = F.coalesce(F.size(probe(f"`{row_tag}`: array<string>, ")[row_tag]), F.lit(0)) > 0
        has = ok & F.when(F.col("_probe")[row_tag].isNotNull(), True).otherwise(listed)
    return b.withColumns({"well_formed": ok, "has_records": has}).drop("_probe")


def discover_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SRC-07: files whose name matches (anchored at the start), with size
    and modification time, sorted by name.  The file content is never read
    (the ``content`` column is pruned)."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.select("path", "length", "modificationTime", F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"))
    p = _anchored(pattern)
    if p:
        df = df.filter(F.col("file_name").rlike(p))
    return df.orderBy("file_name")


LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("run_uuid", T.StringType()),
        T.StructField("username", T.StringType()),
        T.StructField("processtype", T.StringType()),
        T.StructField("stepcounter", T.StringType()),
        T.StructField("stepruntime", T.DoubleType()),
    ]
)


def scan_json_logs(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: JSON log lines with optional fields -> typed log rows;
    run_uuid / username default to 'system', processtype to the logger."""
    df = spark.read.schema(LOG_SCHEMA).json(path)
    return df.select(
        F.try_to_timestamp(F.col("timestamp")).cast("timestamp_ntz").alias("timestamp"),
        F.col("level"),
        F.col("message"),
        F.coalesce("run_uuid", F.lit("system")).alias("run_uuid"),
        F.coalesce("username", F.lit("system")).alias("username"),
        F.coalesce("processtype", "logger").alias("processtype"),
        F.col("stepcounter"),
        F.col("stepruntime"),
    )


# ---------------------------------------------------------------- SRC-06
XLSX_SCHEMA = "file_path string, row_number long, record map<string,string>"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _cell_text(c, shared: list[str]) -> str | None:
    t = c.get("t")
    if t == "inlineStr":
        return "".join(x.text or "" for x in c.iter(_NS + "t"))
    v = c.find(_NS + "v")
    if v is None or v.text is None:
        return None
    if t == "s":
        return shared[int(v.text)]
    if t == "b":
        return "True" if v.text == "1" else "False"
    return v.text


def xlsx_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the active sheet of one workbook (stdlib zip + XML only), one after the other: a sheet is never held whole."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.iter(_NS + "si"):
                shared.append("".join(x.text or "" for x in si.iter(_NS + "t")))
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        view = wb.find(f"{_NS}bookViews/{_NS}workbookView")
        active = int(view.get("activeTab", "0")) if view is not None else 0
        sheets = wb.findall(f"{_NS}sheets/{_NS}sheet")
        rid = sheets[active].get(_REL + "id") if sheets else None
        target = "xl/worksheets/sheet1.xml"
        if rid and "xl/_rels/workbook.xml.rels" in names:
            rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
            for r in rels:
                if r.get("Id") == rid:
                    t = r.get("Target").lstrip("/")
                    target = t if t.startswith("xl/") else "xl/" + t
        with z.open(target) as sheet:
            data_node = None
            for event, x in ET.iterparse(sheet, ("start", "end")):
                if event == "start":
                    data_node = x if x.tag == _NS + "sheetData" else data_node
                elif x.tag == _NS + "row":
                    vals: dict[int, str | None] = {}
                    for i, c in enumerate(x.iter(_NS + "c")):
                        vals[_col_index(c.get("r")) if c.get("r") else i] = _cell_text(c, shared)
                    yield [vals.get(i) for i in range(max(vals) + 1 if vals else 0)]
                    if data_node is not None:
                        data_node.clear()  # rows already read


def read_xlsx_bytes(data: bytes) -> list[list[str | None]]:
    """All rows of the active sheet of one workbook."""
    return list(xlsx_rows(data))


XLSX_BATCH_ROWS = 10_000


def _xlsx_records(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = xlsx_rows(bytes(content))
            first = next(rows, None)
            if first is None:
                continue
            header = [(h if h not in (None, "") else f"column_{i}") for i, h in enumerate(first)]
            out_n, out_r = [], []
            for n, r in enumerate(rows, start=1):
                rec = {header[i]: (r[i] if i < len(r) else None) for i in range(len(header))}
                if all(v in (None, "") for v in rec.values()):
                    continue
                out_n.append(n)
                out_r.append(rec)
                if len(out_n) == XLSX_BATCH_ROWS:
                    yield pd.DataFrame({"file_path": path, "row_number": out_n, "record": out_r})
                    out_n, out_r = [], []
            if out_n:
                yield pd.DataFrame({"file_path": path, "row_number": out_n, "record": out_r})


def scan_xlsx(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """SRC-06: active sheet of every workbook, first row = headers (blank ->
    ``column_<i>``); one row per data row with a ``record`` map.  Files are
    read by ``binaryFile`` and decoded in ``mapInPandas`` on the executors,
    one task per group of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    p = _anchored(pattern)
    if p:
        files = files.filter(F.regexp_extract("path", r"([^/]*)$", 1).rlike(p))
    recs = files.select("path", "content").mapInPandas(_xlsx_records, XLSX_SCHEMA)
    return recs.withColumn("file_name", F.regexp_extract("file_path", r"([^/]*)$", 1))


def widen(records: DataFrame, columns: list[str], map_col: str = "record") -> DataFrame:
    """Map records -> one text column per header name."""
    keep = [c for c in records.columns if c != map_col]
    return records.select(*keep, *[F.col(map_col)[c].alias(c) for c in columns])


# ---------------------------------------------------------------- UDF-02
READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": scan_csv,
    "json": scan_json_records,
    "json_blob": scan_json_blob,
    "xml": scan_xml_records,
    "xml_blob": scan_xml_blob,
    "xlsx": scan_xlsx,
}


def register_reader(file_type: str, reader: Callable[..., DataFrame]) -> None:
    """Plug in a reader ``(spark, path, ...) -> DataFrame`` for a file type."""
    READERS[file_type] = reader


def read(spark: SparkSession, file_type: str, path: str, **kw) -> DataFrame:
    try:
        reader = READERS[file_type]
    except KeyError:
        raise ValueError(f"no reader registered for file type {file_type!r}") from None
    return reader(spark, path, **kw)


def with_first_record_value(df: DataFrame, column: str, out: str, file_col: str = "_path", pos_col: str = "_pos") -> DataFrame:
    """PRJ-09/10 "file content" mode: every row gets ``column`` of the first
    record of its file (files are told apart by full path: partitioned
    writers reuse one file name in every folder).  The first record is a per-file ``min_by`` over the
    record position (partial aggregation, one row per file), joined back."""
    firsts = df.groupBy(file_col).agg(F.min_by(F.col(column), F.col(pos_col)).alias(out))
    return df.join(firsts, file_col, "left")


def xlsx_parts() -> tuple[str, str, dict[str, str]]:
    """Begin and end of a minimal workbook's only sheet, and its other parts."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    others = {
        "[Content_Types].xml": (
            '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            '<Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
            "</Types>"
        ),
        "_rels/.rels": (
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
            "</Relationships>"
        ),
        "xl/workbook.xml": (
            f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
            '<sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
        ),
        "xl/_rels/workbook.xml.rels": (
            '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
            "</Relationships>"
        ),
    }
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>', "</sheetData></worksheet>", others


def xlsx_bytes(header: list[str], rows: list[list[object]]) -> bytes:
    """A minimal one-sheet workbook (inline strings) for landing test data."""

    def esc(v: object) -> str:
        return (str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))

    def col(i: int) -> str:
        s = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            s = chr(65 + r) + s
        return s

    xml_rows = []
    for rn, r in enumerate([header, *rows], start=1):
        cells = "".join(
            f'<c r="{col(i)}{rn}" t="inlineStr"><is><t>{esc(v)}</t></is></c>' for i, v in enumerate(r) if v is not None
        )
        xml_rows.append(f'<row r="{rn}">{cells}</row>')
    begin, end, files = xlsx_parts()
    files["xl/worksheets/sheet1.xml"] = begin + "".join(xml_rows) + end
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return buf.getvalue()

