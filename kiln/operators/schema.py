"""Projections, type inference and schema evolution (PRJ-*).

Column-name work (sanitising, alignment, strategy checks) is metadata only:
it reads ``df.columns`` / ``df.schema`` on the driver and never touches
data.  Data work (type inference, conversion) is one aggregate or one
projection over the whole frame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.scalars import has_java_suffix

# ---------------------------------------------------------------- PRJ-01
_NON_WORD = re.compile(r"[^\w]")


def sanitize_name(name: str) -> str:
    """lower, non-word -> '_', collapse runs, strip '_', 'col_' before a digit."""
    s = _NON_WORD.sub("_", name.lower())
    s = re.sub(r"_+", "_", s).strip("_")
    if not s:
        raise ValueError(f"column name {name!r} sanitises to an empty name")
    if s[0].isdigit():
        s = "col_" + s
    return s


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Rename every column to its sanitised form; collisions are an error."""
    new = [sanitize_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"columns {seen[n]!r} and {old!r} both sanitise to {n!r}")
        seen[n] = old
    return df.toDF(*new)


# ---------------------------------------------------------------- PRJ-02
BOOL_TOKENS = ("true", "false", "t", "f")
INT_MAX = 2147483647


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: (column_name, inferred_type), from ONE aggregate
    pass over all rows (the reference samples the first records; sampling a
    distributed frame is order-dependent, so we look at everything).

    Ladder per column (NULL and '' are ignored, the rest is trimmed): no
    values -> TEXT; only boolean tokens -> BOOLEAN; any non-integral number
    -> NUMERIC(12,2); any number -> INTEGER, or BIGINT when a plain integer
    exceeds the INT range; otherwise VARCHAR(50/100/255) or TEXT by the
    longest value.
    """
    cols = list(columns or df.columns)
    # stage 1: trimmed text and presence; stage 2: the per-value tests;
    # then one aggregate of plain boolean / numeric columns (each value is
    # parsed once, and no test is re-derived inside the aggregate)
    st1 = df.select(*[x for i, c in enumerate(cols) for x in (
        F.trim(F.col(c).cast("string")).alias(f"s{i}"),
        (F.col(c).isNotNull() & (F.col(c).cast("string") != "")).alias(f"p{i}"))])
    st2 = st1.select(*[x for i in range(len(cols)) for x in (
        F.col(f"p{i}").alias(f"p{i}"),
        (F.col(f"p{i}") & F.lower(f"s{i}").isin(*BOOL_TOKENS)).alias(f"b{i}"),
        F.when(F.col(f"p{i}"), F.length(f"s{i}")).alias(f"l{i}"),
        F.col(f"s{i}").alias(f"s{i}"),
        F.when(F.col(f"p{i}") & ~F.lower(f"s{i}").isin(*BOOL_TOKENS) & ~has_java_suffix(F.col(f"s{i}")),
               F.col(f"s{i}").try_cast("double")).alias(f"v{i}"))])
    aggs = []
    for i in range(len(cols)):
        num = F.col(f"v{i}")
        finite = num.isNotNull() & ~F.isnan(num) & (F.abs(num) != F.lit(float("inf")))
        is_int = finite & (num == F.floor(num))
        aggs += [
            F.bool_or(F.col(f"b{i}")).alias(f"b{i}"),
            F.bool_or(is_int).alias(f"i{i}"),
            F.bool_or(num.isNotNull() & ~is_int).alias(f"f{i}"),
            # a plain integer beyond the INT range (the double is exact up to
            # 2^53 and certainly larger than INT_MAX beyond it)
            # the digit test runs only for the rare values beyond INT range
            F.bool_or(F.when(F.abs(num) > INT_MAX, F.col(f"s{i}").rlike(r"^-?[0-9]+$"))).alias(f"m{i}"),
            F.max(f"l{i}").alias(f"l{i}"),
            F.count_if(F.col(f"p{i}")).alias(f"n{i}"),
        ]
    stats = st2.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        b, n_i, n_f, big = (F.coalesce(F.col(f"{k}{i}"), F.lit(False)) for k in "bifm")
        ln = F.coalesce(F.col(f"l{i}"), F.lit(0))
        typ = (
            F.when(F.col(f"n{i}") == 0, "TEXT")
            .when(b & ~n_i & ~n_f, "BOOLEAN")
            .when(n_f, "NUMERIC(12,2)")
            .when(n_i, F.when(big, "BIGINT").otherwise("INTEGER"))
            .when(ln <= 50, "VARCHAR(50)")
            .when(ln <= 100, "VARCHAR(100)")
            .when(ln <= 255, "VARCHAR(255)")
            .otherwise("TEXT")
        )
        rows.append(F.struct(F.lit(c).alias("column_name"), typ.alias("inferred_type")))
    return stats.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


SQL_TO_SPARK = {
    "BOOLEAN": T.BooleanType(),
    "NUMERIC(12,2)": T.DecimalType(12, 2),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
}


def spark_type(sql_type: str) -> T.DataType:
    return SQL_TO_SPARK.get(sql_type, T.StringType())


# ---------------------------------------------------------------- PRJ-03
def blob_type(c) -> Column:
    """JSON when the text starts with '{'/'[' and parses; XML when it starts
    with an XML declaration and is well formed; else TEXT."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.ltrim(c)
    is_json = (t.startswith("{") | t.startswith("[")) & F.try_parse_json(c).isNotNull()
    probe = F.from_xml(t, "struct<_bad: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    is_xml = t.startswith("<?xml") & probe["_bad"].isNull()
    return F.when(is_json, "JSON").when(is_xml, "XML").otherwise("TEXT")


# ---------------------------------------------------------------- PRJ-04..06
def _diff(source: DataFrame, target: T.StructType):
    tcols = [f.name for f in target.fields]
    extra = [c for c in source.columns if c not in tcols]
    missing = [c for c in tcols if c not in source.columns]
    return tcols, extra, missing


def align_auto_add(source: DataFrame, target: T.StructType) -> tuple[DataFrame, T.StructType]:
    """Strategy 1: unseen source columns are added to the target as text;
    returns (rows aligned to the evolved target, evolved target schema)."""
    tcols, extra, _ = _diff(source, target)
    evolved = T.StructType(list(target.fields) + [T.StructField(c, T.StringType(), True) for c in extra])
    return _align(source, evolved), evolved


def align_ignore_extra(source: DataFrame, target: T.StructType) -> DataFrame:
    """Strategy 2: keep only columns the target has."""
    return _align(source, target)


def align_strict(source: DataFrame, target: T.StructType, require_all: bool = False) -> DataFrame:
    """Strategy 3: fail on source columns the target lacks (and, with
    ``require_all``, on target columns the source lacks)."""
    _, extra, missing = _diff(source, target)
    if extra:
        raise ValueError(f"source has columns not in target: {sorted(extra)}")
    if require_all and missing:
        raise ValueError(f"source lacks target columns: {sorted(missing)}")
    return _align(source, target)


def _align(source: DataFrame, target: T.StructType) -> DataFrame:
    """The target's columns; a value its type can't hold is NULL (see ``unfit``)."""
    cols = []
    for f in target.fields:
        if f.name in source.columns:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return source.select(*cols)


def unfit(source: DataFrame, target: T.StructType) -> Column:
    """The source values ``_align`` turns into NULL, as a map {column: text}; NULL if there are none."""
    pairs = []
    for f in target.fields:
        if f.name in source.columns and source.schema[f.name].dataType != f.dataType:
            c = F.col(f.name)
            pairs.append(F.when(c.isNotNull() & c.try_cast(f.dataType).isNull(),
                                F.struct(F.lit(f.name).alias("key"), c.cast("string").alias("value"))))
    none = F.lit(None).cast("map<string,string>")
    if not pairs:
        return none
    held = F.array_compact(F.array(*pairs))
    return F.when(F.size(held) > 0, F.map_from_entries(held)).otherwise(none)


# ---------------------------------------------------------------- PRJ-07/08
def nested_to_json(df: DataFrame) -> DataFrame:
    """Every struct/array/map column becomes JSON text."""
    complex_types = (T.StructType, T.ArrayType, T.MapType)
    return df.select(
        *[
            F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, complex_types) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def add_audit(df: DataFrame, user: str, ts: str, with_modified: bool = False) -> DataFrame:
    cols = {"created_date": F.lit(ts).cast("timestamp_ntz"), "created_by": F.lit(user)}
    if with_modified:
        cols.update({"modified_date": F.lit(ts).cast("timestamp_ntz"), "modified_by": F.lit(user)})
    return df.withColumns(cols)


# ---------------------------------------------------------------- PRJ-09/10
def file_stem(path_col) -> Column:
    """File name without directories and without the last extension."""
    name = F.regexp_extract(path_col, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"\.[^.]*$", "")


def label_from_name(name_col, index: int, delimiter: str = "_") -> Column:
    """n-th token of the stem; out of range -> the whole stem."""
    stem = file_stem(name_col)
    tok = F.try_element_at(F.split(stem, re.escape(delimiter)), F.lit(index + 1))
    return F.coalesce(F.nullif(tok, F.lit("")), stem) if index >= 0 else stem


def java_pattern(fmt: str) -> str:
    """Quote a bare 'T' between date and time fields (yyyyMMddTHHmmss)."""
    return re.sub(r"(?<=[dMy])T(?=[Hh])", "'T'", fmt)


def date_from_text(text_col, fmt: str, default: str) -> Column:
    """Parse with a Java-style pattern; failure -> the explicit default."""
    ts = F.try_to_timestamp(text_col, F.lit(java_pattern(fmt)))
    return F.coalesce(ts.cast("date"), F.lit(default).cast("date"))


def date_from_name(name_col, index: int, fmt: str, default: str, delimiter: str = "_") -> Column:
    stem = file_stem(name_col)
    tok = F.try_element_at(F.split(stem, re.escape(delimiter)), F.lit(index + 1))
    return date_from_text(tok, fmt, default)


def first_record_per_file(df: DataFrame, file_col: str = "_file", order_cols: Sequence[str] = ("_pos",)) -> DataFrame:
    """The first record of every file: ``min_by`` over the file's rows keyed
    by position (partial aggregation, one row per file)."""
    rec = F.struct(*[F.col(c) for c in df.columns if c != file_col])
    return df.groupBy(file_col).agg(F.min_by(rec, F.struct(*[F.col(c) for c in order_cols])).alias("first")).select(
        file_col, "first.*"
    )


# ---------------------------------------------------------------- PRJ-11..16
def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def convert(df: DataFrame, type_map: Mapping[str, str | Callable[[Column], Column]]) -> DataFrame:
    """Convert columns; a value that fails keeps its original text in
    ``<c>__raw`` (a column cannot mix types)."""
    out = df
    for c, t in type_map.items():
        if c not in df.columns:
            continue
        conv = t(F.col(c)) if callable(t) else F.col(c).try_cast(t)
        out = out.withColumns(
            {
                f"{c}__raw": F.when(F.col(c).isNotNull() & conv.isNull(), F.col(c).cast("string")),
                c: conv,
            }
        )
    return out


def filter_records(df: DataFrame, predicate: Column | None) -> DataFrame:
    return df if predicate is None else df.filter(predicate)


def optional_filters(df: DataFrame, **preds: Column | None) -> DataFrame:
    """Apply only the predicates that were given (None = no predicate)."""
    given = [p for p in preds.values() if p is not None]
    return df if not given else df.filter(reduce(lambda a, b: a & b, given))


def patch(target: DataFrame, changes: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Partial update: a non-NULL change overwrites, NULL keeps the target.

    Several changes of one key apply one after another by ``order``, so each column
    takes its last value that isn't NULL; without an order they fail the job, as the
    result would depend on chance.
    """
    cols = [c for c in changes.columns if c not in (key, order)]
    if order is not None:
        ch = changes.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_new_{c}") for c in cols])
    else:
        ch = changes.groupBy(key).agg(F.count("*").alias("_n"), *[F.max(c).alias(f"_new_{c}") for c in cols])
        several = F.raise_error(F.concat(F.lit("several changes of key "), F.col(key).cast("string")))
        ch = ch.select(key, *[F.when(F.col("_n") > 1, several).otherwise(F.col(f"_new_{c}")).cast(changes.schema[c].dataType).alias(f"_new_{c}") for c in cols])
    j = target.join(ch, key, "left")
    return j.select(*[
        F.coalesce(F.col(f"_new_{c}").cast(target.schema[c].dataType), F.col(c)).alias(c) if c in cols else F.col(c)
        for c in target.columns
    ])
