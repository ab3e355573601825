"""Scalar helpers: every function maps Columns to a Column expression.

All of them stay inside Spark's JVM expressions (no Python UDF), so they
fuse into whole-stage codegen and run wherever the data is.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- parsing
def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """SCL-01: empty/NULL -> NULL, bad text -> NULL (the row is kept)."""
    c = _c(c)
    return F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit(fmt)).cast("date")


def parse_numeric(c, strip_commas: bool = True, dtype: str = "double") -> Column:
    """SCL-02: numeric text (optionally with thousands commas) -> number."""
    c = _c(c).cast("string")
    if strip_commas:
        c = F.replace(c, F.lit(","), F.lit(""))
    c = F.nullif(F.trim(c), F.lit(""))
    return F.when(~has_java_suffix(c), c.try_cast(dtype))


def has_java_suffix(c: Column) -> Column:
    """Text such as ``12D`` or ``7f``, which a cast would take for a number."""
    return F.rlike(c, F.lit("[0-9.][dDfF]$"))


def safe_float(c, digits: int = 6) -> Column:
    """SCL-03: NaN -> NULL, rounded; returned as DECIMAL(18, digits)."""
    c = _c(c).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c).cast(T.DecimalType(30, 10)).cast(
        T.DecimalType(18, digits)
    )


def safe_int(c) -> Column:
    c = _c(c).cast("double")
    return F.when(F.isnan(c), F.lit(None)).otherwise(c).try_cast("bigint")


def term_days(end, start) -> Column:
    """SCL-04: whole days from start to end."""
    return F.date_diff(_c(end).cast("date"), _c(start).cast("date"))


def duration_seconds(start, end, as_of) -> Column:
    """SCL-05: seconds between start and COALESCE(end, as_of), as DOUBLE."""
    end_ts = F.coalesce(_c(end), F.lit(as_of).cast("timestamp_ntz"))
    return (F.unix_micros(end_ts.cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))) / F.lit(
        1e6
    )


def format_duration(seconds) -> Column:
    """SCL-06: N/A for NULL/negative, '12.3s' under a minute, '2m 30s'
    under an hour, else '1h 15m'."""
    s = _c(seconds).cast("double")
    whole = F.floor(s).cast("bigint")
    return (
        F.when(s.isNull() | (s < 0), F.lit("N/A"))
        .when(s < 60, F.format_string("%.1fs", s))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(s / 60).cast("bigint"), F.pmod(whole, F.lit(60))))
        .otherwise(
            F.format_string(
                "%dh %dm", F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, F.lit(3600.0)) / 60).cast("bigint")
            )
        )
    )


def truncate_text(c, n: int = 50, suffix: str = "...") -> Column:
    """SCL-07: longer than n -> first n-len(suffix) chars + suffix."""
    c = _c(c)
    keep = max(n - len(suffix), 0)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, keep), F.lit(suffix))).otherwise(c)


def yes_no(c, true_text: str = "Yes", false_text: str = "No") -> Column:
    """SCL-08: boolean -> Yes/No, NULL -> N/A."""
    c = _c(c)
    return F.when(c.isNull(), F.lit("N/A")).when(c, F.lit(true_text)).otherwise(F.lit(false_text))


def format_datetime(c, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """SCL-08: timestamp -> text, NULL -> N/A."""
    return F.coalesce(F.date_format(_c(c), fmt), F.lit("N/A"))


def format_cell(c, dtype: T.DataType) -> Column:
    """SCL-09: report cell text chosen by the column's data type."""
    c = _c(c)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(dtype, T.DateType):
        out = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(dtype, T.BooleanType):
        out = F.when(c, F.lit("Yes")).otherwise(F.lit("No"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        out = F.format_number(c.cast(T.DecimalType(38, 10)), 2)
    elif isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = F.format_number(c, 0)
    else:
        out = c.cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(out)


def contains_any(cols, q: str) -> Column:
    """SCL-10: case-insensitive substring match in any of the columns."""
    needle = F.lit(q.lower())
    preds = [F.coalesce(F.lower(_c(c)).contains(needle), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, preds)


def has_element(arr, value) -> Column:
    """SCL-11: ``value = ANY(arr)``."""
    return F.array_contains(_c(arr), value)


def has_prefix(c, prefix: str) -> Column:
    """SCL-12: ``LIKE 'prefix%'``."""
    return _c(c).startswith(prefix)


def first_truthy(*cols) -> Column:
    """PRJ-14: Python's ``a or b``: NULL, empty text, false and a zero of any
    numeric type fall through; the text '0' does not."""

    def falsy_to_null(c):
        c = _c(c)
        zero = c.cast("string").rlike(r"^(false|-?0+(\.0*)?(E[-+]?[0-9]+)?)$")
        return F.when(F.when(F.typeof(c) == "string", c.cast("string") == "").otherwise(zero), F.lit(None)).otherwise(c)

    return F.coalesce(*[falsy_to_null(c) for c in cols])


# ---------------------------------------------------------------- patterns
def validate_regex(pattern: str | None) -> str | None:
    """Return an error message for an empty/invalid pattern, else None.

    Runs on the driver against the (tiny) pattern text only, with the engine
    that will match it (java.util.regex) when a session is there.
    """
    if not pattern:
        return "Pattern is empty"
    session = SparkSession.getActiveSession()
    try:
        if session is None:
            re.compile(pattern)
        else:
            session.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except re.error as e:
        return f"Invalid regex: {e}"
    except IllegalArgumentException as e:
        return f"Invalid regex: {str(e).splitlines()[0]}"
    return None


def java_groups(pattern: str) -> int:
    """Number of groups of a valid Java pattern; of Python's reading of it without a JVM on the driver's side."""
    session = SparkSession.getActiveSession()
    if session is None or not hasattr(session, "_jvm"):
        return re.compile(pattern).groups
    return session._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()


def regex_test(c, pattern: str, n_groups: int | None = None) -> Column:
    """SCL-13: struct(is_valid, matches, match_text, groups, error) per input.

    The one pattern is validated on the driver; an invalid pattern yields a
    constant 'invalid' struct instead of failing the job.
    """
    err = validate_regex(pattern)
    if err is not None:
        return F.struct(
            F.lit(False).alias("is_valid"),
            F.lit(False).alias("matches"),
            F.lit(None).cast("string").alias("match_text"),
            F.array().cast("array<string>").alias("groups"),
            F.lit(err).alias("error"),
        )
    if n_groups is None:
        n_groups = java_groups(pattern)
    c = _c(c)
    p = F.lit(pattern)
    matched = F.coalesce(c.rlike(pattern), F.lit(False))
    groups = F.array(*[F.regexp_extract(c, pattern, i + 1) for i in range(n_groups)]) if n_groups else F.array()
    return F.struct(
        F.lit(True).alias("is_valid"),
        matched.alias("matches"),
        F.when(matched, F.regexp_substr(c, p)).alias("match_text"),
        F.when(matched, groups.cast("array<string>")).otherwise(F.array().cast("array<string>")).alias("groups"),
        F.lit(None).cast("string").alias("error"),
    )


def regex_tests(c, patterns: dict[int, str]) -> Column:
    """SCL-13 for several patterns: an array of struct(pattern_id, result), one per pattern,
    so that a table is read once however many patterns there are."""
    fields = ("is_valid", "matches", "error")
    tests = {k: regex_test(c, p, 0) for k, p in patterns.items()}
    return F.array(*[
        F.struct(F.lit(k).alias("pattern_id"), F.struct(*[r[f].alias(f) for f in fields]).alias("result")) for k, r in tests.items()
    ])


def glob_to_regex(glob: str) -> str:
    """Translate a shell glob into an anchored Java regex (fnmatch rules)."""
    out, i, n = [], 0, len(glob)
    while i < n:
        ch = glob[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and glob[j] == "!":
                j += 1
            if j < n and glob[j] == "]":
                j += 1
            while j < n and glob[j] != "]":
                j += 1
            if j >= n:
                out.append("\\[")
            else:
                body = glob[i:j].replace("\\", "\\\\")
                i = j + 1
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append(f"[{body}]")
        else:
            out.append(re.escape(ch))
    return "(?s)^" + "".join(out) + "$"


def glob_test(c, pattern: str) -> Column:
    """SCL-14: does the file name match the glob?  NULL pattern -> False."""
    if not pattern:
        return F.lit(False)
    return F.coalesce(_c(c).rlike(glob_to_regex(pattern)), F.lit(False))


def attachment_match(c, pattern: str) -> Column:
    """Does a file name fit an attachment rule: a pattern with ``*`` or ``?`` is
    a glob over the whole name; any other is searched as a regex, ignoring case,
    and one that is no valid regex as plain text (NULL name: false)."""
    name = _c(c)
    if "*" in pattern or "?" in pattern:
        hit = name.rlike(glob_to_regex(pattern))
    elif not pattern:
        hit = name.isNotNull()
    elif validate_regex(pattern) is None:
        hit = name.rlike("(?i)" + pattern)
    else:
        hit = F.contains(F.lower(name), F.lit(pattern.lower()))
    return F.coalesce(hit, F.lit(False))


# ---------------------------------------------------------------- text shapes
def date_prefixed_name(ts, name, fmt: str = "yyyyMMdd") -> Column:
    """SCL-16: '<formatted date>_<name>'."""
    return F.concat(F.date_format(_c(ts), fmt), F.lit("_"), _c(name))


def array_literal(arr) -> Column:
    """SCL-17: ARRAY<STRING> -> PostgreSQL array literal text '{"a","b"}'
    (an embedded '"' is doubled)."""
    quoted = F.transform(_c(arr), lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def slug(name, prefix: str | None = None) -> Column:
    """SCL-18: config name minus a source prefix, lower-cased."""
    c = _c(name)
    if prefix:
        c = F.replace(c, F.lit(prefix), F.lit(""))
    return F.lower(c)


def split_trim(c, sep: str = ",") -> Column:
    """SCL-20: 'a, b ,c' -> ['a','b','c'] (empty items dropped)."""
    parts = F.transform(F.split(_c(c), re.escape(sep)), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


SQL_BLOCK_REGEX = r"(?s)\{\{SQL:(.*?)\}\}"


def sql_blocks(c) -> Column:
    """SCL-21: every ``{{SQL:...}}`` body in a template, in order."""
    return F.regexp_extract_all(_c(c), F.lit(SQL_BLOCK_REGEX), 1)


def sanitize_name_expr(c) -> Column:
    """PRJ-01 on names held as data: lower, non-word -> '_', collapse, strip,
    'col_' before a leading digit."""
    s = F.regexp_replace(F.lower(_c(c)), r"(?U)[^\w]", "_")
    s = F.regexp_replace(s, "_+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("col_"), s)).otherwise(s)
