"""Data-quality audits (DQ-*): the constraints a database would enforce,
re-run as Spark jobs that return violation rows (empty = clean)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DQ-01: key values held by more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """DQ-02: child rows whose key has no parent (NULL keys are not checked)."""
    p = parent.select(F.col(parent_key).alias("_pk")).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(p, F.col(child_key) == F.col("_pk"), "left_anti")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """DQ-03: NULL count per column in ONE aggregate pass, then unpivoted to
    (column_name, null_count) rows."""
    cols = list(columns or df.columns)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return agg.unpivot([], cols, "column_name", "null_count")


def overflow_violations(df: DataFrame, key: str, lengths: Mapping[str, int] = {}, decimals: Mapping[str, tuple[int, int]] = {}
                        ) -> DataFrame:
    """DQ-04: values longer than VARCHAR(n) or not fitting NUMERIC(p, s)
    (each check is the condition a valid value satisfies)."""
    checks = []
    for c, n in lengths.items():
        checks.append((f"{c} > VARCHAR({n})", F.length(F.col(c)) <= n))
    for c, (p, s) in decimals.items():
        checks.append((f"{c} > NUMERIC({p},{s})", F.col(c).isNull() | F.col(c).try_cast(f"decimal({p},{s})").isNotNull()))
    return rule_violations(df, key, dict(checks))


def rule_violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """DQ-05: (rule_id, key) for every row that breaks a rule.  All rules
    are evaluated in one scan; a NULL predicate counts as not violated."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(~p, F.lit(False)), F.lit(r)) for r, p in rules.items()]))
    return df.select(F.explode(hits).alias("rule_id"), F.col(key))


def reconcile(expected: DataFrame, actual: DataFrame, key: str, expected_col: str = "expected",
              actual_col: str = "loaded") -> DataFrame:
    """DQ-06: expected vs loaded counts -> passed / failed with
    RECORD_COUNT_MISMATCH / error when nothing was loaded at all."""
    j = expected.join(actual, key, "left")
    return j.withColumns(
        {
            "result": F.when(F.col(actual_col).isNull(), "error")
            .when(F.col(actual_col) == F.col(expected_col), "passed")
            .otherwise("failed"),
            "error_code": F.when(F.col(actual_col).isNull(), "NOT_LOADED")
            .when(F.col(actual_col) != F.col(expected_col), "RECORD_COUNT_MISMATCH"),
        }
    )


def retention_violations(inserted: DataFrame, stored: DataFrame, key: str, audit_cols: Sequence[str]) -> DataFrame:
    """DQ-07: inserted keys that are missing from storage, or stored with an
    empty audit column (all audit columns checked in one scan)."""
    k = inserted.select(key).distinct()
    missing = k.join(stored.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    probs = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in audit_cols]))
    bad = stored.select(key, F.explode(probs).alias("problem")).join(k, key, "left_semi")
    return missing.unionByName(bad)
