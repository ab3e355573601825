"""Ordered running computations that stay balanced under key skew.

A window ``PARTITION BY key ORDER BY seq`` sends a whole key to one task.
When a key can hold a large share of the rows (a dataset label, a user),
we split the key into ordered chunks of ``seq`` instead:

* inside a (key, chunk) partition the window runs as usual;
* the carry-in from earlier chunks comes from a per-(key, chunk) aggregate
  (partially aggregated, one row per chunk) with a window over chunks, whose
  size is bounded by the number of chunks, not by the number of rows.

The rows shuffle once, by (key, chunk) as one struct column, in which NULL equals
NULL; the carries join them there, and are summed up from the scan itself.

The result equals the single-partition window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chunked(df: DataFrame, keys: list[str], chunk: Column) -> DataFrame:
    """``df`` with ``_at``, the struct of its key and chunk: equal also where a key or the chunk is NULL."""
    return df.withColumn("_at", F.struct(F.struct(*keys).alias("key"), chunk.alias("chunk")))


def earlier_chunks() -> W:
    """The chunks of a key before the current one, over rows with ``_at``."""
    return W.partitionBy("_at.key").orderBy("_at.chunk").rowsBetween(W.unboundedPreceding, -1)


def later_chunks() -> W:
    """The chunks of a key after the current one, the nearest last: a frame that ends at the
    last row is filled anew for every row, one that begins at the first row grows by one."""
    return W.partitionBy("_at.key").orderBy(F.desc("_at.chunk")).rowsBetween(W.unboundedPreceding, -1)


def in_chunk(order: list[str], last: int = 0) -> W:
    return W.partitionBy("_at").orderBy(*order).rowsBetween(W.unboundedPreceding, last)


def after_in_chunk(nth: str) -> W:
    """The rows of a chunk after the current one, the nearest last, by their number in it."""
    return W.partitionBy("_at").orderBy(F.desc(nth)).rowsBetween(W.unboundedPreceding, -1)


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, chunk: Column, out: str) -> DataFrame:
    """``max(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED
    PRECEDING)`` computed per (keys, chunk) plus a carried prefix max."""
    d = chunked(df, keys, chunk).withColumn("_v", value)
    carry = d.groupBy("_at").agg(F.max("_v").alias("_c")).select("_at", F.max("_c").over(earlier_chunks()).alias("_carry"))
    within = d.withColumn("_in", F.max("_v").over(in_chunk(order)))
    return within.join(carry, "_at").withColumn(out, F.greatest("_in", "_carry")).drop("_at", "_v", "_in", "_carry")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, chunk: Column, out: str) -> DataFrame:
    """``sum(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED
    PRECEDING)`` computed per (keys, chunk) plus the sum of the earlier chunks."""
    d = chunked(df, keys, chunk).withColumn("_v", value)
    carry = d.groupBy("_at").agg(F.sum("_v").alias("_c")).select("_at", F.sum("_c").over(earlier_chunks()).alias("_carry"))
    within = d.withColumn("_in", F.sum("_v").over(in_chunk(order)))
    return (
        within.join(carry, "_at")
        .withColumn(out, F.coalesce("_in", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
        .drop("_at", "_v", "_in", "_carry")
    )


def next_match(df: DataFrame, keys: list[str], seq: str, is_match: Column, value: Column, chunk: Column,
               out: str) -> DataFrame:
    """For each row, ``value`` of the next later row (by ``seq``) of the same
    key for which ``is_match`` holds (a LEAD over the matching rows only)."""
    d = chunked(df, keys, chunk).withColumn("_m", F.when(is_match, value))
    first = F.min_by("_m", F.when(is_match, F.col(seq))).alias("_c")
    carry = d.groupBy("_at").agg(first).select("_at", F.last("_c", ignorenulls=True).over(later_chunks()).alias("_carry"))
    within = d.withColumn("_nth", F.row_number().over(in_chunk([seq])))
    within = within.withColumn("_in", F.last("_m", ignorenulls=True).over(after_in_chunk("_nth")))
    return within.join(carry, "_at").withColumn(out, F.coalesce("_in", "_carry")).drop("_at", "_m", "_nth", "_in", "_carry")


def row_number(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str) -> DataFrame:
    """``row_number() OVER (PARTITION BY keys ORDER BY order)`` where rows of
    a key are split into ordered chunks (``chunk`` must be non-decreasing in
    ``order``): numbering inside (keys, chunk) plus the row count of the
    key's earlier chunks."""
    d = chunked(df, keys, chunk)
    carry = d.groupBy("_at").agg(F.count(F.lit(1)).alias("_c")).select(
        "_at", F.coalesce(F.sum("_c").over(earlier_chunks()), F.lit(0)).alias("_carry"))
    within = d.withColumn("_rn", F.row_number().over(W.partitionBy("_at").orderBy(*order)))
    return within.join(carry, "_at").withColumn(out, F.col("_rn") + F.col("_carry")).drop("_at", "_rn", "_carry")
