"""Exact deduplication by two-pass Bloom filtering (operator 10, native).

Two texts are equal when they are identical after deleting every character
of ``[\\x20\\x09-\\x0D]``.  Of equal texts the row with the most code points
stays, then the one with the smallest doc_id (null last).

* pass 1 hashes every row to ``HASHES`` cells and keeps, as bitmaps, the cells
  that were hit at least twice;
* pass 2 tests each row against the bitmaps: a row with one cell outside
  cannot have a copy and passes straight through; only the others shuffle.

The bitmaps have ``CELLS_PER_ROW`` cells a row up to ``MAX_CELLS``, which
bounds the broadcast at ``HASHES * MAX_CELLS / 8`` bytes (16 MB).  Above that
the filter gets less selective - more rows shuffle, the result is the same.

Groups of more than a thousandth of all rows (at most 1000 can exist) are
joined back by a broadcast, all others by a shuffle, so no key holds more
than a thousandth of a shuffle's rows.

Edge cases: null text counts as empty, and all-blank and empty texts are one
group; an empty table gives no rows; rows repeated with the same doc_id are
separate members of their group and exactly one stays; columns other than
the id and the text are ignored by ``exact_groups`` and passed on untouched
by ``exact_dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import WHITESPACE_CLASS, materialise, packed

HASHES = 2
CELLS_PER_ROW = 16
MIN_CELLS = 1 << 15
MAX_CELLS = 1 << 26
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITESPACE_CLASS}+", "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars (code points) and text_sha256 of every row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
    )


def filter_cells(rows: int) -> int:
    """Cells per hash function: a power of two, bounded by ``MAX_CELLS``."""
    cells = MIN_CELLS
    while cells < min(CELLS_PER_ROW * rows, MAX_CELLS):
        cells *= 2
    return cells


def _cells(sha: Column, cells: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(j)), F.lit(cells)) + F.lit(j * cells + 1) for j in range(HASHES)]


def repeat_filter(slim: DataFrame, cells: int) -> DataFrame:
    """Pass 1: bitmaps (bucket, bits) of the cells hit at least twice."""
    hits = slim.select(F.explode(F.array(*_cells(F.col("text_sha256"), cells))).alias("cell"))
    twice = hits.groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2")
    return twice.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")
    )


def _bit(bits: Column, cell: Column) -> Column:
    pos = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(bits, (pos / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (pos % 8).cast("int")) == 1, F.lit(False))


def flag_possible_repeats(slim: DataFrame, bitmaps: DataFrame, cells: int) -> DataFrame:
    """Pass 2: ``maybe`` is false only where no equal text can exist."""
    out = slim
    maybe = F.lit(True)
    for j, cell in enumerate(_cells(F.col("text_sha256"), cells)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"b{j}"), F.col("bits").alias(f"bits{j}")))
        out = out.withColumn(f"c{j}", cell)
        out = out.join(side, F.bitmap_bucket_number(F.col(f"c{j}")) == F.col(f"b{j}"), "left")
        maybe = maybe & _bit(F.col(f"bits{j}"), F.col(f"c{j}"))
    return out.select(*slim.columns, maybe.alias("maybe"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    slim = materialise(
        fingerprints(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "exact-slim"
    )
    rows = slim.count()
    cells = filter_cells(rows)
    flagged = flag_possible_repeats(slim, repeat_filter(slim, cells), cells)
    flagged = materialise(flagged, "exact-flagged")
    alone = flagged.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256", "n_chars",
    )
    maybe = flagged.where("maybe")
    order = F.struct(
        (-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("rid")
    )
    groups = maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).select(
        "text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid")
    )
    groups = materialise(groups, "exact-groups")
    hot = rows // HOT_SHARE
    large = F.broadcast(groups.where(F.col("group_size") > hot)) if hot >= 100 else None
    if large is None:
        joined = maybe.join(groups, "text_sha256")
    else:
        cold = maybe.join(large.select("text_sha256"), "text_sha256", "left_anti")
        joined = maybe.join(large, "text_sha256").unionByName(
            cold.join(groups.where(F.col("group_size") <= hot), "text_sha256")
        )
    repeated = joined.select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), "text_sha256", "n_chars"
    )
    return alone.unionByName(repeated)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows outside the Bloom filter of the dropped rows pass straight through; the
    others are compared with them by (hash, length, id) - a key that differs
    within a group, so that a large group spreads over all tasks.
    """
    groups = materialise(exact_groups(docs, id_col, text_col), "exact-kept")
    name = F.concat_ws("/", "text_sha256", "n_chars", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    named = groups.where("group_size > 1").select(name.alias("_key"), "kept")
    dropped = materialise(named.where("not kept").select("_key").distinct(), "exact-dropped")
    # a dropped row with the key of the row that stays is the same row again
    again = materialise(dropped.join(named.where("kept"), "_key", "left_semi"), "exact-again")
    keyed = packed(docs, _key=F.concat_ws(
        "/", F.sha2(normalised(F.col(text_col)).cast("binary"), 256), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")),
    ))
    out = without(keyed, "_key", dropped)
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, "_key", "left_semi").dropDuplicates(["_key"]))
    return out.select("row.*")


def without(rows: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` isn't in ``dropped``; only rows that may be in it shuffle."""
    cells, bitmaps = bitmap_of(dropped, key)
    flagged = _flag(rows, key, cells, bitmaps)
    rest = flagged.where("not _maybe").drop("_maybe")
    maybe = flagged.where("_maybe").drop("_maybe")
    return rest.unionByName(maybe.join(dropped.select(key), key, "left_anti").select(*rest.columns))


def bitmap_of(keys: DataFrame, column: str) -> tuple[int, DataFrame]:
    """A Bloom filter (cells, bitmaps) of the values of a column, bounded like the one above."""
    cells = filter_cells(keys.count())
    hits = keys.select(F.explode(F.array(*_cells(F.col(column).cast("string"), cells))).alias("cell")).distinct()
    return cells, hits.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits")
    )


def _flag(rows: DataFrame, column: str, cells: int, bitmaps: DataFrame) -> DataFrame:
    out = rows
    maybe = F.lit(True)
    for j, cell in enumerate(_cells(F.col(column).cast("string"), cells)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"_b{j}"), F.col("bits").alias(f"_bits{j}")))
        out = out.join(side, F.bitmap_bucket_number(cell) == F.col(f"_b{j}"), "left")
        maybe = maybe & _bit(F.col(f"_bits{j}"), cell)
    return out.select(*(F.col(f"`{c}`") for c in rows.columns), maybe.alias("_maybe"))


def flagged(rows: DataFrame, column: str, keys: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: false only where the value is none of ``keys``."""
    return _flag(rows, column, *bitmap_of(keys, column)).withColumnRenamed("_maybe", out)


def in_bitmap(rows: DataFrame, column: str, cells: int, bitmaps: DataFrame) -> DataFrame:
    """The rows whose value may be among the keys (all that are, and a few others)."""
    return _flag(rows, column, cells, bitmaps).where("_maybe").drop("_maybe")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s
  FROM documents),
g AS (
  SELECT s, count(*) AS group_size, first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM n GROUP BY s)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.s AS text_sha256
FROM n JOIN g USING (s)
"""
