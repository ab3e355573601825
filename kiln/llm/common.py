"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import staging_dir

# The white space of every contract: [\x20\x09-\x0D]; ``bytes.split()`` splits on exactly these.
WHITESPACE = " \t\n\x0b\x0c\r"
WHITESPACE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of the written files,
    not a recomputation, and the frame can be used several times.
    """
    spark = df.sparkSession
    path = staging_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with as many ``_`` as no column of ``df`` has that name (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_key(docs: DataFrame, text_col: str = "text") -> Column:
    """A name (sha256) of each row over all its columns, nulls included: rows of one name are the same row again."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    return F.sha2(F.to_json(F.struct(*rest, F.sha2(F.col(text_col).cast("binary"), 256).alias("t"))), 256)


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column ``row`` beside the given ones, so that no column of ``docs`` can clash with a working one."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in columns.items()])


def utf8(text: Column) -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def arrow_rows(
    fn: Callable[..., dict[str, Iterable]], schema: pa.Schema, *columns: str, rows: int = 2000
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Wrap ``fn(*lists) -> {name: values}`` for ``mapInArrow``.

    Batches are cut to ``rows`` rows, so memory follows the slice and not the
    partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                out = fn(*(part.column(c).to_pylist() for c in columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in schema], schema=schema
                )

    return run


def crc_mod(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor`` (null id: text is empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


HOT_SHARE = 1000


def skew_join(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to the one row each key has in ``groups``.

    ``groups[size]`` is the key's number of rows.  Keys with more than a
    thousandth of ``total`` - at most 1000 can exist, which bounds the broadcast -
    are joined without a shuffle, so no task gets more than that share.
    """
    hot = total // HOT_SHARE
    if hot < 100:
        return rows.join(groups.drop(size), key)
    large = groups.where(F.col(size) > hot).drop(size)
    cold = rows.join(F.broadcast(large.select(key)), key, "left_anti")
    return rows.join(F.broadcast(large), key).unionByName(
        cold.join(groups.where(F.col(size) <= hot).drop(size), key)
    )


def scramble(x: np.ndarray) -> np.ndarray:
    """Mix the bits of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (``[^\\x20\\x09-\\x0D]+``) and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    word = np.concatenate([[False], (data != 32) & ((data < 9) | (data > 13))])
    edge = np.flatnonzero(word[1:] != word[:-1])
    begin, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    counts = np.bincount(np.searchsorted(ends, begin, side="right"), minlength=len(texts))
    if not len(begin):
        return np.zeros(0, np.uint64), counts
    length = end - begin
    at = np.flatnonzero(word[1:])
    first = np.cumsum(length) - length
    inside = np.arange(len(at)) - np.repeat(first, length)
    parts = scramble(data[at].astype(np.uint64) + (inside.astype(np.uint64) << np.uint64(8)) + np.uint64(0x9E3779B97F4A7C15))
    return scramble(np.add.reduceat(parts, first)), counts
