"""Removal of repeated byte strings by a depth-limited radix sort of suffixes (operator 1).

A string of ``LENGTH`` bytes is repeated where it also starts earlier: in a
document with a smaller id, or earlier in the same document.  Every byte of a repeated string
goes.  Suffixes are ordered only as deep as ``LENGTH`` bytes, by passes over
digits, most significant first; a group that shrinks to one suffix leaves
the sort, and the groups equal at full depth are exactly the repeated strings.

The first digits are taken where they save most work.

* Digit 1: the ``GRAM``-byte string with the least hash inside the suffix's first
  ``LENGTH`` bytes.  Equal suffixes share it, and neighbouring suffixes mostly
  have the same one, so one row (a run) stands for some forty suffixes.
* Digit 2: the run's whole range of bytes.  Runs equal in it repeat the first
  of them entirely.
* A first digit that is left with one range is done.  Of the others the bytes are
  fetched and their suffixes are ordered by digits of eight bytes.

Rows of one digit are summed up before they shuffle: a task sends a digit
once, however often its documents hold it; a first digit with more than
``HOT_RUNS`` ranges is ordered by Spark, suffix by suffix, with partial minima.

Edge cases: null and empty texts have no bytes; texts below ``LENGTH`` bytes lose
nothing; texts of any length are read in pieces; an empty table gives no rows;
rows that share a doc_id are ordered by a hash of their text, rows equal
in both are one document and get the same result; null ids come last; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.common import materialise, scramble, skew_join, utf8

LENGTH = 100
GRAM = 24
PIECE = 1 << 20
LOCAL_RUNS = 1_000_000
BUCKET_RUNS = 20_000
HOT_RUNS = 50_000

_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_BYTES = scramble(np.arange(1, 257, dtype=np.uint64))
_LOW = np.uint64((1 << 24) - 1)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _longer(h: np.ndarray, n: int, other: np.ndarray, m: int) -> np.ndarray:
    """Hashes of n + m bytes at every position from those of n and of m bytes."""
    out = h * _power(m)
    out[: len(h) - n] += other[n:]
    return out


def string_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``GRAM`` and of the 64 bytes at every position (past the end: of what is there)."""
    by = {1: _BYTES[data]}
    for n in (1, 2, 4, 8, 16, 32):
        by[2 * n] = _longer(by[n], n, by[n], n)
    return scramble(_longer(by[16], 16, by[8], 8)), by[64]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[:n], behind[width - 1 : n + width - 1])


def runs_of(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of suffixes with one first digit: piece, start, m (suffixes), gram and hull (the digits)."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    empty = {k: np.zeros(0, np.int64) for k in ("piece", "start", "m")} | {k: np.zeros(0, np.uint64) for k in ("gram", "hull")}
    if len(data) < length:
        return empty
    grams, wide = string_hashes(data)
    order = (grams & ~_LOW) | np.arange(len(data), dtype=np.uint64)
    least = (_least(order, length - gram + 1) & _LOW).astype(np.int64)
    at = np.flatnonzero(np.repeat(ends, sizes) - np.arange(len(data)) >= length)
    if not len(at):
        return empty
    anchor = least[at]
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    begin = at[new]
    m = np.diff(np.append(new, len(at)))
    span = m + length - 1
    hull = scramble(wide[begin] + scramble(wide[begin + (span - 64) // 2]) * np.uint64(3))
    hull = scramble(hull + wide[begin + span - 64] * np.uint64(5) + span.astype(np.uint64))
    piece = np.searchsorted(ends, begin, side="right")
    return {"piece": piece, "start": begin - (ends - sizes)[piece], "m": m, "gram": grams[anchor[new]], "hull": hull}


RUN, MORE, REPEATED = 0, 1, 2
_RUNS = "kind int, part bigint, many boolean, gram bigint, hull bigint, doc bigint, start int, m int"


def summed_up(doc: np.ndarray, start: np.ndarray, m: np.ndarray, gram: np.ndarray, hull: np.ndarray) -> pa.RecordBatch:
    """One task's runs: of equal ones only the first goes on, and one row a first digit as ``RUN``."""
    o = np.lexsort((start, doc, hull, gram))
    doc, start, m, gram, hull = (x[o] for x in (doc, start, m, gram, hull))
    same_gram = np.concatenate([[False], gram[1:] == gram[:-1]])
    same = same_gram & np.concatenate([[False], hull[1:] == hull[:-1]])
    distinct = ~same
    group = np.cumsum(~same_gram) - 1
    many = np.bincount(group[distinct], minlength=(group[-1] + 1) if len(group) else 0)[group] > 1
    kind = np.where(same, REPEATED, np.where(same_gram, MORE, RUN)).astype(np.int32)
    part = np.where(kind == RUN, gram, scramble(gram + hull + doc.astype(np.uint64) * np.uint64(7) + start.astype(np.uint64)))
    gram, hull = (np.where(kind == REPEATED, np.uint64(0), x) for x in (gram, hull))
    back = np.lexsort((start, doc))  # neighbours in a document compress best
    cols = (kind, part.view(np.int64), many, gram.view(np.int64), hull.view(np.int64), doc, start.astype(np.int32), m.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(c[back]) for c in cols], names=["kind", "part", "many", "gram", "hull", "doc", "start", "m"]
    )


def _cut(doc: int, text: bytes, length: int) -> Iterator[tuple[int, int, bytes]]:
    for at in range(0, max(len(text) - length + 1, 1), PIECE):
        yield doc, at, text[at : at + PIECE + length - 1]


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def found(pieces: list[tuple[int, int, bytes]]) -> None:
            nonlocal size
            r = runs_of([p[2] for p in pieces], length, gram)
            owner, at = (np.array([p[k] for p in pieces], np.int64) for k in (0, 1))
            held.append((owner[r["piece"]], r["start"] + at[r["piece"]], r["m"], r["gram"], r["hull"]))
            size += len(r["m"])

        for batch in batches:
            pieces: list[tuple[int, int, bytes]] = []
            used = 0
            for doc, text in zip(batch.column("doc"), batch.column("b")):
                for piece in _cut(doc.as_py(), text.as_py(), length):
                    pieces.append(piece)
                    used += len(piece[2])
                    if used >= PIECE:
                        found(pieces)
                        pieces, used = [], 0
            if pieces:
                found(pieces)
            if size >= LOCAL_RUNS:
                yield summed_up(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        if size:
            yield summed_up(*(np.concatenate(c) for c in zip(*held)))

    return docs.mapInArrow(run, _RUNS)


def radix_groups(data: np.ndarray, starts: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over the suffixes of ``data`` at ``starts``.

    Suffixes begin in their ``group``; each pass orders those still together by
    the next (up to) eight bytes and drops the ones left alone.  Returns the
    suffixes (as indices) in groups equal through ``depth`` bytes, and their groups.
    """
    alive = np.arange(len(starts))
    group = group.copy()
    for at in range(0, depth, 8):
        width = min(8, depth - at)
        key = np.zeros(len(alive), np.uint64)
        for k in range(width):
            key = key << np.uint64(8) | data[starts[alive] + at + k]
        o = np.lexsort((key, group))
        alive, key, group = alive[o], key[o], group[o]
        new = np.ones(len(alive), bool)
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        keep = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        alive, group = alive[keep], group[keep]
        if not len(alive):
            break
    return alive, group


def repeated_ranges(
    gram: np.ndarray, doc: np.ndarray, start: np.ndarray, m: np.ndarray, spans: list[bytes], length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, m of the runs of suffixes that occur earlier among the given ones."""
    data = np.frombuffer(b"".join(spans), np.uint8)
    size = np.array([len(s) for s in spans], np.int64)
    owner = np.repeat(np.arange(len(spans)), m)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
    first = np.unique(gram, return_inverse=True)[1][owner]
    alive, group = radix_groups(data, (np.cumsum(size) - size)[owner] + inside, first, length)
    d, s = doc[owner[alive]], start[owner[alive]] + inside[alive]
    o = np.lexsort((s, d, group))
    later = np.ones(len(o), bool)
    g = group[o]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(g)))
    # the first of a group stays; rows at the very same place are the same suffix
    lead = np.repeat(new, count)
    later = (d[o] != d[o][lead]) | (s[o] != s[o][lead])
    d, s = d[o][later], s[o][later]
    o = np.lexsort((s, d))
    d, s = d[o], s[o]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(d)) - 1
    return d[at], s[at], (s[last] - s[at] + 1) if len(d) else s[at]


_RANGE = "doc bigint, start int, m int"


def _order_in_tasks(spans: DataFrame, buckets: int, length: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        gram, doc, start, m = (table[c].to_numpy().astype(np.int64) for c in ("gram", "doc", "start", "m"))
        d, s, n = repeated_ranges(gram, doc, start, m, table["span"].to_pylist(), length)
        return pa.table({"doc": pa.array(d, pa.int64()), "start": pa.array(s, pa.int32()), "m": pa.array(n, pa.int32())})

    return spans.groupBy(F.pmod(F.xxhash64("gram"), F.lit(buckets))).applyInArrow(run, _RANGE)


def _order_in_spark(spans: DataFrame, length: int) -> DataFrame:
    """The same for first digits with very many ranges: one row a suffix, minima summed up before the shuffle."""
    each = spans.select(
        "gram", "doc", F.posexplode(F.sequence(F.lit(1), F.col("m"))).alias("inside", "at"), "start", "span"
    ).select(
        F.sha2(F.substring("span", F.col("at"), F.lit(length)), 256).alias("suffix"), "doc",
        (F.col("start") + F.col("inside")).cast("int").alias("start"),
    )
    each = materialise(each, "suffix-hot")
    least = each.groupBy("suffix").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("n")).where("n > 1")
    found = skew_join(each, least, "suffix", "n", each.count())
    return found.where(F.struct("doc", "start") > F.col("least")).select("doc", "start", F.lit(1).alias("m"))


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            data = [x.as_py() for x in batch.column("b")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array([len(x) for x in data], pa.int64()),
                 pa.array([codec.compress(x, asbytes=True) for x in data], pa.binary())], names=["doc", "size", "packed"],
            )

    return docs.mapInArrow(run, "doc bigint, size bigint, packed binary")


def _unpack(packed: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, size, asbytes=True) if size else b""


def _spans(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The bytes of each run: gram, doc, start, m, hot, span."""
    per_doc = runs.groupBy("doc").agg(F.collect_list(F.struct("gram", "start", "m", "hot")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                doc, size, packed = (row.column(c)[0].as_py() for c in ("doc", "size", "packed"))
                text = _unpack(packed, size)
                fields = row.column("runs").flatten()
                start, m = (fields.field(c).to_numpy() for c in ("start", "m"))
                yield pa.RecordBatch.from_arrays(
                    [fields.field("gram"), pa.array(np.full(len(start), doc, np.int64)), fields.field("start"), fields.field("m"),
                     fields.field("hot"),
                     pa.array([text[a : a + k + length - 1] for a, k in zip(start.tolist(), m.tolist())], pa.binary())],
                    names=["gram", "doc", "start", "m", "hot", "span"],
                )

    return texts.join(per_doc, "doc").mapInArrow(run, "gram bigint, doc bigint, start int, m int, hot boolean, span binary")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, b) with a unique long per document in id order; and its (doc, doc_id, h) where that isn't the id itself."""
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("b"))
    if isinstance(slim.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        twice = slim.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
        if twice.isEmpty():
            return slim.select(F.col("doc_id").cast("long").alias("doc"), "b"), None
    keyed = slim.withColumn("h", F.xxhash64("b"))
    ids = keyed.select("doc_id", "h").distinct().orderBy(F.col("doc_id").asc_nulls_last(), "h")
    ids = materialise(ids.withColumn("doc", F.monotonically_increasing_id()), "suffix-ids")
    texts = keyed.dropDuplicates(["doc_id", "h"])
    found = texts.join(ids.withColumnRenamed("doc_id", "_id"), (texts["h"] == ids["h"]) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.select("doc", "b"), ids


def repeated_strings(texts: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_runs: int = HOT_RUNS) -> DataFrame:
    """doc, start, m: runs of m suffixes from ``start`` on whose first ``length`` bytes occur earlier."""
    by_digit = Window.partitionBy("part", "kind")
    first = _runs(texts, length, gram).withColumn("n", F.count("*").over(by_digit))
    first = materialise(
        first.where((F.col("kind") != RUN) | (F.col("n") > 1) | F.col("many")).drop("part", "many", "n"), "suffix-runs"
    )
    by_hull = Window.partitionBy("gram", "hull").orderBy("doc", "start")
    second = materialise(
        first.where(F.col("kind") != REPEATED).withColumn("first", F.row_number().over(by_hull) == 1)
        .select("gram", "doc", "start", "m", "first"), "suffix-hulls",
    )
    heads = second.where("first").drop("first")
    total = heads.count()
    several = heads.groupBy("gram").agg(F.count("*").alias("ranges")).where("ranges > 1")
    open_ = materialise(
        skew_join(heads, several.withColumn("hot", F.col("ranges") > hot_runs), "gram", "ranges", total), "suffix-open"
    )
    spans = materialise(_spans(packed, open_, length), "suffix-spans")
    buckets = max(1, spans.count() // BUCKET_RUNS)
    third = _order_in_tasks(spans.where("not hot"), buckets, length)
    if not spans.where("hot").isEmpty():
        third = third.unionByName(_order_in_spark(spans.where("hot"), length))
    found = first.where(F.col("kind") == REPEATED).select("doc", "start", "m")
    return found.unionByName(second.where("not first").select("doc", "start", "m")).unionByName(third)


def merge_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching byte ranges as maximal ones."""
    if not len(start):
        return start, end
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.append(np.flatnonzero(new)[1:], len(start)) - 1]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    hot_runs: int = HOT_RUNS,
) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the removed byte ranges) and kept (the other bytes) of every row."""
    texts, ids = _numbered(docs, id_col, text_col)
    if ids is not None:
        texts = materialise(texts, "suffix-texts")
    found = repeated_strings(texts, _packed(texts), length, gram, hot_runs)
    per_doc = found.groupBy("doc").agg(F.collect_list(F.struct("start", "m")).alias("found"))
    schema = "doc bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans, kept = [], []
                for row, size, packed in zip(part.column("found"), part.column("size").to_pylist(), part.column("packed")):
                    text = _unpack(packed.as_py(), size)
                    starts, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if row.is_valid:
                        starts = row.values.field("start").to_numpy().astype(np.int64)
                        starts, ends = merge_ranges(starts, starts + row.values.field("m").to_numpy() + length - 1)
                    spans.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
                    edges = [0, *(x for pair in zip(starts.tolist(), ends.tolist()) for x in pair), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("size"), pa.array(spans, span_type), pa.array(kept, pa.binary())],
                    names=["doc", "n_bytes", "spans", "kept"],
                )

    out = _packed(texts).join(per_doc, "doc", "left").mapInArrow(run, schema)
    if ids is None:
        return out.withColumnRenamed("doc", "doc_id").withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(utf8(F.col(text_col))).alias("h"))
    named = out.join(ids.withColumnRenamed("doc_id", "_id").withColumnRenamed("h", "_h"), "doc")
    return rows.join(named, (F.col("h") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select(
        "doc_id", "n_bytes", "spans", "kept"
    )


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
