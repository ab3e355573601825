"""Audit of how filters interact over all orders, by wide packed counters (operator 12).

Each document has a mask: which of the filters it fails.  For a mask, every
order of the filters and every step in it say whether that step removes the
document; with five filters these are 120 * 5 = 600 outcomes.  They are the fields
of one big integer, and one more field counts documents.  The integers of
a part's documents are summed up, once for all documents, for good and for toxic ones; a
field is ``FIELD`` bits wide and no sum exceeds the number of documents
(below 2^63), so fields never overflow into each other.

Documents are counted by (part, mask, good, toxic) before they meet, so a part
sends at most 128 rows however many documents it has.

Filters (words are ``[^\\x20\\x09-\\x0D]+``, case-sensitive); a document fails
  A under 200 words,
  B if 100 * distinct words < 50 * words,
  C if 100 * ``[A-Z]`` characters > 2 * code points,
  D if it holds any ``[#$%&*|]``,
  E if a document with a smaller id has the identical text.

Edge cases: null text counts as empty (equal to empty texts); a null part is the
part ''; a null id is not larger than any and has no labels; rows that
share an id are separate documents and don't count as copies of each other by id;
labels of a document that occur more than once count if any row says 1; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.bpe import cut
from kiln.llm.common import materialise, skew_join, utf8

FILTERS = "ABCDE"
FIELD = 64
LEAST_WORDS = 200
UPPER = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"
SLICE = 1 << 22


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails by itself."""
    words = text.split()
    chars = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    fails = (
        len(words) < LEAST_WORDS,
        100 * len(set(words)) < 50 * len(words),
        100 * (len(text) - len(text.translate(None, UPPER))) > 2 * chars,
        len(text.translate(None, SYMBOLS)) < len(text),
    )
    return sum(1 << k for k, failed in enumerate(fails) if failed)


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part and mask (bit k: fails filter k) of every row."""
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), utf8(F.col(text_col)).alias("b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data in cut(batch.column("b"), SLICE):
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "part")), pa.array([own_mask(b) for b in data], pa.int32()),
                     pa.array([sha256(b).digest() for b in data], pa.binary())],
                    names=["doc_id", "part", "mask", "sha"],
                )

    schema = T.StructType([*slim.schema.fields[:2], T.StructField("mask", T.IntegerType()), T.StructField("sha", T.BinaryType())])
    rows = materialise(slim.mapInArrow(run, schema), "audit-masks")
    texts = materialise(rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "audit-texts")
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return skew_join(rows, texts, "sha", "n", rows.count()).select(
        "doc_id", "part", F.when(copied, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask")
    )


def class_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, good, toxic and n: documents of each part by mask and labels."""
    marks = labels.select(F.col(id_col).alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # rows without an id have no labels and don't meet in one task; an id that many rows share is counted first
    named = failed.where("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    nameless = failed.where("doc_id is null").select(
        "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), F.lit(1).cast("long").alias("n")
    )
    no = F.lit(False)
    all_ = named.select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n").unionByName(nameless)
    return all_.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def packed_outcomes(filters: str = FILTERS) -> list[int]:
    """For every mask the integer whose fields are the outcomes of all orders' steps, and one document above them."""
    n = len(filters)
    orders = list(permutations(range(n)))
    out = []
    for mask in range(1 << n):
        total = 1 << (FIELD * len(orders) * n)
        for k, order in enumerate(orders):
            step = next((s for s, f in enumerate(order) if mask >> f & 1), None)
            if step is not None:
                total += 1 << (FIELD * (k * n + step))
        out.append(total)
    return out


def unpacked(total: int, orders: int, steps: int) -> tuple[np.ndarray, int]:
    """(orders, steps) counts of a summed integer, and its number of documents."""
    fields = np.frombuffer(total.to_bytes((orders * steps + 1) * FIELD // 8, "little"), "<u8").astype(np.int64)
    return fields[:-1].reshape(orders, steps), int(fields[-1])


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of the step."""
    n = len(filters)
    packed = packed_outcomes(filters)
    orders = list(permutations(range(n)))
    names = ["".join(filters[f] for f in o) for o in orders]
    at = np.array(orders)
    alone = [orders.index(tuple([f] + [g for g in range(n) if g != f])) for f in range(n)]
    last = [orders.index(tuple([g for g in range(n) if g != f] + [f])) for f in range(n)]

    def run(rows: pa.Table) -> pa.Table:
        masks, size = rows["mask"].to_pylist(), rows["n"].to_pylist()
        flags = {"removed": [True] * len(masks), "good_lost": rows["good"].to_pylist(), "toxic_lost": rows["toxic"].to_pylist()}
        sums = {name: sum(packed[m] * k for m, k, use in zip(masks, size, used) if use) for name, used in flags.items()}
        found = {name: unpacked(total, len(orders), n) for name, total in sums.items()}
        removed, documents = found["removed"]
        fails = np.array([removed[alone[f], 0] for f in range(n)])
        unique = np.array([removed[last[f], n - 1] for f in range(n)])
        shapley = np.array([removed[at == f].sum() for f in range(n)])
        values = {
            "kept": documents - np.cumsum(removed, axis=1), "removed": removed, "redundant": fails[at] - removed, "unique_fails": unique[at],
            "good_lost": found["good_lost"][0], "toxic_lost": found["toxic_lost"][0], "shapley": shapley[at],
        }
        return pa.table({
            "part": pa.array(rows["part"].to_pylist()[:1] * (len(orders) * n), pa.string()),
            "filter_order": pa.array([x for x in names for _ in range(n)]),
            "step": pa.array([*range(1, n + 1)] * len(orders), pa.int32()),
            **{c: pa.array(values[c].ravel(), pa.int64()) for c in COUNTS},
        })

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return counts.groupBy("part").applyInArrow(run, schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
    'A': len(ws) < 200,
    'B': 100 * len(list_distinct(ws)) < 50 * len(ws),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c2.x || d2.x || e.x AS filter_order
  FROM x a, x b, x c2, x d2, x e WHERE len(list_distinct([a.x, b.x, c2.x, d2.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
      FROM o, range(1, 6) r(step)),
j AS (
  SELECT part, good, toxic, n, filter_order, step, own, fails[own] AS hit,
         len(list_filter(string_split(before, ''), lambda z: z <> '' AND fails[z])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda z: fails[z])) AS failed
  FROM c, s),
g AS (
  SELECT part, filter_order, step::INT AS step, own,
         sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND hit THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN hit AND failed = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND hit AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND hit AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM j GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM g
"""
