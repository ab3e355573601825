"""Mixing sources to target weights by the cube method (operator 7).

Targets: the sources, ordered by code point with null last, get the weights
1, 2, 3, 1, 2, 3, ...; their targets share 100 % of all words by weight, stop
at ``MAX_REPEATS`` times the source's size, and what is cut off is shared
again by weight among the others until no target is above its stop.

A source's ratio target / size is split: each document is taken floor(ratio)
times, and once more with inclusion probability frac(ratio).  That last part
is drawn by the cube method: the fractional probabilities move along the null
space of the balancing constraints (number of documents, number of words), so
both totals stay exact, until they are 0 or 1.  The flight runs in blocks of
about ``BLOCK`` documents chosen by a hash of the row; each block leaves at most
two fractional documents, which meet in the next round's blocks, until one
block per source is left.  Only then is the small landing problem solved, by
the outcome nearest to the word target.

Every choice is driven by hashes of doc_id, source and text, so reruns agree.
Rows equal in all three are told apart by a number, 1 to their count, so that rows of one
id (or of none), however many, spread over all blocks of their source.

Edge cases: null text has size 0; a source of size 0 has target 0 and is
taken 0 times; null is a source of its own; an empty table gives no rows;
repeated rows are separate units; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.common import materialise, utf8
from kiln.llm.exact_dedup import flagged

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEATS = 3.0
BLOCK = 4096
EPS = 1e-9
# Per-source tables (one short row a source, already on the driver) are broadcast up to this many sources.
BROADCAST_SOURCES = 100_000


def per_source(plan: DataFrame, sources: int) -> DataFrame:
    """``plan``, one row a source, to be joined; broadcast up to ``BROADCAST_SOURCES`` sources."""
    return F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan


def word_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, number of words and hash (of id, source and text, null or not) of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), utf8(F.col(text_col)).alias("b"))
    # a hash skips nulls, so they are marked
    h = F.xxhash64("doc_id", F.col("doc_id").isNull(), "source", F.col("source").isNull(), "b")
    slim = slim.withColumn("h", h)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.array([len(x.as_py().split()) for x in batch.column("b")], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), size, batch.column("h")], names=["doc_id", "source", "size", "h"]
            )

    schema = T.StructType([*slim.schema.fields[:2], T.StructField("size", T.LongType()), T.StructField("h", T.LongType())])
    return slim.mapInArrow(count, schema)


def numbered(slim: DataFrame) -> DataFrame:
    """``slim`` (h, no, ...; written) with rows of one ``h`` told apart: their numbers, 1 to their count, join the hash.

    Rows are numbered inside the ranges of ``no`` that one task wrote, behind the earlier ranges' counts, so no task
    gets all rows of a hash.  Rows whose hash can't repeat stay where they are.
    """
    repeated = materialise(slim.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "mix-same")
    if repeated.isEmpty():
        return slim.drop("no")
    told = materialise(flagged(slim.withColumn("range", F.shiftright("no", 33)), "h", repeated, "maybe"), "mix-told")
    maybe = told.where("maybe")
    ranges = maybe.groupBy("h", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("h").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("h", "range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = maybe.withColumn("copy", F.row_number().over(Window.partitionBy("h", "range").orderBy("no")))
    apart = inside.join(ranges, ["h", "range"]).withColumn("h", F.xxhash64("h", F.col("copy") + F.col("before")))
    columns = [c for c in slim.columns if c != "no"]
    return told.where("not maybe").select(columns).unionByName(apart.select(columns))


def share_targets(sizes: list[int], weights: list[float], total: float, max_repeats: float = MAX_REPEATS) -> list[float]:
    """Targets of the sources: ``total`` by weight, stopped at ``max_repeats * size``, the excess reshared."""
    target = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    rest = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if rest * weights[i] / weight > max_repeats * sizes[i]]
        if not over:
            for i in free:
                target[i] = rest * weights[i] / weight
            break
        for i in over:
            target[i] = max_repeats * sizes[i]
        rest -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def flight(size: np.ndarray, prob: np.ndarray, rand: np.ndarray) -> np.ndarray:
    """Cube flight over one block: move ``prob`` in the null space of (1, size).

    Three fractional units at a time have a direction that keeps the number
    and the words of the expected sample; a step along it makes one of them 0
    or 1.  Returns the new probabilities; at most two are still fractional.
    """
    p = prob.astype(float).tolist()
    s = size.astype(float).tolist()
    r = rand.tolist()
    active: list[int] = []
    nxt, n, step = 0, len(p), 0
    while True:
        while len(active) < 3 and nxt < n:
            if EPS < p[nxt] < 1 - EPS:
                active.append(nxt)
            else:
                p[nxt] = float(round(p[nxt]))
            nxt += 1
        if len(active) < 2:
            break
        if len(active) == 3:
            a, b, c = active
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if u[0] == 0 and u[1] == 0:
                u = (1.0, -1.0, 0.0)
        else:
            a, b = active
            if s[a] != s[b]:
                break
            u = (1.0, -1.0)
        up = down = math.inf
        for k, d in zip(active, u):
            if d > 0:
                up, down = min(up, (1 - p[k]) / d), min(down, p[k] / d)
            elif d < 0:
                up, down = min(up, p[k] / -d), min(down, (1 - p[k]) / -d)
        move = up if r[step % n] * (up + down) < down else -down
        step += 1
        for k, d in zip(active, u):
            p[k] += move * d
            if p[k] < EPS:
                p[k] = 0.0
            elif p[k] > 1 - EPS:
                p[k] = 1.0
        active = [k for k in active if 0.0 < p[k] < 1.0]
    return np.array(p)


def land(size: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Round the last (at most two) fractional units to the outcome nearest in words, then in documents."""
    open_ = [i for i, p in enumerate(prob) if EPS < p < 1 - EPS]
    out = np.round(prob) if not open_ else prob.copy()
    if open_:
        words, docs = float((size[open_] * prob[open_]).sum()), float(prob[open_].sum())
        best = min(
            range(1 << len(open_)),
            key=lambda m: (
                abs(sum(float(size[i]) for k, i in enumerate(open_) if m >> k & 1) - words),
                abs(bin(m).count("1") - docs), m,
            ),
        )
        for k, i in enumerate(open_):
            out[i] = float(best >> k & 1)
    return out


def _fly_block(last: bool, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
        # a fresh uniform per unit and round from its hash
        mix = pdf["h"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * 2 + 1)
        mix = (mix ^ (mix >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        rand = (mix >> np.uint64(11)).astype(float) / float(1 << 53)
        size = pdf["size"].to_numpy()
        prob = flight(size, pdf["prob"].to_numpy(), rand)
        pdf["prob"] = land(size, prob) if last else prob
        return pdf

    return run


def cube_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """Balanced 0/1 sample of ``units`` (src, doc_id, size, h, prob, ...), balanced per ``src``.

    Returns the same columns with ``prob`` 0.0 or 1.0.
    """
    done: DataFrame | None = None
    level = 0
    counts = {r["src"]: r["n"] for r in units.groupBy("src").agg(F.count("*").alias("n")).collect()}
    while counts:
        blocks = {s: max(1, math.ceil(n / block)) for s, n in counts.items()}
        last = max(blocks.values()) == 1
        spark = units.sparkSession
        per = spark.createDataFrame(list(blocks.items()), "src int, _blocks int")
        dealt = units.join(per_source(per, len(blocks)), "src").withColumn("_block", F.pmod(F.xxhash64("h", F.lit(level)), F.col("_blocks")))
        schema = dealt.schema
        flown = dealt.groupBy("src", "_block").applyInPandas(_fly_block(last, level), schema).drop("_block", "_blocks")
        flown = materialise(flown, f"cube-{level}")
        settled = flown.where(f"prob < {EPS} or prob > {1 - EPS}")
        done = settled if done is None else done.unionByName(settled)
        units = flown.where(f"prob >= {EPS} and prob <= {1 - EPS}")
        counts = {} if last else {
            r["src"]: r["n"] for r in units.groupBy("src").agg(F.count("*").alias("n")).collect()
        }
        level += 1
    return units if done is None else done


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    max_repeats: float = MAX_REPEATS,
    block: int = BLOCK,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted) and repeats of every row."""
    slim = word_sizes(docs, id_col, text_col, source_col).withColumn("no", F.monotonically_increasing_id())
    slim = materialise(slim, "mix-sizes")
    spark = docs.sparkSession
    # one row per source: the mix's own configuration, not the corpus
    totals = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    target = share_targets(
        [r["size"] for r in totals], [weights[i % len(weights)] for i in range(len(totals))],
        sum(r["size"] for r in totals), max_repeats,
    )
    plan = spark.createDataFrame(
        [
            (i, r["source"], r["size"], t, t / r["size"] if r["size"] else 0.0)
            for i, (r, t) in enumerate(zip(totals, target))
        ],
        T.StructType([
            T.StructField("src", T.IntegerType()), T.StructField("_source", slim.schema["source"].dataType),
            T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
            T.StructField("ratio", T.DoubleType()),
        ]),
    )
    units = numbered(slim).join(per_source(plan, len(totals)), F.col("source").eqNullSafe(F.col("_source"))).select(
        "src", "doc_id", "source", "size", "source_size", "target",
        F.floor(F.col("ratio") + EPS).alias("whole"),
        F.greatest(F.lit(0.0), F.col("ratio") - F.floor(F.col("ratio") + EPS)).alias("prob"),
        "h",
    )
    drawn = cube_sample(units, block)
    repeats = F.col("whole") + F.round("prob").cast("long")
    return drawn.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats")
    )
