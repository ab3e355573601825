"""Periodic runs of words by a dictionary of basic factors (operator 13).

A run is a stretch of consecutive words with smallest period q (words q
apart are identical) and length >= max(``LEAST``, ``EXPONENT`` * q) that no
neighbouring word extends keeping the period.

* The dictionary names the factors (strings of words) of every power-of-two
  length l, from the names of their halves.  Factors that occur once in their
  text leave it, and so do all longer ones that hold them.
* The successor of a factor is its next occurrence.  Successors at a distance
  of at most 2 l, twice in a row, are an arithmetic progression, whose
  difference is proposed as a period.  A run of period q and ``EXPONENT`` >= 4
  holds three occurrences q apart of the factor at its start whose length is
  the power of two in [q, 2 q), and a factor of at least q words recurs in a
  run at no smaller distance; so q itself is always proposed.
* A proposal is extended to both sides as far as its period lasts; stretches
  found more than once count once, with their smallest period.

Collapsing drops the words that lie behind the first q words of some run.

Edge cases: null and empty texts have no words and no runs; words are
``[^\\x20\\x09-\\x0D]+`` as UTF-8 bytes; runs may overlap; rows that share an id
are separate; an empty table gives no rows; texts of any length are used
whole; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.bpe import cut
from kiln.llm.common import WHITESPACE_CLASS, scramble, utf8, word_hashes

EXPONENT = 4
LEAST = 6
SLICE = 1 << 20

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def proposed(words: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per factor length: positions and differences of successors in arithmetic progression.

    ``words`` names each word within its document, ``doc`` is the document's number.
    """
    n = len(words)
    at, key, width = np.arange(n), words, 1
    while len(at):
        order = np.argsort(key, kind="stable")
        sorted_key, sorted_at = key[order], at[order]
        same = sorted_key[1:] == sorted_key[:-1]
        step = np.zeros(n, np.int64)
        step[sorted_at[:-1][same]] = (sorted_at[1:] - sorted_at[:-1])[same]
        near = at[(step[at] > 0) & (step[at] <= 2 * width)]
        near = near[step[near + step[near]] == step[near]]
        if len(near):
            first = np.ones(len(near), bool)
            first[1:] = (near[1:] != near[:-1] + 1) | (step[near[1:]] != step[near[:-1]])
            yield near[first], step[near[first]]
        # only factors that occur again get a longer one
        again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        name = np.full(n + width, -1, np.int64)
        name[sorted_at[again]] = np.concatenate([[0], np.cumsum(~same)])[again]
        at = np.sort(sorted_at[again])
        at = at[(at + width < n)]
        at = at[(name[at + width] >= 0) & (doc[at + width] == doc[at])]
        key = name[at] * np.int64(n + 1) + name[at + width]
        width *= 2


def _same_for(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning of two views of equal length."""
    done, size = 0, 64
    while done < len(a):
        differ = a[done : done + size] != b[done : done + size]
        if differ.any():
            return done + int(differ.argmax())
        done += len(differ)
        size *= 2
    return done


def runs_of(words: np.ndarray, counts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Document number -> its runs (start, length, period) by start, then period."""
    doc = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    own = scramble(words + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    found: dict[tuple[int, int], int] = {}
    known: dict[int, list[tuple[int, int]]] = {}
    for at, step in proposed(own, doc):
        for i, d in zip(at.tolist(), step.tolist()):
            seen = known.setdefault(d, [])
            k = bisect_right(seen, (i, len(own))) - 1
            if k >= 0 and seen[k][0] <= i < seen[k][1]:
                continue
            begin, end = int(ends[doc[i]] - counts[doc[i]]), int(ends[doc[i]])
            right = i + _same_for(own[i : end - d], own[i + d : end])
            left = i - _same_for(own[begin:i][::-1], own[begin + d : i + d][::-1])
            seen.insert(k + 1, (left, right))
            stretch = (left, right + d)
            if stretch[1] - left >= max(LEAST, EXPONENT * d):
                found[stretch] = min(d, found.get(stretch, d))
    out: dict[int, list[tuple[int, int, int]]] = {}
    for (left, end), d in found.items():
        k = int(doc[left])
        out.setdefault(k, []).append((left - int(ends[k] - counts[k]), end - left, d))
    return {k: sorted(v, key=lambda r: (r[0], r[2])) for k, v in out.items()}


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repetitions of the runs, joined by one space."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (bytes) of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("b"))
    listed = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data in cut(batch.column("b"), SLICE):
                hashes, counts = word_hashes(data)
                runs = runs_of(hashes, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(counts, pa.int64()),
                     pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs.get(k, ())] for k in range(len(data))], listed),
                     pa.array([collapse(b.split(), runs[k]) if k in runs else b" ".join(b.split()) for k, b in enumerate(data)], pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    schema = T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(f"n_words bigint, runs {RUNS}, collapsed binary").fields])
    return slim.mapInArrow(run, schema)


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text with a periodic tail where crc32 of the decimal id is divisible by 10, else itself.

    A null id counts as an empty one.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, f"{WHITESPACE_CLASS}+"), lambda w: w != "")

    def tail(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("bigint")
        return F.array_join(
            F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(ws, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " "
        )

    # one-element transform: the words are split once and used by name
    periodic = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, tail(ws)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, F.get(periodic, F.lit(0))).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and hashes of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    length = -F.col("best.l")
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * length / F.col("best.period")).cast("bigint").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
