"""Quality rules: gradient-boosted trees over document statistics (operator 4).

Words are ``[^\\x20\\x09-\\x0D]+``.  The statistics are exact counts over the
whole text; a base rule rejects texts of fewer than 20 words or with more than
30 % of their words in repeated 8-word windows.  All others get the verdict of
boosted trees trained on ``labels.quality`` and flattened into numpy node
arrays.  Scores are monotonic in chosen features: more symbols, more repeated
lines or more repeated words never raise a score.

The trees are fitted on all labelled rows: bin edges and threshold are exact
order statistics of all of them, and a level of a tree is one Spark job that
adds up gradients by node, feature and bin where the rows lie.  The sums are
of whole numbers, so that they do not depend on the order or the number of
tasks; only they reach the driver.  A document is kept when its score reaches
the threshold: 0.5, or lower where 0.5 would reject more than
``MAX_GOOD_LOSS`` of the good training documents.

Edge cases: null and empty texts have no words and fail the base rule; texts
of any length are counted whole; equal rows get equal results; without labels
of both classes the base rule alone decides; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.bpe import cut
from kiln.llm.common import WHITESPACE, materialise

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_GOOD_LOSS = 0.002
BINS = 48  # of a feature in training
TASK_ROWS = 50_000  # labelled rows worth a task of their own in a training job

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# more than the contract's counts, for the trees only
EXTRA = ("n_marks", "n_upper", "n_distinct", "n_lines", "n_letters")
FEATURES = ("log_words", "chars_per_word", "symbols", "dup_lines", "repeats", "marks", "upper", "distinct", "line_words", "letters")
# +1: never falls with the feature, -1: never rises, 0: free
MONOTONE = (0, 0, -1, -1, -1, 0, 0, 0, 0, 0)

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_window_words(codes: np.ndarray, lengths: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per document, the words covered by ``width``-word windows found twice or more in it.

    ``codes``: word numbers of all documents one after another; windows are
    compared by a 64-bit hash that includes the document.
    """
    n = len(codes)
    if n < width:
        return np.zeros(len(lengths), np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    h = _scramble(codes.astype(np.uint64) + _MIX)
    span, base = 1, int(_MIX)
    while span < width:  # 1 -> 2 -> 4 -> 8 words
        nxt = h * np.uint64(base)
        nxt[:-span] += h[span:]
        h, span, base = nxt, span * 2, base * base % (1 << 64)
    at = np.flatnonzero(np.arange(n) + width <= ends[doc])
    key = _scramble(h[at] ^ _scramble(doc[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + width, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(lengths))


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """Counts of each text: ``BASE`` and ``EXTRA``."""
    out = {k: np.zeros(len(texts), np.int64) for k in (*BASE, *EXTRA)}
    numbers: dict[bytes, int] = {}
    codes: list[np.ndarray] = []
    used = 0
    for i, text in enumerate(texts):
        data = text.encode()
        words = data.split()
        seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - seen[_SPACE].sum()
        out["n_symbols"][i] = seen[_SYMBOL].sum()
        out["n_marks"][i] = seen[_MARK].sum()
        out["n_upper"][i] = seen[65:91].sum()
        out["n_letters"][i] = seen[65:91].sum() + seen[97:123].sum() + seen[192:].sum()
        out["n_distinct"][i] = len(set(words))
        lines = [x for x in text.split("\n") if x.strip(WHITESPACE)]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        codes.append(np.fromiter(map(numbers.setdefault, words, count(used)), np.int64, len(words)))
        used += len(words)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    out["n_repeat_words"] = repeated_window_words(flat, out["n_words"])
    return out


_SPACE, _SYMBOL, _MARK = (np.array([ord(c) for c in chars]) for chars in (WHITESPACE, SYMBOLS, "!?.,;:"))


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.column_stack([
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / words, s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words, s["n_marks"] / words, s["n_upper"] / chars,
        s["n_distinct"] / np.sqrt(words), np.log1p(s["n_words"] / lines), s["n_letters"] / chars,
    ])


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf points to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


# nodes, roots, open nodes, bias -> whole-number sums of gradient, hessian and rows by open node, feature and bin
Sums = Callable[[np.ndarray, list[int], list[int], float], np.ndarray]
# gradients as whole numbers: a slice of SLICE rows adds up exactly in a double, all slices in 64 bits
UNIT, SLICE = float(1 << 36), 1 << 16


def level_sums(
    binned: np.ndarray, y: np.ndarray, nodes: np.ndarray, roots: list[int], opened: list[int], bias: float, depth: int, width: int,
) -> np.ndarray:
    """The ``Sums`` of some rows; the last root's tree is the one being grown."""
    feature, at_most, left, right = nodes[:, :4].astype(np.int64).T
    slot_of = np.full(len(nodes), -1)
    slot_of[opened] = np.arange(len(opened))
    total = np.zeros((len(opened), binned.shape[1], width, 3), np.int64)
    for start in range(0, len(y), SLICE):
        x = binned[start:start + SLICE]
        raw, row = np.full(len(x), bias), np.arange(len(x))
        for root in roots:
            node = np.full(len(x), root)
            for _ in range(depth):
                node = np.where(x[row, feature[node]] <= at_most[node], left[node], right[node])
            raw += nodes[node, 4]  # 0 in the tree being grown
        inside = np.flatnonzero(slot_of[node] >= 0)
        p = 1 / (1 + np.exp(-raw[inside]))
        g, h = np.rint((p - y[start:start + SLICE][inside]) * UNIT), np.rint(p * (1 - p) * UNIT)
        base = slot_of[node[inside]] * width
        for j in range(x.shape[1]):
            at = base + x[inside, j]
            for k, weights in enumerate((g, h, None)):
                total[:, j, :, k] += np.bincount(at, weights, len(opened) * width).astype(np.int64).reshape(len(opened), width)
    return total


def grow_trees(
    edges: list[np.ndarray], positive: float, sums: Sums, monotone: tuple[int, ...] = MONOTONE, trees: int = 40, depth: int = 3,
    rate: float = 0.3, l2: float = 1.0, least: int = 15,
) -> Trees:
    """Boosted trees for the logistic loss on histograms, level by level.

    ``edges``: the upper ends of each feature's bins but the last; ``positive``:
    the share of the class 1.  A split on a constrained feature must order its
    children's values, and the middle of the two bounds everything grown below
    them.
    """
    rate0 = min(max(positive, 1e-3), 1 - 1e-3)
    bias = float(np.log(rate0 / (1 - rate0)))
    nodes: list[list[float]] = []  # feature, last bin to the left, left, right, value; a leaf points to itself
    roots: list[int] = []
    for _ in range(trees):
        roots.append(len(nodes))
        nodes.append([0, 0, len(nodes), len(nodes), 0.0])
        level = [(roots[-1], -np.inf, np.inf)]
        grown: list[tuple[int, float]] = []
        for deep in range(depth):
            if not level:
                break
            found = sums(np.array(nodes, float), roots, [at for at, _, _ in level], bias)
            below = []
            for (at, low, high), hist in zip(level, found):
                sg, sh, rows = hist[0].sum(axis=0) / np.array([UNIT, UNIT, 1])
                best = (1e-6, 0, 0, 0.0, 0.0, 0.0, 0.0)
                for j in range(len(edges)):
                    to = np.cumsum(hist[j, :len(edges[j]) + 1], axis=0)[:-1]
                    hg, hh, hn = to[:, 0] / UNIT, to[:, 1] / UNIT, to[:, 2]
                    vl = np.clip(-hg / (hh + l2), low, high)
                    vr = np.clip(-(sg - hg) / (sh - hh + l2), low, high)
                    gain = -(hg * vl + 0.5 * (hh + l2) * vl**2) - ((sg - hg) * vr + 0.5 * (sh - hh + l2) * vr**2)
                    v0 = np.clip(-sg / (sh + l2), low, high)
                    gain = gain + (sg * v0 + 0.5 * (sh + l2) * v0**2)
                    ok = (hn >= least) & (rows - hn >= least) & (monotone[j] * (vr - vl) >= 0)
                    if ok.any():
                        c = int(np.argmax(np.where(ok, gain, -np.inf)))
                        if gain[c] > best[0]:
                            best = (float(gain[c]), j, c, float(vl[c]), float(vr[c]), float(hg[c]), float(hh[c]))
                if best[0] <= 1e-6:
                    grown.append((at, rate * float(np.clip(-sg / (sh + l2), low, high))))
                    continue
                _, j, c, vl, vr, gl, hl = best
                mid = (vl + vr) / 2
                bounds = [(low, high), (low, high)]
                if monotone[j] > 0:
                    bounds = [(low, mid), (mid, high)]
                elif monotone[j] < 0:
                    bounds = [(mid, high), (low, mid)]
                for child, (lo, hi), cg, ch in zip((len(nodes), len(nodes) + 1), bounds, (gl, sg - gl), (hl, sh - hl)):
                    nodes.append([0, 0, child, child, 0.0])
                    if deep + 1 < depth:
                        below.append((child, lo, hi))
                    else:
                        grown.append((child, rate * float(np.clip(-cg / (ch + l2), lo, hi))))
                nodes[at][:4] = [j, c, len(nodes) - 2, len(nodes) - 1]
            level = below
        for at, value in grown:
            nodes[at][4] = value
    arr = np.array(nodes, float)
    ends = [edges[int(j)][int(c)] if left != at else np.inf for at, (j, c, left, _, _) in enumerate(nodes)]
    return Trees(
        arr[:, 0].astype(np.int32), np.array(ends), arr[:, 2].astype(np.int32), arr[:, 3].astype(np.int32), arr[:, 4],
        np.array(roots, np.int32), depth, bias,
    )


def into_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])


def fit_trees(
    x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...] = MONOTONE, trees: int = 40, depth: int = 3,
    bins: int = BINS, rate: float = 0.3, l2: float = 1.0, least: int = 15,
) -> Trees:
    """``grow_trees`` on quantile histograms of rows at hand."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = into_bins(x, edges)

    def sums(nodes: np.ndarray, roots: list[int], opened: list[int], bias: float) -> np.ndarray:
        return level_sums(binned, y, nodes, roots, opened, bias, depth, bins)

    return grow_trees(edges, float(y.mean()), sums, monotone, trees, depth, rate, l2, least)


_STAT_TYPES = ", ".join(f"{k} bigint" for k in (*BASE, *EXTRA))


def _stats_frame(docs: DataFrame, extra: list[str], text_col: str) -> DataFrame:
    """The ``extra`` columns and all statistics of every row."""
    slim = docs.select(*extra, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kept = T.StructType([f for f in slim.schema.fields if f.name != "_text"])
    schema = T.StructType([*kept.fields, *(T.StructField(k, T.LongType()) for k in (*BASE, *EXTRA))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in cut(batch.column("_text"), 1 << 20):
                s = statistics(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in extra), *(pa.array(s[k]) for k in (*BASE, *EXTRA))],
                    names=schema.names,
                )

    return slim.mapInArrow(run, schema)


def at_ranks(values: DataFrame, wanted: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """The numbers at the given ranks (0: least) of each ``part`` of ``values`` (part int, value double), exactly.

    Counts of equal numbers are sorted over all tasks; the driver gets each
    task's count of each part and the numbers asked for.
    """
    spark = values.sparkSession
    counts = values.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.repartitionByRange("part", "value").withColumn("at", F.spark_partition_id()), "ranks")
    places, before = [], {}
    for r in sorted(counts.groupBy("part", "at").agg(F.sum("n").alias("n")).collect()):
        start = before.get(r["part"], 0)
        before[r["part"]] = start + r["n"]
        places += [(r["part"], r["at"], k, k - start) for k in set(wanted[r["part"]]) if start <= k < start + r["n"]]
    upto = F.sum("n").over(Window.partitionBy("part", "at").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    asked = spark.createDataFrame(places, "part int, at int, rank long, here long")
    found = counts.withColumn("upto", upto).join(F.broadcast(asked), ["part", "at"])
    found = found.where("here >= upto - n and here < upto")
    return {(r["part"], r["rank"]): r["value"] for r in found.select("part", "rank", "value").collect()}


def quantile_edges(rows: DataFrame, n: int, bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of the columns ``FEATURES`` over all ``n`` rows, between ranks as ``np.quantile`` has them."""
    place = np.linspace(0, 1, bins + 1)[1:-1] * (n - 1)
    low = np.floor(place).astype(int)
    high, t = np.minimum(low + 1, n - 1), place - low
    each = F.array(*[F.struct(F.lit(j).alias("part"), F.col(f).alias("value")) for j, f in enumerate(FEATURES)])
    ranks = np.union1d(low, high).tolist()
    at = at_ranks(rows.select(F.inline(each)), dict.fromkeys(range(len(FEATURES)), ranks))
    edges = []
    for j in range(len(FEATURES)):
        a, b = (np.array([at[j, k] for k in side.tolist()]) for side in (low, high))
        edges.append(np.unique(np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))))
    return edges


def _numbers(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])


def train(stats: DataFrame, labels: DataFrame, id_col: str = "_doc_id") -> Trees | None:
    """Trees from the statistics of all labelled rows; None without rows of both classes."""
    marks = labels.where("quality is not null and doc_id is not null").select(
        F.col("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("_quality"))
    labelled = stats.join(marks, F.col(id_col) == F.col("_label_id")).select("_quality", *BASE, *EXTRA)
    named = T.StructType([T.StructField("y", T.IntegerType()), *(T.StructField(f, T.DoubleType()) for f in FEATURES)])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*BASE, *EXTRA)}
            fine = ~base_failed(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_quality").filter(pa.array(fine)), *(pa.array(c[fine]) for c in features(s).T)], names=named.names)

    rows = materialise(labelled.mapInArrow(passed, named), "quality")
    n, least, most, share, good = rows.agg(F.count("y"), F.min("y"), F.max("y"), F.avg("y"), F.count_if(F.col("y") == 1)).first()
    if n == 0 or least == most:
        return None
    edges = quantile_edges(rows, n)
    small = T.StructType([T.StructField("y", T.IntegerType()), *(T.StructField(f, T.ByteType()) for f in FEATURES)])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = into_bins(_numbers(batch, FEATURES), edges).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(c) for c in x.T)], names=small.names)

    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n // TASK_ROWS)
    low = materialise(rows.repartition(tasks).mapInArrow(binned, small), "quality-bins")
    depth, shape = 3, (-1, len(FEATURES), BINS, 3)

    def sums(nodes: np.ndarray, roots: list[int], opened: list[int], bias: float) -> np.ndarray:
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                y = batch.column("y").to_numpy(zero_copy_only=False)
                part = level_sums(_numbers(batch, FEATURES), y, nodes, roots, opened, bias, depth, BINS)
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        parts = low.mapInArrow(add_up, "sums binary").collect()
        return sum(np.frombuffer(r["sums"], np.int64) for r in parts).reshape(shape)

    trees = grow_trees(edges, float(share), sums, depth=depth)
    if good:
        scores = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("value", T.DoubleType())])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = trees.score(_numbers(batch, FEATURES))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(score), np.int32)), pa.array(score)], names=scores.names)

        rank = int(MAX_GOOD_LOSS * good)
        of_good = rows.where("y = 1").select(*FEATURES).mapInArrow(scored, scores)
        trees.threshold = float(min(0.5, at_ranks(of_good, {0: [rank]})[0, rank]))
    return trees


def judge(s: dict[str, np.ndarray], trees: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score and kept of counted texts."""
    failed = base_failed(s)
    score = np.ones(len(failed)) if trees is None else trees.score(features(s))
    return failed, score, ~failed & (True if trees is None else score >= trees.threshold)


def quality_report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row."""
    stats = materialise(_stats_frame(docs.withColumn("_doc_id", F.col(id_col)), ["_doc_id"], text_col), "quality-stats")
    trees = train(stats, labels)
    id_type = stats.schema["_doc_id"].dataType
    schema = T.StructType([
        T.StructField("doc_id", id_type), *(T.StructField(k, T.LongType()) for k in BASE),
        T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in (*BASE, *EXTRA)}
            failed, score, kept = judge(s, trees)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc_id"), *(batch.column(k) for k in BASE), pa.array(failed), pa.array(score), pa.array(kept)],
                names=schema.names,
            )

    return stats.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; nothing is shuffled."""
    trees = train(_stats_frame(docs.select(F.col(id_col).alias("_doc_id"), text_col), ["_doc_id"], text_col), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in cut(batch.column(text_col), 1 << 20):
                kept = judge(statistics(["" if t is None else t for t in texts]), trees)[2]
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
