"""Language identification of mixed-language text (operator 5).

Words are runs of letters and of the marks combined with them (vowel signs, points,
accents), beginning with a letter.  A word's script (by its first letter's code-point
range) narrows the languages to those that use that script in training;
every remaining language gets the word's log-likelihood ratio from letter
trigrams and the whole word (both hashed).  Viterbi over the words, with a
penalty for each switch, labels spans; the document's language is the one with
the most letters and marks, its score that language's share of them.

Training counts are summed by Spark over labelled rows: at most about
``MAX_LABELLED`` documents, shared equally among the languages and chosen by a
hash of doc_id.  The model is a table of ``BUCKETS`` rows a language.

Edge cases: texts that are null or without letters are ``und`` with score 0
and no spans; texts of any length are labelled whole; ties go to the
first language by code point; equal rows get equal results; without labelled
rows every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.bpe import slices
from kiln.llm.common import crc_mod

BUCKETS = 1 << 15
MAX_LABELLED = 20_000
SWITCH_PENALTY = 12.0
MIN_SCRIPT_SHARE = 0.005
UNDETERMINED = "und"

# First code point and name of the script blocks told apart; the rest is "other".
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x1900, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])

_TABLES: list[np.ndarray] = []


def _char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: is it a letter; its lower case where that is one character; is it a combining mark."""
    if not _TABLES:
        points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        lower = [c.lower() for c in points]
        _TABLES.append(np.array([c.isalpha() for c in points]))
        _TABLES.append(np.array([ord(b) if len(b) == 1 else ord(a) for a, b in zip(points, lower)], np.uint32))
        _TABLES.append(np.array([unicodedata.category(c) in ("Mn", "Mc") for c in points]))
    return _TABLES[0], _TABLES[1], _TABLES[2]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


@dataclass
class Words:
    """The words of several texts: their document, character range, script and hashed features."""

    doc: np.ndarray
    start: np.ndarray  # within the document
    length: np.ndarray
    script: np.ndarray
    trigrams: np.ndarray  # bucket of each letter's trigram
    first: np.ndarray  # index of the word's first trigram
    whole: np.ndarray  # bucket of the whole word


def find_words(texts: list[str]) -> Words:
    alpha, lower, mark = _char_tables()
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.frombuffer(("\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = alpha[codes]
    run = np.concatenate([[False], letter | mark[codes], [False]])
    edge = np.flatnonzero(run[1:] != run[:-1])
    begin, end = edge[::2], edge[1::2]
    letters = np.append(np.flatnonzero(letter), len(codes))
    begin = letters[np.searchsorted(letters, begin)]  # marks before the first letter belong to no word
    begin, end = begin[begin < end], end[begin < end]
    step = np.zeros(len(codes) + 1, np.int8)
    step[begin] = 1
    step[end] -= 1
    inside_word = np.cumsum(step[:-1], dtype=np.int8) > 0
    offsets = np.cumsum(lengths) - lengths
    doc = np.searchsorted(offsets, begin, side="right") - 1
    low = np.concatenate([[0], np.where(inside_word, lower[codes], 0), [0]]).astype(np.uint64)
    at = np.flatnonzero(inside_word)  # positions of letters and their marks
    tri = _scramble(low[at] * np.uint64(0x1F123BB5) + low[at + 1] * np.uint64(0x5851F42D4C957F2D) + low[at + 2] * np.uint64(0x14057B7EF767814F))
    length = end - begin
    first = np.cumsum(length) - length
    inside = (np.arange(len(at)) - np.repeat(first, length)).astype(np.uint64)
    part = _scramble(low[at + 1] + (inside + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D))
    whole = np.add.reduceat(part, first) if len(first) else np.zeros(0, np.uint64)
    script = _SCRIPT_OF[np.maximum(np.searchsorted(_STARTS, codes[begin], side="right") - 1, 0)]
    return Words(
        doc, begin - offsets[doc], length, script, (tri % np.uint64(BUCKETS)).astype(np.int64), first,
        (_scramble(whole + np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64),
    )


@dataclass
class LanguageModel:
    languages: list[str]
    trigram: np.ndarray  # (BUCKETS, languages) float32 log-probabilities, centred over the languages
    whole: np.ndarray
    allowed: np.ndarray  # (scripts, languages) bool

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.first):
            return np.zeros((0, len(self.languages)), np.float32)
        e = np.add.reduceat(self.trigram[w.trigrams], w.first) + self.whole[w.whole]
        return np.where(self.allowed[w.script], e, np.float32(-1e4))


def viterbi(emissions: np.ndarray, counts: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best state of every word; ``counts`` words belong to each document.

    All documents move together, one word a step, longest first.
    """
    n, k = emissions.shape
    state = np.zeros(n, np.int16)
    if not n or k == 1:
        return state
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    steps = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(steps), side="left")
    switch = np.zeros((n, k), bool)
    source = np.zeros(n, np.int16)
    score = emissions[starts[: active[0]]].copy()
    for t in range(1, steps):
        a = active[t]
        score = score[:a]
        best = score.argmax(axis=1)
        floor = score[np.arange(a), best] - penalty
        at = starts[:a] + t
        jump = score < floor[:, None]
        switch[at] = jump
        source[at] = best
        score = np.where(jump, floor[:, None], score) + emissions[at]
        score -= score.max(axis=1, keepdims=True)
        if t + 1 == steps or active[t + 1] < a:
            keep = active[t + 1] if t + 1 < steps else 0
            state[at[keep:]] = score[keep:].argmax(axis=1)
    single = sizes == 1
    state[starts[single]] = emissions[starts[single]].argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        at = starts[: active[t]] + t
        now = state[at]
        state[at - 1] = np.where(switch[at, now], source[at], now)
    return state


def label(texts: list[str], model: LanguageModel) -> tuple[list[str], list[float], list[list[dict]]]:
    """Language, score and spans (lang, start, end in characters) of each text."""
    w = find_words(texts)
    counts = np.bincount(w.doc, minlength=len(texts))
    state = viterbi(model.emissions(w), counts)
    k = len(model.languages)
    letters = np.bincount(w.doc * k + state, w.length, minlength=len(texts) * k).reshape(len(texts), k)
    total = letters.sum(axis=1)
    best = letters.argmax(axis=1)
    langs = [model.languages[b] if n else UNDETERMINED for b, n in zip(best, total)]
    score = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)
    spans: list[list[dict]] = [[] for _ in texts]
    if len(state):
        new = np.flatnonzero(np.concatenate([[True], (state[1:] != state[:-1]) | (w.doc[1:] != w.doc[:-1])]))
        last = np.concatenate([new[1:], [len(state)]]) - 1
        for d, s, a, b in zip(w.doc[new], state[new], w.start[new], w.start[last] + w.length[last]):
            spans[d].append({"lang": model.languages[s], "start": int(a), "end": int(b)})
    return langs, score.tolist(), spans


def _counts(rows: DataFrame) -> DataFrame:
    """lang, kind (trigram, whole, script), bucket, n over all given rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("_text").to_pylist(), np.array(batch.column("_lang").to_pylist(), object)
            for lo, hi in slices(texts, 2 << 20):
                w = find_words(texts[lo:hi])
                names, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                word = code[w.doc]
                letter = np.repeat(word, w.length)
                for kind, owner, bucket, size in (
                    (0, letter, w.trigrams, BUCKETS), (1, word, w.whole, BUCKETS), (2, word, w.script, len(SCRIPT_NAMES))
                ):
                    n = np.bincount(owner * size + bucket, minlength=len(names) * size)
                    hit = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[hit // size], pa.string()), pa.array(np.full(len(hit), kind, np.int32)),
                         pa.array((hit % size).astype(np.int32)), pa.array(n[hit].astype(np.int64))],
                        names=["lang", "kind", "bucket", "n"],
                    )

    return rows.mapInArrow(run, "lang string, kind int, bucket int, n bigint").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, most: int = MAX_LABELLED) -> LanguageModel | None:
    """A model from rows of ``docs`` with a language; None without any."""
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    ).where("_lang is not null")
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    steps = 1 << 30
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("_lang") == lang, F.lit(int(min(1.0, most / len(sizes) / n) * steps))).otherwise(share)
    sample = rows.where((F.pmod(F.xxhash64("_id"), F.lit(steps)) < share) & F.col("_text").isNotNull())
    got = _counts(sample).toPandas()
    languages = sorted(sizes)
    index = {l: i for i, l in enumerate(languages)}
    tables = [np.zeros((size, len(languages))) for size in (BUCKETS, BUCKETS, len(SCRIPT_NAMES))]
    for kind in range(3):
        g = got[got["kind"] == kind]
        tables[kind][g["bucket"].to_numpy(), g["lang"].map(index).to_numpy(int)] = g["n"].to_numpy()
    logs = []
    for t in tables[:2]:
        p = np.log((t + 0.5) / (t.sum(axis=0) + 0.5 * BUCKETS))
        logs.append((p - p.mean(axis=1, keepdims=True)).astype(np.float32))
    scripts = tables[2]
    allowed = scripts >= np.maximum(MIN_SCRIPT_SHARE * scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return LanguageModel(languages, logs[0], logs[1], allowed)


def identify(
    docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    most: int = MAX_LABELLED,
) -> DataFrame:
    """doc_id, lang_pred, score and spans of every row of ``docs``; learns from ``training`` only."""
    model = train(training, id_col, text_col, lang_col, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    spans = "array<struct<lang: string, start: bigint, end: bigint>>"
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for lo, hi in slices(texts, 2 << 20):
                part = texts[lo:hi]
                found = label(part, m) if m else ([UNDETERMINED] * len(part), [0.0] * len(part), [[] for _ in part])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(found[0], pa.string()),
                     pa.array(found[1], pa.float64()), pa.array(found[2], span_type)],
                    names=["doc_id", "lang_pred", "score", "spans"],
                )

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, spans {spans}")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id's text modulo 4 is 2."""
    return crc_mod(doc_id, 4) == 2
