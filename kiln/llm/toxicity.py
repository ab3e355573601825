"""Toxicity by a subsequence string kernel and Nystroem landmarks (operator 6).

Two strings are as similar as the gap-weighted subsequences of ``ORDER``
characters they share, so ``id-iot`` and ``idxiot`` stay near ``idiot``.  Similarities
below ``MIN_SIMILAR`` of a landmark's own, and to tokens that lack one of its
characters, count as none.  The kernel is evaluated against a few landmark
strings only, over every token as it stands and over its letters alone (``i-d-i-o-t``,
``cl***own``), and over the letters of neighbouring tokens of a sentence that
spell a part of a landmark together (``id iot``).  Whitening by the landmarks' own kernel matrix gives the
Nystroem features of a token.  A sentence scores as its most toxic token under a
linear support vector machine, a document as its worst sentence.

Training: sentences inherit their document's label; of a toxic document the
tokens that the machine finds most toxic count (multiple-instance rounds), of
the others all.  At most ``MAX_LABELLED`` rows of each class are used, those with
the smallest hashes of doc_id.  Landmarks are character n-grams (``^`` and ``$``
mark a token's start and end) that occur more in toxic than in other training
documents, picked greedily so that every toxic document is covered, and more
than once; and the near tokens most common in other documents.

Tokens are runs of other than white space, lower-cased; runs of single
characters are read as one token; tokens of more than ``WINDOW`` characters are
covered by overlapping windows.

Edge cases: null and empty texts get the score of a sentence without any
similarity; texts of any length are scored whole; equal rows get equal
results; without toxic training rows every score is the share of toxic
labels (0 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.bpe import slices
from kiln.llm.common import crc_mod

ORDER = 4
DECAY = 0.7
WINDOW = 24
GRAMS = (5, 6, 7)
LANDMARKS = 64
COUNTER_LANDMARKS = 32
CANDIDATES = 4000
MAX_LABELLED = 3000
MIN_SIMILAR = 0.55
CACHE_ENTRIES = 200_000
START, END = "^", "$"
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n+")
_SPACED = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")


def tokens(text: str) -> list[str]:
    """Lower-cased tokens; a run of at least three single characters is one."""
    text = text.lower()
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: m.group().replace(" ", "").replace("\t", ""), text)
    return text.split()


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def letters(token: str) -> str:
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def pieces(token: str) -> list[str]:
    """The token with its marks, or overlapping windows that cover it."""
    marked = START + token + END
    if len(marked) <= WINDOW:
        return [marked]
    return [marked[i : i + WINDOW] for i in range(0, len(marked) - WINDOW // 2, WINDOW // 2)]


def _flat(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character codes of all strings, one after the other, and their lengths."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    return codes, np.fromiter(map(len, strings), np.int64, len(strings))


def _codes(strings: list[str], blank: int) -> np.ndarray:
    codes, size = _flat(strings)
    out = np.full((len(strings), int(size.max(initial=0))), blank, np.int32)
    out[np.arange(out.shape[1]) < size[:, None]] = codes
    return out


def kernel_pairs(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of row i of ``s`` with row i of ``t`` (character codes, padded)."""
    n, width = t.shape
    total = np.zeros(n, np.float32)
    # prefix[i][j]: K'_i of the string read so far with the other's first j characters
    prefix = [[np.ones(n, np.float32)] * (width + 1)]
    prefix += [[np.zeros(n, np.float32) for _ in range(width + 1)] for _ in range(order - 1)]
    for x in range(s.shape[1]):
        match = [(s[:, x] == t[:, j]) * np.float32(decay**2) for j in range(width)]
        for j in range(order - 1, width):
            total += prefix[order - 1][j] * match[j]
        for i in range(order - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for j in range(1, width + 1):
                run = run * np.float32(decay) + prefix[i - 1][j - 1] * match[j - 1]
                prefix[i][j] = prefix[i][j] * np.float32(decay) + run
    return total


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """The kernel of every word with every other string."""
    s, t = _codes(words, -1), _codes(others, -2)
    a, b = np.divmod(np.arange(len(words) * len(others)), max(len(others), 1))
    return kernel_pairs(s[a], t[b]).reshape(len(words), len(others))


def _letters(strings: list[str]) -> np.ndarray:
    """A 64-bit set of each string's characters (by code modulo 64)."""
    codes, size = _flat(strings)
    out = np.zeros(len(strings), np.uint64)
    some = size > 0
    if some.any():
        out[some] = np.bitwise_or.reduceat(np.uint64(1) << (codes % 64).astype(np.uint64), (np.cumsum(size) - size)[some])
    return out


@dataclass
class Svm:
    """Landmarks, Nystroem whitening, linear weights and the margin's sigmoid."""

    landmarks: list[str]
    whiten: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    prior: float = 0.0
    toxic: int = 0  # the first landmarks; the others are counter-landmarks

    def margin(self, similar: np.ndarray) -> np.ndarray:
        return similar @ self.whiten @ self.weight + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.full(len(margin), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


class Similarity:
    """Similarities of tokens to the landmarks, remembered by a worker."""

    def __init__(self, landmarks: list[str], toxic: int | None = None):
        self.landmarks = landmarks
        self.codes = _codes(landmarks, -2)
        self.own = kernel_pairs(_codes(landmarks, -1), self.codes) if landmarks else np.zeros(0, np.float32)
        self.letters = _letters(landmarks)
        self.cache: dict[str, np.ndarray | None] = {}
        self.spelled: dict[str, str] = {}
        inner = {letters(x) for x in landmarks[:toxic]}
        # what neighbouring tokens must spell together: ORDER letters of a landmark, or all of a shorter one
        grams = {x[i : i + ORDER] for x in inner for i in range(max(len(x) - ORDER, 0) + 1) if x}
        alphabet = sorted(set().union(*grams)) if grams else []
        self.base = len(alphabet) + 1
        self.place = np.zeros(max(map(ord, alphabet), default=0) + 2, np.int64)
        self.place[[ord(c) for c in alphabet]] = np.arange(1, self.base)
        self.grams: dict[int, tuple[np.ndarray, bool]] = {}
        for n in {len(g) for g in grams}:
            known = np.array(sorted(self._number([int(self.place[ord(c)]) for c in g]) for g in grams if len(g) == n))
            flat = self.base**n <= 1 << 24
            if flat:
                table = np.zeros(self.base**n, bool)
                table[known] = True
            self.grams[n] = (table if flat else known, flat)

    def _number(self, digits: list) -> int | np.ndarray:
        out = digits[0]
        for d in digits[1:]:
            out = out * self.base + d
        return out

    def joins(self, texts: list[list[str]]) -> list[list[tuple[int, int]]]:
        """Of each text's tokens, ranges of neighbours whose letters spell parts of a landmark across the blanks."""
        spelled = self.spelled
        words: list[str] = []
        parts: list[str] = []
        for ws in texts:
            words += ws
            words.append(" ")
            parts += [spelled[w] for w in ws]
            parts.append("\0")  # no letter: nothing is spelled across texts
        stream, size = _flat(parts)
        digits = self.place[np.minimum(stream, len(self.place) - 1)]
        ends = np.cumsum(size)
        found: set[tuple[int, int]] = set()
        for n, (known, flat) in self.grams.items():
            if len(digits) < n:
                continue
            width = len(digits) - n + 1
            number = self._number([digits[i : i + width] for i in range(n)])
            if flat:
                at = np.flatnonzero(known[number])
            else:
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, number), len(known) - 1)] == number)
            if not len(at):
                continue
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + n - 1
            lo, hi = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="right")
            several = lo < hi
            found.update(zip(lo[several].tolist(), (hi[several] + 1).tolist()))
        starts = np.cumsum([0, *(len(ws) + 1 for ws in texts)])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for x, y in sorted(found):
            if not any(w[-1] in ".!?" for w in words[x : y - 1]):
                k = int(np.searchsorted(starts, x, side="right")) - 1
                out[k].append((x - int(starts[k]), y - int(starts[k])))
        return out

    def learn(self, words: set[str], kept: set[str] = frozenset()) -> None:
        """Remember the similarities of ``words``; those of ``kept`` stay too."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
            self.spelled.clear()
            new = list(words | kept)
        spelled = {w: letters(w) for w in new}
        # as they stand, but neighbouring tokens (with blanks) by their letters only
        fresh = {w for w in new if " " not in w}.union(x for x in spelled.values() if x and x not in self.cache)
        best = self._best(fresh)
        self.cache.update((w, best.get(w)) for w in fresh)
        for w, x in spelled.items():
            if " " not in w:
                self.spelled[w] = x
            if x != w:
                rows = [r for r in (best.get(w), self.cache.get(x)) if r is not None]
                self.cache[w] = np.max(rows, axis=0) if rows else None
        for x in fresh.difference(spelled):
            self.spelled[x] = x

    def _best(self, words: set[str]) -> dict[str, np.ndarray]:
        """The graded similarities of the words that have any."""
        parts, users = [], []
        for w in words:
            mine = pieces(w)
            parts += mine
            users += [w] * len(mine)
        own = _letters(parts)
        # a token that lacks a landmark's character isn't similar to it
        holds = np.zeros(len(parts), bool)
        for x in np.unique(self.letters):
            holds |= (own & x) == x
        use = np.flatnonzero(holds)
        use = use[np.argsort([len(parts[i]) for i in use], kind="stable")]
        best: dict[str, np.ndarray] = {}
        for lo in range(0, len(use), 8192):
            chunk = use[lo : lo + 8192]
            a, b = np.nonzero((own[chunk][:, None] & self.letters[None, :]) == self.letters[None, :])
            near = np.minimum(kernel_pairs(_codes([parts[i] for i in chunk], -1)[a], self.codes[b]) / self.own[b], 1.0)
            near = np.maximum(near - MIN_SIMILAR, 0.0) / (1 - MIN_SIMILAR)
            for k in np.flatnonzero(near):
                row = best.setdefault(users[chunk[a[k]]], np.zeros(len(self.landmarks)))
                row[b[k]] = max(row[b[k]], near[k])
        return best

    def near(self, texts: list[str]) -> list[list[str]]:
        """Of each text, its distinct tokens and neighbouring tokens with any similarity, in order."""
        if not self.landmarks:
            return [[] for _ in texts]
        words = [tokens(t) for t in texts]
        single = set().union(*words)
        self.learn(single)
        joined = [[" ".join(ws[x:y]) for x, y in js] for ws, js in zip(words, self.joins(words))]
        self.learn(set().union(*joined), single)
        hits = {w for w in single if self.cache[w] is not None}
        out = []
        for text, ws, js in zip(texts, words, joined):
            js = [j for j in dict.fromkeys(js) if self.cache[j] is not None]
            if js:
                inside = [f" {' '.join(tokens(x))} " for x in sentences(text)]
                js = [j for j in js if any(f" {j} " in x for x in inside)]
            out.append(list(dict.fromkeys(w for w in ws if w in hits)) + js)
        return out


def text_grams(text: str) -> set[str]:
    out: set[str] = set()
    for w in set(tokens(text)):
        m = START + w + END
        for n in GRAMS:
            out.update(m[i : i + n] for i in range(len(m) - n + 1))
    return out


def _gram_counts(sample: DataFrame) -> DataFrame:
    """gram, toxic and clean: in how many sampled documents of each class it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column("_text").to_pylist(), batch.column("_toxic").to_pylist()
            for lo, hi in slices(texts, 4 << 20):
                n = (Counter(), Counter())
                for t, y in zip(texts[lo:hi], toxic[lo:hi]):
                    n[y].update(text_grams(t))
                grams = list(n[0].keys() | n[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams, pa.string()), pa.array([n[1][g] for g in grams], pa.int64()),
                     pa.array([n[0][g] for g in grams], pa.int64())],
                    names=["gram", "toxic", "clean"],
                )

    return sample.mapInArrow(run, "gram string, toxic bigint, clean bigint").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def pick_landmarks(held: list[frozenset[str]], found: dict[str, tuple[int, int]], clean: int, most: int = LANDMARKS) -> list[str]:
    """Greedy cover of the toxic documents ``held`` (their candidate grams).

    Each pick halves the weight of the documents it covers; a clean document
    costs as much as several toxic ones at their share.
    """
    weight = np.ones(len(held))
    where: dict[str, list[int]] = {}
    for i, grams in enumerate(held):
        for g in grams:
            where.setdefault(g, []).append(i)
    rows = {g: np.array(w) for g, w in where.items()}
    cost = {g: 4.0 * found[g][1] * len(held) / max(clean, 1) for g in rows}
    picked: list[str] = []
    while len(picked) < most and rows:
        best = max(rows, key=lambda g: (weight[rows[g]].sum() - cost[g], len(g), g))
        gain = weight[rows[best]].sum() - cost[best]
        if gain < max(0.5, 0.005 * len(held)):
            break
        picked.append(best)
        weight[rows.pop(best)] *= 0.5
    return picked


def fit_svm(
    x: np.ndarray, y: np.ndarray, size: np.ndarray, rounds: int = 30, c: float = 200.0
) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge, both classes weighted alike) by Newton steps on its support vectors.

    A row without any similarity (zero features) stands for all other clean tokens.
    """
    x = np.vstack([x, np.zeros((1, x.shape[1]))])
    y = np.append(y, 0)
    size = np.append(size, max(size[y[:-1] == 0].sum(), 1.0))
    sign = np.where(y > 0, 1.0, -1.0)
    weight = size * np.where(y > 0, 0.5 / max(size[y > 0].sum(), 1e-9), 0.5 / max(size[y <= 0].sum(), 1e-9))
    z = np.column_stack([x, np.ones(len(x))])
    keep = np.eye(z.shape[1])
    keep[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])
    for step in range(rounds):
        support = sign * (z @ w) < 1
        zs = z[support] * weight[support, None]
        new = np.linalg.solve(keep + 2 * c * zs.T @ z[support], 2 * c * zs.T @ sign[support])
        if np.allclose(new, w, atol=1e-8):
            break
        w = w + 0.7 * (new - w) if step else new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Svm:
    """A model from ``labels`` (doc_id, toxic) and the texts of ``docs``."""
    known = labels.where("toxic is not null and doc_id is not null").select(
        F.col("doc_id").alias("_label_id"), (F.col("toxic") > 0).cast("int").alias("_toxic")
    )
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Svm([], prior=1.0 if sizes.get(1) else 0.0)
    order = (F.xxhash64("_label_id"), F.col("_label_id"))
    sample = known.where("_toxic = 1").orderBy(*order).limit(most).unionByName(
        known.where("_toxic = 0").orderBy(*order).limit(most)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).join(
        F.broadcast(sample), F.col("_id") == F.col("_label_id")
    ).select("_label_id", "_text", "_toxic")
    n_toxic, n_clean = min(sizes[1], most), min(sizes[0], most)
    prior = sizes[1] / (sizes[0] + sizes[1])
    least = max(1, min(5, n_toxic // 8))  # rarer n-grams are toxic by chance
    top = (
        _gram_counts(rows).where(F.col("toxic") >= least)
        .where(F.col("toxic") * n_clean > 4 * F.col("clean") * n_toxic)
        .orderBy((F.col("toxic") / n_toxic - 4 * F.col("clean") / n_clean).desc(), F.length("gram").desc(), "gram")
        .limit(CANDIDATES).collect()
    )
    found = {r["gram"]: (r["toxic"], r["clean"]) for r in top}

    def contained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [sorted(text_grams(t) & found.keys()) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.string()))], names=["grams"])

    held = rows.where("_toxic = 1").mapInArrow(contained, "grams array<string>").limit(2 * most).collect()
    landmarks = pick_landmarks(sorted((frozenset(r["grams"]) for r in held), key=sorted), found, n_clean)
    if not landmarks:
        return Svm([], prior=prior)

    def near_tokens(chosen: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sim = Similarity(chosen)
            for batch in batches:
                texts = batch.column("_text").to_pylist()
                for lo, hi in slices(texts, 2 << 20):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_toxic").slice(lo, hi - lo), pa.array(sim.near(texts[lo:hi]), pa.list_(pa.string()))],
                        names=["toxic", "near"],
                    )

        got = rows.mapInArrow(run, "toxic int, near array<string>").where("size(near) > 0").limit(4 * most).collect()
        return sorted((r["toxic"], sorted(r["near"])) for r in got)

    found_near = near_tokens(landmarks)
    seen = (Counter(), Counter())
    for y, near in found_near:
        seen[y].update(near)
    home = sorted(
        (w for w, n in seen[0].items() if n >= 3 and len(w) + 2 <= WINDOW and " " not in w),
        key=lambda w: (-seen[0][w], w),
    )
    toxic = len(landmarks)
    landmarks = landmarks + [START + w + END for w in home[:COUNTER_LANDMARKS] if START + w + END not in landmarks]
    model = fit_tokens(landmarks, found_near, prior)
    model.toxic = toxic
    return model


def fit_tokens(landmarks: list[str], bags: list[tuple[int, list[str]]], prior: float, rounds: int = 4) -> Svm:
    """The machine from (label, near tokens) of the training documents that have any."""
    gram = kernel(landmarks, landmarks)
    own = np.sqrt(np.diag(gram))
    value, vector = np.linalg.eigh((gram / own[:, None] / own[None, :]).astype(float) + 1e-3 * np.eye(len(landmarks)))
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    sim = Similarity(landmarks)
    words = sorted({w for _, near in bags for w in near})
    sim.cache.clear()
    x = np.zeros((len(words), len(landmarks)))
    for lo in range(0, len(words), CACHE_ENTRIES // 2):
        part = words[lo : lo + CACHE_ENTRIES // 2]
        sim.learn(set(part))
        for i, w in enumerate(part, lo):
            if sim.cache[w] is not None:
                x[i] = sim.cache[w]
    index = {w: i for i, w in enumerate(words)}
    toxic = [[index[w] for w in near] for y, near in bags if y]
    clean = sorted({index[w] for y, near in bags if not y for w in near})
    n_clean = Counter(index[w] for y, near in bags if not y for w in near)
    model = Svm(landmarks, whiten, prior=prior)
    chosen = [b for bag in toxic for b in bag]
    for _ in range(rounds):
        pick = chosen + clean
        y = np.array([1] * len(chosen) + [0] * len(clean))
        weight = np.array([1.0] * len(chosen) + [float(n_clean[i]) for i in clean])
        model.weight, model.bias = fit_svm(x[pick] @ whiten, y, weight)
        margin = model.margin(x)
        chosen = []
        for bag in toxic:
            top = max(bag, key=lambda i: margin[i])
            chosen += [top, *(i for i in bag if margin[i] > 0 and i != top)]
    margin = model.margin(x)
    high = np.array([max(margin[i] for i in bag) for bag in toxic])
    low = np.array([max(margin[index[w]] for w in near) for y, near in bags if not y] or [model.bias])
    cuts = np.unique(np.concatenate([high, low, [model.bias]]))
    cuts = (cuts[1:] + cuts[:-1]) / 2 if len(cuts) > 1 else cuts + 0.5
    wrong = [(high < c).sum() + (low >= c).sum() + (len(bags) if model.bias >= c else 0) for c in cuts]
    middle = float(cuts[int(np.argmin(wrong))])
    model.slope = 4.0
    model.shift = -model.slope * middle
    return model


def score_toxicity(docs: DataFrame, model: Svm, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and the worst sentence (null without any similarity) of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sim = worker_similarity(m.landmarks, m.toxic)
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for lo, hi in slices(texts, 2 << 20):
                margin, worst = [], []
                for text, near in zip(texts[lo:hi], sim.near(texts[lo:hi])):
                    top, word = m.bias, None
                    if near:
                        scores = m.margin(np.array([sim.cache[w] for w in near]))
                        word = near[int(scores.argmax())]
                        top = max(top, float(scores.max()))
                    margin.append(top)
                    worst.append(next((s for s in sentences(text) if f" {word} " in f" {' '.join(tokens(s))} "), text) if word else None)
                score = m.probability(np.array(margin))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(score, pa.float64()),
                     pa.array((score >= 0.5).astype(np.int32)), pa.array(worst, pa.string())],
                    names=["doc_id", "score", "predicted", "worst_sentence"],
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, score double, predicted int, worst_sentence string")


_WORKER: dict[tuple, Similarity] = {}


def worker_similarity(landmarks: list[str], toxic: int) -> Similarity:
    """One cache per worker process and set of landmarks."""
    key = (toxic, *landmarks)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Similarity(landmarks, toxic)
    return _WORKER[key]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id's text modulo 5 is 0."""
    return crc_mod(doc_id, 5) == 0
