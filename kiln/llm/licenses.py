"""License scans by patience alignment (operator 9).

A text and a template, as words, are aligned on the words that occur exactly
once in both: the longest increasing subsequence of their positions is kept, and the
gaps between neighbouring anchors are aligned the same way; a gap without
such words matches its equal leading and trailing words.  Coverage is the share of the
template's words that are aligned.

A template's deciding phrases (name, variant, version; ``DECIDING``) must be aligned
word by word whatever the coverage.  Between the aligned words of a short notice no
other license's name or variant word (``FOREIGN``) may stand, unless an "or" or
"and" among them says that both licenses hold; words that only a relative's text has
(``BARRED``) may not stand there in any template.  ``license_texts`` holds the templates.

Words are runs of other than white space and ASCII punctuation, ASCII letters
lower-cased.  Every window of ``STRETCH`` times the template's length with enough
template words to reach ``COVERAGE`` is a candidate, so none is missed.

Edge cases: null and empty texts have no words and no match; texts of any
length are scanned whole; several matches of one template, and of several
templates, are separate rows; equal rows give equal rows; an empty table gives
no rows; templates without words match nothing; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.bpe import slices
from kiln.llm.common import utf8, word_hashes
from kiln.llm.license_texts import BARRED, DECIDING, NOT_NEXT, TEMPLATES

COVERAGE = 0.8
STRETCH = 1.5
SHORT = 20

# Words of license names and variants; those a template holds itself aren't foreign to it.
FOREIGN = (
    "mit 0 apache bsd clause isc mozilla mpl gnu gpl lgpl agpl lesser affero cc cc0 creative nc nd sa attribution "
    "noncommercial noderivatives sharealike unlicense eclipse epl boost zlib artistic"
)
SHORT_FOR = {
    "gpl": "gnu", "lgpl": "lesser", "agpl": "affero", "mpl": "mozilla", "epl": "eclipse", "cc": "creative",
    "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike",
}
EITHER = "or and"

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = bytes(32 if b in _PUNCTUATION else b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain(text: bytes) -> bytes:
    """ASCII punctuation as blanks, ASCII letters in lower case."""
    return text.translate(_PLAIN)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) in which the second rises."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = ends[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[k], ends[k] = b, i
    out = []
    i = ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(text[a0:a1]), Counter(template[b0:b1])
        at = {w: i for i, w in enumerate(template[b0:b1], b0) if nb[w] == 1}
        anchors = _rising([(i, at[w]) for i, w in enumerate(text[a0:a1], a0) if na[w] == 1 and w in at])
        if not anchors:
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:])]
    return sorted(found)


@dataclass(frozen=True)
class Template:
    """A template's words (hashes), its deciding phrases as ranges of them, and words that speak against it."""

    words: np.ndarray
    deciding: tuple[tuple[int, int], ...] = ()
    foreign: frozenset[int] = frozenset()
    either: frozenset[int] = frozenset()
    barred: frozenset[int] = frozenset()
    not_next: frozenset[int] = frozenset()

    @classmethod
    def of(cls, text: str, phrases: tuple[str, ...] = (), barred: str = "", not_next: str = "") -> Template:
        words = _words(text)
        ranges = []
        for phrase in map(_words, phrases):
            n = len(phrase)
            at = next((i for i in range(len(words) - n + 1) if np.array_equal(words[i : i + n], phrase)), None)
            if at is None or not n:
                raise ValueError(f"deciding words {phrases} are not in the template: {text}")
            ranges.append((at, at + n))
        foreign: frozenset[int] = frozenset()
        if ranges and len(words) <= SHORT:
            own = set(plain(text.encode()).decode().split())
            names = [w for w in FOREIGN.split() if w not in own and SHORT_FOR.get(w) not in own]
            foreign = frozenset(_words(" ".join(names)).tolist())
        rest = (frozenset(_words(w).tolist()) for w in (EITHER, barred, not_next))
        return cls(words, tuple(ranges), foreign, *rest)

    def decided(self, text: list[int], pairs: list[tuple[int, int]]) -> bool:
        """Whether the deciding phrases are aligned without a gap, and no foreign word lies between the aligned ones."""
        at = {b: a for a, b in pairs}
        for lo, hi in self.deciding:
            if lo not in at or any(at.get(b) != at[lo] + b - lo for b in range(lo, hi)):
                return False
        if self.not_next:
            behind = at[self.deciding[-1][1] - 1] + 1
            if behind < len(text) and text[behind] in self.not_next:
                return False
        if not self.foreign and not self.barred:
            return True
        aligned = set(at.values())
        between = {text[a] for a in range(pairs[0][0], pairs[-1][0]) if a not in aligned}
        if between & self.barred:
            return False
        return not between & self.foreign or bool(between & self.either)


def _words(text: str) -> np.ndarray:
    return word_hashes([plain(text.encode())])[0]


def scan(words: np.ndarray, template: Template, coverage: float = COVERAGE) -> list[tuple[float, int, int]]:
    """(coverage, first word, end word) of the template's matches in one text."""
    n = len(template.words)
    need = int(np.ceil(coverage * n - 1e-9))
    if not n or len(words) < need:
        return []
    width = int(np.ceil(STRETCH * n))
    hit = np.concatenate([[0], np.cumsum(np.isin(words, template.words))])
    last = np.minimum(np.arange(len(words)) + width, len(words))
    count = hit[last] - hit[:-1]
    first = np.diff(hit) > 0  # a window may start at a template word only
    starts = np.flatnonzero((count >= need) & first)
    wanted = template.words.tolist()
    out: list[tuple[float, int, int]] = []
    at = 0
    while at < len(starts):
        # of neighbouring starts (within one template's length) the best alignment counts
        end = int(np.searchsorted(starts, starts[at] + max(n // 2, 1)))
        best: tuple[float, int, int] | None = None
        for s in starts[at:end].tolist():
            window = words[s : s + width + 1].tolist()
            pairs = align(window[:width], wanted)
            share = len(pairs) / n
            if share >= coverage - 1e-9 and (best is None or share > best[0]) and template.decided(window, pairs):
                best = (share, s + pairs[0][0], s + pairs[-1][0] + 1)
                if share == 1.0:
                    break
        if best is None:
            at = end
        else:
            out.append(best)
            at = int(np.searchsorted(starts, best[2]))
    return out


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    coverage: float = COVERAGE, deciding: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """doc_id, license, coverage, start_word, end_word of every match.

    ``deciding`` holds the deciding phrases of ``templates``; without it own templates have none.
    """
    names = dict(templates if templates is not None else TEMPLATES)
    phrases = dict(deciding if deciding is not None else DECIDING if templates is None else {})
    barred, not_next = (BARRED, NOT_NEXT) if templates is None else ({}, {})
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: Template.of(t, phrases.get(k, ()), barred.get(k, ""), not_next.get(k, "")) for k, t in names.items()}
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t.words for t in known.values())]))
        place = {k: np.searchsorted(vocabulary, np.unique(t.words)) for k, t in known.items()}
        key = {
            k: np.searchsorted(vocabulary, np.concatenate([np.zeros(0, np.uint64), *(t.words[lo:hi] for lo, hi in t.deciding)]))
            for k, t in known.items()
        }
        for batch in batches:
            data = batch.column("b").to_pylist()
            for lo, hi in slices(data, 1 << 20):
                words, counts = word_hashes([plain(d) for d in data[lo:hi]])
                ends = np.cumsum(counts)
                doc = np.repeat(np.arange(hi - lo), counts)
                rows: list[tuple[int, str, float, int, int]] = []
                # which template words each document holds
                held = np.zeros((len(vocabulary), hi - lo), bool)
                at = np.minimum(np.searchsorted(vocabulary, words), max(len(vocabulary) - 1, 0))
                known_word = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
                held[at[known_word], doc[known_word]] = True
                for name, template in known.items():
                    if not len(template.words):
                        continue
                    # documents with too few distinct template words cannot reach the coverage
                    need = int(np.ceil(coverage * len(template.words) - 1e-9))
                    least = max(need - (len(template.words) - len(place[name])), 1)
                    maybe = np.flatnonzero(held[key[name]].all(axis=0))
                    maybe = maybe[held[np.ix_(place[name], maybe)].sum(axis=0) >= least]
                    for d in maybe:
                        mine = words[ends[d] - counts[d] : ends[d]]
                        rows += [(int(d), name, *m) for m in scan(mine, template, coverage)]
                rows.sort(key=lambda r: (r[0], r[3], r[1]))
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()),
                     pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                    names=["doc_id", "license", "coverage", "start_word", "end_word"],
                )

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, license string, coverage double, start_word bigint, end_word bigint")
