"""Sharding, filter audit and periodic runs against brute force on small tables with every edge case."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kiln.llm import filter_audit, periodic, sharding
from kiln.llm.common import word_hashes

CLASH = "doc_id bigint, text string, source string, size int, shard string, h int, row int, part int, mask int, b int, n_words int"


def frame(spark, rows, parts=3):
    """Rows (doc_id, text, source) with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5, 6, 7) for r in rows], CLASH).repartition(parts)


# 11 ----------------------------------------------------------------------
def groups_in_order(rows, shards):
    size = collections.Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        size[hashlib.sha256(b).hexdigest()[:15]] += len(b) + 8
    total = sum(size.values())
    return sorted(size.items(), key=lambda g: (0, -g[1], g[0]) if g[1] * shards > total else (1, 0, g[0]))


def least_capacity(sizes, shards):
    def needed(capacity):
        n, used = 1, 0
        for s in sizes:
            if used + s > capacity:
                n, used = n + 1, 0
            used += s
        return n

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if needed(mid) <= shards else (mid + 1, hi)
    return lo


def corpus(kind):
    rng = random.Random(kind)
    rows = [(i, "".join(rng.choices("abcdé ", k=rng.choice([0, 3, 40, 900]))), "s") for i in range(400)]
    rows += [(None, None, None), (None, "", "s"), (7, rows[7][1], "s"), (7, "other", "s")]
    if kind == "hot":
        rows += [(1000 + i, "same text " * 9, "s") for i in range(2500)] + [(5000 + i, "second", None) for i in range(900)]
    if kind == "identical":
        rows = [(1, "x", "s")] * 50
    if kind == "few":
        rows = rows[:5]
    return rows


@pytest.mark.parametrize(
    "kind, shards, bits", [("plain", 24, 14), ("plain", 7, 3), ("hot", 24, 14), ("hot", 7, 3), ("identical", 5, 14), ("few", 24, 14)]
)
def test_shards_are_the_smallest_contiguous_ones(spark, monkeypatch, kind, shards, bits):
    if bits == 3:  # few cells, so that the search has to split them over several rounds
        monkeypatch.setattr(sharding, "CELL_BITS", bits)
    rows = corpus(kind)
    got = sharding.shard_documents(frame(spark, rows), shards).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows
    )
    line = groups_in_order(rows, shards)
    by = collections.Counter()
    slots = collections.defaultdict(list)
    for r in got:
        by[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(by.values()) == least_capacity([s for _, s in line], shards)
    assert set(by) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    if len(line) >= shards and bits > 3:
        assert len(by) == shards
    text_of = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())): t for i, t, _ in rows}
    shard_of = collections.defaultdict(set)
    for r in got:
        t = text_of[(r["doc_id"], r["size"], r["text_crc32"])]
        shard_of[hashlib.sha256((t or "").encode()).hexdigest()[:15]].add(r["shard"])
    found = [shard_of[h] for h, _ in line]
    assert all(len(s) == 1 for s in found)
    assert [min(s) for s in found] == sorted(min(s) for s in found)


def test_shards_of_an_empty_table_and_files(spark, tmp_path):
    assert sharding.shard_documents(frame(spark, [])).count() == 0
    rows = corpus("plain")
    docs = frame(spark, rows)
    plan = sharding.write_shards(docs, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(docs.columns) < set(back.columns) and "shard_" in back.columns
    assert sorted(r["doc_id"] or -1 for r in back.collect()) == sorted(r[0] or -1 for r in rows)
    most = back.groupBy("shard_").agg(F.sum(F.length(F.coalesce("text", F.lit("")).cast("binary")) + 8).alias("b")).agg(F.max("b")).first()[0]
    assert most == plan.capacity


# 12 ----------------------------------------------------------------------
def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    seen = []
    for i, t, s in rows:
        t = t or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t],
        }
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        seen.append((s or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = {}
    for part in {s for s, *_ in seen}:
        own = [x for x in seen if x[0] == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                failing = sum(x[1][f] for x in own)
                out[part, "".join(order), k] = [
                    len(left), len(gone), failing - len(gone), sum(x[1][f] and sum(x[1].values()) == 1 for x in own),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
                shapley[f] += len(gone)
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def audit_rows():
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        vocabulary = [rng.choice(["w%d", "W%d", "é%d"]) % i for i in range(rng.choice([20, 300]))]
        texts.append(rng.choice(["", "# ", "A | B "]) + rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, k=rng.choice([5, 199, 200, 260]))))
    texts += [None, "", "x" * 5000, "\t\n ", texts[0], texts[1], "ABC"]
    rows = [(i, t, rng.choice(["a", "b", None, ""])) for i, t in enumerate(texts + texts[:20])]
    return rows + [(None, texts[0], "a"), (None, "fresh", "a"), (3, texts[3], rows[3][2]), (3, texts[4], "b")]


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, None), (None, 1, 1), (3, 1, 1), (900, 1, 1)] + [(i, i % 2, int(i % 5 == 0)) for i in range(10, 70)]
    marks = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id bigint, quality int, toxic int, part string")
    got = filter_audit.audit(filter_audit.class_counts(filter_audit.failures(frame(spark, rows)), marks)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in got} == brute_audit(rows, labels)
    assert len(got) == 600 * 3
    assert filter_audit.audit(filter_audit.class_counts(filter_audit.failures(frame(spark, [])), marks)).count() == 0
    assert filter_audit.audit(filter_audit.class_counts(filter_audit.failures(frame(spark, rows)), marks.limit(0))).where("good_lost + toxic_lost > 0").count() == 0


def test_packed_counters_do_not_overflow():
    packed = filter_audit.packed_outcomes()
    huge = (1 << 62) // 32
    outcomes, documents = filter_audit.unpacked(sum(p * huge for p in packed), 120, 5)
    assert documents == 32 * huge
    assert (outcomes[:, 0] == 16 * huge).all() and (outcomes.sum(axis=1) == 31 * huge).all()


# 13 ----------------------------------------------------------------------
def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q) and i > s:
                found.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def run_rows():
    rng = random.Random(8)
    texts = [None, "", " \n", "a", "a a a a a", "a a a a a a", "ab " * 7, "x y " * 3000, "é " * 50]
    for _ in range(120):
        w = []
        for _ in range(rng.randint(1, 12)):
            unit = rng.choices("abc" if rng.random() < 0.6 else "abcdefghij", k=rng.randint(1, 14))
            w += unit * rng.randint(1, 8) + unit[: rng.randint(0, len(unit))]
        texts.append(rng.choice([" ", "\n", "  \t"]).join(w))
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return rows + [(None, "p q r s " * 20, None), (5, texts[5], "s"), (5, "z " * 9, "s")]


def test_runs_and_collapsed_texts(spark):
    rows = run_rows()
    docs = frame(spark, rows)
    got = periodic.find_runs(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], repr(r[2]), r[3])
    want = []
    for i, t, _ in rows:
        w = (t or "").split()
        runs = brute_runs(w)
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in drop).encode()))
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"])) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert sum(len(r[2]) for r in want) > 100
    assert periodic.find_runs(frame(spark, [])).count() == 0


def test_runs_digest_of_planted_texts(spark):
    rows = [(i, t, s) for i, (_, t, s) in enumerate(run_rows() * 2)] + [(None, "a b c d e f g h i j k l", "s")]
    docs = frame(spark, rows).withColumn("text", periodic.planted_text(F.col("doc_id"), F.col("text")))
    got = {r["doc_id"]: r for r in periodic.digest(periodic.find_runs(docs)).collect()}
    for i, t, _ in rows:
        w = (t or "").split()
        h = zlib.crc32(("" if i is None else str(i)).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, len(w))]
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        drop = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in drop).encode()).hexdigest()


def test_every_factor_length_proposes():
    for q in (1, 2, 3, 7, 8, 9, 100):
        w = [f"w{k % q}" for k in range(max(6, 4 * q))]
        hashes, counts = word_hashes([b"before", " ".join(w).encode()])
        assert periodic.runs_of(hashes, counts) == {1: [(0, len(w), q)]}
