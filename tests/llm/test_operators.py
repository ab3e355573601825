"""Training-data operators against brute force on small tables with every edge case."""

from __future__ import annotations

import collections
import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from kiln.llm import (
    bpe, chat, components, exact_dedup, langid, licenses, mixing, near_join, quality, suffix_dedup, toxicity,
)
from kiln.llm.common import materialise

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, ids int"


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts: list[str | None] = [None, "", " \t\n", "one", "one two three", "漢字 かな", "a" * 5000, "x y " * 300]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 200))) for _ in range(12)]
    texts += base + base[:3] + [b.replace(" ", "  ", 3) for b in base[:3]]
    for b in base[3:9]:
        w = b.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), b + " " + base[0][:150] + "\n" + base[0][:150]]
    texts.append(" ".join(rng.choices(words, k=20000)))
    rng.shuffle(texts)
    return [
        (i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), 1, "clash", 7)
        for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df) -> dict:
    out = {r["doc_id"]: r for r in df.collect()}
    return out


# 1 -----------------------------------------------------------------------
def brute_repeats(texts: list[tuple[int, bytes]], length: int = 100) -> dict:
    seen: set[bytes] = set()
    out = {}
    for i, b in sorted(texts):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                mark[p : p + length] = b"\x01" * length
            seen.add(b[p : p + length])
        kept = bytes(c for c, m in zip(b, mark) if not m)
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        out[i] = (len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [50_000, 0])
def test_repeated_strings(docs, rows, hot):
    got = by_id(suffix_dedup.digest(suffix_dedup.remove_repeats(docs, hot_runs=hot)))
    want = brute_repeats([(r[0], (r[1] or "").encode()) for r in rows])
    assert {k: (v["n_bytes"], v["n_removed"], v["n_spans"], v["kept_sha256"]) for k, v in got.items()} == want


def test_repeated_strings_small_pieces(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    texts = [(r[1] or "").encode() for r in rows]
    runs = [suffix_dedup.runs_of([p[2] for p in suffix_dedup._cut(0, t, 100)]) for t in texts]
    for t, r in zip(texts, runs):
        assert r["m"].sum() == max(len(t) - 99, 0)


def test_repeated_strings_null_and_repeated_ids(spark, empty):
    t = "abcdefghij" * 12
    other = "".join(random.Random(4).choices("klmnopqrst", k=300))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, other + t)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 99, r["n_removed"]) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(df)).collect())
    assert got == [(1, 110), (1, 110), (2, 120), (99, 120)]
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_radix_groups_are_equal_strings():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = np.arange(300)
    alive, group = suffix_dedup.radix_groups(data, starts, np.zeros(300, np.int64), 11)
    want = collections.defaultdict(list)
    for s in starts:
        want[data[s : s + 11].tobytes()].append(s)
    found = collections.defaultdict(list)
    for a, g in zip(alive, group):
        found[g].append(a)
    assert sorted(map(sorted, found.values())) == sorted(v for v in want.values() if len(v) > 1)


# 2 -----------------------------------------------------------------------
CONTROLS = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    data = [
        (1, 1, "assistant", CONTROLS, 1), (1, 0, "user", None, 1), (1, 2, None, "a\\\\b ### </turn>\n", 1),
        (2, 0, "sys: tem", "é漢" * 3000, 1), (2, 0, "assistant", "tie", 1), (None, 0, "assistant", "", 1),
        (3, 0, "assistant", "x", 1), (3, 0, "assistant", "x", 1), (3, 1, "assistant", "\\", 1),
    ]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, ids int")
    formatted = chat.format_conversations(df, RANKS, public_tokenizers.PATTERN)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, RANKS, public_tokenizers.PATTERN).collect()}
    for conv in {d[0] for d in data}:
        turns = sorted((d[1], d[2] or "", d[3] or "") for d in data if d[0] == conv)
        plain = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256(plain.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "###", "</turn>", CONTROLS, "\\\\###\\</turn></turn", "# ## ####"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.read_turns(f"### {chat.escape(text, True)}: {chat.escape(text)}</turn>\n") == [(text, text)]


# 3 -----------------------------------------------------------------------
def test_bpe_equals_tiktoken(docs, rows, empty):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(RANKS))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digest(bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN)))
    for i, t, *_ in rows:
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_vocabularies_of_one_size_are_kept_apart():
    single = [bytes([b]) for b in range(256)]
    one, two = (bpe.worker_bpe(single + [pair, b"zz"], r"\S+|\s+") for pair in (b"ab", b"ba"))
    assert one is not two and bpe.worker_bpe(single + [b"ab", b"zz"], r"\S+|\s+") is one
    assert len(one.encode(["ab"])[0]) == 4 and len(two.encode(["ab"])[0]) == 8


# 4 -----------------------------------------------------------------------
def brute_quality(t: str) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    n = collections.Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = by_id(quality.quality_report(docs, none))
    for i, t, *_ in rows:
        want = brute_quality(t or "")
        assert tuple(got[i][k] for k in quality.BASE) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert got[i]["kept"] == (not got[i]["base_failed"])
    assert quality.quality_report(empty, none).count() == 0
    kept = quality.quality_filter(docs, none)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    trees = quality.fit_trees(x, y, monotone=(-1, 0, -1))
    assert ((trees.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.97
    for j in (0, 2):
        grid = np.repeat(x[:50], 21, axis=0)
        grid[:, j] = np.tile(np.linspace(0, 1, 21), 50)
        assert (np.diff(trees.score(grid).reshape(50, 21), axis=1) <= 1e-12).all()


def test_trees_learn_from_every_labelled_row(spark):
    from pyspark.sql import Window

    # of 20,300 labelled rows, the 300 of the largest hashes alone are of class 0
    nth = F.row_number().over(Window.orderBy(F.xxhash64("id")))
    marked = spark.range(20_300).select(F.col("id").alias("doc_id"), (nth <= 20_000).cast("int").alias("quality")).cache()
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(F.lit("w"), F.col("doc_id") + i)), " ")
    docs = marked.select("doc_id", F.when(F.col("quality") == 1, words).otherwise(F.concat(words, F.lit(" # # # #"))).alias("text"))
    got = quality.quality_report(docs, marked).join(marked, "doc_id").groupBy("quality").agg(F.min("score"), F.max("score"), F.min("kept"), F.max("kept"))
    (_, _, high0, _, any0), (_, low1, _, all1, _) = sorted(got.collect())
    assert high0 < 0.1 and not any0 and low1 > 0.9 and all1


def test_edges_and_sums_over_tasks_equal_those_of_rows_at_hand(spark, monkeypatch):
    monkeypatch.setattr(quality, "TASK_ROWS", 300)
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "Bee", "sea,", "#", "word"], int(rng.integers(18, 60)))) for _ in range(1500)]
    marks = [(i, int(t.count("#") < 0.2 * len(t.split()) or i % 9 == 0), 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    trees = quality.train(quality._stats_frame(docs, ["doc_id"], "text"), labels, "doc_id")
    s = quality.statistics(texts)
    fine = ~quality.base_failed(s)
    x, y = quality.features(s)[fine], np.array([m[1] for m in marks], float)[fine]
    want = quality.fit_trees(x, y)
    assert 0 < y.mean() < 1 and len(y) > 600
    for name in ("feature", "cut", "left", "right", "value", "roots"):
        assert np.array_equal(getattr(trees, name), getattr(want, name)), name
    good = np.sort(want.score(x[y == 1]))
    assert trees.threshold == min(0.5, good[int(quality.MAX_GOOD_LOSS * len(good))])


# 5 -----------------------------------------------------------------------
def test_language_spans(spark, empty):
    rng = random.Random(5)
    stock = {"en": "the and of with house stone river".split(), "fr": "le la est avec maison pierre été".split(), "ru": "дом река и камень это был".split()}
    data = [(i, " ".join(rng.choices(stock[l], k=40)), l) for i, l in enumerate(["en", "fr", "ru"] * 40)]
    data += [(900, None, "en"), (901, "", None), (902, "12 34 ²!", "fr")]
    mixed = "the house and the river of stone " * 3 + "le maison est avec la pierre été " * 5
    df = spark.createDataFrame([*data, (903, mixed, None)], "doc_id bigint, text string, lang string")
    got = by_id(langid.identify(df, df.where("doc_id % 4 <> 2")))
    assert all(got[i]["lang_pred"] == l for i, _, l in data[:120])
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    spans = got[903]["spans"]
    assert [s["lang"] for s in spans] == ["en", "fr"] and mixed[spans[1]["start"] :].startswith("le maison")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(df, df.limit(0)).collect()} == {"und"}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    counts = np.array([5, 0, 1, 7, 3])
    e = rng.normal(0, 4, (counts.sum(), 3)).astype(np.float32)
    got = langid.viterbi(e, counts, 3.0)
    at = 0
    for n in counts:
        part = e[at : at + n].astype(float)
        score, back = part[0].copy() if n else None, []
        for row in part[1:]:
            step = score[:, None] - 3.0 * (1 - np.eye(3))
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        if n:
            path = [int(score.argmax())]
            for b in back[::-1]:
                path.append(int(b[path[-1]]))
            assert got[at : at + n].tolist() == path[::-1]
        at += n


# 6 -----------------------------------------------------------------------
def test_toxicity_tolerates_inserted_characters(spark, empty):
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    insults = ["blockhead", "dimwitted"]
    data, labels = [], []
    for i in range(240):
        w = rng.choices(words, k=60)
        if i % 4 == 0:
            w[rng.randrange(60)] = rng.choice(insults)
        data.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    tests = [(1000, "lon ter blo-ckhead mas"), (1001, " ".join(rng.choices(words, k=60))), (1002, None), (1003, ""), (1004, "x d i m w i t t e d y"), (1005, "q" * 3000)]
    df = spark.createDataFrame(data + tests, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(df, known)
    got = by_id(toxicity.score_toxicity(df, model))
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in range(240)]) > 0.95
    assert [got[i]["predicted"] for i in range(1000, 1006)] == [1, 0, 0, 0, 1, 0]
    plain = toxicity.train(df, known.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score_toxicity(df, plain).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_toxicity_sees_interleaved_and_cut_insults(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 12))) for _ in range(300)]
    insults = ["blockhead", "dimwit", "moron", "scum"]
    data, labels = [], []
    for i in range(400):
        w = rng.choices(words, k=60)
        if i % 4 == 0:
            w[rng.randrange(60)] = insults[i // 4 % 4]
        data.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    hidden = [
        "d-i-m-w-i-t", "b.l.o.c.k.h.e.a.d", "m_o_r_o_n", "di***mwit", "mo***ron", "sc--um", "dim wit", "mo ron", "block head", "b lockhead",
        "di mw it", "sc um,",
    ]
    long = ["-".join(rng.choices(words, k=4)) for _ in range(12)]
    tests = [(1000 + i, f"{' '.join(rng.choices(words, k=9))} {x} {' '.join(rng.choices(words, k=9))}") for i, x in enumerate(hidden + long)]
    tests += [(2000, "They sat mo. Ron came."), (2001, "the last di\nmwit")]
    df = spark.createDataFrame(data + tests, "doc_id bigint, text string")
    model = toxicity.train(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    got = by_id(toxicity.score_toxicity(df, model))
    assert {x: got[1000 + i]["predicted"] for i, x in enumerate(hidden + long)} == {x: int(x in hidden) for x in hidden + long}
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0
    assert np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in range(400)]) > 0.98


def test_string_kernel_by_definition():
    def brute(s, t, order, decay):
        import itertools
        out = 0.0
        for a in itertools.combinations(range(len(s)), order):
            for b in itertools.combinations(range(len(t)), order):
                if all(s[i] == t[j] for i, j in zip(a, b)):
                    out += decay ** (a[-1] - a[0] + b[-1] - b[0] + 2)
        return out

    words, others = ["idiot", "id-iot", "tiodi", "aa"], ["^idiot", "diot", "aaaa"]
    got = toxicity.kernel(words, others)
    want = [[brute(w, o, toxicity.ORDER, toxicity.DECAY) for o in others] for w in words]
    assert np.allclose(got, want, rtol=1e-4)


# 7 -----------------------------------------------------------------------
def test_mix_hits_targets(spark, empty):
    rng = random.Random(7)
    data = [(i, " ".join("w" * rng.randint(1, 80)).strip(), rng.choices(["a", "b", "c", "é", None], [50, 20, 10, 5, 3])[0]) for i in range(3000)]
    data += [(5000, None, "empty"), (5001, "", "empty"), (5002, "x y", "a"), (5002, "x y", "a")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(5)
    got = mixing.mix_sources(df, block=256).collect()
    assert len(got) == len(data)
    size = collections.Counter()
    for _, t, s in data:
        size[s] += len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, mixing.share_targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))], sum(size.values()))))
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    source = {i: s for i, _, s in data}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 80
        assert target[s] <= 3 * size[s] + 1e-9
    again = mixing.mix_sources(df.repartition(3), block=256).collect()
    assert sorted(got) == sorted(again)
    assert mixing.mix_sources(empty).count() == 0


def test_mix_spreads_rows_of_one_id(spark):
    """A third of the rows without an id, a third the same row again: all blocks get their share, reruns agree."""
    rng = random.Random(8)
    data = [(None, " ".join("w" * rng.randint(1, 30)), "a") for _ in range(1500)]
    data += [(None, "the same text again", "a")] * 1500 + [(7, "three more words", None)] * 1000 + [(7, "other", None), (None, None, None), (None, "", None)]
    data += [(i, " ".join("w" * rng.randint(1, 30)), rng.choice("bc")) for i in range(600)]
    schema = "doc_id bigint, text string, source string"
    df = spark.createDataFrame(data, schema).repartition(6)

    def hashes(frame):
        slim = mixing.word_sizes(frame).withColumn("no", F.monotonically_increasing_id())
        return mixing.numbered(materialise(slim, "mix-test")).select("source", "h")

    found = hashes(df)
    assert sorted(r.h for r in found.collect()) == sorted(r.h for r in hashes(spark.createDataFrame(data[::-1], schema).repartition(3)).collect())
    assert found.select("h").distinct().count() == len(data)
    per = [r["count"] for r in found.where("source = 'a'").groupBy(F.pmod(F.xxhash64("h", F.lit(0)), F.lit(12))).count().collect()]
    assert len(per) == 12 and max(per) < 2 * 3000 / 12
    got = mixing.mix_sources(df, block=256).collect()
    size, taken, counts = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, s in data:
        size[s] += len((t or "").split())
        counts[s] += 1
    for r in got:
        taken[r["source"]] += r["taken"]
        counts[r["source"]] -= 1
        assert 0 <= r["taken"] <= 3 * r["size"] and r["repeats"] * r["size"] == r["taken"]
    assert not any(counts.values())
    # the level at which the stopped targets add up to all words, by bisection
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    low, high = 0.0, 3.0 * sum(size.values())
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * size[s], mid * weight[s]) for s in size) < sum(size.values()) else (low, mid)
    for s in size:
        want = min(3 * size[s], low * weight[s])
        assert abs(taken[s] - want) <= 60 and all(abs(r["target"] - want) < 1e-3 for r in got if r["source"] == s)
    again = mixing.mix_sources(df.repartition(3), block=256).collect()
    order = lambda r: (str(r["doc_id"]), str(r["source"]), *r[2:])
    assert sorted(got, key=order) == sorted(again, key=order)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, prob = rng.integers(0, 50, 500), np.full(500, 0.37)
    out = mixing.flight(size, prob, rng.random(500))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert abs(out.sum() - prob.sum()) < 1e-6 and abs((out * size).sum() - (prob * size).sum()) < 1e-4


# 8 -----------------------------------------------------------------------
def brute_near(texts: dict, threshold: float = 0.8) -> dict:
    sets = {}
    for i, t in texts.items():
        w = t.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}
    links = collections.Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-12 and both:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [2048, 3])
def test_near_duplicates(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_SETS", block)
    base = [w for r in rows if r[1] for w in r[1].split()][:200]
    extra = []
    for k in range(12):
        w = list(base)
        w[k * 15] = f"new{k}"
        extra.append((1000 + k, " ".join(w), None, None, 1, "c", 1))
    df = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = by_id(near_join.near_duplicates(df))
    want = brute_near({r[0]: r[1] or "" for r in [*rows, *extra]})
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == want
    monkeypatch.setattr(near_join, "STAR_SETS", block)
    classes = by_id(near_join.near_classes(df))
    assert {i: r["class_id"] for i, r in classes.items()} == {i: c for i, (c, _) in want.items()}
    if block == 3:
        assert near_join.near_duplicates(empty).count() == 0
        assert near_join.near_classes(empty).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_near_duplicates_below_the_production_threshold(spark, threshold):
    rng = random.Random(11)
    texts = []
    for k in range(40):  # chains of ever less similar texts
        w = [f"w{k}x{i}" for i in range(rng.randint(40, 120))]
        for _ in range(5):
            texts.append(" ".join(w))
            at = rng.randrange(len(w) - 6)
            w[at : at + rng.randint(0, 5)] = [f"n{rng.random()}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute_near(dict(enumerate(texts)), threshold)
    got = by_id(near_join.near_duplicates(df, threshold=threshold))
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == want
    assert sum(n for _, n in want.values()) > 200
    classes = by_id(near_join.near_classes(df, threshold=threshold))
    assert {i: r["class_id"] for i, r in classes.items()} == {i: c for i, (c, _) in want.items()}


def test_near_duplicates_without_ids(spark):
    """Most rows have no id or share one: links and classes are those of their texts."""
    rng = random.Random(13)
    texts = []
    for k in range(15):
        w = [f"w{k}x{i}" for i in range(90)]
        for _ in range(4):
            texts.append(" ".join(w))
            w[rng.randrange(90)] = f"n{rng.random()}"
    texts += [texts[0]] * 30 + ["", None]
    ids = [None if i % 3 else 7 for i in range(len(texts))]
    ids[59] = 3
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").repartition(3)
    want = brute_near({i: t or "" for i, t in enumerate(texts)})
    name = {}
    for i, (c, _) in want.items():
        name[c] = min((x for x in (name.get(c), ids[i]) if x is not None), default=None)
    size = collections.Counter(c for c, _ in want.values())
    expected = collections.Counter((ids[i], name[c], size[c], n) for i, (c, n) in want.items())
    got = near_join.near_duplicates(df).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in got) == expected
    classes = near_join.near_classes(df).collect()
    assert collections.Counter(tuple(r) for r in classes) == collections.Counter((ids[i], name[c]) for i, (c, _) in want.items())


def test_a_recall_out_of_reach_is_refused():
    with pytest.raises(ValueError):
        near_join.depth_for(0.1, 24, 0.99999)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 200)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}


def test_depth_shortens_to_recall():
    d = near_join.depth_for(0.8, near_join.TREES, near_join.RECALL)
    assert 1 - (1 - 0.8**d) ** near_join.TREES >= near_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_join.TREES


# 9 -----------------------------------------------------------------------
def test_license_scan(spark, empty):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge, ", "").replace("without limitation", "with no limitation")
    data = [
        (1, "lorem ipsum " * 50 + mit + " dolor" * 30), (2, "under the of and " * 200), (3, changed + " " + changed),
        (4, None), (5, ""), (6, "Some code. Released under the MIT License.\nReleased under the MIT license"),
        (7, "released the under license MIT other"), (8, "Released under the MIT License."), (8, "Released under the MIT License."),
    ]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = collections.Counter((r["doc_id"], r["license"]) for r in licenses.scan_licenses(df).collect())
    assert got == {(1, "MIT"): 1, (3, "MIT"): 2, (6, "MIT-notice"): 2, (8, "MIT-notice"): 2}
    assert licenses.scan_licenses(empty).count() == 0


def test_license_scan_needs_the_deciding_words(spark):
    gpl = licenses.TEMPLATES["GPL-3.0-header"]
    texts = {
        "released under the BSD license": set(),
        "The album was released under the new license last year": set(),
        "Released under the MIT-0 License": set(),
        "Licensed under CC BY 4.0": set(), "Licensed under CC BY-SA 4.0": set(), "Licensed under CC BY-NC-SA 4.0": set(),
        "Licensed under the Mozilla License, Version 2.0": set(),
        "Licensed under the Apache License, Version 1.1.": set(),
        "This work is licensed under the GNU General Public License, version 2": set(),
        "This work is licensed under the GNU Lesser General Public License, version 3": set(),
        "This work is licensed under the GNU Affero General Public License, version 3": set(),
        gpl.replace("version 3", "version 2"): set(),
        gpl.replace("General Public", "Lesser General Public"): set(),
        gpl.replace("General Public", "Affero General Public"): set(),
        "released under the terms of the MIT license": {"MIT-notice"},
        "distributed under the MIT License": {"MIT-notice"},
        "released under the BSD or MIT license": {"MIT-notice"},
        "under the Apache License, Version 2.0": {"Apache-2.0-notice"},
        "is licensed under the GNU General Public License (GPL), version 3": {"GPL-3.0-notice"},
        "available under CC BY-NC 4.0": {"CC-BY-NC-4.0-notice"},
        gpl: {"GPL-3.0-header"},
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    first = {k: v for k, v in licenses.TEMPLATES.items() if k in (
        "MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice", "MIT", "Apache-2.0-header", "GPL-3.0-header")}
    found = collections.defaultdict(set)
    for r in licenses.scan_licenses(df, first, deciding=licenses.DECIDING).collect():
        found[r["doc_id"]].add(r["license"])
    assert {t: found[i] for i, t in enumerate(texts)} == texts


def test_license_scan_covers_the_common_licenses(spark):
    t = licenses.TEMPLATES
    title = "Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
    def full(name):
        return t[f"{name}-text"].replace("Everyone", title + "Everyone") + " Preamble " + "and so on " * 40
    def id_of(name):
        return re.sub(r"-(header|text|notice|name|id|spdx)(-\w+)?$", "", name)
    texts = {
        "Some tool. Released under the BSD 3-Clause License.": {"BSD-3-Clause"}, "under the 2-clause BSD license": {"BSD-2-Clause"},
        "released under the BSD license": {"BSD"}, "distributed under the ISC license": {"ISC"}, "Released under the MIT-0 License": {"MIT-0"},
        "Licensed under the Mozilla Public License, version 2.0": {"MPL-2.0"}, "licensed under the GNU General Public License, version 2": {"GPL-2.0"},
        "licensed under the GNU Lesser General Public License, version 2.1": {"LGPL-2.1"}, "licensed under the LGPLv2.1": {"LGPL-2.1"},
        "licensed under the GNU Affero General Public License (AGPL), version 3": {"AGPL-3.0"}, "Licensed under the LGPL version 3": {"LGPL-3.0"},
        "Licensed under CC BY 4.0": {"CC-BY-4.0"}, "Licensed under CC BY-SA 4.0": {"CC-BY-SA-4.0"}, "Licensed under CC BY-NC-SA 4.0": {"CC-BY-NC-SA-4.0"},
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": {"CC-BY-SA-3.0"},
        "Released under CC0 1.0": {"CC0-1.0"}, "released under the Unlicense": {"Unlicense"},
        "// SPDX-License-Identifier: MIT": {"MIT"}, "SPDX-License-Identifier: MIT-0": {"MIT-0"}, "SPDX-License-Identifier: LGPL-2.1-or-later": {"LGPL-2.1"},
        "SPDX-License-Identifier: BSD-3-Clause-Clear": set(),
        "means the GNU General Public License, Version 2.0, the GNU Lesser General Public License, Version 2.1": set(), "He was released under the old law and the new license": set(),
        **{full(n): {n} for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")},
        **{text: {id_of(n)} for n, text in t.items() if id_of(n) == n or n.endswith(("-header", "-text"))},
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = collections.defaultdict(set)
    for r in licenses.scan_licenses(df).collect():
        found[r["doc_id"]].add(id_of(r["license"]))
    assert {i: found[i] for i in range(len(texts))} == dict(enumerate(texts.values()))
    # every template finds itself, and no other license
    df = spark.createDataFrame([(n, x) for n, x in t.items()], "doc_id string, text string")
    rows = licenses.scan_licenses(df).collect()
    assert {r["doc_id"] for r in rows if r["doc_id"] == r["license"] and r["coverage"] == 1.0} == set(t)
    assert {(r["doc_id"], r["license"]) for r in rows if id_of(r["doc_id"]) != id_of(r["license"])} == set()


def test_alignment_rises_and_anchors():
    text, template = list("xxabcqqdefyy"), list("abcdef")
    pairs = licenses.align([ord(c) for c in text], [ord(c) for c in template])
    assert [t for _, t in pairs] == list(range(6)) and pairs == sorted(pairs)


# 10 ----------------------------------------------------------------------
def test_exact_groups(docs, rows, empty):
    got = by_id(exact_dedup.exact_groups(docs))
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    for text, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(members), i == keep)
            assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(m)[1] for m in groups.values())
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0


def test_exact_repeated_rows_and_hot_group(spark):
    data = [(1, "same"), (1, "same"), (None, "sa me"), (None, None), (2, "other")] + [(i, "hot  text") for i in range(10, 400)]
    data += [(i, f"text {i}") for i in range(1000, 101_000, 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = exact_dedup.exact_groups(df)
    assert got.where("kept").count() == 3 + 1 + 1 + 100_000 - 1
    assert got.where("group_size = 390 and keep_id = 10").count() == 390
    kept = exact_dedup.exact_dedup(df)
    assert kept.count() == kept.selectExpr("regexp_replace(coalesce(text, ''), ' ', '')").distinct().count()


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint")
    got = {r[0]: (r[1], r[2]) for r in df.select("doc_id", langid.held_out(df.doc_id), toxicity.held_out(df.doc_id)).collect()}
    assert got == {i: (zlib.crc32(str(i).encode()) % 4 == 2, zlib.crc32(str(i).encode()) % 5 == 0) for i in range(50)}


def test_words_keep_their_combining_marks():
    from kiln.llm.langid import find_words

    texts = ["नमस्ते दुनिया यहाँ", "́́ été ́a", "", "́ 12", "plain words", "வணக்கம் שָׁלוֹם"]
    w = find_words(texts)
    got = [[texts[d][s : s + n] for e, s, n in zip(w.doc, w.start, w.length) if e == d] for d in range(len(texts))]
    assert got == [texts[0].split(), ["été", "a"], [], [], ["plain", "words"], texts[5].split()]


def test_toxicity_joins_stay_inside_their_text():
    from kiln.llm.toxicity import Similarity, _codes, _letters

    sim = Similarity(["^idiot", "^loser"], 2)
    texts = [["you", "id", "iot"], ["id"], ["iot", "los", "er"], [], ["los.", "er"]]
    sim.learn({w for t in texts for w in t})
    together = sim.joins(texts)
    assert together == [[r for one in sim.joins([t]) for r in one] for t in texts]
    assert together[0] == [(1, 3)] and together[2] == [(1, 3)] and not together[1] and not together[3] and not together[4]
    assert _codes(["ab", "", "c"], -1).tolist() == [[97, 98], [-1, -1], [99, -1]]
    assert _letters(["ab", ""]).tolist() == [(1 << 33) | (1 << 34), 0] and len(_codes([], -1)) == 0
