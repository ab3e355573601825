"""The pipeline's stages on a small table, each against brute force on its own input."""

from __future__ import annotations

import collections
import random
import re

import corpus_pipeline
from kiln.llm.common import materialise, table
from tests.llm.test_operators import brute_near, brute_quality


def test_stages(spark, small_dir):
    docs = table(spark, small_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = materialise(stage(spark, docs, small_dir), f"test-{name}")
        after = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in after}
            for r in before:
                w = brute_quality(r["text"] or "")
                assert not (r["doc_id"] in kept and (w[0] < 20 or 100 * w[4] > 30 * w[0]))
        elif name == "exact_dedup":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
                best[key] = min(best.get(key, (1, 0)), (-len(r["text"] or ""), r["doc_id"]))
            assert sorted(r["doc_id"] for r in after) == sorted(b[1] for b in best.values())
        elif name == "near_dedup":
            classes = brute_near({r["doc_id"]: r["text"] or "" for r in before})
            assert sorted(r["doc_id"] for r in after) == sorted({c for c, _ in classes.values()})
        elif name == "mix_sources":
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
            assert max(collections.Counter(r["doc_id"] for r in after).values()) <= 3
        else:
            assert len(after) == len(before) and all(r["round_trip"] for r in after)


# columns that working columns of the stages might be called, and rows that a careless key would merge
HOSTILE = "doc_id bigint, text string, source string, _key string, _row int, _copy int, _maybe boolean, row string, key string, repeats int, base int, n_chars bigint"


def hostile_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(25, 60))) for _ in range(30)]
    rows = [(i, t, rng.choice(["a", "b", "c", None])) for i, t in enumerate(texts)]
    rows += [(1, "web", None), (1, None, "web"), (None, texts[0], "a"), (None, None, None), (50, "", "b"), (51, " ", "c")]
    rows += [rows[3], rows[3], (60, texts[4] + " and more", "b"), (61, texts[5], "b"), (62, texts[6] + "  ", None)]
    return [(*r, f"k{n}", n, n, True, "row", "key", 9, 7, 1) for n, r in enumerate(rows[:-5])] + [
        (*r, "same", 5, 5, False, "row", "key", 9, 7, 1) for r in [rows[3], rows[3]]] + [
        (*r, f"z{n}", n, n, None, "row", None, 9, 7, 1) for n, r in enumerate(rows[-3:])]


def share(sizes):
    """Targets by weights 1, 2, 3 in order, at most three times a source's size, the excess reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 3 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(target[s] for s in over)
        free -= over
    return target


def test_stages_keep_rows_and_columns(spark, small_dir):
    rows = hostile_rows()
    docs = spark.createDataFrame(rows, HOSTILE).repartition(3)
    text = lambda r: r[1] or ""

    kept = [tuple(r) for r in corpus_pipeline.exact_copies(spark, docs, small_dir).collect()]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text(r))].append(r)
    order = lambda r: (-len(text(r)), r[0] is None, r[0] or 0)
    assert len(kept) == len(groups) and not collections.Counter(kept) - collections.Counter(rows)
    for r in kept:
        assert order(r) == min(map(order, groups[re.sub(r"[\x20\x09-\x0D]", "", text(r))]))

    kept = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, small_dir).collect()]
    classes = brute_near({n: text(r) for n, r in enumerate(rows)})
    members = collections.defaultdict(list)
    for n, (c, _) in classes.items():
        members[c].append(rows[n])
    assert len(kept) == len(members) and not collections.Counter(kept) - collections.Counter(rows)
    for group in members.values():
        mine = [r for r in kept if r in group]
        assert len(mine) == 1
        assert (mine[0][0] is None, mine[0][0] or 0) == min((r[0] is None, r[0] or 0) for r in group)

    out = collections.Counter(tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, small_dir).collect())
    have = collections.Counter(rows)
    assert all(r in have and n <= 3 * have[r] for r, n in out.items())
    sizes, taken = collections.Counter({r[2]: 0 for r in rows}), collections.Counter()
    for r in rows:
        sizes[r[2]] += len(text(r).split())
    for r, n in out.items():
        taken[r[2]] += n * len(text(r).split())
    for s, t in share(sizes).items():
        assert abs(taken[s] - t) <= max(len(text(r).split()) for r in rows if r[2] == s), s

    encoded = corpus_pipeline.encode(spark, docs, small_dir).collect()
    assert len(encoded) == len(rows) and all(r["round_trip"] for r in encoded)


def test_stages_on_an_empty_table(spark, small_dir):
    docs = spark.createDataFrame([], HOSTILE)
    for name, stage in corpus_pipeline.STAGES[1:]:
        found = stage(spark, docs, small_dir)
        assert found.count() == 0
        if name != "byte_bpe":
            assert found.columns == docs.columns
