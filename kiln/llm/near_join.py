"""N-gram Jaccard join by MinHash LSH over many trees (operator 8).

Texts are sets of shingles (``SHINGLE`` consecutive words; a shorter text is one
shingle).  Two documents are linked when the Jaccard similarity of their sets
is ``THRESHOLD`` or more.

1. Texts with equal sets are copies; from here on each set counts once, with
   the number of its documents.
2. Each set gets a signature of ``TREES`` prefixes of minima; sets that share a
   tree's prefix meet in a node.  The prefixes' length, one for all sets, is the greatest up to
   ``MAX_DEPTH`` with which 1 - (1 - THRESHOLD^d)^TREES reaches ``RECALL``.  (A full LSH
   forest would shorten the prefix set by set.)
3. Nodes with several sets are the candidates.  A pair belongs to the first
   tree in which it meets, so it is counted once; pairs whose signatures
   agree in ``SIGMAS`` standard deviations less than the threshold are left out.  Large nodes are cut into blocks, and each pair of
   blocks is a group of its own: a task never holds more than two blocks.
4. Only sets with candidate pairs are read again and shipped, and every pair is
   verified exactly.  A task returns counts and a spanning forest for its
   sets, never the pairs themselves.
5. Classes are the connected components of the links.  ``near_classes`` finds them
   without counting links, in proportion to the sizes of the nodes.

Edge cases: null and empty texts have no shingles and equal sets, so they are
copies of each other; texts of any length are used whole; ties and repeated rows
are copies; an empty table gives no rows; other columns are ignored.  A class is named by
its smallest doc_id (null only if all are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.llm.bpe import cut
from kiln.llm.common import materialise, scramble, skew_join, utf8, word_hashes
from kiln.llm.components import connected_components
from kiln.llm.exact_dedup import bitmap_of, in_bitmap

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
MAX_DEPTH = 8
RECALL = 0.99999
SIGMAS = 6
BLOCK_SETS = 2048
BLOCK_SHINGLES = 2_000_000


def depth_for(threshold: float, trees: int, recall: float, most: int = MAX_DEPTH) -> int:
    """Shorten the prefix until pairs at the threshold meet in some tree with the target recall."""
    depth = most
    while depth and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    if not depth:
        raise ValueError(f"{trees} trees can't reach the recall {recall} at the threshold {threshold}")
    return depth


def sketch_for(threshold: float, minima: int) -> float:
    """The least share of equal minima of a pair at the threshold, but for ``SIGMAS`` standard deviations."""
    return max(0.0, threshold - SIGMAS * (threshold * (1 - threshold) / minima) ** 0.5)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and sorted, and their number per text."""
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    ends = np.cumsum(counts)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.zeros(n, np.uint64)
    # shorter texts: one shingle at their first word, over the words they have
    have = np.minimum(counts, width)
    for k in range(width):
        inside = np.arange(n) + k < ends[doc]
        nxt = np.zeros(n, np.uint64)
        nxt[: n - k] = words[k:]
        h = np.where(inside, scramble(h * np.uint64(0x9E3779B97F4A7C15) + nxt + np.uint64(1)), h)
    starts = ends - counts
    at = np.arange(n)
    ok = (at + width <= ends[doc]) | ((at == starts[doc]) & (have[doc] < width))
    h, doc = h[ok], doc[ok]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(texts))


def _multipliers(n: int) -> np.ndarray:
    return scramble(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(shingles: np.ndarray, counts: np.ndarray, minima: int) -> np.ndarray:
    """MinHash signatures (texts, minima) as unsigned 32-bit integers; empty sets have the largest values."""
    out = np.full((len(counts), minima), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k, m in enumerate(_multipliers(minima)):
            out[some, k] = np.minimum.reduceat((shingles * m) >> np.uint64(32), starts).astype(np.uint32)
    return out


def set_ids(shingles: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16-byte names of the sets."""
    out = np.zeros((len(counts), 2), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            out[some, k] = scramble(np.add.reduceat(scramble(shingles ^ np.uint64(salt)), starts) + counts[some].astype(np.uint64))
    return [row.tobytes() for row in out]


def _sketches(docs: DataFrame, minima: int, width: int) -> DataFrame:
    """doc_id, hash (of the text), sid (the set's name), n (shingles) and sig of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data in cut(batch.column("b"), 1 << 20):
                s, n = shingle_sets(data, width)
                sig = signatures(s, n, minima)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("hash").slice(lo, hi - lo), pa.array(set_ids(s, n), pa.binary()),
                     pa.array(n, pa.int64()), pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["doc_id", "hash", "sid", "n", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, hash bigint, sid binary, n bigint, sig binary")


def _nodes(sets: DataFrame, trees: int, depth: int) -> DataFrame:
    """node (a hash of tree and prefix), tree, no and n of the set, for every tree."""
    size = 4 * depth
    return sets.select("no", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select(
        F.xxhash64("tree", F.substring("sig", F.col("tree") * size + 1, F.lit(size))).alias("node"), "tree", "no", "n"
    )


def new_pairs(sig: np.ndarray, tree: int, depth: int, rows: np.ndarray, cols: np.ndarray, sketch: float) -> np.ndarray:
    """(rows, cols) matrix: the pair meets in ``tree``, in none before, and its signatures agree well enough."""
    out = np.ones((len(rows), len(cols)), bool)
    agree = np.zeros((len(rows), len(cols)), np.int16)
    for k in range(sig.shape[1] // depth):
        same = np.ones_like(out)
        for c in range(k * depth, (k + 1) * depth):
            equal = sig[rows, c][:, None] == sig[cols, c][None, :]
            agree += equal
            if k <= tree:
                same &= equal
        if k <= tree:
            out &= ~same if k < tree else same
    return out & (agree >= sketch * sig.shape[1])


def _strips(rows: np.ndarray, size: int = 256) -> Iterator[np.ndarray]:
    for lo in range(0, len(rows), size):
        yield rows[lo : lo + size]


def _unpack(sig: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = sig.to_pylist()
    return np.frombuffer(b"".join(values), np.uint32).reshape(len(values), -1)


def _members(sets: DataFrame, trees: int, depth: int, sketch: float) -> DataFrame:
    """node, tree, x, y (blocks), block, no: sets that have candidate pairs in that pair of blocks.

    Only names travel until the nodes with several sets are known; their
    signatures follow.
    """
    nodes = _nodes(sets, trees, depth)
    counted = nodes.groupBy("node").agg(
        F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("tree").alias("tree")
    ).where("members > 1")
    counted = counted.withColumn(
        "blocks", F.greatest(F.ceil(F.col("members") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    ).select("node", "tree", "members", "blocks")
    counted = materialise(counted, "near-nodes")
    dealt = skew_join(nodes.select("node", "no"), counted, "node", "members", trees * sets.count())
    paired = (
        dealt.withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "tree", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "no")
        .join(sets.select("no", "sig"), "no")
    )

    def run(table: pa.Table) -> pa.Table:
        sig, block = _unpack(table["sig"]), table["block"].to_numpy()
        tree, x, y = (table[c][0].as_py() for c in ("tree", "x", "y"))
        rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
        needed = np.zeros(len(block), bool)
        for part in _strips(rows):
            hit = new_pairs(sig, tree, depth, part, cols, sketch)
            if x == y:
                hit &= part[:, None] < cols[None, :]
            needed[part[hit.any(axis=1)]] = True
            needed[cols[hit.any(axis=0)]] = True
        return table.filter(pa.array(needed)).select(["node", "tree", "x", "y", "block", "no"])

    return paired.groupBy("node", "x", "y").applyInArrow(run, "node bigint, tree int, x int, y int, block int, no bigint")


def linked(shingles: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, wanted: np.ndarray, threshold: float) -> np.ndarray:
    """(rows, cols) matrix of wanted pairs with Jaccard similarity of at least ``threshold``, exactly."""
    out = np.zeros(wanted.shape, bool)
    size = np.array([len(s) for s in shingles])
    use = np.flatnonzero(wanted.any(axis=0))
    if not len(use):
        return out
    flat = np.concatenate([shingles[cols[j]] for j in use])
    starts = np.cumsum(size[cols[use]]) - size[cols[use]]
    values, code = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(values) + 1, np.int32)
    for i in np.flatnonzero(wanted.any(axis=1)):
        mine = shingles[rows[i]]
        at = np.searchsorted(values, mine)
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == mine)]
        pick = np.flatnonzero(wanted[i, use])
        mark[at] = 1
        if len(pick) * 4 < len(use):
            common = np.array([mark[code[starts[j] : starts[j] + size[cols[use[j]]]]].sum() for j in pick])
        else:
            common = np.add.reduceat(mark[code], starts)[pick]
        mark[at] = 0
        union = len(mine) + size[cols[use[pick]]] - common
        out[i, use[pick]] = common >= threshold * union - 1e-9
    return out


def _verify(members: DataFrame, sets: DataFrame, depth: int, sketch: float, threshold: float) -> DataFrame:
    """no, root (a linked set or itself) and links (documents linked through this group)."""
    full = members.join(sets, "no")

    def run(table: pa.Table) -> pa.Table:
        sig, block, copies = _unpack(table["sig"]), table["block"].to_numpy(), table["copies"].to_numpy()
        nos = table["no"].to_numpy()
        shingles = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        tree, x, y = (table[c][0].as_py() for c in ("tree", "x", "y"))
        rows, cols = np.flatnonzero(block == x), np.flatnonzero(block == y)
        links = np.zeros(len(nos), np.int64)
        parent = list(range(len(nos)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for part in _strips(rows):
            hit = new_pairs(sig, tree, depth, part, cols, sketch)
            if x == y:
                hit &= part[:, None] < cols[None, :]
            hit = linked(shingles, part, cols, hit, threshold)
            links[part] += hit @ copies[cols]
            links[cols] += hit.T @ copies[part]
            for i, j in zip(*np.nonzero(hit)):
                a, b = find(part[i]), find(cols[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
        root = nos[[find(i) for i in range(len(nos))]]
        return pa.table({"no": pa.array(nos), "root": pa.array(root), "links": pa.array(links)}).filter(pa.array(links > 0))

    return full.groupBy("node", "x", "y").applyInArrow(run, "no bigint, root bigint, links bigint")


def _shingle_rows(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """sid and shingles (sorted, 64-bit) of the chosen sets, read again from one document of each.

    A document is named by its id and its text's hash (a struct: null ids are equal), so texts without an id
    meet only their own set.
    """
    cells, bitmap = bitmap_of(chosen, "rep")
    near = in_bitmap(docs.select(F.struct("doc_id", "hash").alias("rep"), "b"), "rep", cells, bitmap)
    texts = near.join(chosen.select("rep"), "rep").select("b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data in cut(batch.column("b"), 1 << 20):
                s, n = shingle_sets(data, width)
                parts = np.split(s, np.cumsum(n)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_ids(s, n), pa.binary()), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["sid", "shingles"],
                )

    # rows that share id and text bring one set several times, texts of equal hash may bring others
    found = texts.mapInArrow(run, "sid binary, shingles binary")
    return found.join(chosen.select("sid"), "sid", "left_semi").dropDuplicates(["sid"])


def _distinct_sets(docs: DataFrame, id_col: str, text_col: str, minima: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, the rows (doc_id, hash, sid, n, sig) and the distinct sets (sid, no, copies, doc_id, rep, n, sig)."""
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("b")).withColumn("hash", F.xxhash64("b"))
    rows = materialise(_sketches(slim, minima, width), "near-rows")
    sets = rows.groupBy("sid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.max(F.struct("doc_id", "hash")).alias("rep"),
        F.first("n").alias("n"), F.first("sig").alias("sig"),
    )
    return slim, rows, materialise(sets.withColumn("no", F.monotonically_increasing_id()), "near-sets")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    width: int = SHINGLE, trees: int = TREES, recall: float = RECALL,
) -> DataFrame:
    """doc_id, class_id, class_size, copies (documents with the same set) and n_links of every document."""
    depth = depth_for(threshold, trees, recall)
    sketch = sketch_for(threshold, trees * depth)
    slim, rows, sets = _distinct_sets(docs, id_col, text_col, trees * depth, width)
    total = rows.count()
    members = materialise(_members(sets.where("n > 0"), trees, depth, sketch), "near-members")
    wanted = members.select("no").distinct()
    chosen = materialise(sets.join(wanted, "no", "left_semi").select("sid", "no", "rep", "copies", "sig"), "near-chosen")
    shingles = _shingle_rows(slim, chosen.select("sid", "rep"), width)
    full = chosen.select("sid", "no", "copies", "sig").join(shingles, "sid").drop("sid")
    found = materialise(_verify(members, full, depth, sketch, threshold), "near-links")
    roots = materialise(
        connected_components(found.select(F.col("no").alias("u"), F.col("root").alias("v"))), "near-roots"
    )
    links = found.groupBy("no").agg(F.sum("links").alias("links"))
    named = (
        sets.select("sid", "no", "copies", "doc_id")
        .join(roots.select(F.col("node").alias("no"), "root"), "no", "left").join(links, "no", "left")
        .select("sid", "copies", "doc_id", F.coalesce("root", "no").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    named = materialise(named, "near-named")
    classes = named.groupBy("root").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("sets")
    )
    per_set = skew_join(named, classes, "root", "sets", sets.count()).select(
        "sid", "class_id", "class_size", "copies", F.col("copies").alias("rows_"), (F.col("links") + F.col("copies") - 1).alias("n_links")
    )
    return skew_join(rows.select("doc_id", "sid"), per_set, "sid", "rows_", total).select(
        "doc_id", "class_id", "class_size", "copies", "n_links"
    )


# ---- classes without counting links: no group of near copies meets itself as a whole
STAR_SETS = 1024


def _verify_stars(pairs: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """The (no, lead) pairs with Jaccard similarity of at least ``threshold``, exactly.

    A task holds one leader and at most about ``STAR_SETS`` of its sets.
    """
    sizes = materialise(pairs.groupBy("lead").agg(F.count("*").alias("sets")).withColumn("parts", F.ceil(F.col("sets") / STAR_SETS).cast("int")), "near-leads")
    dealt = skew_join(pairs, sizes, "lead", "sets", pairs.count()).select(
        "lead", F.pmod(F.xxhash64("no"), F.col("parts")).cast("int").alias("part"), "no")
    leads = sizes.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("lead").alias("no"))
    shipped = dealt.unionByName(leads).join(full.select("no", "shingles"), "no")

    def run(table: pa.Table) -> pa.Table:
        nos, lead = table["no"].to_numpy(), table["lead"][0].as_py()
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        own = sets[int(np.flatnonzero(nos == lead)[0])]
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)
        near = (common >= threshold * (size + len(own) - common) - 1e-9) & (nos != lead)
        return table.filter(pa.array(near)).select(["no", "lead"])

    return shipped.groupBy("lead", "part").applyInArrow(run, "no bigint, lead bigint")


def _strays(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """node, tree, block, stray, label, no: sets of nodes that hold several classes.

    Only pairs of different classes are left to check.  A node's sets lie in blocks, once each;
    its strays - sets outside its largest class - are sent to all its blocks.
    """
    known = nodes.join(label, "no")
    per_class = known.groupBy("node", "tree", "label").agg(F.count("*").alias("n"))
    mixed = per_class.groupBy("node").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("members"), F.min("label").alias("a"), F.max("label").alias("z")
    ).where("a < z").withColumn("blocks", F.ceil(F.col("members") / BLOCK_SETS).cast("int")).select("node", "main", "members", "blocks")
    mixed = materialise(mixed, "near-mixed")
    dealt = skew_join(known, mixed, "node", "members", known.count())
    dealt = dealt.withColumn("stray", F.col("label") != F.col("main")).withColumn("own", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    to = F.when(F.col("stray"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    return dealt.withColumn("block", F.explode(to)).select("node", "tree", "block", "stray", "label", "no")


def _across(sig: np.ndarray, label: np.ndarray, stray: np.ndarray, tree: int, depth: int, sketch: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strips of strays and their candidate pairs with all sets of another class."""
    cols = np.arange(len(label))
    for part in _strips(np.flatnonzero(stray)):
        yield part, new_pairs(sig, tree, depth, part, cols, sketch) & (label[part][:, None] != label[None, :])


def near_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    width: int = SHINGLE, trees: int = TREES, recall: float = RECALL,
) -> DataFrame:
    """doc_id and class_id of every row, as ``near_duplicates`` has them, without the number of links.

    Every set is verified against the first set of each of its nodes.  What that connects needs no
    further check, however large the group; then only sets of one node in different classes are
    compared.  So a group of near copies is shipped in proportion to its size.
    """
    depth = depth_for(threshold, trees, recall)
    sketch = sketch_for(threshold, trees * depth)
    slim, rows, sets = _distinct_sets(docs, id_col, text_col, trees * depth, width)
    total = rows.count()
    nodes = _nodes(sets.where("n > 0"), trees, depth)
    leads = materialise(nodes.groupBy("node").agg(F.min("no").alias("lead"), F.count("*").alias("members")).where("members > 1"), "near-nodes")
    # a set's row holds the names of all its nodes, so that signatures and texts stay where they are
    met = materialise(skew_join(nodes.select("node", "tree", "no"), leads, "node", "members", trees * sets.count()), "near-met")
    pairs = materialise(met.where("no <> lead").select("no", "lead").distinct(), "near-stars")
    wanted = met.select("no").distinct()
    chosen = materialise(sets.join(wanted, "no", "left_semi").select("sid", "no", "rep", "sig"), "near-chosen")
    shingles = _shingle_rows(slim, chosen.select("sid", "rep"), width)
    full = materialise(chosen.select("sid", "no", "sig").join(shingles, "sid").drop("sid"), "near-full")
    first = materialise(_verify_stars(pairs, full, threshold).select(F.col("no").alias("u"), F.col("lead").alias("v")), "near-links")
    roots = materialise(connected_components(first), "near-roots")
    label = chosen.select("no").join(roots.select(F.col("node").alias("no"), "root"), "no", "left").select("no", F.coalesce("root", "no").alias("label"))
    strays = materialise(_strays(met.select("node", "tree", "no"), label), "near-strays")

    def needed(table: pa.Table) -> pa.Table:
        use = np.zeros(table.num_rows, bool)
        stray, tree = table["stray"].to_numpy(zero_copy_only=False), table["tree"][0].as_py()
        for part, hit in _across(_unpack(table["sig"]), table["label"].to_numpy(), stray, tree, depth, sketch):
            use[part[hit.any(axis=1)]] = True
            use |= hit.any(axis=0)
        return table.filter(pa.array(use)).select(["node", "tree", "block", "stray", "label", "no"])

    layout = "node bigint, tree int, block int, stray boolean, label bigint, no bigint"
    open_ = materialise(strays.join(full.select("no", "sig"), "no").groupBy("node", "block").applyInArrow(needed, layout), "near-open")

    def verify(table: pa.Table) -> pa.Table:
        nos, label_ = table["no"].to_numpy(), table["label"].to_numpy()
        stray, tree = table["stray"].to_numpy(zero_copy_only=False), table["tree"][0].as_py()
        parts = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        edges: set[tuple[int, int]] = set()  # one a pair of classes: at most the pairs of classes that meet here
        for part, hit in _across(_unpack(table["sig"]), label_, stray, tree, depth, sketch):
            hit = linked(parts, part, np.arange(len(nos)), hit, threshold)
            i, j = np.nonzero(hit)
            edges.update(zip(label_[part[i]].tolist(), label_[j].tolist()))
        u, v = zip(*sorted(edges)) if edges else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    second = open_.join(full, "no").groupBy("node", "block").applyInArrow(verify, "u bigint, v bigint")
    roots = materialise(connected_components(first.unionByName(second)), "near-roots")
    named = sets.select("sid", "no", "copies", "doc_id").join(roots.select(F.col("node").alias("no"), "root"), "no", "left").select(
        "sid", "copies", "doc_id", F.coalesce("root", "no").alias("root"))
    named = materialise(named, "near-named")
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("sets"))
    per_set = skew_join(named.drop("doc_id"), classes, "root", "sets", sets.count()).select("sid", "class_id", F.col("copies").alias("rows_"))
    return skew_join(rows.select("doc_id", "sid"), per_set, "sid", "rows_", total).select("doc_id", "class_id")
