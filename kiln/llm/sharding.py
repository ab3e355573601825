"""Sharding by a minimax contiguous partition (operator 11, native).

Documents with equal texts are one atomic group.  Groups stand in a fixed
order: those larger than an even share of all bytes first, by size, then all
others by the hash of their text.  The order is cut into contiguous shards so
that the largest shard is as small as possible.

* The smallest feasible capacity is binary-searched; a capacity is feasible
  if filling shards greedily, each as far as it allows, reaches the end.
* The search runs on ends of ``CELLS`` ranges of the hash (cells) instead of
  all groups.  Their ends are true group ends, so the capacity found is feasible.  A
  smaller one could only cut inside certain windows of the line, which follow from
  that capacity and from the even share; cells of several groups in a window
  are split until none is left.  Then the capacity is the smallest over all groups.
* Under that capacity each cut goes to the group end nearest to an even
  share of what is left, as long as the rest still fits, so that shards are near equal
  even where one huge group sets the capacity.

What reaches the driver are at most one cut, one window and one huge group a shard.
Rows are numbered inside shards by ranges of (shard, hash, id), so no shard and
no group of copies is held by one task.

Edge cases: null text counts as empty (size ``ROW_BYTES``, crc 0) and is equal to empty
texts; with fewer groups than shards the last shards stay empty; rows that share an
id are separate; rows equal in all columns are interchangeable; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import free_name, materialise, utf8

SHARDS = 24
ROW_BYTES = 8
HASH_BITS = 60
CELL_BITS = 14
CELLS = 1 << CELL_BITS
LINE_BITS = 22  # the line has fewer than 2^22 ends: ``CELLS`` more a round, at most 46 rounds


def group_hash(text: Column) -> Column:
    """The first 60 bits of the text's sha256: the name of its group and its place in the order."""
    return F.conv(F.substring(F.sha2(utf8(text), 256), 1, HASH_BITS // 4), 16, 10).cast("bigint")


@dataclass(frozen=True)
class ShardPlan:
    """Where the line of groups is cut: capacity, cuts, shard of each huge group, last hash of each shard but the last."""

    capacity: int
    cuts: tuple[int, ...]
    huge: tuple[tuple[int, int], ...]
    bounds: tuple[int, ...]

    def shard_of(self, h: Column) -> Column:
        """Shard of a group by its hash."""
        shard = reduce(lambda a, b: a + (h > F.lit(b)).cast("int"), self.bounds, F.lit(0))
        for name, own in self.huge:
            shard = F.when(h == F.lit(name), F.lit(own)).otherwise(shard)
        return shard


# SQL over one row: ``ends``, the ascending ends of the cells on the line of all bytes.
def _upto(x: str) -> str:
    """How many ends are at most ``x``."""
    return (
        f"aggregate(sequence({LINE_BITS - 1}, 0, -1), 0L, (i, b) -> "
        f"IF(i + shiftleft(1L, b) <= size(ends) AND get(ends, int(i + shiftleft(1L, b) - 1)) <= {x}, i + shiftleft(1L, b), i))"
    )


def _reach(x: str) -> str:
    """The last end at or before ``x`` (0: none)."""
    return f"coalesce(get(ends, int({_upto(x)} - 1)), 0L)"


def _greedy(capacity: str, shards: int) -> str:
    """Where shards filled one after another up to ``capacity`` end."""
    return f"aggregate(sequence(1, {shards}), 0L, (p, j) -> {_reach(f'p + {capacity}')})"


def _search(shards: int, least: int, total: int) -> str:
    """The smallest capacity with which ``shards`` greedily filled shards hold everything."""
    mid = "(s.lo + (s.hi - s.lo) div 2)"
    return (
        f"aggregate(sequence(1, 63), named_struct('lo', {least}L, 'hi', {total}L), (s, t) -> IF(s.lo >= s.hi, s, "
        f"IF({_greedy(mid, shards)} >= {total}L, named_struct('lo', s.lo, 'hi', {mid}), named_struct('lo', {mid} + 1L, 'hi', s.hi))), s -> s.lo)"
    )


def _path(capacity: int, shards: int) -> str:
    """All ends of greedily filled shards."""
    step = _reach(f"element_at(a, -1) + {capacity}L")
    return f"aggregate(sequence(1, {shards}), array(0L), (a, j) -> concat(a, array({step})))"


def _latest_starts(capacity: int, shards: int, total: int) -> str:
    """For 0 to ``shards`` full shards: the first end from which the shards after them can hold the rest."""
    y = f"(get(a, 0) - {capacity}L)"
    before = f"IF({y} <= 0L, 0L, get(ends, int({_upto(f'{y} - 1L')})))"
    return f"aggregate(sequence(1, {shards}), array({total}L), (a, j) -> concat(array({before}), a))"


def _even_cuts(capacity: int, shards: int, total: int) -> str:
    """Cuts next to even shares of what is left; ``starts`` as above."""
    p = "element_at(a, -1)"
    target = f"({p} + ({total}L - {p}) div ({shards} - j + 1))"
    below, above = _reach(target), f"coalesce(get(ends, int({_upto(target)})), {total}L)"
    nearest = f"IF({below} > {p} AND {target} - {below} <= {above} - {target}, {below}, {above})"
    pick = f"least({_reach(f'{p} + {capacity}L')}, greatest(get(starts, j), {nearest}))"
    return f"aggregate(sequence(1, {shards}), array(0L), (a, j) -> concat(a, array({pick})))"


def _line(cells: DataFrame) -> DataFrame:
    """``cells`` with their ends: huge groups by size, then cells by hash."""
    order = Window.orderBy(F.col("huge").desc(), F.when(F.col("huge"), -F.col("size")), "low")
    return cells.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _cells(rows: DataFrame, shift: int) -> DataFrame:
    """Bytes, first and last hash of every range of the hash; partial sums make hot groups one row a task."""
    return rows.groupBy(F.shiftright("h", shift).alias("cell")).agg(
        F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")
    ).select(F.lit(False).alias("huge"), F.lit(shift).alias("shift"), "cell", "size", "low", "high")


def plan_shards(sizes: DataFrame, shards: int = SHARDS) -> ShardPlan:
    """Cut the line of groups; ``sizes`` has h (the group) and size of every row and is read several times."""
    total = sizes.agg(F.sum("size")).first()[0]
    if total is None:
        return ShardPlan(0, (0,) * (shards + 1), (), ())
    shift = HASH_BITS - CELL_BITS
    cells = materialise(_cells(sizes, shift), "shard-cells")
    heavy = [r["cell"] for r in cells.where(F.col("size") * shards > total).select("cell").collect()]
    huge = materialise(
        sizes.where(F.shiftright("h", shift).isin(heavy)).groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") * shards > total),
        "shard-huge",
    )
    alone = {r["h"]: r["size"] for r in huge.collect()}  # fewer than ``shards``
    rest = sizes.where(~F.col("h").isin(list(alone)))
    if alone:
        own = huge.select(F.lit(True).alias("huge"), F.lit(0).alias("shift"), F.col("h").alias("cell"), "size", F.col("h").alias("low"), F.col("h").alias("high"))
        cells = materialise(_cells(rest, shift).unionByName(own), "shard-cells")
    least = max([-(-total // shards), *alone.values()])
    while True:
        line = materialise(_line(cells), "shard-line")
        ends = materialise(line.agg(F.sort_array(F.collect_list("end")).alias("ends")), "shard-ends")
        capacity = ends.select(F.expr(_search(shards, least, total))).first()[0]
        if capacity == least or shift == 0:
            break
        early = ends.select(F.expr(_path(least, shards))).first()[0]
        windows = [
            (max(early[j], total - (shards - j) * capacity), min(j * capacity, total)) for j in range(1, shards)
        ]
        within = reduce(lambda a, b: a | b, ((F.col("end") - F.col("size") < hi) & (F.col("end") > lo) for lo, hi in windows))
        open_ = materialise(line.where((F.col("shift") == shift) & (F.col("low") < F.col("high")) & within & ~F.col("huge")).drop("end"), "shard-open")
        n = open_.count()
        if not n:
            break
        finer = max(0, shift - max(1, CELL_BITS - n.bit_length()))
        keys = F.broadcast(open_.select("cell"))  # at most ``CELLS`` numbers
        inside = rest.withColumn("cell", F.shiftright("h", shift)).join(keys, "cell", "left_semi")
        kept = line.drop("end").join(F.broadcast(open_.select("shift", "cell", "huge")), ["shift", "cell", "huge"], "left_anti").select(*cells.columns)
        cells = materialise(kept.unionByName(_cells(inside, finer)), "shard-cells")
        shift = finer
    both = ends.select("ends", F.expr(_latest_starts(capacity, shards, total)).alias("starts"))
    cuts = both.select(F.expr(_even_cuts(capacity, shards, total))).first()[0]
    inner = cuts[1:shards]
    at = {r["end"]: r for r in line.where(F.col("end").isin(inner) | F.col("huge")).select("end", "huge", "low", "high").collect()}
    return ShardPlan(
        capacity, tuple(cuts),
        tuple((r["low"], sum(c < end for c in inner)) for end, r in sorted(at.items()) if r["huge"]),
        tuple(-1 if at[c]["huge"] else at[c]["high"] for c in inner),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in its shard, by hash and id) of every row."""
    text = utf8(F.col(text_col))
    slim = docs.select(
        F.col(id_col).alias("doc_id"), group_hash(F.col(text_col)).alias("h"), (F.length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"),
    )
    slim = materialise(slim, "shard-rows")
    plan = plan_shards(slim.select("h", "size"), shards)
    order = ("shard", "h", "doc_id", "row")
    placed = slim.withColumn("shard", plan.shard_of(F.col("h"))).repartitionByRange(*order).sortWithinPartitions(*order)
    # the id counts rows inside each range, in order
    placed = materialise(placed.withColumn("at", F.monotonically_increasing_id()), "shard-placed")
    stretches = placed.groupBy("shard", F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select("shard", "range", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # one row per range and shard in it: at most ranges + shards rows
    return placed.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(offsets), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("at") + F.col("shift")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text_col: str = "text") -> ShardPlan:
    """Write all columns of ``docs`` as Parquet, one folder a shard (``shard=``, or a free name like it)."""
    text = utf8(F.col(text_col))
    sizes = materialise(docs.select(group_hash(F.col(text_col)).alias("h"), (F.length(text) + ROW_BYTES).cast("bigint").alias("size")), "shard-rows")
    plan = plan_shards(sizes, shards)
    name = free_name(docs, "shard")
    docs.withColumn(name, plan.shard_of(group_hash(F.col(text_col)))).write.mode("errorifexists").partitionBy(name).parquet(path)
    return plan
