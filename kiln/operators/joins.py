"""Join operators (JOIN-*).

Which side is broadcast is left to the planner and to AQE, which know the sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kiln.functions.scalars import attachment_match, glob_to_regex, validate_regex
from kiln.operators.windows import chunked, earlier_chunks, in_chunk


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, Column | str]], how: str = "inner") -> DataFrame:
    """JOIN-01/02: fact joined to each (dimension, condition) in turn."""
    out = fact
    for dim, on in dims:
        out = out.join(dim, on, how)
    return out


def polymorphic_lookup(
    fact: DataFrame, type_col: str, key_col: str, targets: dict[str, tuple[DataFrame, str, str]]
) -> DataFrame:
    """JOIN-03: resolve ``key_col`` against the table named by ``type_col``.

    The targets are stacked into one (target_type, target_id, target_name)
    frame, so the fact is joined once (equi-join on type and id) instead of
    N times.
    """
    stacked = None
    for tname, (df, id_col, name_col) in targets.items():
        part = df.select(
            F.lit(tname).alias("_t_type"), F.col(id_col).cast("bigint").alias("_t_id"), F.col(name_col).alias("target_name")
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    lookup = stacked
    cond = (F.col(type_col) == F.col("_t_type")) & (F.col(key_col).cast("bigint") == F.col("_t_id"))
    return fact.join(lookup, cond, "left").drop("_t_type", "_t_id")


def semi(fact: DataFrame, other: DataFrame, on) -> DataFrame:
    """JOIN-05: rows of ``fact`` with a match (EXISTS)."""
    return fact.join(other, on, "left_semi")


def anti(fact: DataFrame, other: DataFrame, on) -> DataFrame:
    """JOIN-06/JOIN-12: rows of ``fact`` without a match (NOT EXISTS)."""
    return fact.join(other, on, "left_anti")


def flag_present(fact: DataFrame, keys: DataFrame, fact_key: str, key: str, flag: str) -> DataFrame:
    """JOIN-09: add a boolean ``flag`` = key present in ``keys``.

    ``keys`` is reduced to distinct keys first (partial aggregation), so the
    join is one-to-at-most-one and cannot multiply fact rows.
    """
    k = keys.select(F.col(key).alias("_k")).distinct().withColumn("_hit", F.lit(True))
    return (
        fact.join(k, F.col(fact_key) == F.col("_k"), "left")
        .withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False)))
        .drop("_k", "_hit")
    )


def previous_match(
    df: DataFrame, key: str, ts: str, tiebreak: str, is_match: Column, value: Column, out: str, bucket: Column
) -> DataFrame:
    """JOIN-10: for every row, ``value`` of the latest earlier row of the same
    key that satisfies ``is_match`` (the correlated "latest row before"
    subquery) without a self-join.

    Two levels so a hot key never lands in one task: the window runs per
    (key, bucket) (e.g. a day), and the carry-in from earlier buckets comes
    from a per-(key, bucket) aggregate whose size is bounded by the number of
    buckets, not by the number of rows.
    """
    d = chunked(df, [key], bucket)
    last = F.max_by(F.when(is_match, value), F.when(is_match, F.struct(ts, tiebreak))).alias("_last")
    carry = d.groupBy("_at").agg(last).select("_at", F.last("_last", ignorenulls=True).over(earlier_chunks()).alias("_carry"))
    within = d.withColumn("_in", F.last(F.when(is_match, value), ignorenulls=True).over(in_chunk([ts, tiebreak], last=-1)))
    return within.join(carry, "_at").withColumn(out, F.coalesce("_in", "_carry")).drop("_at", "_in", "_carry")


def usage_counts(ref: DataFrame, ref_key: str, users: DataFrame, user_key: str) -> DataFrame:
    """JOIN-11: how many rows of ``users`` reference each reference row, and
    whether it can be deleted (no users)."""
    counts = users.groupBy(F.col(user_key).alias("_k")).agg(F.count(F.lit(1)).alias("usage_count"))
    return (
        ref.join(counts, F.col(ref_key) == F.col("_k"), "left")
        .drop("_k")
        .withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
        .withColumn("can_delete", F.col("usage_count") == 0)
    )


def date_gaps(df: DataFrame, key: str, ts: str) -> DataFrame:
    """JOIN-13: per key, the dates between its first and last row on which it
    has no row.  The date range per key comes from a partial aggregate; the
    candidate dates are generated per key and anti-joined on distinct
    (key, date) pairs."""
    days = df.select(key, F.to_date(ts).alias("gap_date"))
    rng = days.groupBy(key).agg(F.min("gap_date").alias("_lo"), F.max("gap_date").alias("_hi"))
    candidates = rng.select(key, F.explode(F.sequence("_lo", "_hi")).alias("gap_date"))
    return candidates.join(days.distinct(), [key, "gap_date"], "left_anti")


# ---------------------------------------------------------------- pattern joins
def _explode_matches(facts: DataFrame, conds: list[tuple[object, Column]], id_col: str, rule_id: str,
                     keep: Sequence[str] = ()) -> DataFrame:
    """One scan: an array of the ids of the rules whose predicate holds,
    exploded into (fact, rule) rows."""
    if not conds:
        return facts.select(id_col, *keep, F.lit(None).cast("int").alias(rule_id)).limit(0)
    hits = F.array_compact(F.array(*[F.when(c, F.lit(rid)) for rid, c in conds]))
    return facts.select(id_col, *keep, F.explode(hits).alias(rule_id))


def regex_rule_hits(rules: list[dict], fields: dict[str, str], rule_id: str = "rule_id") -> Column:
    """ARRAY of the ids of the rules (in rule order) whose every non-NULL
    pattern matches its field case-insensitively (search, not full match).

    Rules are validated on the driver: a rule with an invalid pattern is
    skipped (as the reference does) instead of failing the job at run time.
    """
    conds = []
    for r in rules:
        preds, valid = [], True
        for rf, fc in fields.items():
            p = r.get(rf)
            if p is None:
                continue
            if validate_regex(p) is not None:
                valid = False
                break
            preds.append(F.coalesce(F.col(fc).rlike("(?i)" + p), F.lit(False)))
        if valid:
            cond = F.lit(True)
            for p in preds:
                cond = cond & p
            conds.append(F.when(cond, F.lit(r[rule_id])))
    return F.array_compact(F.array(*conds)) if conds else F.array().cast("array<int>")


def regex_rule_join(
    facts: DataFrame, rules: list[dict], fields: dict[str, str], id_col: str, rule_id: str = "rule_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """JOIN-07: (fact, rule) pairs for every matching rule (see
    ``regex_rule_hits``).  All rules are evaluated in one pass over the
    facts, which is what a broadcast nested-loop join against the tiny rule
    list would do, but inside one codegen stage."""
    return facts.select(id_col, *keep, F.explode(regex_rule_hits(rules, fields, rule_id)).alias(rule_id))


def glob_rule_join(facts: DataFrame, rules: list[dict], name_col: str, id_col: str, rule_id: str = "rule_id",
                   pattern: str = "pattern", keep: Sequence[str] = ()) -> DataFrame:
    """JOIN-08: glob patterns are translated to anchored regexes once per rule
    on the driver, then matched like JOIN-07 (NULL pattern = match all)."""
    conds = []
    for r in rules:
        g = r.get(pattern)
        cond = F.lit(True) if g is None else F.coalesce(F.col(name_col).rlike(glob_to_regex(g)), F.lit(False))
        conds.append((r[rule_id], cond))
    return _explode_matches(facts, conds, id_col, rule_id, keep)


def attachment_rule_join(files: DataFrame, rules: list[dict], name_col: str, id_col: str, rule_id: str = "rule_id",
                         pattern: str = "pattern", keep: Sequence[str] = ()) -> DataFrame:
    """JOIN-07 for attachments: (file, rule) pairs by glob, regex or plain text (see ``attachment_match``)."""
    conds = [(r[rule_id], attachment_match(name_col, r[pattern])) for r in rules]
    return _explode_matches(files, conds, id_col, rule_id, keep)
