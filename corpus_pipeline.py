"""Corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``docs``, whatever their names.

Every stage takes null and empty texts as equal, null ids and sources as values of their own, texts
of any length whole, and rows that occur more than once as rows; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import bpe, exact_dedup, mixing, near_join, quality
from kiln.llm.common import materialise, packed, row_key, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts the longest, then the one with the smallest doc_id, stays."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each class of near-duplicates stays, that with the smallest doc_id (null last).

    Rows are told apart by all their columns; of rows equal in all of them one stays.
    """
    keyed = packed(docs, key=row_key(docs), doc_id=F.col("doc_id"), text=F.col("text"))
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    found = materialise(near_join.near_classes(keyed.select(name.alias("name"), "text"), id_col="name"), "near-found")
    dropped = materialise(found.where("doc_id <> class_id").select("doc_id.key").distinct(), "near-dropped")
    heads = found.where("doc_id = class_id").groupBy("doc_id.key").count().where("count > 1").select("key")
    return _once(exact_dedup.without(keyed.select("row", "key"), "key", dropped), materialise(heads, "near-heads")).select("row.*")


def _once(keyed: DataFrame, repeated: DataFrame) -> DataFrame:
    """``keyed`` (row, key) with one row for each of the ``repeated`` keys."""
    if repeated.isEmpty():
        return keyed
    one = keyed.join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return exact_dedup.without(keyed, "key", repeated).unionByName(one.select(*keyed.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents the mix leaves out go, those it repeats occur as often as it takes them.

    Rows are told apart by all their columns; rows equal in all of them share their repeats.
    A source's documents are taken b or b + 1 times.  Which of them once more, two Bloom filters tell:
    a row outside the first, of the rows taken once more, is not; a row in it, but outside the second, of the
    others that hit the first, is.  Only rows in both - a few in a thousand - meet the exact list, and
    all other texts stay where they are.
    """
    keyed = packed(docs, key=row_key(docs), text=F.col("text"), source=F.col("source"))
    mixed = mixing.mix_sources(keyed.select("key", "text", "source"), id_col="key").select(F.col("doc_id").alias("key"), "source", "repeats")
    mixed = materialise(mixed.groupBy("key", "source").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("same")), "mix-repeats")
    single = mixed.where("same = 1")
    repeated = materialise(mixed.where("same > 1").select("key", "repeats"), "mix-same")
    base = materialise(single.groupBy("source").agg(F.min("repeats").alias("base")), "mix-base")
    base = mixing.per_source(base.select(F.col("source").alias("of"), "base"), base.count())
    told = materialise(single.join(base, F.col("source").eqNullSafe(F.col("of"))).select("key", "repeats", (F.col("repeats") > F.col("base")).alias("more")), "mix-told")
    more = told.where("more").select("key")
    near = exact_dedup.flagged(told.where("not more"), "key", more, "first").where("first").select("key")
    near = materialise(near, "mix-near")
    rows = exact_dedup.without(keyed.select("row", "key", "source"), "key", repeated.select("key"))
    rows = rows.join(base, F.col("source").eqNullSafe(F.col("of"))).select("row", "key", "base")
    rows = exact_dedup.flagged(exact_dedup.flagged(rows, "key", more, "first"), "key", near, "second")
    plain = rows.where("not (first and second)").select("row", (F.col("base") + F.col("first").cast("int")).alias("repeats"))
    listed = exact_dedup.flagged(exact_dedup.flagged(told, "key", more, "first"), "key", near, "second").where("first and second")
    unsure = rows.where("first and second").join(listed.select("key", "repeats"), "key").select("row", "repeats")
    taken = plain.unionByName(unsure)
    if not repeated.isEmpty():
        same = keyed.select("row", "key").join(repeated, "key").dropDuplicates(["key"]).select("row", "repeats")
        taken = taken.unionByName(same)
    return taken.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: doc_id, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text."""
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")
    encoded = bpe.encode_documents(
        docs.select(F.struct("doc_id", sha).alias("name"), "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, id_col="name",
    )
    return encoded.select(
        F.col("doc_id.doc_id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.col("doc_id.sha")).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

# Boosted trees and the cube sample aren't SQL: tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
