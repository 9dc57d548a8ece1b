"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after each run of white space
(U+0020, U+0009 to U+000D) is replaced by one space.

1. One scan gives each row the length of its normalised text and a hash of the
   first ``prefix_chars`` characters: a few bytes a row, counted by both and staged.
2. Rows whose length no other row has leave; of the rest, (length, prefix hash)
   groups of two or more survive.
3. The survivors' keys become a bitmap of fixed size, which is broadcast. A second
   scan computes the full SHA-256 of just those rows that the bitmap lets through.
   A false positive of the bitmap costs one hash and never a wrong result.
4. Rows are grouped by (length, prefix hash, full hash). The group by is
   pre-aggregated, and the join back is an equi-join with one row a key on one
   side, so that adaptive execution may split a group with a third of all rows.

Defined results: a null text counts as empty; empty texts are equal to one
another; of rows that repeat both text and doc_id, one stays; of texts of one doc_id
that differ in white space alone, the one with the least hash; rows with a null
doc_id lose to rows that have one; an empty table gives an empty result; other
columns, whatever their names, pass through ``drop_exact_duplicates`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import SPACES, drop_keys, flag_members, free_name, key_bitmap, text_or_empty
from folioloom.session import staged

PREFIX_CHARS = 256
BITS_LOG2 = 24


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def _length(text: str) -> Column:
    return F.length(normalised(text)).cast("long")


def _prefix(text: str, prefix_chars: int) -> Column:
    return F.xxhash64(F.substring(normalised(text), 1, prefix_chars))


def survivors(spark: SparkSession, docs: DataFrame, text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Keys (_len, _prefix) of the groups that are left after two refinements."""
    short = docs.select(_length(text).alias("_len"), _prefix(text, prefix_chars).alias("_prefix"))
    # copies collapse to one counted row a task and key before any length meets in one place
    pairs = staged(spark, short.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")), "dedup-short")
    shared_lengths = pairs.groupBy("_len").agg(F.sum("_n").alias("_n")).filter("_n > 1").select("_len")
    return pairs.join(shared_lengths, "_len", "left_semi").filter("_n > 1").select("_len", "_prefix")


def with_full_hash(spark: SparkSession, docs: DataFrame, text: str = "text", prefix_chars: int = PREFIX_CHARS, bits_log2: int = BITS_LOG2) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with length, prefix hash and, for surviving groups, full hash; and those columns' names."""
    bitmap = key_bitmap(survivors(spark, docs, text, prefix_chars), ["_len", "_prefix"], bits_log2)
    names = {k: free_name(docs, f"_{k}") for k in ("len", "prefix", "full", "maybe")}
    keyed = docs.withColumns({names["len"]: _length(text), names["prefix"]: _prefix(text, prefix_chars)})
    marked = flag_members(keyed, [F.col(names["len"]), F.col(names["prefix"])], bitmap, bits_log2, names["maybe"])
    return marked.withColumn(names["full"], F.when(F.col(names["maybe"]), F.sha2(normalised(text), 256))), names


def exact_groups(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept.

    ``digest`` adds ``text_sha256`` of every normalised text; without it, full
    hashes are computed for surviving groups alone.
    """
    marked, n = with_full_hash(spark, docs, text)
    columns = [F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(F.col(text)).alias("_raw"), F.col(n["len"]).alias("_len"), F.col(n["prefix"]).alias("_prefix"), F.col(n["full"]).alias("_full")]
    if digest:
        columns.append(F.coalesce(F.col(n["full"]), F.sha2(normalised(text), 256)).alias("text_sha256"))
    rows = staged(spark, marked.select(*columns), "dedup-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_raw", "_row")
    groups = rows.filter("_full is not null").groupBy("_len", "_prefix", "_full").agg(F.min(order).alias("_first"), F.count("*").alias("_size")).filter("_size > 1")
    joined = rows.join(groups, ["_len", "_prefix", "_full"], "left")
    alone = F.col("_size").isNull()
    out = [
        F.col("doc_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("_first.doc_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_first._row") == F.col("_row"))).alias("kept"),
    ]
    return joined.select(*out, *(["text_sha256"] if digest else []))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", files: bool = False) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest doc_id.

    Keys alone decide: of surviving groups, a row's number in the scan, its hash and the
    group's key are grouped, and the numbers of the rows that go are looked up in a last scan.
    No text is shuffled but those of rows that go. That takes rows that come in the same
    order each time they are read: ``docs`` is staged first, unless ``files`` says that it is a
    plain reading of files.
    """
    if not files:
        docs = staged(spark, docs, "dedup-docs")
    at = free_name(docs, "_at")
    numbered = docs.withColumn(at, F.struct(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(text)).alias("hash")))
    marked, n = with_full_hash(spark, numbered, text)
    chosen = marked.filter(n["maybe"]).select(F.col(at).alias("_at"), F.col(n["len"]).alias("_len"), F.col(n["prefix"]).alias("_prefix"), F.col(n["full"]).alias("_full"), F.col(doc_id).alias("_id"))
    rows = staged(spark, chosen, "dedup-rows")
    order = F.struct(F.col("_id").isNull(), "_id", "_at.hash", "_at.row")
    groups = rows.groupBy("_len", "_prefix", "_full").agg(F.min(order).alias("_first"), F.count("*").alias("_size")).filter("_size > 1")
    gone = rows.join(groups, ["_len", "_prefix", "_full"]).filter(F.col("_at.row") != F.col("_first.row")).select(F.col("_at").alias(at))
    return drop_keys(numbered, at, staged(spark, gone, "dedup-gone")).drop(at)
