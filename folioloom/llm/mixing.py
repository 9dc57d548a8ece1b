"""Mixing sources to target weights by systematic sampling.

Within its source, each document has the same expected number of copies e:
the source's target over its words. With documents in a fixed order, the prefix
sum of expected copies at place r is e * r. One offset u in [0, 1) per source is
added, and a document is emitted once for every integer that its step crosses:
floor(e * r + u) - floor(e * (r - 1) + u) copies. Ordering by size makes a
systematic sample follow the sizes closely, so the words taken come near the target.

Targets share the words of all sources by weight; none is above ``cap`` times its
source, and what is above is shared again by weight among the rest until none is.

Places are global: rows are range partitioned by (source, size, doc_id, hash of the text),
which splits a hot source over many partitions, staged once, and numbered by partition
offsets. Only these are shuffled for that; words are counted once.

Defined results: a null text has size 0; null is a source of its own, last in
order; rows that repeat source, size and doc_id are ordered by a hash of their text, equal rows are interchangeable; documents of size 0 get copies like others and take no words; a source
without words has target 0 and no copies; an empty table gives an empty result.
Reruns agree: order, offset and targets depend on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm.common import free_name, input_partitions, word_count
from folioloom.session import staged

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def offset(source: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) per source: the first 32 bits of an MD5."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: source_size, source_rows, target. ``sizes`` has source, size; one row a source remains.

    The weights follow the sources' order and the level follows from all of them, so that one
    task sorts those rows, of some 50 bytes each: millions of sources are no burden to it.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    everything = W.partitionBy()
    place = W.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n + 1).cast("int")).cast("long")
    limit = F.col("source_size") * cap
    ranked = by.withColumn("_w", weight).withColumns({"_cap": limit, "_all": F.sum("source_size").over(everything), "_weights": F.sum("_w").over(everything)})
    before = W.orderBy((F.col("_cap").cast("double") / F.col("_w")), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = ranked.withColumns({"_words": F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_rest": F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0))})
    full = F.col("_cap") * F.col("_rest") <= F.col("_words") * F.col("_w")
    level = left.withColumn("_full", full)
    open_ = F.when(~F.col("_full"), F.struct((F.col("_cap").cast("double") / F.col("_w")).alias("r"), "_words", "_rest"))
    found = level.withColumn("_level", F.min(open_).over(everything))
    share = (F.col("_level._words") * F.col("_w")).cast("double") / F.col("_level._rest").cast("double")
    return found.select("source", "source_size", "source_rows", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(share).alias("target"))


def copies(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(text)).alias("_hash"))
    return _numbered(spark, staged(spark, sizes, "mix-sizes"), weights, cap, seed)


def _numbered(spark: SparkSession, sizes: DataFrame, weights: tuple[int, ...], cap: int, seed: str, also: tuple[str, ...] = ()) -> DataFrame:
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc_nulls_first(), F.col("_hash").asc()]
    dealt = sizes.repartitionByRange(input_partitions(spark), *order).sortWithinPartitions(*order)
    rows = staged(spark, dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "mix-rows")
    parts = rows.groupBy("source", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    known = parts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    targets = source_targets(rows.select("source", "size"), weights, cap)
    # one row for each source and partition that holds a part of it, of a size that adaptive execution checks
    about = known.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select(F.col("p.source").alias("_s"), F.col("p._part").alias("_p"), "_first", "_before", "source_size", "target")
    joined = rows.join(about, (F.col("source").eqNullSafe(F.col("_s"))) & (F.col("_part") == F.col("_p")), "inner")
    rank = F.col("_at") - F.col("_first") + F.col("_before") + 1
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    crossed = F.floor(each * rank.cast("double") + u) - F.floor(each * (rank - 1).cast("double") + u)
    return joined.select("doc_id", "source", "size", "source_size", "target", crossed.cast("int").alias("copies"), *also)


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, files: bool = False) -> DataFrame:
    """The mixture: each row of ``docs`` as often as it is emitted, with all its columns.

    Places are found on sizes alone; rows then get their copies by a join on their number
    in the scan and a hash of their text, which spreads long texts evenly. That takes rows
    that are the same, in the same order, each time they are read: ``docs`` is staged
    first, unless ``files`` says that it is a plain reading of files. Where that isn't
    so, the job fails rather than lose rows.
    """
    if not files:
        docs = staged(spark, docs, "mix-docs")
    row, hash_ = free_name(docs, "_row"), free_name(docs, "_hash")
    marked = docs.withColumns({row: F.monotonically_increasing_id(), hash_: F.xxhash64(F.col(text))})
    sizes = marked.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.col(row).alias("_row"), F.col(hash_).alias("_hash"))
    counted = _numbered(spark, staged(spark, sizes, "mix-sizes"), weights, cap, seed, ("_row", "_hash"))
    n, copy = free_name(docs, "_copies"), free_name(docs, "_copy")
    found = staged(spark, counted.select(F.col("_row").alias(row), F.col("_hash").alias(hash_), F.col("copies").alias(n)), "mix-copies")
    joined = marked.join(found, [row, hash_], "left")
    sure = F.coalesce(F.col(n), F.raise_error(F.lit("the documents to mix changed between two readings")).cast("int"))
    taken = joined.withColumn(n, sure).filter(F.col(n) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH s AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), b AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5, 2, 1], (((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1)::INT)::BIGINT AS w
  FROM s GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS words, sum(w) OVER () AS weights FROM b
), d AS (
  SELECT *, cap::DOUBLE / w AS r,
         (words - coalesce(sum(cap) OVER p, 0))::BIGINT AS left_words, (weights - coalesce(sum(w) OVER p, 0))::BIGINT AS left_weights
  FROM c WINDOW p AS (ORDER BY cap::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT *, cap * left_weights <= left_words * w AS is_full FROM d
), f AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN cap::DOUBLE
              ELSE ((SELECT arg_min(left_words, r) FROM e WHERE NOT is_full) * w)::DOUBLE / (SELECT arg_min(left_weights, r) FROM e WHERE NOT is_full)::DOUBLE END AS target
  FROM e
), g AS (
  SELECT s.doc_id, s.size, f.source_size, f.target,
         row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) AS r,
         CASE WHEN f.source_size > 0 THEN f.target / f.source_size::DOUBLE ELSE 0.0 END AS e,
         ('0x' || substr(md5('mix-1|' || coalesce('s' || s.source, 'null')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM s JOIN f ON s.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target, ((floor(e * r + u) - floor(e * (r - 1) + u))::BIGINT * size)::BIGINT AS taken FROM g
"""
