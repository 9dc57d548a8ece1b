"""Chunks of a document's blocks: sections, greedy packing, overlap, inlined footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.functions import ids
from folioloom.functions import text as tx
from folioloom.operators.blocks import BODY_EXCLUDED, with_sections

MAX_TOKENS = 512
OVERLAP_TOKENS = 64


def group_starts(tokens: Column, max_tokens: int, heading: Column | None = None) -> Column:
    """Where groups of an array of token counts begin (from 0), packed greedily up to ``max_tokens``.

    With a heading held, a first block that is too long leaves it alone in group 0, which is
    then empty: it begins at 0, as group 1 does. Only the beginnings are gathered, so that a
    section's length doesn't count squared.
    """
    held = F.coalesce(heading, F.lit(False)) if heading is not None else F.lit(False)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("used"), held.alias("held"), F.array(F.lit(0)).alias("out"))

    def step(acc: Column, t: Column) -> Column:
        over = acc["held"] & (acc["used"] + t > max_tokens)
        used = F.when(over, t.cast("long")).otherwise(acc["used"] + t).cast("long")
        return F.struct((acc["i"] + 1).alias("i"), used.alias("used"), F.lit(True).alias("held"), F.when(over, F.concat(acc["out"], F.array(acc["i"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def raw_chunks(blocks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, section, part and their blocks: the greedy chunks before overlap and footnotes.

    Input: doc_id, pos, block_type, text, block_ids, start_page, end_page, footnote_refs.
    """
    body = with_sections(blocks.filter(~F.col("block_type").isin(*BODY_EXCLUDED)), ["pos"])
    row = F.struct("pos", "text", "block_ids", "start_page", "end_page", "footnote_refs", tx.estimate_tokens(F.col("text")).alias("tokens"))
    heading = F.col("block_type") == "heading"
    sections = body.groupBy("doc_id", "section").agg(F.max(F.when(heading, row)).alias("heading"), F.array_sort(F.collect_list(F.when(~heading, row))).alias("rows"))
    starts = group_starts(F.transform("rows", lambda r: r["tokens"]), max_tokens, F.col("heading").isNotNull())
    bounded = sections.withColumn("at", F.concat(starts, F.array(F.size("rows"))))
    # each part takes its own slice along, and the one before for the overlap, never the section's rows
    cut = lambda k: F.slice("rows", F.get("at", k) + 1, F.get("at", k + 1) - F.get("at", k))
    none = F.slice("rows", 1, 0)
    parts = F.transform(F.sequence(F.lit(0), F.size("at") - 2), lambda k: F.struct(k.alias("part"), cut(k).alias("rows"), F.when(k > 0, cut(k - 1)).otherwise(none).alias("before")))
    return bounded.select("doc_id", "section", "heading", F.explode(parts).alias("p")).select("doc_id", "section", "p.part", "heading", "p.rows", "p.before")


def overlap_tail(rows: Column, limit: int = OVERLAP_TOKENS) -> Column:
    """The last rows whose tokens stay within ``limit``; the very last always."""
    if limit <= 0:
        return F.slice(rows, 1, 0)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def step(acc: Column, r: Column) -> Column:
        full = acc["full"] | ((acc["used"] + r["tokens"] > limit) & (acc["n"] > 0))
        return F.struct(F.when(full, acc["used"]).otherwise(acc["used"] + r["tokens"]).alias("used"), F.when(full, acc["n"]).otherwise(acc["n"] + 1).alias("n"), full.alias("full"))

    n = F.aggregate(F.reverse(rows), start, step, lambda acc: acc["n"])
    return F.slice(rows, F.size(rows) - n + 1, n)


def merge_small(raw: DataFrame, min_tokens: int) -> DataFrame:
    """Chunks below ``min_tokens`` join the one before; their overlap goes, and their heading if that has one."""
    w = W.partitionBy("doc_id").orderBy("section", "part")
    tokens = F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["tokens"])
    own = raw.withColumns({"_r": F.row_number().over(w), "_t": tokens})
    island = own.withColumn("_i", F.sum(F.when((F.col("_r") > 1) & (F.col("_t") < min_tokens), 0).otherwise(1)).over(w))
    g = island.groupBy("doc_id", "_i").agg(F.min("section").alias("section"), F.min(F.struct("section", "part"))["part"].alias("part"), F.array_sort(F.collect_list(F.struct("_r", "heading", "title", "rows", "tail"))).alias("c"))
    first = F.col("c")[0]
    with_heading = F.filter("c", lambda x: x["title"].isNotNull())
    return g.select("doc_id", "section", "part", F.get(with_heading, F.lit(0))["heading"].alias("heading"), F.get(with_heading, F.lit(0))["title"].alias("title"), F.flatten(F.transform("c", lambda x: x["rows"])).alias("rows"), first["tail"].alias("tail"))


def chunks(blocks: DataFrame, footnotes: DataFrame | None = None, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, min_tokens: int = 0) -> DataFrame:
    """Final chunks: chunk_id, doc_id, chunk_index, pages, section_heading, text, block_ids, token_count.

    A continuation has its section's heading text but not the heading's id or page.
    ``footnotes`` (doc_id, footnote_id, footnote_number, text, footnote_type) are inlined in order of id.
    """
    raw = raw_chunks(blocks, max_tokens)
    title = F.trim(F.col("heading.text"))
    own = raw.withColumns({"title": title, "tail": overlap_tail(F.col("before"), overlap)})
    own = own.withColumn("heading", F.when(F.col("part") == 0, F.col("heading")))
    if min_tokens > 0:
        own = merge_small(own, min_tokens)
    numbered = own.withColumn("chunk_index", F.row_number().over(W.partitionBy("doc_id").orderBy("section", "part")) - 1)
    ref_ids = F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["footnote_refs"]))))
    numbered = numbered.withColumn("refs", ref_ids)
    if footnotes is not None:
        n = footnotes.select("doc_id", F.col("footnote_id").alias("_f"), F.struct(F.concat(F.lit("["), F.col("footnote_number").cast("string"), F.lit("] "), F.when(F.col("footnote_type").isin("citation", "mixed"), "[cites:] ").otherwise(""), F.trim("text")).alias("_line")).alias("_n"))
        # joined by document alone: chunks lie so already, and are neither made twice nor shuffled for it
        lines = n.repartition("doc_id").groupBy("doc_id", "_f").agg(F.array_sort(F.collect_list("_n")).alias("_n")).filter("_f IS NOT NULL")
        by = lines.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("_f", "_n"))).alias("_lines"))
        own_lines = F.transform(F.flatten(F.array_compact(F.transform("refs", lambda f: F.try_element_at("_lines", f)))), lambda x: x["_line"])
        numbered = numbered.join(by.hint("shuffle_hash"), "doc_id", "left").withColumn("notes", own_lines).drop("_lines")
    else:
        numbered = numbered.withColumn("notes", F.lit(None).cast("array<string>"))
    both = F.concat("tail", "rows")
    head = F.when(F.col("title").isNotNull() & (F.col("title") != ""), F.array(F.col("title"), F.lit(""))).otherwise(F.array().cast("array<string>"))
    tail = F.when(F.size("notes") > 0, F.concat(F.array(F.lit(""), F.lit("---"), F.lit("Footnotes:")), F.col("notes"))).otherwise(F.array().cast("array<string>"))
    body = tx.strip(F.array_join(F.concat(head, F.transform(both, lambda r: r["text"]), tail), "\n"))
    pages = F.concat(F.transform(both, lambda r: r["start_page"]), F.when(F.col("heading").isNotNull(), F.array(F.col("heading.start_page"))).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.transform(both, lambda r: r["end_page"]), F.when(F.col("heading").isNotNull(), F.array(F.col("heading.end_page"))).otherwise(F.array().cast("array<int>")))
    blocks_ = F.concat(F.coalesce(F.col("heading.block_ids"), F.array().cast("array<string>")), F.flatten(F.transform("rows", lambda r: r["block_ids"])))
    return numbered.withColumn("_body", body).select(
        ids.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.coalesce(F.array_min(pages), F.lit(1)).alias("start_page"),
        F.coalesce(F.array_max(ends), F.lit(1)).alias("end_page"),
        F.col("title").alias("section_heading"),
        F.col("_body").alias("text"),
        blocks_.alias("block_ids"),
        tx.estimate_tokens(F.col("_body")).alias("token_count"),
    )


def chunk_plan(made: DataFrame) -> DataFrame:
    """A dry run's rows: pages, heading, tokens, number of blocks and the first 80 characters."""
    return made.select("doc_id", "chunk_index", "start_page", "end_page", "section_heading", "token_count", F.size("block_ids").alias("n_blocks"), F.substring(F.regexp_replace("text", "\n", " "), 1, 80).alias("preview"))
