"""Text blocks of pages: restitching, sections, boilerplate, ranges, footnotes, references.

Everything is keyed by doc_id, so that one shuffle by document serves the windows of
a whole plan; page- and line-level counts are aggregated before they are joined back.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.functions import text as tx
from folioloom.functions.geometry import in_zone

BODY_EXCLUDED = ("header", "footer", "page_number", "footnote")


def merge_flag(order: W) -> Column:
    """Whether a paragraph continues the one before it over a page break.

    Both are paragraphs, the page is the next, this one is its page's first, the text
    before doesn't end a sentence and this one starts in lower case.
    """
    text, before = F.col("text"), F.lag("text").over(order)
    return F.coalesce(
        (F.col("block_type") == "paragraph")
        & (F.lag("block_type").over(order) == "paragraph")
        & (F.col("page_num_1") == F.lag("page_num_1").over(order) + 1)
        & (F.col("reading_order") == 0)
        & ~before.rlike(r"""[.!?"')\]]\s*\z""")
        & (F.length(F.trim(before)) > 0)
        & text.rlike(r"^\s*\p{Ll}"),
        F.lit(False),
    )


def restitch(blocks: DataFrame) -> DataFrame:
    """Paragraphs that a page break cut become one.

    Input: doc_id, block_id, page_num_1, reading_order, block_type, text, and optionally
    footnote_refs (array). Adjacent original rows alone decide, so that islands of merged
    rows come from a running sum, and chains over several pages need nothing more.
    """
    order = W.partitionBy("doc_id").orderBy("page_num_1", "reading_order", "block_id")
    refs = F.col("footnote_refs") if "footnote_refs" in blocks.columns else F.array().cast("array<string>")
    flagged = blocks.withColumns({"footnote_refs": refs, "_m": merge_flag(order), "_pos": F.row_number().over(order)})
    islands = flagged.withColumn("_island", F.sum(F.when(F.col("_m"), 0).otherwise(1)).over(order))
    rows = F.array_sort(F.collect_list(F.struct("_pos", "block_id", "page_num_1", "reading_order", "block_type", "text", "footnote_refs")))
    grouped = islands.groupBy("doc_id", "_island").agg(rows.alias("r"))
    n = F.size("r")
    pieces = F.transform("r", lambda x, i: F.when(n == 1, x["text"]).when(i == 0, F.rtrim(x["text"])).when(i == n - 1, F.ltrim(x["text"])).otherwise(F.trim(x["text"])))
    return grouped.select(
        "doc_id",
        F.transform("r", lambda x: x["block_id"]).alias("block_ids"),
        F.array_min(F.transform("r", lambda x: x["page_num_1"])).alias("start_page"),
        F.array_max(F.transform("r", lambda x: x["page_num_1"])).alias("end_page"),
        F.array_join(pieces, " ").alias("text"),
        F.col("r")[0]["block_type"].alias("block_type"),
        F.col("r")[0]["reading_order"].alias("reading_order"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("r", lambda x: x["footnote_refs"])))).alias("footnote_refs"),
        F.col("r")[0]["_pos"].alias("pos"),
    )


def with_sections(blocks: DataFrame, order: list[str]) -> DataFrame:
    """``section``: how many headings a document has had up to a block."""
    w = W.partitionBy("doc_id").orderBy(*order)
    return blocks.withColumn("section", F.sum(F.when(F.col("block_type") == "heading", 1).otherwise(0)).over(w))


def article_range(blocks: DataFrame, docs: DataFrame, page: str = "start_page") -> DataFrame:
    """Blocks on the pages of their document's page_range_label; all of them where there is none."""
    ranges = docs.select("doc_id", tx.page_range(F.col("page_range_label")).alias("_r"))
    joined = blocks.join(ranges.hint("shuffle_hash"), "doc_id", "left")  # a row a document: texts aren't sorted for it
    return joined.filter(F.col("_r").isNull() | F.col(page).between(F.col("_r.first"), F.col("_r.last"))).drop("_r")


def title_trim(blocks: DataFrame, docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Blocks of a range's first page from the article's title heading on.

    The heading must share ``threshold`` of the title's words. Blocks before the first
    such heading go; the search covers the leading blocks on that page alone.
    """
    known = docs.select("doc_id", tx.page_range(F.col("page_range_label"))["first"].alias("_first"), tx.word_set(F.col("title")).alias("_title"))
    w = W.partitionBy("doc_id").orderBy("pos")
    joined = blocks.join(known.hint("shuffle_hash"), "doc_id", "left")
    share = F.size(F.array_intersect(tx.word_set(F.col("text")), F.col("_title"))) / F.size("_title")
    leading = F.coalesce(F.sum(F.when(F.col("start_page") == F.col("_first"), 0).otherwise(1)).over(w), F.lit(1)) == 0
    hit = leading & (F.col("block_type") == "heading") & (F.size("_title") > 0) & (share >= threshold)
    found = joined.withColumn("_hit", F.when(hit, F.col("pos"))).withColumn("_from", F.min("_hit").over(W.partitionBy("doc_id")))
    return found.filter(F.col("_from").isNull() | (F.col("pos") >= F.col("_from"))).drop("_first", "_title", "_hit", "_from")


def line_frequency(blocks: DataFrame, share: float = 0.3, page: str = "page_num_1", fold: bool = True) -> DataFrame:
    """doc_id, line: normalised lines that occur on max(2, share of the pages) pages or more."""
    lines = blocks.select("doc_id", page, F.explode(F.split("text", "\n")).alias("_l")).select("doc_id", page, tx.frequency_key(F.col("_l"), fold).alias("line")).filter(F.length("line") > 3)
    counted = lines.groupBy("doc_id", "line").agg(F.countDistinct(page).alias("pages"))
    pages = blocks.groupBy("doc_id").agg(F.countDistinct(page).alias("n"))
    return counted.join(pages, "doc_id").filter(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("n") * share))).select("doc_id", "line", "pages")


PLATFORMS = ("PROJECT MUSE", "JSTOR")


def boilerplate(blocks: DataFrame, heights: DataFrame | None = None, header_bottom: float = 0.10, footer_top: float = 0.80, share: float = 0.3) -> DataFrame:
    """``removed`` and the new block_type of each block.

    Zones retype blocks first (with a ``bbox`` and heights; 800 points where a height is
    missing). Then a block goes if it is a header or footer, a platform's name, or has a
    frequent line; such blocks become headers up to the page's first content and footers
    from its last on.
    """
    b = blocks
    if heights is not None and "bbox" in blocks.columns:
        b = b.join(heights.select("doc_id", "page_num_1", F.col("height").alias("_h")), ["doc_id", "page_num_1"], "left")
        height = F.coalesce("_h", F.lit(800.0))
        kept = F.col("block_type").isin("header", "footer")
        b = b.withColumn("block_type", F.when(kept, F.col("block_type")).when(in_zone(F.col("bbox"), height, 0.0, header_bottom), "header").when(in_zone(F.col("bbox"), height, footer_top, 1.0), "footer").otherwise(F.col("block_type"))).drop("_h")
    frequent = line_frequency(b, share)
    own = b.select("doc_id", "page_num_1", "block_id", F.explode(F.split("text", "\n")).alias("_l")).withColumn("line", tx.frequency_key(F.col("_l")))
    hit = own.join(frequent, ["doc_id", "line"], "left_semi").select("doc_id", "page_num_1", "block_id").distinct().withColumn("_hit", F.lit(True))
    flagged = b.join(hit, ["doc_id", "page_num_1", "block_id"], "left")
    name = F.upper(F.trim(F.regexp_replace(F.trim("text"), r"(?U)[^\w\s]", "")))
    flagged = flagged.withColumn("removed", F.coalesce("_hit", F.lit(False)) | name.isin(*PLATFORMS) | F.col("block_type").isin("header", "footer")).drop("_hit")
    page = W.partitionBy("doc_id", "page_num_1")
    content = F.when(~F.col("removed"), F.col("reading_order"))
    first, last = F.coalesce(F.min(content).over(page), F.lit(2**31 - 1)), F.coalesce(F.max(content).over(page), F.lit(-1))
    retyped = F.when(~F.col("removed") | F.col("block_type").isin("header", "footer"), F.col("block_type")).when(F.col("reading_order") <= first, "header").when(F.col("reading_order") >= last, "footer").otherwise(F.col("block_type"))
    return flagged.withColumn("block_type", retyped)


def content_area(blocks: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Per page with two body blocks or more: the 5th percentile of x0, y0 and the 95th of x1, y1."""
    body = blocks.filter(~F.col("block_type").isin("header", "footer", "page_number"))
    p = [F.percentile(F.col(f"bbox.{c}"), F.lit(q)).alias(c) for c, q in (("x0", low), ("y0", low), ("x1", high), ("y1", high))]
    return body.groupBy("doc_id", "page_num_1").agg(F.count("*").alias("n"), *p).filter("n >= 2").drop("n")


def page_offset_mode(blocks: DataFrame, page_counts: DataFrame, votes: int = 3) -> DataFrame:
    """Offset of printed page numbers, by the mode of line-ending numbers less the page.

    The second half of a document's pages votes; numbers up to twice the page count; offsets
    between -20 and 0; ties go to the offset seen first.
    """
    pages = blocks.select("doc_id", "page_num_1").distinct()
    w = W.partitionBy("doc_id").orderBy("page_num_1")
    half = pages.withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(W.partitionBy("doc_id"))}).filter(F.col("_r") >= F.floor(F.col("_n") / 2)).select("doc_id", "page_num_1")
    numbers = F.regexp_extract_all("text", F.lit(r"(?m)\b(\d{1,4})\s*$"), F.lit(1))
    voted = blocks.join(half, ["doc_id", "page_num_1"], "left_semi").select("doc_id", "page_num_1", "reading_order", F.posexplode(numbers).alias("at", "c")).join(page_counts, "doc_id")
    c = F.col("c").cast("int")
    offsets = voted.filter((c >= 1) & (c <= F.col("page_count") * 2)).withColumn("page_offset", c - F.col("page_num_1")).filter("page_offset > -20 AND page_offset < 0")
    seen = offsets.groupBy("doc_id", "page_offset").agg(F.count("*").alias("votes"), F.min(F.struct("page_num_1", "reading_order", "at")).alias("first"))
    best = W.partitionBy("doc_id").orderBy(F.desc("votes"), "first")
    return seen.withColumn("_r", F.row_number().over(best)).filter("_r = 1").filter(F.col("votes") >= votes).select("doc_id", "page_offset", "votes")


def apply_page_offset(df: DataFrame, docs: DataFrame, pages: tuple[str, ...] = ("page_num_1",)) -> DataFrame:
    """Adds each document's page_offset to a relation's page numbers; use it on every relation keyed by page."""
    joined = df.join(docs.select("doc_id", F.coalesce("page_offset", F.lit(0)).alias("_o")), "doc_id", "left")
    return joined.withColumns({p: F.col(p) + F.coalesce("_o", F.lit(0)) for p in pages}).drop("_o")


def opening_text(blocks: DataFrame, at_least: int = 50, until: int = 3000, cut: int = 3000, max_pages: int | None = None) -> DataFrame:
    """A document's first pages of ``at_least`` characters, in order, until ``until`` are gathered; cut to ``cut``."""
    page = blocks.groupBy("doc_id", "page_num_1").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"]), "\n").alias("t")).filter(F.length("t") >= at_least)
    w = W.partitionBy("doc_id").orderBy("page_num_1")
    before = F.coalesce(F.sum(F.length("t")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = page.withColumns({"_before": before, "_r": F.row_number().over(w)})
    taken = taken.filter(F.col("_r") <= max_pages) if max_pages else taken.filter(F.col("_before") < until)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num_1", "t"))), lambda x: x["t"]), "\n\n")
    return taken.groupBy("doc_id").agg(F.substring(joined, 1, cut).alias("opening"))


def page_counts(blocks: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per page: characters, blocks and, with ``images`` (doc_id, page_num_1), images; pages of either have a row."""
    key = ["doc_id", "page_num_1"]
    counted = blocks.groupBy(*key).agg(F.sum(F.length("text")).cast("long").alias("text_char_count"), F.count("*").alias("blocks"))
    if images is None:
        return counted
    j = counted.join(images.groupBy(*key).agg(F.count("*").alias("image_count")), key, "full_outer")
    return j.select(*key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("text_char_count", "blocks", "image_count")])


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper of two."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def rotation_votes(lines: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per page: share of vertical lines, and 90 or 270 degrees where it is above ``threshold``.

    Input: doc_id, page_num_1, direction (horizontal, up, down).
    """
    n, down, up = F.count("*"), F.count_if(F.col("direction") == "down"), F.count_if(F.col("direction") == "up")
    g = lines.groupBy("doc_id", "page_num_1").agg(F.round((down + up) / n, 4).alias("vertical_text_ratio"), down.alias("_d"), up.alias("_u"))
    turn = F.when(F.col("vertical_text_ratio") > threshold, F.when(F.col("_d") >= F.col("_u"), 90).otherwise(270)).otherwise(0)
    return g.withColumns({"has_vertical_text": F.col("_d") + F.col("_u") > 0, "suggested_rotation_cw": turn}).drop("_d", "_u")


_SPLIT = re.compile(r"(?:^|\.\s+)(\d{1,3})(?:\s|$)")


def split_footnotes(text: str) -> list[tuple[int, str]]:
    """(number, text) of footnotes that ran together; nothing unless two or more ascend closely."""
    t = (text or "").strip()
    marks = [(m.start(1), int(m.group(1))) for m in _SPLIT.finditer(t)]
    numbers = [n for _, n in marks]
    if len(marks) < 2 or numbers != sorted(set(numbers)) or numbers[-1] - numbers[0] >= 3 * len(numbers):
        return []
    ends = [at for at, _ in marks[1:]] + [len(t)]
    return [(n, t[at + len(str(n)) : end].strip()) for (at, n), end in zip(marks, ends, strict=True)]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("text", T.StringType())])))
def split_footnotes_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"number": n, "text": t} for n, t in split_footnotes(x)])


def footnotes(blocks: DataFrame, heights: DataFrame | None = None, top: float = 0.72) -> DataFrame:
    """Footnotes of footnote blocks, of blocks low on the page, and of full-page paragraphs that start with a number.

    Input: doc_id, block_id, page_num_1, reading_order, block_type, text. Gives doc_id,
    page_num_1, block_id, footnote_number, text, footnote_type; a block without a number gives none,
    one with nothing but its number (``5.``) does.
    """
    number = tx.footnote_number(F.col("text"), alone=True)
    is_note = F.col("block_type") == "footnote"
    b = blocks
    if heights is not None and "bbox" in blocks.columns:
        b = b.join(heights.select("doc_id", "page_num_1", F.col("width").alias("_w"), F.col("height").alias("_h")), ["doc_id", "page_num_1"], "left")
        box, h, w = F.col("bbox"), F.coalesce("_h", F.lit(800.0)), F.coalesce("_w", F.lit(612.0))
        full = (F.abs(box["x0"]) <= 2) & (F.abs(box["y0"]) <= 2) & (F.abs(box["x1"] - w) <= 2) & (F.abs(box["y1"] - h) <= 2)
        is_note = is_note | (in_zone(box, h, top, 1.0) & number.isNotNull()) | ((F.col("block_type") == "paragraph") & full & number.isNotNull())
    found = b.filter(is_note).withColumn("_many", split_footnotes_udf("text"))
    one = F.array(F.struct(number.alias("number"), F.trim("text").alias("text")))
    each = found.withColumn("_n", F.explode(F.when(F.size("_many") > 0, F.col("_many")).otherwise(one))).filter("_n.number IS NOT NULL")
    return each.select("doc_id", "page_num_1", "block_id", F.col("_n.number").alias("footnote_number"), F.col("_n.text").alias("text"), tx.footnote_type(F.col("_n.text")).alias("footnote_type"), "reading_order")


def link_refs(blocks: DataFrame, notes: DataFrame, around: int | None = 20) -> DataFrame:
    """References in body blocks to footnotes: the same page's first, else the document's (``_xpage``).

    The last of several footnotes with a number wins. One row per block and number, the
    first by pattern and place, with up to ``around`` characters of text on both sides; None leaves the snippet out.
    """
    body = blocks.filter(~F.col("block_type").isin("footnote", "header", "footer"))
    found = body.select("doc_id", "page_num_1", F.col("block_id").alias("parent_block_id"), F.explode(tx.find_refs(F.col("text"), around)).alias("r")).select("doc_id", "page_num_1", "parent_block_id", F.col("r.number").alias("footnote_number"), F.col("r.match_type").alias("match_type"), F.col("r.pattern_no").alias("_p"), F.col("r.match_no").alias("_m"), F.col("r.snippet").alias("context_snippet"))
    key = F.struct("page_num_1", "reading_order", "footnote_id")
    here = notes.groupBy("doc_id", "page_num_1", "footnote_number").agg(F.max_by("footnote_id", key).alias("_here"))
    anywhere = notes.groupBy("doc_id", "footnote_number").agg(F.max_by("footnote_id", key).alias("_any"))
    joined = found.join(here, ["doc_id", "page_num_1", "footnote_number"], "left").join(anywhere, ["doc_id", "footnote_number"], "inner")
    typed = joined.withColumns({"footnote_id": F.coalesce("_here", "_any"), "match_type": F.when(F.col("_here").isNull(), F.concat("match_type", F.lit("_xpage"))).otherwise(F.col("match_type"))})
    first = W.partitionBy("doc_id", "parent_block_id", "footnote_number").orderBy("_p", "_m")
    return typed.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("doc_id", "page_num_1", "parent_block_id", "footnote_number", "footnote_id", "match_type", "context_snippet")


def block_refs(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """``blocks`` with ``footnote_refs``: the distinct ids of the footnotes that a block refers to, sorted."""
    by = refs.filter("footnote_id IS NOT NULL AND parent_block_id IS NOT NULL").groupBy("doc_id", F.col("parent_block_id").alias("block_id")).agg(F.array_sort(F.collect_set("footnote_id")).alias("_ids"))
    # joined by document alone, so that texts are shuffled once, for the windows over documents as well
    own = by.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("block_id", "_ids"))).alias("_own"))
    return blocks.drop("footnote_refs").join(own, "doc_id", "left").withColumn("footnote_refs", F.coalesce(F.try_element_at("_own", F.col("block_id")), F.array().cast("array<string>"))).drop("_own")


def refer(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """``blocks`` with ``footnote_refs``, as ``block_refs`` of ``link_refs`` has them; ``notes`` has footnote_id.

    Numbers are found where a block is read, and looked up in its document's footnotes: blocks are read once, and their
    texts shuffled for nothing but the windows over documents.
    """
    body = ~F.col("block_type").isin("footnote", "header", "footer")
    # a reference has a digit, which few blocks have: the others' texts aren't sent to Python
    found = tx.find_refs(F.when(body & F.col("text").rlike("[0-9]"), F.col("text")), None)
    numbered = blocks.drop("footnote_refs").withColumn("_numbers", F.array_distinct(F.transform(found, lambda r: r["number"])))
    key = F.struct("page_num_1", "reading_order", "footnote_id")
    here = notes.repartition("doc_id").groupBy("doc_id", "page_num_1", "footnote_number").agg(F.max(key).alias("_last"))
    both = here.withColumn("_any", F.max("_last").over(W.partitionBy("doc_id", "footnote_number")))
    place = F.struct(F.col("page_num_1").alias("page"), F.col("footnote_number").alias("number"))
    own = both.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("page_num_1").isNotNull(), F.struct(place, F.col("_last.footnote_id"))))).alias("_here"),
        F.map_from_entries(F.collect_set(F.struct("footnote_number", F.col("_any.footnote_id")))).alias("_all"),
    )
    ids = F.transform("_numbers", lambda n: F.coalesce(F.try_element_at("_here", F.struct(F.col("page_num_1").alias("page"), n.alias("number"))), F.try_element_at("_all", n)))
    return numbered.join(own.hint("shuffle_hash"), "doc_id", "left").withColumn("footnote_refs", F.array_sort(F.array_distinct(F.array_compact(ids)))).drop("_numbers", "_here", "_all")


def mark_refs(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """``text`` with ``[ref:N]`` marks for linked superscript references."""
    by = refs.groupBy("doc_id", F.col("parent_block_id").alias("block_id")).agg(F.collect_list(F.struct("match_type", F.col("footnote_number").alias("number"))).alias("_refs"))
    joined = blocks.join(by, ["doc_id", "block_id"], "left")
    return joined.withColumn("text", F.when(F.col("_refs").isNull(), F.col("text")).otherwise(tx.ref_markup(F.col("text"), F.col("_refs")))).drop("_refs")


def parse_markdown(pages: DataFrame) -> DataFrame:
    """Blocks of pages in Markdown (doc_id, page_num_1, markdown): block_type, text, reading_order, figure.

    Text below the first rule is footnotes, a line each. Image tags give rows with
    ``figure`` and no text; descriptions of blank pages are dropped.
    """
    parts = F.split("markdown", r"\n---+\n", 2)
    body = pages.select("doc_id", "page_num_1", F.posexplode(F.split(parts[0], r"\n{2,}")).alias("at", "p"), F.lit(0).alias("part"))
    notes = pages.select("doc_id", "page_num_1", F.posexplode(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "\n")).alias("at", "p"), F.lit(1).alias("part"))
    rows = body.unionByName(notes).withColumn("p", tx.strip(F.col("p"))).filter(F.length("p") > 0)
    p = F.col("p")
    image = r"^!\[([^\]]*)\]\(([^)]*)\)\s*\z"
    is_image = (F.col("part") == 0) & p.rlike(image)
    described = F.regexp_extract(p, image, 2)
    figure = F.when(is_image, F.when(described != "", described).otherwise(F.regexp_extract(p, image, 1)))
    kind = F.when(F.col("part") == 1, "footnote").when(p.startswith("#"), "heading").when(p.startswith(">"), "paragraph").when(p.rlike(r"^([-*]|\d+\.)\s+"), "list_item").otherwise("paragraph")
    t = F.when(kind == "heading", F.regexp_replace(p, r"^#+\s*", "")).when(p.startswith(">") & (F.col("part") == 0), F.regexp_replace(p, r"(?m)^>\s*", "")).otherwise(p)
    t = F.regexp_replace(t, r"\^(\d+)", "<sup>$1</sup>")
    typed = rows.withColumns({"figure": figure, "block_type": F.when(~is_image, kind), "text": F.when(~is_image, t)})
    kept = typed.filter((F.col("text").isNotNull() & (F.length(F.trim("text")) > 0)) | ((F.col("figure") != "") & ~F.col("figure").rlike(r"(?i)\bblank\b")))
    order = W.partitionBy("doc_id", "page_num_1").orderBy("part", "at")
    count = F.sum(F.when(F.col("text").isNotNull(), 1).otherwise(0)).over(order)
    return kept.withColumn("reading_order", F.when(F.col("text").isNotNull(), count - 1)).select("doc_id", "page_num_1", "block_type", "text", "reading_order", "figure")
