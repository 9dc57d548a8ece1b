"""Figures: eligibility, captions, plates, superscript spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_SIDE = 150


def is_substantial() -> Column:
    """Whether a figure (derived_from, caption_text_clean, page_num_1, bbox) goes into the index."""
    bare = F.length(F.coalesce("caption_text_clean", F.lit(""))) == 0
    box = F.col("bbox")
    large = (box["x1"] - box["x0"] >= LEAST_SIDE) & (box["y1"] - box["y0"] >= LEAST_SIDE)
    origin = F.coalesce("derived_from", F.lit(""))
    return F.when(origin == "rendered_clip", False).when((origin == "vl_detected_scan") & bare, False).when((F.col("page_num_1") == 1) & bare, False).when(box.isNull(), True).otherwise(large)


def eligible_images(images: DataFrame, pages: DataFrame, background: float = 0.90, textless: float = 0.70, least: int = 20, aspect: float = 20.0) -> DataFrame:
    """Images that may be figures.

    ``images``: doc_id, page_num_1, image_id, bbox, width, height (pixels). ``pages``: doc_id,
    page_num_1, width, height, spans. Images that cover most of a page are scans' backgrounds;
    tiny and very long ones are ornaments.
    """
    j = images.join(pages.select("doc_id", "page_num_1", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("spans").alias("_s")), ["doc_id", "page_num_1"], "left")
    box = F.col("bbox")
    share = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) / (F.col("_w") * F.col("_h"))
    cover = share >= F.when(F.coalesce("_s", F.lit(0)) == 0, textless).otherwise(background)
    tiny = (F.col("width") <= least) & (F.col("height") <= least)
    long_ = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1)) > aspect
    return j.filter(~F.coalesce(cover, F.lit(False)) & ~tiny & ~long_).drop("_w", "_h", "_s")


def scans_to_render(images: DataFrame, pages: DataFrame, blocks: DataFrame, described: DataFrame, background: float = 0.90, textless: float = 0.70, most_text: int = 100) -> DataFrame:
    """Pages whose scan is itself a figure, each once: doc_id, page_num_1.

    Those that a page reader has ``described`` (doc_id, page_num_1) as having a figure, that
    have a background scan but no image that is smaller, no text spans, and less than
    ``most_text`` characters of blocks (text_raw).
    """
    key = ["doc_id", "page_num_1"]
    known = pages.select(*key, F.col("width").alias("_w"), F.col("height").alias("_h"), F.coalesce("spans", F.lit(0)).alias("_s"))
    box = F.col("bbox")
    cover = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"]) >= F.when(F.col("_s") == 0, textless).otherwise(background) * F.col("_w") * F.col("_h")
    per = images.join(known, key).filter(F.col("_w") * F.col("_h") > 0).groupBy(*key).agg(F.max(F.when(cover, 1).otherwise(0)).alias("scan"), F.max(F.when(cover, 0).otherwise(1)).alias("real"), F.max("_s").alias("spans"))
    wordy = blocks.groupBy(*key).agg(F.sum(F.length("text_raw")).alias("_n")).filter(F.col("_n") >= most_text)
    bare = per.filter("scan = 1 AND real = 0 AND spans = 0").select(*key)
    return bare.join(described.select(*key).distinct(), key, "left_semi").join(wordy, key, "left_anti")


def captions(figures: DataFrame, lines: DataFrame, reach: float = 50.0, most: int = 4) -> DataFrame:
    """Up to ``most`` text lines below each figure, above the next one, as its caption.

    ``figures``: doc_id, page_num_1, figure_id, bbox. ``lines``: doc_id, page_num_1, bbox, text.
    """
    w = W.partitionBy("doc_id", "page_num_1").orderBy("bbox.y0", "figure_id")
    f = figures.select("doc_id", "page_num_1", "figure_id", F.col("bbox").alias("_f"), F.lead("bbox.y0").over(w).alias("_next"))
    j = f.join(lines.select("doc_id", "page_num_1", F.col("bbox").alias("_l"), "text"), ["doc_id", "page_num_1"])
    gap = F.col("_l.y0") - F.col("_f.y1")
    near = gap.between(0, reach) & (F.least("_l.x1", "_f.x1") - F.greatest("_l.x0", "_f.x0") >= 0) & (F.col("_next").isNull() | (F.col("_l.y0") < F.col("_next")))
    best = W.partitionBy("figure_id").orderBy("_l.y0", "_l.x0", "text")
    top = j.filter(near).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= most)
    return top.groupBy("doc_id", "page_num_1", "figure_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]), " ").alias("caption"))


def plates(figures: DataFrame) -> DataFrame:
    """Pages with a caption that starts with ``plate``: its label (the last such caption's) and the page's figures."""
    label = F.when(F.col("caption").rlike(r"(?i)^\s*plate\b"), F.regexp_extract("caption", r"(?i)^\s*(plate\s+[\w-]+)", 1))
    g = figures.withColumn("_p", label).groupBy("doc_id", "page_num_1").agg(F.max_by("_p", F.when(F.col("_p").isNotNull(), F.col("figure_id"))).alias("plate_label"), F.array_sort(F.collect_list("figure_id")).alias("figure_ids"))
    return g.filter("plate_label IS NOT NULL")


def superscript_refs(spans: DataFrame, blocks: DataFrame, slack: float = 5.0, ratio: float = 0.7) -> DataFrame:
    """Digits set smaller than ``ratio`` of their block's (upper) median size, within ``slack`` points of it."""
    from folioloom.functions.geometry import contains
    from folioloom.operators.blocks import upper_median

    inside = spans.select("doc_id", "page_num_1", "text", "font_size", F.col("bbox").alias("_s")).join(blocks.select("doc_id", "page_num_1", "block_id", F.col("bbox").alias("_b")), ["doc_id", "page_num_1"]).filter(contains(F.col("_b"), F.col("_s"), slack))
    median = inside.groupBy("doc_id", "page_num_1", "block_id").agg(upper_median(F.collect_list("font_size")).alias("_m"))
    j = inside.join(median, ["doc_id", "page_num_1", "block_id"])
    return j.filter(F.col("text").rlike(r"^\s*\d{1,3}\s*\z") & (F.col("font_size") < ratio * F.col("_m"))).select("doc_id", "page_num_1", "block_id", F.trim("text").cast("int").alias("footnote_number"))


def group_lines(spans: Column, share: float = 0.5) -> Column:
    """Spans (x0, y0, y1, text), in order, as lines: a new one where y0 is off the line's first by half a height."""
    kind = "array<struct<y0:double,text:string>>"
    start = F.array().cast(kind)

    # the spans of one page, a bounded few hundred
    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        new = last.isNull() | (F.abs(s["y0"] - last["y0"]) >= share * (s["y1"] - s["y0"]))
        grown = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["y0"].alias("y0"), F.concat_ws(" ", last["text"], s["text"]).alias("text"))))
        return F.when(new, F.concat(acc, F.array(F.struct(s["y0"].alias("y0"), s["text"].alias("text"))))).otherwise(grown)

    return F.transform(F.aggregate(spans, start, step), lambda x: x["text"])


def fill_pages(extracted: DataFrame, pages: DataFrame, width: float = 612.0, height: float = 792.0) -> DataFrame:
    """Page records for all pages in either relation, with default sizes where none is known."""
    keys = extracted.select("doc_id", "page_num_1").distinct()
    return keys.join(pages, ["doc_id", "page_num_1"], "full_outer").withColumns({"width": F.coalesce("width", F.lit(width)), "height": F.coalesce("height", F.lit(height))})
