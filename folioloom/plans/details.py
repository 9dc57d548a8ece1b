"""Queries of smaller operators: geometry, figures, captions, spans, names, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import geometry as geo
from folioloom.functions import text as tx
from folioloom.operators import blocks as bl
from folioloom.operators import chunking as ch
from folioloom.operators import figures as fg
from folioloom.operators import index as ix
from folioloom.plans import views as v


def _box(x0: Column, y0: Column, w: Column, h: Column) -> Column:
    x, y = x0.cast("double"), y0.cast("double")
    return F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))


def geometry(spark: SparkSession, d: str) -> DataFrame:
    """Two boxes per block: overlap, containment, zone and distance."""
    p = F.col("pos")
    a, b = _box(p * 37 % 100, p * 91 % 300, F.lit(80.0), F.lit(40.0)), _box(p * 53 % 100, p * 17 % 300, F.lit(50.0), F.lit(30.0))
    x = v.blocks(spark, d).select("block_id", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    return x.select("block_id", F.round(geo.overlap(a, b), 9).alias("overlap"), geo.contains(a, b, 5.0).alias("contained"), geo.in_zone(a, F.lit(300.0), 0.0, 0.1).alias("header"), geo.vertical_distance(a, b).alias("distance"))


_GEOMETRY_SQL = (
    v.with_views("words", "v_blocks")
    + """, g AS (SELECT block_id, (pos * 37 % 100)::DOUBLE AS ax, (pos * 91 % 300)::DOUBLE AS ay, (pos * 53 % 100)::DOUBLE AS bx, (pos * 17 % 300)::DOUBLE AS b_y FROM v_blocks),
o AS (SELECT *, greatest(0.0, least(ax + 80, bx + 50) - greatest(ax, bx)) * greatest(0.0, least(ay + 40, b_y + 30) - greatest(ay, b_y)) AS common FROM g)
SELECT block_id, round(common / (80 * 40 + 50 * 30 - common), 9) AS overlap, bx >= ax - 5 AND b_y >= ay - 5 AND bx + 50 <= ax + 85 AND b_y + 30 <= ay + 45 AS contained, (ay + 20) / 300 BETWEEN 0 AND 0.1 AS header, b_y - (ay + 40) AS distance FROM o"""
)


def eligible_images(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d)
    p = F.col("pos")
    images = b.select("doc_id", "page_num_1", F.col("block_id").alias("image_id"), _box(F.lit(0), F.lit(0), (p * 41 % 613).cast("double"), (p * 67 % 793).cast("double")).alias("bbox"), (p * 7 % 90 + 1).cast("int").alias("width"), (p * 13 % 70 + 1).cast("int").alias("height"))
    pages = b.groupBy("doc_id", "page_num_1").agg(F.count("*").alias("n")).select("doc_id", "page_num_1", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.when(F.col("page_num_1") % 3 == 0, 0).otherwise(5).alias("spans"))
    return fg.eligible_images(images, pages).select("image_id")


_IMAGES_SQL = (
    v.with_views("words", "v_blocks")
    + """, i AS (SELECT block_id, page_num_1, (pos * 41 % 613) * (pos * 67 % 793) / (612.0 * 792.0) AS share, pos * 7 % 90 + 1 AS w, pos * 13 % 70 + 1 AS h FROM v_blocks)
SELECT block_id AS image_id FROM i WHERE NOT share >= CASE WHEN page_num_1 % 3 = 0 THEN 0.7 ELSE 0.9 END AND NOT (w <= 20 AND h <= 20) AND NOT greatest(w, h) / least(w, h)::DOUBLE > 20"""
)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("pos")
    return v.blocks(spark, d).select("doc_id", "page_num_1", "block_id", "pos", _box(p * 29 % 90, p * 43 % 240, F.lit(60.0), F.lit(10.0)).alias("bbox"), F.concat(F.when(p % 2 == 0, "Plate ").otherwise("Line "), p.cast("string"), F.lit(" x")).alias("text"))


def captions(spark: SparkSession, d: str) -> DataFrame:
    """Figures of pages (one a page, and a second on some), with the lines just below them."""
    x = _lines(spark, d)
    figs = x.filter("pos % 3 = 0").select("doc_id", "page_num_1", F.col("block_id").alias("figure_id"), F.col("bbox"))
    return fg.captions(figs, x.filter("pos % 3 <> 0"), most=2).select("figure_id", "caption")


_LINES = "l AS (SELECT doc_id, page_num_1, block_id, pos, (pos * 29 % 90)::DOUBLE AS x0, (pos * 43 % 240)::DOUBLE AS y0, CASE WHEN pos % 2 = 0 THEN 'Plate ' ELSE 'Line ' END || pos || ' x' AS text FROM v_blocks)"

_CAPTIONS = (
    _LINES
    + """, f AS (SELECT *, lead(y0) OVER (PARTITION BY doc_id, page_num_1 ORDER BY y0, block_id) AS below FROM l WHERE pos % 3 = 0),
j AS (SELECT f.doc_id, f.page_num_1, f.block_id AS figure_id, l.text, row_number() OVER (PARTITION BY f.block_id ORDER BY l.y0, l.x0, l.text) AS r FROM f JOIN l ON l.doc_id = f.doc_id AND l.page_num_1 = f.page_num_1 AND l.pos % 3 <> 0
  WHERE l.y0 - (f.y0 + 10) BETWEEN 0 AND 50 AND least(l.x0 + 60, f.x0 + 60) - greatest(l.x0, f.x0) >= 0 AND (f.below IS NULL OR l.y0 < f.below)),
c AS (SELECT doc_id, page_num_1, figure_id, string_agg(text, ' ' ORDER BY r) AS caption FROM j WHERE r <= 2 GROUP BY ALL)"""
)


def plates(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    figs = x.filter("pos % 3 = 0").select("doc_id", "page_num_1", F.col("block_id").alias("figure_id"), F.col("bbox"))
    p = fg.plates(fg.captions(figs, x.filter("pos % 3 <> 0"), most=2))
    return p.select("doc_id", "page_num_1", "plate_label", F.array_join("figure_ids", ",").alias("figure_ids"))


def superscript_spans(spark: SparkSession, d: str) -> DataFrame:
    """Four spans a block, the last a small number."""
    b = v.blocks(spark, d).withColumn("bbox", _box(F.lit(0), F.col("reading_order") * 100, F.lit(500.0), F.lit(90.0)))
    s = b.select("doc_id", "page_num_1", "pos", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "reading_order")
    spans = s.select("doc_id", "page_num_1", F.when(F.col("k") == 3, (F.col("pos") % 99 + 1).cast("string")).otherwise("word").alias("text"), F.when(F.col("k") == 3, 4.0 + F.col("pos") % 8).otherwise(10.0).alias("font_size"), _box(F.col("k") * 20, F.col("reading_order") * 100 + 5, F.lit(10.0), F.lit(8.0)).alias("bbox"))
    return fg.superscript_refs(spans, b).select("block_id", "footnote_number")


def names(spark: SparkSession, d: str) -> DataFrame:
    """Names of files, assets, societies and types, and hints in descriptions."""
    i = F.col("doc_id")
    n = i.cast("string")
    x = v.docs(spark, d)
    file = F.when(i % 2 == 0, F.concat(F.lit("Azmi & Co (19"), F.lpad((i % 100).cast("string"), 2, "0"), F.lit(") x.pdf"))).otherwise(F.concat(F.lit("plain-"), n))
    asset = F.when(i % 2 == 0, F.concat(F.lit("/tmp/a/assets/"), n, F.lit(".jpg"))).otherwise(F.concat(F.lit("/tmp/"), n, F.lit(".jpg")))
    society = F.concat(F.lit("*Journal of the Malayan Branch of the Royal Asiatic Society* "), n)
    hint = F.when(i % 3 == 0, F.lit("a|rotate90cw")).when(i % 3 == 1, F.lit("a|rotate90ccw")).otherwise("a")
    thought = F.concat(F.lit("<think>\nx"), n, F.lit("\n</think>\n"), F.lit("answer "), n)
    return x.select("doc_id", tx.filename_author(file).alias("author"), tx.filename_year(file).alias("year"), tx.asset_path(asset).alias("asset"), tx.citation_clean(society).alias("society"), tx.type_label(F.col("document_type")).alias("label"), tx.rotation_hint(hint).alias("turn"), tx.strip_think(thought).alias("answer"))


_LABELS = "[" + ", ".join("' [" + x.replace("'", "''") + "]'" for x in tx.TYPE_LABELS.values()) + "]"

_NAMES_SQL = f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Azmi & Co' ELSE '' END AS author, CASE WHEN doc_id % 2 = 0 THEN '19' || lpad((doc_id % 100)::VARCHAR, 2, '0') ELSE '' END AS year, 'assets/' || doc_id || '.jpg' AS asset,
  'JMBRAS ' || doc_id AS society, ({_LABELS})[(doc_id % 13 + 1)::INT] AS label, ([90, 270, 0])[(doc_id % 3 + 1)::INT] AS turn, 'answer ' || doc_id AS answer FROM documents"""


def page_offset_apply(spark: SparkSession, d: str) -> DataFrame:
    docs = v.docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 50).cast("int")).alias("page_offset"))
    return bl.apply_page_offset(v.blocks(spark, d), docs).select("block_id", "page_num_1")


def fill_pages(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d)
    known = b.filter("page_num_1 % 2 = 0").select("doc_id", "page_num_1").distinct().select("doc_id", "page_num_1", F.lit(500.0).alias("width"), F.lit(700.0).alias("height"))
    return fg.fill_pages(b, known).select("doc_id", "page_num_1", "width", "height")


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    """What chunking would make: totals per document of the dry run's rows."""
    plan = ch.chunk_plan(ch.chunks(v.stitched_like(spark, d), max_tokens=150, overlap=0))
    return plan.groupBy("doc_id").agg(F.sum("n_blocks").cast("long").alias("blocks"), F.min("start_page").alias("first"), F.max("end_page").alias("last"))


def figure_replace(spark: SparkSession, d: str) -> DataFrame:
    """A run that found figures for some documents; the others keep theirs."""
    old = v.figures(spark, d).select("figure_id", "doc_id", "caption")
    new = old.filter("doc_id % 6 = 0").withColumns({"figure_id": F.concat("figure_id", F.lit("n")), "caption": F.lit("new")})
    return ix.replace_figures(old, new)


def skip_known_files(spark: SparkSession, d: str) -> DataFrame:
    files = v.docs(spark, d).select("doc_id", F.sha2("source_filename", 256).alias("sha256"))
    return ix.skip_known_files(files, files.filter("doc_id % 4 <> 1")).select("doc_id")


def only_with_chunks(spark: SparkSession, d: str) -> DataFrame:
    return ix.only_with_chunks(v.docs(spark, d).select("doc_id"), v.blocks(spark, d).filter("pos = 30"))


_B = v.with_views("words", "v_blocks")

ALL = [
    ("geometry", geometry, _GEOMETRY_SQL),
    ("eligible_images", eligible_images, _IMAGES_SQL),
    ("captions", captions, _B + ", " + _CAPTIONS + " SELECT figure_id, caption FROM c"),
    ("plates", plates, _B + ", " + _CAPTIONS + r" SELECT doc_id, page_num_1, arg_max(regexp_extract(caption, '(?i)^\s*(plate\s+[\w-]+)', 1), figure_id) FILTER (regexp_matches(caption, '(?i)^\s*plate\b')) AS plate_label, string_agg(figure_id, ',' ORDER BY figure_id) AS figure_ids FROM c GROUP BY 1, 2 HAVING count(*) FILTER (regexp_matches(caption, '(?i)^\s*plate\b')) > 0"),
    ("superscript_spans", superscript_spans, _B + " SELECT block_id, (pos % 99 + 1)::INT AS footnote_number FROM v_blocks WHERE 4.0 + pos % 8 < 7.0"),
    ("names", names, _NAMES_SQL),
    ("page_offset_apply", page_offset_apply, _B + " SELECT block_id, (page_num_1 + CASE WHEN doc_id % 3 = 0 THEN doc_id % 50 ELSE 0 END)::INT AS page_num_1 FROM v_blocks"),
    ("fill_pages", fill_pages, _B + " SELECT DISTINCT doc_id, page_num_1, CASE WHEN page_num_1 % 2 = 0 THEN 500.0 ELSE 612.0 END::DOUBLE AS width, CASE WHEN page_num_1 % 2 = 0 THEN 700.0 ELSE 792.0 END::DOUBLE AS height FROM v_blocks"),
    ("chunk_plan", chunk_plan, _B + " SELECT doc_id, count(*) AS blocks, min(page_num_1) AS first, max(page_num_1) AS last FROM v_blocks GROUP BY 1"),
    ("figure_replace", figure_replace, v.with_views("words", "v_figures") + " SELECT figure_id || CASE WHEN doc_id % 6 = 0 THEN 'n' ELSE '' END AS figure_id, doc_id, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE caption END AS caption FROM v_figures"),
    ("skip_known_files", skip_known_files, "SELECT doc_id FROM documents WHERE doc_id % 4 = 1"),
    ("only_with_chunks", only_with_chunks, _B + " SELECT doc_id FROM v_blocks WHERE pos = 30"),
]
