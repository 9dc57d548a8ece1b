"""The engine's relations, derived from the driver's tables in the same way in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.text import TYPE_LABELS
from folioloom.session import table

TYPES = tuple(TYPE_LABELS)
WORDS = 40
QUERY_VECTOR = 7


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.withColumn("w", F.split("text", r"\s+"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    # words 361 to 368 where there are more, else the first six; no text is split any further
    late = F.regexp_extract("text", r"^(?:\S*+\s++){360}(\S*+(?:\s++\S*+){7})\s", 1)
    title = F.when(F.length(late) > 0, F.regexp_replace(late, r"\s+", " ")).otherwise(F.array_join(F.slice(F.split("text", r"\s+", 7), 1, 6), " "))
    return d.select(
        "doc_id",
        F.concat(F.lit("doc-"), i.cast("string"), F.lit(".pdf")).alias("source_filename"),
        title.alias("title"),
        F.concat(F.lit("Author, "), F.upper("lang"), F.lit(" "), F.col("source")).alias("author"),
        F.col("lang").alias("language"),
        F.col("source").alias("publication"),
        F.when(i % 17 != 0, (i % 150 + 1870).cast("int")).alias("year"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (i % 13 + 1).cast("int")).alias("document_type"),
        F.when(i % 3 == 0, "3-4").when(i % 3 == 1, "2–3").alias("page_range_label"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = words(spark, sf_dir)
    last = F.greatest(F.floor((F.size("w") - 1) / WORDS), F.lit(0)).cast("int")
    # each block takes its own words along, never its document's
    cut = F.transform(F.sequence(F.lit(0), last), lambda pos: F.array_join(F.slice("w", pos * WORDS + 1, WORDS), " "))
    b = d.select("doc_id", F.posexplode(cut).alias("pos", "text"))
    return b.select(
        "doc_id",
        F.concat(F.lit("b"), F.col("doc_id").cast("string"), F.lit("-"), F.format_string("%05d", F.col("pos"))).alias("block_id"),
        (F.floor(F.col("pos") / 4) + 1).cast("int").alias("page_num_1"),
        (F.col("pos") % 4).cast("int").alias("reading_order"),
        F.when(F.col("pos") % 9 == 0, "heading").otherwise("paragraph").alias("block_type"),
        "text",
        "pos",
    )


def stitched_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in the shape that chunking takes, without restitching."""
    b = blocks(spark, sf_dir)
    return b.select("doc_id", F.array("block_id").alias("block_ids"), F.col("page_num_1").alias("start_page"), F.col("page_num_1").alias("end_page"), "text", "block_type", "reading_order", F.array().cast("array<string>").alias("footnote_refs"), "pos")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    i = F.col("doc_id")
    start = (i % 5 + 1).cast("int")
    return d.join(e, "doc_id", "left").select(F.concat(F.lit("c"), i.cast("string")).alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"), start.alias("start_page"), (start + i % 3).cast("int").alias("end_page"), F.lit(None).cast("string").alias("section_heading"), "text", "embedding")


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = words(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("doc_id"), "embedding")
    i = F.col("doc_id")
    caption = F.when(i % 7 == 0, "").when(i % 5 == 0, "Figure on p.3").otherwise(F.array_join(F.slice("w", 1, 8), " "))
    return d.filter(i % 2 == 0).join(e, "doc_id", "left").select(F.concat(F.lit("f"), i.cast("string")).alias("figure_id"), "doc_id", (i % 4 + 1).cast("int").alias("page_num"), caption.alias("caption"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == QUERY_VECTOR).select("embedding").first()
    return list(row["embedding"])


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("filename"), F.col("event_type").alias("stage"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("updated_at"), "event_id")


def old_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", "doc_id", "text")


def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second version: every fifth document edited, every seventh gone, every eleventh with one chunk more."""
    c = old_chunks(spark, sf_dir).filter(F.col("doc_id") % 7 != 0)
    edited = c.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Edited. "), F.col("text"))).otherwise(F.col("text")))
    more = c.filter(F.col("doc_id") % 11 == 0).withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))
    return edited.unionByName(more)


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"

#: The same relations for DuckDB, to be put after WITH.
SQL = {
    "words": r"words AS (SELECT *, regexp_split_to_array(text, '\s+') AS w FROM documents)",
    "v_docs": f"""v_docs AS (
  SELECT doc_id, 'doc-' || doc_id || '.pdf' AS source_filename,
         array_to_string(CASE WHEN len(w) > 368 THEN w[361:368] ELSE w[1:6] END, ' ') AS title,
         'Author, ' || upper(lang) || ' ' || source AS author, lang AS language, source AS publication,
         CASE WHEN doc_id % 17 <> 0 THEN (doc_id % 150 + 1870)::INT END AS year,
         ({_TYPE_LIST})[(doc_id % 13 + 1)::INT] AS document_type,
         CASE WHEN doc_id % 3 = 0 THEN '3-4' WHEN doc_id % 3 = 1 THEN '2–3' END AS page_range_label
  FROM words)""",
    "v_blocks": f"""v_blocks AS (
  SELECT doc_id, 'b' || doc_id || '-' || lpad(pos::VARCHAR, 5, '0') AS block_id, (pos // 4 + 1)::INT AS page_num_1, (pos % 4)::INT AS reading_order,
         CASE WHEN pos % 9 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type,
         array_to_string(w[pos * {WORDS} + 1 : pos * {WORDS} + {WORDS}], ' ') AS text, pos
  FROM (SELECT doc_id, w, unnest(range(greatest((len(w) - 1) // {WORDS}, 0) + 1))::INT AS pos FROM words))""",
    "v_chunks": """v_chunks AS (
  SELECT 'c' || d.doc_id AS chunk_id, d.doc_id, (d.doc_id % 5 + 1)::INT AS start_page, (d.doc_id % 5 + 1 + d.doc_id % 3)::INT AS end_page, d.text, e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)""",
    "v_figures": """v_figures AS (
  SELECT 'f' || d.doc_id AS figure_id, d.doc_id, (d.doc_id % 4 + 1)::INT AS page_num,
         CASE WHEN d.doc_id % 7 = 0 THEN '' WHEN d.doc_id % 5 = 0 THEN 'Figure on p.3' ELSE array_to_string(w[1:8], ' ') END AS caption, e.embedding
  FROM words d LEFT JOIN embeddings e ON e.vec_id + 1 = d.doc_id WHERE d.doc_id % 2 = 0)""",
    "v_old": "v_old AS (SELECT 'c' || doc_id AS chunk_id, doc_id, text FROM documents)",
    "v_new": """v_new AS (
  SELECT chunk_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Edited. ' || text ELSE text END AS text FROM v_old WHERE doc_id % 7 <> 0
  UNION ALL SELECT chunk_id || 'x', doc_id, text FROM v_old WHERE doc_id % 7 <> 0 AND doc_id % 11 = 0)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause of views, in order, ready for more."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
