"""Queries of sources and sinks, streams, the editor's lists, migration and metadata merging."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import blocks as bl
from folioloom.operators import figures as fg
from folioloom.operators import index as ix
from folioloom.operators import metadata as md
from folioloom.plans import flow
from folioloom.plans import views as v
from folioloom.session import shared_dir, table
from folioloom.sources import records as rc
from folioloom.sources.providers import HashEmbedder
from folioloom.streaming import ingest as st


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioloom/{name}-{uuid.uuid4().hex}"


# -- sources and sinks -----------------------------------------------------------------


def bundle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A run's records written as JSON lines and read back, defaults filled; a record type that isn't there is empty."""
    at = _folder(spark, "bundle")
    b = flow.records(spark, d)
    blocks = b.select("block_id", F.col("doc_id").cast("string").alias("doc_id"), "page_num_1", F.col("text").alias("text_raw"), F.when(F.col("block_type") != "paragraph", F.col("block_type")).alias("block_type"), "reading_order")
    docs = v.docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "source_filename", "title", "year")
    rc.write_bundle({"documents": docs, "text_blocks": blocks}, at)
    back = rc.read_bundle(spark, at)
    known = back["text_blocks"].join(back["documents"].select("doc_id", "source_filename", "page_offset"), "doc_id")
    none = back["footnotes"].select("doc_id").withColumn("n", F.lit(1))
    return known.join(none, "doc_id", "left").filter("n IS NULL").select("doc_id", "block_id", "page_num_1", "reading_order", "block_type", F.sha2("text_raw", 256).alias("text_sha"), "text_clean", F.size("links").alias("links"), "source_filename", "page_offset")


def _version_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each source is a document here, with a record for each text."""
    x = table(spark, d, "documents")
    return x.select(F.concat("source", F.lit("-x")).alias("doc_id"), F.col("doc_id").cast("string").alias("block_id"), (F.col("doc_id") % 50 + 1).cast("int").alias("page_num_1"), F.col("text").alias("text_raw"))


def _versions_written(spark: SparkSession, d: str) -> str:
    at = _folder(spark, "store")
    rows = _version_rows(spark, d)
    rc.write_version(rows, at, "text_blocks", order=["page_num_1", "block_id"])
    rc.write_version(rows.filter("page_num_1 % 2 = 0 AND doc_id < 'src3'").withColumn("text_raw", F.concat(F.lit("#"), "text_raw")), at, "text_blocks", order=["page_num_1", "block_id"])
    return at


def versioned_store(spark: SparkSession, d: str) -> DataFrame:
    """Two runs into versioned folders; what each document's last version has."""
    latest = rc.read_latest(spark, _versions_written(spark, d), "text_blocks")
    return latest.select("doc_id", "version", "block_id", "page_num_1", "text_raw")


_STORE_SQL = """WITH r AS (SELECT source || '-x' AS doc_id, doc_id::VARCHAR AS block_id, (doc_id % 50 + 1)::INT AS page_num_1, text AS text_raw FROM documents),
s AS (SELECT doc_id, 2 AS version, block_id, page_num_1, '#' || text_raw AS text_raw FROM r WHERE page_num_1 % 2 = 0 AND doc_id < 'src3')
SELECT * FROM s UNION ALL SELECT doc_id, 1, block_id, page_num_1, text_raw FROM r WHERE doc_id NOT IN (SELECT doc_id FROM s)"""


def file_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """All files of a versioned store as a stream brings them, with the version of their path, in batches of ten."""
    root, out = _versions_written(spark, d), _folder(spark, "arrived")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("doc_id", "version", "block_id").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    st.ingest(st.arrivals(spark, root, files_per_batch=10), f"{out}-checkpoint", keep).awaitTermination()
    return spark.read.parquet(out).groupBy("doc_id", "version").agg(F.count("*").alias("blocks"))


_ARRIVALS_SQL = """WITH r AS (SELECT source || '-x' AS doc_id, doc_id % 50 + 1 AS p FROM documents)
SELECT doc_id, 1 AS version, count(*) AS blocks FROM r GROUP BY 1 UNION ALL SELECT doc_id, 2, count(*) FROM r WHERE p % 2 = 0 AND doc_id < 'src3' GROUP BY 1"""


def trigger_keys(spark: SparkSession, d: str) -> DataFrame:
    """Which object keys start indexing, and of what."""
    i = F.col("doc_id")
    n = i.cast("string")
    key = F.when(i % 4 == 0, F.concat(F.lit("processed/d"), n, F.lit("/v"), (i % 9 + 1).cast("string"), F.lit("/documents.jsonl"))).when(i % 4 == 1, F.concat(F.lit("processed/d"), n, F.lit("/v1/text_blocks.jsonl"))).when(i % 4 == 2, F.concat(F.lit("uploads/d"), n, F.lit(".pdf"))).otherwise(F.concat(F.lit("x/processed/d"), n, F.lit("/v2/documents.jsonl")))
    doc, version = st.trigger_parts(key)
    return table(spark, d, "documents").select("doc_id", doc.alias("found"), version.alias("version"))


def stream_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Events that are delivered twice, each kept once."""
    kind = table(spark, d, "events").schema
    once = lambda: spark.readStream.schema(kind).option("pathGlobFilter", "events*.parquet").parquet(d).select(F.col("event_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = _folder(spark, "repeats")
    kept = st.without_repeats(once().union(once()), late="400 days")
    kept.writeStream.option("checkpointLocation", f"{out}/checkpoint").format("parquet").option("path", f"{out}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, ts timestamp, event_type string").parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


# -- the editor ------------------------------------------------------------------------


def chunk_preview(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d).select(F.col("block_id").alias("chunk_id"), "doc_id", F.col("pos").alias("chunk_index"), "text")
    return ix.chunk_preview(b, 5, 6)


def admin_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first of the editor's documents, newest first, those without a time last."""
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval((F.col("doc_id") * 7919 % 1000).cast("int"))).alias("indexed_at"))
    return ix.admin_list(x, "documents", 50).select("doc_id", F.date_format("indexed_at", "yyyy-MM-dd").alias("day"))


def admin_versions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 7).cast("int").alias("version")).distinct()
    return ix.admin_list(x, "versions", 100)


def requeue(spark: SparkSession, d: str) -> DataFrame:
    docs = v.docs(spark, d).filter("year < 1900")
    asked = ix.requeue(docs, "uploaded", F.to_timestamp(F.lit("2025-01-01")))
    log = v.docs(spark, d).select(F.col("source_filename").alias("filename"), F.lit("done").alias("stage"), F.lit(None).cast("string").alias("error"), F.to_timestamp(F.lit("2024-01-01")).alias("updated_at"))
    return ix.latest_status(log.unionByName(asked)).select("filename", "stage")


def migrate(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the copy, with a vector of the other service's width; all else as it was."""
    copy = ix.migrate(v.docs(spark, d), v.chunks(spark, d), HashEmbedder(48, batch=96).column(F.col("text")))
    return copy["chunks"].join(copy["documents"].select("doc_id", "title"), "doc_id").select("chunk_id", "title", "start_page", F.sha2("text", 256).alias("text_sha"), F.size("embedding").alias("dimensions"))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Files against processed records: the same hash reuses the record, another makes a new one."""
    files = v.docs(spark, d).select("source_filename", F.sha2(F.concat("source_filename", (F.col("doc_id") % 2).cast("string")), 256).alias("sha256"), F.concat(F.lit("/in/"), "source_filename").alias("path"))
    old = v.docs(spark, d).filter("doc_id % 3 <> 0").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("-"), F.substring(F.sha2(F.concat("source_filename", F.lit("0")), 256), 1, 12)).alias("doc_id"), F.sha2(F.concat("source_filename", F.lit("0")), 256).alias("sha256"), F.col("title"))
    return ix.inventory(files, old).select("doc_id", "source_filename", "reused", "title")


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """Two runs' audits; the second repeats part of the first's version."""
    first = ix.chunk_audit(v.old_chunks(spark, d), v.new_chunks(spark, d), 2)
    again = ix.chunk_audit(v.new_chunks(spark, d), v.new_chunks(spark, d).filter("doc_id % 2 = 0"), 2).unionByName(ix.chunk_audit(v.new_chunks(spark, d), v.new_chunks(spark, d).filter("doc_id % 3 = 0"), 3))
    return ix.append_audit(first, again).select("doc_id", "version", "total_chunks", "added", "unchanged")


_AUDIT_SQL = (
    v.with_views("v_old", "v_new")
    + """, f AS (SELECT n.doc_id, 2 AS version, count(*) AS total_chunks, count(*) FILTER (o.chunk_id IS NULL) AS added, count(*) FILTER (o.text = n.text) AS unchanged FROM v_new n LEFT JOIN v_old o USING (chunk_id) GROUP BY 1),
a AS (SELECT doc_id, v.v AS version, count(*) AS total_chunks, 0 AS added, count(*) AS unchanged FROM v_new, (SELECT unnest([2, 3]) AS v) v WHERE doc_id % v.v = 0 GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT * FROM f WHERE doc_id % 2 <> 0"""
)


# -- pages, figures, lines --------------------------------------------------------------


def page_images(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d)
    images = b.filter("pos % 3 = 1").select("doc_id", (F.col("page_num_1") + 1).alias("page_num_1"))
    return bl.page_counts(b, images)


def scans_to_render(spark: SparkSession, d: str) -> DataFrame:
    """Pages with one to three images, some as large as the page, some with text of their own."""
    b = v.blocks(spark, d)
    p = F.col("page_num_1")
    side = F.when((F.col("doc_id") + p) % 2 == 0, 590.0).otherwise((F.col("pos") % 5 * 130).cast("double"))
    images = b.filter(F.col("reading_order") <= p % 3).select("doc_id", "page_num_1", F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), side.alias("x1"), F.lit(780.0).alias("y1")).alias("bbox"))
    pages = b.select("doc_id", "page_num_1").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "spans": F.when(p % 4 == 0, 3).otherwise(0)})
    texts = b.select("doc_id", "page_num_1", F.substring("text", 1, 30).alias("text_raw"))
    return fg.scans_to_render(images, pages, texts, b.filter("page_num_1 % 5 <> 2").select("doc_id", "page_num_1"))


_SCANS_SQL = (
    v.with_views("words", "v_blocks")
    + """, i AS (SELECT doc_id, page_num_1, CASE WHEN (doc_id + page_num_1) % 2 = 0 THEN 590.0 ELSE pos % 5 * 130.0 END * 780.0 >= 0.7 * 612 * 792 AS cover FROM v_blocks WHERE reading_order <= page_num_1 % 3),
w AS (SELECT doc_id, page_num_1 FROM v_blocks GROUP BY 1, 2 HAVING sum(length(substr(text, 1, 30))) >= 100)
SELECT doc_id, page_num_1 FROM i WHERE page_num_1 % 4 <> 0 AND page_num_1 % 5 <> 2 AND (doc_id, page_num_1) NOT IN (SELECT doc_id, page_num_1 FROM w) GROUP BY 1, 2 HAVING bool_and(cover)"""
)


def span_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words of a document's opening as spans, eight to a line, now and then a little lower; lines as they are read."""
    x = v.words(spark, d).filter(F.size("w") > 0)
    spans = F.transform(F.slice("w", 1, 60), lambda w, i: F.struct((i % 8).cast("double").alias("x0"), (F.floor(i / 8) * 12 + F.when(i % 3 == 1, 4).otherwise(0)).cast("double").alias("y0"), (F.floor(i / 8) * 12 + F.when(i % 3 == 1, 4).otherwise(0) + 10).cast("double").alias("y1"), w.alias("text")))
    return x.select("doc_id", F.array_join(fg.group_lines(spans), "|").alias("lines"))


def opening_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first ten pages of any length, cut to 8,000 characters."""
    return bl.opening_text(v.blocks(spark, d), at_least=0, until=10**9, cut=8000, max_pages=10).select("doc_id", F.length("opening").alias("n"), F.sha2("opening", 256).alias("sha"))


_OPENING_SQL = (
    v.with_views("words", "v_blocks")
    + """, p AS (SELECT doc_id, page_num_1, string_agg(text, chr(10) ORDER BY reading_order) AS t FROM v_blocks GROUP BY 1, 2),
o AS (SELECT doc_id, substr(string_agg(t, chr(10) || chr(10) ORDER BY page_num_1), 1, 8000) AS t FROM p WHERE page_num_1 <= 10 GROUP BY 1)
SELECT doc_id, length(t) AS n, sha256(t) AS sha FROM o"""
)


# -- metadata --------------------------------------------------------------------------


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """Documents with gaps, and a model's answers in fences, with types and years that don't exist among them."""
    i = F.col("doc_id")
    docs = v.docs(spark, d).select("doc_id", F.when(i % 2 == 0, F.col("title")).otherwise("").alias("title"), F.when(i % 3 == 0, F.col("author")).alias("author"), F.when(i % 4 != 0, F.col("year")).otherwise(0).alias("year"), F.when(i % 5 == 0, F.col("document_type")).alias("document_type"), F.array(F.lit("a"), F.lit("b")).alias("keywords"))
    year = F.when(i % 3 == 0, "about 1900").otherwise((i % 100 + 1900).cast("string"))
    body = F.to_json(F.struct(F.concat(F.lit(" Model "), i.cast("string")).alias("title"), F.concat(F.lit("Writer "), i.cast("string")).alias("author"), year.alias("year"), F.when(i % 2 == 0, "obituary").otherwise("novel").alias("document_type"), F.array(F.lit("b"), F.lit(" c ")).alias("keywords")))
    answers = docs.filter(i % 7 != 0).select("doc_id", F.when(i % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("answer"))
    return md.merge_model_answer(docs, answers).select("doc_id", "title", "author", "year", "document_type", F.array_join("keywords", "|").alias("keywords"))


_MODEL_SQL = (
    v.with_views("words", "v_docs")
    + """, g AS (SELECT doc_id AS i, *, doc_id % 7 <> 0 AS told FROM v_docs)
SELECT doc_id, CASE WHEN i % 2 = 0 AND title <> '' THEN title WHEN told THEN 'Model ' || i WHEN i % 2 = 0 THEN title ELSE NULL END AS title, CASE WHEN i % 3 = 0 THEN author WHEN told THEN 'Writer ' || i END AS author,
  CASE WHEN i % 4 <> 0 AND year IS NOT NULL THEN year WHEN told AND i % 3 <> 0 THEN (i % 100 + 1900)::INT END AS year, CASE WHEN i % 5 = 0 THEN document_type WHEN told AND i % 2 = 0 THEN 'obituary' END AS document_type, CASE WHEN told THEN 'a|b|c' ELSE 'a|b' END AS keywords FROM g"""
)


def catalogue_answers(spark: SparkSession, d: str) -> DataFrame:
    """Three catalogues, each knowing some documents, the most believed first; where each filled value is from."""
    i = F.col("doc_id")
    n = i.cast("string")
    source = "array<struct<field:string,source:string,confidence:double,raw_value:string>>"
    docs = v.docs(spark, d).select("doc_id", F.when(i % 2 == 0, F.col("title")).alias("title"), F.lit(None).cast("string").alias("abstract"), F.when(i % 5 == 0, F.col("year")).alias("year"), F.array().cast(source).alias("metadata_sources"))
    x = docs.select("doc_id")
    lookups = {
        "crossref": x.filter(i % 3 == 0).select("doc_id", F.concat(F.lit("C "), n).alias("title"), F.concat(F.lit("<jats:p>About "), n, F.lit("</jats:p>")).alias("abstract")),
        "openlibrary": x.filter(i % 4 == 0).select("doc_id", F.when(i % 8 == 0, "title").otherwise("identifier").alias("matched_by"), F.concat(F.lit("O "), n).alias("title"), (i % 90 + 1900).cast("int").alias("year")),
        "web": x.select("doc_id", F.concat(F.lit("W "), n).alias("title")),
    }
    m = md.merge_catalogues(docs, lookups)
    said = F.array_join(F.transform("metadata_sources", lambda s: F.concat_ws(":", s["field"], s["source"], F.format_number(s["confidence"], 1), s["raw_value"])), "|")
    return m.select("doc_id", "title", "abstract", "year", said.alias("sources"))


_CATALOGUE_SQL = (
    v.with_views("words", "v_docs")
    + """, g AS (SELECT doc_id AS i, CASE WHEN doc_id % 2 = 0 AND title <> '' THEN title END AS t, CASE WHEN doc_id % 5 = 0 THEN year END AS y FROM v_docs)
SELECT i AS doc_id, coalesce(t, CASE WHEN i % 3 = 0 THEN 'C ' || i WHEN i % 4 = 0 THEN 'O ' || i ELSE 'W ' || i END) AS title, CASE WHEN i % 3 = 0 THEN 'About ' || i END AS abstract, coalesce(y, CASE WHEN i % 4 = 0 THEN (i % 90 + 1900)::INT END) AS year,
  concat_ws('|', CASE WHEN t IS NULL THEN CASE WHEN i % 3 = 0 THEN 'title:crossref:1.0:C ' || i WHEN i % 8 = 0 THEN 'title:openlibrary:0.7:O ' || i WHEN i % 4 = 0 THEN 'title:openlibrary:0.8:O ' || i ELSE 'title:web:0.5:W ' || i END END,
    CASE WHEN y IS NULL AND i % 4 = 0 THEN 'year:openlibrary:' || CASE WHEN i % 8 = 0 THEN '0.7' ELSE '0.8' END || ':' || (i % 90 + 1900) END, CASE WHEN i % 3 = 0 THEN 'abstract:crossref:1.0:<jats:p>About ' || i || '</jats:p>' END) AS sources FROM g"""
)

_B = v.with_views("words", "v_blocks")

ALL = [
    ("bundle_round_trip", bundle_round_trip, v.with_views("words", "v_docs", "v_blocks") + ",\n" + flow._RECORDS + " SELECT r.doc_id::VARCHAR AS doc_id, block_id, page_num_1, reading_order, block_type, sha256(text) AS text_sha, '' AS text_clean, 0 AS links, source_filename, 0 AS page_offset FROM records r JOIN v_docs USING (doc_id)"),
    ("versioned_store", versioned_store, _STORE_SQL),
    ("file_arrivals", file_arrivals, _ARRIVALS_SQL),
    ("trigger_keys", trigger_keys, "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'd' || doc_id ELSE '' END AS found, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9 + 1)::INT END AS version FROM documents"),
    ("stream_repeats", stream_repeats, "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY 1"),
    ("chunk_preview", chunk_preview, _B + " SELECT block_id AS chunk_id, pos AS chunk_index, substr(text, 1, 300) AS preview FROM v_blocks WHERE doc_id = 5 ORDER BY pos LIMIT 6"),
    ("admin_documents", admin_documents, "SELECT doc_id, strftime(t, '%Y-%m-%d') AS day FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL (doc_id * 7919 % 1000) DAY END AS t FROM documents) ORDER BY t DESC NULLS LAST, doc_id LIMIT 50"),
    ("admin_versions", admin_versions, "SELECT DISTINCT o_custkey AS doc_id, (o_orderkey % 7)::INT AS version FROM orders ORDER BY 1, 2 DESC LIMIT 100"),
    ("requeue", requeue, v.with_views("words", "v_docs") + " SELECT source_filename AS filename, CASE WHEN year < 1900 THEN 'uploaded' ELSE 'done' END AS stage FROM v_docs"),
    ("migrate", migrate, v.with_views("words", "v_docs", "v_chunks") + " SELECT chunk_id, title, start_page, sha256(text) AS text_sha, 48 AS dimensions FROM v_chunks JOIN v_docs USING (doc_id)"),
    ("inventory", inventory, v.with_views("words", "v_docs") + " SELECT 'doc-' || doc_id || '-' || substr(sha256(source_filename || doc_id % 2), 1, 12) AS doc_id, source_filename, doc_id % 2 = 0 AND doc_id % 3 <> 0 AS reused, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 0 THEN title END AS title FROM v_docs"),
    ("audit_log", audit_log, _AUDIT_SQL),
    ("page_images", page_images, _B + ", b AS (SELECT doc_id, page_num_1, sum(length(text))::BIGINT AS c, count(*) AS n FROM v_blocks GROUP BY 1, 2), i AS (SELECT doc_id, page_num_1 + 1 AS page_num_1, count(*) AS m FROM v_blocks WHERE pos % 3 = 1 GROUP BY 1, 2) SELECT doc_id, page_num_1, coalesce(c, 0) AS text_char_count, coalesce(n, 0) AS blocks, coalesce(m, 0) AS image_count FROM b FULL JOIN i USING (doc_id, page_num_1)"),
    ("scans_to_render", scans_to_render, _SCANS_SQL),
    ("span_lines", span_lines, v.with_views("words") + ", s AS (SELECT doc_id, unnest(w[1:60]) AS x, generate_subscripts(w[1:60], 1) - 1 AS i FROM words WHERE len(w) > 0), l AS (SELECT doc_id, i // 8 AS line, string_agg(x, ' ' ORDER BY i) AS t FROM s GROUP BY 1, 2) SELECT doc_id, string_agg(t, '|' ORDER BY line) AS lines FROM l GROUP BY 1"),
    ("opening_pages", opening_pages, _OPENING_SQL),
    ("model_answers", model_answers, _MODEL_SQL),
    ("catalogue_answers", catalogue_answers, _CATALOGUE_SQL),
]
