"""Index maintenance, catalogue and streaming queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import index as ix
from folioloom.plans import views as v
from folioloom.session import shared_dir, table
from folioloom.streaming import ingest as st


def docs_with_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d).filter(F.col("doc_id") % 3 != 0).select("doc_id", F.col("block_id").alias("chunk_id"))
    return ix.docs_with_chunk_counts(v.docs(spark, d).select("doc_id", "source_filename"), b)


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    return ix.dashboard(v.docs(spark, d), v.chunks(spark, d), v.figures(spark, d))


def latest_status(spark: SparkSession, d: str) -> DataFrame:
    return ix.latest_status(v.status(spark, d)).select("filename", "stage", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return ix.stage_counts(ix.latest_status(v.status(spark, d)), ("click", "error", "purchase", "signup", "view", "unknown"))


def chunk_audit(spark: SparkSession, d: str) -> DataFrame:
    a = ix.chunk_audit(v.old_chunks(spark, d), v.new_chunks(spark, d), 2)
    return a.select("doc_id", "total_chunks", "added", "removed", "text_changed", "unchanged", "version")


def embed_reuse(spark: SparkSession, d: str) -> DataFrame:
    old = v.chunks(spark, d).select("chunk_id", "text", "embedding")
    return ix.embed_reuse(old, v.new_chunks(spark, d)).select("chunk_id", "needs_embedding")


def chunk_replace(spark: SparkSession, d: str) -> DataFrame:
    new = v.new_chunks(spark, d).filter("doc_id % 4 = 1")
    return ix.replace_chunks(v.old_chunks(spark, d), new).select("chunk_id", "doc_id", F.sha2("text", 256).alias("text_sha"))


def doc_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = v.docs(spark, d).select("doc_id", "source_filename", "title", "year", "publication")
    new = old.filter("doc_id % 3 = 0").select((F.col("doc_id") * 2).alias("doc_id"), F.concat("source_filename", F.lit(".new")).alias("source_filename"), F.when(F.col("doc_id") % 2 == 0, F.col("title")).alias("title"), F.lit(None).cast("int").alias("year"), F.lit("New").alias("publication"))
    return ix.upsert_documents(old, new)


_UPSERT_SQL = (
    v.with_views("words", "v_docs")
    + """, n AS (SELECT doc_id * 2 AS doc_id, source_filename || '.new' AS source_filename, CASE WHEN doc_id % 2 = 0 THEN title END AS title, NULL::INT AS year, 'New' AS publication FROM v_docs WHERE doc_id % 3 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.source_filename ELSE n.source_filename END AS source_filename, coalesce(n.title, o.title) AS title, coalesce(n.year, o.year) AS year, coalesce(n.publication, o.publication) AS publication
FROM v_docs o FULL JOIN n ON o.doc_id = n.doc_id"""
)


def delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    docs = v.docs(spark, d)
    tables = {"documents": docs, "chunks": v.chunks(spark, d), "figures": v.figures(spark, d), "pipeline_status": docs.select(F.col("source_filename").alias("filename"))}
    left = ix.delete_documents(tables, docs.filter("doc_id % 10 = 3"))
    parts = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def version_diff(spark: SparkSession, d: str) -> DataFrame:
    old = v.blocks(spark, d).select("doc_id", "block_id", "page_num_1", "reading_order", F.col("text").alias("text_raw"), "pos")
    new = old.filter("pos % 7 <> 3").withColumn("text_raw", F.when(F.col("pos") % 5 == 0, F.concat("text_raw", F.lit("!"))).otherwise(F.col("text_raw")))
    return ix.diff_totals(ix.block_diff(old, new))


def version_diff_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents' new versions: by doc_id, some lines gone and some longer; one more at the end where the text's length is odd."""
    c = table(spark, d, "documents").select("doc_id", F.col("text").alias("old"), F.split("text", "\n").alias("l"))
    n = F.col("doc_id") % 3
    kept = F.filter("l", lambda x, i: (i % 4 != 1) | (n != 0))
    edited = F.transform(kept, lambda x, i: F.when((i % 3 == 0) & (n == 1), F.concat(x, F.lit(" #"), i.cast("string"))).otherwise(x))
    new = F.concat(F.array_join(edited, "\n"), F.when(F.length("old") % 2 == 1, F.lit("\n+ a line of its own")).otherwise(""))
    t = c.select("doc_id", ix.unified_diff("old", new).alias("diff"))
    return t.select("doc_id", ix.line_changes(F.col("diff"))["added"].alias("added"), ix.line_changes(F.col("diff"))["removed"].alias("removed"))


def overlay_merge(spark: SparkSession, d: str) -> DataFrame:
    x = v.docs(spark, d)
    base = F.to_json(F.struct("title", "publication"))
    over = F.when(F.col("doc_id") % 3 == 0, F.lit('{"title": null}')).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"title": "T'), F.col("doc_id").cast("string"), F.lit('"}')))
    return x.select("doc_id", ix.overlay_field(base, over, "title").alias("title"), ix.overlay_field(base, over, "publication").alias("publication"))


def keyword_union(spark: SparkSession, d: str) -> DataFrame:
    x = v.words(spark, d)
    return x.select("doc_id", F.array_join(ix.keyword_union(F.slice("w", 1, 3), F.transform(F.slice("w", 2, 4), lambda y: F.concat(F.lit(" "), y))), "|").alias("keywords"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 7).alias("version"), F.col("o_orderkey").alias("row"))
    return ix.latest_version(x)


def metadata_edit(spark: SparkSession, d: str) -> DataFrame:
    docs = v.docs(spark, d)
    fields = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("title"), F.concat(F.lit("Edited "), F.col("doc_id").cast("string")), F.lit("year"), F.lit("x"))).otherwise(F.create_map(F.lit("year"), F.lit("1999")))
    edits = docs.filter("doc_id % 5 = 0").select("doc_id", fields.alias("fields"))
    return ix.edit_metadata(docs, edits).select("doc_id", "title", "year")


def backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = v.docs(spark, d).select("doc_id", "title", "year")
    records = docs.filter("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("title"), "year", F.lit(1).alias("version")).unionByName(docs.filter("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(2).alias("version")))
    return ix.backfill(docs, records)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    kind = table(spark, d, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events*.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """The status table as a stream keeps it, run over all events that are there."""
    import uuid

    s = _stream(spark, d).select(F.col("user_id").cast("string").alias("filename"), F.col("event_type").alias("stage"), F.col("ts").alias("updated_at"))
    name = "status_" + uuid.uuid4().hex
    where = f"{shared_dir(spark)}/folioloom/{name}"
    path = f"{where}/rows"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = st.status_stream(s).writeStream.outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(path).select("filename", "stage", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day as a stream counts them, over all events that are there."""
    import uuid

    where = f"{shared_dir(spark)}/folioloom/windows_{uuid.uuid4().hex}"
    counted = st.windowed_counts(_stream(spark, d), "1 day", "40 days")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{where}/rows")

    q = counted.writeStream.outputMode("complete").option("checkpointLocation", f"{where}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{where}/rows").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def report_pages(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d)
    return ix.report_pages(b, b.filter("pos % 5 = 2"), b.filter("pos % 11 = 0"))


_V = v.with_views
_STATUS = "WITH s AS (SELECT user_id::VARCHAR AS filename, arg_max(event_type, (ts, event_type)) AS stage, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at FROM events GROUP BY 1) "

ALL = [
    ("docs_with_chunk_counts", docs_with_chunk_counts, _V("words", "v_docs", "v_blocks") + " SELECT d.doc_id, d.source_filename, count(b.block_id) AS chunk_count FROM v_docs d LEFT JOIN (SELECT * FROM v_blocks WHERE doc_id % 3 <> 0) b USING (doc_id) GROUP BY 1, 2"),
    ("dashboard", dashboard, _V("words", "v_figures") + " SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM documents UNION ALL SELECT 'figures', count(*) FROM v_figures"),
    ("latest_status", latest_status, _STATUS + "SELECT * FROM s"),
    ("stage_counts", stage_counts, _STATUS + "SELECT t.stage, count(s.filename) AS n FROM (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'unknown']) AS stage) t LEFT JOIN s USING (stage) GROUP BY 1"),
    ("chunk_audit", chunk_audit, _V("v_old", "v_new") + " SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, count(n.chunk_id) AS total_chunks, count(*) FILTER (o.chunk_id IS NULL) AS added, count(*) FILTER (n.chunk_id IS NULL) AS removed, count(*) FILTER (o.text <> n.text) AS text_changed, count(*) FILTER (o.text = n.text) AS unchanged, 2 AS version FROM v_old o FULL JOIN v_new n USING (chunk_id) GROUP BY 1 HAVING count(n.chunk_id) > 0"),
    ("embed_reuse", embed_reuse, _V("v_old", "v_new") + " SELECT n.chunk_id, NOT coalesce(o.text = n.text AND e.embedding IS NOT NULL, false) AND length(n.text) > 0 AS needs_embedding FROM v_new n LEFT JOIN v_old o USING (chunk_id) LEFT JOIN embeddings e ON e.vec_id = o.doc_id"),
    ("chunk_replace", chunk_replace, _V("v_old", "v_new") + ", r AS (SELECT * FROM v_new WHERE doc_id % 4 = 1) SELECT chunk_id, doc_id, sha256(text) AS text_sha FROM (SELECT * FROM v_old WHERE doc_id NOT IN (SELECT doc_id FROM r) UNION ALL SELECT * FROM r)"),
    ("doc_upsert", doc_upsert, _UPSERT_SQL),
    ("delete_cascade", delete_cascade, _V("words", "v_docs", "v_figures") + " SELECT 'documents' AS name, count(*) AS n FROM v_docs WHERE doc_id % 10 <> 3 UNION ALL SELECT 'chunks', count(*) FROM v_docs WHERE doc_id % 10 <> 3 UNION ALL SELECT 'figures', count(*) FROM v_figures WHERE doc_id % 10 <> 3 UNION ALL SELECT 'pipeline_status', count(*) FROM v_docs WHERE doc_id % 10 <> 3"),
    ("version_diff", version_diff, _V("words", "v_blocks") + " SELECT doc_id, 0::BIGINT AS added, count(*) FILTER (pos % 7 = 3) AS removed, count(*) FILTER (pos % 7 <> 3 AND pos % 5 = 0) AS changed, count(*) FILTER (pos % 7 <> 3 AND pos % 5 <> 0) AS unchanged FROM v_blocks GROUP BY 1"),
    ("version_diff_lines", version_diff_lines, None),
    ("overlay_merge", overlay_merge, _V("words", "v_docs") + " SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'T' || doc_id ELSE title END AS title, publication FROM v_docs"),
    ("keyword_union", keyword_union, _V("words") + ", k AS (SELECT doc_id, unnest(list_concat(w[1:3], w[2:5])) AS x, generate_subscripts(list_concat(w[1:3], w[2:5]), 1) AS i FROM words) SELECT doc_id, coalesce(string_agg(x, '|' ORDER BY i), '') AS keywords FROM (SELECT doc_id, x, min(i) AS i FROM k GROUP BY 1, 2) GROUP BY 1"),
    ("latest_version", latest_version, "SELECT doc_id, version, \"row\" FROM (SELECT o_custkey AS doc_id, o_orderkey % 7 AS version, o_orderkey AS \"row\", max(o_orderkey % 7) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE version = top"),
    ("metadata_edit", metadata_edit, _V("words", "v_docs") + " SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'Edited ' || doc_id ELSE title END AS title, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 1999 ELSE year END AS year FROM v_docs"),
    ("backfill", backfill, _V("words", "v_docs") + " SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN 'old' ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE year END AS year FROM v_docs"),
    ("stream_status", stream_status, _STATUS + "SELECT * FROM s"),
    ("stream_windows", stream_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    ("report_pages", report_pages, _V("words", "v_blocks") + " SELECT doc_id, page_num_1, count(*) AS blocks, count(*) FILTER (pos % 5 = 2) AS footnotes, count(*) FILTER (pos % 11 = 0) AS figures FROM v_blocks GROUP BY 1, 2"),
]
