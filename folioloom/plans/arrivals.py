"""Queries of streams into a store: arrivals indexed once, and stages with timers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators import retrieval as rt
from folioloom.operators.index import STAGES
from folioloom.plans import flow
from folioloom.plans import views as v
from folioloom.plans.search import _terms
from folioloom.session import lean, remove, scratch, shared_dir, table
from folioloom.sources.store import Store
from folioloom.streaming import ingest as st

_BLOCKS = "doc_id bigint, block_id string, page_num_1 int, reading_order int, block_type string, text string"

#: Bytes of arrived files that a batch takes in; what it makes on disk on the way is a few times as much, whatever has arrived.
BATCH_BYTES = 128 << 20


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folioloom/{name}-{uuid.uuid4().hex}"


def _indexed(spark: SparkSession, d: str) -> Store:
    """A store that two waves of arrivals are indexed into: first pages 1 to 6 of even documents, then all of every document. Each batch is delivered twice."""
    at = _folder(spark, "arrivals")
    store = Store(spark, f"{at}/store", buckets=4, order=flow.TABLES)

    def change(batch: DataFrame, name: str) -> None:
        # a batch holds whole documents, since a file does
        named = docs.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        flow.index_into(store, batch, named, name, flow.MAX_TOKENS, flow.OVERLAP)

    handle = st.once_each("arrivals", change)

    def twice(batch: DataFrame, batch_id: int) -> None:
        handle(batch, batch_id)
        handle(batch, batch_id)

    blocks = flow.records(spark, d).select("doc_id", "block_id", "page_num_1", "reading_order", "block_type", "text")
    with lean(spark), scratch(spark):
        docs = flow.catalogue(spark, d)
        for wave in (blocks.filter("doc_id % 2 = 0 AND page_num_1 <= 6"), blocks):
            wave.repartition("doc_id").write.mode("append").options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}).json(f"{at}/in")
            # files go once the batch that took them in is committed, the last ones with the wave
            stream = spark.readStream.schema(_BLOCKS).option("maxBytesPerTrigger", BATCH_BYTES).option("cleanSource", "delete").json(f"{at}/in")
            st.ingest(stream, f"{at}/checkpoint", twice).awaitTermination()
            remove(spark, f"{at}/in")
    return store


def indexed_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a store after its arrivals: those of the last version of each document."""
    c = _indexed(spark, d).read("chunks")
    return c.select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "start_page", "end_page", "section_heading", "text", F.array_join("block_ids", ",").alias("block_ids"), "token_count")


def arrivals_audit(spark: SparkSession, d: str) -> DataFrame:
    """What each version of a document changed, though every batch came twice."""
    return _indexed(spark, d).read("audit").select("doc_id", "version", "total_chunks", "added", "removed", "text_changed", "unchanged")


_CHUNKS_SQL = flow._BASE + flow._flow("n_", "true") + " SELECT chunk_id, doc_id, chunk_index, start_page, end_page, section_heading, text, block_ids, greatest(1, length(text) // 4)::INT AS token_count FROM n_chunks"

_AUDIT_SQL = (
    flow._BASE
    + flow._flow("n_", "true")
    + ",\n"
    + flow._flow("o_", "page_num_1 <= 6 AND doc_id % 2 = 0")
    + """, met AS (SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, count(n.chunk_id) AS total_chunks, count(*) FILTER (o.chunk_id IS NULL) AS added, count(*) FILTER (n.chunk_id IS NULL) AS removed,
  count(*) FILTER (n.text <> o.text) AS text_changed, count(*) FILTER (n.text = o.text) AS unchanged FROM n_chunks n FULL JOIN o_chunks o USING (chunk_id) GROUP BY 1 HAVING count(n.chunk_id) > 0)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM o_chunks) THEN 2 ELSE 1 END AS version, total_chunks, added, removed, text_changed, unchanged FROM met
UNION ALL SELECT doc_id, 1, count(*), count(*), 0, 0, 0 FROM o_chunks GROUP BY doc_id"""
)


# -- postings in segments ------------------------------------------------------------------


def segment_postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings that were written, replaced in part, deleted in part and half merged: as an index built anew has them."""
    chunks = v.chunks(spark, d).select("chunk_id", "doc_id", "text")
    store = Store(spark, _folder(spark, "postings"), buckets=8, order={"postings": ["term", "chunk_id"]})

    def made(rows: DataFrame) -> DataFrame:
        return rt.postings(rows, also=("doc_id",)).select("doc_id", "term", "chunk_id", "tf")

    store.commit({"postings": made(chunks)})
    changed = chunks.filter("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("amended "), F.reverse("text")))
    store.commit({"postings": made(changed)})
    store.merge()
    store.delete(chunks.filter("doc_id % 7 = 0").select("doc_id"), ["postings"])
    again = chunks.filter("doc_id % 35 = 0").withColumn("text", F.lit("back again again"))
    store.commit({"postings": made(again)})
    return store.read("postings").groupBy("term").agg(F.count("*").alias("rows"), F.sum("tf").alias("tf"))


_POSTINGS_SQL = (
    v.with_views("v_chunks")
    + rf""", now AS (SELECT chunk_id, CASE WHEN doc_id % 35 = 0 THEN 'back again again' WHEN doc_id % 5 = 0 THEN 'amended ' || reverse(text) ELSE text END AS t FROM v_chunks WHERE doc_id % 7 <> 0 OR doc_id % 35 = 0)
SELECT term, count(*) AS rows, sum(tf)::BIGINT AS tf FROM (SELECT chunk_id, term, count(*) AS tf FROM ({_terms('now', 'chunk_id', 't')}) GROUP BY ALL) GROUP BY term"""
)


# -- stages with timers ----------------------------------------------------------------------


def stream_stages(spark: SparkSession, d: str) -> DataFrame:
    """Furthest stages of all events' users, and which of them are stuck once the watermark has passed their timers."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    at = _folder(spark, "stages")
    e = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    stage = F.element_at(F.array(*[F.lit(s) for s in STAGES]), (F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.col("user_id") % 6 + 1) + 1).cast("int"))
    events = e.select(F.col("user_id").cast("string").alias("filename"), stage.alias("stage"), F.col("ts").cast("timestamp").alias("updated_at"))
    st.state_store(spark)
    try:
        moved = st.ordered_status(events, late="1 hour", hours=72)
        moved.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/rows/batch={i}")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.parquet(f"{at}/rows").select("filename", "stage", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "stuck")


_STAGES_SQL = f"""
WITH e AS (SELECT user_id::VARCHAR AS filename, ts::TIMESTAMP AS ts, ((event_id * 7 + user_id) % (user_id % 6 + 1))::INT AS r FROM events),
b AS (SELECT filename, max(r) AS r, max(ts) AS last FROM e GROUP BY 1),
f AS (SELECT b.filename, ({list(STAGES)})[b.r + 1] AS stage, strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS updated_at, any_value(b.last) AS last FROM b JOIN e ON e.filename = b.filename AND e.r = b.r GROUP BY b.filename, b.r)
SELECT filename, stage, updated_at, false AS stuck FROM f
UNION ALL SELECT filename, stage, updated_at, true FROM f WHERE stage NOT IN ('done', 'error') AND last + INTERVAL 72 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 1 HOUR
"""

ALL = [
    ("indexed_arrivals", indexed_arrivals, _CHUNKS_SQL),
    ("arrivals_audit", arrivals_audit, _AUDIT_SQL),
    ("segment_postings", segment_postings, _POSTINGS_SQL),
    ("stream_stages", stream_stages, _STAGES_SQL),
]
