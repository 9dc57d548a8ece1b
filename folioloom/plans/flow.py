"""Indexing a corpus as one plan: blocks and footnotes to chunks, vectors to make, documents and audit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import text as tx
from folioloom.operators import blocks as bl
from folioloom.operators import chunking as ch
from folioloom.operators import index as ix
from folioloom.plans import corpus
from folioloom.plans import views as v
from folioloom.session import lean, scratch, staged
from folioloom.sources.store import Store

MAX_TOKENS, OVERLAP = 150, 64


def make_chunks(blocks: DataFrame, docs: DataFrame, max_tokens: int = ch.MAX_TOKENS, overlap: int = ch.OVERLAP_TOKENS, min_tokens: int = 0) -> DataFrame:
    """Chunks of whole documents, from their blocks as they were read.

    Footnotes are found and linked, paragraphs restitched over page breaks, pages and
    footnotes outside an article's range left out, blocks before its title too; the rest is
    packed by section, with the footnotes it refers to. ``blocks``: doc_id, block_id,
    page_num_1, reading_order, block_type, text; ``docs``: doc_id, title, page_range_label.
    Footnotes, a few hundredths of the blocks, are written to the shared folder: blocks are read for them and for the
    chunks, and their texts shuffled once.
    """
    notes = staged(blocks.sparkSession, bl.footnotes(blocks).withColumn("footnote_id", F.col("block_id")), "footnotes")
    ranged = bl.article_range(bl.restitch(bl.refer(blocks, notes)), docs)
    inside = bl.article_range(notes, docs, page="page_num_1")
    return ch.chunks(bl.title_trim(ranged, docs), inside, max_tokens, overlap, min_tokens)


@dataclass(frozen=True)
class Run:
    """What an indexing run writes: new tables, the audit's rows, and which chunks need a vector."""

    documents: DataFrame
    chunks: DataFrame
    audit: DataFrame
    made: DataFrame


def index_corpus(blocks: DataFrame, docs: DataFrame, old_documents: DataFrame, old_chunks: DataFrame, version: int, max_tokens: int = ch.MAX_TOKENS, overlap: int = ch.OVERLAP_TOKENS, embed=None) -> Run:
    """One run over new versions of documents against the stored tables; documents without chunks change nothing.

    Chunks are made once, with their vectors, and written to the shared folder: all that a run writes is of the same chunks.
    """
    with lean(blocks.sparkSession), scratch(blocks.sparkSession) as keep:
        made = keep(staged(blocks.sparkSession, ix.embed_reuse(old_chunks, make_chunks(blocks, docs, max_tokens, overlap), within="doc_id"), "made-chunks"))
    full = staged(blocks.sparkSession, ix.embed_missing(made, embed), "embedded-chunks") if embed is not None else made.drop("needs_embedding")
    return Run(
        documents=ix.upsert_documents(old_documents, ix.only_with_chunks(docs, made)),
        chunks=ix.replace_chunks(old_chunks, full),
        audit=ix.chunk_audit(old_chunks.join(made.select("doc_id").distinct(), "doc_id", "left_semi"), made, version),
        made=made,
    )


#: Tables of an index kept in a ``Store``, and the order of their rows in its files.
TABLES = {"documents": ["doc_id"], "chunks": ["doc_id", "chunk_index"], "audit": ["doc_id", "version"]}


def index_into(store: Store, blocks: DataFrame, docs: DataFrame, batch: str | None = None, max_tokens: int = ch.MAX_TOKENS, overlap: int = ch.OVERLAP_TOKENS, embed=None) -> int | None:
    """Index new versions of documents into a store: chunks, documents and audit in one commit; its number, or None where ``batch`` was there.

    Only what the store has of these documents is read and merged, and only that is written: upserts keep old values, vectors of
    unchanged chunks are used again, old chunks go, each document's audit is numbered on. Another writer's commit meanwhile has the run made anew.
    """
    spark, given = blocks.sparkSession, docs

    def make(s: Store):
        have = {t for x in s.segments() for t in x.tables}
        docs = staged(spark, given, "documents")
        ids = docs.select("doc_id").distinct()
        made = make_chunks(blocks, docs, max_tokens, overlap)

        def old(table: str, like: DataFrame) -> DataFrame:
            return s.read(table, among=ids) if table in have else spark.createDataFrame([], like.schema)

        old_chunks = old("chunks", made.withColumn("embedding", F.array().cast("array<float>")))
        chunks = ix.embed_reuse(old_chunks, made, within="doc_id")
        chunks = staged(spark, ix.embed_missing(chunks, embed) if embed is not None else chunks.drop("needs_embedding"), "made-chunks")
        audit = ix.chunk_audit(old_chunks.join(chunks.select("doc_id").distinct(), "doc_id", "left_semi"), chunks).drop("version")
        log = old("audit", audit.withColumn("version", F.lit(1)))
        number = log.groupBy("doc_id").agg(F.max("version").alias("_last"))
        new = audit.join(number, "doc_id", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + 1).cast("int")).drop("_last")
        changed = ix.only_with_chunks(docs, chunks)
        merged = ix.upsert_documents(old("documents", docs), changed)
        # the audit's earlier rows of a document are written with its new one: in a store a document's rows are replaced together
        return {"chunks": chunks, "documents": merged.join(changed.select("doc_id"), "doc_id", "left_semi"), "audit": log.join(new.select("doc_id"), "doc_id", "left_semi").unionByName(new.select(*log.columns))}, None

    with scratch(spark):  # what is made for a commit goes with it
        return store.change(make, batch=batch)


# -- over the driver's tables ---------------------------------------------------------


def records(spark: SparkSession, d: str) -> DataFrame:
    """Blocks as documents are read: every third page has a running head, a footnote and a page number; others refer to them."""
    b = v.blocks(spark, d)
    page, ro = F.col("page_num_1"), F.col("reading_order")
    number = lambda p: (F.floor(p / 3) % 90 + 1).cast("string")
    own = F.concat("text", F.lit(" note("), number(page), F.lit(")."))
    later = F.concat("text", F.lit(" see ["), number(page + 2), F.lit("] later"))
    text = F.when((page % 3 == 0) & (ro == 1), own).when((page % 3 == 1) & (ro == 2), later).otherwise(F.col("text"))
    place = F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.format_string("%05d", page))
    rest = {
        "header": ("h", 8, F.concat(F.lit("Head "), F.col("doc_id").cast("string"))),
        "footnote": ("n", 9, F.concat(number(page), F.lit(" "), F.replace(F.substring("text", 1, 60), F.lit("."), F.lit("")))),
        "page_number": ("p", 10, page.cast("string")),
    }
    body = F.struct("block_id", "reading_order", "block_type", text.alias("text"))
    extra = [F.struct(F.concat(F.lit(k), place).alias("block_id"), F.lit(at).alias("reading_order"), F.lit(kind).alias("block_type"), t.alias("text")) for kind, (k, at, t) in rest.items()]
    rows = F.when((page % 3 == 0) & (ro == 0), F.array(body, *extra)).otherwise(F.array(body))
    return b.select("doc_id", "page_num_1", F.explode(rows).alias("x")).select("doc_id", "x.block_id", "page_num_1", "x.reading_order", "x.block_type", "x.text")


def _old_chunks(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    """The chunks of an earlier version, which had six pages at most, with vectors that are there for most."""
    with lean(spark), scratch(spark) as keep:
        made = make_chunks(records(spark, d).filter("page_num_1 <= 6"), docs, MAX_TOKENS, OVERLAP)
        return keep(staged(spark, made.withColumn("embedding", F.when(F.col("chunk_index") % 4 != 3, F.array(F.lit(1.0).cast("float")))), "old-chunks"))


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    """What indexing knows of each document, written once: a title takes its document's whole text."""
    return staged(spark, v.docs(spark, d).select("doc_id", "source_filename", "title", "page_range_label"), "documents")


def _run(spark: SparkSession, d: str) -> Run:
    docs = catalogue(spark, d)
    stored = docs.select("doc_id", F.lit("old.pdf").alias("source_filename"), F.lit("Old title").alias("title"), F.lit("kept").alias("s3_prefix")).filter("doc_id % 2 = 0")
    return index_corpus(records(spark, d), docs, stored, _old_chunks(spark, d, docs), 2, MAX_TOKENS, OVERLAP)


def block_refs(spark: SparkSession, d: str) -> DataFrame:
    b = records(spark, d)
    notes = bl.footnotes(b).withColumn("footnote_id", F.col("block_id"))
    found = bl.block_refs(b, bl.link_refs(b, notes, around=None)).filter(F.size("footnote_refs") > 0)
    return found.select("doc_id", "block_id", F.array_join("footnote_refs", ",").alias("footnote_refs"))


def footnotes_found(spark: SparkSession, d: str) -> DataFrame:
    return bl.footnotes(records(spark, d)).select("doc_id", "page_num_1", "block_id", "footnote_number", "text", "footnote_type")


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with boxes down their pages, some over the whole page, every second one with a number; and the sizes of two pages of three."""
    b = v.blocks(spark, d).withColumn("text", F.regexp_replace("text", "[0-9.]", ""))
    page, ro = F.col("page_num_1"), F.col("reading_order")
    w, h = F.when(page % 3 == 0, 600.0).when(page % 3 == 1, 612.0), F.when(page % 3 == 0, 700.0).when(page % 3 == 1, 900.0)
    y = ro.cast("double") * 180
    whole = F.struct(F.lit(1.0).alias("x0"), F.lit(-1.0).alias("y0"), F.coalesce(w, F.lit(612.0)).alias("x1"), F.coalesce(h, F.lit(800.0)).alias("y1"))
    part = F.struct(F.lit(50.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 150).alias("y1"))
    boxed = b.withColumns({"bbox": F.when(F.col("pos") % 11 == 5, whole).otherwise(part), "text": F.when(F.col("pos") % 2 == 0, F.concat((F.col("pos") % 90 + 1).cast("string"), F.lit(". "), "text")).otherwise(F.col("text"))})
    sizes = b.select("doc_id", "page_num_1", w.alias("width"), h.alias("height")).filter("width IS NOT NULL").distinct()
    return boxed, sizes


def footnotes_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes that are told by their place: numbered blocks low on the page, and numbered paragraphs as large as the page."""
    boxed, sizes = _placed(spark, d)
    return bl.footnotes(boxed, sizes).select("doc_id", "page_num_1", "block_id", "footnote_number", F.sha2("text", 256).alias("text_sha"))


def footnote_range(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes on the pages of their document's range."""
    notes = bl.footnotes(records(spark, d))
    return bl.article_range(notes, v.docs(spark, d), page="page_num_1").select("doc_id", "page_num_1", "footnote_number")


def index_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All chunks that a run makes, with what it reuses."""
    made = _run(spark, d).made
    return made.select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "start_page", "end_page", "section_heading", "text", F.array_join("block_ids", ",").alias("block_ids"), "token_count", "needs_embedding")


def index_audit(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).audit


def index_documents(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).documents


_RECORDS = r"""records AS (
  SELECT doc_id, block_id, page_num_1, reading_order, block_type,
         CASE WHEN page_num_1 % 3 = 0 AND reading_order = 1 THEN text || ' note(' || (page_num_1 // 3 % 90 + 1) || ').' WHEN page_num_1 % 3 = 1 AND reading_order = 2 THEN text || ' see [' || ((page_num_1 + 2) // 3 % 90 + 1) || '] later' ELSE text END AS text FROM v_blocks
  UNION ALL SELECT doc_id, 'h' || doc_id || '-' || lpad(page_num_1::VARCHAR, 5, '0'), page_num_1, 8, 'header', 'Head ' || doc_id FROM v_blocks WHERE page_num_1 % 3 = 0 AND reading_order = 0
  UNION ALL SELECT doc_id, 'n' || doc_id || '-' || lpad(page_num_1::VARCHAR, 5, '0'), page_num_1, 9, 'footnote', (page_num_1 // 3 % 90 + 1) || ' ' || replace(substr(text, 1, 60), '.', '') FROM v_blocks WHERE page_num_1 % 3 = 0 AND reading_order = 0
  UNION ALL SELECT doc_id, 'p' || doc_id || '-' || lpad(page_num_1::VARCHAR, 5, '0'), page_num_1, 10, 'page_number', page_num_1::VARCHAR FROM v_blocks WHERE page_num_1 % 3 = 0 AND reading_order = 0)"""


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _flow(p: str, where: str) -> str:
    """The run's relations for DuckDB, their names beginning with ``p``, over the records that satisfy ``where``."""
    each = " UNION ALL ".join(f"SELECT doc_id, page_num_1, block_id, unnest(regexp_extract_all(text, {_quoted(pattern)}, {g}))::INT AS footnote_number, {i} AS k FROM {p}r WHERE block_type NOT IN ('footnote', 'header', 'footer')" for i, (_, pattern, g) in enumerate(tx.REF_PATTERNS))
    cited = " OR ".join(f"regexp_matches(body, {_quoted(x)})" for x in tx.CITATION_SIGNS)
    rest = "body"
    for x in tx.CITATION_SIGNS:
        rest = f"regexp_replace({rest}, {_quoted(x)}, '', 'g')"
    junk = _quoted(r"""[\s.,;:()\[\]'"-]+""")
    title = corpus._word_set("title")
    return rf"""{p}r AS (SELECT * FROM records WHERE {where}),
{p}body AS (SELECT *, regexp_replace(trim(text), '^\d{{1,3}}[\s.)]+', '') AS body FROM {p}r WHERE block_type = 'footnote'),
{p}typed AS (SELECT *, ({cited}) AS cited, trim(regexp_replace({rest}, {junk}, ' ', 'g')) AS rest FROM {p}body),
{p}notes AS (SELECT doc_id, page_num_1, block_id, reading_order, TRY_CAST(regexp_extract(trim(text), '^(\d{{1,3}})\s', 1) AS INT) AS footnote_number, trim(text) AS text,
  CASE WHEN NOT cited THEN 'explanatory' WHEN rest = '' OR len(string_split(rest, ' ')) <= 8 THEN 'citation' ELSE 'mixed' END AS footnote_type FROM {p}typed),
{p}found AS ({each}),
{p}here AS (SELECT doc_id, page_num_1, footnote_number, arg_max(block_id, (reading_order, block_id)) AS id FROM {p}notes GROUP BY ALL),
{p}any AS (SELECT doc_id, footnote_number, arg_max(block_id, (page_num_1, reading_order, block_id)) AS id FROM {p}notes GROUP BY ALL),
{p}refs AS (SELECT f.doc_id, f.block_id, list_sort(list_distinct(list(coalesce(h.id, a.id)))) AS ids FROM {p}found f JOIN {p}any a USING (doc_id, footnote_number) LEFT JOIN {p}here h USING (doc_id, page_num_1, footnote_number) GROUP BY ALL),
{p}flag AS (
  SELECT r.*, ids, CASE WHEN block_type = 'paragraph' AND lag(block_type) OVER w = 'paragraph' AND page_num_1 = lag(page_num_1) OVER w + 1 AND reading_order = 0
    AND NOT regexp_matches(lag(text) OVER w, '[.!?"'')\]]\s*\z') AND length(trim(lag(text) OVER w)) > 0 AND regexp_matches(text, '^\s*\p{{Ll}}') THEN 0 ELSE 1 END AS starts
  FROM {p}r r LEFT JOIN {p}refs USING (doc_id, block_id) WINDOW w AS (PARTITION BY r.doc_id ORDER BY page_num_1, reading_order, block_id)),
{p}isle AS (SELECT *, sum(starts) OVER w AS island, row_number() OVER w AS pos FROM {p}flag WINDOW w AS (PARTITION BY doc_id ORDER BY page_num_1, reading_order, block_id)),
{p}place AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS i, count(*) OVER (PARTITION BY doc_id, island) AS n FROM {p}isle),
{p}whole AS (
  SELECT doc_id, min(pos) AS pos, string_agg(block_id, ',' ORDER BY i) AS block_ids, min(page_num_1) AS start_page, max(page_num_1) AS end_page, arg_min(block_type, i) AS block_type, flatten(list(coalesce(ids, []) ORDER BY i)) AS ids,
    string_agg(CASE WHEN n = 1 THEN text WHEN i = 1 THEN rtrim(text) WHEN i = n THEN ltrim(text) ELSE trim(text) END, ' ' ORDER BY i) AS text FROM {p}place GROUP BY doc_id, island),
{p}label AS (SELECT doc_id, title, TRY_CAST(regexp_extract(page_range_label, '^(\d+)\s*[-–—]\s*(\d+)', 1) AS INT) AS first, TRY_CAST(regexp_extract(page_range_label, '^(\d+)\s*[-–—]\s*(\d+)', 2) AS INT) AS last FROM v_docs),
{p}inside AS (SELECT n.* FROM {p}notes n JOIN {p}label l USING (doc_id) WHERE first IS NULL OR page_num_1 BETWEEN first AND last),
{p}ranged AS (SELECT b.*, first, title FROM {p}whole b JOIN {p}label USING (doc_id) WHERE first IS NULL OR start_page BETWEEN first AND last),
{p}open AS (SELECT *, sum(CASE WHEN start_page = first THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) = 0 AS lead_ FROM {p}ranged),
{p}hits AS (SELECT doc_id, min(pos) AS ord FROM {p}open WHERE lead_ AND block_type = 'heading' AND len({title}) > 0 AND len(list_intersect({corpus._word_set("text")}, {title})) / len({title})::DOUBLE >= 0.6 GROUP BY doc_id),
{p}s AS (SELECT r.*, greatest(1, length(text) // 4) AS tokens, sum((block_type = 'heading')::INT) OVER (PARTITION BY r.doc_id ORDER BY pos)::BIGINT AS section
  FROM {p}ranged r LEFT JOIN {p}hits h USING (doc_id) WHERE (h.ord IS NULL OR r.pos >= h.ord) AND block_type NOT IN ('header', 'footer', 'page_number', 'footnote')),
{p}heads AS (SELECT doc_id, section, block_ids, trim(text) AS title, start_page, end_page FROM {p}s WHERE block_type = 'heading'),
{p}rows AS (SELECT s.*, h.doc_id IS NOT NULL AS held, row_number() OVER (PARTITION BY s.doc_id, s.section ORDER BY s.pos) AS i FROM {p}s s LEFT JOIN {p}heads h ON h.doc_id = s.doc_id AND h.section = s.section WHERE s.block_type <> 'heading'),
{p}packed AS (
  SELECT doc_id, section, pos, i, (CASE WHEN held AND tokens > {MAX_TOKENS} THEN 1 ELSE 0 END)::BIGINT AS part, tokens::BIGINT AS used FROM {p}rows WHERE i = 1
  UNION ALL
  SELECT b.doc_id, b.section, b.pos, b.i, CASE WHEN q.used + b.tokens > {MAX_TOKENS} THEN q.part + 1 ELSE q.part END, (CASE WHEN q.used + b.tokens > {MAX_TOKENS} THEN b.tokens ELSE q.used + b.tokens END)::BIGINT
  FROM {p}packed q JOIN {p}rows b ON b.doc_id = q.doc_id AND b.section = q.section AND b.i = q.i + 1),
{p}parts AS (SELECT doc_id, section, unnest(range(0, top + 1)) AS part FROM (SELECT q.doc_id, q.section, coalesce(max(k.part), 0) AS top FROM (SELECT DISTINCT doc_id, section FROM {p}s) q LEFT JOIN {p}packed k ON k.doc_id = q.doc_id AND k.section = q.section GROUP BY ALL)),
{p}tail AS (SELECT doc_id, section, part + 1 AS part, pos FROM (
    SELECT k.doc_id, k.section, k.part, k.pos, sum(b.tokens) OVER w AS used, row_number() OVER w AS back FROM {p}packed k JOIN {p}rows b USING (doc_id, section, pos) WINDOW w AS (PARTITION BY k.doc_id, k.section, k.part ORDER BY k.pos DESC)) WHERE back = 1 OR used <= {OVERLAP}),
{p}both AS (SELECT doc_id, section, part, pos, 1 AS own FROM {p}packed UNION ALL SELECT doc_id, section, part, pos, 0 FROM {p}tail),
{p}joined AS (
  SELECT q.doc_id, q.section, q.part, min(b.start_page) AS a, max(b.end_page) AS z, string_agg(b.text, chr(10) ORDER BY r.own, r.pos) AS body, string_agg(CASE WHEN r.own = 1 THEN b.block_ids END, ',' ORDER BY r.pos) AS ids,
    list_distinct(flatten(list(CASE WHEN r.own = 1 THEN b.ids ELSE [] END))) AS refs
  FROM {p}parts q LEFT JOIN {p}both r ON r.doc_id = q.doc_id AND r.section = q.section AND r.part = q.part LEFT JOIN {p}rows b ON b.doc_id = r.doc_id AND b.pos = r.pos GROUP BY ALL),
{p}lines AS (
  SELECT j.doc_id, j.section, j.part, string_agg('[' || n.footnote_number || '] ' || CASE WHEN n.footnote_type IN ('citation', 'mixed') THEN '[cites:] ' ELSE '' END || n.text, chr(10) ORDER BY n.block_id) AS notes
  FROM (SELECT doc_id, section, part, unnest(refs) AS id FROM {p}joined) j JOIN {p}inside n ON n.doc_id = j.doc_id AND n.block_id = j.id GROUP BY ALL),
{p}texts AS (
  SELECT g.doc_id, g.section, g.part, h.title AS section_heading,
    coalesce(least(g.a, CASE WHEN g.part = 0 THEN h.start_page END), g.a, CASE WHEN g.part = 0 THEN h.start_page END, 1) AS start_page, coalesce(greatest(g.z, CASE WHEN g.part = 0 THEN h.end_page END), g.z, CASE WHEN g.part = 0 THEN h.end_page END, 1) AS end_page,
    trim(coalesce(h.title || chr(10), '') || CASE WHEN h.title IS NOT NULL AND g.body IS NOT NULL THEN chr(10) ELSE '' END || coalesce(g.body, '') || coalesce(chr(10) || chr(10) || '---' || chr(10) || 'Footnotes:' || chr(10) || l.notes, ''), ' ' || chr(10)) AS text,
    concat_ws(',', CASE WHEN g.part = 0 THEN h.block_ids END, g.ids) AS block_ids
  FROM {p}joined g LEFT JOIN {p}heads h ON h.doc_id = g.doc_id AND h.section = g.section LEFT JOIN {p}lines l ON l.doc_id = g.doc_id AND l.section = g.section AND l.part = g.part),
{p}chunks AS (
  SELECT substr(sha256(doc_id || ':chunk:' || chunk_index), 1, 24) AS chunk_id, * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_index FROM {p}texts))"""


_BASE = v.with_views("words", "v_docs", "v_blocks", recursive=True) + ",\n" + _RECORDS + ",\n"
_BOTH = _BASE + _flow("n_", "true") + ",\n" + _flow("o_", "page_num_1 <= 6")

_CHUNKS_SQL = (
    _BOTH
    + """ SELECT n.chunk_id, n.doc_id, n.chunk_index, n.start_page, n.end_page, n.section_heading, n.text, n.block_ids, greatest(1, length(n.text) // 4)::INT AS token_count,
  NOT coalesce(o.text = n.text AND o.chunk_index % 4 <> 3, false) AND length(n.text) > 0 AS needs_embedding FROM n_chunks n LEFT JOIN o_chunks o USING (chunk_id)"""
)

_AUDIT_SQL = (
    _BOTH
    + """ SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, count(n.chunk_id) AS total_chunks, count(*) FILTER (o.chunk_id IS NULL) AS added, count(*) FILTER (n.chunk_id IS NULL) AS removed,
  count(*) FILTER (n.text <> o.text) AS text_changed, count(*) FILTER (n.text = o.text) AS unchanged, 2 AS version
  FROM n_chunks n FULL JOIN o_chunks o USING (chunk_id) GROUP BY 1 HAVING count(n.chunk_id) > 0"""
)

_DOCUMENTS_SQL = (
    _BOTH
    + """, n AS (SELECT doc_id, source_filename, title, page_range_label FROM v_docs WHERE doc_id IN (SELECT doc_id FROM n_chunks)), o AS (SELECT doc_id, 'old.pdf' AS source_filename, 'Old title' AS title, 'kept' AS s3_prefix FROM v_docs WHERE doc_id % 2 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.source_filename, o.source_filename) AS source_filename, coalesce(n.title, o.title) AS title, n.page_range_label, o.s3_prefix FROM o FULL JOIN n ON o.doc_id = n.doc_id"""
)

_PLACE_SQL = (
    v.with_views("words", "v_blocks")
    + r""", p AS (SELECT *, regexp_replace(text, '[0-9.]', '', 'g') AS t, CASE page_num_1 % 3 WHEN 0 THEN 700.0::DOUBLE WHEN 1 THEN 900.0::DOUBLE ELSE 800.0::DOUBLE END AS h FROM v_blocks),
n AS (SELECT *, pos % 90 + 1 AS footnote_number, trim((pos % 90 + 1) || '. ' || t) AS body, pos % 11 = 5 AS whole, CASE WHEN pos % 11 = 5 THEN (h - 1) / 2 / h ELSE (reading_order * 180 + 75) / h END AS middle FROM p WHERE pos % 2 = 0)
SELECT doc_id, page_num_1, block_id, footnote_number::INT AS footnote_number, sha256(body) AS text_sha FROM n WHERE (whole AND block_type = 'paragraph') OR middle BETWEEN 0.72 AND 1.0"""
)

ALL = [
    ("footnotes_by_place", footnotes_by_place, _PLACE_SQL),
    ("block_refs", block_refs, _BASE + _flow("n_", "true") + " SELECT doc_id, block_id, array_to_string(ids, ',') AS footnote_refs FROM n_refs"),
    ("footnotes_found", footnotes_found, _BASE + _flow("n_", "true") + " SELECT doc_id, page_num_1, block_id, footnote_number, text, footnote_type FROM n_notes WHERE footnote_number IS NOT NULL"),
    ("footnote_range", footnote_range, _BASE + _flow("n_", "true") + " SELECT doc_id, page_num_1, footnote_number FROM n_inside WHERE footnote_number IS NOT NULL"),
    ("index_chunks", index_chunks, _CHUNKS_SQL),
    ("index_audit", index_audit, _AUDIT_SQL),
    ("index_documents", index_documents, _DOCUMENTS_SQL),
]
