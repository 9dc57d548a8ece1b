"""Retrieval queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.analyzer import STOP_WORDS
from folioloom.functions.text import TYPE_LABELS
from folioloom.operators import citations as ct
from folioloom.operators import index as ix
from folioloom.operators import retrieval as rt
from folioloom.plans import views as v
from folioloom.session import shared_dir, staged, table
from folioloom.sources.providers import OverlapReranker

QUERY = "the worthless reports"
RARE = "worthless casino trash"
FILTERS = rt.Filters(year_from=1880, year_to=1990, language="en")

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _terms(source: str, key: str, text: str) -> str:
    return rf"SELECT {key}, t.term FROM {source}, unnest(regexp_split_to_array(trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS t(term) WHERE t.term <> '' AND t.term NOT IN ({_STOP})"


_VEC = f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {v.QUERY_VECTOR})"


def _dist(e: str = "embedding") -> str:
    return f"1.0 - list_dot_product({e}::DOUBLE[], {_VEC}) / (sqrt(list_dot_product({e}::DOUBLE[], {e}::DOUBLE[])) * sqrt(list_dot_product({_VEC}, {_VEC})))"


def _query_terms(q: str) -> list[str]:
    from folioloom.functions.analyzer import query_terms

    return query_terms(q)


def _match(source: str, key: str, text: str, query: str) -> str:
    terms = ", ".join(f"'{t}'" for t in _query_terms(query))
    damped = "list_sum(list_transform(range(1, least(tf, 256) + 1), lambda i: 1.0::DOUBLE / (i * i))) / 1.64493406685"
    return f"SELECT {key}, count(*) AS n_terms, sum({damped}) / {len(_query_terms(query))}.0::DOUBLE AS score FROM (SELECT {key}, term, count(*) AS tf FROM ({_terms(source, key, text)}) GROUP BY ALL) WHERE term IN ({terms}) GROUP BY {key}"


def filter_optional(spark: SparkSession, d: str) -> DataFrame:
    return rt.Filters(document_type="obituary", year_from=1900, language="en").apply(v.docs(spark, d)).select("doc_id", "year", "language", "document_type")


def filter_null_excluded(spark: SparkSession, d: str) -> DataFrame:
    return rt.Filters(year_to=3000).apply(v.docs(spark, d)).select("doc_id", "year")


def ilike_suffix(spark: SparkSession, d: str) -> DataFrame:
    return rt.Filters(source_filename="_7.PDF").apply(v.docs(spark, d)).select("doc_id", "source_filename")


def publication_like(spark: SparkSession, d: str) -> DataFrame:
    return rt.Filters(publication="SRC1").apply(v.docs(spark, d)).select("doc_id", "publication")


def author_parts(spark: SparkSession, d: str) -> DataFrame:
    return rt.Filters(author="src3, A Author").apply(v.docs(spark, d)).select("doc_id", "author")


def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    near = rt.nearest(v.chunks(spark, d), v.query_vector(spark, d), 25)
    return near.select("chunk_id", F.round("dist", 6).alias("dist"), "vrank")


def target_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = v.chunks(spark, d).filter("embedding IS NOT NULL")
    return rt.target_rank(rows, v.query_vector(spark, d), "c100").select("chunk_id", "rank")


def fts_and(spark: SparkSession, d: str) -> DataFrame:
    return rt.text_search(v.chunks(spark, d), "stupid worthless", 50, least=1)


def fts_or_fallback(spark: SparkSession, d: str) -> DataFrame:
    return rt.text_search(v.chunks(spark, d), RARE, 50, least=10)


def fts_count(spark: SparkSession, d: str) -> DataFrame:
    found = rt.matches(rt.postings(v.chunks(spark, d)), _query_terms("stupid"))
    return found.agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def stemmed_fts(spark: SparkSession, d: str) -> DataFrame:
    return rt.text_search(v.chunks(spark, d), "reports worthless", 50, analyser="english", fallback=True)


_HYBRID_ROWS = f"""
, f_docs AS (SELECT doc_id FROM v_docs WHERE year >= 1880 AND year <= 1990 AND language = 'en'),
allowed AS (SELECT * FROM v_chunks WHERE doc_id IN (SELECT doc_id FROM f_docs)),
near AS (SELECT chunk_id, {_dist()} AS dist FROM allowed WHERE embedding IS NOT NULL ORDER BY dist, chunk_id LIMIT 120),
vec AS (SELECT chunk_id, row_number() OVER (ORDER BY dist, chunk_id) AS vrank FROM near),
hits AS ({_match('allowed', 'chunk_id', 'text', 'worthless stupid trash')}),
scope AS ({_match('v_chunks', 'chunk_id', 'text', 'worthless stupid trash')}),
fields AS (SELECT doc_id, title || ' ' || author AS t FROM v_docs),
boost AS ({_match('fields', 'doc_id', 't', 'worthless stupid trash')}),
chosen AS (SELECT * FROM hits WHERE n_terms = 3 OR (SELECT count(*) FROM scope WHERE n_terms = 3) < 10),
txt AS (SELECT c.chunk_id, round(c.score * 0.4 + coalesce(b.score, 0.0), 9) AS rank_score
        FROM chosen c JOIN v_chunks k USING (chunk_id) LEFT JOIN boost b ON b.doc_id = k.doc_id ORDER BY rank_score DESC, c.chunk_id LIMIT 120),
ranked AS (SELECT chunk_id, row_number() OVER (ORDER BY rank_score DESC, chunk_id) AS trank FROM txt),
fused AS (SELECT coalesce(vec.chunk_id, ranked.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60.0::DOUBLE + vrank), 0.0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + trank), 0.0) AS score
          FROM vec FULL JOIN ranked ON vec.chunk_id = ranked.chunk_id ORDER BY score DESC, 1 LIMIT 120)
"""

_HYBRID_QUERY = "worthless stupid trash"


def _hybrid(spark: SparkSession, d: str, per_doc: int = 0) -> DataFrame:
    return rt.retrieve(v.chunks(spark, d), v.docs(spark, d), _HYBRID_QUERY, v.query_vector(spark, d), 40, FILTERS, per_doc=per_doc)


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, per_doc=5).select("chunk_id", "doc_id", F.round("score", 9).alias("score"), "title", "year", "publication")


def diversity_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most two documents a source and 30 in all, by length of text."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("n_chars").cast("double").alias("score"))
    return rt.diversity_cap(rows, 2, 30).select("chunk_id", "doc_id", "score")


def rerank_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = v.chunks(spark, d).join(v.docs(spark, d), "doc_id").drop("embedding")
    return rt.rerank_rows(rows, "worthless stupid trash", OverlapReranker(), 50, 0.3).select("chunk_id", "score")


def figure_hybrid(spark: SparkSession, d: str) -> DataFrame:
    found = rt.retrieve_figures(v.figures(spark, d), v.docs(spark, d), "la de", v.query_vector(spark, d), k=8, filters=rt.Filters(year_from=1880))
    return found.select("figure_id", "page_num", F.round("score", 9).alias("score"))


_FIGURE_SQL = v.with_views("words", "v_docs", "v_figures") + f"""
, allowed AS (SELECT * FROM v_figures WHERE doc_id IN (SELECT doc_id FROM v_docs WHERE year >= 1880)),
near AS (SELECT figure_id, {_dist()} AS dist FROM allowed WHERE embedding IS NOT NULL ORDER BY dist, figure_id LIMIT 30),
vec AS (SELECT figure_id, row_number() OVER (ORDER BY dist, figure_id) AS vrank FROM near),
hits AS ({_match('allowed', 'figure_id', 'caption', 'la de')}),
txt AS (SELECT figure_id, round(score * 0.4, 9) AS s FROM hits WHERE n_terms = 2 ORDER BY s DESC, figure_id LIMIT 30),
ranked AS (SELECT figure_id, row_number() OVER (ORDER BY s DESC, figure_id) AS trank FROM txt),
fused AS (SELECT coalesce(vec.figure_id, ranked.figure_id) AS figure_id, coalesce(1.0::DOUBLE / (60.0::DOUBLE + vrank), 0.0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + trank), 0.0) AS score
          FROM vec FULL JOIN ranked ON vec.figure_id = ranked.figure_id ORDER BY score DESC, 1 LIMIT 8)
SELECT f.figure_id, g.page_num, round(f.score, 9) AS score FROM fused f JOIN v_figures g USING (figure_id)
"""


def contextual_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rt.contextual_figures(v.chunks(spark, d), v.figures(spark, d)).select("chunk_id", "figure_id", "page_num")


def figures_on_pages(spark: SparkSession, d: str) -> DataFrame:
    pairs = v.chunks(spark, d).select("doc_id", F.col("start_page").alias("page_num"))
    return rt.figures_on_pages(v.figures(spark, d), pairs).select("figure_id", "page_num")


def doc_context(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d).select(F.col("block_id").alias("chunk_id"), "doc_id", F.col("page_num_1").alias("start_page"), "text")
    return rt.document_context(b, 3, 2, window=1).select("chunk_id", "start_page", "text")


def browse_list(spark: SparkSession, d: str) -> DataFrame:
    return rt.browse(v.docs(spark, d), rt.Filters(author="Author EN", document_type="index")).select("doc_id", "author", "title", "document_type")


def browse_count(spark: SparkSession, d: str) -> DataFrame:
    return rt.count_by(v.docs(spark, d), "publication")


def overview(spark: SparkSession, d: str) -> DataFrame:
    return rt.overview(v.docs(spark, d))


def distribution(spark: SparkSession, d: str) -> DataFrame:
    return rt.distribution(v.blocks(spark, d))


def benchmark_scores(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "events")
    latency, tokens, rounds = F.col("event_id") % 25, F.col("event_id") % 150 * 100, (F.col("event_id") % 6 + 1).cast("int")
    score = rt.benchmark_score(latency.cast("double"), tokens.cast("double"), rounds)
    return o.select("event_id", F.when(F.col("event_type") == "error", 0.0).otherwise(score).alias("score"))


def search_documents(spark: SparkSession, d: str) -> DataFrame:
    return ix.search_documents(v.docs(spark, d), "Re").select("doc_id", "title")


# -- answers over conversations: markers are made from turn numbers -----------------


def _answers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    a, b, e = (F.col("turn") * 3 % 7 + 1), (F.col("conv_id") % 5 + 1), (F.col("turn") % 4 + 1)
    text = F.concat(F.lit("See ["), a.cast("string"), F.lit(", "), b.cast("string"), F.lit("] and ["), e.cast("string"), F.lit("]. "), F.col("text"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), text.alias("text"))


_ANSWERS = """v_answers AS (
  SELECT conv_id * 1000 + turn AS answer_id, 'See [' || (turn * 3 % 7 + 1) || ', ' || (conv_id % 5 + 1) || '] and [' || (turn % 4 + 1) || ']. ' || text AS text
  FROM conversations WHERE role = 'assistant')"""

_CITED = r"""cited AS (
  SELECT answer_id, unnest(l) AS old, generate_subscripts(l, 1) AS ord FROM (
    SELECT answer_id, list_transform(flatten(list_transform(regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1), lambda g: string_split(g, ','))), lambda x: trim(x)::INT) AS l FROM v_answers)),
mapping AS (SELECT answer_id, old, row_number() OVER (PARTITION BY answer_id ORDER BY min(ord)) AS new FROM cited GROUP BY answer_id, old)"""


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return a.select("answer_id", F.array_join(ct.cited_set(F.col("text")).cast("array<string>"), ",").alias("cited"))


def citation_renumber_map(spark: SparkSession, d: str) -> DataFrame:
    return ct.index_map(_answers(spark, d)).select("answer_id", "old", F.col("new").cast("long").alias("new"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Seven sources per answer, ids in a row from anywhere in the range of all documents; the sixth repeats the first's document and page."""
    docs = v.docs(spark, d)
    a = _answers(spark, d).select("answer_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("position"))
    place = F.when(F.col("position") == 6, 1).otherwise(F.col("position"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    of = (F.col("answer_id") * 7919 + F.floor(F.col("answer_id") / 1000) * 613 + place) % ((high or 0) - (low or 0) + 1) + (low or 0)
    keyed = a.select("answer_id", "position", of.cast("long").alias("doc_id"), F.concat(F.lit("c"), F.col("position").cast("string")).alias("chunk_id"))
    start = (F.col("doc_id") % 9 + 1).cast("int")
    return keyed.join(docs, "doc_id").withColumns({"start_page": start, "end_page": (start + F.col("doc_id") % 2).cast("int")})


def citation_collapse(spark: SparkSession, d: str) -> DataFrame:
    found = ct.collapse(ct.index_map(_answers(spark, d)), _sources(spark, d))
    return found.select("answer_id", "old", F.col("new").cast("long").alias("new"))


_SOURCE_SQL = """v_sources AS (
  SELECT a.answer_id, p.position, d.*, (d.doc_id % 9 + 1)::INT AS start_page, (d.doc_id % 9 + 1 + d.doc_id % 2)::INT AS end_page
  FROM (SELECT answer_id, unnest(range(1, 8)) AS position FROM v_answers) p JOIN v_answers a USING (answer_id)
  JOIN v_docs d ON d.doc_id = (a.answer_id * 7919 + a.answer_id // 1000 * 613 + CASE WHEN p.position = 6 THEN 1 ELSE p.position END) % (SELECT max(doc_id) - min(doc_id) + 1 FROM v_docs) + (SELECT min(doc_id) FROM v_docs))"""

_COLLAPSED = """collapsed AS (
  SELECT answer_id, old, dense_rank() OVER (PARTITION BY answer_id ORDER BY first) AS new FROM (
    SELECT m.answer_id, m.old, min(m.new) OVER (PARTITION BY m.answer_id, s.doc_id, s.start_page, CASE WHEN s.doc_id IS NULL THEN m.old END) AS first
    FROM mapping m LEFT JOIN v_sources s ON s.answer_id = m.answer_id AND s.position = m.old))"""


def bibliography(spark: SparkSession, d: str) -> DataFrame:
    sources = _sources(spark, d)
    mapping = ct.collapse(ct.index_map(_answers(spark, d)), sources)
    return ct.bibliography(sources, mapping)


_BIB_SQL = v.with_views("words", "v_docs") + ",\n" + ",\n".join((_ANSWERS, _CITED, _SOURCE_SQL, _COLLAPSED)) + r"""
, first AS (
  SELECT s.*, c.new, row_number() OVER (PARTITION BY s.answer_id, s.doc_id, s.start_page ORDER BY s.position) AS r FROM v_sources s JOIN collapsed c ON c.answer_id = s.answer_id AND c.old = s.position),
lines AS (
  SELECT answer_id, new, position, replace(trim('[' || new || '] ' || author || CASE WHEN year IS NULL THEN '' ELSE ' (' || year || ')' END) || '. ''' || trim(replace(title, '*', '')) || ''', *' || publication || '*, '
    || CASE WHEN start_page = end_page THEN 'p. ' || start_page ELSE 'pp. ' || start_page || '–' || end_page END, '..', '.') AS line FROM first WHERE r = 1)
SELECT answer_id, chr(10) || chr(10) || '---' || chr(10) || '**Sources:**' || chr(10) || string_agg(line, chr(10) ORDER BY new, position) AS bibliography FROM lines GROUP BY answer_id
"""


def renumbered_answers(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    m = ct.collapse(ct.index_map(a), _sources(spark, d)).groupBy("answer_id").agg(F.collect_list(F.struct("old", "new")).alias("m"))
    return a.join(m, "answer_id", "left").select("answer_id", ct.renumber("text", "m").alias("text"))


_RENUMBERED_SQL = v.with_views("words", "v_docs") + ",\n" + ",\n".join((_ANSWERS, _CITED, _SOURCE_SQL, _COLLAPSED)) + r"""
, maps AS (SELECT answer_id, map_from_entries(list((old, new::INT))) AS m FROM collapsed GROUP BY 1),
cut AS (SELECT answer_id, regexp_split_to_array(text, '\[\d+(?:\s*,\s*\d+)*\]') AS gaps, regexp_extract_all(text, '\[(\d+(?:\s*,\s*\d+)*)\]', 1) AS marks FROM v_answers),
each AS (SELECT answer_id, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, marks FROM cut),
made AS (SELECT answer_id, i, gap || coalesce('[' || array_to_string(list_transform(string_split(marks[i], ','), lambda x: coalesce(m[trim(x)::INT], trim(x)::INT)::VARCHAR), ', ') || ']', '') AS part FROM each JOIN maps USING (answer_id))
SELECT answer_id, string_agg(part, '' ORDER BY i) AS text FROM made GROUP BY 1"""


def retrieve_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid query over a stored index: postings by term, vectors with their lengths."""
    where = f"{shared_dir(spark)}/folioloom/index-{uuid.uuid4().hex}"
    rt.write_postings(rt.postings(v.chunks(spark, d)), f"{where}/postings")
    stored = staged(spark, rt.with_norms(v.chunks(spark, d)), "index-chunks")
    found = rt.retrieve(stored, v.docs(spark, d), _HYBRID_QUERY, v.query_vector(spark, d), 40, FILTERS, per_doc=5, index=spark.read.parquet(f"{where}/postings"))
    return found.select("chunk_id", F.round("score", 9).alias("score"))


def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    """What the keyword tool prints of its hits, before their texts."""
    found = rt.retrieve(v.chunks(spark, d), v.docs(spark, d), _HYBRID_QUERY, v.query_vector(spark, d), 40, FILTERS)
    return found.select("chunk_id", rt.source_line().alias("line"))


_KEYWORD_SQL = v.with_views("words", "v_docs", "v_chunks") + _HYBRID_ROWS + " SELECT f.chunk_id, 'SOURCE: ' || d.source_filename || CASE WHEN d.title <> '' THEN ' | TITLE: ' || d.title ELSE '' END || CASE WHEN d.year IS NOT NULL THEN ' (' || d.year || ')' ELSE '' END AS line FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 40) f JOIN v_chunks k USING (chunk_id) JOIN v_docs d ON d.doc_id = k.doc_id"


_ATTRIBUTES = rt.Filters(document_type="obituary", publication="src1", year_from=1875)


def attribute_search(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid query of the attribute tool: among documents of one type, publication and time."""
    found = rt.retrieve(v.chunks(spark, d), v.docs(spark, d), _HYBRID_QUERY, v.query_vector(spark, d), 40, _ATTRIBUTES, per_doc=5)
    return found.select("chunk_id", "document_type", "publication", "year", F.round("score", 9).alias("score"))


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """The index tool's query: the same over one file's chunks, which are that file's blocks."""
    b = v.blocks(spark, d).select(F.col("block_id").alias("chunk_id"), "doc_id", "text", "page_num_1", F.lit(None).cast("array<float>").alias("embedding"))
    found = rt.retrieve(b, v.docs(spark, d), " ".join(rt.author_parts("tion, er")), v.query_vector(spark, d), 10, rt.Filters(source_filename="doc-9.pdf"))
    return found.select("chunk_id", "source_filename", "text")


_ATTRIBUTE_SQL = (
    v.with_views("words", "v_docs", "v_chunks")
    + _HYBRID_ROWS.replace("year >= 1880 AND year <= 1990 AND language = 'en'", "document_type = 'obituary' AND publication ILIKE '%src1%' AND year >= 1875")
    + " SELECT f.chunk_id, d.document_type, d.publication, d.year, round(f.score, 9) AS score FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 40) f JOIN v_chunks k USING (chunk_id) JOIN v_docs d ON d.doc_id = k.doc_id"
)

_INDEX_QUERY = " ".join(rt.author_parts("tion, er"))

_INDEX_SQL = (
    v.with_views("words", "v_docs", "v_blocks")
    + f""", b AS (SELECT block_id AS chunk_id, doc_id, text FROM v_blocks), own AS (SELECT * FROM b WHERE doc_id = 9),
hits AS ({_match('own', 'chunk_id', 'text', _INDEX_QUERY)}), scope AS ({_match('b', 'chunk_id', 'text', _INDEX_QUERY)}), fields AS (SELECT doc_id, title || ' ' || author AS t FROM v_docs WHERE doc_id = 9), boost AS ({_match('fields', 'doc_id', 't', _INDEX_QUERY)}),
chosen AS (SELECT * FROM hits WHERE n_terms = {len(_query_terms(_INDEX_QUERY))} OR (SELECT count(*) FROM scope WHERE n_terms = {len(_query_terms(_INDEX_QUERY))}) < 10),
top AS (SELECT c.chunk_id FROM chosen c LEFT JOIN boost x ON x.doc_id = 9 ORDER BY round(c.score * 0.4 + coalesce(x.score, 0.0), 9) DESC, c.chunk_id LIMIT 10)
SELECT chunk_id, 'doc-9.pdf' AS source_filename, text FROM top JOIN own USING (chunk_id)"""
)


def history_last4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("text", F.when(F.col("role") == "assistant", F.concat("text", F.lit(" [2, 3] Sources: x"))).otherwise(F.col("text")))
    return ct.clean_history(c).select("conv_id", "turn", "role", "text")


def context_trim(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    rows = doc.select(F.col("source").alias("answer_id"), F.col("doc_id").alias("chunk_id"), (F.col("doc_id") * 7919 % 1009).alias("score"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long").alias("tokens"))
    return ct.trim_context(rows, 5000).select("answer_id", "chunk_id", "tokens")


def context_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = v.docs(spark, d).withColumns({"section_heading": F.when(F.col("doc_id") % 2 == 0, F.lit("Part")), "start_page": F.lit(2), "end_page": (F.col("doc_id") % 2 + 2).cast("int"), "author": F.when(F.col("doc_id") % 4 != 0, F.col("author"))})
    return rows.select("doc_id", ct.context_header(F.col("doc_id")).alias("header"))


def strip_sources(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").filter("role = 'assistant'")
    at_start = F.col("turn") % 4 == 1
    text = F.when(at_start, F.concat(F.lit("A\nSources:\n"), F.col("text"))).otherwise(F.concat("text", F.lit("\n---\n**References:**\nx")))
    return c.select("conv_id", "turn", ct.strip_sources(text).alias("text"))


_RERANK_SQL = (
    v.with_views("words", "v_docs")
    + r""", r AS (SELECT 'c' || doc_id AS chunk_id, round(len(list_intersect(['worthless', 'stupid', 'trash'], regexp_split_to_array(lower('Author: ' || author || chr(10) || 'Document: ' || title || chr(10) || text), '\s+'))) / 3.0::DOUBLE, 6) AS score FROM v_docs JOIN documents USING (doc_id))
SELECT chunk_id, score FROM (SELECT * FROM r ORDER BY score DESC, chunk_id LIMIT 50) WHERE score >= 0.3"""
)

_LABELS = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in TYPE_LABELS.values()) + "]"

_HEADER_SQL = (
    v.with_views("words", "v_docs")
    + f""", h AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN author ELSE '' END AS a, coalesce(year::VARCHAR, '') AS y, title AS t FROM v_docs)
SELECT doc_id, '[' || doc_id || '] [' || ({_LABELS})[(doc_id % 13 + 1)::INT] || '] '
  || CASE WHEN a <> '' AND y <> '' THEN a || ' (' || y || '), "' || t || '"' WHEN a <> '' THEN a || ', "' || t || '"' WHEN y <> '' THEN '"' || t || '" (' || y || ')' ELSE t END
  || CASE WHEN doc_id % 2 = 0 THEN ', p.2 — Part' ELSE ', pp.2-3' END AS header FROM h"""
)

_STRIP_SQL = "SELECT conv_id, turn, CASE WHEN turn % 4 = 1 AND 1 < (11 + length(text)) * 0.3 THEN 'A' || chr(10) || 'Sources:' || chr(10) || text WHEN turn % 4 = 1 THEN 'A' ELSE rtrim(text, ' ') END AS text FROM conversations WHERE role = 'assistant'"

_HYBRID = v.with_views("words", "v_docs", "v_chunks") + _HYBRID_ROWS

ALL = [
    ("filter_optional", filter_optional, v.with_views("words", "v_docs") + " SELECT doc_id, year, language, document_type FROM v_docs WHERE document_type = 'obituary' AND year >= 1900 AND language = 'en'"),
    ("filter_null_excluded", filter_null_excluded, v.with_views("words", "v_docs") + " SELECT doc_id, year FROM v_docs WHERE year <= 3000"),
    ("ilike_suffix", ilike_suffix, v.with_views("words", "v_docs") + " SELECT doc_id, source_filename FROM v_docs WHERE source_filename ILIKE '%_7.PDF'"),
    ("publication_like", publication_like, v.with_views("words", "v_docs") + " SELECT doc_id, publication FROM v_docs WHERE publication ILIKE '%SRC1%'"),
    ("author_parts", author_parts, v.with_views("words", "v_docs") + " SELECT doc_id, author FROM v_docs WHERE author ILIKE '%src3%' AND author ILIKE '%author%'"),
    ("knn_topk", knn_topk, v.with_views("v_chunks") + f" SELECT chunk_id, round(dist, 6) AS dist, row_number() OVER (ORDER BY dist, chunk_id) AS vrank FROM (SELECT chunk_id, {_dist()} AS dist FROM v_chunks WHERE embedding IS NOT NULL ORDER BY dist, chunk_id LIMIT 25)"),
    ("target_rank", target_rank, v.with_views("v_chunks") + f", d AS (SELECT chunk_id, {_dist()} AS dist FROM v_chunks WHERE embedding IS NOT NULL) SELECT 'c100' AS chunk_id, count(*) + 1 AS rank FROM d WHERE dist < (SELECT dist FROM d WHERE chunk_id = 'c100')"),
    ("fts_and", fts_and, v.with_views("v_chunks") + f", h AS ({_match('v_chunks', 'chunk_id', 'text', 'stupid worthless')}), t AS (SELECT chunk_id, round(score * 0.4, 9) AS rank_score FROM h WHERE n_terms = 2 ORDER BY rank_score DESC, chunk_id LIMIT 50) SELECT *, row_number() OVER (ORDER BY rank_score DESC, chunk_id) AS trank FROM t"),
    ("fts_or_fallback", fts_or_fallback, v.with_views("v_chunks") + f", h AS ({_match('v_chunks', 'chunk_id', 'text', RARE)}), t AS (SELECT chunk_id, round(score * 0.4, 9) AS rank_score FROM h WHERE n_terms = 3 OR (SELECT count(*) FROM h WHERE n_terms = 3) < 10 ORDER BY rank_score DESC, chunk_id LIMIT 50) SELECT *, row_number() OVER (ORDER BY rank_score DESC, chunk_id) AS trank FROM t"),
    ("fts_count", fts_count, v.with_views("v_chunks") + f", h AS ({_match('v_chunks', 'chunk_id', 'text', 'stupid')}) SELECT count(*) AS n, round(sum(score), 6) AS score FROM h"),
    ("stemmed_fts", stemmed_fts, None),
    ("rrf_hybrid", rrf_hybrid, _HYBRID + " SELECT f.chunk_id, k.doc_id, round(f.score, 9) AS score, d.title, d.year, d.publication FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 40) f JOIN v_chunks k USING (chunk_id) JOIN v_docs d ON d.doc_id = k.doc_id"),
    ("diversity_cap", diversity_cap, "SELECT chunk_id, doc_id, score FROM (SELECT doc_id AS chunk_id, source AS doc_id, n_chars::DOUBLE AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 2 ORDER BY score DESC, chunk_id LIMIT 30"),
    ("rerank_stub", rerank_stub, _RERANK_SQL),
    ("figure_hybrid", figure_hybrid, _FIGURE_SQL),
    ("contextual_pairs", contextual_pairs, v.with_views("words", "v_chunks", "v_figures") + r" SELECT DISTINCT c.chunk_id, f.figure_id, f.page_num FROM v_chunks c JOIN v_figures f ON f.doc_id = c.doc_id AND f.page_num BETWEEN c.start_page AND c.end_page WHERE f.caption <> '' AND NOT regexp_matches(f.caption, '^Figure on p\.\d+$')"),
    ("figures_on_pages", figures_on_pages, v.with_views("words", "v_chunks", "v_figures") + " SELECT f.figure_id, f.page_num FROM v_figures f WHERE EXISTS (SELECT 1 FROM v_chunks c WHERE c.doc_id = f.doc_id AND c.start_page = f.page_num)"),
    ("doc_context", doc_context, v.with_views("words", "v_blocks") + " SELECT block_id AS chunk_id, page_num_1 AS start_page, text FROM v_blocks WHERE doc_id = 3 AND page_num_1 BETWEEN 1 AND 3 ORDER BY page_num_1, block_id LIMIT 10"),
    ("browse_list", browse_list, v.with_views("words", "v_docs") + " SELECT doc_id, author, title, document_type FROM v_docs WHERE author ILIKE '%Author%' AND author ILIKE '%EN%' AND document_type = 'index' ORDER BY doc_id LIMIT 25"),
    ("browse_count", browse_count, v.with_views("words", "v_docs") + " SELECT publication AS value, count(*) AS n FROM v_docs GROUP BY 1"),
    ("overview", overview, v.with_views("words", "v_docs") + " SELECT count(*) AS documents, min(year) AS first_year, max(year) AS last_year, count(DISTINCT publication) AS publications FROM v_docs"),
    ("distribution", distribution, v.with_views("words", "v_blocks") + " SELECT doc_id, count(*) AS n FROM v_blocks GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 5"),
    ("benchmark_scores", benchmark_scores, "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE round(40.0 + 30.0 * greatest(0.0, least(1.0, (20.0 - event_id % 25) / 12.0)) + 20.0 * greatest(0.0, least(1.0, (12000.0 - event_id % 150 * 100) / 8000.0)) + greatest(0.0, 10.0 - 2.5 * greatest(0, event_id % 6)), 2) END::DOUBLE AS score FROM events"),
    ("search_documents", search_documents, v.with_views("words", "v_docs") + " SELECT doc_id, title FROM v_docs WHERE source_filename ILIKE '%Re%' OR title ILIKE '%Re%'"),
    ("citation_extract", citation_extract, "WITH " + _ANSWERS + ", " + _CITED + " SELECT answer_id, string_agg(old::VARCHAR, ',' ORDER BY old) AS cited FROM mapping GROUP BY 1"),
    ("citation_renumber_map", citation_renumber_map, "WITH " + _ANSWERS + ", " + _CITED + " SELECT answer_id, old, new FROM mapping"),
    ("citation_collapse", citation_collapse, v.with_views("words", "v_docs") + ",\n" + ",\n".join((_ANSWERS, _CITED, _SOURCE_SQL, _COLLAPSED)) + " SELECT answer_id, old, new FROM collapsed"),
    ("bibliography", bibliography, _BIB_SQL),
    ("renumbered_answers", renumbered_answers, _RENUMBERED_SQL),
    ("retrieve_indexed", retrieve_indexed, _HYBRID + " SELECT f.chunk_id, round(f.score, 9) AS score FROM (SELECT * FROM fused ORDER BY score DESC, chunk_id LIMIT 40) f"),
    ("keyword_search", keyword_search, _KEYWORD_SQL),
    ("attribute_search", attribute_search, _ATTRIBUTE_SQL),
    ("index_search", index_search, _INDEX_SQL),
    ("history_last4", history_last4, r"SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN regexp_replace(trim(split_part(split_part(text || ' [2, 3] Sources: x', 'Sources:', 1), 'References:', 1)), '\[\d+(?:\s*,\s*\d+)*\]', '', 'g') ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4"),
    ("context_trim", context_trim, "SELECT answer_id, chunk_id, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY answer_id ORDER BY score DESC, chunk_id) AS used FROM (SELECT source AS answer_id, doc_id AS chunk_id, doc_id * 7919 % 1009 AS score, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents)) WHERE used <= 5000"),
    ("context_headers", context_headers, _HEADER_SQL),
    ("strip_sources", strip_sources, _STRIP_SQL),
]
