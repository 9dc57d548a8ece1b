"""Document-processing and chunking queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import ids, lang
from folioloom.functions import text as tx
from folioloom.functions.vectors import dot
from folioloom.operators import blocks as bl
from folioloom.operators import citations as ct
from folioloom.operators import chunking as ch
from folioloom.operators import figures as fg
from folioloom.operators import language_model as lm
from folioloom.operators import metadata as md
from folioloom.plans import views as v
from folioloom.session import table
from folioloom.sources.providers import HashEmbedder

_B = v.with_views("words", "v_blocks")

# -- restitching, ranges, sections ---------------------------------------------------


def restitch(spark: SparkSession, d: str) -> DataFrame:
    r = bl.restitch(v.blocks(spark, d))
    return r.select("doc_id", F.array_join("block_ids", ",").alias("block_ids"), "start_page", "end_page", "text", "block_type")


def _one_block_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every block a page of its own, so that chains over many pages occur."""
    return v.blocks(spark, d).filter("block_type = 'paragraph'").withColumns({"page_num_1": (F.col("pos") - F.floor(F.col("pos") / 9)).cast("int"), "reading_order": F.lit(0)})


def restitch_chains(spark: SparkSession, d: str) -> DataFrame:
    r = bl.restitch(_one_block_pages(spark, d))
    return r.select("doc_id", F.array_join("block_ids", ",").alias("block_ids"), "start_page", "end_page", "text", "block_type")


def _restitch_sql(source: str) -> str:
    return rf"""
, flagged AS (
  SELECT *, CASE WHEN block_type = 'paragraph' AND lag(block_type) OVER w = 'paragraph' AND page_num_1 = lag(page_num_1) OVER w + 1 AND reading_order = 0
                 AND NOT regexp_matches(lag(text) OVER w, '[.!?"'')\]]\s*\z') AND length(trim(lag(text) OVER w)) > 0 AND regexp_matches(text, '^\s*\p{{Ll}}') THEN 0 ELSE 1 END AS starts
  FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY page_num_1, reading_order, block_id)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY page_num_1, reading_order, block_id) AS island FROM flagged),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY page_num_1, reading_order, block_id) AS i, count(*) OVER (PARTITION BY doc_id, island) AS n FROM islands)
SELECT doc_id, string_agg(block_id, ',' ORDER BY i) AS block_ids, min(page_num_1) AS start_page, max(page_num_1) AS end_page,
       string_agg(CASE WHEN n = 1 THEN text WHEN i = 1 THEN rtrim(text) WHEN i = n THEN ltrim(text) ELSE trim(text) END, ' ' ORDER BY i) AS text, arg_min(block_type, i) AS block_type
FROM placed GROUP BY doc_id, island
"""


_ONE = """v_one AS (SELECT doc_id, block_id, (pos - pos // 9)::INT AS page_num_1, 0 AS reading_order, block_type, text FROM v_blocks WHERE block_type = 'paragraph')"""


def article_range(spark: SparkSession, d: str) -> DataFrame:
    return bl.article_range(v.stitched_like(spark, d), v.docs(spark, d)).select("doc_id", "pos", "start_page")


def title_trim(spark: SparkSession, d: str) -> DataFrame:
    ranged = bl.article_range(v.stitched_like(spark, d), v.docs(spark, d))
    return bl.title_trim(ranged, v.docs(spark, d)).select("doc_id", "pos", "start_page")


_RANGE = r"""ranges AS (
  SELECT doc_id, title, TRY_CAST(regexp_extract(page_range_label, '^(\d+)\s*[-–—]\s*(\d+)', 1) AS INT) AS first, TRY_CAST(regexp_extract(page_range_label, '^(\d+)\s*[-–—]\s*(\d+)', 2) AS INT) AS last FROM v_docs),
ranged AS (SELECT b.*, r.first, r.title FROM v_blocks b JOIN ranges r USING (doc_id) WHERE r.first IS NULL OR b.page_num_1 BETWEEN r.first AND r.last)"""


def _word_set(c: str) -> str:
    return rf"list_filter(list_distinct(string_split(trim(regexp_replace(translate(lower({c}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', ''), '\s+', ' ', 'g')), ' ')), lambda x: x <> '')"


_TITLE_SQL = (
    v.with_views("words", "v_docs", "v_blocks")
    + ",\n"
    + _RANGE
    + f"""
, opening AS (SELECT *, sum(CASE WHEN page_num_1 = first THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) = 0 AS lead_ FROM ranged),
hits AS (SELECT doc_id, min(pos) AS ord FROM opening
         WHERE lead_ AND block_type = 'heading' AND len({_word_set('title')}) > 0 AND len(list_intersect({_word_set('text')}, {_word_set('title')})) / len({_word_set('title')})::DOUBLE >= 0.6 GROUP BY doc_id)
SELECT r.doc_id, r.pos, r.page_num_1 AS start_page FROM ranged r LEFT JOIN hits h USING (doc_id) WHERE h.ord IS NULL OR r.pos >= h.ord
"""
)


def sections(spark: SparkSession, d: str) -> DataFrame:
    s = bl.with_sections(v.blocks(spark, d), ["pos"])
    return s.select("doc_id", "block_id", F.col("section").cast("long").alias("section"))


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    raw = ch.raw_chunks(v.stitched_like(spark, d), max_tokens=150)
    rows = raw.select("doc_id", F.col("section").cast("long").alias("section"), "part", F.explode("rows").alias("r"))
    return rows.select("doc_id", "section", F.col("part").cast("long").alias("part"), F.col("r.pos").alias("pos"))


_PACK_SQL = (
    v.with_views("words", "v_blocks", recursive=True)
    + """
, s AS (SELECT doc_id, pos, block_type, greatest(1, length(text) // 4) AS tokens, sum((block_type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section FROM v_blocks),
held AS (SELECT DISTINCT doc_id, section FROM s WHERE block_type = 'heading'),
body AS (SELECT s.doc_id, s.section, s.pos, s.tokens, h.doc_id IS NOT NULL AS has_heading, row_number() OVER (PARTITION BY s.doc_id, s.section ORDER BY s.pos) AS i FROM s LEFT JOIN held h ON h.doc_id = s.doc_id AND h.section = s.section WHERE s.block_type <> 'heading'),
packed AS (
  SELECT doc_id, section, pos, i, (CASE WHEN has_heading AND tokens > 150 THEN 1 ELSE 0 END)::BIGINT AS part, tokens::BIGINT AS used FROM body WHERE i = 1
  UNION ALL
  SELECT b.doc_id, b.section, b.pos, b.i, CASE WHEN p.used + b.tokens > 150 THEN p.part + 1 ELSE p.part END, (CASE WHEN p.used + b.tokens > 150 THEN b.tokens ELSE p.used + b.tokens END)::BIGINT
  FROM packed p JOIN body b ON b.doc_id = p.doc_id AND b.section = p.section AND b.i = p.i + 1)
SELECT doc_id, section, part, pos FROM packed
"""
)


def overlap_tail(spark: SparkSession, d: str) -> DataFrame:
    raw = ch.raw_chunks(v.stitched_like(spark, d), max_tokens=150).filter(F.size("rows") > 0)
    tail = raw.select("doc_id", F.col("section").cast("long").alias("section"), F.col("part").cast("long").alias("part"), F.explode(ch.overlap_tail(F.col("rows"), 64)).alias("r"))
    return tail.select("doc_id", "section", "part", F.col("r.pos").alias("pos"))


_TAIL_SQL = _PACK_SQL.replace("SELECT doc_id, section, part, pos FROM packed", """, t AS (
  SELECT p.doc_id, p.section, p.part, p.pos, b.tokens, sum(b.tokens) OVER w AS used, row_number() OVER w AS back
  FROM packed p JOIN body b USING (doc_id, section, pos) WINDOW w AS (PARTITION BY p.doc_id, p.section, p.part ORDER BY p.pos DESC))
SELECT doc_id, section, part, pos FROM t WHERE back = 1 OR used <= 64""")


def _footnotes_for(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d).filter(F.col("pos") % 5 == 2)
    kind = F.element_at(F.array(F.lit("citation"), F.lit("explanatory"), F.lit("mixed")), (F.col("pos") % 3 + 1).cast("int"))
    return b.select("doc_id", F.concat(F.lit("fn-"), F.col("block_id")).alias("footnote_id"), (F.col("pos") + 1).alias("footnote_number"), F.substring("text", 1, 30).alias("text"), kind.alias("footnote_type"), "block_id")


def chunks_final(spark: SparkSession, d: str) -> DataFrame:
    """Whole chunks with overlap and inlined footnotes, in the plan's form."""
    n = _footnotes_for(spark, d)
    b = v.stitched_like(spark, d).withColumn("footnote_refs", F.when(F.col("pos") % 5 == 2, F.array(F.concat(F.lit("fn-"), F.col("block_ids")[0]))).otherwise(F.array().cast("array<string>")))
    made = ch.chunks(b, n, max_tokens=150, overlap=64)
    return made.select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "start_page", "end_page", "text", F.array_join("block_ids", ",").alias("block_ids"), "token_count")


_CHUNKS_SQL = _PACK_SQL.replace(
    "SELECT doc_id, section, part, pos FROM packed",
    r"""
, heads AS (SELECT b.doc_id, s.section, b.block_id, trim(b.text) AS title, b.page_num_1 FROM v_blocks b JOIN s USING (doc_id, pos) WHERE b.block_type = 'heading'),
parts AS (
  SELECT doc_id, section, unnest(range(0, top + 1)) AS part FROM (
    SELECT q.doc_id, q.section, coalesce(max(p.part), 0) AS top FROM (SELECT DISTINCT doc_id, section FROM s) q LEFT JOIN packed p ON p.doc_id = q.doc_id AND p.section = q.section GROUP BY ALL)),
tailed AS (
  SELECT p.doc_id, p.section, p.part + 1 AS part, p.pos FROM (
    SELECT p.doc_id, p.section, p.part, p.pos, sum(b.tokens) OVER w AS used, row_number() OVER w AS back
    FROM packed p JOIN body b USING (doc_id, section, pos) WINDOW w AS (PARTITION BY p.doc_id, p.section, p.part ORDER BY p.pos DESC)) p WHERE back = 1 OR used <= 64),
rows_ AS (SELECT doc_id, section, part, pos, 1 AS own FROM packed UNION ALL SELECT doc_id, section, part, pos, 0 FROM tailed),
grouped AS (
  SELECT p.doc_id, p.section, p.part, min(b.page_num_1) AS a, max(b.page_num_1) AS z, string_agg(b.text, chr(10) ORDER BY r.own, r.pos) AS body,
         string_agg(CASE WHEN r.own = 1 THEN b.block_id END, ',' ORDER BY r.pos) AS ids,
         string_agg(CASE WHEN r.own = 1 AND r.pos % 5 = 2 THEN '[' || (r.pos + 1) || '] ' || CASE WHEN r.pos % 3 <> 1 THEN '[cites:] ' ELSE '' END || trim(substr(b.text, 1, 30)) END, chr(10) ORDER BY 'fn-' || b.block_id) AS notes
  FROM parts p LEFT JOIN rows_ r ON r.doc_id = p.doc_id AND r.section = p.section AND r.part = p.part LEFT JOIN v_blocks b ON b.doc_id = r.doc_id AND b.pos = r.pos GROUP BY ALL),
texts AS (
  SELECT g.doc_id, g.section, g.part, coalesce(least(g.a, CASE WHEN g.part = 0 THEN h.page_num_1 END), g.a, h.page_num_1) AS start_page, coalesce(greatest(g.z, CASE WHEN g.part = 0 THEN h.page_num_1 END), g.z, h.page_num_1) AS end_page,
         trim(coalesce(h.title || chr(10), '') || CASE WHEN h.title IS NOT NULL AND g.body IS NOT NULL THEN chr(10) ELSE '' END || coalesce(g.body, '') || coalesce(chr(10) || chr(10) || '---' || chr(10) || 'Footnotes:' || chr(10) || g.notes, ''), ' ' || chr(10)) AS text,
         concat_ws(',', CASE WHEN g.part = 0 THEN h.block_id END, g.ids) AS block_ids
  FROM grouped g LEFT JOIN heads h ON h.doc_id = g.doc_id AND h.section = g.section),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) - 1 AS chunk_index FROM texts WHERE true)
SELECT substr(sha256(doc_id || ':chunk:' || chunk_index), 1, 24) AS chunk_id, doc_id, chunk_index, start_page, end_page, text, block_ids, greatest(1, length(text) // 4)::INT AS token_count FROM numbered
""",
)

# -- lines, areas, offsets -------------------------------------------------------------


def boilerplate_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines shared by a source's documents, each document standing for a page."""
    x = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_num_1"), "text")
    return bl.line_frequency(x, share=0.02, fold=False)


_LINES_SQL = r"""
WITH l AS (SELECT source AS doc_id, doc_id AS page, trim(regexp_replace(regexp_replace(regexp_replace(lower(t.x), '^\d+\s*', ''), '\s*\d+\z', ''), '\s+', ' ', 'g')) AS line FROM documents, unnest(string_split(text, chr(10))) AS t(x)),
n AS (SELECT source AS doc_id, count(*) AS n FROM documents GROUP BY 1)
SELECT l.doc_id, line, count(DISTINCT page) AS pages FROM l JOIN n USING (doc_id) WHERE length(line) > 3 GROUP BY l.doc_id, line, n.n HAVING count(DISTINCT page) >= greatest(2, floor(n.n * 0.02))
"""


def boilerplate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of lines, ten to a page: removed ones with their new type."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    b = x.select("doc_id", F.concat_ws("-", "doc_id", "pos").alias("block_id"), (F.floor(F.col("pos") / 3) + 1).cast("int").alias("page_num_1"), (F.col("pos") % 3).alias("reading_order"), F.lit("paragraph").alias("block_type"), "text")
    return bl.boilerplate(b).filter("removed").select("doc_id", "block_id", "block_type")


_BLOCKS_SQL = r"""
WITH b AS (SELECT doc_id, pos - 1 AS pos, (pos - 1) // 3 + 1 AS page, (pos - 1) % 3 AS ro, x AS text, trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(x), 'ß', 'ss'), '^\d+\s*', ''), '\s*\d+\z', ''), '\s+', ' ', 'g')) AS line
  FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
n AS (SELECT doc_id, count(DISTINCT page) AS n FROM b GROUP BY 1),
f AS (SELECT b.doc_id, line FROM b JOIN n USING (doc_id) WHERE length(line) > 3 GROUP BY b.doc_id, line, n HAVING count(DISTINCT page) >= greatest(2, floor(n * 0.3))),
r AS (SELECT b.*, f.line IS NOT NULL OR upper(trim(regexp_replace(trim(text), '[^\p{L}\p{N}_\s]', '', 'g'))) IN ('PROJECT MUSE', 'JSTOR') AS removed FROM b LEFT JOIN f ON f.doc_id = b.doc_id AND f.line = b.line),
e AS (SELECT *, coalesce(min(CASE WHEN NOT removed THEN ro END) OVER w, 2147483647) AS first, coalesce(max(CASE WHEN NOT removed THEN ro END) OVER w, -1) AS last FROM r WINDOW w AS (PARTITION BY doc_id, page))
SELECT doc_id, doc_id || '-' || pos AS block_id, CASE WHEN ro <= first THEN 'header' WHEN ro >= last THEN 'footer' ELSE 'paragraph' END AS block_type FROM e WHERE removed
"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d)
    x0, y0 = (F.col("pos") * 37 % 100).cast("double"), (F.col("pos") * 91 % 300).cast("double")
    return b.withColumn("bbox", F.struct(x0.alias("x0"), y0.alias("y0"), (x0 + F.length("text")).alias("x1"), (y0 + 20.0).alias("y1")))


def content_bbox_pctl(spark: SparkSession, d: str) -> DataFrame:
    a = bl.content_area(_boxes(spark, d))
    return a.select("doc_id", "page_num_1", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


_BOX = "boxes AS (SELECT *, (pos * 37 % 100)::DOUBLE AS x0, (pos * 91 % 300)::DOUBLE AS y0, (pos * 37 % 100)::DOUBLE + length(text) AS x1, (pos * 91 % 300)::DOUBLE + 20.0 AS y1 FROM v_blocks)"


def page_offset_mode(spark: SparkSession, d: str) -> DataFrame:
    """Pages that end with a printed number, off by three, and now and then by more."""
    b = v.blocks(spark, d).withColumn("text", F.concat("text", F.lit(" "), (F.col("page_num_1") - F.when(F.col("pos") % 7 == 0, 5).otherwise(3)).cast("string")))
    pages = b.groupBy("doc_id").agg(F.max("page_num_1").alias("page_count"))
    return bl.page_offset_mode(b, pages)


_OFFSET_SQL = (
    v.with_views("words", "v_blocks")
    + r"""
, b AS (SELECT doc_id, page_num_1, reading_order, text || ' ' || (page_num_1 - CASE WHEN pos % 7 = 0 THEN 5 ELSE 3 END) AS text FROM v_blocks),
p AS (SELECT doc_id, max(page_num_1) AS page_count FROM b GROUP BY 1),
h AS (SELECT doc_id, page_num_1 FROM (SELECT doc_id, page_num_1, row_number() OVER (PARTITION BY doc_id ORDER BY page_num_1) - 1 AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, page_num_1 FROM b)) WHERE r >= n // 2),
c AS (SELECT b.doc_id, b.page_num_1, b.reading_order, TRY_CAST(regexp_extract(b.text, '\b(\d{1,4})\s*\z', 1) AS INT) AS c FROM b JOIN h USING (doc_id, page_num_1)),
o AS (SELECT c.doc_id, c.c - c.page_num_1 AS page_offset, c.page_num_1, c.reading_order FROM c JOIN p USING (doc_id) WHERE c.c BETWEEN 1 AND 2 * p.page_count AND c.c - c.page_num_1 > -20 AND c.c - c.page_num_1 < 0),
g AS (SELECT doc_id, page_offset, count(*) AS votes, min(page_num_1 * 10 + reading_order) AS first FROM o GROUP BY 1, 2)
SELECT doc_id, page_offset, votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) AS r FROM g) WHERE r = 1 AND votes >= 3
"""
)


def opening_text(spark: SparkSession, d: str) -> DataFrame:
    return bl.opening_text(v.blocks(spark, d), until=2000, cut=2500)


_OPENING_SQL = (
    v.with_views("words", "v_blocks")
    + """
, p AS (SELECT doc_id, page_num_1, string_agg(text, chr(10) ORDER BY reading_order) AS t FROM v_blocks GROUP BY 1, 2),
q AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY page_num_1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE length(t) >= 50)
SELECT doc_id, substr(string_agg(t, chr(10) || chr(10) ORDER BY page_num_1), 1, 2500) AS opening FROM q WHERE before < 2000 GROUP BY doc_id
"""
)


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    return bl.page_counts(v.blocks(spark, d))


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks(spark, d).groupBy("doc_id").agg(bl.upper_median(F.collect_list(F.length("text"))).alias("median"))


def rotation_votes(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d)
    way = F.when(F.length("text") % 3 == 0, "up").when(F.length("text") % 3 == 1, "down").otherwise("horizontal")
    return bl.rotation_votes(b.withColumn("direction", way)).select("doc_id", "page_num_1", "vertical_text_ratio", "has_vertical_text", "suggested_rotation_cw")


# -- functions of text -------------------------------------------------------------------


def _marked(c: Column) -> Column:
    """Text with references, superscripts and broken words put in."""
    n = (F.col("pos") % 30 + 1).cast("string")
    t = F.concat(c, F.lit(" word"), n, F.lit(", Smith."), n, F.lit(" "), F.lit("end. "), n, F.lit(" and ("), n, F.lit(") ["), n, F.lit("] <sup>"), n, F.lit("a</sup> bro-\nken"))
    return t


_MARKED = r"(text || ' word' || (pos % 30 + 1) || ', Smith.' || (pos % 30 + 1) || ' end. ' || (pos % 30 + 1) || ' and (' || (pos % 30 + 1) || ') [' || (pos % 30 + 1) || '] <sup>' || (pos % 30 + 1) || 'a</sup> bro-' || chr(10) || 'ken')"


def superscripts(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks(spark, d).select("block_id", tx.superscript_refs(_marked(F.col("text"))).alias("text"))


def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks(spark, d).select("block_id", tx.dehyphenate(_marked(F.col("text"))).alias("text"))


def _note(c: Column) -> Column:
    n = (F.col("pos") % 120 + 1).cast("string")
    k = F.col("pos") % 6
    return F.when(k == 0, F.concat(n, F.lit(" "), c)).when(k == 1, F.concat(F.lit("("), n, F.lit(") "), c)).when(k == 2, F.concat(n, F.lit(". "), c)).when(k == 3, F.concat(n, F.lit(") Ibid."))).when(k == 4, F.concat(n, F.lit(" See Smith, CO 273/105. "), F.substring(c, 1, 30))).otherwise(c)


_NOTE = "CASE pos % 6 WHEN 0 THEN (pos % 120 + 1) || ' ' || text WHEN 1 THEN '(' || (pos % 120 + 1) || ') ' || text WHEN 2 THEN (pos % 120 + 1) || '. ' || text WHEN 3 THEN (pos % 120 + 1) || ') Ibid.' WHEN 4 THEN (pos % 120 + 1) || ' See Smith, CO 273/105. ' || substr(text, 1, 30) ELSE text END"


def footnote_number(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks(spark, d).select("block_id", tx.footnote_number(_note(F.col("text"))).alias("number"))


_NUMBER_SQL = v.with_views("words", "v_blocks") + rf""", n AS (SELECT block_id, trim({_NOTE}) AS t FROM v_blocks)
SELECT block_id, coalesce(TRY_CAST(nullif(regexp_extract(t, '^(\d{{1,3}})\s', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, '^\((\d{{1,3}})\)\s*', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, '^(\d{{1,3}})\.\s', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(t, '^(\d{{1,3}})\)\s', 1), '') AS INT)) AS number FROM n"""


def footnote_type(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks(spark, d).select("block_id", tx.footnote_type(_note(F.col("text"))).alias("kind"))


def _type_sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    cited = " OR ".join(f"regexp_matches(body, {q(p)})" for p in tx.CITATION_SIGNS)
    rest = "body"
    for p in tx.CITATION_SIGNS:
        rest = f"regexp_replace({rest}, {q(p)}, '', 'g')"
    junk = q(r"""[\s.,;:()\[\]'"-]+""")
    return (
        v.with_views("words", "v_blocks")
        + rf""", n AS (SELECT block_id, regexp_replace(trim({_NOTE}), '^\d{{1,3}}[\s.)]+', '') AS body FROM v_blocks),
r AS (SELECT block_id, ({cited}) AS cited, trim(regexp_replace({rest}, {junk}, ' ', 'g')) AS rest FROM n)
SELECT block_id, CASE WHEN NOT cited THEN 'explanatory' WHEN rest = '' OR len(string_split(rest, ' ')) <= 8 THEN 'citation' ELSE 'mixed' END AS kind FROM r"""
    )


def ref_extract(spark: SparkSession, d: str) -> DataFrame:
    r = v.blocks(spark, d).select("block_id", F.explode(tx.find_refs(_marked(F.col("text")))).alias("r"))
    return r.groupBy("block_id", F.col("r.match_type").alias("match_type"), F.col("r.number").alias("number"), F.col("r.snippet").alias("snippet")).agg(F.count("*").alias("n"))


def _matches_sql(columns: str) -> str:
    """Rows of all patterns' matches over m (t): p, m_, match_type, number and snippet, by summed lengths."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"""SELECT {columns}, t, {i} AS p, '{name}' AS match_type, regexp_extract_all(t, {q(p)}, {g}) AS numbers, regexp_extract_all(t, {q(p)}) AS hits, regexp_extract_all(t, {q("(?s).*?(?:" + p + ")")}) AS parts FROM m"""
        for i, (name, p, g) in enumerate(tx.REF_PATTERNS)
    )
    return f"""a AS ({each}), k AS (SELECT *, unnest(range(1, len(numbers) + 1)) AS m_ FROM a),
s AS (SELECT *, list_sum([length(x) FOR x IN parts[1:m_]])::BIGINT AS stop, length(hits[m_]) AS size FROM k),
e AS (SELECT {columns}, p, m_, match_type, numbers[m_]::INT AS number, substr(t, greatest(stop - size - 20, 0) + 1, stop + 20 - greatest(stop - size - 20, 0)) AS snippet FROM s)"""


def _refs_sql() -> str:
    return v.with_views("words", "v_blocks") + f", m AS (SELECT block_id, {_MARKED} AS t FROM v_blocks), {_matches_sql('block_id')} SELECT block_id, match_type, number, snippet, count(*) AS n FROM e GROUP BY ALL"


def ref_markup(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d).withColumn("text", _marked(F.col("text")))
    notes = b.select("doc_id", "page_num_1", "reading_order", (F.col("pos") % 30 + 1).cast("int").alias("footnote_number"), F.concat(F.lit("fn"), "block_id").alias("footnote_id"))
    return bl.mark_refs(b, bl.link_refs(b, notes, around=None)).select("block_id", "text")


def link_refs(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d).withColumn("text", _marked(F.col("text")))
    notes = b.filter(F.col("pos") % 2 == 0).select("doc_id", "page_num_1", "reading_order", (F.col("pos") % 30 + 1).cast("int").alias("footnote_number"), F.concat(F.lit("fn"), "block_id").alias("footnote_id"))
    return bl.link_refs(b, notes)


def _link_sql() -> str:
    return (
        v.with_views("words", "v_blocks")
        + f""", m AS (SELECT doc_id, page_num_1, block_id, {_MARKED} AS t FROM v_blocks), {_matches_sql('doc_id, page_num_1, block_id')},
notes AS (SELECT doc_id, page_num_1, reading_order, (pos % 30 + 1)::INT AS footnote_number, 'fn' || block_id AS footnote_id FROM v_blocks WHERE pos % 2 = 0),
here AS (SELECT doc_id, page_num_1, footnote_number, arg_max(footnote_id, (page_num_1, reading_order, footnote_id)) AS h FROM notes GROUP BY 1, 2, 3),
anywhere AS (SELECT doc_id, footnote_number, arg_max(footnote_id, (page_num_1, reading_order, footnote_id)) AS a FROM notes GROUP BY 1, 2),
j AS (SELECT e.doc_id, e.page_num_1, e.block_id AS parent_block_id, e.number AS footnote_number, p, m_, snippet, coalesce(h.h, a.a) AS footnote_id, CASE WHEN h.h IS NULL THEN match_type || '_xpage' ELSE match_type END AS mt
      FROM e JOIN anywhere a ON a.doc_id = e.doc_id AND a.footnote_number = e.number LEFT JOIN here h ON h.doc_id = e.doc_id AND h.page_num_1 = e.page_num_1 AND h.footnote_number = e.number)
SELECT doc_id, page_num_1, parent_block_id, footnote_number, footnote_id, mt AS match_type, snippet AS context_snippet FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_block_id, footnote_number ORDER BY p, m_) AS r FROM j) WHERE r = 1"""
    )


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"), tx.estimate_json_tokens(F.length("text")).alias("json_tokens"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks(spark, d).select("block_id", ids.chunk_id(F.col("doc_id"), F.col("pos")).alias("chunk_id"))


def block_ids(spark: SparkSession, d: str) -> DataFrame:
    b = v.blocks(spark, d)
    return b.select("block_id", ids.block_id(F.col("doc_id"), F.col("page_num_1"), ids.page_bbox(F.lit(612.0), F.lit(792.0)), F.col("block_type"), F.sha2("text", 256)).alias("made"))


def page_hash(spark: SparkSession, d: str) -> DataFrame:
    return v.blocks(spark, d).groupBy("doc_id", "page_num_1").agg(ids.page_hash(F.collect_list(F.sha2("text", 256))).alias("page_hash"))


def nfkc_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.clean_text(F.concat(F.lit("ﬁ­x  "), F.col("text"))).alias("text"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    x = v.docs(spark, d)
    return x.select("doc_id", ids.doc_id(F.concat("title", F.lit(".pdf")), F.sha2("source_filename", 256)).alias("made"))


def diacritics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.strip_diacritics(F.col("text"), F.lit("en")).alias("text"))


def script_intrusions(spark: SparkSession, d: str) -> DataFrame:
    """Letters of other scripts go from English texts alone."""
    return table(spark, d, "documents").select("doc_id", tx.remove_script_intrusions(F.concat("text", F.lit(" Ж 中文 x")), F.col("lang")).alias("text"))


def text_cleanups(spark: SparkSession, d: str) -> DataFrame:
    """The better of two texts, links' tails, code fences, and sources sections cut wherever they begin."""
    i, t = F.col("doc_id"), F.col("text")
    x = table(spark, d, "documents")
    clean = F.when(i % 3 == 0, "").when(i % 3 == 1, F.lit(None)).otherwise(F.substring(t, 1, 20))
    link = F.concat(F.substring(t, 1, 10), F.when(i % 2 == 0, "](https://example.org/a)").otherwise(""))
    fenced = F.when(i % 2 == 0, F.concat(F.lit("```json\n"), F.substring(t, 1, 10), F.lit("\n```"))).otherwise(F.substring(t, 1, 10))
    return x.select("doc_id", tx.best_text(clean, t).alias("best"), tx.strip_link_tail(link).alias("link"), tx.strip_code_fence(fenced).alias("fenced"), ct.strip_sources_always(F.concat(F.lit("A\n\n**Sources:**\n"), t)).alias("answer"))


_CLEANUPS_SQL = r"""SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND length(text) > 0 THEN substr(text, 1, 20) ELSE text END AS best, substr(text, 1, 10) AS link, trim(substr(text, 1, 10), ' ' || chr(9) || chr(10) || chr(13)) AS fenced, 'A' AS answer FROM documents"""


def footnotes_split(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes that ran together: three words a footnote, numbers in a row from each document's own."""
    x = v.words(spark, d).withColumn("n", (F.col("doc_id") % 80 + 1).cast("int"))
    word = lambda i: F.regexp_replace(F.coalesce(F.get("w", F.lit(i)), F.lit("")), r"[^\p{L}]", "x")
    joined = F.concat(F.col("n"), F.lit(" a"), word(0), F.lit(". "), F.col("n") + 1, F.lit(" b"), word(1), F.lit(". "), F.col("n") + 2, F.lit(" c"), word(2))
    one = F.when(F.col("doc_id") % 5 == 0, F.concat(F.col("n"), F.lit(" alone"))).otherwise(joined)
    found = x.select("doc_id", F.explode(bl.split_footnotes_udf(one)).alias("f"))
    return found.select("doc_id", "f.number", "f.text")


_SPLIT_SQL = v.with_views("words") + r""", s AS (SELECT doc_id, doc_id % 80 + 1 AS n, unnest([0, 1, 2]) AS i, w FROM words WHERE doc_id % 5 <> 0)
SELECT doc_id, (n + i)::INT AS number, ['a', 'b', 'c'][i + 1] || regexp_replace(coalesce(w[i + 1], ''), '[^\p{L}]', 'x', 'g') || CASE WHEN i < 2 THEN '.' ELSE '' END AS text FROM s"""


def _markup_sql() -> str:
    """Marks by captures in place of lookahead; references of a block, higher numbers first, go through one after the other."""
    q = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(f"SELECT doc_id, page_num_1, block_id, '{name}' AS mt, unnest(regexp_extract_all(t, {q(p)}, {g}))::INT AS n, {i} AS p FROM m" for i, (name, p, g) in enumerate(tx.REF_PATTERNS))
    step = r"""regexp_replace(acc, CASE WHEN split_part(r, '|', 1) LIKE 'regex_period%' THEN '([A-Za-z])\.' WHEN split_part(r, '|', 1) LIKE 'regex_space%' THEN '([.)\]])\s' ELSE '([A-Za-z\)])' END || split_part(r, '|', 2)
      || CASE WHEN split_part(r, '|', 1) LIKE 'regex_period%' THEN '(\s|[A-Z]|[.,;:]|$)' WHEN split_part(r, '|', 1) LIKE 'regex_space%' THEN '(\s|$)' ELSE '(\s|[.,;:]|$)' END, '\1 [ref:' || split_part(r, '|', 2) || ']\2', 'g')"""
    return (
        _B
        + f""", m AS (SELECT doc_id, page_num_1, reading_order, block_id, pos, {_MARKED} AS t FROM v_blocks), e AS ({each}),
notes AS (SELECT doc_id, page_num_1, (pos % 30 + 1)::INT AS n FROM v_blocks),
here AS (SELECT DISTINCT doc_id, page_num_1, n, true AS here FROM notes), anywhere AS (SELECT DISTINCT doc_id, n FROM notes),
j AS (SELECT e.*, CASE WHEN h.here IS NULL THEN mt || '_xpage' ELSE mt END AS kind FROM e JOIN anywhere USING (doc_id, n) LEFT JOIN here h USING (doc_id, page_num_1, n)),
k AS (SELECT block_id, n, kind FROM (SELECT *, row_number() OVER (PARTITION BY block_id, n ORDER BY p) AS r FROM j) WHERE r = 1 AND kind NOT LIKE 'regex_parens%' AND kind NOT LIKE 'regex_brackets%'),
l AS (SELECT block_id, list(kind || '|' || n ORDER BY n DESC, kind DESC) AS refs FROM k GROUP BY 1)
SELECT m.block_id, CASE WHEN refs IS NULL THEN t ELSE list_reduce(list_concat([t], refs), lambda acc, r: {step}) END AS text FROM m LEFT JOIN l USING (block_id)"""
    )


def language_detect(spark: SparkSession, d: str) -> DataFrame:
    """All eleven languages, over whole documents."""
    x = table(spark, d, "documents").select("doc_id", lang.detect(F.col("text"), lang.LANGUAGES).alias("l"))
    return x.select("doc_id", "l.lang", "l.confidence", F.array_join("l.candidates", ",").alias("candidates"))


def language_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Languages of all documents, by trigrams of those whose id isn't divisible by 5."""
    x = table(spark, d, "documents")
    found = lm.identify(x, lm.fit(x.filter("doc_id % 5 <> 0")))
    return found.select("doc_id", "detected", F.round("confidence", 3).alias("confidence"), F.array_join("candidates", ",").alias("candidates"))


_PROFILES_SQL = f"""
WITH c AS (SELECT doc_id, lang, text, [unicode(x) FOR x IN string_split(lower(text), '')] AS u FROM documents WHERE length(text) > 2),
g AS (SELECT doc_id, lang, length(text) AS n, unnest([(u[i] * 961 + u[i + 1] * 31 + u[i + 2]) % {lm.BUCKETS} FOR i IN range(1, len(u) - 1)]) AS b FROM c),
t AS (SELECT doc_id, n, b, count(*) AS k FROM g GROUP BY ALL),
m AS (SELECT lang, b, count(*) AS k FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY ALL),
z AS (SELECT lang, sum(k) AS total FROM m GROUP BY 1),
s AS (SELECT t.doc_id, z.lang, sum(t.k * ln((coalesce(m.k, 0) + {lm.SMOOTHING}) / (z.total + {lm.SMOOTHING * lm.BUCKETS}))::DOUBLE) / sum(t.k) AS score
      FROM t CROSS JOIN z LEFT JOIN m ON m.lang = z.lang AND m.b = t.b WHERE t.n >= {lm.SHORTEST} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS place, exp(score - max(score) OVER (PARTITION BY doc_id)) AS share FROM s),
f AS (SELECT doc_id, max(lang) FILTER (place = 1) AS detected, round(round(max(share) / sum(share), 4), 3) AS confidence, string_agg(lang, ',' ORDER BY place) FILTER (place <= 3) AS candidates FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(detected, 'unknown') AS detected, coalesce(confidence, 0.0) AS confidence, coalesce(candidates, '') AS candidates FROM documents d LEFT JOIN f USING (doc_id)
"""


def _language_sql() -> str:
    each = []
    for code in lang.LANGUAGES:
        if code in lang.SCRIPTS:
            each.append(f"{{'c': '{code}', 's': CASE WHEN n > 0 THEN (n - length(regexp_replace(text, '\\s|{lang.SCRIPTS[code]}', '', 'g'))) / n::DOUBLE ELSE 0 END}}")
        else:
            known = ", ".join(f"'{w}'" for w in lang.WORDS[code])
            each.append(f"{{'c': '{code}', 's': CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ({known}))) / len(w)::DOUBLE ELSE 0 END}}")
    edges = lang._EDGES.replace("'", "''")
    return f"""WITH w AS (SELECT doc_id, text, length(regexp_replace(text, '\\s', '', 'g')) AS n, list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda x: trim(x, '{edges}')), lambda x: x <> '') AS w FROM documents),
a AS (SELECT doc_id, text, [{", ".join(each)}] AS l FROM w),
s AS (SELECT doc_id, text, unnest(l) AS e, list_reduce(list_transform(l, lambda x: x.s), lambda x, y: x + y) AS total FROM a),
r AS (SELECT doc_id, text, e.c AS c, e.s AS s, total, row_number() OVER (PARTITION BY doc_id ORDER BY e.s DESC, e.c) AS r FROM s)
SELECT doc_id, CASE WHEN length(any_value(text)) >= 30 AND any_value(total) > 0 THEN arg_min(c, r) ELSE 'unknown' END AS lang, CASE WHEN length(any_value(text)) >= 30 AND any_value(total) > 0 THEN round(max(s) / any_value(total), 4) ELSE 0 END AS confidence,
  CASE WHEN length(any_value(text)) >= 30 AND any_value(total) > 0 THEN coalesce(string_agg(c, ',' ORDER BY r) FILTER (r <= 3 AND s > 0), '') ELSE '' END AS candidates FROM r GROUP BY doc_id"""


def embed_stub(spark: SparkSession, d: str) -> DataFrame:
    """A vector a document from a service that takes ten texts a call; what its numbers must satisfy."""
    e = HashEmbedder(32, prefix="passage: ", batch=10).column(F.col("text"))
    return table(spark, d, "documents").select("doc_id", e.alias("e")).select("doc_id", F.size("e").alias("dimensions"), F.round(dot(F.col("e"), F.col("e")), 4).alias("length"))


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.col("doc_id"), F.lit(1).alias("page_num_1"), F.concat(F.lit("# Title\n\n"), F.regexp_replace("text", "\n", "\n\n"), F.lit("\n\n![Figure](a map|rotate90cw)\n\n- item^2\n---\n1 a note\n2 another")).alias("markdown"))
    return bl.parse_markdown(x).select("doc_id", "block_type", "text", F.col("reading_order").cast("long").alias("reading_order"), "figure")


_MARKDOWN_SQL = r"""
WITH parts AS (SELECT doc_id, '# Title' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '![Figure](a map|rotate90cw)' || chr(10) || chr(10) || '- item^2' AS body, '1 a note' || chr(10) || '2 another' AS notes FROM documents),
r AS (SELECT doc_id, 0 AS part, ord, trim(x, ' ' || chr(10) || chr(9)) AS p FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, regexp_split_to_array(body, '\n{2,}') AS l FROM parts))
      UNION ALL SELECT doc_id, 1, ord, x FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS ord FROM (SELECT doc_id, string_split(notes, chr(10)) AS l FROM parts))),
k AS (SELECT *, part = 0 AND regexp_matches(p, '^!\[[^\]]*\]\([^)]*\)\s*\z') AS image FROM r WHERE p <> ''),
t AS (SELECT *, CASE WHEN image THEN NULL WHEN part = 1 THEN 'footnote' WHEN p LIKE '#%' THEN 'heading' WHEN p LIKE '>%' THEN 'paragraph' WHEN regexp_matches(p, '^([-*]|\d+\.)\s+') THEN 'list_item' ELSE 'paragraph' END AS block_type FROM k)
SELECT doc_id, block_type, CASE WHEN NOT image THEN regexp_replace(CASE WHEN block_type = 'heading' THEN regexp_replace(p, '^#+\s*', '') ELSE p END, '\^(\d+)', '<sup>\1</sup>', 'g') END AS text,
       CASE WHEN NOT image THEN sum((NOT image)::INT) OVER (PARTITION BY doc_id ORDER BY part, ord)::BIGINT - 1 END AS reading_order, CASE WHEN image THEN regexp_extract(p, '\(([^)]*)\)', 1) END AS figure FROM t
"""


def metadata_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a made cover page: source line, author, address, identifier."""
    x = v.docs(spark, d).select("doc_id", F.concat(F.lit("Abdullah (2011) "), F.col("source_filename")).alias("source_filename"))
    n = F.col("doc_id").cast("string")
    cover = F.concat(F.lit("Author(s): Jane Doe\nSource: Journal of Things, Vol. "), n, F.lit(", No. 2 (June 2010), pp. 1-22\nStable URL: https://example.org/"), n, F.lit(".\nDOI 10.1234/ab"), n)
    b = x.select("doc_id", F.lit(1).alias("page_num_1"), F.explode(F.array(F.struct(F.lit(0).alias("reading_order"), F.lit("heading").alias("block_type"), F.concat(F.lit("**A long title** "), n).alias("text")), F.struct(F.lit(1).alias("reading_order"), F.lit("paragraph").alias("block_type"), cover.alias("text")))).alias("b")).select("doc_id", "page_num_1", "b.*")
    pdf = x.select("doc_id", F.lit("JSTOR").alias("pdf_title"), F.lit(None).cast("string").alias("pdf_author"), F.lit(24).alias("page_count"))
    return md.extract(x, b, pdf).select("doc_id", "title", "author", "publication", "volume", "issue", "page_range_label", "year", "url", "doi", "page_offset")


_CASCADE_SQL = "SELECT doc_id, 'A long title ' || doc_id AS title, 'Jane Doe' AS author, 'Journal of Things' AS publication, doc_id::VARCHAR AS volume, '2' AS issue, '1-22' AS page_range_label, 2011 AS year, 'https://example.org/' || doc_id AS url, '10.1234/ab' || doc_id AS doi, -2 AS page_offset FROM documents"


def figure_filter(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    box = F.when(i % 3 != 0, F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (i % 400).cast("double").alias("x1"), (i * 7 % 400).cast("double").alias("y1")))
    origin = F.element_at(F.array(F.lit("rendered_clip"), F.lit("vl_detected_scan"), F.lit("embedded"), F.lit(None).cast("string")), (i % 4 + 1).cast("int"))
    f = v.figures(spark, d).select("figure_id", origin.alias("derived_from"), F.when(i % 5 != 0, F.col("caption")).otherwise("").alias("caption_text_clean"), (i % 3 + 1).alias("page_num_1"), box.alias("bbox"))
    return f.filter(fg.is_substantial()).select("figure_id")


_FIGURE_FILTER_SQL = (
    v.with_views("words", "v_figures")
    + """, f AS (SELECT figure_id, doc_id AS i, (['rendered_clip', 'vl_detected_scan', 'embedded', NULL])[(doc_id % 4 + 1)::INT] AS o, CASE WHEN doc_id % 5 <> 0 THEN caption ELSE '' END AS c FROM v_figures)
SELECT figure_id FROM f WHERE coalesce(o, '') <> 'rendered_clip' AND NOT (coalesce(o, '') = 'vl_detected_scan' AND c = '') AND NOT (i % 3 = 0 AND c = '') AND (i % 3 = 0 OR (i % 400 >= 150 AND i * 7 % 400 >= 150))"""
)

ALL = [
    ("restitch", restitch, _B + _restitch_sql("v_blocks")),
    ("restitch_chains", restitch_chains, _B + ",\n" + _ONE + _restitch_sql("v_one")),
    ("article_range", article_range, v.with_views("words", "v_docs", "v_blocks") + ",\n" + _RANGE + " SELECT doc_id, pos, page_num_1 AS start_page FROM ranged"),
    ("title_trim", title_trim, _TITLE_SQL),
    ("sections", sections, _B + " SELECT doc_id, block_id, sum((block_type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS section FROM v_blocks"),
    ("chunk_pack", chunk_pack, _PACK_SQL),
    ("overlap_tail", overlap_tail, _TAIL_SQL),
    ("chunks_final", chunks_final, _CHUNKS_SQL),
    ("boilerplate_lines", boilerplate_lines, _LINES_SQL),
    ("boilerplate_blocks", boilerplate_blocks, _BLOCKS_SQL),
    ("content_bbox_pctl", content_bbox_pctl, _B + ", " + _BOX + " SELECT doc_id, page_num_1, round(quantile_cont(x0, 0.05), 6) AS x0, round(quantile_cont(y0, 0.05), 6) AS y0, round(quantile_cont(x1, 0.95), 6) AS x1, round(quantile_cont(y1, 0.95), 6) AS y1 FROM boxes GROUP BY 1, 2 HAVING count(*) >= 2"),
    ("page_offset_mode", page_offset_mode, _OFFSET_SQL),
    ("opening_text", opening_text, _OPENING_SQL),
    ("page_counts", page_counts, _B + " SELECT doc_id, page_num_1, sum(length(text))::BIGINT AS text_char_count, count(*) AS blocks FROM v_blocks GROUP BY 1, 2"),
    ("upper_median", upper_median, _B + " SELECT doc_id, list_sort(list(length(text)))[len(list(length(text))) // 2 + 1] AS median FROM v_blocks GROUP BY 1"),
    ("rotation_votes", rotation_votes, _B + ", c AS (SELECT doc_id, page_num_1, count(*) AS n, count(*) FILTER (length(text) % 3 = 0) AS up, count(*) FILTER (length(text) % 3 = 1) AS down FROM v_blocks GROUP BY 1, 2) SELECT doc_id, page_num_1, round((up + down) / n, 4) AS vertical_text_ratio, up + down > 0 AS has_vertical_text, CASE WHEN round((up + down) / n, 4) > 0.6 THEN CASE WHEN down >= up THEN 90 ELSE 270 END ELSE 0 END AS suggested_rotation_cw FROM c"),
    ("superscripts", superscripts, _B + rf" SELECT block_id, regexp_replace({_MARKED}, '<sup>(\d+[a-z]?)</sup>', '(\1)', 'g') AS text FROM v_blocks"),
    ("dehyphenate", dehyphenate, _B + rf" SELECT block_id, regexp_replace({_MARKED}, '-\n([a-z])', '\1', 'g') AS text FROM v_blocks"),
    ("footnote_number", footnote_number, _NUMBER_SQL),
    ("footnote_type", footnote_type, _type_sql()),
    ("ref_extract", ref_extract, _refs_sql()),
    ("link_refs", link_refs, _link_sql()),
    ("ref_markup", ref_markup, _markup_sql()),
    ("token_estimate", token_estimate, "SELECT doc_id, greatest(1, length(text) // 4)::INT AS tokens, (floor(length(text) / 3.5) + 100)::INT AS json_tokens FROM documents"),
    ("chunk_ids", chunk_ids, _B + " SELECT block_id, substr(sha256(doc_id || ':chunk:' || pos), 1, 24) AS chunk_id FROM v_blocks"),
    ("block_ids", block_ids, _B + " SELECT block_id, substr(sha256(doc_id || ':' || page_num_1 || ':0.0,0.0,612.0,792.0:' || block_type || ':' || sha256(text)), 1, 24) AS made FROM v_blocks"),
    ("page_hash", page_hash, _B + " SELECT doc_id, page_num_1, sha256(string_agg(sha256(text), '|' ORDER BY sha256(text))) AS page_hash FROM v_blocks GROUP BY 1, 2"),
    ("nfkc_clean", nfkc_clean, None),
    ("slugs", slugs, v.with_views("words", "v_docs") + r" SELECT doc_id, concat_ws('-', regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), substr(sha256(source_filename), 1, 12)) AS made FROM v_docs"),
    ("diacritics", diacritics, r"SELECT doc_id, strip_accents(text) AS text FROM documents"),
    ("script_intrusions", script_intrusions, r"SELECT doc_id, CASE WHEN lang = 'en' THEN trim(regexp_replace(text || ' x', ' {2,}', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) ELSE text || ' Ж 中文 x' END AS text FROM documents"),
    ("text_cleanups", text_cleanups, _CLEANUPS_SQL),
    ("footnotes_split", footnotes_split, _SPLIT_SQL),
    ("language_detect", language_detect, _language_sql()),
    ("language_profiles", language_profiles, _PROFILES_SQL),
    ("embed_stub", embed_stub, "SELECT doc_id, 32 AS dimensions, 1.0::DOUBLE AS length FROM documents"),
    ("markdown_blocks", markdown_blocks, _MARKDOWN_SQL),
    ("metadata_cascade", metadata_cascade, _CASCADE_SQL),
    ("figure_filter", figure_filter, _FIGURE_FILTER_SQL),
]
