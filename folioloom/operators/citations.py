"""Citation markers, renumbering, bibliographies, context blocks and chat history."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioloom.functions import text as tx

#: Citation markers (fixed value).
MARKER = r"\[(\d+(?:\s*,\s*\d+)*)\]"


def cited(text: Column) -> Column:
    """All numbers in ``[n]`` and ``[n, m]`` markers, in order, repeats kept."""
    groups = F.regexp_extract_all(text, F.lit(MARKER), F.lit(1))
    return F.transform(F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*"))), lambda x: F.trim(x).cast("int"))


def cited_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(cited(text)))


def index_map(answers: DataFrame, key: str = "answer_id") -> DataFrame:
    """(key, old, new): numbers in order of first appearance, from 1."""
    seen = answers.select(key, F.posexplode(F.array_distinct(cited(F.col("text")))).alias("at", "old"))
    return seen.select(key, "old", (F.col("at") + 1).alias("new"))


def collapse(mapping: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Numbers of the same document and page become one; those without a source keep their own.

    ``sources``: key, position (from 1), doc_id, start_page. New numbers are dense, in order
    of first appearance.
    """
    j = mapping.join(sources.select(key, F.col("position").alias("old"), "doc_id", "start_page"), [key, "old"], "left")
    own = F.col("doc_id").isNull()
    group = F.when(own, F.struct(F.lit(None).cast("string").alias("d"), F.lit(None).cast("int").alias("p"), F.col("old").alias("o"))).otherwise(F.struct(F.col("doc_id").cast("string").alias("d"), F.col("start_page").cast("int").alias("p"), F.lit(None).cast("int").alias("o")))
    first = j.withColumn("_g", group).withColumn("_first", F.min("new").over(W.partitionBy(key, "_g")))
    return first.withColumn("new", F.dense_rank().over(W.partitionBy(key).orderBy("_first"))).select(key, "old", "new")


_MARK = re.compile(MARKER)


@F.pandas_udf(T.StringType())
def renumber(text: pd.Series, mapping: pd.Series) -> pd.Series:
    """Markers with mapped numbers, in one pass; numbers that aren't mapped stay.

    ``mapping``: an array of structs (old, new).
    """

    def one(t, pairs):
        if t is None:
            return None
        m = {} if pairs is None else {p["old"]: p["new"] for p in pairs}
        return _MARK.sub(lambda g: "[" + ", ".join(str(m.get(int(x), int(x))) for x in g.group(1).split(",")) + "]", t)

    return pd.Series([one(t, p) for t, p in zip(text, mapping, strict=True)])


#: How a sources section begins (fixed value).
_SOURCES = r"(?i)\n+(?:---\n)?\*{0,2}(?:Sources?|References|Bibliography):?\*{0,2}:?\s*\n"


def strip_sources(text: Column, least: float = 0.3) -> Column:
    """A sources section that starts ``least`` of the way in or later is cut off, with all after it."""
    before = F.split(text, _SOURCES, 2)[0]
    at = F.length(before)
    return F.when(text.rlike(_SOURCES) & (at >= F.length(text) * least), F.rtrim(before)).otherwise(text)


def strip_sources_always(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)\n+(?:---\n)?\*{0,2}(?:Sources?|References|Bibliography):?.*", "")


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("p. "), start.cast("string"))).otherwise(F.concat(F.lit("pp. "), start.cast("string"), F.lit("–"), end.cast("string")))


def citation_line(label: Column) -> Column:
    """``[n] Author (Year). 'Title', *Publication*, pp. a–b`` from author, year, title, source_filename, publication, start_page, end_page."""
    author = tx.citation_clean(F.col("author"))
    year = F.when(F.coalesce(F.col("year"), F.lit(0)) != 0, F.col("year").cast("string")).otherwise("")
    title = tx.citation_clean(F.when(F.length("title") > 0, F.col("title")).otherwise(F.col("source_filename")))
    publication = tx.citation_clean(F.col("publication"))
    who = F.when((author != "") & (year != ""), F.concat(author, F.lit(" ("), year, F.lit(")"))).when(author != "", author).when(year != "", F.concat(F.lit("("), year, F.lit(")"))).otherwise("")
    body = F.when(publication != "", F.concat(F.lit("'"), title, F.lit("', *"), publication, F.lit("*"))).otherwise(F.concat(F.lit("*"), title, F.lit("*")))
    first = F.trim(F.concat(F.lit("["), label.cast("string"), F.lit("] "), who))
    return F.replace(F.concat(first, F.lit(". "), body, F.lit(", "), page_label(F.col("start_page"), F.col("end_page"))), F.lit(".."), F.lit("."))


def bibliography(sources: DataFrame, mapping: DataFrame, key: str = "answer_id", by: tuple[str, ...] = ("doc_id", "start_page")) -> DataFrame:
    """One block per answer: a line for each cited source, the first of equal ``by``, sorted by label.

    ``sources`` has key, position and the fields of ``citation_line``; ``mapping`` key, old, new.
    """
    j = sources.join(mapping.select(key, F.col("old").alias("position"), "new"), [key, "position"])
    w = W.partitionBy(key, *by).orderBy("position")
    lines = j.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(key, F.col("new"), "position", citation_line(F.col("new")).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("new", "position", "line"))), lambda x: x["line"])
    return lines.groupBy(key).agg(F.concat(F.lit("\n\n---\n**Sources:**\n"), F.array_join(ordered, "\n")).alias("bibliography"))


def context_header(position: Column) -> Column:
    """A numbered header in one of four forms, by what is known of author and year; a filename's year beats the record's."""
    title = F.when(F.length("title") > 0, F.col("title")).otherwise(F.col("source_filename"))
    author = F.when(F.length("author") > 0, F.col("author")).otherwise(tx.filename_author(F.coalesce("source_filename", F.lit(""))))
    named = tx.filename_year(F.coalesce("source_filename", F.lit("")))
    year = F.when(named != "", named).otherwise(F.coalesce(F.col("year").cast("string"), F.lit("")))
    pages = F.when(F.col("start_page") == F.col("end_page"), F.concat(F.lit("p."), F.col("start_page").cast("string"))).otherwise(F.concat(F.lit("pp."), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string")))
    head = F.when(F.length("section_heading") > 0, F.concat(F.lit(" — "), F.col("section_heading"))).otherwise("")
    lead = F.concat(F.lit("["), position.cast("string"), F.lit("]"), tx.type_label(F.col("document_type")), F.lit(" "))
    quoted = F.concat(F.lit('"'), title, F.lit('"'))
    dated = F.concat(F.lit(" ("), year, F.lit(")"))
    middle = F.when((author != "") & (year != ""), F.concat(author, dated, F.lit(", "), quoted)).when(author != "", F.concat(author, F.lit(", "), quoted)).when(year != "", F.concat(quoted, dated)).otherwise(title)
    return F.concat(lead, middle, F.lit(", "), pages, head)


#: Chunks that one answer's context has at most.
MOST_CHUNKS = 1000


def context_blocks(chunks: DataFrame, figures: DataFrame | None = None, start: int = 1) -> DataFrame:
    """position and block of each retrieved chunk, best first, with the figures of its pages."""
    best = chunks.orderBy(F.desc("score"), "chunk_id").limit(MOST_CHUNKS)
    w = W.orderBy(F.desc("score"), "chunk_id")  # at most MOST_CHUNKS rows
    numbered = best.withColumn("position", F.row_number().over(w) + start - 1)
    text = F.concat(context_header(F.col("position")), F.lit("\n"), F.col("text"))
    if figures is None:
        return numbered.select("position", "chunk_id", text.alias("block"))
    from folioloom.operators.retrieval import contextual_figures

    shown = contextual_figures(chunks.select("chunk_id", "doc_id", "start_page", "end_page"), figures)
    image = F.concat(F.lit("\n\n!["), F.col("caption"), F.lit("]("), (F.coalesce("image_url", F.lit("")) if "image_url" in figures.columns else F.lit("")), F.lit(")\n*"), F.col("caption"), F.lit("*"))
    per = shown.withColumn("_i", image).groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "figure_id", "_i"))), lambda x: x["_i"]), "").alias("_images"))
    return numbered.join(per, "chunk_id", "left").select("position", "chunk_id", F.concat(text, F.coalesce("_images", F.lit(""))).alias("block"))


def clean_history(turns: DataFrame, keep: int = 4) -> DataFrame:
    """The last ``keep`` turns of a conversation; answers without sources sections and markers."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")
    text = F.coalesce("text", F.lit(""))
    cut = F.trim(F.split(F.split(text, "Sources:", 2)[0], "References:", 2)[0])
    return last.withColumn("text", F.when(F.col("role") == "assistant", F.regexp_replace(cut, r"\[\d+(?:\s*,\s*\d+)*\]", "")).otherwise(text))


def trim_context(chunks: DataFrame, budget: int, key: str = "answer_id") -> DataFrame:
    """The best chunks of an answer whose estimated tokens stay within the budget."""
    w = W.partitionBy(key).orderBy(F.desc("score"), "chunk_id")
    return chunks.withColumn("_used", F.sum("tokens").over(w)).filter(F.col("_used") <= budget).drop("_used")
