"""Document metadata: the cover-page cascade, and merging model and catalogue answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions import text as tx

#: Types a document can have (fixed values).
DOCUMENT_TYPES = tuple(tx.TYPE_LABELS)

#: Forms of a source line, of a journal's citation, of years, addresses and identifiers (fixed values).
SOURCE = r"(?im)Source:\s*(.+?)(?:,\s*Vol\.?\s*(\d+))?(?:,\s*No\.?\s*(\d+))?(?:\s*\(([^)]+)\))?(?:,\s*pp?\.?\s*([\d]+\s*-\s*[\d]+))?\s*$"
JOURNAL = r"(?i)(Journal of the Malaysian Branch of the Royal Asiatic Society),\s*Volume\s*(\d+)(?:,\s*Part\s*(\d+))?.*?,\s*pp?\.?\s*([\d]+\s*-\s*[\d]+)"
YEAR = r"\b(1[5-9]\d{2}|20[0-2]\d)\b"
DOI = r"10\.\d{4,}/\S+"
URL = r"https?://\S+"
BAD_TITLES = ("PROJECT MUSE", "JSTOR", "UNTITLED", "LAYOUT 1")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, group)
    return F.when(F.length(x) > 0, x)


def _known(name: str) -> Column:
    return F.when(F.length(F.col(name)) > 0, F.col(name))


def cover_text(blocks: DataFrame, pages: int = 2) -> DataFrame:
    """A document's first pages as one text, lines in order; at most ``pages`` pages are collected."""
    from pyspark.sql import Window as W

    w = W.partitionBy("doc_id").orderBy("page_num_1")
    first = blocks.select("doc_id", "page_num_1").distinct().withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= pages)
    rows = blocks.join(first.select("doc_id", "page_num_1"), ["doc_id", "page_num_1"], "left_semi")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num_1", "reading_order", "text"))), lambda x: x["text"]), "\n").alias("cover"))


def title_candidates(blocks: DataFrame) -> DataFrame:
    """Each document's title by its first page: a heading, the first paragraph after a platform's name, or any."""
    opening = blocks.groupBy("doc_id").agg(F.min("page_num_1").alias("page_num_1"))
    rows = F.array_sort(F.collect_list(F.struct("page_num_1", "reading_order", "block_type", "text")))
    g = blocks.join(opening, ["doc_id", "page_num_1"], "left_semi").groupBy("doc_id").agg(rows.alias("_r"))  # one page's blocks
    page = F.col("_r")
    name = lambda x: F.upper(F.trim(F.regexp_replace(F.trim(x["text"]), r"(?U)[^\w\s]", "")))
    plain = lambda x: F.trim(x["text"])
    headings = F.filter(page, lambda x: x["block_type"] == "heading")
    good = F.filter(headings, lambda x: ~name(x).isin("PROJECT MUSE", "JSTOR") & (F.length(plain(x)) > 10))
    platform = F.exists(headings, lambda x: name(x).isin("PROJECT MUSE", "JSTOR"))
    body = F.filter(page, lambda x: ~x["block_type"].isin("header", "footer", "page_number"))
    after = F.filter(body, lambda x: (x["block_type"] != "heading") & ~plain(x).rlike(JOURNAL) & ~plain(x).rlike(SOURCE) & ~F.lower(plain(x)).rlike("^(published by|author|source:|stable url)") & (F.length(plain(x)) > 10))
    any_ = F.filter(body, lambda x: F.length(plain(x)) > 20)
    first = lambda a: F.trim(F.get(a, F.lit(0))["text"])
    return g.select("doc_id", tx.clean_title(F.coalesce(first(good), F.when(platform, F.substring(first(after), 1, 200)), F.substring(first(any_), 1, 200))).alias("title_guess"))


def extract(docs: DataFrame, blocks: DataFrame, pdf: DataFrame | None = None) -> DataFrame:
    """Fills empty fields of documents by the cascade, in order, and appends provenance.

    ``docs``: doc_id, source_filename and the fields; ``pdf`` (optional): doc_id, pdf_title,
    pdf_author, page_count. The page offset is the range's last page less the page count;
    where that gives none and a document has more than 10 pages, printed numbers vote.
    """
    from folioloom.operators.blocks import page_offset_mode

    if pdf is None:
        pdf = docs.select("doc_id", F.lit(None).cast("string").alias("pdf_title"), F.lit(None).cast("string").alias("pdf_author"), F.lit(None).cast("int").alias("page_count"))
    for c, kind in {"title": "string", "author": "string", "publication": "string", "volume": "string", "issue": "string", "page_range_label": "string", "year": "int", "url": "string", "doi": "string", "page_offset": "int"}.items():
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast(kind))
    long_ = pdf.filter("page_count > 10").select("doc_id", "page_count")
    voted = page_offset_mode(blocks.join(long_.select("doc_id"), "doc_id", "left_semi"), long_).select("doc_id", F.col("page_offset").alias("_voted"))
    j = docs.join(cover_text(blocks), "doc_id", "left").join(title_candidates(blocks), "doc_id", "left").join(pdf, "doc_id", "left").join(voted, "doc_id", "left")
    cover = F.coalesce("cover", F.lit(""))
    bad = F.upper(F.trim(F.regexp_replace(F.trim("pdf_title"), r"(?U)[^\w\s]", ""))).isin(*BAD_TITLES)
    pdf_title = F.when(~bad & (F.length(F.trim("pdf_title")) > 0), F.trim("pdf_title"))
    has_source = cover.rlike(SOURCE)
    src = lambda i: F.when(has_source, _found(cover, SOURCE, i))
    jou = lambda i: F.when(~has_source, _found(cover, JOURNAL, i))
    line = F.when(has_source, F.regexp_extract(cover, SOURCE, 0)).otherwise(F.regexp_extract(cover, JOURNAL, 0))
    named_year = _found(F.coalesce("source_filename", F.lit("")), r"\((\d{4})\)").cast("int")
    label = F.coalesce(_known("page_range_label"), src(5), F.replace(jou(4), F.lit(" "), F.lit("")))
    last = F.trim(F.element_at(F.split(label, "-"), -1)).try_cast("int")
    by_range = F.when((F.col("page_count") > 0) & last.isNotNull(), last - F.col("page_count")).otherwise(F.coalesce("page_offset", F.lit(0)))
    url = F.coalesce(_found(F.regexp_extract(cover, r"(?i)Stable URL:\s*(.+)", 1), URL, 0), _found(cover, URL, 0))
    by_file = tx.filename_author(F.coalesce("source_filename", F.lit("")))
    cover_author = F.trim(_found(cover, r"(?i)Author\(?s?\)?:\s*(.+)"))
    fields = {
        "title": tx.clean_title(F.coalesce(_known("title"), pdf_title, F.col("title_guess"))),
        "author": F.coalesce(_known("author"), F.when(F.length("pdf_author") > 0, F.trim("pdf_author")), cover_author, F.when(by_file != "", by_file)),
        "publication": F.coalesce(_known("publication"), F.regexp_replace(F.trim(src(1)), r",+\z", ""), jou(1), F.trim(_found(cover, r"(?i)Published by:\s*(.+)"))),
        "volume": F.coalesce(_known("volume"), src(2), jou(2)),
        "issue": F.coalesce(_known("issue"), src(3), jou(3)),
        "page_range_label": label,
        "year": F.coalesce(named_year, F.when(F.col("year") != 0, F.col("year")), _found(src(4), YEAR).cast("int"), _found(line, YEAR).cast("int"), _found(cover, YEAR).cast("int")),
        "url": F.coalesce(_known("url"), tx.strip_link_tail(F.regexp_replace(url, r"\.+\z", ""))),
        "doi": F.coalesce(_known("doi"), tx.strip_link_tail(F.regexp_replace(_found(cover, DOI, 0), r"\.+\z", ""))),
        "page_offset": F.coalesce(F.when(by_range != 0, by_range), "_voted", by_range),
    }
    how = {
        "title": F.when(_known("title").isNotNull(), F.lit(None)).when(pdf_title.isNotNull(), "pdf_metadata"),
        "author": F.when(_known("author").isNotNull(), F.lit(None)).when(F.length("pdf_author") > 0, "pdf_metadata").when(cover_author.isNotNull(), "cover_page_regex").when(by_file != "", "filename_pattern"),
        **{c: F.when(_known(c).isNull() & src(i).isNotNull(), "cover_page_regex") for c, i in (("publication", 1), ("volume", 2), ("issue", 3), ("page_range_label", 5))},
        "url": F.when(_known("url").isNull() & url.isNotNull(), "cover_page_regex"),
        "doi": F.when(_known("doi").isNull() & cover.rlike(DOI), "cover_page_regex"),
    }
    confidence = {"pdf_metadata": 0.6, "filename_pattern": 0.5}
    sources = F.array(*[F.when(h.isNotNull(), F.struct(F.lit(c).alias("field"), h.cast("string").alias("source"), F.coalesce(*[F.when(h == k, F.lit(v)) for k, v in confidence.items()], F.lit(0.9)).alias("confidence"), F.substring(fields[c].cast("string"), 1, 200).alias("raw_value"))) for c, h in how.items()])
    kept = [c for c in docs.columns if c not in fields and c != "metadata_sources"]
    more = F.filter(sources, lambda x: x.isNotNull())
    old = [F.col("metadata_sources")] if "metadata_sources" in docs.columns else []
    return j.select(*kept, *[v.alias(k) for k, v in fields.items()], F.concat(*old, more).alias("metadata_sources"))


def merge_model_answer(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """Fields from a model's JSON (doc_id, answer), filled where empty; unknown types and years are skipped."""
    from folioloom.operators.index import keyword_union

    body = tx.strip_code_fence(F.col("_a"))
    value = lambda k: F.when(F.length(F.trim(F.get_json_object(body, f"$.{k}"))) > 0, F.trim(F.get_json_object(body, f"$.{k}")))
    j = docs.join(answers.select("doc_id", F.col("answer").alias("_a")), "doc_id", "left")
    out = {c: F.coalesce(_known(c), value(c)) for c in ("title", "author", "editor", "publication", "abstract", "language", "description", "series", "volume", "issue", "isbn", "issn") if c in docs.columns}
    if "year" in docs.columns:
        out["year"] = F.coalesce(F.when(F.col("year") != 0, F.col("year")), value("year").try_cast("int"))
    if "document_type" in docs.columns:
        out["document_type"] = F.coalesce(_known("document_type"), F.when(value("document_type").isin(*DOCUMENT_TYPES), value("document_type")))
    if "keywords" in docs.columns:
        out["keywords"] = keyword_union(F.col("keywords"), F.from_json(F.get_json_object(body, "$.keywords"), "array<string>"))
    return j.withColumns(out).drop("_a")


#: Catalogues in the order in which they are believed, with what a match by identifier and by title is worth (fixed values).
CATALOGUES = (("crossref", 1.0, 1.0), ("openlibrary", 0.8, 0.7), ("web", 0.5, 0.5))


def merge_catalogues(docs: DataFrame, lookups: dict[str, DataFrame], fields: tuple[str, ...] = ("title", "author", "publication", "year", "abstract", "isbn", "issn", "doi", "url")) -> DataFrame:
    """Fills empty fields from cached catalogue tables (doc_id and fields), most believed first; markup off abstracts.

    A table's ``matched_by`` (identifier or title) sets what its values are worth; without it
    they came by identifier. With ``metadata_sources`` in ``docs``, each filled field adds its
    provenance: field, source, confidence, raw_value.
    """
    j = docs
    for name, *_ in CATALOGUES:
        if name in lookups:
            t = lookups[name]
            by = F.col("matched_by") if "matched_by" in t.columns else F.lit("identifier")
            j = j.join(t.select("doc_id", by.alias(f"_{name}_by"), *[F.col(c).alias(f"_{name}_{c}") for c in fields if c in t.columns]), "doc_id", "left")
    out, told = {}, []
    for c in fields:
        if c not in docs.columns:
            continue
        text = dict(docs.dtypes)[c] == "string"
        own = _known(c) if text else F.col(c)
        offered = []
        for name, exact, loose in CATALOGUES:
            if name in lookups and c in lookups[name].columns:
                raw = F.col(f"_{name}_{c}")
                value = F.trim(F.regexp_replace(raw, "<[^>]+>", "")) if c == "abstract" else raw
                worth = F.when(F.col(f"_{name}_by") == "title", loose).otherwise(exact)
                source = F.struct(F.lit(c).alias("field"), F.lit(name).alias("source"), worth.alias("confidence"), F.substring(raw.cast("string"), 1, 200).alias("raw_value"))
                offered.append((F.when(F.length(value) > 0, value) if text else value, source))
        out[c] = F.coalesce(own, *[x for x, _ in offered])
        chain = F.when(own.isNotNull(), F.lit(None))
        for x, source in offered:
            chain = chain.when(x.isNotNull(), source)
        told.append(chain)
    filled = j.withColumns({f"_new_{c}": x for c, x in out.items()})
    if "metadata_sources" in docs.columns and told:
        filled = filled.withColumn("metadata_sources", F.concat(F.coalesce("metadata_sources", F.array().cast(dict(docs.dtypes)["metadata_sources"])), F.filter(F.array(*told), lambda x: x.isNotNull())))
    return filled.select(*[F.col(f"_new_{c}").alias(c) if c in out else F.col(c) for c in docs.columns])
