"""Hybrid retrieval: filters, nearest vectors, full text, rank fusion, caps, context.

Filters go on documents first, so that they reach the scan; the filtered keys are a
semi join, broadcast only where adaptive execution finds them small. Vectors are
never carried past the top k, which is a per-task heap and not a sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.functions.analyzer import query_terms, terms
from folioloom.functions.vectors import dot, length_of

RRF = 60
AND_LEAST = 10
#: Weights of a chunk's text and of its document's fields (fixed values), and the most places of a term that count.
TEXT_WEIGHT, FIELD_WEIGHT = 0.4, 1.0
MOST_PLACES = 256

#: Short names of publications and patterns that match their full names (fixed values).
PUBLICATIONS = {
    "JMBRAS": "%Malay% Branch of the Royal Asiatic Society%",
    "MBRAS": "%Malay% Branch of the Royal Asiatic Society%",
    "JSBRAS": "%Straits Branch of the Royal Asiatic Society%",
    "SB": "%Straits Branch of the Royal Asiatic Society%",
}


def publication_pattern(value: str | None) -> str | None:
    return PUBLICATIONS.get(value.upper(), f"%{value}%") if value else None


def author_parts(value: str | None) -> list[str]:
    return [p for p in (value or "").replace(",", " ").split() if len(p) > 1]


@dataclass(frozen=True)
class Filters:
    """Optional predicates on documents; what isn't set isn't there. A null never satisfies one that is."""

    document_type: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    language: str | None = None
    publication: str | None = None
    source_filename: str | None = None
    author: str | None = None
    exact_publication: bool = False

    def conditions(self) -> list[Column]:
        out = []
        if self.document_type is not None:
            out.append(F.col("document_type") == self.document_type)
        if self.year_from is not None:
            out.append(F.col("year") >= self.year_from)
        if self.year_to is not None:
            out.append(F.col("year") <= self.year_to)
        if self.language is not None:
            out.append(F.col("language") == self.language)
        if self.publication is not None:
            out.append(F.col("publication") == self.publication if self.exact_publication else F.col("publication").ilike(publication_pattern(self.publication)))
        if self.source_filename is not None:
            out.append(F.col("source_filename").ilike("%" + self.source_filename))
        out += [F.col("author").ilike(f"%{p}%") for p in author_parts(self.author)]
        return out

    def apply(self, docs: DataFrame) -> DataFrame:
        for c in self.conditions():
            docs = docs.filter(c)
        return docs


def restrict(chunks: DataFrame, docs: DataFrame, filters: Filters | None) -> DataFrame:
    """Chunks of documents that satisfy the filters."""
    if filters is None or not filters.conditions():
        return chunks
    return chunks.join(filters.apply(docs).select("doc_id"), "doc_id", "left_semi")


def literal_vector(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def _distance(rows: DataFrame, query: list[float], vector: str) -> Column:
    """Cosine distance to a query; a stored ``norm`` is used, and the query's own is a constant."""
    norm = F.col("norm") if "norm" in rows.columns else length_of(F.col(vector))
    own = sum(float(x) * float(x) for x in query) ** 0.5
    return F.when((norm > 0) & F.lit(own > 0), F.lit(1.0) - dot(F.col(vector), literal_vector(query)) / (norm * F.lit(own)))


def with_norms(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with their vectors' lengths, to be stored with the index."""
    return rows.withColumn("norm", length_of(F.col(vector)))


def nearest(rows: DataFrame, query: list[float], k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows by cosine distance, exactly: key, dist, vrank."""
    near = rows.filter(F.col(vector).isNotNull()).select(key, _distance(rows, query, vector).alias("dist")).filter("dist IS NOT NULL").orderBy("dist", key).limit(k)
    return near.withColumn("vrank", F.row_number().over(W.orderBy("dist", key)))  # k rows


def target_rank(rows: DataFrame, query: list[float], target, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """The rank of one row among all by distance, without sorting them."""
    d = rows.select(key, _distance(rows, query, vector).alias("dist"))
    own = d.filter(F.col(key) == target).agg(F.min("dist").alias("_d"))  # one row
    return d.join(F.broadcast(own), F.col("dist") < F.col("_d"), "inner").agg((F.count("*") + 1).alias("rank")).withColumn(key, F.lit(target))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text", analyser: str = "simple", also: tuple[str, ...] = ()) -> DataFrame:
    """(term, key, tf): an inverted index; write it bucketed by term to reuse it. ``also``: the chunk's columns that its postings repeat.

    Texts are shuffled, once, and counted where they come to lie: their postings are many times as large.
    """
    dealt = chunks.select(key, *also, text).repartition(key)
    return dealt.select(key, *also, F.explode(terms(F.col(text), analyser)).alias("term")).groupBy("term", key, *also).agg(F.count("*").alias("tf"))


def write_postings(index: DataFrame, path: str) -> None:
    """Store an inverted index in files that are sorted by term, so that a lookup reads the pages of its terms alone."""
    index.hint("rebalance", "term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def damped(tf: Column) -> Column:
    """What a term's places add up to: the sum of 1 / i² over them, over that of the endless series."""
    sums, total = [], 0.0
    for i in range(1, MOST_PLACES + 1):
        total += 1.0 / (i * i)
        sums.append(total / 1.64493406685)
    return F.element_at(F.array(*[F.lit(x) for x in sums]), F.least(tf, F.lit(MOST_PLACES)).cast("int"))


def matches(index: DataFrame, query: list[str], key: str = "chunk_id") -> DataFrame:
    """Rows that have a term of the query: key, n_terms, and a score, the mean of the query's terms' damped places."""
    hit = index.filter(F.col("term").isin(query))
    return hit.groupBy(key).agg(F.count("*").alias("n_terms"), (F.sum(damped(F.col("tf"))) / F.lit(float(max(1, len(query))))).alias("score"))


def row_matches(rows: DataFrame, query: list[str], key: str = "chunk_id", text: str = "text", analyser: str = "simple") -> DataFrame:
    """As ``matches`` without an index: each row counts the query's terms in its own text, and nothing is shuffled."""
    if not query:
        return rows.select(key, F.lit(0).cast("long").alias("n_terms"), F.lit(0.0).alias("score")).limit(0)
    own = rows.select(key, F.filter(terms(F.col(text), analyser), lambda w: w.isin(query)).alias("_t")).filter(F.size("_t") > 0)

    def frequency(term: str) -> Column:
        return F.size(F.filter("_t", lambda w: w == term))

    counted = own.select(key, *[frequency(t).alias(f"_f{i}") for i, t in enumerate(query)])
    tf = [F.col(f"_f{i}") for i in range(len(query))]
    there = [F.when(f > 0, 1).otherwise(0) for f in tf]
    score = [F.when(f > 0, damped(f)).otherwise(0.0) for f in tf]
    return counted.select(key, sum(there[1:], there[0]).cast("long").alias("n_terms"), (sum(score[1:], score[0]) / F.lit(float(len(query)))).alias("score"))


def text_search(chunks: DataFrame, query: str, k: int, key: str = "chunk_id", analyser: str = "simple", least: int = AND_LEAST, fallback: bool = True, scope: DataFrame | None = None, boost: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """The k best rows by text: key, rank_score, trank.

    All terms must occur; with fewer than ``least`` such rows in ``scope`` (by default
    ``chunks``), any term will do. A query without terms matches nothing. ``boost``
    (key, score) adds the documents' own fields, at their greater weight. With an
    ``index`` of postings of ``scope``, its terms are looked up instead of reading texts.
    """
    wanted = query_terms(query, analyser)

    def hits(rows: DataFrame) -> DataFrame:
        if index is None:
            return row_matches(rows, wanted, key, analyser=analyser)
        return matches(index.filter(F.col("term").isin(wanted)), wanted, key).join(rows.select(key), key, "left_semi")

    found = hits(chunks)
    full = found.filter(F.col("n_terms") == len(wanted))
    if fallback and wanted:
        counted = full if scope is None else (hits(scope) if index is None else matches(index, wanted, key)).filter(F.col("n_terms") == len(wanted))
        full = full if counted.limit(least).count() >= least else found
    score = F.col("score") * TEXT_WEIGHT
    if boost is not None:
        full = full.join(boost.select(key, F.col("score").alias("_b")), key, "left")
        score = score + F.coalesce("_b", F.lit(0.0)) * FIELD_WEIGHT
    best = full.select(key, F.round(score, 9).alias("rank_score")).orderBy(F.desc("rank_score"), key).limit(k)
    return best.withColumn("trank", F.row_number().over(W.orderBy(F.desc("rank_score"), key)))  # k rows


def document_boost(chunks: DataFrame, docs: DataFrame, query: str, key: str = "chunk_id", analyser: str = "simple") -> DataFrame:
    """(key, score) from title, author, abstract, description and keywords of a chunk's document, weight 1."""
    have = [c for c in ("title", "author", "abstract", "description") if c in docs.columns]
    parts = [F.coalesce(F.col(c), F.lit("")) for c in have] + ([F.coalesce(F.array_join("keywords", " "), F.lit(""))] if "keywords" in docs.columns else [])
    fields = docs.select("doc_id", F.concat_ws(" ", *parts).alias("text"))
    scored = row_matches(fields, query_terms(query, analyser), "doc_id", analyser=analyser)
    return chunks.select(key, "doc_id").join(scored.select("doc_id", "score"), "doc_id").select(key, "score")


def fuse(near: DataFrame, found: DataFrame, k: int, key: str = "chunk_id", alpha: float | None = None) -> DataFrame:
    """Reciprocal rank fusion of both lists: key, score; ``alpha`` weighs the vectors' side (both 1 without)."""
    a, b = (1.0, 1.0) if alpha is None else (2 * alpha, 2 * (1 - alpha))
    both = near.select(key, "vrank").join(found.select(key, "trank"), key, "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (F.lit(float(RRF)) + F.col(r)), F.lit(0.0))
    return both.select(key, (part("vrank", a) + part("trank", b)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def diversity_cap(rows: DataFrame, per_doc: int, target: int, key: str = "chunk_id") -> DataFrame:
    """At most ``per_doc`` rows a document, best first, up to ``target`` rows; no cap where it is 0 or less."""
    if per_doc <= 0:
        return rows.orderBy(F.desc("score"), key).limit(target)
    w = W.partitionBy("doc_id").orderBy(F.desc("score"), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_doc).drop("_r").orderBy(F.desc("score"), key).limit(target)


#: Characters of a query that chunks are searched with (fixed value); figures are searched with all of it.
QUERY_CHARS = 2000


def retrieve(chunks: DataFrame, docs: DataFrame, query: str, vector: list[float], k: int, filters: Filters | None = None, per_doc: int = 0, rerank=None, threshold: float = 0.3, analyser: str = "simple", alpha: float | None = None, index: DataFrame | None = None) -> DataFrame:
    """The hybrid query: filters, vectors and text, fusion, cap, optional rerank and threshold; with document fields.

    With an ``index`` of postings of all ``chunks``, no chunk's text is read but those of the result.
    """
    allowed = restrict(chunks, docs, filters)
    fetch = 3 * k if per_doc > 0 else k
    query = query[:QUERY_CHARS]
    near = nearest(allowed, vector, fetch)
    found = text_search(allowed, query, fetch, scope=chunks, boost=document_boost(allowed, docs, query, analyser=analyser), analyser=analyser, index=index)
    fused = fuse(near, found, fetch, alpha=alpha)
    rows = chunks.drop("embedding", "norm").join(F.broadcast(fused), "chunk_id")  # fetch rows at most
    top = diversity_cap(rows, per_doc, k)
    full = top.join(docs, "doc_id")
    if rerank is not None:
        full = rerank_rows(full, query, rerank, k, threshold)
    return full.orderBy(F.desc("score"), "chunk_id")


def source_line() -> Column:
    """``SOURCE: file | TITLE: title (year)``, as far as they are known."""
    known = lambda c, x: F.when(F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) > 0, x).otherwise("")
    return F.concat(F.lit("SOURCE: "), F.coalesce("source_filename", F.lit("")), known("title", F.concat(F.lit(" | TITLE: "), F.col("title"))), known("year", F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))))


def rerank_text(author: Column, title: Column, text: Column) -> Column:
    """What a reranker reads: ``Author:`` and ``Document:`` lines where known, then the text."""
    line = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", line("Author", author), line("Document", title), text)


def rerank_rows(rows: DataFrame, query: str, provider, k: int, threshold: float) -> DataFrame:
    """Rows by a provider's score, those below the threshold left out."""
    scored = rows.withColumn("score", provider.score(query, rerank_text(F.col("author"), F.col("title"), F.col("text"))))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(k).filter(F.col("score") >= threshold)


def retrieve_figures(figures: DataFrame, docs: DataFrame, query: str, vector: list[float], k: int = 5, candidates: int = 30, filters: Filters | None = None, analyser: str = "simple", index: DataFrame | None = None) -> DataFrame:
    """The hybrid query over captions: all terms, no fallback, no cap; figures without a vector by text alone.

    ``index``: postings of captions, by figure_id.
    """
    allowed = restrict(figures, docs, filters)
    near = nearest(allowed, vector, candidates, key="figure_id")
    found = text_search(allowed.withColumn("text", F.col("caption")), query, candidates, key="figure_id", fallback=False, analyser=analyser, index=index)
    fused = fuse(near, found, k, key="figure_id")
    return figures.drop("embedding", "norm").join(F.broadcast(fused), "figure_id").orderBy(F.desc("score"), "figure_id")


def contextual_figures(chunks: DataFrame, figures: DataFrame) -> DataFrame:
    """Figures on any page of the chunks; each once per chunk, placeholders left out."""
    pages = chunks.select("chunk_id", "doc_id", F.explode(F.sequence("start_page", "end_page")).alias("page_num"))
    shown = figures.filter((F.length("caption") > 0) & ~F.col("caption").rlike(r"^Figure on p\.\d+$"))
    return pages.join(shown, ["doc_id", "page_num"]).dropDuplicates(["chunk_id", "figure_id"])


def figures_on_pages(figures: DataFrame, pairs: DataFrame) -> DataFrame:
    """Figures whose (doc_id, page_num) is among ``pairs``."""
    return figures.join(pairs.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")


def document_context(chunks: DataFrame, doc_id, page: int, window: int = 1, limit: int = 10, by_index: bool = False) -> DataFrame:
    """Chunks that start within ``window`` pages of a page, by page and chunk id (or index)."""
    near = chunks.filter((F.col("doc_id") == doc_id) & F.col("start_page").between(max(1, page - window), page + window))
    return near.orderBy("start_page", "chunk_index" if by_index else "chunk_id").limit(limit)


def browse(docs: DataFrame, filters: Filters | None = None, limit: int = 25) -> DataFrame:
    return (filters or Filters()).apply(docs).orderBy("doc_id").limit(limit)


def count_by(docs: DataFrame, field: str) -> DataFrame:
    return docs.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"))


def overview(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("documents"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.countDistinct("publication").alias("publications"))


def distribution(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(k)


def benchmark_score(latency: Column, tokens: Column, rounds: Column) -> Column:
    """40 points, and up to 30, 20 and 10 for latency (8 to 20 s), tokens (4,000 to 12,000) and tool rounds."""
    part = lambda x, full, none, points: F.lit(points) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (none - x) / (none - full)))
    return F.round(F.lit(40.0) + part(latency, 8.0, 20.0, 30.0) + part(tokens, 4000.0, 12000.0, 20.0) + F.greatest(F.lit(0.0), F.lit(10.0) - F.lit(2.5) * F.greatest(F.lit(0), rounds - 1)), 2)
