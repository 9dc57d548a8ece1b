"""Keeping an index up to date: upserts, replacement, reuse of vectors, audits, diffs, status, deletion.

Tables are immutable files; a change is a new DataFrame from old and new rows, by
full outer or anti join on the key, to be written as the table's next version.
"""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields of a document that a new null leaves as they were; others are always new (fixed values).
KEPT_FIELDS = ("title", "author", "editor", "publication", "document_type", "abstract", "language", "isbn", "issn", "series", "description", "volume", "issue", "page_range_label", "year")
STAGES = ("uploaded", "processing", "processed", "indexing", "done", "error")


def upsert_documents(old: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """New documents over old ones: nulls of ``KEPT_FIELDS`` and empty keywords keep the old value.

    The result has the columns of both; what only the old table has stays as it was, and is
    null for documents that it hadn't.
    """
    stored = [c for c in old.columns if c not in ("doc_id", "indexed_at")]
    columns = [c for c in new.columns if c != "doc_id"]
    columns += [c for c in stored if c not in columns]
    o = old.select("doc_id", *[F.col(c).alias(f"_old_{c}") for c in columns if c in old.columns], *([F.col("indexed_at").alias("_old_at")] if "indexed_at" in old.columns else []))
    n = new.withColumn("_has", F.lit(True))
    j = o.join(n, "doc_id", "full_outer")
    fresh = F.coalesce("_has", F.lit(False))

    def merged(c: str) -> Column:
        if c not in old.columns:
            return F.col(c)
        before = F.col(f"_old_{c}")
        if c not in new.columns:
            return before
        if c in KEPT_FIELDS:
            return F.coalesce(F.col(c), before)
        if c == "keywords":
            return F.when(fresh & (F.size(c) > 0), F.col(c)).otherwise(F.coalesce(before, F.col(c)))
        return F.when(fresh, F.col(c)).otherwise(before)

    out = j.select("doc_id", *[merged(c).alias(c) for c in columns], fresh.alias("_fresh"), *(["_old_at"] if "indexed_at" in old.columns else []))
    if "indexed_at" in old.columns and "indexed_at" not in columns:
        out = out.withColumn("indexed_at", F.when(F.col("_fresh"), now if now is not None else F.current_timestamp()).otherwise(F.col("_old_at")))
    return out.drop("_fresh", "_old_at")


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of documents in ``new`` are all replaced; others stay."""
    return old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(new.select(*old.columns))


def replace_figures(old: DataFrame, new: DataFrame) -> DataFrame:
    """As for chunks; a document that now has no figures keeps its old ones."""
    return replace_chunks(old, new)


def only_with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents that have a chunk; the others aren't written at all."""
    return docs.join(chunks.select("doc_id"), "doc_id", "left_semi")


def text_digest(text: Column) -> Column:
    """The 32 bytes that stand for a text where texts are only compared, so that joins don't shuffle them."""
    return F.unhex(F.sha2(text, 256))


def embed_reuse(old: DataFrame, new: DataFrame, key: str = "chunk_id", text: str = "text", within: str | None = None) -> DataFrame:
    """``new`` with the old vector where key and text are the same, and ``needs_embedding`` elsewhere; empty texts need none.

    ``within``: a column of both that a key determines, such as doc_id, by which ``new`` is partitioned already; rows are
    joined by it, so that new texts are not shuffled. Keys must be unique.
    """
    o = old.select(key, *([within] if within else []), text_digest(F.col(text)).alias("_t"), F.col("embedding").alias("_e"))
    if within:
        by = o.filter(F.col(key).isNotNull()).groupBy(within).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.struct("_t", "_e")))).alias("_old"))
        j = new.join(by.hint("shuffle_hash"), within, "left").withColumn("_o", F.try_element_at("_old", F.col(key))).withColumns({"_t": F.col("_o._t"), "_e": F.col("_o._e")}).drop("_old", "_o")
    else:
        j = new.join(o, key, "left")
    same = (F.col("_t") == text_digest(F.col(text))) & F.col("_e").isNotNull()
    return j.withColumns({"embedding": F.when(same, F.col("_e")), "needs_embedding": ~F.coalesce(same, F.lit(False)) & (F.length(text) > 0)}).drop("_t", "_e")


def embed_missing(rows: DataFrame, embed: Column) -> DataFrame:
    """Vectors for the rows that need one; the others never reach the provider."""
    need = rows.filter("needs_embedding").withColumn("embedding", embed)
    return rows.filter("NOT needs_embedding").unionByName(need).drop("needs_embedding")


def chunk_audit(old: DataFrame, new: DataFrame, version: int = 0) -> DataFrame:
    """Per document in ``new``: total, added, removed, text_changed, unchanged chunks."""
    o = old.select(F.col("doc_id").alias("_od"), "chunk_id", text_digest(F.col("text")).alias("_ot"))
    n = new.select(F.col("doc_id").alias("_nd"), "chunk_id", text_digest(F.col("text")).alias("_nt"))
    j = o.join(n, "chunk_id", "full_outer").withColumn("doc_id", F.coalesce("_nd", "_od"))
    was, is_ = F.col("_od").isNotNull(), F.col("_nd").isNotNull()
    out = j.groupBy("doc_id").agg(
        F.count_if(is_).alias("total_chunks"),
        F.count_if(is_ & ~was).alias("added"),
        F.count_if(was & ~is_).alias("removed"),
        F.count_if(was & is_ & (F.col("_ot") != F.col("_nt"))).alias("text_changed"),
        F.count_if(was & is_ & (F.col("_ot") == F.col("_nt"))).alias("unchanged"),
    )
    return out.filter("total_chunks > 0").withColumn("version", F.lit(version))


def append_audit(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The audit log with new rows; a run that is repeated replaces its row of a document and version."""
    return log.join(rows.select("doc_id", "version"), ["doc_id", "version"], "left_anti").unionByName(rows.select(*log.columns))


def block_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per block id in either version: status and both texts; of a repeated id, the last row counts."""

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id", "block_id").agg(F.max_by("text_raw", F.struct("page_num_1", "reading_order")).alias(name))

    j = last(old, "old_text").join(last(new, "new_text"), ["doc_id", "block_id"], "full_outer")
    status = F.when(F.col("old_text").isNull(), "added").when(F.col("new_text").isNull(), "removed").when(F.col("old_text") != F.col("new_text"), "changed").otherwise("unchanged")
    return j.withColumn("status", status)


def diff_totals(diff: DataFrame) -> DataFrame:
    return diff.groupBy("doc_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")])


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of two texts, for rows that changed."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="")) for a, b in zip(old, new, strict=True)])


def line_changes(diff_text: Column) -> Column:
    """(added, removed) lines of a unified diff, its headers apart."""
    lines = F.split(diff_text, "\n")
    plus = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    minus = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return F.struct(plus.alias("added"), minus.alias("removed"))


def latest_status(log: DataFrame) -> DataFrame:
    """The last stage per filename of an append-only log (filename, stage, error, updated_at)."""
    key = F.struct("updated_at", "stage")
    return log.groupBy("filename").agg(F.max_by("stage", key).alias("stage"), F.max_by("error", key).alias("error"), F.max("updated_at").alias("updated_at"))


def stage_counts(status: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Files per stage, 0 for stages without any."""
    spark = status.sparkSession
    fixed = spark.createDataFrame([(s,) for s in stages], "stage string")
    return fixed.join(status.groupBy("stage").agg(F.count("*").alias("n")), "stage", "left").select("stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame, with_status: bool = True, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables without some documents: documents, chunks, figures, and, for a single deletion, pipeline_status.

    Audit rows stay.
    """
    out = dict(tables)
    for name in ("documents", "chunks", "figures"):
        if name in tables:
            out[name] = tables[name].join(doc_ids.select("doc_id"), "doc_id", "left_anti")
    if with_status and "pipeline_status" in tables:
        names = (documents if documents is not None else tables["documents"]).join(doc_ids.select("doc_id"), "doc_id", "left_semi").select(F.col("source_filename").alias("filename"))
        out["pipeline_status"] = tables["pipeline_status"].join(names, "filename", "left_anti")
    return out


#: Columns that an editor may change (fixed values).
EDITABLE = (*KEPT_FIELDS, "keywords", "page_offset")


def coerce(field: str, value: Column) -> Column:
    """A form's text as a column's value: integers or the default, keywords from JSON or commas."""
    if field == "year":
        return value.try_cast("int")
    if field == "page_offset":
        return F.coalesce(value.try_cast("int"), F.lit(0))
    if field == "keywords":
        parsed = F.from_json(value, "array<string>")
        plain = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
        return F.when(F.trim(value).startswith("["), parsed).otherwise(plain)
    return value


def edit_metadata(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (doc_id, fields map<string,string>) applied: a key that is there wins, even with a null."""
    j = docs.join(edits.select("doc_id", F.col("fields").alias("_f")), "doc_id", "left")
    out = {c: F.when(F.map_contains_key(F.coalesce("_f", F.create_map().cast("map<string,string>")), c), coerce(c, F.try_element_at("_f", F.lit(c)))).otherwise(F.col(c)) for c in docs.columns if c in EDITABLE}
    return j.withColumns(out).drop("_f").select(*docs.columns)


def overlay(base: DataFrame, over: DataFrame) -> DataFrame:
    """JSON records (doc_id, json) under an overlay: keys of the overlay win, nulls included; other keys stay."""
    merge = F.pandas_udf(_merge_json, T.StringType())
    j = base.select("doc_id", "json").join(over.select("doc_id", F.col("json").alias("_o")), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("_o").isNull(), F.col("json")).otherwise(merge("json", "_o")).alias("json"))


def _merge_json(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x if y is None else json.dumps(json.loads(x or "{}") | json.loads(y), sort_keys=True, ensure_ascii=False) for x, y in zip(a, b, strict=True)])


def overlay_field(base_json: Column, over_json: Column, field: str) -> Column:
    """One field under an overlay, by the presence of its key in the raw JSON."""
    there = F.array_contains(F.json_object_keys(over_json), field)
    return F.when(F.coalesce(there, F.lit(False)), F.get_json_object(over_json, f"$.{field}")).otherwise(F.get_json_object(base_json, f"$.{field}"))


def latest_version(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of each document's highest version."""
    top = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(top, [key, "version"], "left_semi")


def backfill(docs: DataFrame, records: DataFrame) -> DataFrame:
    """Documents with all metadata from the latest records, nulls included."""
    r = latest_version(records)
    fields = [c for c in docs.columns if c in r.columns and c not in ("doc_id", "version")]
    j = docs.join(r.select("doc_id", *[F.col(c).alias(f"_n_{c}") for c in fields], F.lit(True).alias("_has")), "doc_id", "left")
    return j.withColumns({c: F.when(F.col("_has"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in fields}).select(*docs.columns)


def requeue(docs: DataFrame, stage: str, now: Column) -> DataFrame:
    """Event rows that ask for documents to be processed or indexed again."""
    return docs.select(F.col("source_filename").alias("filename"), F.lit(stage).alias("stage"), F.lit(None).cast("string").alias("error"), now.alias("updated_at"))


def docs_with_chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with their number of chunks, 0 included; counted before the join."""
    n = chunks.groupBy("doc_id").agg(F.count("chunk_id").alias("chunk_count"))
    return docs.join(n, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))


def dashboard(docs: DataFrame, chunks: DataFrame, figures: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one(docs, "documents").unionByName(one(chunks, "chunks")).unionByName(one(figures, "figures"))


def search_documents(docs: DataFrame, query: str) -> DataFrame:
    return docs.filter(F.col("source_filename").ilike(f"%{query}%") | F.col("title").ilike(f"%{query}%"))


def chunk_preview(chunks: DataFrame, doc_id, limit: int = 20) -> DataFrame:
    return chunks.filter(F.col("doc_id") == doc_id).orderBy("chunk_index").limit(limit).select("chunk_id", "chunk_index", F.substring("text", 1, 300).alias("preview"))


def skip_known_files(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files (with sha256) that no processed record has."""
    return files.join(processed.select("sha256"), "sha256", "left_anti")


def inventory(files: DataFrame, processed: DataFrame, force: bool = False) -> DataFrame:
    """One document record a file (path, source_filename, sha256): the processed one where the hash is the same, else a new one.

    ``reused`` says which; nothing is reused with ``force``. Both go on through the pipeline.
    """
    from folioloom.functions import ids

    fresh = files.withColumn("doc_id", ids.doc_id(F.col("source_filename"), F.col("sha256")))
    kept = processed.select("doc_id", "sha256", *[c for c in processed.columns if c not in files.columns and c not in ("doc_id", "sha256")], F.lit(True).alias("_had"))
    if force:
        kept = kept.limit(0)
    return fresh.join(kept, ["doc_id", "sha256"], "left").withColumn("reused", F.coalesce("_had", F.lit(False))).drop("_had")


def keyword_union(old: Column, new: Column, trim: bool = True) -> Column:
    """Old keywords and those of the new that aren't among them, in order."""
    n = F.transform(new, lambda x: F.trim(x)) if trim else new
    return F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.filter(F.coalesce(n, F.array().cast("array<string>")), lambda x: F.length(x) > 0)))


#: Orders of the editor's lists (fixed values): table, and what it is sorted by.
ADMIN_ORDERS = {
    "documents": (("indexed_at", True), ("doc_id", False)),
    "pipeline_status": (("updated_at", True), ("filename", False)),
    "versions": (("doc_id", False), ("version", True)),
    "figures": (("page_num", False), ("figure_id", False)),
    "chunks": (("chunk_index", False), ("chunk_id", False)),
}


def admin_list(rows: DataFrame, table: str, limit: int | None = None) -> DataFrame:
    """A table's rows as an editor lists them, newest or first in the document first; nulls last."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in ADMIN_ORDERS[table]]
    out = rows.orderBy(*order)
    return out.limit(limit) if limit else out


def migrate(docs: DataFrame, chunks: DataFrame, embed: Column) -> dict[str, DataFrame]:
    """A copy of an index with all vectors made anew by another provider; rows are otherwise as they were."""
    return {"documents": docs, "chunks": chunks.withColumn("embedding", embed)}


def report_pages(blocks: DataFrame, footnotes: DataFrame, figures: DataFrame) -> DataFrame:
    """A report's rows: blocks, footnotes and figures per document and page, 0 where there are none."""
    key = ["doc_id", "page_num_1"]
    count = lambda df, name: df.groupBy(*key).agg(F.count("*").alias(name))
    j = count(blocks, "blocks").join(count(footnotes, "footnotes"), key, "full_outer").join(count(figures, "figures"), key, "full_outer")
    return j.select(*key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blocks", "footnotes", "figures")])
