"""Records as JSON lines with fixed schemas, versioned folders, and document bundles."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"

#: Record types and their columns.
SCHEMAS = {
    "documents": "doc_id string, source_filename string, sha256_pdf string, title string, author string, editor string, publication string, journal_ref string, volume string, issue string, page_range_label string, year int, doi string, url string, document_type string, abstract string, keywords array<string>, language string, isbn string, issn string, series string, description string, page_offset int, metadata_sources array<struct<field:string,source:string,confidence:double,raw_value:string>>, s3_prefix string",
    "pages": f"doc_id string, page_num_1 int, width double, height double, page_hash string, text_char_count long, image_count long, content_bbox {BBOX}, has_vertical_text boolean, vertical_text_ratio double, suggested_rotation_cw int",
    "text_blocks": f"block_id string, doc_id string, page_num_1 int, bbox {BBOX}, text_raw string, text_clean string, block_type string, section_path string, lang string, lang_confidence double, lang_candidates array<string>, reading_order int, links array<string>",
    "footnotes": "footnote_id string, doc_id string, page_num_1 int, footnote_number int, text_raw string, text_clean string, footnote_type string",
    "footnote_refs": "ref_id string, doc_id string, page_num_1 int, parent_block_id string, footnote_number int, footnote_id string, match_type string, context_snippet string",
    "figures": f"figure_id string, doc_id string, page_num_1 int, bbox {BBOX}, asset_jpg_path string, asset_thumb_path string, caption_text_raw string, caption_text_clean string, derived_from string, applied_rotation_cw int",
    "plates": "plate_id string, doc_id string, page_num_1 int, plate_label string, figure_ids array<string>",
    "chunks": "chunk_id string, doc_id string, chunk_index int, start_page int, end_page int, section_heading string, text string, block_ids array<string>, token_count int, embedding array<float>",
    "chunk_changes": "doc_id string, version int, total_chunks long, added long, removed long, text_changed long, unchanged long, indexed_at timestamp",
    "pipeline_status": "filename string, stage string, error string, updated_at timestamp",
}

#: What a missing key means.
DEFAULTS = {
    "documents": {"keywords": "array()", "metadata_sources": "array()", "page_offset": "0", "s3_prefix": "''"},
    "text_blocks": {"text_clean": "''", "block_type": "'paragraph'", "reading_order": "0", "links": "array()", "lang_candidates": "array()"},
    "footnotes": {"text_clean": "''", "footnote_type": "'explanatory'"},
    "figures": {"caption_text_raw": "''", "caption_text_clean": "''", "applied_rotation_cw": "0"},
    "pages": {"has_vertical_text": "false", "suggested_rotation_cw": "0", "text_char_count": "0", "image_count": "0"},
}

BLOCK_TYPES = ("paragraph", "heading", "list_item", "header", "footer", "footnote", "page_number", "caption", "table", "other")
FOOTNOTE_TYPES = ("citation", "explanatory", "mixed")
OPTIONAL = ("footnotes", "footnote_refs", "figures", "plates", "pages")


def with_defaults(df: DataFrame, record: str) -> DataFrame:
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.expr(v).cast(types[c])) for c, v in DEFAULTS.get(record, {}).items() if c in types})


def schema(record: str) -> T.StructType:
    return T._parse_datatype_string(SCHEMAS[record])


def read_jsonl(spark: SparkSession, paths: str | list[str], record: str) -> DataFrame:
    """JSON lines of a record type; blank lines are skipped, unknown keys ignored, missing ones defaulted."""
    return with_defaults(spark.read.schema(schema(record)).json(paths), record)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Overwrites a folder of JSON lines; with an order, rows are sorted over all files, by name, and a document isn't parted where it comes first."""
    (df.repartitionByRange(*order[:1]).sortWithinPartitions(*order) if order else df).write.mode("overwrite").json(path)


def write_bundle(bundle: dict[str, DataFrame], folder: str) -> None:
    """All record types of a run; plates only where there are any."""
    for name, df in bundle.items():
        if name == "plates" and df.isEmpty():
            continue
        write_jsonl(df, f"{folder}/{name}", ["doc_id", "page_num_1", "reading_order"] if name == "text_blocks" else None)


def read_bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All record types of a run; optional ones that aren't there are empty."""
    jvm = spark.sparkContext._jvm
    out = {}
    for name in ("documents", "text_blocks", *OPTIONAL):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        if not there and name not in OPTIONAL:
            raise FileNotFoundError(f"{folder}/{name}")
        out[name] = read_jsonl(spark, f"{folder}/{name}", name) if there else spark.createDataFrame([], schema(name))
    return out


def read_raw_json(spark: SparkSession, paths: str | list[str], key: str = "doc_id") -> DataFrame:
    """(key, json) of each line, for overlays, where presence of a key matters."""
    lines = spark.read.text(paths).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.get_json_object("value", f"$.{key}").alias(key), F.col("value").alias("json"))


#: Where a version of a document lies.
VERSIONED = r"processed/([^/]+)/v(\d+)/"


def key_parts(path, uri: bool = False) -> tuple:
    """(doc_id, version) columns of an object's path, which ``uri`` says is escaped as URIs are; the version is null where it doesn't fit."""
    version = F.regexp_extract(path, VERSIONED, 2)
    folder = F.regexp_extract(path, VERSIONED, 1)
    return doc_id_of(doc_id_of(folder) if uri else folder), F.when(version != "", version.cast("int"))


def read_versions(spark: SparkSession, root: str, record: str) -> DataFrame:
    """All versions of a record type under ``processed/<doc>/v<N>/``, with ``version`` from the path."""
    df = spark.read.schema(schema(record)).option("pathGlobFilter", "*.jsonl").json(f"{root}/processed/*/v*/{{{record},{record}.jsonl}}")
    doc, version = key_parts(F.col("_metadata.file_path"), uri=True)
    return with_defaults(df.withColumns({"version": version, "path_doc_id": doc}), record)


def write_version(records: DataFrame, root: str, record: str, version: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """Write each document's records as its next version, ``processed/<doc>/v<N>/<record>.jsonl``; (doc_id, version) of what was written.

    Documents without an earlier version begin with 1. ``version`` (doc_id, version) sets the
    numbers where several record types go into one version. Rows lie in the order given. What a path can't
    hold of a doc_id is escaped as ``%41`` (``folder_name``); rows whose doc_id is null are left out, as no folder can be theirs.
    This is the layout that other programs read: a file is renamed into place once all are written, one call on the driver for each
    document of the run, which is a batch of arrivals. A run that fails while it renames leaves whole files of some documents; those of
    the others aren't there. Versions of many documents that must come together or not at all are kept by ``store.Store``.
    """
    spark = records.sparkSession
    records = records.filter("doc_id IS NOT NULL")
    if version is None:
        version = spark.createDataFrame(next_versions(spark, root, records.select("doc_id").distinct()).collect(), "doc_id string, version int")  # the run's documents
    numbered = records.join(version.select("doc_id", F.col("version").alias("_to")), "doc_id").withColumn("_doc", folder_name(F.col("doc_id")))
    staging = f"{root}/.writing-{uuid.uuid4().hex}"
    # the writer needs rows by (_doc, _to): an order that begins so is kept, any other is sorted anew and lost
    whole = numbered.repartition("_doc").sortWithinPartitions("_doc", "_to", *(order or []))
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(sc._jsc.hadoopConfiguration())
    try:
        whole.write.partitionBy("_doc", "_to").json(staging)
        for part in fs.globStatus(path(f"{staging}/_doc=*/_to=*/part-*")) or []:
            at = part.getPath()
            to, doc = at.getParent().getName().removeprefix("_to="), unquote(at.getParent().getParent().getName().removeprefix("_doc="))
            folder = path(f"{root}/processed/{doc}/v{to}")
            fs.mkdirs(folder)
            if not fs.rename(at, path(folder, f"{record}.jsonl")):
                raise FileExistsError(f"{folder}/{record}.jsonl")
    finally:
        fs.delete(path(staging), True)
    return version


#: Characters of a doc_id that stay as they are in a folder's name.
_PLAIN = r"A-Za-z0-9._ -"


def folder_name(doc_id: Column) -> Column:
    """A doc_id as a folder's name: letters beyond ASCII and signs that paths or globs use as %-escapes of their UTF-8 bytes, and so is a leading dot or underscore, which readers would pass over."""
    parts = F.regexp_extract_all(doc_id, F.lit(f"(?s)^[._]|[{_PLAIN}]+|[^{_PLAIN}]+"), F.lit(0))
    plain = lambda x: x.rlike(rf"^[{_PLAIN}]+\z") & ~x.rlike(r"^[._]\z")
    escaped = lambda x: F.regexp_replace(F.hex(F.encode(x, "utf-8")), "(..)", "%$1")
    return F.array_join(F.transform(parts, lambda x: F.when(plain(x), x).otherwise(escaped(x))), "")


def doc_id_of(folder: Column) -> Column:
    """The doc_id that a folder's name stands for."""
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, version) of all versions under ``processed/``, from the paths of their files; executors list them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(f"{root}/processed").select("path")
    doc, version = key_parts(F.col("path"))
    return files.select(doc.alias("doc_id"), version.alias("version")).filter("version IS NOT NULL").distinct()


def next_versions(spark: SparkSession, root: str, docs: DataFrame) -> DataFrame:
    """(doc_id, version): one more than each document's highest, 1 where there is none."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/processed")
    if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
        return docs.select("doc_id", F.lit(1).alias("version"))
    top = versions(spark, root).groupBy("doc_id").agg(F.max("version").alias("_top"))
    return docs.select("doc_id").join(top, "doc_id", "left").select("doc_id", (F.coalesce("_top", F.lit(0)) + 1).alias("version"))


def read_latest(spark: SparkSession, root: str, record: str) -> DataFrame:
    """A record type's rows in each document's highest version: what a viewer of one document shows."""
    rows = read_versions(spark, root, record)
    top = versions(spark, root).groupBy("doc_id").agg(F.max("version").alias("version")).withColumnRenamed("doc_id", "path_doc_id")
    return rows.join(top, ["path_doc_id", "version"], "left_semi")


def discover_outputs(spark: SparkSession, root: str) -> DataFrame:
    """Documents of local runs, ``out/<doc>/documents.jsonl``: path and record, sorted by path."""
    df = spark.read.schema(schema("documents")).json(f"{root}/out/*/documents.jsonl")
    return with_defaults(df.withColumn("path", F.col("_metadata.file_path")), "documents").orderBy("path")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database's table; with a numeric ``key`` and its bounds, read in ``parts`` ranges at once. The driver must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", parts: int = 8, **options: str) -> None:
    """Rows into a database's table, over at most ``parts`` connections; arrays and structs go as JSON."""
    plain = [F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in df.dtypes]
    df.select(*plain).write.format("jdbc").option("url", url).option("dbtable", table).option("numPartitions", parts).options(**options).mode(mode).save()


def discover_pdfs(spark: SparkSession, root: str) -> DataFrame:
    """PDF files under a folder with their SHA-256; content stays with the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.substring_index("path", "/", -1).alias("source_filename"), F.sha2("content", 256).alias("sha256"), "length")


def pages_selected(spec: str | None) -> list[int] | None:
    """``1-10,15`` as sorted page numbers; None for all."""
    if not spec:
        return None
    out: set[int] = set()
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        out |= set(range(int(a), int(b or a) + 1))
    return sorted(out)


