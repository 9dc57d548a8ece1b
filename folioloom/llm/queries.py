"""The operators' queries opN_<name> and their SQL, for the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import crosstoken, exact_dedup, infill, langid, license_scan, mixing, mpegts, packing, recurrent, secret_scan, sharding, simhash, toxicity
from folioloom.session import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of held-out rows are never learned from."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    found = toxicity.score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold != 0)
    return found.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_secret_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: three base kinds and what the randomness battery adds."""
    found = secret_scan.scan(spark, table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op3_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in all documents, with their wording's differences."""
    return license_scan.scan(spark, table(spark, sf_dir, "documents"))


def op4_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as transport streams, read back: digests and what the streams hold."""
    media = mpegts.parse(spark, mpegts.encode(spark, table(spark, sf_dir, "documents")))
    stream = F.col("streams")[0]
    payload, units = stream["payload"], stream["units"]
    first, last = units[0], F.element_at(units, -1)
    parts = {
        "streams": F.size("streams"),
        "packets": F.col("packets"),
        "faults": F.col("sync_errors") + F.col("continuity_errors") + F.col("crc_errors"),
        "units": F.size(units),
        "random_access": F.size(F.filter(units, lambda u: u["random_access"])),
        "first_pts": first["pts"],
        "last_pts": last["pts"],
    }
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    placed, _ = sharding.shard(spark, table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages; the text model learns from documents."""
    return langid.identify_pages(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_dedup.exact_groups(spark, table(spark, sf_dir, "documents"), digest=True)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    found = mixing.copies(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op11_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihoods of all documents; held-out rows, and those without an id, are never learned from."""
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)), F.lit(0))
    found = recurrent.score(spark, table(spark, sf_dir, "documents"), fold != 0)
    return found.select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as fill-in-the-middle examples, with digests of what is put out and of what it restores to."""
    made = infill.rearrange(spark, table(spark, sf_dir, "documents"))
    back = infill.restore(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of two tokenizers over all documents."""
    found = crosstoken.align(spark, table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_secret_battery, op3_license_compression, op4_transport_streams, op5_virtual_slots, op6_language_fusion, op7_exact_dedup, op8_simhash, op9_systematic_mix, op10_harmonic_packing, op11_recurrent, op12_infill, op13_crosstoken)
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)
""",
    "op9_systematic_mix": mixing.ORACLE_SQL,
    "op12_infill": infill.ORACLE_SQL,
}
