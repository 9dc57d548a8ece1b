"""What a step makes, shuffles and takes along, which decides how its cost grows."""

from __future__ import annotations

import hashlib
import io
from contextlib import redirect_stdout
from pathlib import Path

from pyspark.sql import functions as F

from folioloom.functions import text as tx
from folioloom.operators import blocks as bl
from folioloom.operators import index as ix
from folioloom.operators import retrieval as rt
from folioloom.plans import views as v
from folioloom.sources.store import Store


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_commit_makes_its_rows_once_and_shares_a_large_bucket(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return "".join(hashlib.sha256(f"{i}-{k}".encode()).hexdigest() for k in range(12))

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(2000).repartition(8).select(F.lit("a").alias("doc_id"), F.col("id").cast("int").alias("pos"), text("id").alias("text"))
        store = Store(spark, f"file://{tmp_path}/s", buckets=4)
        store.commit({"chunks": rows})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert made.value == 2000
    assert store.read("chunks").count() == 2000 and [r["doc_id"] for r in store.versions("chunks").distinct().collect()] == ["a"]
    assert len(list(Path(tmp_path).glob("s/chunks/*/bucket=*/*.parquet"))) > 1


def test_postings_shuffle_texts_once(spark, sf_dir):
    p = plan(rt.postings(v.chunks(spark, sf_dir).drop("embedding").select("chunk_id", "doc_id", "text"), also=("doc_id",)))
    assert "hashpartitioning(chunk_id" in p and "hashpartitioning(term" not in p


def test_a_block_takes_no_other_words_along(spark, sf_dir):
    generate = next(line for line in plan(v.blocks(spark, sf_dir)).splitlines() if "Generate" in line)
    assert generate.rsplit("[", 2)[1].startswith("doc_id") and "w#" not in generate.split("), [", 1)[1]


def test_texts_that_are_compared_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "c1", "a"), (1, "c2", "b")], "doc_id long, chunk_id string, text string")
    p = plan(ix.chunk_audit(rows, rows))
    assert p.count("sha2(") >= 2 and all("sha2(" not in x.split("Exchange")[-1] or "Exchange" not in x for x in p.splitlines())


def test_references_are_joined_by_document(spark):
    blocks = spark.createDataFrame([(1, "b1", "x"), (1, "b2", "y"), (2, "b1", "z")], "doc_id long, block_id string, text string")
    refs = spark.createDataFrame([(1, "b1", "n2"), (1, "b1", "n1"), (2, None, "n3"), (2, "b9", None)], "doc_id long, parent_block_id string, footnote_id string")
    found = bl.block_refs(blocks, refs)
    assert {(r["doc_id"], r["block_id"]): r["footnote_refs"] for r in found.collect()} == {(1, "b1"): ["n1", "n2"], (1, "b2"): [], (2, "b1"): []}
    assert all("block_id" not in x for x in plan(found).splitlines() if "Join" in x)


def test_snippets_are_cut_in_one_scan_a_pattern(spark):
    df = spark.createDataFrame([("word43, (1)",), (None,)], "t string").select(tx.find_refs(F.col("t")).alias("r"))
    assert "ArrowEvalPython" in plan(df)
    got = [[(x["number"], x["snippet"]) for x in r["r"] or []] for r in df.collect()]
    assert got == [[(43, "word43, (1)"), (1, "word43, (1)")], []]
