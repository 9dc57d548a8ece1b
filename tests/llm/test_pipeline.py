"""The pipeline's stages on a small folder of tables, against what each operator alone decides."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from folioloom.llm import langid, mixing, packing, queries, similar


def components_of_all_pairs(texts, width=5, least=0.8):
    """The least id of each text's component, by comparing all pairs of its words' shingles."""
    import re

    sets, parent = {}, {d: d for d in texts}
    for d, t in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in texts}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, docs.first()["text"], "en", "src1", 0)], docs.schema)
    at = docs.union(extra)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, at, sf_dir)
        if name != "pack":
            assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), at.schema)
        seen.append((name, before, at))
    assert [n for n, *_ in seen] == ["language_id", "exact_dedup", "near_dedup", "mix", "pack"]
    ids = {n: Counter(r["doc_id"] for r in d.collect()) for n, _, d in seen}
    assert 10**6 not in ids["language_id"] and 10**6 + 1 in ids["language_id"] and 10**6 + 1 not in ids["exact_dedup"]
    # the near stage by all pairs: the least id of each component of similarity 0.8 or more stays
    texts = {r["doc_id"]: r["text"] for r in seen[1][2].collect()}
    assert set(ids["near_dedup"]) == set(components_of_all_pairs(texts).values())
    copies = {r["doc_id"]: r["copies"] for r in mixing.copies(spark, seen[2][2]).collect()}
    assert ids["mix"] == Counter({d: c for d, c in copies.items() if c})
    tokens = sum(r["length"] for r in seen[4][2].collect())
    encoding = packing.tokenizer()
    assert tokens == sum(len(encoding.encode_ordinary(r["text"])) + 1 for r in seen[3][2].collect())
    assert langid.UNKNOWN == "und"


def test_pipeline_over_hard_rows(spark, sf_dir, tmp_path):
    """A very long text, a third of all rows equal, a third nearly equal, null ids, and columns with clashing names, end to end."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    base = [x["text"] for x in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars > 600").collect()]
    words = base[0].split()[:200]

    def edited():
        w = list(words)
        w[r.randrange(len(w))] = r.choice(words)
        return " ".join(w)

    rows = [(i, x, "en", "s1") for i, x in enumerate(base[1:81])] + [(1000 + i, base[81], "en", "s1") for i in range(80)] + [(2000 + i, edited(), "en", "s2") for i in range(80)]
    rows += [(None, base[82] + f" {i}", "en", None) for i in range(3)] + [(5000, " ".join(base[:60]) * 40, "en", "s1"), (5001, "", "en", "s1"), (5002, None, None, None)]
    odd = ("_key", "_row", "_hash", "_at", "key", "node", "size", "copies", "fp")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long")} | {c: F.lit(1) for c in odd})
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert sorted(at.columns) == sorted(docs.columns)
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "near_dedup":
            ids = [x["doc_id"] for x in at.collect()]
            assert sum(1000 <= (i or 0) < 2000 for i in ids) == 1 and sum(2000 <= (i or 0) < 3000 for i in ids) == 1
            assert ids.count(None) == 1 and 5000 in ids and len([i for i in ids if i is not None and i < 1000]) >= 76
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 80


def test_run_removes_what_it_no_longer_reads(spark, sf_dir):
    """Only what the last stage reads is left under the shared folder."""
    import glob

    from folioloom.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/folioloom/*"
    before = set(glob.glob(folder))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(folder)) - before}
    assert left == {"pipeline-mix"}


def test_registered_queries_run(spark, sf_dir):
    assert len(queries.QUERIES) == 13
    for name in ("op3_license_compression", "op5_virtual_slots", "op7_exact_dedup", "op9_systematic_mix"):
        assert queries.QUERIES[name](spark, sf_dir).columns


@pytest.mark.parametrize("rows", [0, 3])
def test_empty_and_null_tables(spark, tmp_path, rows):
    """Every operator's query and the pipeline over tables without rows, and over rows of nulls."""
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "pages": "page_id long, url string, html string"}
    for name, schema in schemas.items():
        width = schema.count(",") + 1
        spark.createDataFrame([(None,) * width] * rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    many = {"op1", "op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"}
    for name, query in queries.QUERIES.items():
        got = query(spark, str(tmp_path)).collect()
        assert len(got) == (rows if name.split("_")[0] in many else 0), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
