"""Indexing as one plan, stored versions, the stored index, databases, and what operators keep."""

from __future__ import annotations

import difflib
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioloom.functions import text as tx
from folioloom.operators import blocks as bl
from folioloom.operators import chunking as ch
from folioloom.operators import figures as fg
from folioloom.operators import index as ix
from folioloom.operators import metadata as md
from folioloom.operators import retrieval as rt
from folioloom.plans import flow, maintenance
from folioloom.sources import records as rc

BLOCK = "doc_id string, block_id string, page_num_1 int, reading_order int, block_type string, text string"


def test_blocks_to_chunks(spark):
    """A small article: headers, a footnote on the page and one further on, a paragraph over a page break, pages outside the range."""
    rows = [
        ("d", "a0", 1, 0, "paragraph", "Before the article."),
        ("d", "h2", 2, 0, "header", "Running head"),
        ("d", "t2", 2, 1, "heading", "The Rubber Trade of Perak"),
        ("d", "p2", 2, 2, "paragraph", "Rubber came late(1). It grew and"),
        ("d", "p3", 3, 0, "paragraph", "grew until the war [2] came."),
        ("d", "n3", 3, 1, "footnote", "1 Ibid."),
        ("d", "n4", 3, 2, "footnote", "2 Smith thought that the war came late, and for other reasons entirely."),
        ("d", "g3", 3, 3, "page_number", "3"),
        ("d", "p4", 4, 0, "paragraph", "Another article [9]."),
    ]
    docs = spark.createDataFrame([("d", "The Rubber Trade of Perak", "2-3")], "doc_id string, title string, page_range_label string")
    (chunk,) = flow.make_chunks(spark.createDataFrame(rows, BLOCK), docs).collect()
    assert chunk["section_heading"] == "The Rubber Trade of Perak" and (chunk["start_page"], chunk["end_page"]) == (2, 3)
    assert chunk["block_ids"] == ["t2", "p2", "p3"]
    body, notes = chunk["text"].split("\n\n---\n")
    assert body.endswith("Rubber came late(1). It grew and grew until the war [2] came.") and "Running head" not in body
    assert notes == "Footnotes:\n[1] [cites:] 1 Ibid.\n[2] 2 Smith thought that the war came late, and for other reasons entirely."


def test_most_references_are_found(spark, sf_dir):
    """At least half of the footnotes have a reference, as end to end runs assert."""
    b = flow.records(spark, sf_dir)
    notes = bl.footnotes(b).withColumn("footnote_id", F.col("block_id"))
    linked = bl.link_refs(b, notes).select("footnote_id").distinct().count()
    assert linked >= 0.5 * notes.count() > 0


def test_index_run_changes_what_it_must(spark):
    docs = spark.createDataFrame([("d", "T", None), ("none", "Empty", None)], "doc_id string, title string, page_range_label string")
    blocks = spark.createDataFrame([("d", "a", 1, 0, "paragraph", "One."), ("d", "b", 1, 1, "heading", "Two"), ("d", "c", 1, 2, "paragraph", "Three."), ("none", "x", 1, 0, "header", "Head")], BLOCK)
    first = flow.make_chunks(blocks, docs).withColumn("embedding", F.array(F.lit(1.0).cast("float"))).collect()
    old = spark.createDataFrame(first, flow.make_chunks(blocks, docs).withColumn("embedding", F.array(F.lit(1.0).cast("float"))).schema)
    stored = spark.createDataFrame([("d", "Old", "s3"), ("other", "Other", "s4")], "doc_id string, title string, s3_prefix string")
    same = flow.index_corpus(blocks, docs, stored, old, 2)
    assert same.made.filter("needs_embedding").count() == 0  # an unchanged document needs no vector
    edited = blocks.withColumn("text", F.when(F.col("block_id") == "c", "Changed.").otherwise(F.col("text")))
    run = flow.index_corpus(edited, docs, stored, old, 3)
    assert run.made.filter("needs_embedding").count() == 1
    assert [tuple(r) for r in run.audit.select("doc_id", "total_chunks", "text_changed", "unchanged", "version").collect()] == [("d", 2, 1, 1, 3)]
    kept = {r["doc_id"]: (r["title"], r["s3_prefix"]) for r in run.documents.collect()}
    assert kept == {"d": ("T", "s3"), "other": ("Other", "s4")}  # no chunks, no document; what only the store has stays


def test_upsert_has_the_columns_of_both(spark):
    old = spark.createDataFrame([(1, "a", "x", 5)], "doc_id int, title string, abstract string, extra int")
    new = spark.createDataFrame([(1, None, 3), (2, "b", 4)], "doc_id int, title string, year int")
    got = {r["doc_id"]: r.asDict() for r in ix.upsert_documents(old, new).collect()}
    assert got[1] == {"doc_id": 1, "title": "a", "year": 3, "abstract": "x", "extra": 5}
    assert got[2] == {"doc_id": 2, "title": "b", "year": 4, "abstract": None, "extra": None}


def test_one_long_section(spark):
    """A document without headings, of 30,000 blocks: as fast a block as a short one, and as the loop packs them."""
    n = 30_000
    b = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("pos"), F.lit("paragraph").alias("block_type"), F.rpad(F.concat(F.lit("t"), F.col("id").cast("string")), 40 + (n % 7), "x").alias("text"), F.array(F.col("id").cast("string")).alias("block_ids"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.array().cast("array<string>").alias("footnote_refs"))
    began = time.time()
    rows = ch.raw_chunks(b, 100).select("part", F.transform("rows", lambda r: r["pos"]).alias("pos"), F.size("before").alias("before")).collect()
    assert time.time() - began < 60
    want, used = [[]], 0
    size = (40 + (n % 7)) // 4
    for i in range(n):
        if want[-1] and used + size > 100:
            want.append([])
            used = 0
        want[-1].append(i)
        used += size
    assert [r["pos"] for r in sorted(rows, key=lambda r: r["part"])] == want
    assert sorted({r["before"] for r in rows}) == [0, len(want[0])]


def test_snippets(spark):
    """Each match with up to 20 characters around it, by plain loops."""
    texts = ["See Smith.12 and (3) and [4] word5, end. 6 x", "(1)(2) [3]", "a" * 50 + "7 " + "b" * 50, "nothing", "", "word1 word1 word1.", "😀" * 30 + "a1 " + "😀" * 30, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j1 "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {(r["i"], x["pattern_no"], x["match_no"]): (x["number"], x["snippet"]) for r in df.select("i", tx.find_refs(F.col("t")).alias("r")).collect() for x in r["r"]}
    want = {}
    for i, t in enumerate(texts):
        for p, (_, pattern, group) in enumerate(tx.REF_PATTERNS):
            for k, m in enumerate(re.finditer(pattern, t)):
                want[i, p, k] = (int(m.group(group)), t[max(0, m.start() - 20) : m.end() + 20])
    assert got == want and len(want) > 8
    bare = {(r["i"], x["pattern_no"], x["match_no"]): (x["number"], x["snippet"]) for r in df.select("i", tx.find_refs(F.col("t"), None).alias("r")).collect() for x in r["r"]}
    assert bare == {k: (n, None) for k, (n, _) in want.items()}


def test_references_of_long_texts(spark):
    """Time grows with the text, whether it has no, one or many references."""
    import time

    none, one, many = "z" * 1_000_000, "a1 " + "z é😀" * 250_000, "word12, (3) " * 20_000
    df = spark.createDataFrame([(0, none), (1, one), (2, many)], "i int, t string").repartition(3)
    refs = df.select("i", F.explode(tx.find_refs(F.col("t"))).alias("r")).groupBy("i").agg(F.count("*").alias("n"), F.max(F.length("r.snippet")).alias("most"))
    began = time.time()
    assert {r["i"]: (r["n"], r["most"]) for r in refs.collect()} == {1: (1, 23), 2: (40_000, 44)}
    assert time.time() - began < 30


def test_versions(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([("d", "b", 2, "x"), ("d", "a", 1, "y"), ("e", "c", 1, "z")], "doc_id string, block_id string, page_num_1 int, text_raw string")
    assert {tuple(r) for r in rc.write_version(rows, root, "text_blocks", order=["page_num_1"]).collect()} == {("d", 1), ("e", 1)}
    both = rc.write_version(rows.filter("doc_id = 'd'"), root, "text_blocks")
    rc.write_version(spark.createDataFrame([("d", "f.pdf")], "doc_id string, source_filename string"), root, "documents", version=both)
    assert {tuple(r) for r in rc.versions(spark, root).collect()} == {("d", 1), ("d", 2), ("e", 1)}
    assert [line.split('"block_id":"')[1][0] for line in (tmp_path / "processed/d/v1/text_blocks.jsonl").read_text().splitlines()] == ["a", "b"]
    assert (tmp_path / "processed/d/v2/documents.jsonl").exists() and not list(tmp_path.glob(".writing*"))
    latest = {(r["doc_id"], r["version"]) for r in rc.read_latest(spark, root, "text_blocks").collect()}
    assert latest == {("d", 2), ("e", 1)}
    with pytest.raises(FileExistsError):
        rc.write_version(rows.filter("doc_id = 'e'"), root, "text_blocks", version=spark.createDataFrame([("e", 1)], "doc_id string, version int"))
    (tmp_path / "out" / "d-1").mkdir(parents=True)
    (tmp_path / "out" / "d-1" / "documents.jsonl").write_text('{"doc_id": "d-1", "source_filename": "f.pdf"}\n')
    assert [r["doc_id"] for r in rc.discover_outputs(spark, root).collect()] == ["d-1"]
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "a b.pdf").write_bytes(b"abc")
    (found,) = rc.discover_pdfs(spark, f"{root}/x").collect()
    assert found["source_filename"] == "a b.pdf" and found["sha256"].startswith("ba7816bf") and found["length"] == 3


def test_versions_of_odd_ids(spark, tmp_path):
    """Ids that hold what paths, globs and escapes use: written, found again, and numbered on."""
    root = f"file://{tmp_path}/r"
    odd = ["a=b c%:1", "x/../y", "é 日本", "p*[q]{r}", "_u", ".d", "100%", "a+b", "ok", "w" * 60]
    rows = spark.createDataFrame([(d, f"b{i}", i, "t") for d in odd for i in (2, 0, 1)] + [(None, "n", 1, "t")], "doc_id string, block_id string, page_num_1 int, text_raw string")
    assert {tuple(r) for r in rc.write_version(rows, root, "text_blocks", order=["page_num_1"]).collect()} == {(d, 1) for d in odd}
    assert {tuple(r) for r in rc.write_version(rows.filter("doc_id IN ('a=b c%:1', 'ok', '_u')"), root, "text_blocks").collect()} == {("a=b c%:1", 2), ("ok", 2), ("_u", 2)}
    assert {tuple(r) for r in rc.versions(spark, root).collect()} == {(d, 1) for d in odd} | {("a=b c%:1", 2), ("ok", 2), ("_u", 2)}
    assert {(r["path_doc_id"], r["doc_id"], r["version"]) for r in rc.read_latest(spark, root, "text_blocks").collect()} == {(d, d, 2 if d in ("a=b c%:1", "ok", "_u") else 1) for d in odd}
    for folder in (tmp_path / "r" / "processed").iterdir():
        assert [line.split('"block_id":"')[1][:2] for line in (folder / "v1" / "text_blocks.jsonl").read_text().splitlines()] == ["b0", "b1", "b2"]


def test_a_run_that_fails_leaves_no_drafts(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([("a", "b", 1, "t"), ("z", "b", 1, "t")], "doc_id string, block_id string, page_num_1 int, text_raw string")
    rc.write_version(rows.filter("doc_id = 'z'"), root, "text_blocks")
    with pytest.raises(FileExistsError):
        rc.write_version(rows, root, "text_blocks", version=spark.createDataFrame([("a", 1), ("z", 1)], "doc_id string, version int"))
    assert not list((tmp_path / "r").glob(".writing*")) and rc.read_latest(spark, root, "text_blocks").count() in (1, 2)


def test_page_order_of_files(spark, tmp_path):
    """Rows of a document lie in page order, in one file after the other."""
    rows = [(f"d{i % 7}", p, o) for i in range(7) for p in range(30) for o in range(3)]
    df = spark.createDataFrame(rows, "doc_id string, page_num_1 int, reading_order int").repartition(5)
    rc.write_jsonl(df, f"file://{tmp_path}/b", ["doc_id", "page_num_1", "reading_order"])
    seen = []
    for f in sorted((tmp_path / "b").glob("part-*.json")):
        seen += [tuple(re.findall(r':"?(\w+)', line)) for line in f.read_text().splitlines()]
    assert [(d, int(p), int(o)) for d, p, o in seen] == sorted(rows)


def test_database(spark):
    """Rows through an embedded database: nested values as JSON, ranges read at once."""
    url = "jdbc:derby:memory:folioloom;create=true"
    df = spark.createDataFrame([(i, f"t{i}", [f"k{i}"]) for i in range(20)], "doc_id int, title string, keywords array<string>")
    try:
        rc.write_jdbc(df, url, "docs", mode="overwrite", parts=2, driver="org.apache.derby.jdbc.EmbeddedDriver")
    except Exception as e:
        if "ClassNotFound" in str(e):
            pytest.skip("no embedded database on the class path")
        raise
    rc.write_jdbc(df.limit(3), url, "docs", parts=1, driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = rc.read_jdbc(spark, url, "docs", key="doc_id", low=0, high=20, parts=4, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert back.rdd.getNumPartitions() == 4 and back.count() == 23
    assert back.filter("doc_id = 19").first()["keywords"] == '["k19"]'


def test_lookup_reads_no_text(spark, tmp_path):
    """With a stored index, the search reads postings of the query's terms; texts only of the rows it returns."""
    chunks = spark.createDataFrame([(f"c{i}", f"d{i % 5}", f"tin and rubber {i} " * (i % 4 + 1), [1.0, float(i)]) for i in range(40)], "chunk_id string, doc_id string, text string, embedding array<float>")
    rt.with_norms(chunks).write.parquet(f"{tmp_path}/chunks")
    rt.write_postings(rt.postings(chunks), f"{tmp_path}/postings")
    stored, index = spark.read.parquet(f"{tmp_path}/chunks"), spark.read.parquet(f"{tmp_path}/postings")
    found = rt.text_search(stored, "rubber 7", 10, scope=stored, index=index)
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    scans = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
    assert scans and not any("text" in s or "embedding" in s for s in scans)
    assert "PushedFilters: [In(term" in plan or "In(term, [" in plan
    near = rt.nearest(stored, [1.0, 2.0], 5)
    assert "norm" in near._jdf.queryExecution().toString()
    plain = {r["chunk_id"]: (r["rank_score"], r["trank"]) for r in rt.text_search(chunks, "rubber 7", 10, scope=chunks).collect()}
    assert {r["chunk_id"]: (r["rank_score"], r["trank"]) for r in found.collect()} == plain and plain
    assert [r["chunk_id"] for r in near.collect()] == [r["chunk_id"] for r in rt.nearest(chunks, [1.0, 2.0], 5).collect()]


def test_long_queries_are_cut_for_chunks(spark):
    docs = spark.createDataFrame([("d", "T", None, None, "f.pdf", "p", "other")], "doc_id string, title string, author string, year int, source_filename string, publication string, document_type string")
    chunks = spark.createDataFrame([("c1", "d", 1, 1, "tin", [1.0]), ("c2", "d", 1, 1, "late", [1.0])], "chunk_id string, doc_id string, start_page int, end_page int, text string, embedding array<float>")
    figures = spark.createDataFrame([("f", "d", 1, "late", None)], "figure_id string, doc_id string, page_num int, caption string, embedding array<float>")
    query = "tin " + " " * 2000 + "late"
    assert rt.text_search(chunks, query[: rt.QUERY_CHARS], 5, least=1).count() == 1
    got = rt.retrieve(chunks, docs, query, [0.0], 5)  # a query without a direction: by text alone
    assert [r["chunk_id"] for r in got.collect()] == ["c1"]
    assert rt.retrieve_figures(figures, docs, query.replace("tin", "late"), [0.0]).count() == 1


def test_rank_formula():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 256, 300)], "n long")
    got = [r[0] for r in df.select(rt.damped(F.col("n"))).collect()]
    want = [sum(1 / (i * i) for i in range(1, min(n, 256) + 1)) / 1.64493406685 for n in (1, 2, 3, 256, 300)]
    assert got == pytest.approx(want, abs=1e-12)


def test_scans(spark):
    """One page a case: rendered only where the scan is bare, described, and nothing smaller is on the page."""
    full, small = (0.0, 0.0, 600.0, 790.0), (0.0, 0.0, 100.0, 100.0)
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    images = spark.createDataFrame([("d", 1, full), ("d", 2, full), ("d", 2, small), ("d", 3, full), ("d", 4, full), ("d", 5, full), ("d", 6, small), ("d", 7, full), ("d", 7, full)], f"doc_id string, page_num_1 int, bbox {box}")
    pages = spark.createDataFrame([("d", p, 612.0, 792.0, 9 if p == 3 else 0) for p in range(1, 8)], "doc_id string, page_num_1 int, width double, height double, spans int")
    blocks = spark.createDataFrame([("d", 4, "x" * 100), ("d", 1, "x" * 99)], "doc_id string, page_num_1 int, text_raw string")
    described = spark.createDataFrame([("d", p) for p in (1, 2, 3, 4, 6, 7)], "doc_id string, page_num_1 int")
    assert sorted(r["page_num_1"] for r in fg.scans_to_render(images, pages, blocks, described).collect()) == [1, 7]


def test_page_offset_falls_back_on_printed_numbers(spark):
    docs = spark.createDataFrame([("a", "x.pdf", None), ("b", "y.pdf", "1-20")], "doc_id string, source_filename string, page_range_label string")
    b = spark.createDataFrame([(d, f"{d}{p}", p, 0, "paragraph", f"text of a page {p - 2}") for d in "ab" for p in range(1, 21)], BLOCK)
    pdf = spark.createDataFrame([("a", None, None, 20), ("b", None, None, 23)], "doc_id string, pdf_title string, pdf_author string, page_count int")
    got = {r["doc_id"]: r["page_offset"] for r in md.extract(docs, b, pdf).collect()}
    assert got == {"a": -2, "b": -3}


def test_diffs_of_all_documents(spark, sf_dir):
    """Added and removed lines by difflib over the same texts."""
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        old, n = r["text"], r["doc_id"] % 3
        kept = [x for i, x in enumerate(old.split("\n")) if i % 4 != 1 or n != 0]
        new = "\n".join(f"{x} #{i}" if i % 3 == 0 and n == 1 else x for i, x in enumerate(kept)) + ("\n+ a line of its own" if len(old) % 2 else "")
        lines = "\n".join(difflib.unified_diff(old.splitlines(), new.splitlines(), lineterm="")).split("\n")
        want[r["doc_id"]] = (sum(x[:1] == "+" and x[:3] != "+++" for x in lines), sum(x[:1] == "-" and x[:3] != "---" for x in lines))
    got = {r["doc_id"]: (r["added"], r["removed"]) for r in maintenance.version_diff_lines(spark, sf_dir).collect()}
    assert got == want and len({x for x in want.values()}) > 5


def test_blocks_are_read_twice_and_shuffled_once(spark):
    """A run reads its blocks for the footnotes and for the chunks, and no more; references are those of the operators one by one."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(x):
        made.add(1)
        return x

    kind = F.when(F.col("id") % 3 == 2, "footnote").when(F.col("id") % 7 == 0, "heading").otherwise("paragraph")
    n = (F.floor(F.col("id") / 20) % 4 + 1).cast("string")
    words = F.when(kind == "footnote", F.concat(n, F.lit(" Ibid."))).otherwise(F.concat(F.lit("Tin [1] and ("), n, F.lit(") and [99] of block "), F.col("id").cast("string")))
    plain = spark.range(2000).select((F.col("id") % 20).cast("string").alias("doc_id"), F.concat(F.lit("b"), "id").alias("block_id"), (F.col("id") / 100 + 1).cast("int").alias("page_num_1"), (F.col("id") % 100).cast("int").alias("reading_order"), kind.alias("block_type"), words.alias("text"))
    docs = spark.range(20).select(F.col("id").cast("string").alias("doc_id"), F.lit("T").alias("title"), F.when(F.col("id") % 2 == 0, "2-9").alias("page_range_label"))
    assert flow.make_chunks(plain.withColumn("text", text("text")), docs).count() > 0
    made.add(-made.value)
    rows = flow.make_chunks(plain.withColumn("text", text("text")), docs).collect()
    assert rows and 0 < made.value <= 2 * 2000
    notes = bl.footnotes(plain).withColumn("footnote_id", F.col("block_id"))
    one = {r["block_id"]: r["footnote_refs"] for r in bl.refer(plain, notes).collect()}
    assert one == {r["block_id"]: r["footnote_refs"] for r in bl.block_refs(plain, bl.link_refs(plain, notes, around=None)).collect()}
    assert max(map(len, one.values())) > 1


def test_arrivals_leave_nothing_but_the_store(spark, sf_dir, monkeypatch):
    """Batches of bounded bytes come to the same tables, and landed files and what batches made are gone."""
    from urllib.parse import urlsplit

    from folioloom import session
    from folioloom.plans import arrivals

    monkeypatch.setattr(arrivals, "BATCH_BYTES", 1, raising=False)
    parts, join = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(join, "false")
    staged = set(session._STAGED)
    try:
        store = arrivals._indexed(spark, sf_dir)
    finally:
        spark.conf.unset(join)
    assert len(store.segments()) == 2 * int(parts)  # a file a batch, in both waves
    root = Path(urlsplit(store.root).path)
    assert not list(root.parent.glob("in/**/*.json*")) and set(session._STAGED) == staged
    seen = store.read("chunks")
    assert seen.count() == seen.select("chunk_id").distinct().count() > 0
    assert {tuple(r) for r in store.read("audit").groupBy("version").agg((F.count("*") > 0).alias("some")).collect()} == {(1, True), (2, True)}


def test_a_read_of_documents_opens_their_segments(spark, tmp_path):
    from folioloom.sources.store import Store

    store = Store(spark, f"file://{tmp_path}/s", buckets=2)
    for name in "abc":
        store.commit({"chunks": spark.createDataFrame([(name, 1), (name + "x", 1)], "doc_id string, pos int")})
    store.commit({"chunks": spark.createDataFrame([("a", 2)], "doc_id string, pos int")})
    ids = {s.number: s.id for s in store.segments()}
    opened = lambda df: {n for n, i in ids.items() if any(f"segment={i}" in f for f in df.inputFiles())}
    wanted = store.read("chunks", among=spark.createDataFrame([("a",), ("b",), ("none",)], "doc_id string"))
    assert {tuple(r) for r in wanted.select("doc_id", "pos").collect()} == {("a", 2), ("b", 1)}
    rows = [f for f in wanted.inputFiles() if ".touched" not in f]
    assert {n for n, i in ids.items() if any(f"segment={i}" in f for f in rows)} == {2, 4}  # the first is void for a, and has no b
    assert {tuple(r) for r in store.read("chunks").select("doc_id", "pos").collect()} == {("a", 2), ("ax", 1), ("b", 1), ("bx", 1), ("c", 1), ("cx", 1)}
    assert store.read("chunks", among=spark.createDataFrame([], "doc_id string")).count() == 0
    assert opened(store.read("chunks")) == {1, 2, 3, 4}
