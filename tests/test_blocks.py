from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.operators import blocks as bl
from folioloom.operators import chunking as ch

SCHEMA = "doc_id string, block_id string, page_num_1 int, reading_order int, block_type string, text string"
STITCHED = "doc_id string, block_ids array<string>, start_page int, end_page int, text string, block_type string, footnote_refs array<string>, pos int"


def blocks(spark, *rows):
    return spark.createDataFrame([("d", f"b{i}", *r) for i, r in enumerate(rows)], SCHEMA)


def stitched(spark, *rows, doc="d"):
    return spark.createDataFrame([(doc, [f"b{i}"], p, p, t, k, list(refs), i) for i, (k, p, t, *refs) in enumerate(rows)], STITCHED)


def ids(df):
    return [r["block_ids"] for r in df.orderBy("pos").collect()]


def test_restitch_cases(spark):
    p = "paragraph"
    assert ids(bl.restitch(blocks(spark, (1, 0, p, "The start "), (2, 0, p, " goes on.")))) == [["b0", "b1"]]
    assert ids(bl.restitch(blocks(spark, (1, 0, p, "The end."), (2, 0, p, "goes on")))) == [["b0"], ["b1"]]
    assert ids(bl.restitch(blocks(spark, (1, 0, p, "The start"), (2, 0, p, "Upper")))) == [["b0"], ["b1"]]
    assert ids(bl.restitch(blocks(spark, (1, 0, p, "The start"), (3, 0, p, "lower")))) == [["b0"], ["b1"]]
    assert ids(bl.restitch(blocks(spark, (1, 0, "heading", "The start"), (2, 0, p, "lower")))) == [["b0"], ["b1"]]
    assert ids(bl.restitch(blocks(spark, (1, 0, p, "a"), (2, 0, p, "b"), (3, 0, p, "c")))) == [["b0", "b1", "b2"]]
    assert ids(bl.restitch(blocks(spark, (1, 0, p, "a"), (2, 1, p, "b")))) == [["b0"], ["b1"]]
    assert ids(bl.restitch(blocks(spark))) == []
    r = bl.restitch(blocks(spark, (1, 0, p, " The start "), (2, 0, p, " goes on "))).first()
    assert (r["text"], r["start_page"], r["end_page"]) == (" The start goes on ", 1, 2)


def test_restitch_takes_the_union_of_refs(spark):
    df = blocks(spark, (1, 0, "paragraph", "a"), (2, 0, "paragraph", "b")).withColumn("footnote_refs", F.array(F.concat(F.lit("f"), "block_id"), F.lit("f0")))
    assert bl.restitch(df).first()["footnote_refs"] == ["f0", "fb0", "fb1"]


def test_article_range_and_title(spark):
    b = stitched(spark, ("paragraph", 1, "x"), ("paragraph", 57, "before"), ("heading", 57, "The Red & White Flag of Kedah"), ("paragraph", 57, "y"), ("paragraph", 58, "z"), ("paragraph", 62, "w"))
    docs = spark.createDataFrame([("d", "57-61", "The Red and White Flag of Kedah")], "doc_id string, page_range_label string, title string")
    kept = bl.article_range(b, docs)
    assert kept.count() == 4
    assert [r["text"] for r in bl.title_trim(kept, docs).orderBy("pos").collect()][0].startswith("The Red & White")
    none = spark.createDataFrame([("d", None, None)], "doc_id string, page_range_label string, title string")
    assert bl.title_trim(bl.article_range(b, none), none).count() == 6


def test_chunks_by_heading_overflow_and_overlap(spark):
    made = ch.chunks(stitched(spark, ("heading", 1, "H1"), ("paragraph", 1, "a"), ("heading", 2, "H2"), ("paragraph", 2, "b"))).orderBy("chunk_index").collect()
    assert [(r["section_heading"], r["text"], r["block_ids"]) for r in made] == [("H1", "H1\n\na", ["b0", "b1"]), ("H2", "H2\n\nb", ["b2", "b3"])]
    rows = [("heading", 1, "H"), *[("paragraph", i, c * 200) for i, c in enumerate("xyz", 1)]]
    made = ch.chunks(stitched(spark, *rows), max_tokens=80, overlap=50).orderBy("chunk_index").collect()
    assert len(made) == 3
    assert made[1]["text"].startswith("H\n\n" + "x" * 200) and "b1" not in made[1]["block_ids"] and made[1]["section_heading"] == "H"
    assert made[1]["start_page"] == 1
    plain = ch.chunks(stitched(spark, *rows), max_tokens=80, overlap=0).orderBy("chunk_index").collect()
    assert "x" not in plain[1]["text"]


def test_headings_alone_and_long_blocks(spark):
    made = ch.chunks(stitched(spark, ("heading", 1, "A"), ("heading", 1, "B"), ("paragraph", 1, "x" * 4000)), max_tokens=80).orderBy("chunk_index").collect()
    assert [(r["section_heading"], r["block_ids"]) for r in made] == [("A", ["b0"]), ("B", ["b1"]), ("B", ["b2"])]


def test_every_body_block_is_in_one_chunk(spark):
    rows = [("heading" if i % 7 == 0 else "header" if i % 5 == 0 else "paragraph", i // 3 + 1, "w" * (i * 37 % 300)) for i in range(60)]
    made = ch.chunks(stitched(spark, *rows), max_tokens=60)
    got = sorted(x for r in made.collect() for x in r["block_ids"])
    assert got == sorted(f"b{i}" for i, r in enumerate(rows) if r[0] != "header")


def test_footnotes_are_inlined(spark):
    notes = spark.createDataFrame([("d", "f1", 1, "Ibid.", "citation"), ("d", "f2", 2, "a note", "explanatory")], "doc_id string, footnote_id string, footnote_number int, text string, footnote_type string")
    made = ch.chunks(stitched(spark, ("paragraph", 1, "a", "f1", "f2", "gone")), notes).first()
    assert made["text"] == "a\n\n---\nFootnotes:\n[1] [cites:] Ibid.\n[2] a note"


def test_small_chunks_merge(spark):
    made = ch.chunks(stitched(spark, ("heading", 1, "A"), ("paragraph", 1, "x" * 400), ("heading", 1, "B"), ("paragraph", 1, "y")), min_tokens=10).collect()
    assert len(made) == 1 and made[0]["section_heading"] == "A" and made[0]["block_ids"] == ["b0", "b1", "b3"]


def test_boilerplate(spark):
    rows = [(p, i, "paragraph", t) for p in range(1, 7) for i, t in enumerate(["Running head %d" % p, f"body {chr(96 + p)} text", "Printed by us"])]
    out = {(r["page_num_1"], r["reading_order"]): (r["removed"], r["block_type"]) for r in bl.boilerplate(blocks(spark, *rows)).collect()}
    assert out[1, 0] == (True, "header") and out[1, 1] == (False, "paragraph") and out[1, 2] == (True, "footer")


def test_split_footnotes():
    assert bl.split_footnotes("35 Weld to Kimberley, CO 273/105. 36 Smith (1990: 12).") == [(35, "Weld to Kimberley, CO 273/105."), (36, "Smith (1990: 12).")]
    assert bl.split_footnotes("35 One. 34 Two.") == []
    assert bl.split_footnotes("1 One. 99 Two.") == []
    assert bl.split_footnotes("1 One") == []
    assert bl.split_footnotes(None) == []


def test_footnotes_of_blocks(spark):
    df = blocks(spark, (1, 0, "footnote", "3 See Smith"), (1, 1, "footnote", "no number"), (1, 2, "paragraph", "4 not one"), (2, 0, "footnote", "5 One. 6 Two."))
    assert sorted(r["footnote_number"] for r in bl.footnotes(df).collect()) == [3, 5, 6]


def test_link_refs_prefers_the_page_and_the_last(spark):
    b = blocks(spark, (1, 0, "paragraph", "word1, and (2)"), (2, 0, "paragraph", "word1, x"))
    notes = spark.createDataFrame([("d", 1, 0, 1, "n1"), ("d", 1, 1, 1, "n1b"), ("d", 3, 0, 2, "n2")], "doc_id string, page_num_1 int, reading_order int, footnote_number int, footnote_id string")
    got = {(r["parent_block_id"], r["footnote_number"]): (r["footnote_id"], r["match_type"]) for r in bl.link_refs(b, notes).collect()}
    assert got == {("b0", 1): ("n1b", "regex_superscript"), ("b0", 2): ("n2", "regex_parens_xpage"), ("b1", 1): ("n1b", "regex_superscript_xpage")}


def test_markdown(spark):
    page = "# Title\n\n> quoted\n> more\n\n![Figure](a map)\n\n![x](blank page)\n\n- item^2\n---\n1 note\n\n2 other"
    df = spark.createDataFrame([("d", 1, page)], "doc_id string, page_num_1 int, markdown string")
    rows = bl.parse_markdown(df).collect()
    assert [(r["block_type"], r["text"], r["reading_order"]) for r in sorted((r for r in rows if r["text"]), key=lambda r: r["reading_order"])] == [("heading", "Title", 0), ("paragraph", "quoted\nmore", 1), ("list_item", "- item<sup>2</sup>", 2), ("footnote", "1 note", 3), ("footnote", "2 other", 4)]
    assert [r["figure"] for r in rows if r["figure"]] == ["a map"]
