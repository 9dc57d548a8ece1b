from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioloom.functions import ids
from folioloom.functions import text as tx
from folioloom.functions.analyzer import query_terms, stem


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    ("make", "given", "want"),
    [
        (tx.estimate_tokens, ["hello", "hello world test", ""], [1, 4, 1]),
        (tx.dehyphenate, ["exam-\nple", "Exam-\nPle"], ["example", "Exam-\nPle"]),
        (tx.superscript_refs, ["a<sup>17</sup>", "b<sup>3a</sup>", r"c\(^{91}\)"], ["a(17)", "b(3a)", "c(91)"]),
        (tx.clean_text, ["a­b​c", "x  \t y\nz", "  ﬁ "], ["abc", "x y\nz", "fi"]),
        (tx.footnote_number, ["1 Some", "(12) Some", "3. Some", "4) Some", "Some 1", "1234 x", None], [1, 12, 3, 4, None, None, None]),
        (tx.filename_year, ["Abdullah (2011) x.pdf", "x.pdf"], ["2011", ""]),
        (tx.rotation_hint, ["map|rotate90cw", "map|rotate90ccw", "map"], [90, 270, 0]),
        (tx.asset_path, ["/a/assets/b.jpg", "/a/b.jpg", None], ["assets/b.jpg", "assets/b.jpg", None]),
        (tx.clean_title, ["**Bold** title\nAuthor", "```markdown\nT\n```"], ["Bold title", "T"]),
        (tx.type_label, ["index", "odd", None], [" [Index]", " [odd]", ""]),
        (tx.strip_think, ["<think>\nx</think>\n answer"], ["answer"]),
        (tx.citation_clean, ["*Journal of the Malayan Branch of the Royal Asiatic Society* ", None], ["JMBRAS", ""]),
    ],
)
def test_functions(spark, make, given, want):
    assert one(spark, make(F.col("x")), *given) == want


def test_page_ranges(spark):
    got = one(spark, tx.page_range(F.col("x")), "57-61", "57–61", "42", None, "", " 57 - 61 ", "57-61x", "42x")
    assert [tuple(g) if g else None for g in got] == [(57, 61), (57, 61), (42, 42), None, None, (57, 61), (57, 61), None]


def test_footnote_types(spark):
    texts = ["35 Weld to Kimberley, CO 273/105", "1 Gullick (1992: 246-8)", "2 Ibid.", "3 A local term for the river's upper reaches", "4 Smith (1990: 12). This was a much longer story about the old families of the coast"]
    assert one(spark, tx.footnote_type(F.col("x")), *texts) == ["citation", "citation", "citation", "explanatory", "mixed"]


def test_language_gated(spark):
    df = spark.createDataFrame([("café Жx", "en"), ("café", "fr"), (None, "en")], "x string, l string")
    got = [r[0] for r in df.select(tx.remove_script_intrusions(tx.strip_diacritics(F.col("x"), F.col("l")), F.col("l"))).collect()]
    assert got == ["cafe x", "café", None]


def test_refs(spark):
    (refs,) = one(spark, tx.find_refs(F.col("x")), "word43, Smith.9 end. 45 (1) [2]")
    assert {(r["match_type"], r["number"]) for r in refs} == {("regex_superscript", 43), ("regex_period_superscript", 9), ("regex_space_superscript", 45), ("regex_parens", 1), ("regex_brackets", 2)}
    (text,) = one(spark, tx.ref_markup(F.col("x"), tx.find_refs(F.col("x"))), "word43, Smith.9 end. 45 (1) [2]")
    assert text == "word [ref:43], Smith [ref:9] end. [ref:45] (1) [2]"


def test_ids(spark):
    assert one(spark, ids.slug(F.col("x")), "Abdullah (2011) JMBRAS 84(1), 1-22.pdf", "Ünïcödé File.pdf") == ["abdullah-2011-jmbras-84-1-1-22", "unicode-file"]
    assert one(spark, ids.doc_id(F.lit("test.pdf"), F.col("x")), "abc123def456789") == ["test-abc123def456"]
    a, b = one(spark, ids.text_hash(F.col("x")), "é", "é")
    assert a == b
    assert one(spark, ids.page_hash(F.array(F.col("x"), F.lit("a"))), "b") == one(spark, ids.page_hash(F.array(F.lit("a"), F.col("x"))), "b")


@pytest.mark.parametrize(("word", "want"), [("reports", "report"), ("running", "run"), ("hopping", "hop"), ("hoped", "hope"), ("relational", "relat"), ("skies", "ski"), ("happily", "happili"), ("knightly", "knight"), ("generously", "generous"), ("consignment", "consign")])
def test_stems(word, want):
    assert stem(word) == want


def test_query_terms():
    assert query_terms("The history of THE Malay history") == ["history", "malay"]
    assert query_terms("of the") == []


def test_stems_of_a_batch_are_made_once_a_word(monkeypatch):
    import pyarrow as pa

    from folioloom.functions import analyzer

    made, stem = [], analyzer.stem
    monkeypatch.setattr(analyzer, "stem", lambda w: made.append(w) or stem(w))
    rows = [["reports", "reports"], None, [], ["running", None, "reports"]] * 50
    want = [None if r is None else [None if w is None else stem(w) for w in r] for r in rows]
    column = pa.array(rows, pa.list_(pa.string()))
    assert analyzer.stemmed(column).to_pylist() == want and sorted(made) == ["reports", "running"]
    assert analyzer.stemmed(column.slice(3, 6)).to_pylist() == want[3:9] and analyzer.stemmed(column.slice(0, 0)).to_pylist() == []
