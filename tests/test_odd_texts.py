"""Queries over made documents whose texts are odd, against their SQL."""

from __future__ import annotations

import duckdb
import pytest

from folioloom.plans import registry
from test_queries import plain


@pytest.fixture
def odd(spark, tmp_path):
    def write(texts: list[str | None]) -> str:
        rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts, 1)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def agrees(spark, d: str, name: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    got = con.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    want = sorted(tuple(map(plain, r)) for r in got.fetchall())
    rows = sorted(tuple(plain(r[c]) for c in names) for r in registry.QUERIES[name](spark, d).collect())
    assert rows == want
    return rows


def test_words_that_cancel_out_have_a_vector(spark, odd):
    # the hashes of "w17" and "w103" are the prefix's, with the other sign
    assert len(agrees(spark, odd(["w17", "w103", "a text", "w17 w103 passage:"]), "embed_stub")) == 4


def test_a_footnote_of_nothing_but_its_number(spark, odd):
    # the 17th block, as large as its page, has digits and dots alone
    words = " ".join(["word"] * 640)
    found = agrees(spark, odd([f"{words} 2.0.", f"{words} 3. 4.", f"{words} more", words]), "footnotes_by_place")
    assert [r[:4] for r in found if r[2].endswith("-00016")] == [(i, 5, f"b{i}-00016", 17) for i in (1, 2, 3)]
