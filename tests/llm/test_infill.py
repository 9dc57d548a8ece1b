"""Fill-in-the-middle examples against plain loops."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from folioloom.llm import infill

SCHEMA = "doc_id long, text string, output string, form string, body string, place long"


def plain(doc_id, text, rate=100, suffix_first=50, seed="7"):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < suffix_first:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rows = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "\n"), (4, "\n\n\n"), (5, "x <P> y\nz"), (6, "<\n<S\n>P>\n<"), (7, "é\n日本語\n😀 tail\n"), (8, "no end"), (8, "no end"), (8, "other\ntext")]
    rows += [(10 + i, "".join(f"line {j} of {i}{'é' * (j % 3)}\n" for j in range(i))) for i in range(60)]
    rows += [(100, "nul \x00 in\x00\nit\r\n\x0b"), (101, "w" * 300_000), (102, "short\n" * 200_000), (-5, "below\nzero\nid")]
    return [(d, t, "clash", "clash", "clash", 9) for d, t in rows]


@pytest.mark.parametrize(("rate", "suffix_first", "slice_"), [(100, 50, None), (40, 20, 100)])
def test_against_loops(spark, rate, suffix_first, slice_, monkeypatch):
    if slice_:
        monkeypatch.setattr(infill, "_SLICE", slice_)
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = infill.rearrange(spark, docs, rate=rate, suffix_first=suffix_first)
    got = got.select("*", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    want = sorted(((d, *plain(d, t, rate, suffix_first), t or "") for d, t, *_ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_string_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([("k-1", "a\nb\nc\nd\n", 1)], "id string, body string, n long")
    assert [tuple(r) for r in infill.rearrange(spark, docs, "id", "body", seed="s").collect()] == [("k-1", *plain("k-1", "a\nb\nc\nd\n", seed="s"))]
    assert infill.rearrange(spark, docs.limit(0), "id", "body").collect() == []


def test_slices_are_bounded():
    import pyarrow as pa

    column = pa.array(["a" * (1 << 20)] * 9 + ["b" * (6 << 20), None, ""])
    assert list(infill._slices(column)) == [(0, 4), (4, 4), (8, 1), (9, 1), (10, 2)] and list(infill._slices(column.slice(0, 0))) == []
