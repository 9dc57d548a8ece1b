"""Language profiles: held-out accuracy, plain loops, hard rows."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioloom.operators import language_model as lm


def test_held_out_accuracy(spark):
    x = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = lm.identify(x, lm.fit(x.filter("doc_id % 5 <> 0"))).join(x, "doc_id").filter("doc_id % 5 = 0 AND length(text) > 100")
    for r in found.groupBy("lang").agg(F.avg((F.col("lang") == F.col("detected")).cast("double")).alias("right"), F.count("*").alias("n")).collect():
        assert r["n"] > 10 and r["right"] >= 0.97, r


def test_scores_by_loops(spark):
    rows = [(1, "Das ist ein kleines Haus am Rande des Waldes.", "de"), (2, "This is a small house at the edge of the wood.", "en"), (3, "这是森林边上的一所小房子 and 😀", "zh"), (4, None, "en"), (5, "no label at all here, none", None), (6, "ab", "en"), (7, "Ein Haus ist ein Haus, und die Straße ist lang.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lm.identify(df, lm.fit(df), most=2).collect()}
    counts = defaultdict(Counter)
    grams = lambda t: [(ord(a) * 961 + ord(b) * 31 + ord(c)) % lm.BUCKETS for a, b, c in zip(t, t[1:], t[2:])]  # noqa: B905, E731
    for _, t, lang in rows:
        if t and lang:
            counts[lang].update(grams(t.lower()))
    for d, t, _ in rows:
        if not t or len(t) < 30:
            assert tuple(got[d])[1:] == ("unknown", 0.0, [])
            continue
        g = grams(t.lower())
        score = {k: sum(math.log((c[b] + 0.5) / (c.total() + 0.5 * lm.BUCKETS)) for b in g) / len(g) for k, c in counts.items()}
        best = sorted(score, key=lambda k: (-score[k], k))
        assert got[d]["candidates"] == best[:2] and got[d]["detected"] == best[0]
        assert got[d]["confidence"] == pytest.approx(math.exp(score[best[0]]) / sum(map(math.exp, score.values())), abs=1e-4)
    assert got[7]["detected"] == "de"


def test_nothing_known(spark):
    df = spark.createDataFrame([(1, "a text that is long enough to be told", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in lm.identify(df, lm.fit(df)).collect()] == [(1, "unknown", 0.0, [])]
    many = spark.range(lm.LANGUAGES + 1).selectExpr("'some text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError):
        lm.fit(many)
