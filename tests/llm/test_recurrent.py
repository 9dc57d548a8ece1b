"""The recurrent language model against plain loops, slopes by differences, and held-out likelihood."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import recurrent as rn
from folioloom.session import staged

SCHEMA = "doc_id long, text string, word string, n long, row long, score double, rare string, round int"


def corpus(n=120, seed=3):
    """Two kinds of sentences, so that words before tell of words after."""
    r = random.Random(seed)
    kinds = [["the", "cat", "sat", "on", "a", "Mat"], ["das", "ist", "ein", "haus", "im", "wald"]]
    rows = [(None, "no id\there"), (1, None), (2, ""), (3, " \n\t"), (4, "One"), (4, "One"), (5, "x" * 2000 + " y"), (6, "a b c É")]
    for i in range(n):
        own = kinds[i % 2]
        words = [own[j % 6] if r.random() < 0.8 else f"w{r.randrange(500)}" for j in range(r.choice([5, 20, 90]))]
        rows.append((10 + i, r.choice([" ", "  ", "\n"]).join(words)))
    rows.append((900, "the cat sat " * 4000))
    return [(d, t, "c", 1, 1, 0.0, "c", 1) for d, t in rows]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", low)]


def walked(model, ids):
    """log10 likelihood of one document, a token and a number at a time."""
    E, W, b, U, C, c, O, o = (getattr(model, k).astype(float) for k in "EWbUCcOo")  # noqa: E741
    n, h, total, last = model.hidden, [0.0] * model.hidden, 0.0, 0
    for i in ids:
        x = [sum(E[last][e] * W[e][j] for e in range(len(W))) + b[j] for j in range(3 * n)]
        g = [sum(h[k] * U[k][j] for k in range(n)) for j in range(3 * n)]
        z = [1 / (1 + math.exp(-(x[j] + g[j]))) for j in range(n)]
        r = [1 / (1 + math.exp(-(x[n + j] + g[n + j]))) for j in range(n)]
        new = [math.tanh(x[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
        h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(n)]
        k = next(k for k in range(len(model.cuts) - 1) if model.cuts[k] <= i < model.cuts[k + 1])
        kinds = [math.exp(sum(h[j] * C[j][q] for j in range(n)) + c[q]) for q in range(len(c))]
        lo, hi = model.cuts[k], model.cuts[k + 1]
        inside = [math.exp(sum(h[j] * O[w][j] for j in range(n)) + o[w]) for w in range(lo, hi)]
        total += math.log10(kinds[k] / sum(kinds)) + math.log10(inside[i - lo] / sum(inside))
        last = i
    return total


@pytest.mark.parametrize("room", [0, 400, 1 << 20])
def test_against_loops(spark, room):
    rows, sizes = corpus(), (5, 4, 3)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)), F.lit(0))
    learned = [t for d, t, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    counts = Counter(w for t in learned for w in words(t)) + Counter({b"": len(learned)})
    total, kinds = sum(counts.values()), len(counts)
    got = rn.score(spark, docs, fold != 0, share=2, rounds=2, words=12, room=room, sizes=sizes)
    # the same model again, to walk through it
    found = rn.word_counts(spark, docs.filter(fold != 0))
    assert {bytes(r["word"]): r["n"] for r in found.collect()} == counts
    _, listed = rn.shortlist(found, room)
    assert sum(len(w) + 16 for w, _ in listed if w) <= room
    vocabulary = rn.Vocabulary(listed, total, kinds, 12)
    model = rn.train(spark, docs.filter(fold != 0), vocabulary, share=2, rounds=2, sizes=sizes)
    inside = {w: i + 2 for i, w in enumerate(vocabulary.words.split()[:10])}
    rare = total - counts[b""] - sum(counts[w] for w in inside)
    rare_kinds = kinds - 1 - len(inside)
    want = []
    for d, t, *_ in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in [*own, b""])
        by_model = sum(math.log10((counts[w] + 0.1) / (rare + 0.1 * (rare_kinds + 1))) for w in own if w not in inside)
        if len(own) <= 100:
            by_model += walked(model, [*(inside.get(w, rn.RARE) for w in own), rn.END])
        else:
            by_model = None
        want.append((d, len(own) + 1, sum(counts[w] > 0 for w in own) + 1, total, base, by_model))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[4])
    got = sorted((tuple(r) for r in got.collect()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)
        if w[5] is not None:
            assert g[5] == pytest.approx(w[5], rel=2e-3, abs=2e-3)  # training may add floats in another order


def test_slopes():
    """Gradients of a window equal differences of its loss; state carried in and ends inside included."""
    r = np.random.default_rng(2)
    model = rn.Model([30, 9, 8, 7, 7, 5, 3, 2, 1], 3, 4, 3, "f8")
    x, y = r.integers(0, 9, (5, 3)), r.integers(0, 9, (5, 3))
    x[2, 1] = rn.END
    h = r.standard_normal((3, 4))
    slope = np.zeros(model.size)
    model.window(x, y, h, model.views(slope))
    for i in range(0, model.size, 3):
        old, losses = model.vector[i], []
        for step in (1e-5, -1e-5):
            model.vector[i] = old + step
            losses.append(-model.window(x, y, h)[0] / y.size)
        model.vector[i] = old
        assert slope[i] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_chances_add_up_to_one():
    model = rn.Model([5, 4, 9, 8, 7, 1, 1, 1], 3, 4, 3, "f8")
    states = np.random.default_rng(4).standard_normal((2, 4))
    for s in states:
        found, _ = model.output(np.repeat(s[None], 8, 0), np.arange(8))
        assert np.exp(found).sum() == pytest.approx(1)


@pytest.mark.parametrize("counts", [[0, 0], [3, 0], [3, 2, 2], [9, 9, *range(50, 0, -1)]])
def test_classes(counts):
    cuts = rn.class_cuts(counts, 8)
    assert cuts[:3] == [0, 1, 2] and cuts[-1] == len(counts) and cuts == sorted(set(cuts)) and len(cuts) <= 3 + 8


def test_documents_side_by_side(monkeypatch):
    """Scores don't depend on what else is scored, on windows or on how many states wait."""
    model = rn.Model([5, 4, 9, 8, 7, 1, 1, 1], 3, 4, 3, "f8")
    r = np.random.default_rng(6)
    docs = [np.append(r.integers(1, 8, n), 0) for n in (0, 3, 40, 3, 1, 17)]
    together = model.scores(docs)
    monkeypatch.setattr(rn, "_WAITING", 4)
    alone = [model.scores([d])[0] for d in docs]
    assert together == pytest.approx(alone) and [x / math.log(10) for x in alone] == pytest.approx([walked(model, d.tolist()) for d in docs])
    assert model.scores([]).tolist() == []


def test_it_learns(spark):
    rows = corpus(600)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)), F.lit(0))
    got = rn.score(spark, docs, fold != 0, share=1, rounds=4, words=300, sizes=(8, 8, 8)).filter("doc_id >= 10 AND doc_id < 900").withColumn("held_out", fold == 0)
    base, score, n = got.filter("held_out").agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (score - base) / n > 0.05  # of 1.7 digits a token, after some 20,000 tokens


def test_no_training_documents_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rn.score(spark, docs, F.lit(False)).collect()}
    assert (got[1]["n_tokens"], got[1]["n_known"], got[1]["train_tokens"], got[2]["n_tokens"]) == (3, 0, 0, 1)
    assert got[1]["base_score"] == pytest.approx(0) and all(math.isfinite(r["score"]) for r in got.values())
    assert rn.score(spark, docs.limit(0), F.lit(True)).collect() == []


def test_every_training_document_is_trained_on(spark, monkeypatch):
    """Gradients come from all training documents unless a caller asks for a share of them."""
    docs = spark.createDataFrame(corpus(60), SCHEMA)
    counts = rn.word_counts(spark, docs)
    total, kinds = counts.agg(F.sum("n"), F.count("*")).first()
    kept = {}
    monkeypatch.setattr(rn, "staged", lambda s, df, name: kept.setdefault(name, staged(s, df, name)))
    rn.train(spark, docs, rn.Vocabulary(rn.shortlist(counts)[1], total, kinds, 50), sizes=(3, 3, 3))
    assert kept["recurrent-sample"].agg(F.sum(F.length("ids") / 4)).first()[0] == total


def test_a_task_takes_one_thread():
    """Products of small matrices cost twice the CPU time on two threads."""
    import os
    import subprocess
    import sys

    code = """
import ctypes, pathlib, sys
import numpy as np
from folioloom.functions.vectors import one_thread
lib = [ctypes.CDLL(str(p)) for p in pathlib.Path(np.__file__).parent.with_name("numpy.libs").glob("*openblas*")]
ask = [getattr(x, n) for x in lib for n in ("scipy_openblas_get_num_threads64_", "openblas_get_num_threads64_") if hasattr(x, n)]
before = [f() for f in ask]
one_thread()
print(bool(ask), before, [f() for f in ask])
"""
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"OMP_NUM_THREADS": "2"}, capture_output=True, text=True, check=True).stdout
    assert out.split()[0] == "False" or out.strip().endswith("[2] [1]")


def test_large_weights():
    """Chances add up to one, and slopes are finite, also where exponentials of the logits would be too large or too small."""
    model = rn.Model([5, 4, 9, 8, 7, 1, 1, 1], 3, 4, 3, "f4")
    for at in (900, -900):
        model.c[:], model.o[:] = at, at
        found, _ = model.output(np.zeros((8, 4), "f4"), np.arange(8))
        assert np.exp(found.astype(float)).sum() == pytest.approx(1)
        slope = np.zeros(model.size, "f4")
        model.output(np.ones((8, 4), "f4"), np.arange(8), model.views(slope))
        assert np.isfinite(slope).all()


def test_a_window_takes_few_steps(monkeypatch):
    """A softmax takes no maximum a row where none is needed."""
    model = rn.Model([5, 4, 9, 8, 7, 1, 1, 1], 3, 4, 3)
    rows = []

    class Seen(np.ndarray):
        def max(self, axis=None, **more):
            rows.append(axis)
            return super().max(axis=axis, **more)

    model.output(np.zeros((8, 4), "f4").view(Seen), np.arange(8))
    assert rows and all(axis is None for axis in rows)
