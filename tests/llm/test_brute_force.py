"""Models of the operators recomputed number by number with plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import langid, toxicity


# -- language fusion -----------------------------------------------------------------------


def trigrams(text):
    """Hashed trigrams of a text's letters, words parted by one blank."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return []
    s = " " + " ".join(words) + " "
    return [((ord(a) * 961 + ord(b) * 31 + ord(c)) * 2654435761 >> 8) % langid.BUCKETS for a, b, c in zip(s, s[1:], s[2:])]  # noqa: B905


def pages():
    r = random.Random(8)
    words = {"de": "der die und haus wald ist nicht ein kleines grün".split(), "en": "the and house wood is not one small green of".split(), "fr": "le la et maison bois est pas une petite vert".split()}
    hosts = ["a.example.de", "b.example.de", "x.co.uk", "y.x.co.uk", "web.fr", "10.0.0.1", None]
    rows = []
    for i in range(90):
        own = r.choice(list(words))
        mixed = [r.choice(words[own if r.random() < 0.7 else r.choice(list(words))]) for _ in range(r.choice([1, 3, 12]))]
        rows.append((i, " ".join(mixed) if i % 11 else r.choice([None, "", "123 !"]), r.choice([own, own, "EN-us", "xx", None]), r.choice(hosts), own))
    return rows


def domain(host):
    labels = host.split(".")
    if labels[-1].isdigit():
        return host
    return ".".join(labels[-3:]) if len(labels) > 2 and labels[-2] in langid.SECOND_LEVEL and len(labels[-1]) == 2 else ".".join(labels[-2:])


def fused(rows, langs, table):
    """(language, posterior) of each row, from its text, declared language and the other rows of its host, domain and suffix."""
    uniform = -math.log(langid.BUCKETS)
    loglik, best = {}, {}
    for i, t, *_ in rows:
        g = trigrams(t or "")
        temper = min(1.0, langid.MAX_GRAMS / len(g)) if g else 1.0
        own = [temper * sum(float(table[b][k]) for b in g) for k in range(len(langs))] + [temper * len(g) * uniform if g else 0.0]
        loglik[i] = [x - max(own) for x in own]
        best[i] = max(range(len(langs)), key=lambda k: (loglik[i][k], -k)) if g else None
    low = lambda x: x and x.lower().replace("_", "-").split("-")[0]
    out = {}
    for i, _, declared, host, _ in rows:
        others = [(h, best[j]) for j, _, _, h, _ in rows if j != i and best[j] is not None]
        if best[i] is None:
            out[i] = (langid.UNKNOWN, 0.0)
            continue
        whole = [sum(b == k for _, b in others) + 1 for k in range(len(langs))]
        prior = [x / sum(whole) for x in whole]
        if host:
            levels = [(lambda h: not h.split(".")[-1].isdigit() and h.split(".")[-1] == host.split(".")[-1]), (lambda h: domain(h) == domain(host)), (lambda h: h == host)]
            for same, alpha in zip(levels, langid.STRENGTH[::-1], strict=True):
                n = [sum(1 for h, b in others if h and same(h) and b == k) for k in range(len(langs))]
                prior = [(x + alpha * p) / (sum(n) + alpha) for x, p in zip(n, prior, strict=True)]
        logs = [x + math.log(p * (1 - langid.OTHER)) for x, p in zip(loglik[i], prior, strict=False)] + [loglik[i][-1] + math.log(langid.OTHER)]
        d = low(declared)
        if d in langs:
            for k in range(len(langs)):
                met = [low(e) for j, _, e, _, _ in rows if best[j] == k and low(e) in langs]
                logs[k] += math.log((met.count(d) + (8.0 if d == langs[k] else 0.5)) / (len(met) + 8.0 + 0.5 * (len(langs) - 1)))
            logs[-1] -= math.log(len(langs))
        p = [math.exp(x - max(logs)) for x in logs]
        top = max(range(len(langs)), key=lambda k: (logs[k], -k))
        post = p[top] / sum(p)
        out[i] = (langs[top] if post >= langid.LEAST and p[-1] / sum(p) <= post else langid.UNKNOWN, post)
    return out


def test_posteriors_of_languages(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, host string, lang string").repartition(3)
    langs, table = langid.fit(spark, df)
    # the model: all different texts of a language, since they are fewer than the sample has room for
    assert langs == ["de", "en", "fr"]
    for k, lang in enumerate(langs):
        counts = Counter(b for t in {t for _, t, _, _, own in rows if own == lang and t} for b in trigrams(t))
        column = [0.05 + counts.get(b, 0) for b in range(langid.BUCKETS)]
        assert table[:, k] == pytest.approx(np.log(np.array(column) / sum(column)), abs=1e-4)
    got = {r["page_id"]: (r["lang"], r["posterior"]) for r in langid.identify(spark, df, (langs, table), "page_id", F.col("text"), F.col("declared"), F.col("host")).collect()}
    want = fused(rows, langs, table)
    assert {i: x for i, (x, _) in got.items()} == {i: x for i, (x, _) in want.items()}
    for i, (_, p) in want.items():
        assert got[i][1] == pytest.approx(p, abs=2e-5), i
    assert len({x for x, _ in want.values()}) == 4 and sum(0.5 < p < 0.999 for _, p in want.values()) > 5


# -- the label model -------------------------------------------------------------------------


def plain_em(masks, fires, y, share, p1, p0, rounds):
    """The label model's estimates after some rounds, by loops over patterns and rows; weights of rows are one."""
    v, bias, gold = len(p1), math.log(share / (1 - share)), list(toxicity.GOLD)
    discount = [1.0] * v

    def chance(x, label=None):
        z = bias + sum(math.log(p1[k] / p0[k]) * discount[k] for k in range(v) if x[k])
        if label is not None:
            z += math.log(gold[0] / gold[1]) if label else math.log((1 - gold[0]) / (1 - gold[1]))
        return 1 / (1 + math.exp(-max(-40, min(40, z))))

    def calibrated():
        nonlocal bias
        low, high = -30.0, 30.0
        for _ in range(60):
            bias = (low + high) / 2
            if sum(chance(x) for x in fires) > share * len(fires):
                high = bias
            else:
                low = bias

    for _ in range(rounds):
        calibrated()
        n, single, both = [0.0, 0.0], [[0.0] * v, [0.0] * v], [defaultdict(float), defaultdict(float)]
        seen = [([m >> k & 1 for k in range(v)], c, chance([m >> k & 1 for k in range(v)])) for m, c in masks.items()]
        q = [chance(x, label) for x, label in zip(fires, y, strict=True)]
        seen += [(x, 1, p) for x, p in zip(fires, q, strict=True)]
        for x, c, p in seen:
            for side, w in ((0, c * p), (1, c * (1 - p))):
                n[side] += w
                for i in range(v):
                    if x[i]:
                        single[side][i] += w
                        for j in range(v):
                            if x[j]:
                                both[side][i, j] += w
        rates = [[min(0.99, max(1e-5, s / n[side])) for s in single[side]] for side in (0, 1)]
        p1, p0 = rates
        strongest = [[0.0] * v for _ in range(v)]
        for i in range(v):
            for j in range(v):
                if i != j:
                    c = []
                    for side in (0, 1):
                        r = rates[side]
                        c.append(max(-1.0, min(1.0, (both[side][i, j] / n[side] - r[i] * r[j]) / math.sqrt(r[i] * (1 - r[i]) * r[j] * (1 - r[j])))))
                    strongest[i][j] = max(c)
        discount = [1 / (1 + sum(max(0.0, x - 0.2) for x in strongest[i])) for i in range(v)]
        calibrated()
        gold = [(sum(w * label for w, label in zip(side, y, strict=True)) + toxicity.GOLD_WEIGHT * g) / (sum(side) + toxicity.GOLD_WEIGHT) for side, g in ((q, toxicity.GOLD[0]), ([1 - w for w in q], toxicity.GOLD[1]))]
    return p1, p0, discount, gold, bias, [chance(x) for x in fires]


def test_label_model_by_loops(spark):
    r = np.random.default_rng(5)
    true = r.random(200) < 0.3
    fires = (r.random((200, 4)) < np.where(true[:, None], [0.7, 0.5, 0.6, 0.4], [0.05, 0.1, 0.02, 0.2])).astype(int)
    fires[:, 3] = np.where(r.random(200) < 0.8, fires[:, 0], fires[:, 3])
    masks = Counter(int(x @ (1 << np.arange(4))) for x in fires)
    sample, y = fires[:80], true[:80].astype(float)
    start = [0.6, 0.5, 0.5, 0.5], [0.1, 0.1, 0.1, 0.1]
    model = toxicity.LabelModel(0.3, np.array(start[0]), np.array(start[1]))
    model.fit(spark.createDataFrame(list(masks.items()), "mask long, n long").repartition(3), sample.astype(float), y, np.ones(80), rounds=4)
    p1, p0, discount, gold, bias, q = plain_em(masks, sample.tolist(), y.tolist(), 0.3, *start, 4)
    for got, want in ((model.p1, p1), (model.p0, p0), (model.discount, discount), (model.gold, gold), (model.bias, bias), (model.posterior(sample.astype(float)), q)):
        assert got == pytest.approx(want, rel=1e-6, abs=1e-8)
