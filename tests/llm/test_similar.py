"""Similar documents against all pairs: recall, groups inside long lists, windows, hard rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import similar
from test_pipeline import components_of_all_pairs


def groups(n_groups, members, words=60, edits=2, seed=1):
    """Texts that are edits of a common one each; groups have nothing in common."""
    r = random.Random(seed)
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{r.randrange(10**6)}" for _ in range(words)]
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(words)] = f"x{r.randrange(10**6)}"
            out.append(" ".join(w))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("short", [64, 8])
def test_groups_in_long_lists(spark, short, monkeypatch):
    """Five groups of 90 whose keys are made to meet in the same lists, all above the limit of a short one."""
    texts = dict(enumerate(groups(5, 90)))
    want = components_of_all_pairs(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    # one choice of no position: all nodes are in one list
    monkeypatch.setattr(similar, "choices", lambda *a: [(0,)])
    monkeypatch.setattr(similar, "_posted", _one_list)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(spark, docs, short=short).collect()}
    apart = sum(got[d] != want[d] for d in want)
    assert apart <= 0.02 * len(want) and len(set(want.values())) >= 5


def _one_list(chosen):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([7] * b.num_rows, pa.int64()), *[b.column(i) for i in range(4)]], names=["list", "f0", "f1", "f2", "f3"])

    return run


def test_no_link_below_the_threshold(spark):
    """Pairs of known similarity from 0.6 to 1: what is linked is 0.8 or more, and nearly all of that is linked."""
    r = random.Random(3)
    rows, truth = [], {}
    for i in range(300):
        base = [f"b{i}w{j}" for j in range(120)]
        edited = list(base)
        for _ in range(r.randrange(8)):
            edited[r.randrange(120)] = f"y{r.random()}"
        a, b = ({tuple(w[j : j + 5]) for j in range(116)} for w in (base, edited))
        truth[i] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited).upper().replace(" ", "\n"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "f0", "list", "key", "u", "_maybe", "first")})
    got = {x["doc_id"]: x["component_id"] for x in similar.similar_documents(spark, df).collect()}
    linked = {i for i in truth if got[2 * i] == got[2 * i + 1]}
    assert min(truth[i] for i in linked) >= 0.8
    alike = [i for i, s in truth.items() if s >= 0.8]
    assert len(alike) > 120 and len(linked) >= 0.95 * len(alike) and len(linked) < 300
    kept = similar.drop_similar_documents(spark, df)
    assert kept.columns == df.columns and {x["doc_id"] for x in kept.collect()} == set(got.values())


def test_hard_rows(spark):
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(None, None), (3, ""), (4, " \n"), (5, "a b"), (6, "A  B"), (6, "A  B"), (7, words), (None, words + " end"), (8, words.replace("w1 ", "v ")), (9, "long " * 70_000), (10, "long " * 70_000 + "er")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in similar.similar_documents(spark, docs).collect()}
    # 50 words with one replaced have 41 of 51 shingles in common; those of "long" are one, so that "er" makes two
    assert got == {(None, 3), (3, 3), (4, 3), (5, 5), (6, 5), (7, 7), (None, 7), (8, 7), (9, 9), (10, 10)}
    kept = sorted(((r["doc_id"], r["text"]) for r in similar.drop_similar_documents(spark, docs).collect()), key=lambda x: (x[0] is None, x[0] or 0))
    assert [d for d, _ in kept] == [3, 5, 7, 9, 10]
    assert similar.similar_documents(spark, docs.limit(0)).count() == 0


def test_a_hot_group_is_one(spark):
    """A third of all texts are edits of one: they stay one group, and candidates stay few."""
    texts = dict(enumerate([*groups(1, 700, 80, 2), *groups(700, 2, 40, 1, seed=5)]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(spark, docs).collect()}
    want = components_of_all_pairs(texts)
    assert sum(got[d] != want[d] for d in want) <= 0.01 * len(want)


def test_best_edges():
    r = random.Random(6)
    rows = [(r.randrange(9), r.randrange(9), 0, r.randrange(2)) for _ in range(300)]
    rows = [(u, v, (7 * u * v + u + v) % 50, c) for u, v, _, c in rows]
    got = {tuple(x) for x in similar.best_edges(np.array(rows, similar._EDGE), 3).tolist()}
    want = set()
    for u in range(9):
        for c, most in ((0, 3), (1, 1)):
            own = sorted({(b, v) for a, v, b, k in rows if a == u and k == c})
            want |= {(u, v, b, c) for b, v in own[:most]}
    assert got == want and len(similar.best_edges(np.empty(0, similar._EDGE))) == 0


def test_short_and_long_lists_by_loops():
    r = np.random.default_rng(1)
    centres = r.integers(0, 2**63, (6, 4)).astype(np.uint64)
    longs = np.repeat(centres, 20, 0) ^ (np.uint64(1) << r.integers(0, 63, (120, 4)).astype(np.uint64))
    lists = np.repeat([1, 1, 4, 5, 5, 9], 20)
    nodes = similar.node_of(longs)
    bits = lambda i, j: int(np.bitwise_count(longs[i] ^ longs[j]).sum())
    want = {(nodes[i], nodes[j], bits(i, j), 0) for i in range(120) for j in range(120) if i != j and lists[i] == lists[j] and bits(i, j) <= 30}
    found = np.concatenate(similar._short_lists(lists, longs, 30))
    assert {tuple(x) for x in found.tolist()} == want
    centre = similar._centre_of(longs[:20])
    near = np.concatenate(similar._long_list(longs, 30, centre, 3))
    for i in range(120):
        own = sorted(bits(i, j) for j in range(120) if i != j)[:3]
        assert sorted(near["bits"][(near["u"] == nodes[i]) & (near["centre"] == 0)].tolist()) == own


@pytest.mark.parametrize("rows", [40, 10_000])
def test_lists_over_batches(monkeypatch, rows):
    """Lists that batches cut, and one that is longer than all that is compared at a time."""
    import pyarrow as pa

    monkeypatch.setattr(similar, "_ROWS", rows)
    monkeypatch.setattr(similar, "_WINDOW", 64)
    r = np.random.default_rng(2)
    near = r.integers(0, 2**63, 4).astype(np.uint64) ^ (np.uint64(1) << r.integers(0, 60, (300, 4)).astype(np.uint64))
    longs = np.concatenate([r.integers(0, 2**63, (30, 4)).astype(np.uint64), near, r.integers(0, 2**63, (5, 4)).astype(np.uint64)])
    lists = np.concatenate([np.arange(30), np.full(300, 50), np.full(5, 60)])
    table = pa.RecordBatch.from_arrays([pa.array(lists), *[pa.array(longs[:, i].copy().view(np.int64)) for i in range(4)]], names=["list", "f0", "f1", "f2", "f3"])
    packed = list(similar._compared(20, 8, 4, 5)([table.slice(i, 17) for i in range(0, 335, 17)]))
    edges = np.concatenate([np.frombuffer(x, similar._EDGE) for b in packed for x in b.column(1).to_pylist()])
    assert set(edges["u"].tolist()) == set(similar.node_of(near).tolist())
    pairs = [e for b in similar._merged(4)([b.select(["edges"]) for b in packed]) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    parent = {n: n for n in similar.node_of(near).tolist()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    assert len({find(n) for n in parent}) == 1 and len(pairs) <= 5 * len(near)


def test_choices():
    """As many keys as the wanted chance needs, by simulation of independent bits."""
    for k in (2, 3):
        chosen = similar.choices(k)
        assert len(set(chosen)) == len(chosen) and all(len(set(c)) == k for c in chosen)
        r = np.random.default_rng(k)
        same = (r.random((4000, 32)) < (1 - similar._differ(0.8)) ** 8)
        met = np.zeros(4000, bool)
        for c in chosen:
            met |= same[:, list(c)].all(axis=1)
        assert abs(met.mean() - similar.CHANCE) < 0.015
    assert [similar.key_bytes(n) for n in (0, 10**6, 10**8, 10**11)] == [2, 2, 3, 4]
    assert similar.most_bits(0.8) == int(256 * similar._differ(0.8) + 3 * math.sqrt(256 * similar._differ(0.8) * (1 - similar._differ(0.8))))


@pytest.mark.parametrize("chosen", [[(0, 1)], [(3,)]])
def test_no_link_is_lost(spark, chosen, monkeypatch):
    """Where candidates are few, all links between different texts are found nevertheless: groups are those of all pairs."""
    texts = dict(enumerate([*groups(30, 6, 60, 3), *groups(1, 120, 40, 2, seed=4), *groups(40, 2, 9, 1, seed=7), "", "a", "a b", "A  b"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(similar, "choices", lambda *a: chosen)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(spark, docs, best=1).collect()}
    assert got == components_of_all_pairs(texts)


@pytest.mark.parametrize("held", [16, 1 << 16])
def test_prefixes_and_pairs_by_loops(held, monkeypatch):
    """Of random sets, all pairs of 0.8 and more in different components are made, and none of one component."""
    import pyarrow as pa

    monkeypatch.setattr(similar, "_ROWS", held)
    monkeypatch.setattr(similar, "_PAIRS", held)
    r = random.Random(5)
    sets = []
    for i in range(60):
        base = {r.getrandbits(63) for _ in range(r.choice([1, 4, 5, 20, 41]))} | set(range(10))
        sets += [np.array(sorted(set(base) - set(r.sample(sorted(base), min(k, len(base) - 1)))), np.uint64) for k in (0, 0, 1, 2, 4)]
    frequent = np.arange(10, dtype=np.uint64), np.arange(10, 0, -1)
    comp = [r.randrange(40) for _ in sets]
    rows = sorted((int(h), comp[i], i, len(s), at) for i, s in enumerate(sets) for at, h in enumerate(similar.prefix(s, frequent).view(np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["h", "comp", "kind", "n", "pos"])
    got = {p for b in similar._across(0.8)([batch.slice(i, 7) for i in range(0, len(rows), 7)]) for p in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    want = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            apart = len(a) + len(sets[j]) - 2 * both
            assert np.bitwise_count(similar.parities(a) ^ similar.parities(sets[j])).sum() <= apart
            assert (similar.kind_of(a) == similar.kind_of(sets[j])) == (apart == 0)
            if both >= 0.8 * (both + apart) and comp[i] != comp[j]:
                want.add((i, j))
    assert len(want) > 50 and want <= got and all(comp[i] != comp[j] for i, j in got)


def test_chance_makes_no_pairs():
    """Long texts that have many single shingles in common by chance share no key; the pair of 0.8 and more does."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 2**63, 2000).astype(np.uint64)) for _ in range(40)]
    some = r.choice(np.concatenate(sets), 400)
    sets = [np.unique(np.concatenate([s, r.choice(some, 30)])) for s in sets]
    sets.append(np.unique(np.concatenate([sets[0][: len(sets[0]) * 9 // 10], r.integers(0, 2**63, 100).astype(np.uint64)])))
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = sorted((int(h), i, i, len(s), at) for i, s in enumerate(sets) for at, h in enumerate(similar.prefix(s, nothing).view(np.int64)))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["h", "comp", "kind", "n", "pos"])
    got = {p for b in similar._across(0.8)([batch]) for p in zip(*[c.to_pylist() for c in b.columns], strict=True)}
    assert (0, 40) in got and len(got) <= 5
    # parities of long sets tell them apart, whatever their sizes
    apart = lambda a, b: len(np.setxor1d(a, b))
    odd = np.array([similar.parities(s).view(np.int64) for s in [*sets, sets[0][:1700]]] + [None], object)
    n = np.array([*map(len, sets), 1700, 1])
    near = similar._near(odd, n, 0.8)
    i, j = np.array([0, 0, 0, 1, 41]), np.array([40, 41, 42, 2, 40])
    assert near(i, j).tolist() == [True, True, True, False, True] and apart(sets[0], sets[41 - 1]) <= (n[0] + n[40]) / 9


def test_parities_in_spark_are_bounds(spark):
    """Whatever two sets' sizes, at most as many parities differ as members; where sizes are far apart there is no bound."""
    r = np.random.default_rng(9)
    pool = np.unique(r.integers(0, 2**63, 3000).astype(np.uint64))
    sets = [pool[:k] for k in (1, 100, 128, 129, 200, 256, 257, 500, 513, 3000)]
    rows = [(i, j, similar.parities(a).view(np.int64).tolist(), similar.parities(b).view(np.int64).tolist()) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    found = spark.createDataFrame(rows, "i int, j int, a array<bigint>, b array<bigint>").select("i", "j", similar.parities_apart(F.col("a"), F.col("b")).alias("d"))
    for x in found.collect():
        a, b = sets[x["i"]], sets[x["j"]]
        assert x["d"] is None and max(len(a), len(b)) > 2 * min(len(a), len(b)) or x["d"] <= abs(len(a) - len(b))


def test_texts_alike_in_part_make_no_pairs(spark, monkeypatch):
    """Texts a third of whose words are passages of others make no pairs, also where no sample knows the passages; near copies among them are linked."""
    r = random.Random(12)
    passages = [[f"p{i}w{j}" for j in range(12)] for i in range(12)]
    rows = []
    for i in range(240):
        parts = [*r.sample(passages, 3), *[[f"d{i}w{k}v{j}" for j in range(12)] for k in range(6)]]
        r.shuffle(parts)
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows += [(1000 + i, rows[i][1] + " and more") for i in range(0, 240, 24)]
    kept = {}
    staged = similar.staged

    def keep(s, df, name):
        kept[name] = staged(s, df, name)
        return kept[name]

    monkeypatch.setattr(similar, "staged", keep)
    monkeypatch.setattr(similar, "frequent_shingles", lambda *a: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    # candidates find nothing, so that all links are those of the join
    monkeypatch.setattr(similar, "candidates", lambda spark, nodes, *a: nodes.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component_id"] for x in similar.similar_documents(spark, docs).collect()}
    assert got == {d: d - 1000 if d >= 1000 else d for d, _ in rows}
    assert kept["similar-across"].count() <= 20


@pytest.mark.parametrize("similarity", [0.8, 0.65, 0.5])
def test_rarest_keys_by_loops(similarity, monkeypatch):
    """Of random sets, all pairs of the similarity still share a key when each leaves out its most frequent ones, whatever their sizes."""
    import pyarrow as pa

    monkeypatch.setattr(similar, "_ROWS", 16)
    r = random.Random(15)
    sets = []
    for _ in range(40):
        base = [r.getrandbits(63) for _ in range(r.choice([1, 2, 4, 5, 20, 41, 90]))] + list(range(r.randrange(12)))
        sets += [np.array(sorted(set(base) - set(r.sample(base, min(k, len(base) - 1)))), np.uint64) for k in (0, 0, 1, 3, len(base) // 6)]
    frequent = np.arange(6, dtype=np.uint64), np.arange(6, 0, -1)
    spares = [int(similar.spare_keys(np.int64(len(s)), similarity)) for s in sets]
    assert min(spares) == 0 and max(spares) > 5
    lists = [similar.prefix(s, frequent, similarity, k).view(np.int64).tolist() for s, k in zip(sets, spares, strict=True)]
    rows = sorted((h, i) for i, own in enumerate(lists) for h in own * 2)  # texts of equal sets repeat their keys
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["h", "kind"])
    got = [x for b in similar._shared([batch.slice(i, 7) for i in range(0, len(rows), 7)]) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    times = {h: n for h in {h for h, _ in rows} if (n := sum(h in own for own in lists)) > 1}
    assert sorted(got) == sorted((h, i, times[h]) for i, own in enumerate(lists) for h in own if h in times)
    left = [set(sorted((h for h in own if h in times), key=lambda h: (-times[h], -h))[k:]) for own, k in zip(lists, spares, strict=True)]
    alike = 0
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if both >= similarity * (len(a) + len(sets[j]) - both):
                alike += 1
                assert left[i] & left[j]
    assert alike > 200
