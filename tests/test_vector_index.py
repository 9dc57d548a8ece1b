"""The vector index: recall, pruning, equality with the exact search, hard rows, tables of queries."""

from __future__ import annotations

import numpy as np
import pytest

from folioloom.operators import retrieval as rt
from folioloom.operators import vector_index as vi


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    centres = r.standard_normal((20, 16))
    x = np.repeat(centres, 60, 0) + 0.4 * r.standard_normal((1200, 16))
    data = [(f"c{i}", [float(v) for v in row]) for i, row in enumerate(x)] + [("zero", [0.0] * 16), ("null", None), ("twin", [float(v) for v in x[0]])]
    return spark.createDataFrame(data, "chunk_id string, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('ivf')}"
    vi.build(rows, at, cells=32, rounds=4)
    return at


def queries(rows, n=40):
    return {r["chunk_id"]: [float(x) for x in r["embedding"]] for r in rows.filter("chunk_id RLIKE '^c[0-9]+0$'").limit(n).collect()}


def test_all_cells_equal_the_exact_search(spark, rows, index):
    assert vi.stored_rows(spark, index).count() == 1201
    for q in list(queries(rows).values())[:3]:
        want = [(r["chunk_id"], pytest.approx(r["dist"]), r["vrank"]) for r in rt.nearest(rows, q, 12).orderBy("vrank").collect()]
        assert [tuple(r) for r in vi.search(spark, index, q, 12, probes=32).orderBy("vrank").collect()] == want
    assert vi.search(spark, index, [0.0] * 16, 5).count() == 0


def test_recall_and_pruning(spark, rows, index):
    asked = queries(rows)
    q = spark.createDataFrame(list(asked.items()), "query_id string, vector array<double>")
    exact = {(r["query_id"], r["chunk_id"]) for r in vi.nearest_many(rows, q, 10).collect()}
    some = {(r["query_id"], r["chunk_id"]) for r in vi.nearest_many(vi.stored_rows(spark, index), q, 10, path=index, probes=6).collect()}
    assert len(exact) == 10 * len(asked) and len(some & exact) / len(exact) >= 0.95
    one = vi.search(spark, index, next(iter(asked.values())), 10, probes=3)
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "cell" in filters and "IN" in filters


def test_stored_number_of_cells(spark, rows, index):
    """The index's own number of cells finds what it promises, also for queries that it wasn't measured by."""
    probes, recall = vi.probes_of(spark, index)
    assert recall[probes - 1] >= vi.RECALL and (probes == 1 or recall[probes - 2] < vi.RECALL) and recall == sorted(recall) and recall[-1] == pytest.approx(1)
    assert probes < 16
    q = spark.createDataFrame(list(queries(rows, 60).items()), "query_id string, vector array<double>")
    exact = {(r["query_id"], r["chunk_id"]) for r in vi.nearest_many(rows, q, 10).collect()}
    some = {(r["query_id"], r["chunk_id"]) for r in vi.nearest_many(vi.stored_rows(spark, index), q, 10, path=index).collect()}
    assert len(some & exact) / len(exact) >= 0.9


@pytest.mark.parametrize("block", [7, 4096])
def test_each_query_equals_its_own_search(rows, spark, block, monkeypatch):
    monkeypatch.setattr(vi, "QUERIES", block)
    asked = queries(rows, 20) | {"none": [0.0] * 16}
    got = vi.nearest_many(rows, spark.createDataFrame(list(asked.items()), "query_id string, vector array<double>"), 7).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["vrank"], r["chunk_id"]))
    assert set(by) == set(asked) - {"none"}
    for name in list(by)[:4]:
        assert sorted(by[name]) == [(r["vrank"], r["chunk_id"]) for r in rt.nearest(rows, asked[name], 7).orderBy("vrank").collect()]


def test_nothing_to_index(spark, tmp_path):
    none = spark.createDataFrame([("a", None), ("b", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    at = f"file://{tmp_path}/i"
    vi.build(none, at, cells=4)
    assert vi.search(spark, at, [1.0, 0.0], 3).count() == 0 and vi.probes_of(spark, at)[0] == 1
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    assert vi.nearest_many(none, q, 3).count() == 0 and vi.nearest_many(none, q.limit(0), 3).count() == 0


def test_a_task_holds_few_rows_at_a_time(monkeypatch):
    """Large batches are multiplied in parts, and the result is that of all pairs, ties by key."""
    import pyarrow as pa

    r = np.random.default_rng(8)
    x = np.repeat(r.standard_normal((1500, 8)), 2, 0).astype("f4").astype(float)  # each vector twice
    norms, asked, seen = np.linalg.norm(x, axis=1), r.standard_normal((300, 8)), []
    matrix = vi._matrix
    monkeypatch.setattr(vi, "_matrix", lambda c: seen.append(len(c)) or matrix(c))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(x.tolist(), pa.list_(pa.float32())), pa.array(norms)], names=["key", "v", "norm"])
    got = [t for b in vi._heaps(asked, 5, None)([batch]) for t in zip(*[c.to_pylist() for c in b.columns[:2]], strict=True)]
    assert max(seen) <= 1024 and sum(seen) == 3000
    dist = 1 - (x / norms[:, None]) @ vi._unit(asked).T
    pairs = [(q, k) for q in range(300) for k in sorted(range(3000), key=lambda i: (round(dist[i, q], 12), i))[:5]]
    assert sorted(got) == sorted(pairs)
