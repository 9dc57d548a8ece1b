"""Segments: what readers see, races, replays, and which files a change touches."""

from __future__ import annotations

import json
import threading
from pathlib import Path

import pytest

from folioloom.sources.store import Conflict, Store

SCHEMA = "doc_id string, pos int, text string"


def rows(spark, *x):
    return spark.createDataFrame(list(x), SCHEMA)


def seen(df):
    return sorted((tuple(r[c] for c in ("doc_id", "pos", "text")) for r in df.collect()), key=repr)


def files(root):
    return {p: p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/s p", buckets=4, order={"chunks": ["pos"]})


def test_replace_and_delete(spark, store, tmp_path):
    odd = "a=b c%:1/é"
    assert store.commit({"chunks": rows(spark, ("a", 1, "x"), ("a", 2, "y"), (odd, 1, "z"), (None, 1, "n"))}) == 1
    before = files(tmp_path)
    assert store.commit({"chunks": rows(spark, ("a", 7, "new"), ("b", 1, "b"))}) == 2
    assert {p: t for p, t in files(tmp_path).items() if p in before} == before  # nothing old was written again
    assert seen(store.read("chunks")) == sorted([("a", 7, "new"), ("b", 1, "b"), (odd, 1, "z"), (None, 1, "n")], key=repr)
    assert seen(store.read("chunks", until=1)) == sorted([("a", 1, "x"), ("a", 2, "y"), (odd, 1, "z"), (None, 1, "n")], key=repr)
    assert {tuple(r) for r in store.versions("chunks").filter("doc_id IS NOT NULL").collect()} == {("a", 2), ("b", 1), (odd, 1)}
    store.delete(spark.createDataFrame([(odd,), ("none",)], "doc_id string"), ["chunks"])
    assert seen(store.read("chunks", doc_ids=["a", odd])) == [("a", 7, "new")]
    # touched documents without rows give way too
    store.commit({"chunks": spark.createDataFrame([], SCHEMA)}, touched={"chunks": spark.createDataFrame([("b",)], "doc_id string")})
    left = [("a", 7, "new"), (None, 1, "n")]
    assert seen(store.read("chunks")) == sorted(left, key=repr)
    assert store.merge(vacuum=True) == 5 and store.merge() is None
    assert seen(store.read("chunks")) == sorted(left, key=repr) and len(store.segments()) == 1
    assert len(list((tmp_path / "s p" / "chunks").glob("segment=*"))) == 1
    store.commit({"chunks": rows(spark, (None, 2, "later"))})
    assert seen(store.read("chunks")) == sorted([("a", 7, "new"), (None, 2, "later")], key=repr)


def test_buckets_are_pruned(spark, store):
    store.commit({"chunks": rows(spark, *[(f"d{i}", i, "t") for i in range(40)])})
    plan = store.read("chunks", doc_ids=["d3"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert seen(store.read("chunks", doc_ids=["d3"])) == [("d3", 3, "t")] and seen(store.read("chunks", doc_ids=[])) == []


def test_a_run_that_dies_leaves_nothing(spark, store, monkeypatch):
    store.commit({"chunks": rows(spark, ("a", 1, "x")), "documents": rows(spark, ("a", 0, "title"))})
    whole = Store._write

    def dies(self, segment, table, *rest):
        if table == "documents":
            raise RuntimeError("killed")
        whole(self, segment, table, *rest)

    monkeypatch.setattr(Store, "_write", dies)
    with pytest.raises(RuntimeError):
        store.commit({"chunks": rows(spark, ("a", 2, "half")), "documents": rows(spark, ("a", 0, "new title"))})
    assert seen(store.read("chunks")) == [("a", 1, "x")] and seen(store.read("documents")) == [("a", 0, "title")] and store.last() == 1


def test_a_batch_counts_once(spark, store):
    assert store.commit({"chunks": rows(spark, ("a", 1, "x"))}, batch="s:0") == 1
    assert store.commit({"chunks": rows(spark, ("a", 1, "twice"))}, batch="s:0") is None
    assert store.change(lambda s: pytest.fail("made again"), batch="s:0") is None
    assert seen(store.read("chunks")) == [("a", 1, "x")]


def test_two_writers(spark, store):
    store.commit({"chunks": rows(spark, ("a", 0, ""))})
    gate = threading.Barrier(2)

    def append(letter):
        first = [True]

        def make(s):
            old = s.read("chunks").filter("doc_id = 'a'")
            made = spark.createDataFrame([(r["doc_id"], r["pos"], r["text"] + letter) for r in old.collect()], SCHEMA)
            if first:
                first.clear()
                gate.wait(60)
            return {"chunks": made}, None

        store.change(make)

    both = [threading.Thread(target=append, args=(x,)) for x in "pq"]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert store.last() == 3 and seen(store.read("chunks")) in ([("a", 0, "pq")], [("a", 0, "qp")])
    with pytest.raises(Conflict):
        store.commit({"chunks": rows(spark, ("a", 1, "x"))}, base=1)


def test_the_log_is_never_written_over(store, tmp_path):
    assert store._put(1, {"segment": "p", "tables": []}) and not store._put(1, {"segment": "q", "tables": []})
    [only] = (tmp_path / "s p" / "_log").iterdir()
    assert json.loads(only.read_text())["segment"] == "p"
