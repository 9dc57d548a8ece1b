"""Properties on random documents: packing, restitching, fusion and renumbering against plain loops."""

from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioloom.operators import blocks as bl
from folioloom.operators import chunking as ch

_SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def greedy(tokens, most, held):
    out, g, used = [], 0, 0
    for t in tokens:
        if held and used + t > most:
            g, used = g + 1, 0
        used += t
        held = True
        out.append(g)
    return out


@_SLOW
@given(st.lists(st.tuples(st.lists(st.integers(1, 120), max_size=12), st.booleans()), min_size=1, max_size=200))
def test_packing_equals_the_loop(spark, cases):
    df = spark.createDataFrame([(i, t, h) for i, (t, h) in enumerate(cases)], "i int, t array<int>, h boolean")
    got = {r["i"]: r["g"] for r in df.select("i", ch.group_starts(F.col("t"), 80, F.col("h")).alias("g")).collect()}
    # how many rows each group has, group 0 even where it is empty
    sizes = lambda starts, n: [b - a for a, b in zip(starts, [*starts[1:], n], strict=True)]
    groups = {i: greedy(t, 80, h) for i, (t, h) in enumerate(cases)}
    assert {i: sizes(g, len(cases[i][0])) for i, g in got.items()} == {i: [g.count(k) for k in range(max(g, default=0) + 1)] for i, g in groups.items()}


def stitched(rows):
    """The sequential rule: merge into the text so far where the last row and this one allow it."""
    out = []
    for i, (page, order, kind, text) in enumerate(rows):
        before = rows[i - 1] if i else None
        joins = before is not None and kind == before[2] == "paragraph" and page == before[0] + 1 and order == 0 and before[3].strip() and before[3].rstrip()[-1] not in ".!?\"')]" and text.lstrip()[:1].islower()
        if joins:
            out[-1].append(i)
        else:
            out.append([i])
    return out


@_SLOW
@given(st.integers(0, 10**6))
def test_restitching_equals_the_loop(spark, seed):
    r = random.Random(seed)
    docs = {}
    for d in range(60):
        rows, page, order = [], 1, 0
        for _ in range(r.randint(1, 12)):
            rows.append((page, order, r.choice(["paragraph"] * 4 + ["heading"]), r.choice(["ends here.", "goes on", "Upper start", " lower (x)", "été", "and so ", '"quoted"'])))
            page, order = (page, order + 1) if r.random() < 0.4 else (page + r.choice([1, 1, 1, 2]), 0)
        docs[f"d{d:02}"] = rows
    df = spark.createDataFrame([(d, f"{i:03}", *row) for d, rows in docs.items() for i, row in enumerate(rows)], "doc_id string, block_id string, page_num_1 int, reading_order int, block_type string, text string")
    got: dict[str, list] = {d: [] for d in docs}
    for x in bl.restitch(df).orderBy("doc_id", "pos").collect():
        got[x["doc_id"]].append([int(b) for b in x["block_ids"]])
    assert got == {d: stitched(rows) for d, rows in docs.items()}
