"""SimHash near duplicates with a byte-position inverted index and count filtering.

Fingerprints: the text's A-Z are lower-cased, words are runs of characters that
aren't white space, shingles are ``width`` words in a row, repeats included, joined
by one space (fewer words: the whole sequence). Each shingle's XXH64 (seed 42)
votes on 64 bits; a bit is 1 when over half of the hashes have it. A text without
words has fingerprint zero.

Links: two fingerprints link when at most ``max_bits`` (2) of 64 bits differ. Those
bits lie in at most 2 of 8 bytes, so linked fingerprints share 6 or more bytes at
the same positions: that is the guaranteed minimum of the count filter.

* Equal fingerprints are one node, pre-aggregated, so that copies cost nothing here.
* Postings: two nodes that share six of eight positions share ``k`` of any ``k + 2``.
  So the inverted index holds, for the first ``k + 2`` positions, every choice of
  ``k`` of them with its bytes; ``k`` is the least number of bytes, from ``LEAST_BYTES``
  on, with at least as many values as there are nodes, so that random nodes rarely meet. Nodes that meet in a
  posting of up to ``SHORT`` nodes are tallied over all eight positions; pairs with six
  or more shared bytes are verified bit by bit.
* Longer postings are split by further bytes, without loss: their nodes go into lists
  of all six positions that contain the posting's. Members of such a list differ in two
  bytes at most, so that it never has more than 65,536 nodes, whatever the input. In
  lists that are still longer than ``SHORT``, each node looks up the 136 values of the two
  free bytes that are one or two bits away, in an array of all 65,536; what is found is
  contracted to stars, without a row for each pair.

All ways are exact: ``links`` has fewer links than there are, but connects what they do.

Components: links are contracted in each task (a forest has fewer edges than nodes)
and again where they meet at their greater end; then each node takes the least of its
neighbours for all its neighbours, and edges contract again, until nothing changes.
Minimum and join back, no window, so that a star's centre isn't one task's work.

Documents that are alike, rather than nearly equal, are found by ``similar``.

Defined results: a null text counts as empty; repeated rows have the same result; a
null doc_id is never a component's id unless all of its documents have none; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import drop_keys, flag_members, free_name, key_bitmap, prepare, released, row_key, texts
from folioloom.session import release, staged

WIDTH = 3
MAX_BITS = 2
SHORT = 64
LEAST_BYTES = 3
SEED = 42

#: Hashes that are tallied at a time, so that a long text takes no more memory.
_BLOCK = 1 << 16


def _votes(text: str | None, width: int, digest, positions: int) -> int:
    """The majority of each bit over the shingles' digests of ``positions`` bytes; 0 without words."""
    import numpy as np

    global _TABLE
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    if _TABLE is None:
        _TABLE = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
    votes, n = np.zeros((positions, 256), np.int64), 0
    offsets = np.arange(positions, dtype=np.int64) * 256
    for block in _digests(words, width, digest):
        b = np.frombuffer(block, np.uint8).reshape(-1, positions)
        n += len(b)
        votes += np.bincount((b + offsets).ravel(), minlength=positions * 256).reshape(positions, 256)
    bits = (votes @ _TABLE).ravel()  # most significant bit first
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


_TABLE = None
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    import xxhash

    return _votes(text, width, lambda x: xxhash.xxh64_digest(x, SEED), 8)


def _digests(words: list[bytes], width: int, digest) -> Iterator[bytes]:
    """Digests of all shingles, in blocks."""
    count = max(1, len(words) - width + 1)
    for at in range(0, count, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        joined = b" ".join(part)
        ends = list(itertools.accumulate(len(w) + 1 for w in part))
        starts = [0, *ends]
        last = ends[width - 1 :] if len(part) >= width else ends[-1:]
        yield b"".join([digest(joined[i : j - 1]) for i, j in zip(starts, last, strict=False)])


def _fingerprints(batches):
    import pyarrow as pa

    for batch in released(batches):
        values = [fingerprint(t) for t in texts(batch.column(2))]
        signed = [v - (1 << 64) if v >> 63 else v for v in values]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed, pa.int64())], names=["doc_id", "key", "fp"])


def fingerprints(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row key and fingerprint (as a signed long) of each row."""
    prepare(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(_fingerprints, f"doc_id {kind}, key string, fp bigint")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


#: Positions that pairs must share, and the 28 choices of them.
_SHARED = 8 - MAX_BITS
_SIX = list(itertools.combinations(range(8), _SHARED))


def _mask(positions: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << (8 * p) for p in positions))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of a pair: positions at which both have the same byte."""
    x = a.bitwiseXOR(b)
    parts = [F.when(x.bitwiseAND(F.lit(_signed(0xFF << (8 * p)))) == 0, 1).otherwise(0) for p in range(8)]
    return sum(parts[1:], parts[0])


def _verified(lists: DataFrame) -> DataFrame:
    """(u, v) of the pairs of each list ``fps`` that reach the tally and are within ``MAX_BITS``."""
    member = lists.select(F.array_sort("fps").alias("fps")).select("fps", F.posexplode("fps").alias("i", "u"))
    met = member.select("u", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("v"))
    tallied = met.filter(shared_bytes(F.col("u"), F.col("v")) >= _SHARED)
    return tallied.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)


def links(spark: SparkSession, nodes: DataFrame, short: int = SHORT, level: int | None = None) -> DataFrame:
    """Links (u, v), u < v, over distinct fingerprints ``nodes`` (fp), which connect what is within two bits.

    ``level`` is the number of bytes of the first postings; by default it follows from the number of nodes.
    """
    if level is None:
        n = nodes.count()
        level = next((k for k in range(LEAST_BYTES, _SHARED) if 256**k >= n), _SHARED)
    chosen = list(itertools.combinations(range(level + MAX_BITS), level))
    entries = F.array(*[F.struct(F.lit(i).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for i, c in enumerate(chosen)])
    postings = nodes.select("fp", F.explode(entries).alias("e")).select("fp", "e.k", "e.bytes")
    shared = staged(spark, postings.groupBy("k", "bytes").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-postings")
    # postings that nothing else has are passed over before the shuffle
    maybe = flag_members(postings, [F.col("k"), F.col("bytes")], key_bitmap(shared, ["k", "bytes"], 24), 24, "_maybe")
    met = maybe.filter("_maybe").drop("_maybe").join(shared, ["k", "bytes"])
    few = met.filter(F.col("n") <= short).groupBy("k", "bytes").agg(F.collect_list("fp").alias("fps"))

    wider = F.array(*[F.array(*[F.lit(q).cast("byte") for q, six in enumerate(_SIX) if set(c) <= set(six)]) for c in chosen])
    masks = F.array(*[F.lit(_mask(six)) for six in _SIX])
    split = met.filter(F.col("n") > short).select("fp", F.explode(F.element_at(wider, F.col("k").cast("int") + 1)).alias("q"))
    six = split.withColumn("bytes", F.col("fp").bitwiseAND(F.element_at(masks, F.col("q").cast("int") + 1)))
    lists = staged(spark, six.groupBy("q", "bytes").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1), "simhash-lists")
    pairs = _verified(few.select("fps").unionByName(lists.filter(F.size("fps") <= short).select("fps")))

    # rows of a list follow one another, so that a task holds one list at a time
    rows = lists.filter(F.size("fps") > short).select("q", "bytes", F.explode("fps").alias("fp"))
    return pairs.unionByName(rows.mapInArrow(_dense, "u bigint, v bigint"))


#: The 136 ways to change one or two of 16 bits.
_NEAR = [1 << i for i in range(16)] + [1 << i | 1 << j for i in range(16) for j in range(i)]


def _stars(q: int, fps):
    """Stars that connect the fingerprints of one list that are within two bits: an array of all values of the two free bytes says who has which."""
    import numpy as np

    a, b = (p for p in range(8) if p not in _SIX[q])
    bits = fps.view(np.uint64)
    free = (bits >> np.uint64(8 * a) & np.uint64(255) | (bits >> np.uint64(8 * b) & np.uint64(255)) << np.uint64(8)).astype(np.int64)
    own, at = np.arange(len(fps)), np.full(1 << 16, -1)
    at[free] = own
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for mask in _NEAR:
        other = at[free ^ mask]
        met = other > own
        u, v = np.concatenate([u, own[met]]), np.concatenate([v, other[met]])
        if len(u) >= _EDGES:
            u, v = contracted(u, v)
    return contracted(fps[u], fps[v])


def _dense(batches):
    """Stars of lists (q, bytes, fp), whose rows are next to one another."""
    import numpy as np
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        q, six, fps = (batch.column(i).to_numpy() for i in range(3))
        cuts = [0, *(np.flatnonzero((q[1:] != q[:-1]) | (six[1:] != six[:-1])) + 1).tolist(), len(q)]
        done = []
        for lo, hi in itertools.pairwise(cuts):
            if lo == hi:
                continue
            now = (int(q[lo]), int(six[lo]))
            if held and now != key:
                done.append(_stars(key[0], np.concatenate(held)))
                held = []
            key = now
            held.append(fps[lo:hi])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*done, strict=True)], names=["u", "v"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _stars(key[0], np.concatenate(held))], names=["u", "v"])


#: Edges that are contracted at a time.
_EDGES = 1 << 20


def contracted(u, v):
    """Arrays (root, node) of the stars that connect what edges between arrays ``u`` and ``v`` do; root is the least node."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[below]], nodes[below]


def _contract(batches):
    import numpy as np
    import pyarrow as pa

    held, n = [], 0

    def joined():
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        return contracted(u, v)

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= _EDGES:
            held = [joined()]
            n = 0
    if held:
        u, v = joined()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node that has an edge (u, v); root is its component's least node."""
    prepare(spark)
    kind = "u bigint, v bigint"
    # tasks know many of a large group's nodes each; where these meet, one edge a node is left
    edges = staged(spark, edges.select("u", "v").mapInArrow(_contract, kind).repartition("v").mapInArrow(_contract, kind), "links")
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(least, "u").filter("v > u OR v <> m")
        moved = staged(spark, met.select(F.col("m").alias("u"), "v", F.expr("v < u OR m < u").alias("changed")), "stars")
        release(spark, edges)
        if not moved.agg(F.max("changed")).first()[0]:
            return moved.select(F.col("v").alias("node"), F.col("u").alias("root")).union(moved.select("u", "u")).distinct()
        edges = staged(spark, moved.select("u", "v").repartition("v").mapInArrow(_contract, kind), "links")
        release(spark, moved)
    raise RuntimeError("components did not settle")


def _named(spark: SparkSession, rows: DataFrame, nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``rows`` with ``first`` of their component: the least (doc_id is null, doc_id, key) of all that links lead to."""
    roots = components(spark, edges)
    linked = staged(spark, nodes.join(roots.withColumnRenamed("node", node), node), "simhash-linked")
    named = linked.groupBy("root").agg(F.min("first").alias("first"))
    new = linked.select(node, "root").join(named, "root").select(node, F.col("first").alias("new"))
    ids = nodes.select(node, "first").join(new, node, "left").select(node, F.coalesce("new", "first").alias("first"))
    return rows.join(ids, node)


_FIRST = "min(struct(doc_id IS NULL AS none, doc_id, key)) AS first"


def near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the least doc_id that links lead to), key, kept.

    ``kept`` is true for one document of each component: the one with the least doc_id,
    and of several texts with that doc_id, one. Rows that repeat both have equal results.
    """
    rows = staged(spark, fingerprints(spark, docs, doc_id, text), "simhash-rows")
    nodes = staged(spark, rows.groupBy("fp").agg(F.expr(_FIRST)), "simhash-nodes")
    named = _named(spark, rows, nodes, links(spark, nodes.select("fp")), "fp")
    return named.select("doc_id", "fp", F.col("first.doc_id").alias("component_id"), "key", (F.col("key") == F.col("first.key")).alias("kept"))


def _without(spark: SparkSession, docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    key = free_name(docs, "_key")
    gone = staged(spark, found.filter("NOT kept").select(F.col("key").alias(key)), "simhash-gone")
    return drop_keys(docs.withColumn(key, row_key(doc_id, text)), key, gone).drop(key)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component. Rows that repeat doc_id and text stay or go together."""
    return _without(spark, docs, near_duplicates(spark, docs, doc_id, text), doc_id, text)
