"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into ``n_slots`` virtual slots, a number that never changes, by
doc_id and checksum of the text. Bytes are summed per slot (pre-aggregated, at most
``n_slots`` rows), and a stored map gives each slot a shard. Version 0 of the map is slot
modulo shards. Rebalancing loads the last version, edits it and stores the next:
shards above the mean give up slots, and those go to the lightest shards; everything
else stays where it was. Each version is kept; a map that needs no move gets none.

Rows that repeat doc_id and text more often than a slot has rows on average would make
one slot heavy. Those keys (at most ``n_slots``, so that they can be broadcast) are
hashed with their row's number too, which spreads them over all slots: equal rows are
interchangeable.

The driver sees one row per slot, a bound that doesn't depend on the input. Only
doc_id, size, checksum and slot are shuffled, never the text.

Defined results: a null text has 16 bytes; null doc_ids hash like any value;
repeated rows are rows of their own and get slots of their own; an empty table
gives an empty result and a map that is still whole; other columns don't matter.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm.common import text_or_empty
from folioloom.session import shared_dir, staged

N_SLOTS = 8192
N_SHARDS = 40
OVERHEAD = 16


#: A key must have this many rows to be spread.
REPEATS = 100


def slotted(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """``records`` (doc_id, size, text_crc32, row) with their ``virtual_slot``."""
    total = records.count()
    key = F.xxhash64("doc_id", "text_crc32")
    heavy = records.groupBy(key.alias("_key")).agg(F.count("*").alias("_n")).filter(F.col("_n") > max(REPEATS, total // n_slots)).select("_key", F.col("_n").isNotNull().alias("_heavy"))
    known = records.withColumn("_key", key).join(F.broadcast(heavy), "_key", "left")  # fewer than n_slots rows: each has more than a slot's share
    slot = F.pmod(F.when(F.col("_heavy"), F.xxhash64("_key", "row")).otherwise(F.col("_key")), F.lit(n_slots)).cast("int")
    return known.withColumn("virtual_slot", slot).drop("_key", "_heavy")


def slot_bytes(records: DataFrame, n_slots: int = N_SLOTS) -> list[int]:
    """Bytes per virtual slot of ``records`` (columns virtual_slot, size): ``n_slots`` numbers."""
    out = [0] * n_slots
    for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("b")).collect():
        out[r["virtual_slot"]] = r["b"]
    return out


def initial_map(n_slots: int, n_shards: int) -> list[int]:
    return [s % n_shards for s in range(n_slots)]


def rebalance(old: list[int], weights: list[int], n_shards: int, tolerance: float = 0.0) -> list[int]:
    """A new map with nearly equal bytes, made by moving slots out of heavy shards.

    A shard above the mean gives up what it has too much, in the largest slots that aren't
    more than that; they go, largest first, to the shard that is then lightest. Last, single
    slots go from the heaviest to the lightest shard, or change places, while that narrows
    the gap. Shards within ``tolerance`` of the mean are left as they are, so that a greater
    one moves fewer bytes.
    """
    new = list(old)
    mean = sum(weights) / n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    loads, loose = [0] * n_shards, []
    for slot, shard in enumerate(new):
        if shard < n_shards:
            held[shard].append(slot)
            loads[shard] += weights[slot]
        else:
            loose.append(slot)
    for shard in range(n_shards):
        if loads[shard] <= mean * (1 + tolerance):
            continue
        for slot in sorted(held[shard], key=lambda s: (-weights[s], s)):
            if weights[slot] and loads[shard] - weights[slot] >= mean:
                loads[shard] -= weights[slot]
                held[shard].remove(slot)
                loose.append(slot)
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda s: (-weights[s], s)):
        load, shard = heapq.heappop(heap)
        new[slot] = shard
        held[shard].append(slot)
        loads[shard] = load + weights[slot]
        heapq.heappush(heap, (loads[shard], shard))
    for _ in range(8 * n_shards):
        low, high = min(range(n_shards), key=lambda s: (loads[s], s)), max(range(n_shards), key=lambda s: (loads[s], -s))
        gap = loads[high] - loads[low]
        if gap <= tolerance * mean:
            break
        below = sorted([0, *(weights[s] for s in held[low])])
        best = None
        for a in held[high]:
            want = weights[a] - gap / 2
            at = min(range(len(below)), key=lambda i: abs(below[i] - want)) if len(below) < 8 else _nearest(below, want)
            moved = weights[a] - below[at]
            if 0 < moved < gap and (best is None or abs(gap / 2 - moved) < best[0]):
                best = (abs(gap / 2 - moved), a, below[at], moved)
        if best is None:
            break
        _, a, size, moved = best
        b = next((s for s in held[low] if weights[s] == size), None) if size else None
        held[high].remove(a)
        held[low].append(a)
        new[a] = low
        if b is not None:
            held[low].remove(b)
            held[high].append(b)
            new[b] = high
        loads[high] -= moved
        loads[low] += moved
    return new


def _nearest(ordered: list[int], want: float) -> int:
    from bisect import bisect_left

    i = bisect_left(ordered, want)
    near = [j for j in (i - 1, i) if 0 <= j < len(ordered)]
    return min(near, key=lambda j: abs(ordered[j] - want))


def write_map(spark: SparkSession, path: str, version: int, shards: list[int]) -> None:
    """Store one version of a map in the folder ``path``; versions are never written over."""
    rows = spark.createDataFrame([(s, shard) for s, shard in enumerate(shards)], "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a stored map: rows (version, virtual_slot, shard)."""
    return spark.read.schema("virtual_slot int, shard int, version int").parquet(path).select("version", "virtual_slot", "shard")


def latest_map(slot_map: DataFrame) -> tuple[int, list[int]]:
    """The last version's number and its shard of each slot."""
    version = slot_map.agg(F.max("version")).first()[0]
    rows = slot_map.filter(F.col("version") == version).collect()  # n_slots rows
    return version, [r["shard"] for r in sorted(rows, key=lambda r: r["virtual_slot"])]


def shard(spark: SparkSession, docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, doc_id: str = "doc_id", text: str = "text", map_path: str | None = None, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Assigned rows (doc_id, size, text_crc32, virtual_slot, shard, slot) and the map with all its versions.

    ``map_path`` is the folder of a stored map, whose last version is edited where bytes
    aren't balanced within ``tolerance`` or shards were added; where it is None, a map is begun in the shared
    folder. ``slot`` counts from 0 in each shard without a gap: the shard's virtual slots
    one after the other, ordered by doc_id within each.
    """
    t = F.encode(text_or_empty(text), "UTF-8")
    records = staged(
        spark,
        docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.monotonically_increasing_id().alias("row")),
        "shard-records",
    )
    if map_path is None:
        map_path = f"{shared_dir(spark)}/folioloom/shard-map-{uuid.uuid4().hex}"
        write_map(spark, map_path, 0, initial_map(n_slots, n_shards))
    version, old = latest_map(read_map(spark, map_path))
    if len(old) != n_slots:
        raise ValueError(f"the stored map has {len(old)} slots; their number can't change")
    placed = slotted(records, n_slots)
    new = rebalance(old, slot_bytes(placed, n_slots), n_shards, tolerance)
    if new != old:
        version += 1
        write_map(spark, map_path, version, new)
    slot_map = read_map(spark, map_path)
    current = slot_map.filter(F.col("version") == version).drop("version")
    counts = placed.groupBy("virtual_slot").agg(F.count("*").alias("_n"))
    in_shard = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = current.join(counts, "virtual_slot", "left").withColumn("_start", F.coalesce(F.sum("_n").over(in_shard), F.lit(0))).select("virtual_slot", "shard", "_start")
    in_slot = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "row")
    numbered = placed.withColumn("_at", F.row_number().over(in_slot) - 1)
    assigned = numbered.join(F.broadcast(starts), "virtual_slot")  # one row a slot: n_slots rows of 16 bytes
    return assigned.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot")), slot_map
