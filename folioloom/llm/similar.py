"""Documents that are alike: SimHash candidates of a byte-position index, then an exact join of what they leave apart; all verified exactly.

Two documents link when the sets of their shingles (``WIDTH`` words, A-Z lower-cased, as XXH64) have a Jaccard similarity of
``SIMILARITY`` or more. A component of links is a group.

* Fingerprints: each shingle of the set votes on 256 bits, 32 positions of a byte. Equal fingerprints are one node.
* Index: a list for each choice of ``k`` positions and its bytes. ``k`` is two bytes, and one more whenever lists of unrelated nodes
  would be longer than a thousand; how many choices there are follows from ``k``, so that a pair at the threshold
  shares one of them with the chance ``CHANCE``. Both grow with the number of nodes; recall doesn't fall with it.
* Count filtering: pairs of a list are tallied over all 256 bits, ``most_bits`` of which may differ: three standard deviations above the mean at
  the threshold, so that the filter costs next to no link. It keeps some pairs that aren't alike; they cost a comparison.
* Lists of up to ``SHORT`` nodes are compared pair by pair. In longer ones, which are near groups, each node takes its ``BEST`` nearest
  and the node nearest to the list's majority (the text that others are edits of, where it is there), and windows of
  ``_WINDOW`` nodes follow one another where a list is longer still. Of all lists, each node keeps its ``BEST`` nearest and one centre. So the
  candidates are at most five a node, however large a group; each of a group of up to five is compared with all others.
* Verification: the shingle sets of candidates alone are made, and compared exactly. No link is below the threshold.

Nothing of that grows with the square of a group: a member that is alike to any of its nearest, or to the centre, joins. Links that these candidates miss
are found by an exact join over what is still in different components:

* Neighbours: each shingle of a set and the next greater hash (after the greatest, the least) are a key, ``n`` keys a set. A member that one set alone has
  parts one pair of neighbours of what both have, so that sets with ``o`` common ones of ``n`` and ``m`` have ``3 o - n - m`` common keys at least. Long texts that
  have a few shingles in common by chance rarely have two that are neighbours in both, so that pairs don't grow with chance.
* Prefixes: keys are ordered by frequency, then hash. Two sets of ``SIMILARITY`` or more share one of the first ``n - ceil((2 SIMILARITY - 1) n) + 1``
  of each, and ``l`` of the first ones if ``l - 1`` more are taken (``SPARE`` of the set). Any order does for that, so that the ``FREQUENT`` most frequent
  shingles of a sample of texts come last and all others count alike.
* Rarest first: these prefixes are listed by key, which tells how many sets have each in theirs; keys of one set alone are done with. Since two prefixes
  share ``l`` keys, they share one besides the ``l - 1`` most frequent of each, by that exact number; those are left out. So a text that has a part of its
  keys in common with others by chance has no list at all, and lists are of texts most of whose keys others have.
* A list of each key that is left; its pairs of different components, if their sizes allow the similarity,
  and if no more of their parities differ than their sets may (the parities of two sets differ at most as often as their members; there are
  two for each member, or more). Pairs of one component are never made, so that a large group of copies costs a row a member and key.
* What is left is verified as above. No link between different texts is lost, whatever the first step found. A list is held whole (40 bytes a member, and its parities).

Defined results: a null text counts as empty; texts without words are one node; repeated rows have the same result; a null doc_id is never a
component's id unless all of its documents have none; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.llm.common import drop_keys, flag_members, free_name, input_partitions, key_bitmap, prepare, released, row_key, texts
from folioloom.llm.simhash import _FIRST, _LOWER, SEED, _digests, _named, components
from folioloom.session import staged

WIDTH = 5
SIMILARITY = 0.8
CHANCE = 0.97
SHORT = 64
BEST = 4
_LONGS = ["f0", "f1", "f2", "f3"]
_POSITIONS = 32
_WINDOW = 4096
#: Mean length of a list of unrelated nodes above which keys get another byte.
_MEAN = 1024
#: Texts whose shingles are counted, and shingles that are known as frequent, 16 bytes each.
_COUNTED = 16_384
FREQUENT = 65_536
#: Keys that a prefix has beyond those it needs, as a share of its set's; as many, the most frequent ones, are left out of lists.
SPARE = 0.1
#: Pairs that are made at a time.
_PAIRS = 1 << 20
#: Rows that are compared at a time, and candidates that are held before they are reduced.
_ROWS = 1 << 16
_HELD = 1 << 21


# -- shingles and fingerprints -------------------------------------------------------------


def shingle_set(text: str | None, width: int = WIDTH):
    """The different shingles of a text as sorted 64-bit hashes; none without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(np.frombuffer(b"".join(_digests(words, width, lambda x: xxhash.xxh64_digest(x, SEED))), "<u8"))


def _mixed(h):
    """64-bit integers whose bits depend on all of ``h``'s (the finaliser of SplitMix64)."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _bits():
    import numpy as np

    return ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(shingles):
    """Four 64-bit integers: the majority of each of 256 bits over a set of shingles; zeros for none."""
    import numpy as np

    if not len(shingles):
        return np.zeros(4, np.uint64)
    votes, offsets = np.zeros((_POSITIONS, 256), np.int64), np.arange(_POSITIONS, dtype=np.int64) * 256
    for at in range(0, len(shingles), _ROWS):
        h = shingles[at : at + _ROWS]
        b = np.stack([_mixed(h + np.uint64(0x9E3779B97F4A7C15 * (s + 1) % 2**64)) for s in range(4)], axis=1).view(np.uint8)
        votes += np.bincount((b + offsets).ravel(), minlength=_POSITIONS * 256).reshape(_POSITIONS, 256)
    return np.packbits(2 * (votes @ _bits()).ravel() > len(shingles)).view("<u8")


def node_of(longs):
    """A node's number by its fingerprint (rows of four)."""
    import numpy as np

    out = np.zeros(len(longs), np.uint64)
    for i in range(4):
        out = _mixed(out ^ longs[:, i])
    return out.view(np.int64)


def most_bits(similarity: float) -> int:
    """Differing bits of 256 at ``similarity``: sets of equal size have cosine 2s/(1+s), and bits differ with chance acos/pi; three standard deviations above the mean."""
    share = _differ(similarity)
    return int(256 * share + 3 * (256 * share * (1 - share)) ** 0.5)


def _differ(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def key_bytes(nodes: int) -> int:
    """Bytes of a key, so that lists of unrelated nodes have at most about ``_MEAN``."""
    return next((k for k in (2, 3, 4) if nodes <= _MEAN * 256**k), 5)


def choices(k: int, similarity: float = SIMILARITY, chance: float = CHANCE) -> list[tuple[int, ...]]:
    """Choices of ``k`` positions, as many as a pair at ``similarity`` shares one of with ``chance``; positions occur about equally often."""
    same, ways = (1 - _differ(similarity)) ** 8, math.comb(_POSITIONS, k)
    shared = [math.comb(_POSITIONS, s) * same**s * (1 - same) ** (_POSITIONS - s) for s in range(_POSITIONS + 1)]
    count = 1
    while count < ways and sum(p * (1 - math.comb(s, k) / ways) ** count for s, p in enumerate(shared)) > 1 - chance:
        count += 1
    draw, out = random.Random(1), {}
    while len(out) < count:
        order = list(range(_POSITIONS))
        draw.shuffle(order)
        out |= {tuple(sorted(order[i : i + k])): None for i in range(0, _POSITIONS - k + 1, k)}
    return list(out)[:count]


def kind_of(shingles) -> int:
    """A set's number, equal for equal sets alone (64 bits)."""
    import numpy as np

    return int(node_of(np.array([[len(shingles), shingles.sum(), np.bitwise_xor.reduce(shingles), _mixed(shingles).sum()]], np.uint64))[0]) if len(shingles) else 0


def parities(shingles):
    """64-bit integers: whether the set has an odd number of members in each of at least two classes a member (a power of two, 256 or more).
    Of twice as many classes, the two halves differ where half as many are odd."""
    import numpy as np

    classes = max(256, 1 << (2 * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1).view("<u8")


def parities_apart(a: Column, b: Column) -> Column:
    """In how many classes parities differ; null where one has over twice as many as the other."""
    xor = lambda x, y: x.bitwiseXOR(y)
    halved = lambda x, y: F.when(F.size(x) > F.size(y), F.zip_with(F.slice(x, 1, F.size(y)), F.slice(x, F.size(y) + 1, F.size(x)), xor)).otherwise(x)
    return F.aggregate(F.zip_with(halved(a, b), halved(b, a), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda n, x: n + x)


def neighbours(similarity: float = SIMILARITY) -> bool:
    """Whether a key is two shingles; below, sets need not have enough of these in common."""
    return similarity > 0.6


def least_keys(n, m, similarity: float = SIMILARITY):
    """Common keys that sets of ``n`` and ``m`` have at least, if they are as similar as that."""
    import numpy as np

    both = np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    return 3 * both - n - m if neighbours(similarity) else both


def _share(similarity: float) -> float:
    """The share of its keys that a set has in common at least with any set as similar as that."""
    return 2 * similarity - 1 if neighbours(similarity) else similarity


def prefix_size(n, similarity: float = SIMILARITY):
    """First keys of a set of ``n``, one of which any set as similar as that has among its own first ones."""
    import numpy as np

    return n - np.ceil(_share(similarity) * n - 1e-9).astype(np.int64) + 1


def spare_keys(n, similarity: float = SIMILARITY):
    """Keys that a set of ``n`` lists beyond ``prefix_size``; of a set as similar as that, one more than these are among the keys that it lists.
    What neither lists is a share of each, rounded down, so that it doesn't fall with ``n``: sets of different sizes may each leave out their own number."""
    import numpy as np

    return n - np.floor(max(0.0, _share(similarity) - SPARE) * n + 1e-9).astype(np.int64) - prefix_size(n, similarity)


def prefix(shingles, frequent, similarity: float = SIMILARITY, spare: int = 0):
    """The first keys in order of frequency, then hash, and ``spare`` more. ``frequent``: sorted hashes, and how frequent each is; others come first."""
    import numpy as np

    if not len(shingles):
        return shingles
    hashes, counts = frequent
    rank = np.zeros(len(shingles), np.int64)
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, shingles), len(hashes) - 1)
        rank = np.where(hashes[at] == shingles, counts[at], 0)
    if neighbours(similarity):  # which are as frequent as the rarer of both, at most
        rank = np.minimum(rank, np.roll(rank, -1))
        shingles = _mixed(shingles + _mixed(np.roll(shingles, -1)))
    size, known = int(prefix_size(np.int64(len(shingles)), similarity)) + spare, rank > 0
    first = np.sort(shingles[~known])[:size]
    if len(first) == size:
        return first
    shingles, rank = shingles[known], rank[known]
    return np.concatenate([first, shingles[np.lexsort((shingles, rank))[: size - len(first)]]])


def _members(batches):
    """Rows (h): the shingles of texts, each once a text."""
    import numpy as np
    import pyarrow as pa

    for batch in released(batches):
        for at in range(0, batch.num_rows, 100):
            found = [shingle_set(t) for t in texts(batch.column(0).slice(at, 100))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])


def frequent_shingles(spark: SparkSession, docs: DataFrame, text: str = "text", counted: int = _COUNTED, most: int = FREQUENT):
    """Sorted hashes of the most frequent shingles of a sample of texts, and their counts: an order, no filter."""
    import numpy as np

    drawn = F.pmod(F.xxhash64(F.col(text)), F.lit(max(1, docs.count() // counted)))
    found = docs.filter(drawn == 0).select(F.col(text).alias("text")).mapInArrow(_members, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    top = found.filter("n > 1").orderBy(F.desc("n"), "h").limit(most).collect()  # bounded
    hashes, counts = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _fingerprinted(frequent, similarity: float):
    """Rows of a text's fingerprint, its set's number, size, parities and prefix, and how many keys of that are to spare."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "key", "node", *_LONGS, "kind", "n", "odd", "prefix", "spare"]
        for batch in released(batches):
            made = []
            for t in texts(batch.column(2)):
                own = shingle_set(t)
                spare = int(spare_keys(np.int64(len(own)), similarity)) if len(own) else 0
                first = prefix(own, frequent.value, similarity, spare)
                made.append((fingerprint(own), kind_of(own), len(own), parities(own).view(np.int64), first.view(np.int64), spare))
            prints, kinds, sizes, odd, firsts, spares = zip(*made, strict=True) if made else ((),) * 6
            longs = np.array(prints, np.uint64).reshape(-1, 4)
            columns = [pa.array(node_of(longs)), *[pa.array(longs[:, i].copy().view(np.int64)) for i in range(4)], pa.array(kinds, pa.int64()), pa.array(sizes, pa.int32()), pa.array(list(odd), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(list(firsts), pa.list_(pa.int64())), pa.array(spares, pa.int32())], names=names)

    return run


# -- candidates ----------------------------------------------------------------------------


def _posted(chosen: list[tuple[int, ...]]):
    """Rows (list, f0 to f3): a node in each of its lists."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at, k = np.array(chosen), len(chosen[0])
        for batch in batches:
            longs = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            bytes_ = longs.view(np.uint8).astype(np.int64)
            keys = np.repeat(np.arange(len(chosen), dtype=np.int64)[None], len(longs), axis=0)
            for i in range(k):
                keys = (keys << 8) | bytes_[:, at[:, i]]
            take = np.repeat(np.arange(len(longs)), len(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(longs[take, i]) for i in range(4)]], names=["list", *_LONGS])

    return run


_EDGE = [("u", "<i8"), ("v", "<i8"), ("bits", "<i2"), ("centre", "i1")]


def _edges(u, v, bits, centre: int):
    import numpy as np

    out = np.empty(len(u), _EDGE)
    out["u"], out["v"], out["bits"], out["centre"] = u, v, bits, centre
    return out


def best_edges(edges, best: int = BEST):
    """Of each ``u``, its ``best`` nearest and its nearest centre, each ``v`` once of either kind."""
    import numpy as np

    edges = edges[np.lexsort((edges["v"], edges["bits"], edges["centre"], edges["u"]))]
    new = np.ones(len(edges), bool)
    new[1:] = (edges["u"][1:] != edges["u"][:-1]) | (edges["v"][1:] != edges["v"][:-1]) | (edges["centre"][1:] != edges["centre"][:-1])
    edges = edges[new]  # a pair always has the same number of bits, so that its repeats are next to one another
    starts = np.flatnonzero(np.concatenate([[True], (edges["u"][1:] != edges["u"][:-1]) | (edges["centre"][1:] != edges["centre"][:-1])])) if len(edges) else np.zeros(0, np.int64)
    rank = np.arange(len(edges)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(edges)]])))
    return edges[rank < np.where(edges["centre"] == 1, 1, best)]


def _apart(a, b):
    """Differing bits of rows of two arrays of four longs."""
    import numpy as np

    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _short_lists(lists, longs, limit: int):
    """Both directions of all pairs of each list within the limit; rows of a list are next to one another."""
    import numpy as np

    start = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    left = np.repeat(np.concatenate([start[1:], [len(lists)]]), np.diff(np.concatenate([start, [len(lists)]]))) - np.arange(len(lists)) - 1  # rows of the list after each
    out = []
    for d in range(1, int(left.max(initial=0)) + 1):
        i = np.flatnonzero(left >= d)
        bits = _apart(longs[i], longs[i + d])
        near = bits <= limit
        i, bits = i[near], bits[near]
        if len(i):
            u, v = node_of(longs[i]), node_of(longs[i + d])
            out += [_edges(u, v, bits, 0), _edges(v, u, bits, 0)]
    return out


def _centre_of(longs):
    """The member nearest to the majority of each bit."""
    import numpy as np

    bits = np.unpackbits(longs.view(np.uint8).reshape(len(longs), -1), axis=1)
    majority = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(longs)).view("<u8")
    return longs[int(np.argmin(_apart(longs, majority[None])))]


def _long_list(longs, limit: int, centre, best: int = BEST):
    """Each member's nearest within the limit, and its way to the centre."""
    import numpy as np

    nodes, out = node_of(longs), []
    for at in range(0, len(longs), 256):
        own = longs[at : at + 256]
        bits = np.zeros((len(own), len(longs)), np.int16)
        for i in range(4):
            bits += np.bitwise_count(own[:, i, None] ^ longs[None, :, i])
        bits[np.arange(len(own)), at + np.arange(len(own))] = 999
        near = np.argpartition(bits, min(best, len(longs) - 1), axis=1)[:, :best]
        row, col = np.nonzero(np.take_along_axis(bits, near, 1) <= limit)
        to = near[row, col]
        out.append(_edges(nodes[at + row], nodes[to], bits[row, to], 0))
    middle = int(node_of(centre[None])[0])
    bits = _apart(longs, centre[None])
    near = (bits <= limit) & (nodes != middle)
    out.append(_edges(nodes[near], np.full(int(near.sum()), middle), bits[near], 1))
    return out


def _compared(limit: int, short: int, best: int, parts: int):
    """Rows (part, edges): the best edges of a task's lists, whose rows are next to one another, packed by a hash of their first node."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []
        count = 0
        lists, longs = np.zeros(0, np.int64), np.zeros((0, 4), np.uint64)
        centre = None  # of a list that goes on

        def done(upto: int):
            """Compare the first ``upto`` rows, which are whole lists but for a window's."""
            nonlocal centre
            start = np.flatnonzero(np.concatenate([[True], lists[1:upto] != lists[: upto - 1]]))
            sizes = np.diff(np.concatenate([start, [upto]]))
            small = np.repeat(sizes <= short, sizes)
            if centre is not None:
                small[: sizes[0]] = False
            found = _short_lists(lists[:upto][small], longs[:upto][small], limit)
            for s, n in zip(start.tolist(), sizes.tolist(), strict=True):
                if not small[s]:
                    own = longs[s : s + n]
                    middle = centre if centre is not None and s == 0 else _centre_of(own)
                    found += [e for w in range(0, max(1, n - _WINDOW // 2), _WINDOW // 2) for e in _long_list(own[w : w + _WINDOW], limit, middle, best)]
            return found

        def add(found):
            nonlocal held, count
            held += found
            count += sum(map(len, found))
            if count >= _HELD:
                held = [best_edges(np.concatenate(held), best)]
                count = len(held[0])

        for batch in batches:
            lists = np.concatenate([lists, batch.column(0).to_numpy()])
            longs = np.concatenate([longs, np.stack([batch.column(i).to_numpy() for i in range(1, 5)], axis=1).view(np.uint64)])
            if len(lists) < _ROWS:
                continue
            last = int(np.searchsorted(lists, lists[-1])) if lists[0] <= lists[-1] else 0
            if last:  # all lists but the last, which may go on
                add(done(last))
                lists, longs, centre = lists[last:], longs[last:], None
            else:  # one list: its windows, and what the next one begins with
                if centre is None:
                    centre = _centre_of(longs)
                add(done(len(lists)))
                lists, longs = lists[-_WINDOW // 2 :], longs[-_WINDOW // 2 :]
        if len(lists):
            add(done(len(lists)))
        if held:
            edges = best_edges(np.concatenate(held), best)
            part = (_mixed(edges["u"].copy().view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            edges, part = edges[order], part[order]
            names, starts = np.unique(part, return_index=True)
            ends = np.concatenate([starts[1:], [len(part)]])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([edges[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["part", "edges"])

    return run


def _merged(best: int):
    """(u, v) of the best edges of all tasks' packed ones."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, count = [], 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                held.append(np.frombuffer(x, _EDGE))
                count += len(held[-1])
                if count >= _HELD:
                    held = [best_edges(np.concatenate(held), best)]
                    count = len(held[0])
        if held:
            edges = best_edges(np.concatenate(held), best)
            yield pa.RecordBatch.from_arrays([pa.array(edges["u"].copy()), pa.array(edges["v"].copy())], names=["u", "v"])

    return run


def candidates(spark: SparkSession, nodes: DataFrame, similarity: float = SIMILARITY, short: int = SHORT, best: int = BEST, k: int | None = None) -> DataFrame:
    """Pairs (u, v), u < v, of ``nodes`` (node, f0 to f3) to be verified; at most ``best`` + 1 a node."""
    prepare(spark)
    chosen, parts = choices(key_bytes(nodes.count()) if k is None else k, similarity), input_partitions(spark)
    posted = nodes.select(*_LONGS).mapInArrow(_posted(chosen), "list bigint, " + ", ".join(f"{f} bigint" for f in _LONGS))
    together = posted.repartition(parts, "list").sortWithinPartitions("list", *_LONGS)
    packed = together.mapInArrow(_compared(most_bits(similarity), short, best, parts), "part int, edges binary")
    edges = packed.repartition(parts, "part").select("edges").mapInArrow(_merged(best), "u bigint, v bigint")
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


# -- the exact join ------------------------------------------------------------------------


def _arrays(lists):
    """Rows of a column of lists as arrays, None for null."""
    import numpy as np

    out = np.full(len(lists), None, object)
    if lists.null_count == len(lists):
        return out
    for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
        out[i] = lists[i].values.to_numpy()
    return out


def _near(odd, n, similarity: float):
    """Whether rows ``i`` and ``j`` (arrays) may be as similar by their parities; true where a row has none."""
    import numpy as np

    width = np.array([0 if x is None else len(x) for x in odd])
    tables: dict = {}

    def table(w):
        """Places and parities of rows of ``w`` numbers; those of twice as many are halved."""
        if w not in tables:
            rows = np.flatnonzero((width == w) | (width == 2 * w))
            at = np.zeros(len(odd), np.int64)
            at[rows] = np.arange(len(rows))
            tables[w] = at, np.array([odd[r] if width[r] == w else odd[r][:w] ^ odd[r][w:] for r in rows.tolist()], np.int64).view(np.uint64)
        return tables[w]

    def near(i, j):
        may, least, most = np.ones(len(i), bool), np.minimum(width[i], width[j]), np.maximum(width[i], width[j])
        for w in np.unique(least[least > 0]).tolist():
            at, bits = table(w)
            some = np.flatnonzero((least == w) & (most <= 2 * w))
            step = max(1, _PAIRS // w)
            for k in range(0, len(some), step):
                own = some[k : k + step]
                a, b = i[own], j[own]
                apart = np.bitwise_count(bits[at[a]] ^ bits[at[b]]).sum(axis=1, dtype=np.int64)
                may[own] = apart <= (1 - similarity) / (1 + similarity) * (n[a] + n[b]) + 1e-9
        return may

    return near


def _shared(batches):
    """Rows (h, kind, times): keys that several sets list, by each of these, and how many they are; rows (h, kind) of a key are next to one another, and so are those of a set."""
    import numpy as np
    import pyarrow as pa

    def given(h, kind):
        new = np.concatenate([[True], h[1:] != h[:-1]])
        one = new | np.concatenate([[True], kind[1:] != kind[:-1]])
        h, kind, starts = h[one], kind[one], np.flatnonzero(new[one])
        times = np.diff(np.append(starts, len(h)))
        times = np.repeat(times, times)
        some = times > 1
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(kind[some]), pa.array(times[some])], names=["h", "kind", "times"])

    parts, rows = [], 0
    for batch in batches:
        parts.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows < _ROWS:
            continue
        h, kind = (np.concatenate(c) for c in zip(*parts, strict=True))
        last = int(np.flatnonzero(h == h[-1])[0])  # where the last list, which may go on, begins
        if last:
            yield given(h[:last], kind[:last])
        parts, rows = [[h[last:], kind[last:]]], 0
    if parts:
        yield given(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def _across(similarity: float):
    """Rows (u, v), u < v: pairs of a list whose components differ and that may be as similar as that; rows (h, comp, kind, n, pos, and parities where they are
    given) of a list are next to one another, and so are those of a component."""

    def pairs(h, comp, kind, n, pos, odd=None):
        import numpy as np

        near = _near(odd, n, similarity) if odd is not None and any(x is not None for x in odd) else None

        ends = lambda new: np.append(np.flatnonzero(new)[1:], len(h))[np.cumsum(new) - 1]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        own = ends(new | np.concatenate([[True], comp[1:] != comp[:-1]]))  # where others of the list begin
        count = ends(new) - own
        sums = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(h) and sums[at] < sums[-1]:
            to = max(at + 1, int(np.searchsorted(sums, sums[at] + _PAIRS, "right")) - 1)
            some = np.arange(at, to)
            i = np.repeat(some, count[some])
            j = own[i] + np.arange(len(i)) - np.repeat(sums[some] - sums[at], count[some])
            smaller, larger = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            left = np.minimum(n[i] - pos[i], n[j] - pos[j])  # keys from the shared one on
            may = (smaller >= similarity * larger - 1e-9) & (left >= least_keys(n[i], n[j], similarity))
            i, j = i[may], j[may]
            if near and len(i):
                may = near(i, j)
                i, j = i[may], j[may]
            u, v = kind[i], kind[j]
            if len(u):
                yield np.minimum(u, v), np.maximum(u, v)
            at = to

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, parts, rows = None, [], 0

        def given(u, v):
            both = np.unique(np.stack([u, v], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])

        def found(upto):
            for u, v in pairs(*[c[:upto] for c in held]):
                yield given(u, v)

        for batch in batches:
            parts.append([c.to_numpy().astype(np.int64) for c in batch.columns[:5]] + [_arrays(c) for c in batch.columns[5:]])
            rows += batch.num_rows
            if rows < _ROWS:
                continue
            held = [np.concatenate(c) for c in zip(*parts, strict=True)]
            last = int(np.flatnonzero(held[0] == held[0][-1])[0])  # where the last list, which may go on, begins
            yield from found(last)
            parts, rows = [[c[last:] for c in held]], 0
        if parts:
            held = [np.concatenate(c) for c in zip(*parts, strict=True)]
            yield from found(len(held[0]))

    return run


def missed(spark: SparkSession, docs: DataFrame, rows: DataFrame, links: DataFrame, doc_id: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) of nodes whose components under ``links`` differ: all that there are, verified. ``rows``: as ``_fingerprinted`` makes them."""
    roots = components(spark, links)
    parts = input_partitions(spark)
    kinds = staged(spark, rows.groupBy("kind", "node", "n", "spare").agg(F.expr(_FIRST), F.any_value("odd").alias("odd")), "similar-kinds")
    keys = rows.select(F.explode("prefix").alias("h"), "kind").repartition(parts, "h").sortWithinPartitions("h", "kind")
    shared = staged(spark, keys.mapInArrow(_shared, "h bigint, kind bigint, times bigint"), "similar-shared")
    # a set's keys are at most as many as its words
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("times"), F.desc("h")))
    rarest = shared.join(kinds.select("kind", "spare"), "kind").withColumn("place", place).filter("place > spare").select("h", "kind")
    comps = kinds.join(roots, "node", "left").select("kind", F.coalesce("root", "node").alias("comp"), "n", "odd")
    lists = rarest.join(comps, "kind").select("h", "comp", "kind", "n", F.lit(0).alias("pos"), "odd")
    together = lists.repartition(parts, "h").sortWithinPartitions("h", "comp")
    pairs = staged(spark, together.mapInArrow(_across(similarity), "u bigint, v bigint").distinct(), "similar-across")
    side = lambda c: kinds.select(F.col("kind").alias(c), F.col("n").alias(f"_n{c}"), F.col("odd").alias(f"_odd{c}"))
    may = parities_apart(F.col("_oddu"), F.col("_oddv")) <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("_nu") + F.col("_nv")) + 1e-9
    likely = staged(spark, pairs.join(side("u"), "u").join(side("v"), "v").filter(may).select("u", "v"), "similar-likely")
    found = verified(spark, docs, kinds.select(F.col("kind").alias("node"), "first"), likely, doc_id, text, similarity)
    node = lambda c: kinds.select(F.col("kind").alias(c), F.col("node").alias(f"_{c}"))
    return found.join(node("u"), "u").join(node("v"), "v").select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct()


# -- verification --------------------------------------------------------------------------


def _sets(batches):
    import pyarrow as pa

    for batch in released(batches):
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            found = [shingle_set(t).view("<i8") for t in texts(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "shingles"])


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def verified(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, doc_id: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (u, v) of ``nodes`` (node, first) whose shingle sets are as similar as that. Texts of candidates alone are shingled, and none is shuffled."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = staged(spark, nodes.select("node", F.col("first.key").alias("key")).join(needed, "node", "left_semi"), "similar-wanted")
    chosen = flag_members(docs.select(row_key(doc_id, text).alias("key"), F.col(text).alias("text")), [F.col("key")], key_bitmap(wanted, ["key"], 24), 24, "_maybe")
    made = chosen.filter("_maybe").select("key", "text").mapInArrow(_sets, "key string, shingles array<bigint>")
    sets = staged(spark, made.join(wanted, "key").groupBy("node").agg(F.any_value("shingles").alias("shingles")), "similar-sets")
    one, other = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"_{n}")) for n in "uv")
    sizes = F.least(F.size("_u"), F.size("_v")) >= F.lit(similarity) * F.greatest(F.size("_u"), F.size("_v"))
    return pairs.join(one, "u").join(other, "v").filter(sizes & (jaccard(F.col("_u"), F.col("_v")) >= similarity)).select("u", "v")


# -- groups --------------------------------------------------------------------------------


def similar_documents(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, short: int = SHORT, best: int = BEST, k: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (the least doc_id that links lead to), key, kept.

    ``kept`` is true for one document of each component: the one with the least doc_id, and of several texts with that doc_id, one.
    """
    prepare(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(spark, docs, text))
    longs = lambda names: ", ".join(f"{f} bigint" for f in names)
    made = chosen.mapInArrow(_fingerprinted(frequent, similarity), f"doc_id {kind}, key string, node bigint, {longs(_LONGS)}, kind bigint, n int, odd array<bigint>, prefix array<bigint>, spare int")
    rows = staged(spark, made, "similar-rows")
    frequent.destroy()
    nodes = staged(spark, rows.groupBy("node", *_LONGS).agg(F.expr(_FIRST)), "similar-nodes")
    pairs = staged(spark, candidates(spark, nodes, similarity, short, best, k), "similar-pairs")
    links = staged(spark, verified(spark, docs, nodes, pairs, doc_id, text, similarity), "similar-links")
    links = staged(spark, links.union(missed(spark, docs, rows, links, doc_id, text, similarity)), "similar-all-links")
    named = _named(spark, rows.select("doc_id", "key", "node"), nodes, links, "node")
    return named.select("doc_id", F.col("first.doc_id").alias("component_id"), "key", (F.col("key") == F.col("first.key")).alias("kept"))


def drop_similar_documents(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of similar ones. Rows that repeat doc_id and text stay or go together."""
    key = free_name(docs, "_key")
    found = similar_documents(spark, docs, doc_id, text, similarity)
    gone = staged(spark, found.filter("NOT kept").select(F.col("key").alias(key)), "similar-gone")
    return drop_keys(docs.withColumn(key, row_key(doc_id, text)), key, gone).drop(key)
