"""Alignment of two tokenizers over a corpus: which tokens cover the same bytes, and how often two ids do.

Each text is encoded by a byte-level BPE (A) and by a piece BPE with byte fallback (B), with one
space in front. Byte offsets where a token of both ends cut its tokens into groups. Two tokens
are linked when their byte ranges overlap, and a pair of ids counts as often as the whole
corpus links it.

* Texts are encoded once; ids are written to the shared folder, 2 bytes a token.
* Pair keys are packed into an int64, B's id above A's. Each task sums its keys by ``np.unique``
  and gives them out, partly summed, whenever it holds ``_HELD`` different ones: so a pair of
  ids that a third of all links share is one row a task, never a hot group.
* The partial counts are range-partitioned by key and sorted in each partition; equal keys
  are a run in one partition, whose counts are summed there. Each task writes its part as a
  sorted shard, keys and counts, under a name of its own attempt; a shard exists once its task's
  row does, so that lost executors and repeated attempts leave nothing wrong behind.
* The last pass maps the shards into memory and finds the keys of a batch by ``searchsorted``:
  pages are read as they are needed, nothing is broadcast but the first key of each shard and
  the best count of each of B's ids, 8 bytes each, at most as many as its vocabulary has.

Where ``spark.checkpoint.dir`` is no mounted folder (``file:`` or a plain path), shards can't be
mapped; then the counts are joined to each document's links by key (``lookup="join"``), with
the same result.

Defined results: texts that are null or empty, or that either tokenizer doesn't give back byte
for byte (the piece sign U+2581, say), have no tokens, zeros and empty groups; repeated rows are
documents of their own, and count in the corpus; doc_id may be null or repeated; other columns
aren't read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import input_partitions, prepare, released, texts
from folioloom.llm.packing import tokenizer
from folioloom.session import shared_dir, staged

VOCABULARY_A = "byte_bpe_50k.tiktoken"
VOCABULARY_B = "piece_bpe_32k.model"
#: Different keys that a task holds before it gives out their partial counts.
_HELD = 1 << 20
#: Tokens that are aligned at a time; a longer document is taken alone.
_TOKENS = 1 << 20
_SHIFT = 32

_PIECES: dict = {}


def pieces(vocabulary: str = VOCABULARY_B):
    """The piece tokenizer and the bytes of each of its ids."""
    import public_tokenizers
    import sentencepiece

    if vocabulary not in _PIECES:
        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in range(model.get_piece_size()) for p in (model.id_to_piece(i),)]
        _PIECES[vocabulary] = model, table
    return _PIECES[vocabulary]


def byte_tokens(vocabulary: str = VOCABULARY_A) -> list[bytes]:
    """The bytes of each of A's ids."""
    encoding = tokenizer(vocabulary)
    return [encoding.decode_single_token_bytes(i) for i in range(encoding.n_vocab)]


def _encoded(vocabulary_a: str, vocabulary_b: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        a, (b, table_b) = tokenizer(vocabulary_a), pieces(vocabulary_b)
        table_a, row = byte_tokens(vocabulary_a), TaskContext.get().partitionId() << 40
        kinds = [_kind(len(table_a)), _kind(len(table_b))]
        for batch in released(batches):
            out: list[list[bytes]] = [[], []]
            for text in texts(batch.column(1)):
                whole = " " + text if text else ""
                body = whole.encode()
                ids = [a.encode_ordinary(whole), b.encode(text)] if text else [[], []]
                same = all(b"".join(map(t.__getitem__, x)) == body for x, t in zip(ids, (table_a, table_b), strict=True))
                for column, x, kind in zip(out, ids, kinds, strict=True):
                    column.append(np.array(x if same else [], kind).tobytes())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column(0), *[pa.array(x, pa.binary()) for x in out]], names=["row", "doc_id", "a", "b"])
            row += n

    return run


def _kind(ids: int) -> str:
    return "<u2" if ids <= 1 << 16 else "<u4"


def encode(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """row (unique once it is written), doc_id, a and b: the ids of each text, little-endian, of 2 bytes where the vocabulary allows."""
    prepare(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(_encoded(vocabulary_a, vocabulary_b), f"row bigint, doc_id {kind}, a binary, b binary")


class Aligned:
    """The links and groups of some documents' tokens, as arrays over all of them."""

    def __init__(self, a, b, width_a, width_b, counts_a, counts_b):
        import numpy as np

        self.a, self.b = a, b
        # no document's bytes differ between A and B, so that offsets over all documents do as well
        end_a, end_b = np.cumsum(width_a[a], dtype=np.int64), np.cumsum(width_b[b], dtype=np.int64)
        of_a, of_b = (np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool) for _ in range(2))  # whether a token ends at a byte
        of_a[end_a], of_b[end_b] = True, True
        self.common_a, self.common_b = of_b[end_a], of_a[end_b]
        ends = np.flatnonzero(of_a | of_b)  # between two ends next to each other lies one link
        last_a, last_b = of_a[ends], of_b[ends]
        self.of_a, self.of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        self.keys = (b[self.of_b].astype(np.int64) << _SHIFT) | a[self.of_a].astype(np.int64)
        self.start_a, self.start_b = (np.concatenate([[0], np.cumsum(c)]) for c in (counts_a, counts_b))
        self.doc = np.repeat(np.arange(len(counts_a)), counts_a)[self.of_a]  # of each link
        self.docs = len(counts_a)

    def sums(self, values):
        """Per document, the sum of a value of each link."""
        import numpy as np

        ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        cuts = np.searchsorted(self.doc, np.arange(self.docs + 1))
        return ends[cuts[1:]] - ends[cuts[:-1]]

    def groups(self):
        """Per document, how many groups it has."""
        import numpy as np

        ends = np.concatenate([[0], np.cumsum(self.common_a, dtype=np.int64)])
        return ends[self.start_a[1:]] - ends[self.start_a[:-1]]

    def written(self, names_a, names_b) -> list[str]:
        """Per document, its groups as ``a1,a2|b1;a3|b2,b3``; ``names_*``: pairs of arrays of the ids' decimals, with the sign after an id inside a group and after its last."""
        import numpy as np

        last_a, last_b = np.flatnonzero(self.common_a), np.flatnonzero(self.common_b)  # of each group
        group_a, group_b = np.cumsum(self.common_a) - self.common_a, np.cumsum(self.common_b) - self.common_b
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + np.concatenate([[0], last_b + 1])[group_a]] = np.where(self.common_a, names_a[1][self.a], names_a[0][self.a])
        out[np.arange(len(self.b)) + (last_a + 1)[group_b]] = np.where(self.common_b, names_b[1][self.b], names_b[0][self.b])
        at = self.start_a + self.start_b
        return ["".join(out[lo:hi].tolist())[:-1] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _parts(batch):
    """(start, length, A's counts, B's counts) of runs of rows of at most ``_TOKENS`` tokens, or of one row; columns 2 and 3 hold the ids."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = [pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)]
    ends = np.cumsum(sizes[0] + sizes[1])
    start, base = 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, base + 2 * _TOKENS, "right")))
        yield start, end - start, sizes[0][start:end], sizes[1][start:end]
        start, base = end, int(ends[end - 1])


def _aligned(batch, widths):
    """(slice of the batch, ``Aligned``) for each of its parts."""
    import numpy as np

    kinds = [_kind(len(w)) for w in widths]
    for start, count, *sizes in _parts(batch):
        part = batch.slice(start, count)
        ids = [np.frombuffer(b"".join(part.column(i).to_pylist()), k) for i, k in zip((2, 3), kinds, strict=True)]
        yield part, Aligned(*ids, *widths, *[s // np.dtype(k).itemsize for s, k in zip(sizes, kinds, strict=True)])


def _widths(vocabulary_a: str, vocabulary_b: str):
    import numpy as np

    return tuple(np.array([len(x) for x in t], np.int64) for t in (byte_tokens(vocabulary_a), pieces(vocabulary_b)[1]))


def _partial(vocabulary_a: str, vocabulary_b: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        widths, held, n = _widths(vocabulary_a, vocabulary_b), [], 0

        def summed():
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at = np.unique(keys, return_inverse=True)
            total = np.zeros(len(u), np.int64)
            np.add.at(total, at, counts)
            return u, total

        def given(u, counts):
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(counts)], names=["key", "n"])

        for batch in released(batches):
            for _, found in _aligned(batch, widths):
                u, counts = np.unique(found.keys, return_counts=True)
                held.append((u, counts))
                n += len(u)
                if n >= 2 * _HELD:
                    u, counts = summed()
                    held, n = [(u, counts)], len(u)
                    if n >= _HELD:
                        yield given(u, counts)
                        held, n = [], 0
        if held:
            yield given(*summed())

    return run


def partial_counts(spark: SparkSession, tokens: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """(key, n) of all links of ``tokens`` (what ``encode`` gives), summed in each task; a key has a few rows a task at most."""
    prepare(spark)
    return tokens.select("row", "doc_id", "a", "b").mapInArrow(_partial(vocabulary_a, vocabulary_b), "key bigint, n bigint")


def _shards(folder: str, ids_b: int):
    """Sums runs of a sorted partition, writes them as a shard and gives its row, and one row for each of B's ids with the best count it has here."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        path = f"{folder}/{uuid.uuid4().hex}"
        best = np.zeros(ids_b, np.int64)
        first, last, written = None, (None, 0), 0
        os.makedirs(folder, exist_ok=True)
        with open(f"{path}.keys", "wb") as to_keys, open(f"{path}.counts", "wb") as to_counts:

            def put(keys, counts):
                keys.astype("<i8").tofile(to_keys)
                counts.astype("<i8").tofile(to_counts)
                np.maximum.at(best, keys >> _SHIFT, counts)

            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                keys, n = keys[cuts], np.add.reduceat(n, cuts)
                if last[0] is not None and keys[0] == last[0]:
                    n[0] += last[1]
                elif last[0] is not None:
                    put(np.array([last[0]]), np.array([last[1]]))
                    written += 1
                first = int(keys[0]) if first is None else first
                put(keys[:-1], n[:-1])
                written += len(keys) - 1
                last = int(keys[-1]), int(n[-1])
            if last[0] is not None:
                put(np.array([last[0]]), np.array([last[1]]))
                written += 1
        if not written:
            os.remove(f"{path}.keys")
            os.remove(f"{path}.counts")
            return
        ids = np.flatnonzero(best)
        gaps = [None] * len(ids)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path, *gaps], pa.string()), pa.array([written, *gaps], pa.int64()), pa.array([first, *gaps], pa.int64()), pa.array([None, *ids.tolist()], pa.int64()), pa.array([None, *best[ids].tolist()], pa.int64())],
            names=["path", "keys", "first", "id", "best"],
        )

    return run


def local_folder(spark: SparkSession) -> str | None:
    """The shared folder as a path that every machine has mounted; None where it isn't one."""
    at = urlsplit(shared_dir(spark))
    return unquote(at.path) if at.scheme in ("", "file") else None


class Index:
    """Sorted count shards, and the best count of each of B's ids."""

    def __init__(self, shards: list[tuple[int, str, int]], best):
        import numpy as np

        self.shards = sorted(shards)  # first key, path, number of keys
        self.firsts = np.array([s[0] for s in self.shards], np.int64)
        self.best = best
        self.open: dict = {}

    def counts(self, keys):
        """The counts of ``keys``, all of which the corpus has."""
        import numpy as np

        out = np.empty(len(keys), np.int64)
        where = np.searchsorted(self.firsts, keys, "right") - 1
        for s in np.unique(where).tolist():
            if s not in self.open:
                _, path, n = self.shards[s]
                self.open[s] = tuple(np.memmap(f"{path}.{x}", "<i8", "r", shape=(n,)) for x in ("keys", "counts"))
            own = where == s
            sorted_keys, counts = self.open[s]
            out[own] = counts[np.searchsorted(sorted_keys, keys[own])]
        return out


def build_index(spark: SparkSession, partial: DataFrame, folder: str, vocabulary_b: str = VOCABULARY_B) -> Index:
    """Shards of the sums of ``partial`` (key, n) in a mounted folder. The driver gets one row a shard, and one for each of B's ids."""
    import numpy as np

    ids_b = len(pieces(vocabulary_b)[1])
    ranged = partial.repartitionByRange(input_partitions(spark), "key").sortWithinPartitions("key")
    made = staged(spark, ranged.mapInArrow(_shards(f"{folder}/folioloom/pairs-{uuid.uuid4().hex}", ids_b), "path string, keys bigint, first bigint, id bigint, best bigint"), "pair-shards")
    best = np.zeros(ids_b, np.int64)
    for r in made.filter("id IS NOT NULL").groupBy("id").agg(F.max("best").alias("best")).collect():
        best[r["id"]] = r["best"]
    return Index([(r["first"], r["path"], r["keys"]) for r in made.filter("path IS NOT NULL").select("path", "keys", "first").collect()], best)


def _measured(vocabulary_a: str, vocabulary_b: str, shards, best):
    """Rows of what each document's alignment is; with shards, the counts of its links too."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        widths = _widths(vocabulary_a, vocabulary_b)
        names = [tuple(np.array([f"{i}{sign}" for i in range(len(w))], object) for sign in signs) for w, signs in zip(widths, (",|", ",;"), strict=True)]
        index = None if shards is None else Index(shards, best)
        for batch in released(batches):
            for part, found in _aligned(batch, widths):
                columns = [np.diff(found.start_a), np.diff(found.start_b), found.groups(), found.sums(np.ones(len(found.keys), np.int64))]
                if index is not None:
                    u, at = np.unique(found.keys, return_inverse=True)
                    counts = index.counts(u)
                    columns += [found.sums((counts == index.best[u >> _SHIFT])[at]), found.sums(counts[at])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(c.astype(np.int64)) for c in columns], pa.array(found.written(*names), pa.string())],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", *(["n_best", "count_sum"] if index is not None else []), "groups"],
                )

    return run


def _document_keys(vocabulary_a: str, vocabulary_b: str):
    """(row, key, n) of the different keys of each document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        widths = _widths(vocabulary_a, vocabulary_b)
        for batch in released(batches):
            for part, found in _aligned(batch, widths):
                order = np.lexsort((found.keys, found.doc))
                doc, keys = found.doc[order], found.keys[order]
                cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([cuts, [len(keys)]]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[cuts])), pa.array(keys[cuts]), pa.array(n.astype(np.int64))], names=["row", "key", "n"])

    return run


def align(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, lookup: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups.

    ``count_sum`` adds up, over the document's links, how often the corpus links their pair of ids; ``n_best``
    says for how many of them no other pair with that id of B counts more. ``lookup``: ``shards`` or
    ``join``; by default shards where the shared folder is mounted.
    """
    tokens = staged(spark, encode(spark, docs, doc_id, text, vocabulary_a, vocabulary_b), "crosstoken-ids")
    partial = staged(spark, partial_counts(spark, tokens, vocabulary_a, vocabulary_b), "crosstoken-partial")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    folder = local_folder(spark)
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    if lookup == "shards" or (lookup is None and folder is not None):
        index = build_index(spark, partial, folder, vocabulary_b)
        return tokens.mapInArrow(_measured(vocabulary_a, vocabulary_b, index.shards, index.best), schema + "n_best bigint, count_sum bigint, groups string").select(*out)
    counts = staged(spark, partial.groupBy("key").agg(F.sum("n").alias("count")), "crosstoken-counts")
    best = counts.groupBy(F.shiftright("key", _SHIFT).alias("id")).agg(F.max("count").alias("best"))  # a row for each of B's ids
    marked = counts.join(F.broadcast(best), F.shiftright("key", _SHIFT) == F.col("id")).select("key", "count", (F.col("count") == F.col("best")).alias("is_best"))
    own = tokens.mapInArrow(_document_keys(vocabulary_a, vocabulary_b), "row bigint, key bigint, n bigint").join(marked, "key")
    sums = own.groupBy("row").agg(F.sum(F.when(F.col("is_best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    measured = tokens.mapInArrow(_measured(vocabulary_a, vocabulary_b, None, None), schema + "groups string")
    return measured.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}).select(*out)
