"""Scores of whole documents by a gated recurrent language model, and by word counts.

Tokens: A-Z are lower-cased, words are runs of characters that aren't white space, and one end follows a text.

* Counts: every task counts the words of its documents and gives out partial counts whenever it holds
  ``_HELD`` different words; they are summed by word. So they cover all training documents, and a word that is
  everywhere is a few rows a task. ``base_score`` is the log10 likelihood under these counts, smoothed by 0.1.
* The shortlist: the words whose counts are highest, as many as fit into ``SHORTLIST`` bytes, are broadcast with
  their counts (found by a histogram of the counts' logarithms, without a sort). All other words of a document are
  looked up by a join, already tallied by document; no count is ever approximated.
* The model: a gated recurrent unit in numpy over the most frequent words (``WORDS``), an end and a class of all
  other words. The output is factored: the chance of a class of words, then of the word in it, classes being
  ranges of words of equal mass of the roots of their counts; biases begin at the counts' logarithms. A word outside
  the vocabulary has the chance of their class, times its own smoothed share of their counts.
* Training: truncated backpropagation over windows of ``WINDOW`` tokens, ``STREAMS`` streams at a time (fewer where a task has little text, so that
  its weights are moved ``UPDATES`` times at least), whose state is carried from window to window and is new at a document's start. In each of ``ROUNDS`` rounds every task
  starts from the same weights and passes once over its part of the round's documents; the weights, each task's by its number of
  tokens, are averaged in the cluster, in blocks, and the driver gets one model. Every training document takes part in
  one round, chosen by a hash, so that the rounds are one pass over all of them; counts, vocabulary, classes and
  biases come from all, too. ``share`` above 1 trains on one in so many documents.
* Scoring: all documents, whole. Documents are stepped side by side, longest first, and each one's state is carried from its
  first word to its end, whatever the windows.

Defined results: a null text counts as empty, whose one token is the end; without training documents N and V are 0, and
every word is unknown; repeated rows count, and are scored, as often as they occur; doc_id may be null or repeated;
other columns aren't read; an empty table gives an empty result. Reruns on equal partitions give equal scores.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.vectors import one_thread
from folioloom.llm.common import input_partitions, prepare, released, texts
from folioloom.session import staged

WORDS = 4096
CLASSES = 64
EMBEDDED = 24
HIDDEN = 24
STREAMS = 256
WINDOW = 16
UPDATES = 64
ROUNDS = 3
SHARE = 1
RATE = 0.006
SMOOTHING = 0.1
#: Bytes of the shortlist, 16 a word besides its own, and the longest word in it.
SHORTLIST = 4 << 20
LONGEST = 1024
END, RARE = 0, 1

_HELD = 1 << 19
#: Tokens that are trained on, and scored, at a time (a longer document is taken alone), and hidden states that wait for the output layer.
_TRAINED = 1 << 20
_SCORED = 1 << 21
_WAITING = 1 << 16
#: Weights of one row while models are averaged.
_BLOCK = 1024
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def _counted(batches):
    import pyarrow as pa

    def given(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for batch in released(batches):
        for text in texts(batch.column(0)):
            held.update(words_of(text))
            held[b""] += 1  # the end
            if len(held) >= _HELD:
                yield given(held)
                held.clear()
    if held:
        yield given(held)


def word_counts(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all documents, as bytes; the end is the empty word."""
    prepare(spark)
    return docs.select(F.col(text).alias("text")).mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _bin(n: Column) -> Column:
    """A count's place on a scale of 64 steps a doubling."""
    return F.floor(F.log2(n) * 64).cast("int")


def _listed(least: int) -> Column:
    return (F.octet_length("word") == 0) | ((F.octet_length("word") <= LONGEST) & (_bin(F.col("n")) >= least))


def shortlist(counts: DataFrame, room: int = SHORTLIST) -> tuple[int, list[tuple[bytes, int]]]:
    """The least bin that is listed, and (word, n) of the listed words, highest counts first: ``room`` bytes at most."""
    bins = counts.filter((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST)).groupBy(_bin(F.col("n")).alias("bin")).agg(F.sum(F.octet_length("word") + 16).alias("size"))
    least, size = 1 << 30, 0
    for r in sorted(bins.collect(), reverse=True):  # 64 rows a doubling
        size += r["size"]
        if size > room:
            break
        least = r["bin"]
    listed = [(bytes(r["word"]), r["n"]) for r in counts.filter(_listed(least)).collect()]
    return least, sorted(listed, key=lambda x: (-x[1], x[0]))


def class_cuts(counts: list[int], classes: int = CLASSES) -> list[int]:
    """Where classes of words begin and end: the end and the rare words alone, the others in ranges of about equal sums of roots."""
    total, cuts, mass = sum(math.sqrt(c) for c in counts[2:]), [0, 1, 2], 0.0
    for i, c in enumerate(counts[2:], 2):
        mass += math.sqrt(c)
        if mass >= total * (len(cuts) - 2) / classes and i + 1 < len(counts):
            cuts.append(i + 1)
    return [*cuts, len(counts)] if cuts[-1] < len(counts) else cuts


class Model:
    """Weights as views of one vector, the losses of windows with their gradients, and scores of documents."""

    def __init__(self, counts: list[int], embedded: int = EMBEDDED, hidden: int = HIDDEN, classes: int = CLASSES, dtype: str = "f4"):
        import numpy as np

        self.counts, self.dtype = counts, np.dtype(dtype)
        self.cuts = np.array(class_cuts(counts, classes))
        n, k = len(counts), len(self.cuts) - 1
        self.of = np.repeat(np.arange(k), np.diff(self.cuts))
        self.shapes = {"E": (n, embedded), "W": (embedded, 3 * hidden), "b": (3 * hidden,), "U": (hidden, 3 * hidden), "C": (hidden, k), "c": (k,), "O": (n, hidden), "o": (n,)}
        self.hidden = hidden
        self.size = sum(math.prod(s) for s in self.shapes.values())
        draw = np.random.default_rng(1)
        self.load((draw.standard_normal(self.size) * 0.1).astype(self.dtype))
        own = np.maximum(np.array(counts, float), SMOOTHING)
        mass = np.add.reduceat(own, self.cuts[:-1])
        self.c[:], self.o[:], self.b[:] = np.log(mass / mass.sum()), np.log(own / mass[self.of]), 0

    def views(self, vector) -> dict:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = vector[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def load(self, vector) -> Model:
        self.vector = vector
        for name, view in self.views(vector).items():
            setattr(self, name, view)
        return self

    def step(self, x, h):
        """(new state, update gate, reset gate, candidate, the state's part of the candidate) of one token; ``x`` is its part of the gates."""
        import numpy as np

        n, g = self.hidden, h @ self.U
        gates = x[:, : 2 * n] + g[:, : 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        z, r, part = gates[:, :n], gates[:, n:], g[:, 2 * n :]
        new = r * part
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        after = h - new
        after *= z
        after += new
        return after, z, r, new, part

    def output(self, states, targets, gradient=None):
        """Natural log likelihood of each target after its state. ``gradient``: views to which the gradient of minus the mean is added; then also that of the states."""
        import numpy as np

        m = len(targets)
        out, back = np.empty(m, self.dtype), np.zeros_like(states) if gradient else None
        every, ones = np.arange(m), np.ones(max(m, len(self.counts)), self.dtype)  # sums of rows and columns as products

        def softmax(logits, at):
            rows = every[: len(at)]
            if not -60 < logits.min() <= logits.max() < 60:  # else no exponential is too large or small
                logits -= logits.max(axis=1, keepdims=True)
            own = logits[rows, at]
            np.exp(logits, out=logits)
            total = logits @ ones[: logits.shape[1]]
            if gradient:
                logits *= (1 / (total * m))[:, None]
                logits[rows, at] -= self.dtype.type(1 / m)
            return own - np.log(total)

        kind = self.of[targets].astype(np.int16)  # of which a stable sort is by digits
        logits = states @ self.C + self.c
        out[:] = softmax(logits, kind)
        if gradient:
            gradient["C"] += states.T @ logits
            gradient["c"] += ones[:m] @ logits
            back += logits @ self.C.T
        order = np.argsort(kind, kind="stable")
        ends = np.searchsorted(kind[order], np.arange(len(self.cuts))).tolist()
        # rows of a class are slices of these
        states, targets, inside = states[order], targets[order], np.zeros(m, self.dtype)
        slope = np.zeros_like(states) if gradient else None
        for k, (lo, hi) in enumerate(itertools.pairwise(self.cuts.tolist())):
            own = slice(ends[k], ends[k + 1])
            if hi - lo == 1 or ends[k] == ends[k + 1]:
                continue
            h = states[own]
            logits = h @ self.O[lo:hi].T + self.o[lo:hi]
            inside[own] = softmax(logits, targets[own] - lo)
            if gradient:
                gradient["O"][lo:hi] += logits.T @ h
                gradient["o"][lo:hi] += ones[: len(h)] @ logits
                slope[own] = logits @ self.O[lo:hi]
        out[order] += inside
        if gradient:
            back[order] += slope
        return out, back

    def window(self, x, y, h, gradient=None):
        """(sum of the targets' log likelihoods, state after the window) of tokens ``x`` [time, stream] and the ones after them, ``y``."""
        import numpy as np

        steps, streams = x.shape
        gates = self.E[x] @ self.W + self.b
        kept, states = [], np.empty((steps, streams, self.hidden), self.dtype)
        for t in range(steps):
            go_on = (x[t] != END).astype(self.dtype)[:, None]  # after an end the state is new
            before = h * go_on
            h, *parts = self.step(gates[t], before)
            states[t] = h
            kept.append((before, go_on, *parts))
        found, back = self.output(states.reshape(-1, self.hidden), y.ravel(), gradient)
        if gradient is None:
            return float(found.sum()), h
        n, later = self.hidden, 0
        back = back.reshape(states.shape)
        befores, go_ons, z, r, new, part = (np.stack(v) for v in zip(*kept, strict=True))
        # what a state's slope is multiplied by, of all steps at once; a step has but its own slope to find
        rest = 1 - z
        by_new = rest * (1 - new * new)
        factors = np.empty((steps, streams, 3, n), self.dtype)
        factors[:, :, 0] = rest * (befores - new) * z
        factors[:, :, 2] = by_new * r
        factors[:, :, 1] = factors[:, :, 2] * part * (1 - r)
        turned = np.ascontiguousarray(self.U.T)
        for t in range(steps - 1, -1, -1):
            d = back[t]
            d += later
            factors[t] *= d[:, None]
            later = factors[t].reshape(streams, 3 * n) @ turned
            later += d * z[t]
            later *= go_ons[t]
        flat, ids = factors.reshape(-1, 3 * n), x.ravel()
        gradient["U"] += befores.reshape(-1, n).T @ flat
        factors[:, :, 2] = back * by_new  # the candidate's slope as its word sees it, before the reset gate
        gradient["b"] += flat.sum(axis=0)
        gradient["W"] += self.E[ids].T @ flat
        order = np.argsort(ids.astype(np.uint16) if len(self.counts) <= 1 << 16 else ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        gradient["E"][ids[order[first]]] += np.add.reduceat((flat @ self.W.T)[order], first)
        return float(found.sum()), h

    def train(self, stream, adam, streams: int = STREAMS, window: int = WINDOW, rate: float = RATE) -> None:
        """One pass over a stream of tokens, cut into ``streams`` that go side by side; ``adam``: running moments, which this changes."""
        import numpy as np

        streams = max(1, min(streams, len(stream) // (window * UPDATES)))
        length = -(-len(stream) // streams)
        rows = np.full((streams, length), END)  # the last stream is filled with ends
        rows.ravel()[: len(stream)] = stream
        x, y = np.concatenate([np.full((1, streams), END), rows.T[:-1]]), rows.T
        h = np.zeros((streams, self.hidden), self.dtype)
        slope = np.zeros_like(self.vector)
        views = self.views(slope)
        for at in range(0, length, window):
            slope[:] = 0
            _, h = self.window(x[at : at + window], y[at : at + window], h, views)
            adam.update(self.vector, slope, rate)

    def scores(self, docs: list):
        """The natural log likelihood of each document, an array of ids that ends with the end."""
        import numpy as np

        out = np.zeros(len(docs))
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        lengths = np.array([len(docs[i]) for i in order])
        flat = np.concatenate([docs[i] for i in order]) if docs else np.zeros(0, np.int32)
        starts = np.cumsum(lengths) - lengths
        table = self.E @ self.W + self.b  # each word's part of the gates
        h, before = np.zeros((len(docs), self.hidden), self.dtype), np.full(len(docs), END)
        held: list = []
        waiting = 0

        def settle():
            states, targets, whose = (np.concatenate(v) for v in zip(*held, strict=True))
            found, _ = self.output(states, targets)
            out[:] += np.bincount(whose, found, minlength=len(docs))
            held.clear()

        # documents that go on at step t are the first ones, since the longest come first
        going = len(docs) - np.searchsorted(lengths[::-1], np.arange(int(lengths.max(initial=0))), "right")
        for t, k in enumerate(going.tolist()):
            h = self.step(table[before[:k]], h[:k])[0]
            before = flat[starts[:k] + t]
            held.append((h, before, np.arange(k)))
            waiting += k
            if waiting >= _WAITING:
                settle()
                waiting = 0
        if held:
            settle()
        result = np.empty(len(docs))
        result[order] = out
        return result


class Adam:
    """Running means of slopes and of their squares."""

    def __init__(self, size: int, dtype="f4"):
        import numpy as np

        self.m, self.v, self.t = np.zeros(size, dtype), np.zeros(size, dtype), 0

    def update(self, vector, slope, rate: float) -> None:
        import numpy as np

        self.t += 1
        scale = rate * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        for at in range(0, len(vector), 8192):  # so that a part stays in the cache
            part = slice(at, at + 8192)
            g, m, v = slope[part], self.m[part], self.v[part]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            vector[part] -= scale * m / (np.sqrt(v) + 1e-8)


class Vocabulary:
    """The shortlist as workers use it: places and counts of its words, and each one's id in the model."""

    def __init__(self, listed: list[tuple[bytes, int]], total: int, kinds: int, words: int = WORDS):
        import numpy as np

        plain = [x for x in listed if x[0]]
        self.words = b" ".join(w for w, _ in plain)
        self.counts = np.array([n for _, n in plain], np.int64)
        ends = sum(n for w, n in listed if not w)
        known = self.counts[: max(0, words - 2)].tolist()
        #: All training tokens and different ones; the same of words outside the model.
        self.total, self.kinds = total, kinds
        self.rare_total, self.rare_kinds = total - ends - sum(known), kinds - len(known) - (1 if ends else 0)
        self.model_counts = [ends, self.rare_total, *known]

    def base(self, n):
        """log10 of the smoothed share of all tokens."""
        import numpy as np

        return np.log10((n + SMOOTHING) / (self.total + SMOOTHING * (self.kinds + 1)))

    def rare(self, n):
        """log10 of the smoothed share of the tokens outside the model."""
        import numpy as np

        return np.log10((n + SMOOTHING) / (self.rare_total + SMOOTHING * (self.rare_kinds + 1)))

    def places(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.split(b" "))} if self.words else {}


def _ids(places, size: int):
    """An array of a text's places in the shortlist, -1 for others, and of its ids in a model of ``size`` ids, the end included."""
    import numpy as np

    def of(words):
        at = np.fromiter(map(places.get, words, itertools.repeat(-1)), np.int32, len(words))
        ids = np.where((at >= 0) & (at < size - 2), at + 2, RARE).astype(np.int32)
        return at, np.concatenate([ids, np.array([END], np.int32)])

    return of


def _sampled(vocabulary):
    def run(batches):
        import pyarrow as pa

        v = vocabulary.value
        of = _ids(v.places(), len(v.model_counts))
        for batch in released(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([of(words_of(t))[1].tobytes() for t in texts(batch.column(1))], pa.binary())], names=["round", "ids"])

    return run


def _trained(weights, counts: list[int], sizes: tuple):
    """Rows (block, tokens, weights) of the model that a task's documents make of the round's first weights."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        one_thread()
        model, seen = Model(counts, *sizes), 0
        model.load(np.frombuffer(weights.value, model.dtype).copy())
        adam = Adam(model.size, model.dtype)
        held: list = []
        n = 0
        for batch in released(batches):
            for ids in batch.column(0).to_pylist():
                held.append(np.frombuffer(ids, np.int32))
                n += len(held[-1])
                if n >= _TRAINED:
                    model.train(np.concatenate(held), adam)
                    seen, n = seen + n, 0
                    held.clear()
        if held:
            model.train(np.concatenate(held), adam)
            seen += n
        if seen:
            blocks = [model.vector[i : i + _BLOCK].tobytes() for i in range(0, model.size, _BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([seen] * len(blocks), pa.int64()), pa.array(blocks, pa.binary())], names=["block", "tokens", "weights"])

    return run


def _averaged(batches):
    """The mean of each block, by tokens; one block's sum is all that is held of it."""
    import numpy as np
    import pyarrow as pa

    sums: dict = {}
    for batch in batches:
        for block, tokens, weights in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            own = np.frombuffer(weights, "f4").astype(float) * tokens
            total, n = sums.get(block, (0.0, 0))
            sums[block] = total + own, n + tokens
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / n).astype("f4").tobytes() for s, n in sums.values()], pa.binary())], names=["block", "weights"])


def train(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, rounds: int = ROUNDS, sizes: tuple = (EMBEDDED, HIDDEN, CLASSES)) -> Model:
    """A model of one in ``share`` of ``docs``, in ``rounds`` rounds, each over its own part of them."""
    prepare(spark)
    model = Model(vocabulary.model_counts, *sizes)
    drawn = F.xxhash64(F.col(doc_id), F.col(text))
    chosen = docs.filter(F.pmod(drawn, F.lit(share)) == 0).select(F.pmod(F.floor(drawn / share), F.lit(rounds)).cast("int").alias("round"), F.col(text).alias("text"))
    sent = spark.sparkContext.broadcast(vocabulary)
    sample = staged(spark, chosen.mapInArrow(_sampled(sent), "round int, ids binary"), "recurrent-sample")
    for r in range(rounds):
        start = spark.sparkContext.broadcast(model.vector.tobytes())
        parts = sample.filter(F.col("round") == r).select("ids").mapInArrow(_trained(start, vocabulary.model_counts, sizes), "block int, tokens bigint, weights binary")
        mean = parts.repartition(input_partitions(spark), "block").mapInArrow(_averaged, "block int, weights binary")
        blocks = {x["block"]: bytes(x["weights"]) for x in mean.collect()}  # one model
        start.destroy()
        if blocks:
            import numpy as np

            model.load(np.frombuffer(b"".join(blocks[i] for i in sorted(blocks)), model.dtype).copy())
    sent.destroy()
    return model


def _scored(vocabulary, weights, sizes: tuple):
    """Rows of each document's sums over its listed words, and its other words with their numbers."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        one_thread()
        v = vocabulary.value
        places, n_model = v.places(), len(v.model_counts)
        of = _ids(places, n_model)
        model = Model(v.model_counts, *sizes)
        model.load(np.frombuffer(weights.value, model.dtype))
        base, rare = v.base(v.counts), v.rare(v.counts)
        ends = v.model_counts[END]
        base_end = float(v.base(np.float64(ends)))
        row = TaskContext.get().partitionId() << 40
        kind = pa.null()
        held: list = []
        waiting = 0

        def rows(row: int):
            found = model.scores([x[1] for x in held]) / math.log(10)
            names = ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"]
            doc_ids, ids, known, base_sums, rare_sums, others = zip(*held, strict=True)
            word = pa.array([w for x in others for w in x], pa.binary())
            number = pa.array([n for x in others for n in x.values()], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in others])]), pa.int32()), pa.StructArray.from_arrays([word, number], names=["word", "times"]))
            columns = [pa.array(np.arange(row, row + len(held))), pa.array(doc_ids, kind), pa.array([len(x) for x in ids], pa.int64()), pa.array(known, pa.int64()), pa.array(base_sums, pa.float64()), pa.array(found + np.array(rare_sums)), lists]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in released(batches):
            kind = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                words = words_of(text)
                at, ids = of(words)
                listed = at[at >= 0]
                others = Counter(itertools.compress(words, (at < 0).tolist())) if len(listed) < len(words) else {}
                outside = listed[listed >= n_model - 2]
                held.append((doc_id, ids, len(listed) + (ends > 0), float(base[listed].sum()) + base_end, float(rare[outside].sum()), others))
                waiting += len(ids)
                if waiting >= _SCORED:
                    n = len(held)
                    yield rows(row)
                    row, waiting = row + n, 0
        if held:
            yield rows(row)

    return run


def score(spark: SparkSession, docs: DataFrame, train_on: Column, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, rounds: int = ROUNDS, words: int = WORDS, room: int = SHORTLIST, sizes: tuple = (EMBEDDED, HIDDEN, CLASSES)) -> DataFrame:
    """One row a document: doc_id, n_tokens, n_known, train_tokens, base_score, score; learned from rows where ``train_on`` is true.

    ``score`` is the log10 likelihood of the whole document under the model, ``base_score`` under the counts alone.
    """
    prepare(spark)
    training = docs.filter(train_on)
    counts = staged(spark, word_counts(spark, training, text), "recurrent-words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least, listed = shortlist(counts, room)
    vocabulary = Vocabulary(listed, total, kinds, words)
    model = train(spark, training, vocabulary, doc_id, text, share, rounds, sizes)
    sent, weights = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(model.vector.tobytes())
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, rare array<struct<word:binary,times:bigint>>"
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = staged(spark, chosen.mapInArrow(_scored(sent, weights, sizes), schema), "recurrent-scores")
    sent.destroy()
    weights.destroy()
    # words that aren't listed: their counts come by a join
    others = scored.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times").join(counts.filter(~_listed(least)), "word", "left")
    seen = F.coalesce("n", F.lit(0)) + SMOOTHING
    log = lambda all_, different: F.log10(seen / F.lit(float(all_ + SMOOTHING * (different + 1))))
    sums = others.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * log(total, kinds)).alias("_base"),
        F.sum(F.col("times") * log(vocabulary.rare_total, vocabulary.rare_kinds)).alias("_rare"),
    )
    more = lambda c, by: F.col(c) + F.coalesce(by, F.lit(0))
    joined = scored.drop("rare").join(sums, "row", "left")
    return joined.select("doc_id", "n_tokens", more("n_known", "_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), more("base_score", "_base").alias("base_score"), more("score", "_rare").alias("score"))
