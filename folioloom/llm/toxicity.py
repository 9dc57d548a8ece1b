"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. Samples: at most ``max_toxic`` and ``max_clean`` labelled documents of each class (least
   hashes of doc_id) and ``max_unlabelled`` documents without a label (least hashes of the
   text, each text once). Rows that ``usable`` excludes are never looked at. Executors
   count the features of the labelled sample; the best ones reach the driver.
2. Features of a text, with how often they occur: words and their beginnings; words as
   they read once disguises are undone (``~``: digits or signs for letters, letters set
   apart, letters drawn out); who is addressed (``you>``: the words after "you"); shouting,
   masked words, runs of exclamation marks.
3. Voters: a lexicon voter fires when a word, a pattern voter when one of the other
   features, occurs at least once, twice or three times. At most ``MAX_VOTERS``, those
   that agree best with the labels, without near copies of one another. Where none
   fires, all abstain; such a document without a label teaches nothing.
4. The generative label model: vote patterns are counted over all documents, and
   expectation maximisation estimates each voter's firing rate in either class (its
   accuracy). A row's label is one more voter, of the labelled sample alone, whose two error
   rates are estimated too; so that other voters can overrule it. Correlations between
   voters, within each class, are estimated anew in every round from joint firings, and
   correlated voters share their weight. A voter that abstains is no evidence; the bias is
   set so that the known share of toxic documents is expected.
5. Its posteriors label the labelled and the unlabelled sample, of the latter what it is sure
   of; a ridge logistic regression on log counts of ``MAX_FEATURES`` features learns from
   them, and scores every document.

One pass over the texts gives each row its votes and counts of known features, staged;
everything else works on those. What reaches the driver is bounded: candidates for
features, the samples' counts of known features, and per task one row of sums as wide
as the number of voters squared.

Defined results: null and empty texts get the score of a text without features; repeated
rows get equal scores; a doc_id with both labels has none, one that repeats a label has
it once; of several texts with one doc_id, one is learned from; without labels of both
classes all scores are 0; an empty table gives an empty result; doc_id, lang and source
are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.common import prepare, released, texts
from folioloom.session import staged

MAX_TOXIC = 3000
MAX_CLEAN = 5000
MAX_UNLABELLED = 4000
MAX_VOTERS = 60
MAX_FEATURES = 400
PREFIXES = (3, 4, 5, 6, 7)
ROUNDS = 8
RIDGE = 0.5
#: What a document without a label counts in the regression, of one with a label.
UNLABELLED_WEIGHT = 0.25
#: Posteriors up to which and from which such a document teaches anything.
SURE = (0.01, 0.8)
#: Error rates of labels before any are seen, and how many documents that counts for.
GOLD = (0.95, 0.01)
GOLD_WEIGHT = 20.0

_WORD = re.compile(r"[^\W\d_]+")
#: Each pattern begins with what is rare, or is looked for only where that occurs.
_SIGN = re.compile(r"[0-9@$!|+][^\W\d_]")
_DISGUISED = re.compile(r"(?<![^\W_])[0-9@$]?[^\W\d_]+(?:[0-9@$!|+]+[^\W\d_]+)+(?![^\W_])")
_PARTED = re.compile(r"[.*_-][^\W\d_][.*_-]")
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .*_-][^\W\d_]){3,}(?![^\W_])")
_DRAWN = re.compile(r"(.)\1{2,}")
_MASKED = re.compile(r"(?<![^\W_])[^\W\d_]+[*#]{2,}[^\W\d_]*")
_SHOUT = re.compile(r"[A-Z]{4,}\b")
_BANG = re.compile(r"[!?]{2,}")
_YOU = re.compile(r"you(?:\W+are|['’]re)?\W+(?:an?\W+|such\W+|so\W+)*([^\W\d_]+)")
#: What signs stand for (fixed values).
_SIGNS = str.maketrans("013457@$!|+", "oieastasilt")


def parts(word: str) -> list[str]:
    """A word as features: itself, and its beginnings."""
    return [word, *(f"^{word[:n]}" for n in PREFIXES if len(word) > n)]


def counted(text: str | None) -> Counter:
    """Words of a text, and patterns, which begin with a sign."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    out = Counter(words)
    if _SIGN.search(low):
        for m in _DISGUISED.finditer(low):
            out["~" + m.group().translate(_SIGNS)] += 1
    if _PARTED.search(low) or sum(n for w, n in out.items() if len(w) == 1) > 3:
        for m in _APART.finditer(low):
            out["~" + m.group()[::2]] += 1
    if "you" in out or "youre" in out:
        for m in _YOU.finditer(low):
            if not m.start() or not low[m.start() - 1].isalpha():
                out["you>" + m.group(1)] += 1
    if "**" in low or "##" in low:
        out["#masked"] = sum(1 for _ in _MASKED.finditer(low))
    if n := len(_SHOUT.findall(text)):
        out["#shout"] = n
    if n := len(_BANG.findall(text)):
        out["#bang"] = n
    return out


def _pieces(word: str) -> list[str]:
    """All features of what ``counted`` gives: patterns are features themselves; an undisguised word, and one with letters drawn out, is the plain word too."""
    if word[0] == "#" or ">" in word:
        return [word]
    plain = _DRAWN.sub(r"\1", word.removeprefix("~"))
    if word[0] == "~" or plain != word:
        return ["~" + plain, *parts(plain)]
    return parts(word)


def samples(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, max_toxic: int, max_clean: int, max_unlabelled: int) -> tuple[DataFrame, float]:
    """Staged rows (toxic, text) of the samples, toxic null without a label; and the share of label 1 among all usable labels."""
    once = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    known = once.filter("toxic = other").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    number = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(number.values())

    def first(label: int, n: int) -> DataFrame:
        return known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    few = first(1, max_toxic).unionByName(first(0, max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # max_toxic + max_clean ids at most
    labelled = rows.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("toxic", "text")

    h = F.xxhash64("text")
    free = docs.filter(F.length("text") > 0).select("doc_id", h.alias("h")).join(labels.select("doc_id").filter("doc_id is not null").distinct(), "doc_id", "left_anti")
    bound = free.select("h").distinct().orderBy("h").limit(max_unlabelled).agg(F.max("h")).first()[0]
    out = labelled
    if bound is not None and max_unlabelled:
        keys = free.filter(F.col("h") <= bound).select("h").distinct()  # max_unlabelled at most
        unlabelled = docs.select("text", h.alias("h")).filter(F.length("text") > 0).join(F.broadcast(keys), "h").groupBy("h").agg(F.min("text").alias("text"))
        out = labelled.unionByName(unlabelled.select(F.lit(None).cast("int").alias("toxic"), "text"))
    return staged(spark, out, "toxicity-samples"), number.get(1, 0) / total if total else 0.0


class Features:
    """Which features a text has, from a dictionary of known ones; words are remembered."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.seen: dict[str, list[int]] = {}

    def of(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        seen = self.seen
        for word, n in counted(text).items():
            found = seen.get(word)
            if found is None:
                if len(seen) > 300_000:
                    seen.clear()
                found = seen[word] = [i for p in _pieces(word) if (i := self.index.get(p)) is not None]
            for i in found:
                out[i] = out.get(i, 0) + n
        return out


def _support(batches):
    """Per task: in how many texts of each class a feature occurs at least once, twice, three times."""
    import pyarrow as pa

    seen: Counter = Counter()
    for batch in released(batches):
        for label, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            total: Counter = Counter()
            for word, n in counted(text).items():
                for p in _pieces(word):
                    total[p] += n
            for p, n in total.items():
                for t in range(1, min(n, 3) + 1):
                    seen[p, t, label] += 1
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.int32()), pa.array([k[2] for k in seen], pa.int32()), pa.array(seen.values(), pa.int64())], names=["p", "t", "label", "n"])


def ranked(labelled: DataFrame, n1: int, n0: int, wanted: int) -> list[tuple[str, int, int, int]]:
    """(feature, least count, texts of label 1, texts of label 0), by how well the presence tells the classes apart."""
    seen = labelled.mapInArrow(_support, "p string, t int, label int, n bigint")
    by = seen.groupBy("p", "t").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    ra, rb = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1)
    gain = (ra - rb) * (ra - rb) / ((ra + rb) / 2)
    best = by.filter("a + b >= 5 AND (a > 0 OR t = 1)").orderBy(gain.desc(), F.col("p").startswith("^"), "p", "t").limit(wanted)
    return [(r["p"], r["t"], r["a"], r["b"]) for r in best.collect()]


def chosen_voters(best: list[tuple[str, int, int, int]], index: dict[str, int], rows: list[dict[int, int]], n1: int, n0: int, max_voters: int = MAX_VOTERS) -> list[tuple[int, int]]:
    """Voters (feature, least count) among the ranked features; ``rows`` are the labelled sample's."""
    voters, fired = [], []
    for p, t, a, b in best:
        if len(voters) == max_voters:
            break
        if p not in index or a < 4 or a / (a + b * n1 / max(n0, 1)) < 0.75:
            continue
        mine = np.array([r.get(index[p], 0) >= t for r in rows])
        if all((mine & x).sum() < 0.9 * (mine | x).sum() for x in fired):
            voters.append((index[p], t))
            fired.append(mine)
    return voters


def _features(index: dict[str, int], voters: list[tuple[int, int]]):
    def run(batches):
        import pyarrow as pa

        known = Features(index)
        for batch in released(batches):
            masks, ids, counts = [], [], []
            for text in texts(batch.column(1)):
                found = known.of(text)
                masks.append(sum(1 << i for i, (f, t) in enumerate(voters) if found.get(f, 0) >= t))
                ids.append(list(found))
                counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(masks, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["key", "mask", "ids", "counts"])

    return run


def _bits(masks: np.ndarray, n: int) -> np.ndarray:
    return (masks[:, None] >> np.arange(n) & 1).astype(np.float64)


def _posterior(x: np.ndarray, bias: float, weights: np.ndarray) -> np.ndarray:
    z = x @ weights + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sums(bias: float, weights: np.ndarray):
    """Per task: expected number, firings and joint firings of voters in each class."""

    def run(batches):
        import pyarrow as pa

        v = len(weights)
        total = np.zeros(2 + 2 * v + 2 * v * v)
        for batch in batches:
            x, n = _bits(batch.column(0).to_numpy(), v), batch.column(1).to_numpy().astype(np.float64)
            total += _expected(x, n, _posterior(x, bias, weights))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    return run


def _expected(x: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
    a, b = n * q, n * (1 - q)
    return np.concatenate([[a.sum(), b.sum()], a @ x, b @ x, ((x * a[:, None]).T @ x).ravel(), ((x * b[:, None]).T @ x).ravel()])


class LabelModel:
    """Voters' firing rates in either class, their correlations, and the error rates of labels."""

    def __init__(self, share: float, rate1: np.ndarray, rate0: np.ndarray, gold: tuple[float, float] = GOLD):
        self.share, self.p1, self.p0 = share, rate1.copy(), rate0.copy()
        self.gold = gold  # how often a toxic document is labelled toxic, and a clean one
        self.correlation = (np.zeros((len(rate1),) * 2), np.zeros((len(rate1),) * 2))
        self.discount = np.ones(len(rate1))
        self.bias = float(np.log(share / (1 - share)))

    def linear(self) -> tuple[float, np.ndarray]:
        """(bias, weights) of the log odds, given which voters fire; those that abstain say nothing."""
        return self.bias, np.log(self.p1 / self.p0) * self.discount

    def calibrate(self, fires: np.ndarray, weight: np.ndarray) -> None:
        """Set the bias so that the sample, weighted to the corpus' shares, is expected to have the known share of toxic documents."""
        low, high = -30.0, 30.0
        for _ in range(60):
            self.bias = (low + high) / 2
            if weight @ self.posterior(fires) > self.share * weight.sum():
                high = self.bias
            else:
                low = self.bias

    def posterior(self, fires: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
        """Chance of being toxic, from the votes and, where given, the labels."""
        bias, weights = self.linear()
        if y is None:
            return _posterior(fires, bias, weights)
        g1, g0 = self.gold
        label = np.where(y == 1, np.log(g1 / g0), np.log((1 - g1) / (1 - g0)))
        return _posterior(np.hstack([fires, label[:, None]]), bias, np.append(weights, 1.0))

    def fit(self, masks: DataFrame, fires: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
        """Expectation maximisation over all documents' vote patterns (mask, n) and the labelled sample, weighted to the corpus' shares."""
        v = len(self.p1)
        for _ in range(rounds):
            self.calibrate(fires, weight)
            parts = masks.mapInArrow(_sums(*self.linear()), "s array<double>").select(F.posexplode("s").alias("i", "x"))
            s = np.zeros(2 + 2 * v + 2 * v * v)
            for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():  # a row a number of the model, however many tasks
                s[r["i"]] = r["x"]
            q = self.posterior(fires, y)
            s += _expected(fires, weight, q)
            n1, n0 = max(s[0], 1e-9), max(s[1], 1e-9)
            self.p1, self.p0 = np.clip(s[2 : 2 + v] / n1, 1e-5, 0.99), np.clip(s[2 + v : 2 + 2 * v] / n0, 1e-5, 0.99)
            held = ((s[2 + 2 * v : 2 + 2 * v + v * v], n1, self.p1), (s[2 + 2 * v + v * v :], n0, self.p0))
            self.correlation = tuple(_correlation(joint.reshape(v, v) / n, p) for joint, n, p in held)
            both = np.maximum(*self.correlation) if v else self.correlation[0]
            self.discount = 1 / (1 + np.clip(both - 0.2, 0, None).sum(axis=1))
            a, b = weight * q, weight * (1 - q)
            self.calibrate(fires, weight)
            self.gold = tuple(float((c @ y + GOLD_WEIGHT * g) / (c.sum() + GOLD_WEIGHT)) for c, g in ((a, GOLD[0]), (b, GOLD[1])))
        return self


def _correlation(pairs: np.ndarray, p: np.ndarray) -> np.ndarray:
    sd = np.sqrt(p * (1 - p))
    out = np.clip((pairs - np.outer(p, p)) / np.outer(sd, sd), -1, 1)
    np.fill_diagonal(out, 0)
    return out


def regress(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 30) -> tuple[float, np.ndarray]:
    """Ridge logistic regression on soft labels, by Newton's method; a step that doesn't lower the loss is halved."""
    n, d = x.shape
    a = np.hstack([np.ones((n, 1)), x])
    w = np.zeros(d + 1)
    w[0] = np.log(max((weight * y).sum(), 1e-6) / max((weight * (1 - y)).sum(), 1e-6))
    penalty = np.full(d + 1, ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (weight * (p - y)) + penalty * w
        bend = (a * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        before, w = now, w - size * step
        now = loss(w)
        if before - now < 1e-7 * max(1.0, abs(before)):
            break
    return float(w[0]), w[1:]


def _score(bias: float, weights: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, counts = batch.column(1), batch.column(2)
            sizes = np.diff(ids.offsets.to_numpy())
            lo, hi = ids.offsets[0].as_py(), ids.offsets[-1].as_py()
            gain = weights[ids.values.to_numpy()[lo:hi]] * np.log1p(counts.values.to_numpy()[lo:hi])
            z = bias + np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=gain, minlength=len(sizes))
            score = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["key", "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, usable: Column, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_unlabelled: int = MAX_UNLABELLED, max_voters: int = MAX_VOTERS, max_features: int = MAX_FEATURES, learn_from: str = "posteriors") -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs`` (doc_id, text).

    ``usable`` is a condition on ``labels`` (doc_id, toxic): the rows to learn from.
    ``learn_from`` is "posteriors" or, to compare, "labels" (the given labels alone) or
    "votes" (posteriors that never see a label).
    """
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    sampled, share = samples(spark, docs, labels, usable, max_toxic, max_clean, max_unlabelled)
    n = {r["toxic"]: r["n"] for r in sampled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # three rows
    if not 0 < share < 1 or not n.get(0) or not n.get(1):
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    best = ranked(sampled.filter("toxic is not null"), n[1], n[0], 4 * max_features)
    index: dict[str, int] = {}
    for p, *_ in best:
        if len(index) < max_features:
            index.setdefault(p, len(index))

    schema = "mask bigint, ids array<int>, counts array<int>"
    learned = sampled.mapInArrow(_features(index, []), f"key int, {schema}").select("key", "ids", "counts").collect()  # the samples' rows, at most 3 * max_features numbers each
    learned.sort(key=lambda r: (r["key"] is None, r["key"] or 0, r["ids"], r["counts"]))
    rows = [dict(zip(r["ids"], r["counts"], strict=True)) for r in learned]
    x = np.zeros((len(rows), len(index)))
    for i, row in enumerate(rows):
        for j, c in row.items():
            x[i, j] = np.log1p(c)
    y = np.array([r["key"] for r in learned if r["key"] is not None], np.float64)
    labelled = len(y)
    voters = chosen_voters(best, index, rows[:labelled], n[1], n[0], max_voters)

    chosen = docs.select(F.col("doc_id").alias("key"), F.col("text"))
    found = staged(spark, chosen.mapInArrow(_features(index, voters), f"key {kind}, {schema}"), "toxicity-rows")

    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    q, weights = y, weight
    if voters and learn_from != "labels":
        fires = np.array([[r.get(f, 0) >= t for f, t in voters] for r in rows], np.float64)
        mine = fires[:labelled]
        rate1 = np.clip((y @ mine + 0.5) / (y.sum() + 1), 1e-5, 0.99)
        rate0 = np.clip(((1 - y) @ mine + 0.5) / ((1 - y).sum() + 1), 1e-5, 0.99)
        masks = staged(spark, found.groupBy("mask").agg(F.count("*").alias("n")), "toxicity-votes")
        model = LabelModel(share, rate1, rate0).fit(masks, mine, y, weight)
        q = np.concatenate([model.posterior(mine, y if learn_from == "posteriors" else None), model.posterior(fires[labelled:])])
        unlabelled = q[labelled:]
        sure = fires[labelled:].any(axis=1) & ((unlabelled >= SURE[1]) | (unlabelled <= SURE[0]))  # where all abstain, there is nothing to learn
        weights = np.concatenate([weight, np.where(sure, UNLABELLED_WEIGHT, 0.0)])
    linear = regress(x[: len(q)], q, weights)
    return found.select("key", "ids", "counts").mapInArrow(_score(*linear), f"key {kind}, score double").withColumnRenamed("key", "doc_id")
