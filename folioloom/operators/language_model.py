"""Languages by character trigrams: a naive Bayes model learned from labelled rows, scored in one pass over texts.

Training is one aggregation: every task counts the trigrams of its rows by language, hashed to ``BUCKETS``, and the counts are summed by language and
bucket. So the model has at most ``BUCKETS`` numbers a language, whatever the corpus; languages are at most ``LANGUAGES``, an error beyond. Scoring adds, for each trigram of a
text, the logarithms of its smoothed share in each language; no text is shuffled. The confidence is a language's part of all, with the likelihoods'
geometric means a trigram, so that it doesn't depend on a text's length.

Defined results: texts of fewer than ``SHORTEST`` characters and null ones are ``unknown``, with confidence 0 and no candidates; rows without a language or
text teach nothing; with no language at all everything is unknown; ties go to the code that comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.session import ship

BUCKETS = 1 << 15
LANGUAGES = 64
SHORTEST = 30
SMOOTHING = 0.5


def _buckets(text: str):
    """The trigrams of a text, lower-cased, by bucket."""
    import numpy as np

    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    return (c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % BUCKETS if len(c) > 2 else np.zeros(0, np.int64)


def _counted(batches):
    import numpy as np
    import pyarrow as pa

    held: dict = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = held.setdefault(lang, np.zeros(BUCKETS, np.int64))
            counts += np.bincount(_buckets(text.as_py()), minlength=BUCKETS)
    for lang, counts in held.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["lang", "bucket", "n"])


class Profiles:
    """The logarithms of each language's smoothed shares: codes, and a row a language."""

    def __init__(self, codes: list[str], counts):
        import numpy as np

        self.codes = codes
        self.logs = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)) if codes else counts

    def scores(self, text: str):
        """The mean log likelihood of a trigram in each language; None where a text has no trigram."""
        at = _buckets(text)
        return self.logs[:, at].sum(axis=1) / len(at) if len(at) else None


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages of labelled rows."""
    import numpy as np

    ship(rows.sparkSession)
    known = rows.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    codes = sorted(r["lang"] for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(codes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    table = np.zeros((len(codes), BUCKETS))
    for r in counts.collect():  # at most BUCKETS a language
        table[codes.index(r["lang"]), r["bucket"]] = r["n"]
    return Profiles(codes, table)


def _scored(profiles: Profiles, shortest: int, most: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], []]
            for x in batch.column(batch.num_columns - 1):
                text = x.as_py() or ""
                found = profiles.scores(text) if len(text) >= shortest and profiles.codes else None
                if found is None:
                    values = ("unknown", 0.0, [])
                else:
                    share = np.exp(found - found.max())
                    order = np.argsort(-found, kind="stable")[:most].tolist()
                    values = (profiles.codes[order[0]], round(float(share[order[0]] / share.sum()), 4), [profiles.codes[i] for i in order])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "detected", "confidence", "candidates"])

    return run


def identify(rows: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, most: int = 3) -> DataFrame:
    """Per row: key, detected, confidence (four digits), candidates (the ``most`` likeliest codes)."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_scored(profiles, shortest, most), f"key {kind}, detected string, confidence double, candidates array<string>").withColumnRenamed("key", key)
