"""Language identification by Bayesian evidence fusion.

Four kinds of evidence, each a factor of one posterior over the languages and a class
of other texts:

* text: a naive Bayes model over hashed character trigrams. It is fitted on a bounded
  sample of labelled rows: ``sample_rows`` different whole texts of each language, those
  with the least hashes, so that copies of a text count once. Trigrams are counted on
  executors; a language costs the driver and the broadcast model 128 KB. A text's log
  likelihood is tempered to at most ``max_grams`` independent trigrams, since trigrams
  of a text aren't independent. Other texts have all trigrams alike.
* declared language: markup's lang attribute, or a column. Its likelihood
  P(declared | language) is estimated from the corpus: counts of (declared, language
  by text), a table of languages squared, smoothed.
* address suffix: the last label of the host, P(language | suffix).
* host: P(language | host). Counts come from grouped aggregation over all rows, with
  partial sums before the shuffle. They are smoothed hierarchically: a host's counts
  towards its registered domain's, those towards its suffix's, those towards the
  whole corpus. So the suffix reaches a page through the host's prior, once. A row's
  own text counts in none of them: it is taken out at each level.

A row whose text has no trigram, which is likelier to be another text, or whose
posterior stays below ``least``, is ``und``: rejected. Only scores and keys of a row
are shuffled, never its text.

Defined results: null or empty text, or text without letters, is ``und``; a null host
and an unknown declared language leave the other evidence to decide; ties go to the
language that sorts first; repeated rows have equal results; an empty table gives an
empty result; without labelled rows all is ``und``; other columns, whatever their
names, pass through ``accept_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm.common import drop_keys, free_name, prepare, released, row_key, texts
from folioloom.session import staged

SAMPLE_ROWS = 400
BUCKETS = 1 << 15
MAX_GRAMS = 400.0
STRENGTH = (4.0, 8.0, 16.0)
LEAST = 0.5
OTHER = 0.001
UNKNOWN = "und"

#: Labels under a country's that belong to the suffix, not to a registered domain (fixed values).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def grams(text: str, buckets: int = BUCKETS):
    """Hashed trigrams of the letters of a text, words parted by one blank; lower case."""
    import numpy as np

    kept = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower().translate(_ASCII)
    words = kept.split()
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.int64)
    return ((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * 2654435761 >> 8) % buckets


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def _counts(buckets: int):
    """Per task and language: how often each trigram occurs, as one array."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[str, np.ndarray] = {}
        for batch in released(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if lang not in held:
                    held[lang] = np.zeros(buckets, np.int64)
                held[lang] += np.bincount(grams(text, buckets), minlength=buckets)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "gram", "n"])

    return run


def fit(spark: SparkSession, labelled: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS):
    """(languages, table): table[bucket, language] is a trigram's log probability.

    The sample doesn't depend on the layout. It is drawn from the least hashes: four
    times as many texts as are wanted are likely below a language's bound, which
    follows from its number of different texts.
    """
    import numpy as np

    prepare(spark)
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(4.0 * sample_rows) / F.approx_count_distinct("h")))
    bounds = rows.groupBy("lang").agg(share.alias("share"))  # a row a language
    below = F.pmod(F.shiftrightunsigned("h", 1), F.lit(1 << 40)) <= F.col("share") * F.lit(float(1 << 40))
    keys = rows.select("lang", "h").join(F.broadcast(bounds), "lang").filter(below).select("lang", "h").distinct()
    chosen = keys.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample_rows).select("lang", "h")  # sample_rows a language
    sample = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    counted = sample.select("lang", "text").mapInArrow(_counts(buckets), "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang = counted.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).orderBy("lang")  # at most ``buckets`` entries a language
    langs, columns = [], []
    for r in by_lang.toLocalIterator():
        column = np.full(buckets, 0.05)
        column[np.array(r["gram"], np.int64)] += np.array(r["n"], np.float64)
        langs.append(r["lang"])
        columns.append(np.log(column / column.sum()).astype(np.float32))
    return langs, np.stack(columns, axis=1) if columns else np.zeros((buckets, 1), np.float32)


def _scores(model, max_grams: float):
    """Adds to each row the number of its trigrams and the log likelihoods of each language and, last, of another text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = model.value
        uniform = -np.log(len(table))
        for batch in released(batches):
            out, n = [], []
            for text in texts(batch.column(batch.num_columns - 1)):
                g = grams(text or "", len(table))
                n.append(len(g))
                total = np.zeros(table.shape[1] + 1)
                for at in range(0, len(g), 1 << 18):
                    total[:-1] += table[g[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
                if len(g):
                    total[-1] = len(g) * uniform
                    total *= min(1.0, max_grams / len(g))
                out.append(np.round(total - total.max(), 6))
            values = pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * (table.shape[1] + 1), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), lists], names=[*batch.schema.names[:-1], "n_grams", "loglik"])

    return run


def suffix_of(host: Column) -> Column:
    """The address suffix: the last label of a host; null for an address in numbers."""
    return F.when(~host.rlike(r"^[0-9.]*$|:"), F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: a host's last two labels, or three where the second is part of a country's suffix."""
    labels = F.when(host.rlike(rf"\.(?:{'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(suffix_of(host).isNull(), host).otherwise(labels)


def _fused(langs: list[str], total: list[int], given: dict[str, list[float]], least: float, strength: tuple[float, float, float]):
    """Labels and posteriors from the evidence of each row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width = len(langs)
        whole = np.array(total, np.float64)
        declared_p = {d: np.log(p) for d, p in given.items()}
        nothing = np.zeros(width)

        def counts(column) -> np.ndarray:
            return np.array([x if x is not None else nothing for x in column.to_pylist()], np.float64).reshape(-1, width)

        for batch in batches:
            if not batch.num_rows:
                continue
            best = np.array([t or 0 for t in batch.column(1).to_pylist()])
            own = np.zeros((len(best), width))
            known = best > 0
            own[np.flatnonzero(known), best[known] - 1] = 1
            prior = whole - own + 1
            prior /= prior.sum(axis=1, keepdims=True)
            for column, alpha in zip((8, 7, 6), strength[::-1], strict=True):  # suffix, domain, host
                n = counts(batch.column(column))
                n = np.maximum(n - own, 0)
                prior = (n + alpha * prior) / (n.sum(axis=1, keepdims=True) + alpha)
            loglik = np.array(batch.column(5).to_pylist(), np.float64)
            logs = np.hstack([loglik[:, :-1] + np.log(prior * (1 - OTHER)), loglik[:, -1:] + np.log(OTHER)])
            for i, d in enumerate(batch.column(2).to_pylist()):
                if d in declared_p:
                    logs[i, :-1] += declared_p[d]
                    logs[i, -1] -= np.log(width)
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            at = logs[:, :-1].argmax(axis=1)
            post = np.where(known, np.round(p[np.arange(len(at)), at], 6), 0.0)
            sure = known & (post >= least) & (p[:, -1] <= post)
            label = [langs[k] if ok else UNKNOWN for k, ok in zip(at, sure, strict=True)]
            by_text = [langs[t - 1] if t else None for t in best]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(label, pa.string()), pa.array(post, pa.float64()), pa.array(by_text, pa.string()), batch.column(2), batch.column(3), batch.column(4)],
                names=["key", "lang", "posterior", "text_lang", "declared", "host", "n_grams"],
            )

    return run


def identify(spark: SparkSession, rows: DataFrame, model: tuple, key: str, text: Column, declared: Column, host: Column, least: float = LEAST, max_grams: float = MAX_GRAMS, strength: tuple[float, float, float] = STRENGTH) -> DataFrame:
    """One row per row of ``rows``: key, lang, posterior, text_lang, declared, host, n_grams."""
    prepare(spark)
    langs, table = model
    if not langs:
        return rows.select(F.col(key), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("string").alias("text_lang"), declared.alias("declared"), host.alias("host"), F.lit(0).cast("long").alias("n_grams"))
    width = len(langs)
    kind = rows.schema[key].dataType.simpleString()
    inputs = rows.select(F.col(key).alias("key"), F.lower(F.split(declared, "[-_]")[0]).alias("declared"), F.lower(host).alias("host"), text.alias("text"))
    shared = spark.sparkContext.broadcast(table)  # 128 KB a language
    scored = inputs.mapInArrow(_scores(shared, max_grams), f"key {kind}, declared string, host string, n_grams bigint, loglik array<double>")
    by_text = F.slice("loglik", 1, width)
    best = F.when(F.col("n_grams") > 0, F.array_position(by_text, F.array_max(by_text)).cast("int"))
    s = staged(spark, scored.withColumn("t", best), "langid-scores")
    shared.destroy()  # scores are written

    def dense(entries: Column) -> Column:
        found = F.map_from_entries(entries)
        return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.coalesce(F.element_at(found, i), F.lit(0).cast("long")))

    def counted(by: DataFrame, *keys: str) -> DataFrame:
        """One row a key, with an array of its rows of each language."""
        return by.groupBy(*keys, "t").agg(F.sum("n").alias("n")).groupBy(*keys).agg(dense(F.collect_list(F.struct("t", "n"))).alias("n"))

    tally = s.filter("t is not null")
    pairs = staged(spark, tally.groupBy("host", "t").agg(F.count("*").alias("n")).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "langid-hosts")
    total = [0] * width
    for r in pairs.groupBy("t").agg(F.sum("n").alias("n")).collect():  # a row a language
        total[r["t"] - 1] = r["n"]
    named = pairs.filter("host is not null")
    hosts = counted(named, "host", "domain", "suffix").withColumnRenamed("n", "of_host")
    domains = counted(named, "domain").withColumnRenamed("n", "of_domain")
    suffixes = counted(named.filter("suffix is not null"), "suffix").withColumnRenamed("n", "of_suffix")
    priors = hosts.join(domains, "domain").join(suffixes, "suffix", "left").select("host", "of_host", "of_domain", "of_suffix")

    confusion: dict[tuple[str, int], float] = {}
    for r in tally.filter(F.col("declared").isin(langs)).groupBy("declared", "t").agg(F.count("*").alias("n")).collect():  # languages squared
        confusion[r["declared"], r["t"]] = float(r["n"])
    of_lang = [sum(confusion.get((d, i + 1), 0.0) for d in langs) for i in range(width)]
    given = {d: [(confusion.get((d, i + 1), 0.0) + (8.0 if d == langs[i] else 0.5)) / (of_lang[i] + 8.0 + 0.5 * (width - 1)) for i in range(width)] for d in langs}

    joined = s.join(priors, "host", "left").select("key", "t", "declared", "host", "n_grams", "loglik", "of_host", "of_domain", "of_suffix")
    out = f"key {kind}, lang string, posterior double, text_lang string, declared string, host string, n_grams bigint"
    return joined.mapInArrow(_fused(langs, total, given, least, strength), out).withColumnRenamed("key", key)


#: Parts of a page that aren't text, and tags.
_HIDDEN = r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_text(html: str = "html") -> Column:
    return F.regexp_replace(F.coalesce(F.col(html), F.lit("")), _HIDDEN, " ")


def page_declared(html: str = "html") -> Column:
    """The lang attribute of a page's html element, wherever it begins; null where there is none. Comments don't count."""
    found = F.regexp_extract(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?s)<!--.*?-->", ""), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+(?:[-_][A-Za-z0-9]+)*)", 1)
    return F.when(found != "", found)


def page_host(url: str = "url") -> Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host)


def identify_pages(spark: SparkSession, pages: DataFrame, labelled: DataFrame, **parameters) -> DataFrame:
    """Languages of web pages, from their text, lang attribute, address suffix and host."""
    return identify(spark, pages, fit(spark, labelled), "page_id", page_text(), page_declared(), page_host(), **parameters)


def accept_documents(spark: SparkSession, docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without those whose language is ``und``: declared language and source are the other evidence.

    Rows stay or go by their own text, whatever their doc_id.
    """
    key = free_name(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    found = identify(spark, keyed, fit(spark, docs), key, F.coalesce(F.col("text"), F.lit("")), F.col("lang"), F.col("source"), least=least)
    gone = staged(spark, found.filter(F.col("lang") == UNKNOWN).select(key), "langid-gone")
    return drop_keys(keyed, key, gone).drop(key)
