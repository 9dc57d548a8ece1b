"""Secret scanning with a randomness test battery; DataFrame functions alone.

Base spans come from three patterns (see ``BASE``), leftmost and without overlap for
each kind. Further spans of kind ``random`` come from the battery:

1. Candidates are runs of 20 or more characters of the base-64 alphabets with both a
   letter and a digit. The encoding is inferred from the characters that occur: hex,
   base 32, upper or lower case with digits, base 62, base 64.
2. Battery, for each candidate against uniform draws from its encoding's alphabet:
   chi-squared uniformity (Wilson-Hilferty), Wald-Wolfowitz runs above and below the
   alphabet's middle, and lag-1 serial correlation. Their p values are combined to one,
   ``p_random``, by Cauchy's rule, which holds for dependent tests.
3. False-discovery control in each class of encoding and length, in two ways. On the
   battery's ``p_random``, which is uniform for random strings and small for others: the
   number of random ones follows from the p values above ``CALM`` (Storey's estimate), and
   the least bound is taken above which the others are at most ``RATE`` of what passes.
   Classes of fewer than ``FEW`` candidates are judged with the next longer ones. Against
   text: in text-like strings of n characters, equal pairs of characters are Poisson with
   mean n(n-1)/2 times text's coincidence rate, so that the p value against "this is text"
   sharpens with length; Benjamini and Hochberg's procedure holds their share at ``RATE``.
   A discovery passes both. Both work on counts in fixed bins, summed over all rows: at
   most 6 encodings, 33 lengths and 1,301 bins reach the driver, whatever the input.

A candidate that overlaps a base span adds nothing. Offsets count code points, ends
exclusive. Text is scanned where it lies; matches leave it as rows of numbers (and of
candidates' characters), which get their places from running sums over a text's rows,
so that time grows with the number of matches, however many a text has.

Defined results: null and empty texts have no spans; repeated rows have equal
results; ties in start are ordered by kind; an empty table gives an empty result;
other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioloom.llm.common import text_or_empty
from folioloom.session import staged

#: Kinds in their order: pattern, the group whose length counts, the least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 4, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 2, 16),
    "hex": (r"[0-9a-f]{32,}", 2, 32),
}
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}"
RATE = 0.05
CALM = 0.05
FEW = 200

#: Encoding: what its strings look like (fixed values), its alphabet in order, and the coincidence rate of text-like strings.
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.1),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065),
    "upper": ("^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 0.065),
    "lower": ("^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 0.065),
    "base62": ("^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.065),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065),
}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_of(text: Column, kind: int, pattern: str, group: int, probe: str, keep: bool) -> Column:
    """Array of a pattern's leftmost matches, each with the length of the gap before it (g), its own (l) and its group's (n).

    ``keep`` adds the characters of the match.
    """
    whole = F.lit(rf"(?s)(.*?)({pattern}|\z)")  # the end matches too, else each place of the tail is searched again
    gaps, hits, counted = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2, group))
    rows = F.zip_with(F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h"))), counted, lambda x, c: F.struct(x["g"].alias("g"), x["h"].alias("h"), F.length(c).alias("n")))

    def entry(x: Column, i: Column) -> Column:
        hit = x["h"] if keep else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["g"].alias("g"), F.length(x["h"]).alias("l"), x["n"].alias("n"), hit.alias("hit"))

    return F.when(text.rlike(probe), F.transform(rows, entry)).otherwise(F.array().cast("array<struct<kind:int,at:int,g:int,l:int,n:int,hit:string>>"))


def _upper_tail(z: str) -> str:
    """P(Z > |z|) for a standard normal, by a rational approximation (error below 1e-7)."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(0.3989422804014327 * exp(-0.5 * ({z}) * ({z})) * {poly})"


def battery(tokens: DataFrame) -> DataFrame:
    """Adds to rows with a string ``hit`` its encoding, p values of the battery, and ``p_text`` and their class and bin."""
    body = "rtrim('=', hit)"
    names = list(ENCODINGS)
    encoding = "CASE " + " ".join(f"WHEN body RLIKE {_sql(ENCODINGS[n][0])} THEN {_sql(n)}" for n in names[:-1]) + f" ELSE {_sql(names[-1])} END"
    alphabet = "CASE encoding " + " ".join(f"WHEN {_sql(n)} THEN {_sql(ENCODINGS[n][1])}" for n in names) + " END"
    rate = "CASE encoding " + " ".join(f"WHEN {_sql(n)} THEN {ENCODINGS[n][2]}D" for n in names) + " END"
    steps = [
        {"body": body},
        {"encoding": encoding},
        {"alphabet": alphabet, "rate": rate, "plain": "CASE encoding WHEN 'hex' THEN lower(body) WHEN 'base64' THEN translate(body, '-_', '+/') ELSE body END"},
        {"k": "CAST(length(alphabet) AS DOUBLE)", "n": "CAST(length(plain) AS DOUBLE)", "v": "transform(split(plain, ''), c -> CAST(instr(alphabet, c) - 1 AS DOUBLE))"},
        {
            "squares": "aggregate(array_distinct(v), 0D, (a, x) -> a + pow(size(filter(v, y -> y = x)), 2))",
            "high": "transform(v, x -> CAST(x >= k / 2 AS INT))",
            "mean": "aggregate(v, 0D, (a, x) -> a + x) / n",
        },
        {
            "chi": "k / n * squares - n",
            "n1": "aggregate(high, 0D, (a, x) -> a + x)",
            "turns": "aggregate(zip_with(slice(high, 1, size(high) - 1), slice(high, 2, size(high)), (a, b) -> abs(a - b)), 1D, (a, x) -> a + x)",
            "spread": "aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))",
            "lag": "aggregate(zip_with(slice(v, 1, size(v) - 1), slice(v, 2, size(v)), (a, b) -> (a - mean) * (b - mean)), 0D, (a, x) -> a + x)",
            "pairs": "(squares - n) / 2",
            "expected": "n * (n - 1) / 2 * rate",
        },
        {
            "z_chi": "(pow(greatest(chi, 0) / (k - 1), 1D / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))",
            "runs_mean": "2 * n1 * (n - n1) / n + 1",
            "z_serial": "CASE WHEN spread > 0 THEN (lag / spread + 1 / n) * sqrt(n) ELSE 99D END",
            # a Poisson count's lower tail, by its cube root
            "z_text": "3 * sqrt(pairs + 1) * (pow(expected / (pairs + 1), 1D / 3) - 1 + 1 / (9 * (pairs + 1)))",
        },
        {"z_runs": "CASE WHEN n1 > 0 AND n1 < n AND runs_mean > 2 THEN (turns - runs_mean) / sqrt((runs_mean - 1) * (runs_mean - 2) / (n - 1)) ELSE 99D END"},
        {
            "p_chi": f"CASE WHEN z_chi >= 0 THEN {_upper_tail('z_chi')} ELSE 1 - {_upper_tail('z_chi')} END",
            "p_runs": f"2 * {_upper_tail('z_runs')}",
            "p_serial": f"2 * {_upper_tail('z_serial')}",
            "p_text": f"CASE WHEN z_text >= 0 THEN {_upper_tail('z_text')} ELSE 1 - {_upper_tail('z_text')} END",
        },
        {"cauchy": " + ".join(f"tan((0.5 - greatest(1e-12D, least(0.99D, {p}))) * pi())" for p in ("p_chi", "p_runs", "p_serial"))},
        {"p_random": "0.5 - atan((cauchy) / 3) / pi()"},
        {
            "length_class": "CAST(least(32, floor(n / 8)) AS INT)",
            "calm_bin": "CAST(floor(p_random * 1000) AS INT)",
            "text_bin": "CAST(greatest(0, least(300, floor(-10 * log10(greatest(p_text, 1e-40D))))) AS INT)",
        },
    ]
    out = tokens
    for step in steps:
        out = out.withColumns({k: F.expr(v) for k, v in step.items()})
    return out.select(*tokens.columns, "encoding", "p_chi", "p_runs", "p_serial", "p_random", "p_text", "length_class", "calm_bin", "text_bin")


def _binned(tested: DataFrame, column: str) -> dict[str, dict[int, dict[int, int]]]:
    """Counts by encoding, length class and bin: a bounded number."""
    out: dict[str, dict[int, dict[int, int]]] = {}
    for r in tested.groupBy("encoding", "length_class", column).agg(F.count("*").alias("n")).collect():
        out.setdefault(r["encoding"], {}).setdefault(r["length_class"], {})[r[column]] = r["n"]
    return out


def against_text(tested: DataFrame, rate: float = RATE) -> dict[tuple[str, int], int]:
    """For each class of encoding and length, the least ``text_bin`` whose candidates are discoveries (Benjamini-Hochberg)."""
    out = {}
    for encoding, classes in _binned(tested, "text_bin").items():
        for length, bins in classes.items():
            m, so_far = sum(bins.values()), 0
            for b in sorted(bins, reverse=True):
                so_far += bins[b]
                if 10 ** (-b / 10) <= rate * so_far / m:  # the bin's largest p value
                    out[encoding, length] = b
    return out


def random_enough(tested: DataFrame, rate: float = RATE, calm: float = CALM, few: int = FEW) -> dict[tuple[str, int], int]:
    """For each class of encoding and length, the least ``calm_bin`` above which at most ``rate`` isn't random (Storey)."""
    out = {}
    for encoding, classes in _binned(tested, "calm_bin").items():
        groups: list[list[int]] = [[]]
        for length in sorted(classes):  # few candidates are judged with the next longer ones, or at the end with the ones before
            groups[-1].append(length)
            if sum(sum(classes[x].values()) for x in groups[-1]) >= few:
                groups.append([])
        if len(groups) > 1:
            last = groups.pop()
            groups[-1] += last
        for group in groups:
            bins: dict[int, int] = {}
            for length in group:
                for b, n in classes[length].items():
                    bins[b] = bins.get(b, 0) + n
            m = sum(bins.values())
            if not m:
                continue
            random = min(1.0, sum(n for b, n in bins.items() if b >= 1000 * calm) / ((1 - calm) * m)) * m
            above = m - bins.get(0, 0)
            for b in range(1, 1000):  # p values below 0.001 are never random enough
                if above <= 0:
                    break
                if above - random * (1 - b / 1000) <= rate * above:
                    out |= {(encoding, length): b for length in group}
                    break
                above -= bins.get(b, 0)
    return out


_PROBES = {"assign": "(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{32}"}


def scan(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (start, end, kind).

    Each row's spans are in order of start, then of kind.
    """
    t = text_or_empty(text)
    order = [*BASE, "random"]
    added = len(BASE)
    nothing = "CAST(NULL AS INT)"
    itself = F.expr(f"array(struct(-1 AS kind, 0 AS at, {nothing} AS g, {nothing} AS l, {nothing} AS n, CAST(NULL AS STRING) AS hit))")  # so that each row of docs stays
    found = [matches_of(t, i, pattern, group, _PROBES[kind], False) for i, (kind, (pattern, group, _)) in enumerate(BASE.items())]
    entries = F.concat(itself, *found, matches_of(t, added, RANDOM, 2, "[0-9]", True))
    numbered = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), entries.alias("m"))  # a row's number is given before it is exploded
    exploded = numbered.select("doc_id", "row", F.explode("m").alias("m")).select("doc_id", "row", "m.*")

    running = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    least = F.element_at(F.array(*[F.lit(n) for *_, n in BASE.values()], F.lit(20)), F.col("kind") + 1)
    placed = exploded.repartition("row").withColumn("end", F.sum(F.col("g") + F.col("l")).over(running).cast("int")).withColumn("start", F.col("end") - F.col("l"))
    spans = placed.filter((F.col("kind") < 0) | (F.col("l") > 0) & (F.col("n") >= F.when(F.col("kind") >= 0, least)))
    # a candidate is free where no base span that begins before its end reaches beyond its start
    candidate = F.col("kind") == added
    before = W.partitionBy("row").orderBy(F.when(candidate, F.col("end")).otherwise(F.col("start")), F.when(candidate, 0).otherwise(1)).rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(~candidate, F.col("end"))).over(before)
    free = spans.withColumn("reach", reach).filter(~candidate | F.col("reach").isNull() | (F.col("reach") <= F.col("start")))
    rows = staged(spark, free.select("doc_id", "row", "kind", "start", "end", "hit"), "secret-rows")

    tested = staged(spark, battery(rows.filter(candidate)).drop("hit"), "secret-tests")
    calm, unlike = random_enough(tested, rate), against_text(tested, rate)
    chosen = F.lit(False)
    for key in calm.keys() & unlike.keys():
        chosen = chosen | ((F.col("encoding") == key[0]) & (F.col("length_class") == key[1]) & (F.col("calm_bin") >= calm[key]) & (F.col("text_bin") >= unlike[key]))
    columns = ["doc_id", "row", "kind", "start", "end"]
    every = rows.filter(~candidate).select(*columns).unionByName(tested.filter(chosen).select(*columns))
    by_row = every.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end")))).alias("found"))
    names = F.array(*[F.lit(x) for x in order])
    return by_row.select("doc_id", F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind"))).alias("spans"))
