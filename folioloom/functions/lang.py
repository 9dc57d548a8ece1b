"""Language of a text by frequent words and scripts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that are looked for where none are given (fixed value), and the least length of a text.
DEFAULT_LANGUAGES = ("en", "ms", "zh", "ar")
SHORTEST = 30

#: Frequent words of languages (fixed values).
WORDS = {
    "de": ("als", "auch", "auf", "das", "dem", "den", "der", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu", "zum"),
    "en": ("are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "and"),
    "es": ("al", "como", "con", "del", "el", "en", "es", "las", "lo", "los", "para", "por", "que", "se", "su", "un", "una", "y", "más", "pero"),
    "fr": ("au", "avec", "dans", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "par", "pas", "pour", "que", "qui", "sur", "une"),
    "it": ("che", "con", "da", "dei", "del", "della", "di", "e", "gli", "i", "il", "in", "la", "le", "non", "per", "sono", "un", "una", "è"),
    "la": ("ab", "ad", "atque", "aut", "cum", "de", "enim", "est", "et", "ex", "hoc", "in", "non", "per", "quae", "quod", "sed", "sunt", "ut", "vel"),
    "ms": ("ada", "adalah", "dalam", "dan", "dari", "dengan", "di", "ini", "itu", "juga", "ke", "kepada", "oleh", "orang", "pada", "sebagai", "telah", "tidak", "untuk", "yang"),
    "nl": ("aan", "dat", "de", "die", "een", "en", "het", "in", "is", "met", "niet", "of", "om", "op", "te", "van", "voor", "was", "wordt", "zijn"),
    "pt": ("ao", "as", "com", "da", "de", "do", "dos", "e", "em", "mais", "na", "no", "não", "o", "os", "para", "por", "que", "se", "uma"),
}

#: Scripts of languages that are told by their letters (fixed values).
SCRIPTS = {"ar": r"[؀-ۿ]", "zh": r"[一-鿿]"}

LANGUAGES = tuple(sorted((*WORDS, *SCRIPTS)))
_EDGES = ".,;:!?()\"'"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shares(text: Column, languages: tuple[str, ...] = DEFAULT_LANGUAGES) -> Column:
    """Array of (code, share): the part of the words that are frequent words of a language, or of the characters in its script."""
    words = F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.btrim(w, F.lit(_EDGES))), lambda w: F.length(w) > 0)
    letters = F.length(F.regexp_replace(text, r"\s", ""))

    def share(code: str, words: Column) -> Column:
        if code in SCRIPTS:
            return F.when(letters > 0, (letters - F.length(F.regexp_replace(text, rf"\s|{SCRIPTS[code]}", ""))) / letters)
        return F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: w.isin(*WORDS[code]))) / F.size(words))

    return _let(words, lambda ws: F.array(*[F.struct(F.lit(c).alias("code"), F.coalesce(share(c, ws), F.lit(0.0)).alias("share")) for c in sorted(languages)]))


def detect(text: Column, languages: tuple[str, ...] = DEFAULT_LANGUAGES, shortest: int = SHORTEST) -> Column:
    """struct(lang, confidence, candidates): the best language, its part of all shares, and the three best codes.

    Texts below ``shortest`` characters, and those with no share of any language, are unknown.
    """
    enough = F.coalesce(F.length(text) >= shortest, F.lit(False))

    def of(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda a, x: a + x["share"])
        best = F.slice(F.array_sort(F.transform(F.filter(found, lambda x: x["share"] > 0), lambda x: F.struct((-x["share"]).alias("down"), x["code"].alias("code")))), 1, 3)
        known = enough & (total > 0)
        top = F.try_element_at(best, F.lit(1))
        return F.struct(
            F.when(known, top["code"]).otherwise("unknown").alias("lang"),
            F.when(known, F.round(-top["down"] / total, 4)).otherwise(0.0).alias("confidence"),
            F.when(known, F.transform(best, lambda x: x["code"])).otherwise(F.array().cast("array<string>")).alias("candidates"),
        )

    return _let(shares(text, languages), of)
