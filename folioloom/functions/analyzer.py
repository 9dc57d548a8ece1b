"""Analysers of text for search: ``simple`` (JVM expressions) and ``english`` (with a stemmer)."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that queries and postings leave out (fixed values).
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no nor not of on or our she so "
    "such than that the their them then there these they this to was we were what when which who will with you your"
).split()


def simple_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits without stop words, repeats kept."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 0) & ~w.isin(STOP_WORDS))


def simple_terms_of(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in set(STOP_WORDS)]


_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _region(word: str, start: int) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in _VOWEL and word[i - 1] in _VOWEL:
            return i + 1
    return len(word)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-3] not in _VOWEL and w[-2] in _VOWEL and w[-1] not in _VOWEL + "wxY"


#: Suffixes of the later steps and what replaces them (fixed values of the published algorithm).
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": ""}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The English (Porter 2) stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.lstrip("'")
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWEL) else c for i, c in enumerate(w))
    for prefix in ("gener", "commun", "arsen"):
        if w.startswith(prefix):
            r1 = len(prefix)
            break
    else:
        r1 = _region(w, 0)
    r2 = _region(w, r1)
    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w.endswith(("eedly", "eed")):
        e = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e := _longest(w, ("ingly", "edly", "ing", "ed")):
        base = w[: -len(e)]
        if any(c in _VOWEL for c in base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLE):
                w = w[:-1]
            elif r1 >= len(w) and _short_end(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    if (e := _longest(w, _STEP2)) and len(w) - len(e) >= r1:
        base = w[: -len(e)]
        if e == "li":
            w = base if base[-1:] in tuple("cdeghkmnrt") else w
        elif e != "ogi" or base.endswith("l"):
            w = base + _STEP2[e]
    if (e := _longest(w, _STEP3)) and len(w) - len(e) >= r1 and (e != "ative" or len(w) - len(e) >= r2):
        w = w[: -len(e)] + _STEP3[e]
    if (e := _longest(w, _STEP4)) and len(w) - len(e) >= r2 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def stemmed(words: pa.Array) -> pa.Array:
    """Lists of stems of lists of words; of a batch, only its different words are ever Python objects."""
    flat = words.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0).cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, stems.take(flat.indices), mask=words.is_null())


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_all(words: pa.Array) -> pa.Array:
    return stemmed(words)


def english_terms(text: Column) -> Column:
    return stem_all(simple_terms(text))


def query_terms(text: str, analyser: str = "simple") -> list[str]:
    """Distinct terms of a query, in order."""
    words = simple_terms_of(text)
    return list(dict.fromkeys(map(stem, words) if analyser == "english" else words))


def terms(text: Column, analyser: str = "simple") -> Column:
    return english_terms(text) if analyser == "english" else simple_terms(text)
