"""Text functions as columns. Built-in expressions wherever Spark has them; pandas
or Arrow functions only for Unicode normalisation and places of matches, which Spark lacks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def without_marks(s: pd.Series) -> pd.Series:
    """Canonical decomposition without its combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


@F.pandas_udf(T.StringType())
def ascii_only(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, characters beyond ASCII dropped."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def strip(c: Column) -> Column:
    """White space off both ends, Unicode's included. Only a text that has some there is searched."""
    space = r"(?U)^\s"
    ends = F.substring(c, 1, 1).rlike(space) | F.substring(c, -1, 1).rlike(space)
    return F.when(ends, F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")).otherwise(c)


def clean_text(c: Column) -> Column:
    """NFKC; soft hyphens and zero-width characters out; hyphens unified; blanks collapsed, lines kept."""
    t = F.regexp_replace(nfkc(c), r"[\u00AD\u200B\u200C\u200D]", "")
    t = F.regexp_replace(t, r"[\u2010\u2011]", "-")
    return strip(F.regexp_replace(t, r"(?U)[^\S\n]+", " "))


def best_text(clean: Column, raw: Column) -> Column:
    """The cleaned text unless it is empty or missing."""
    return F.when(F.length(clean) > 0, clean).otherwise(raw)


def dehyphenate(c: Column) -> Column:
    """Words broken at a line end are joined."""
    return F.regexp_replace(c, r"-\n([a-z])", "$1")


def superscript_refs(c: Column) -> Column:
    """``<sup>17a</sup>`` and ``\\(^{91}\\)`` become ``(17a)`` and ``(91)``."""
    t = F.regexp_replace(c, r"<sup>(\d+[a-z]?)</sup>", "($1)")
    return F.regexp_replace(t, r"\\\(\^\{(\d+[a-z]?)\}\\\)", "($1)")


def strip_diacritics(c: Column, lang: Column) -> Column:
    """Marks off letters, in English text alone."""
    return F.when(lang == "en", without_marks(c)).otherwise(c)


def remove_script_intrusions(c: Column, lang: Column) -> Column:
    """Stray Cyrillic, CJK and Arabic characters out of English text."""
    t = F.regexp_replace(c, r"[\u0400-\u04FF\u4E00-\u9FFF\uF900-\uFAFF\u0600-\u06FF]+", "")
    return F.when(lang == "en", strip(F.regexp_replace(t, " {2,}", " "))).otherwise(c)


def frequency_key(c: Column, fold: bool = True) -> Column:
    """A line as it is counted: folded case, leading and trailing numbers out, blanks collapsed.

    ``fold=False`` uses ``lower``, which differs from case folding in a few letters (ß).
    """
    t = casefold(c) if fold else F.lower(c)
    t = F.regexp_replace(F.regexp_replace(t, r"^\d+\s*", ""), r"\s*\d+\z", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def word_set(c: Column) -> Column:
    """Distinct lower-case words, ASCII punctuation deleted."""
    t = F.trim(F.regexp_replace(F.translate(F.lower(c), PUNCTUATION, ""), r"\s+", " "))
    return F.when(F.length(t) > 0, F.array_distinct(F.split(t, " "))).otherwise(F.array().cast("array<string>"))


def estimate_tokens(c: Column) -> Column:
    """Tokens of a text, about: a quarter of its characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("int")


def estimate_json_tokens(chars: Column) -> Column:
    """Tokens of a request of so many characters, with a fixed surcharge."""
    return (F.floor(chars / F.lit(3.5)) + 100).cast("int")


def footnote_number(c: Column, alone: bool = False) -> Column:
    """The number that starts a footnote: ``N ``, ``(N)``, ``N. `` or ``N) ``; else null. ``alone``: also an ``N.`` that nothing follows."""
    t = strip(c)
    # the forms of a number (fixed values)
    forms = (r"^(\d{1,3})\s", r"^\((\d{1,3})\)\s*", r"^(\d{1,3})\.\s", r"^(\d{1,3})\)\s", *([r"^(\d{1,3})\.\z"] if alone else []))
    found = [F.regexp_extract(t, p, 1) for p in forms]
    return F.coalesce(*[F.when(x != "", x.cast("int")) for x in found])


#: Signs of a citation in a footnote (fixed values).
CITATION_SIGNS = (
    r"\b[A-Z][a-z]+\s*\(\d{4}(?:[a-z])?(?::\s*[\d\-–—,\s]+)?\)",
    r"\bCO\s*\d+/\d+",
    r"\bFO\s*\d+/\d+",
    r"\b(?:SSF|SSFR)\b",
    r"\bBL/APAC/",
    r"\bIOR\b",
    r"\bHSL\s*\d+\.\d+",
    r"(?i)\bIbid\.?\b",
    r"(?i)\bop\.\s*cit\.?\b",
    r"(?i)\bloc\.\s*cit\.?\b",
    r"(?i)\bNote\s+\d+\s+above\b",
    r"\bSee\s+(?:also\s+)?(?:fn\.?\s*\d+|[A-Z][a-z]+)",
    r"\bcf\.?\s+[A-Z]",
    r"(?i)\b(?:Malaya Tribune|Straits Times|Nanyang Siang Pau|The Sun)\b",
    r",\s*\d{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}",
    r"\bSSD\s*,",
    r"\bSSJ\s*,",
    r"['’]s\s+(?:journal|diary)\b",
    r"Annual\s+Report\s+\d{4}",
    r"National\s+Archives\b",
    r"https?://",
    r"\baccessed\s+\d{1,2}\s+\w+\s+\d{4}",
    r"(?i)\bpersonal\s+communication\b",
)


#: Any of the signs, in one scan; flags of a sign hold for it alone.
_ANY_SIGN = "|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for p in CITATION_SIGNS)


def footnote_type(c: Column) -> Column:
    """``explanatory`` without a sign of citation; ``citation`` if at most 8 words remain without them; else ``mixed``.

    One scan finds whether there is a sign; only texts with one are taken apart.
    """
    body = F.regexp_replace(strip(c), r"^\d{1,3}[\s.)]+", "")  # the number before a footnote (fixed value)
    rest = body
    for p in CITATION_SIGNS:
        rest = F.regexp_replace(rest, p, "")
    rest = F.trim(F.regexp_replace(rest, r"[\s.,;:()\[\]'\"-]+", " "))
    left = F.when(F.length(rest) > 0, F.size(F.split(rest, " "))).otherwise(0)
    return F.when(~body.rlike(_ANY_SIGN), "explanatory").when(left <= 8, "citation").otherwise("mixed")


#: Footnote references in running text: name, pattern, group of the number (fixed values).
REF_PATTERNS = (
    ("regex_superscript", r"([A-Za-z\)])(\d{1,2})(\s|[.,;:])", 2),
    ("regex_period_superscript", r"([A-Za-z])\.(\d{1,2})(\s|[A-Z]|[.,;:])", 2),
    ("regex_space_superscript", r"([.)\]])\s(\d{1,3})(?:\s|$)", 2),
    ("regex_parens", r"\((\d{1,2})\)", 1),
    ("regex_brackets", r"\[(\d{1,2})\]", 1),
)


_REFS = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("pattern_no", T.IntegerType()), ("match_no", T.IntegerType()), ("match_type", T.StringType()), ("number", T.IntegerType()), ("snippet", T.StringType()))]))


def find_refs(c: Column, around: int | None = 20) -> Column:
    """Array of (pattern_no, match_no, match_type, number, snippet) of all patterns' matches, in that order.

    The snippet is the match with up to ``around`` characters on both sides; None leaves it out. Spark's functions
    tell no places of matches, so that texts are scanned in Arrow batches, once a pattern.
    """
    return _cut_refs(c, F.lit(around).cast("int"))


@F.arrow_udf(_REFS)
def _cut_refs(text: pa.Array, around: pa.Array) -> pa.Array:
    # white space and digits are ASCII's
    patterns = [(name, re.compile(p, re.ASCII), g) for name, p, g in REF_PATTERNS]
    reach = around[0].as_py() if len(around) else None
    ends, rows = [0], []
    for t in text.to_pylist():
        for no, (name, pattern, group) in enumerate(patterns if t else ()):
            for i, m in enumerate(pattern.finditer(t)):
                rows.append((no, i, name, int(m.group(group)), None if reach is None else t[max(m.start() - reach, 0) : m.end() + reach]))
        ends.append(len(rows))
    kinds = {"pattern_no": pa.int32(), "match_no": pa.int32(), "match_type": pa.string(), "number": pa.int32(), "snippet": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    made = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)


def ref_markup(text: Column, refs: Column) -> Column:
    """``word43`` becomes ``word [ref:43]`` for each of ``refs``, (match_type, number), higher numbers first."""
    wanted = F.filter(refs, lambda r: ~r["match_type"].startswith("regex_parens") & ~r["match_type"].startswith("regex_brackets"))
    down = F.reverse(F.array_sort(F.transform(wanted, lambda r: F.struct(r["number"].alias("number"), r["match_type"].alias("match_type")))))

    def apply(t: Column, r: Column) -> Column:
        n, kind = r["number"].cast("string"), r["match_type"]
        # what stands before and after a reference of each kind (fixed values)
        space = kind.startswith("regex_space")
        before = F.when(kind.startswith("regex_period"), r"([A-Za-z])\.").when(space, r"([.)\]])\s").otherwise(r"([A-Za-z\)])")
        after = F.when(kind.startswith("regex_period"), r"(?=\s|[A-Z]|[.,;:]|$)").when(space, r"(?=\s|$)").otherwise(r"(?=\s|[.,;:]|$)")
        return F.regexp_replace(t, F.concat(before, n, after), F.concat(F.lit("$1 [ref:"), n, F.lit("]")))

    return F.aggregate(down, text, apply)


def clean_title(c: Column) -> Column:
    """Emphasis and code fences off, the first line that isn't empty."""
    t = F.regexp_replace(c, r"\*{1,2}(.+?)\*{1,2}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"^```(?:markdown)?\s*", ""), r"```\s*\z", "")
    lines = F.filter(F.transform(F.split(t, r"\r\n|\n|\r"), lambda x: strip(x)), lambda x: F.length(x) > 0)
    return F.coalesce(F.try_element_at(lines, F.lit(1)), strip(t))


def strip_link_tail(c: Column) -> Column:
    """A Markdown link's ``](http…)`` off the end of a value."""
    return F.regexp_replace(c, r"\]\(https?://[^\s)]+\)\z", "")


def filename_author(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"^(.+?)\s*\((\d{4})\)", 1))


def filename_year(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.+?)\s*\((\d{4})\)", 2)


#: Labels of document types (fixed values).
TYPE_LABELS = {
    "journal_article": "Journal Article",
    "primary_source": "Primary Source",
    "secondary_source": "Secondary Source",
    "front_matter": "Front Matter",
    "obituary": "Obituary",
    "editors_note": "Editor's Note",
    "illustration": "Illustration",
    "annual_report": "Annual Report",
    "agm_minutes": "AGM Minutes",
    "biographical_notes": "Biographical Notes",
    "mbras_monograph": "MBRAS Monograph",
    "mbras_reprint": "MBRAS Reprint",
    "index": "Index",
}


def type_label(c: Column) -> Column:
    """`` [Journal Article]`` for a known type, `` [x]`` for another, nothing for none."""
    labels = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "").otherwise(F.concat(F.lit(" ["), F.coalesce(F.try_element_at(labels, c), c), F.lit("]")))


#: Society and journal names with their short forms, longest first (fixed values).
SOCIETIES = (
    (r"(?i)Journal of the (Malaysian|Malayan) Branch of the Royal Asiatic Society", "JMBRAS"),
    (r"(?i)Journal of the Straits Branch of the Royal Asiatic Society", "JSBRAS"),
    (r"(?i)(Malaysian|Malayan) Branch of the Royal Asiatic Society", "MBRAS"),
    (r"(?i)Straits Branch of the Royal Asiatic Society", "JSBRAS"),
)


def citation_clean(c: Column) -> Column:
    t = strip(F.replace(F.coalesce(c, F.lit("")), F.lit("*"), F.lit("")))
    for pattern, short in SOCIETIES:
        t = F.regexp_replace(t, pattern, short)
    return t


def asset_path(c: Column) -> Column:
    """The part from ``assets/`` on, else ``assets/`` and the file's name."""
    at = F.instr(c, "assets/")
    return F.when(c.isNull() | (c == ""), c).when(at > 0, F.substring(c, at, F.length(c))).otherwise(F.concat(F.lit("assets/"), F.substring_index(c, "/", -1)))


def strip_think(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<think>.*?</think>\s*", "")


def strip_code_fence(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```\z", ""))


def rotation_hint(c: Column) -> Column:
    """Degrees from a description's ending ``|rotate90cw`` (90) or ``|rotate90ccw`` (270); else 0."""
    return F.when(c.endswith("|rotate90ccw"), 270).when(c.endswith("|rotate90cw"), 90).otherwise(0)


def page_range(c: Column) -> Column:
    """(first, last) of a label such as ``57-61`` (any dash) or ``42``; else null.

    A range may have anything after it; a single page may not.
    """
    t = strip(c)
    # a range, or one page (fixed values)
    a, b = (F.regexp_extract(t, r"^(\d+)\s*[-–—]\s*(\d+)", i) for i in (1, 2))
    one = F.regexp_extract(t, r"^(\d+)$", 1)
    return F.when(a != "", F.struct(a.cast("int").alias("first"), b.cast("int").alias("last"))).when(one != "", F.struct(one.cast("int").alias("first"), one.cast("int").alias("last")))
