"""Deterministic identifiers, all from SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioloom.functions.text import ascii_only, nfkc, strip


def slug(filename: Column) -> Column:
    """A file name's stem in lower-case ASCII, other characters as single dashes."""
    stem = F.regexp_replace(F.substring_index(filename, "/", -1), r"(?<=.)\.[^.]*\z", "")
    return F.regexp_replace(F.regexp_replace(F.lower(ascii_only(stem)), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def doc_id(filename: Column, sha: Column) -> Column:
    return F.concat_ws("-", slug(filename), F.substring(sha, 1, 12))


def text_hash(text: Column) -> Column:
    return F.sha2(strip(nfkc(text)), 256)


def short_hash(*parts: Column, n: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, n)


def block_id(doc: Column, page: Column, bbox: Column, kind: Column, hash_: Column) -> Column:
    return short_hash(doc, page, bbox, kind, hash_)


def chunk_id(doc: Column, index: Column) -> Column:
    """By place, not by content: an unchanged place keeps its id."""
    return short_hash(doc, F.lit("chunk"), index)


def page_hash(block_hashes: Column) -> Column:
    """Of an array of block hashes, in any order."""
    return F.sha2(F.array_join(F.array_sort(block_hashes), "|"), 256)


def page_bbox(width: Column, height: Column) -> Column:
    return F.concat(F.lit("0.0,0.0,"), F.format_string("%.1f", width), F.lit(","), F.format_string("%.1f", height))
