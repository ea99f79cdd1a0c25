"""Identifiers, names, tokens and numbers as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DOI_PREFIX = "https://doi.org/"
#: A word as Unicode sees it; both engines agree on this class, not on \w.
TOKEN = r"[\p{L}\p{N}_]+"


def slug(name: str) -> str:
    return name.strip().replace(" ", "_").lower()


def slug_column(c: Column) -> Column:
    return F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("_")))


def short_hash(c: Column, n: int = 8) -> Column:
    return F.substring(F.md5(c.cast("string")), 1, n)


def doi_url(c: Column) -> Column:
    """Trimmed, lower case, with the resolver's prefix; null for an empty one."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^https?://(dx\.)?doi\.org/", "")
    return F.when(bare != "", F.concat(F.lit(DOI_PREFIX), bare))


def identifier_tail(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def short_author(name: Column) -> Column:
    """Family name and first initial; a single name as it is."""
    parts = F.filter(F.split(name, r"\s+"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, -1), F.lit(" "), F.substring(F.element_at(parts, 1), 1, 1), F.lit("."))).otherwise(name)


def safe_join(items: Column, separator: str = "; ") -> Column:
    """Non-null, non-blank items, trimmed; '' for null."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_join(clean, separator), F.lit(""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def has_token(text: Column, term: str) -> Column:
    """ASCII-delimited token, as column stores have it."""
    return F.coalesce(F.array_contains(F.split(F.lower(text), "[^a-z0-9]+"), term.lower()), F.lit(False))


def wildcard_pattern(term: str) -> str:
    """``*`` any run, ``?`` one character, word edges on both sides unless the term ends in ``*``.

    Edges are written out, since \\b differs between engines beyond ASCII.
    """
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in term.lower())
    return r"(^|[^\p{L}\p{N}_])" + body + ("" if body.endswith(".*") else r"([^\p{L}\p{N}_]|$)")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)
