"""Boolean search queries: a recursive reader, and predicates over text columns.

A query is one string, so it is read on the driver; what comes out are Column
predicates that run in the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, wildcard_pattern

# The text fields of the query syntax.
FIELDS = ("TITLE-ABS-KEY", "TITLE", "ABS", "KEY")
#: Rules that name one of these are judged on title and abstract alone.
ANIMALS = ("murine", "rodent", "mouse")
# The code fields, what a code of each is made of, and the area whose rules are about animals.
CODES = {"SUBJTERMS": str.isdigit, "SUBJAREA": str.isalpha}
VETERINARY = "SUBJAREA(VETE)"


@dataclass
class Exclusion:
    exclude: list[str] = field(default_factory=list)
    reinclude: list[str] = field(default_factory=list)
    veterinary: bool = False

    @property
    def animal(self) -> bool:
        return self.veterinary or any(a in t.lower() for t in self.exclude for a in ANIMALS)


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    codes: list[str] = field(default_factory=list)
    exclusions: list[Exclusion] = field(default_factory=list)


def _depths(text: str) -> Iterator[tuple[int, int]]:
    """Each place and the number of parentheses open before it."""
    depth = 0
    for i, ch in enumerate(text):
        yield i, depth
        depth += (ch == "(") - (ch == ")")


def split_and_not(text: str, depths: tuple[int, ...] = (1, 2)) -> list[str]:
    """Parts between AND NOT, where it stands at one of the depths."""
    cuts, after = [], 0
    depth = dict(_depths(text))
    for m in re.finditer(r"and[ \n\r]not\s*", text, re.IGNORECASE):
        if m.start() >= after and depth[m.start()] in depths:
            cuts.append(m.span())
            after = m.end()
    edges = [0, *[x for span in cuts for x in span], len(text)]
    parts = [text[a:b].strip() for a, b in zip(edges[::2], edges[1::2])]
    return parts if parts[-1] or not cuts else parts[:-1]


def field_contents(text: str, name: str) -> list[str]:
    """What stands in each balanced NAME(...)."""
    found = []
    for m in re.finditer(rf"\b{re.escape(name)}\s*\(", text, re.IGNORECASE):
        end = next((i for i, depth in _depths(text[m.end() :]) if depth == 0 and text[m.end() + i] == ")"), None)
        if end is not None:
            found.append(text[m.end() : m.end() + end].strip())
    return found


def split_or(text: str) -> list[str]:
    """Alternatives at the top level, without the quotes around them."""
    depth = dict(_depths(text))
    edges = [0]
    for m in re.finditer(r"[ \n\r]or(?= )|or(?=\n)", text, re.IGNORECASE):
        if depth[m.start()] == 0 and m.start() >= edges[-1]:
            edges += [m.start(), m.end()]
    edges.append(len(text))
    out = []
    for a, b in zip(edges[::2], edges[1::2]):
        term = text[a:b].strip()
        if len(term) > 1 and term[0] == term[-1] and term[0] in "\"'":
            term = term[1:-1]
        if term:
            out.append(term)
    return out


def terms_in(text: str) -> list[str]:
    """Terms of all text fields, in order, once each."""
    return list(dict.fromkeys(t for name in FIELDS for c in field_contents(text, name) for t in split_or(c)))


def formatted(term: str) -> str:
    """Quotes around several words, unless they are grouped, quoted, or joined by an operator."""
    term = term.strip()
    wrapped = any(term.startswith(a) and term.endswith(b) for a, b in (("(", ")"), ('"', '"')))
    operator = re.search(r" (W/|PRE/|AND |OR |NOT )", term.upper())
    return term if wrapped or operator or " " not in term else f'"{term}"'


def codes_in(text: str) -> list[str]:
    """FIELD(code) of all code fields; contents that are no code are passed over."""
    return [f"{name}({code})" for name, valid in CODES.items() for code in field_contents(text, name) if code.isascii() and valid(code)]


def proximity(term: str) -> tuple[str, str, int] | None:
    """Both sides and the distance of ``(a W/n b)``; None for anything else."""
    if not term.startswith("("):
        return None
    close = next((i for i, depth in _depths(term) if depth == 1 and term[i] == ")"), None)
    words = term[1:close].split() if close else []
    for i, word in enumerate(words[1:-1], 1):
        if word[:2] in ("W/", "w/") and word[2:].isdigit():
            return " ".join(words[:i]), " ".join(words[i + 1 :]), int(word[2:])
    return None


def _rule(block: str) -> Exclusion:
    """A block after AND NOT; what a second AND NOT inside it takes out is included again."""
    out, back, *_ = [*split_and_not(block), "", ""]
    return Exclusion(terms_in(out), terms_in(back), VETERINARY in map(str.upper, codes_in(out)))


def parse(text: str) -> Query:
    kept, *blocks = split_and_not(text) or [""]
    return Query(terms_in(kept), codes_in(kept), [_rule(block) for block in blocks])


# ---- predicates ---------------------------------------------------------------------------


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates) if predicates else F.lit(False)


def wildcard(text: Column, term: str) -> Column:
    return F.coalesce(F.lower(text).rlike(wildcard_pattern(term)), F.lit(False))


def _word_is(word: Column, term: str) -> Column:
    """From a token's start; ``*`` any run, ``?`` one character. A plain term is compared, not matched."""
    term = term.lower()
    if not set(term) & set("*?"):
        return word == term
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in term)
    return word.rlike("^" + body + ("" if body.endswith(".*") else "$"))


def _literal(term: str) -> str:
    """The longest run of a term that a text must hold as it is."""
    return max(re.split(r"[*?]", term.lower()), key=len)


def near(text: Column, a: str, b: str, distance: int) -> Column:
    """Two different tokens, one for each term, at most ``distance`` apart, in either order.

    Texts that lack a literal part of either term are not cut into tokens;
    places of each term are found once, and pairs are looked for in place.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    places = lambda words, term: F.filter(F.transform(words, lambda w, i: F.when(_word_is(w, term), i)), lambda i: i.isNotNull())
    both = F.transform(F.array(tokens(low)), lambda words: F.struct(places(words, a).alias("a"), places(words, b).alias("b")))
    found = F.exists(both, lambda p: F.exists(p["a"], lambda i: F.exists(p["b"], lambda j: (i != j) & (F.abs(i - j) <= distance))))
    return F.when(F.contains(low, F.lit(_literal(a))) & F.contains(low, F.lit(_literal(b))), found).otherwise(False)


def matches(text: Column, terms: list[str]) -> Column:
    """Any term. ``(a W/n b)`` is proximity; without parentheses it is that, too, but never matches."""
    found = []
    for term in (t.strip() for t in terms):
        if " W/" in term.upper():
            pair = proximity(term)
            found.append(near(text, *pair) if pair else F.lit(False))
        elif term:
            found.append(wildcard(text, term))
    return any_of(found)


def full_text(df: DataFrame, columns: tuple[str, ...]) -> Column:
    """The columns that there are, joined; null is ''."""
    parts = []
    for c in columns:
        if c in df.columns:
            value = F.array_join(c, " ") if df.schema[c].dataType.typeName() == "array" else F.col(c).cast("string")
            parts.append(F.coalesce(value, F.lit("")))
        else:
            parts.append(F.lit(""))
    return F.lower(F.concat_ws(" ", *parts))


def excluded(df: DataFrame, rules: list[Exclusion]) -> Column:
    """A rule excludes what matches it, unless its re-inclusion matches, too; the costlier test runs only on what is excluded."""
    everything, short = full_text(df, ("title", "abstract", "keywords", "concepts")), full_text(df, ("title", "abstract"))
    out = []
    for rule in rules:
        text = short if rule.animal else everything
        hit = matches(text, rule.exclude)
        out.append(F.when(hit, ~matches(text, rule.reinclude)).otherwise(False) if rule.reinclude else hit)
    return any_of(out)


def exclude(df: DataFrame, rules: list[Exclusion]) -> DataFrame:
    return df.filter(~excluded(df, rules)) if rules else df


def select(df: DataFrame, query: Query) -> DataFrame:
    """Rows with any positive term and no exclusion."""
    text = full_text(df, ("title", "abstract", "keywords", "concepts"))
    kept = df.filter(matches(text, query.terms)) if query.terms else df
    return exclude(kept, query.exclusions)


def date_ranges(counts: dict, first, last, most: int = 5000, least_days: int = 2):
    """Load-date ranges of at most ``most`` rows, or of few days: halves of halves, a day shared at each cut.

    ``counts`` is a function (first, last) -> rows.
    """
    from datetime import timedelta

    if counts(first, last) <= most or (last - first).days <= least_days:
        return [(first, last)]
    middle = first + timedelta(days=(last - first).days // 2)
    return date_ranges(counts, first, middle, most, least_days) + date_ranges(counts, middle, last, most, least_days)


def batches(terms: list[str], n: int = 30) -> list[str]:
    """Sub-queries of at most n alternatives."""
    return [" OR ".join(map(formatted, terms[i : i + n])) for i in range(0, len(terms), n)]
