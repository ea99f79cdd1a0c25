"""Partitioning a search whose answers are bounded, and putting the parts together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first
from .search import date_ranges

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
HALVES = {"H1": MONTHS[:6], "H2": MONTHS[6:]}
MOST = 5000


@dataclass(frozen=True)
class Scope:
    """Conditions on columns that all hold: a value, or for ``without`` none of some values."""

    equal: tuple[tuple[str, object], ...] = ()
    without: tuple[tuple[str, tuple], ...] = ()
    dates: tuple | None = None

    def having(self, column: str, value) -> Scope:
        return Scope((*self.equal, (column, value)), self.without, self.dates)

    def lacking(self, column: str, values: tuple) -> Scope:
        return Scope(self.equal, (*self.without, (column, values)), self.dates)

    def within(self, dates: tuple) -> Scope:
        return Scope(self.equal, self.without, dates)

    @property
    def name(self) -> str:
        marks = [str(value) for _, value in self.equal] + ["other" for _ in self.without] + [str(d) for d in self.dates or ()]
        return "_".join(marks).lower()

    def predicate(self):
        """The scope as a condition; a null value is none of any values."""
        out = F.lit(True)
        for column, value in self.equal:
            out = out & (F.col(column) == value)
        for column, values in self.without:
            out = out & ~F.coalesce(F.col(column).isin(*values), F.lit(False))
        return out


def partition(count: Callable[[Scope], int], scope: Scope, splits: list[tuple[str, tuple]], most: int = MOST, dates: tuple | None = None) -> Iterator[tuple[Scope, int]]:
    """Disjoint scopes that cover ``scope``, of at most ``most`` rows where splitting can do it, with their rows.

    ``splits`` are tried in order on what is too large: one part for each value,
    one for all others.  What is still too large is halved by load dates, if
    ``dates`` (first, last) are given.  Empty parts are left out.
    """
    rows = count(scope)
    if rows == 0:
        return
    if rows <= most:
        yield scope, rows
    elif splits:
        (column, values), rest = splits[0], splits[1:]
        for value in values:
            yield from partition(count, scope.having(column, value), rest, most, dates)
        yield from partition(count, scope.lacking(column, tuple(values)), rest, most, dates)
    elif dates is None:
        yield scope, rows
    else:
        for a, b in date_ranges(lambda a, b: count(scope.within((a, b))), *dates, most):
            yield scope.within((a, b)), count(scope.within((a, b)))


def yearly(count: Callable[[Scope], int], first_year: int, last_year: int, kinds: tuple = (), areas: tuple = (), most: int = MOST, dates: Callable[[int], tuple] | None = None) -> list[tuple[Scope, int]]:
    """Years, split by month, document type, subject area and load date as far as needed."""
    splits = [s for s in (("month", MONTHS), ("kind", kinds), ("area", areas)) if s[1]]
    return [part for year in range(first_year, last_year + 1) for part in partition(count, Scope((("year", year),)), splits, most, dates(year) if dates else None)]


def half_years(area: str, first_year: int, last_year: int) -> list[tuple[str, str, int, tuple]]:
    """(name, area, year, months) of each half of each year, and of what has no month (no months)."""
    return [(f"{area}_{year}_{half}".lower(), area, year, months) for year in range(first_year, last_year + 1) for half, months in (*HALVES.items(), ("undated", ()))]


def counted(rows: DataFrame, columns: list[str]) -> Callable[[Scope], int]:
    """A count of scopes from one pass over ``rows``: what comes to the driver is one row for each combination of values."""
    cells = rows.groupBy(*columns).agg(F.count("*").alias("n")).collect()

    def count(scope: Scope) -> int:
        return sum(c["n"] for c in cells if all(c[k] == v for k, v in scope.equal) and not any(c[k] in values for k, values in scope.without))

    return count


@dataclass
class Gathered:
    """What the parts of one search came to."""

    rows: DataFrame
    metadata: dict = field(default_factory=dict)


def gather(parts: list[DataFrame], key: str, name: str, query: str, first_year: int, last_year: int, exclusions: list[str] | None = None) -> Gathered:
    """All parts in one table, one row for each key (that of the earliest part), and a description of the search."""
    marked = [part.withColumn("_part", F.lit(i)) for i, part in enumerate(parts)]
    whole = marked[0]
    for part in marked[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    rows = first(whole, [key], ["_part"]).drop("_part")
    return Gathered(rows, {"name": name, "query": query, "start_year": first_year, "end_year": last_year, "total_documents": rows.count(), "exclusions": exclusions or []})
