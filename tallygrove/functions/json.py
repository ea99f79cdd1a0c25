"""Values out of JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nested(c: Column, path: str, kind: str, default) -> Column:
    """The value at a path, or the default where text or path is missing or of another type."""
    return F.coalesce(F.get_json_object(c, path).try_cast(kind), F.lit(default).cast(kind))


def parsed_or_text(c: Column, schema: str) -> Column:
    """Parsed if it looks like JSON, else null."""
    return F.when(F.trim(c).rlike(r"^[\[{]"), F.from_json(c, schema))


def source_of(raw: Column) -> Column:
    """(name, publisher, issn) of a work's primary location."""
    base = "$.primary_location.source"
    issn = F.coalesce(F.get_json_object(raw, f"{base}.issn[0]"), F.get_json_object(raw, f"{base}.issn"))
    return F.struct(
        F.coalesce(F.get_json_object(raw, f"{base}.display_name"), F.lit("[No source]")).alias("name"),
        F.coalesce(F.get_json_object(raw, f"{base}.host_organization_name"), F.lit("")).alias("publisher"),
        F.coalesce(issn, F.lit("")).alias("issn"),
    )
