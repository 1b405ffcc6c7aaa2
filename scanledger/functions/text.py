"""Query text: truncation, the dataset it names, and tag headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanledger.functions.identity import UNKNOWN

# The first dataset after FROM, and the header lines that tag a query.
FROM_DATASET = r"(?i)FROM\s+`?([a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+)`?"
TAG_LINES = {
    "project": "Query for project",
    "team": "Team",
    "owner": "Owner",
    "purpose": "Purpose",
    "query_id": "Query ID",
    "query_type": "Query Type",
}


def truncated(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def qualified(*parts: Column) -> Column:
    """Parts joined by dots; NULL when a part is NULL."""
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit("."), part]
    return F.concat(*pieces)


def dataset_in_text(text: Column) -> Column:
    """Dataset named after the first matching FROM, else 'Unknown'."""
    found = F.nullif(F.regexp_extract(text, FROM_DATASET, 1), F.lit(""))
    return F.coalesce(found, F.lit(UNKNOWN))


def tag(text: Column, name: str) -> Column:
    """Value of one tag line of the query's header, NULL when it has none."""
    found = F.regexp_extract(text, f"-- {TAG_LINES[name]}: ([^\\n]+)", 1)
    return F.nullif(found, F.lit(""))


def tag_header(**tags: Column) -> Column:
    """Header text for the given tags; lines whose value is NULL are left out."""
    lines = [
        F.concat(F.lit(f"-- {label}: "), tags[name], F.lit("\n"))
        for name, label in TAG_LINES.items()
        if name in tags
    ]
    return F.concat(*[F.coalesce(line, F.lit("")) for line in lines])


def tagged(text: Column, **tags: Column) -> Column:
    return F.concat(tag_header(**tags), text)
