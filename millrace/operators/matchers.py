"""Label matchers and their normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHERS = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "=~": lambda c, v: c.rlike(f"^(?:{v})$"),
    "!~": lambda c, v: ~c.rlike(f"^(?:{v})$"),
}


def matching(rows: DataFrame, *matchers: tuple[str, str, str]) -> DataFrame:
    """Rows that pass all (label, one of = != =~ !~, value); patterns match the whole label. A missing label is empty."""
    for label, kind, value in matchers:
        rows = rows.filter(MATCHERS[kind](F.coalesce(F.col(label).cast("string"), F.lit("")), value))
    return rows


def normal_filter(text: str) -> str:
    """A filter text without braces, its parts stripped and sorted."""
    return ",".join(sorted(p.strip() for p in text.strip().strip("{}").split(",") if p.strip()))


def normal_filters(text: Column) -> Column:
    """normal_filter of a column of filter texts."""
    parts = F.split(F.regexp_replace(F.trim(text), r"^[{}]+|[{}]+$", ""), ",")
    return F.array_join(F.array_sort(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")), ",")
