"""Search filters: one value object compiled to one predicate, or columns of a table of cases."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilters:
    """All given conditions must hold: document in the list, heading path begins with the prefix, pages overlap."""

    document_ids: tuple[str, ...] | None = None
    heading_prefix: tuple[str, ...] | None = None
    page_start: int | None = None
    page_end: int | None = None

    def __post_init__(self) -> None:
        for name in ("document_ids", "heading_prefix"):
            values = getattr(self, name)
            if values is not None and (not values or any(not v.strip() for v in values)):
                raise ValueError(f"{name} must hold non-blank values")
        if self.document_ids is not None and len(set(self.document_ids)) < len(self.document_ids):
            raise ValueError("document_ids must be unique")
        for name in ("page_start", "page_end"):
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or value < 1):
                raise ValueError(f"{name} must be a positive page")
        if self.page_start is not None and self.page_end is not None and self.page_end < self.page_start:
            raise ValueError("page_end must not be before page_start")

    def predicate(self, row: str = "") -> Column:
        """The condition on the columns of chunks (under ``row`` if they are in a struct); true if nothing is given."""

        def col(name: str) -> Column:
            return F.col(f"{row}.{name}" if row else name)

        tests = []
        if self.document_ids is not None:
            tests.append(col("document_id").isin(*self.document_ids))
        if self.heading_prefix is not None:
            tests.append(F.slice(col("heading_path"), 1, len(self.heading_prefix)) == F.array(*map(F.lit, self.heading_prefix)))
        if self.page_start is not None:
            tests.append(col("page_end") >= self.page_start)
        if self.page_end is not None:
            tests.append(col("page_start") <= self.page_end)
        return reduce(Column.__and__, tests, F.lit(True))


def matches(filters: Column, document_id: Column, heading_path: Column, page_start: Column, page_end: Column) -> Column:
    """The same condition with the filters in a struct column; null filters and null fields ask for nothing."""
    documents, prefix = filters["document_ids"], filters["heading_prefix"]
    tests = [
        documents.isNull() | F.array_contains(documents, document_id),
        prefix.isNull() | (F.slice(heading_path, 1, F.greatest(F.size(prefix), F.lit(0))) == prefix),
        filters["page_start"].isNull() | (page_end >= filters["page_start"]),
        filters["page_end"].isNull() | (page_start <= filters["page_end"]),
    ]
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))
