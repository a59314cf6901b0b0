"""Metadata filters: one description, turned into Column predicates and semi joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchFilters:
    author: str | None = None
    format_name: str | None = None
    language: str | None = None
    category_ids: list[int] = field(default_factory=list)
    year_from: int | None = None
    year_to: int | None = None
    tag: str | None = None


def clamp_limit(limit: int) -> int:
    return max(1, min(100, int(limit)))


def check_positive(name: str, value: int) -> int:
    if value <= 0:
        raise ValueError(f"{name} must be positive")
    return value


def _given(value: str | None) -> bool:
    return bool(value and value.strip())


def book_predicate(f: SearchFilters, compat: bool = False) -> Column:
    """On columns of books. compat: the author is compared as a pattern with ASCII-only case folding."""
    out = F.lit(True)
    if _given(f.author):
        if compat:
            upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
            out &= F.translate(F.coalesce("author", F.lit("")), upper, lower).like(f"%{f.author.translate(str.maketrans(upper, lower))}%")
        else:
            out &= F.contains(F.lower(F.coalesce("author", F.lit(""))), F.lit(f.author.strip().lower()))
    if _given(f.format_name):
        out &= F.lower(F.coalesce("format_name", F.lit(""))) == f.format_name.strip().lower()
    if _given(f.language):
        out &= F.lower(F.coalesce("language", F.lit(""))) == f.language.strip().lower()
    return out


def filter_books(books: DataFrame, f: SearchFilters, book_categories: DataFrame | None = None, timeline: DataFrame | None = None, tags: DataFrame | None = None, book_tags: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """The books that pass; every condition on another table is a semi join."""
    out = books.where(book_predicate(f, compat))
    if f.category_ids and book_categories is not None:
        out = out.join(book_categories.where(F.col("category_id").isin(list(f.category_ids))).select(F.col("book_id").alias("id")), "id", "left_semi")
    if (f.year_from is not None or f.year_to is not None) and timeline is not None:
        low, high = f.year_from if f.year_from is not None else 0, f.year_to if f.year_to is not None else 9999
        hit = timeline.where((F.col("year_from") <= high) & (F.col("year_to") >= low)).select(F.col("book_id").alias("id")).distinct()
        out = out.join(hit, "id", "left_semi")
    if _given(f.tag) and tags is not None and book_tags is not None:
        named = tags.where(F.lower("name") == f.tag.strip().lower()).select(F.col("id").alias("tag_id"))
        out = out.join(book_tags.join(named, "tag_id", "left_semi").select(F.col("book_id").alias("id")), "id", "left_semi")
    return out
