"""Page-set algebra on tables of pages: one row a page, numbered from 1 within its document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_range(n: Column, start: Column, end: Column) -> Column:
    """Page numbers of [start, end] within 1..n; an end below 1 means the last page. Null where none is left."""
    first = F.greatest(start, F.lit(1))
    last = F.when(end <= 0, n).otherwise(F.least(end, n))
    return F.when(first <= last, F.sequence(first, last))


def complement(n: Column, keep: Column) -> Column:
    return F.when(n >= 1, F.array_except(F.sequence(F.lit(1), n), keep)).otherwise(F.array().cast("array<int>"))


def renumber(pages: DataFrame, doc: str, *order: str, to: str = "pagenum") -> DataFrame:
    return pages.withColumn(to, F.row_number().over(Window.partitionBy(doc).orderBy(*order)))


def text_of(pages: DataFrame, doc: str, page: str, text: str, separator: str = "") -> DataFrame:
    """(doc, text): the pages' texts in order. A document's pages meet in one row."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(page), F.col(text))))
    return pages.groupBy(doc).agg(F.array_join(F.transform(rows, lambda x: x[text]), separator).alias("text"))


def between(pages: DataFrame, page: str, start: int, end: int) -> DataFrame:
    return pages.where(F.col(page).between(start, end))


def delete(pages: DataFrame, doc: str, page: str, gone: DataFrame) -> DataFrame:
    """Without the pages of ``gone`` (doc, page), numbered anew."""
    left = pages.join(gone.select(doc, page).distinct(), [doc, page], "left_anti")
    return renumber(left, doc, page, to="new_page")


def extract(pages: DataFrame, doc: str, page: str, keep: DataFrame) -> DataFrame:
    """Only the pages of ``keep``, in document order whatever its order."""
    return renumber(pages.join(keep.select(doc, page).distinct(), [doc, page], "left_semi"), doc, page, to="new_page")


def concatenate(parts: list[DataFrame], page: str) -> DataFrame:
    """The parts' rows with ``part`` (their place) and ``page`` counting through; parts share their columns."""
    out = None
    for i, df in enumerate(parts):
        one = df.withColumn("part", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def insert(pages: DataFrame, doc: str, page: str, other: DataFrame, at: int) -> DataFrame:
    """The rows of ``other`` (same columns) go before page ``at``; pages are numbered anew as ``new_page``."""
    own = pages.withColumn("_k", F.when(F.col(page) < at, 0).otherwise(2))
    mixed = own.unionByName(other.withColumn("_k", F.lit(1)))
    return renumber(mixed, doc, "_k", page, to="new_page").drop("_k")
