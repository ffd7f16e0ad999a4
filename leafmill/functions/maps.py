"""Document information and metadata maps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREDEFINED = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Trapped")


def first_wins(entries: Column) -> Column:
    """A map of (key, value) pairs in which the first of equal keys stays, and nulls are no keys."""
    kept = F.filter(entries, lambda e, i: e["key"].isNotNull() & (F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1))
    return F.map_from_entries(kept)


def put(m: Column, key: Column | str, value: Column) -> Column:
    key = F.lit(key) if isinstance(key, str) else key
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(key, value))


def remove(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def get(m: Column, key: str) -> Column:
    return F.try_element_at(m, F.lit(key))


def clear_custom(m: Column) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*PREDEFINED))


def swapped(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))


def canonical(m: Column) -> Column:
    """key<TAB>value lines in the order of keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("\t"), e["value"])), "\n")
