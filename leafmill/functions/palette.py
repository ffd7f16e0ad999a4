"""Palette lookup as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest(r: Column, g: Column, b: Column, palette: list[tuple[int, int, int]]) -> Column:
    """The index of the nearest palette colour; of equally near ones the lowest."""
    best = [F.struct(((r - p) * (r - p) + (g - q) * (g - q) + (b - s) * (b - s)).cast("long").alias("d"), F.lit(i).alias("i")) for i, (p, q, s) in enumerate(palette)]
    return F.array_min(F.array(*best))["i"]
