"""Colours as column expressions: device families to sRGB, and quantisation to bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """Into [0, 1]; NaN counts as 0 (it sorts above all numbers in Spark, so it is tested first)."""
    return F.when(F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def gray_to_srgb(g: Column) -> Column:
    return rgb(clamp01(g), clamp01(g), clamp01(g))


def rgb_to_srgb(r: Column, g: Column, b: Column) -> Column:
    return rgb(clamp01(r), clamp01(g), clamp01(b))


def cmyk_to_srgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    white = 1 - clamp01(k)
    return rgb((1 - clamp01(c)) * white, (1 - clamp01(m)) * white, (1 - clamp01(y)) * white)


def to_srgb(family: Column, parts: Column) -> Column:
    """``parts`` holds the components; another number of them than the family's raises an error."""
    at = lambda i: F.get(parts, F.lit(i))
    wrong = F.raise_error(F.concat(F.lit("components don't fit the colour family "), family)).cast("struct<r: double, g: double, b: double>")
    return (
        F.when((family == "gray") & (F.size(parts) == 1), gray_to_srgb(at(0)))
        .when((family == "rgb") & (F.size(parts) == 3), rgb_to_srgb(at(0), at(1), at(2)))
        .when((family == "cmyk") & (F.size(parts) == 4), cmyk_to_srgb(at(0), at(1), at(2), at(3)))
        .otherwise(wrong)
    )


def quantize(x: Column) -> Column:
    return F.floor(clamp01(x) * 255 + 0.5).cast("int")


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(x), 2, "0") for x in (r, g, b)))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Whole-number luma of bytes."""
    return F.floor((299 * r + 587 * g + 114 * b + 500) / 1000).cast("int")
