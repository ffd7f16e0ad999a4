"""Text layout and interpolation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(text: Column, width: int) -> Column:
    """Lines of at most ``width`` characters, filled greedily; a single wider word is a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def step(acc: Column, w: Column) -> Column:
        fits = F.length(acc["line"]) + F.when(acc["line"] == "", 0).otherwise(1) + F.length(w) <= width
        grown = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        done = F.when(acc["line"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"]))
        return F.when(fits | (acc["line"] == ""), F.struct(acc["lines"].alias("lines"), grown.alias("line"))).otherwise(F.struct(done.alias("lines"), w.alias("line")))

    return F.aggregate(words, start, step, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.array_append(acc["lines"], acc["line"])))


def stitched(t: Column, low: float, high: float, bounds: list[float], values: list[tuple[float, float]]) -> Column:
    """A function stitched of linear parts: ``values`` are each part's ends, the last part holds its upper end."""
    t = F.greatest(F.lit(low), F.least(F.lit(high), t))
    edges = [low, *bounds, high]
    out = None
    for k, (a, b) in enumerate(values):
        x0, x1 = edges[k], edges[k + 1]
        part = F.lit(a) + (t - x0) / (x1 - x0) * (b - a) if x1 > x0 else F.lit(a)
        last = k == len(values) - 1
        out = F.when(t < x1, part) if out is None and not last else part if out is None else out.otherwise(part) if last else out.when(t < x1, part)
    return out


def field_kind(kind: Column, flags: Column) -> Column:
    """The class of a form field from its type and flags."""
    on = lambda bit: flags.bitwiseAND(F.lit(1 << bit)) != 0
    button = F.when(on(16), "push").when(on(15), "radio").otherwise("checkbox")
    return F.when(kind == "Btn", button).when(kind == "Ch", F.when(on(17), "combo").otherwise("list")).when(kind == "Tx", "text").when(kind == "Sig", "signature").otherwise("unknown")
