"""Affine matrices, rectangles and page geometry as column expressions.

A matrix is a struct (a, b, c, d, e, f) for row vectors: x' = a*x + c*y + e, y' = b*x + d*y + f. A rectangle is
a struct (llx, lly, urx, ury).
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_M = ("a", "b", "c", "d", "e", "f")
_R = ("llx", "lly", "urx", "ury")


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def matrix(*parts: Column | float) -> Column:
    return F.struct(*(_col(p).alias(n) for n, p in zip(_M, parts, strict=True)))


def translate(tx: Column | float, ty: Column | float) -> Column:
    return matrix(1, 0, 0, 1, tx, ty)


def scale(sx: Column | float, sy: Column | float) -> Column:
    return matrix(sx, 0, 0, sy, 0, 0)


def rotate(radians: Column | float) -> Column:
    r = _col(radians)
    return matrix(F.cos(r), F.sin(r), -F.sin(r), F.cos(r), 0, 0)


def skew(ax: Column | float, by: Column | float) -> Column:
    return matrix(1, F.tan(_col(ax)), F.tan(_col(by)), 1, 0, 0)


def compose(first: Column, then: Column) -> Column:
    """The matrix that applies ``first`` and ``then`` in turn."""
    l, r = ({n: m[n] for n in _M} for m in (first, then))
    return matrix(
        l["a"] * r["a"] + l["b"] * r["c"], l["a"] * r["b"] + l["b"] * r["d"],
        l["c"] * r["a"] + l["d"] * r["c"], l["c"] * r["b"] + l["d"] * r["d"],
        l["e"] * r["a"] + l["f"] * r["c"] + r["e"], l["e"] * r["b"] + l["f"] * r["d"] + r["f"],
    )


def determinant(m: Column) -> Column:
    return m["a"] * m["d"] - m["b"] * m["c"]


def inverse(m: Column) -> Column:
    """Null where the matrix is singular (determinant within 1e-12)."""
    det = determinant(m)
    solved = matrix(m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det, (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det)
    return F.when(F.abs(det) >= 1e-12, solved)


def apply(m: Column, x: Column | float, y: Column | float) -> Column:
    x, y = _col(x), _col(y)
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def rect(*parts: Column | float) -> Column:
    """A rectangle with its corners put in order."""
    x0, y0, x1, y1 = map(_col, parts)
    return F.struct(F.least(x0, x1).alias("llx"), F.least(y0, y1).alias("lly"), F.greatest(x0, x1).alias("urx"), F.greatest(y0, y1).alias("ury"))


def apply_to_rect(m: Column, r: Column) -> Column:
    corners = [apply(m, r[x], r[y]) for x in ("llx", "urx") for y in ("lly", "ury")]
    return F.struct(
        F.least(*(c["x"] for c in corners)).alias("llx"), F.least(*(c["y"] for c in corners)).alias("lly"),
        F.greatest(*(c["x"] for c in corners)).alias("urx"), F.greatest(*(c["y"] for c in corners)).alias("ury"),
    )


def viewport(box: Column, rotation: int, width: Column | float, height: Column | float) -> Column:
    """From page space to pixels (y down), for pages turned by quarter turns."""
    if rotation not in (0, 90, 180, 270):
        raise ValueError("a page turns by quarter turns only")
    w, h = box["urx"] - box["llx"], box["ury"] - box["lly"]
    turned = {0: (1, 0, 0, 1, 0, 0), 90: (0, -1, 1, 0, 0, w), 180: (-1, 0, 0, -1, w, h), 270: (0, 1, -1, 0, h, 0)}[rotation]
    across, up = (w, h) if rotation in (0, 180) else (h, w)
    out = compose(translate(-box["llx"], -box["lly"]), matrix(*turned))
    return compose(out, matrix(_col(width) / across, 0, 0, -_col(height) / up, 0, _col(height)))


def is_intersect(p: Column, q: Column) -> Column:
    """Closed boxes: touching ones meet."""
    return (p["llx"] <= q["urx"]) & (q["llx"] <= p["urx"]) & (p["lly"] <= q["ury"]) & (q["lly"] <= p["ury"])


def overlaps(p: Column, q: Column) -> Column:
    """Open boxes: touching ones don't overlap."""
    return (p["llx"] < q["urx"]) & (q["llx"] < p["urx"]) & (p["lly"] < q["ury"]) & (q["lly"] < p["ury"])


def intersect(p: Column, q: Column) -> Column:
    cut = F.struct(F.greatest(p["llx"], q["llx"]).alias("llx"), F.greatest(p["lly"], q["lly"]).alias("lly"), F.least(p["urx"], q["urx"]).alias("urx"), F.least(p["ury"], q["ury"]).alias("ury"))
    return F.when(is_intersect(p, q), cut).otherwise(empty())


def join(p: Column, q: Column) -> Column:
    return F.struct(F.least(p["llx"], q["llx"]).alias("llx"), F.least(p["lly"], q["lly"]).alias("lly"), F.greatest(p["urx"], q["urx"]).alias("urx"), F.greatest(p["ury"], q["ury"]).alias("ury"))


def empty() -> Column:
    return rect(0, 0, 0, 0)


def contains(r: Column, x: Column, y: Column, inclusive: bool = True) -> Column:
    if inclusive:
        return x.between(r["llx"], r["urx"]) & y.between(r["lly"], r["ury"])
    return (x > r["llx"]) & (x < r["urx"]) & (y > r["lly"]) & (y < r["ury"])


def contains_line(r: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return contains(r, x1, y1) & contains(r, x2, y2)


def near_equals(p: Column, q: Column, delta: float) -> Column:
    out = F.lit(True)
    for n in _R:
        out = out & (F.abs(p[n] - q[n]) <= delta)
    return out


def equals(p: Column, q: Column) -> Column:
    return near_equals(p, q, 0.0)


def move_by(r: Column, dx: Column | float, dy: Column | float) -> Column:
    dx, dy = _col(dx), _col(dy)
    return F.struct((r["llx"] + dx).alias("llx"), (r["lly"] + dy).alias("lly"), (r["urx"] + dx).alias("urx"), (r["ury"] + dy).alias("ury"))


def rotate_rect(r: Column, quarter_turns: Column) -> Column:
    """Turns about the centre: odd turns swap width and height."""
    cx, cy = (r["llx"] + r["urx"]) / 2, (r["lly"] + r["ury"]) / 2
    w, h = (r["urx"] - r["llx"]) / 2, (r["ury"] - r["lly"]) / 2
    odd = F.pmod(quarter_turns, F.lit(2)) == 1
    return F.when(odd, F.struct((cx - h).alias("llx"), (cy - w).alias("lly"), (cx + h).alias("urx"), (cy + w).alias("ury"))).otherwise(r)


def to_points(r: Column) -> Column:
    return F.array(*(F.struct(r[x].alias("x"), r[y].alias("y")) for x, y in (("llx", "lly"), ("urx", "lly"), ("urx", "ury"), ("llx", "ury"))))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def normalize_rotation(r: Column) -> Column:
    """The nearest multiple of 90, halves away from zero, in [0, 360)."""
    return F.pmod(F.round(r / 90.0).cast("int") * 90, F.lit(360))


def device_size(extent: Column, dpi: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(extent * dpi / 72.0 - 1e-6).cast("int"))


def is_landscape(width: Column, height: Column) -> Column:
    return width > height


QUARTER = math.pi / 2
