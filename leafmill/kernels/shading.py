"""Colours that change over a page: functions of one number, and shadings along an axis or between two circles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .pdf import Document, Stream


def function(doc: Document, f) -> Callable[[np.ndarray], np.ndarray]:
    """Sampled, exponential and stitched functions, and lists of them, as a map from numbers to rows of colour parts."""
    f = doc.get(f)
    if isinstance(f, list):
        parts = [function(doc, x) for x in f]
        return lambda t: np.concatenate([p(t) for p in parts], axis=1)
    head = f.header if isinstance(f, Stream) else f
    row = lambda k, default: np.array([float(doc.get(v)) for v in doc.get(head.get(k)) or default])
    low, high = row("Domain", (0, 1))[:2]
    kind = int(doc.get(head["FunctionType"]))
    if kind == 2:
        c0, c1, n = row("C0", (0,)), row("C1", (1,)), float(doc.get(head["N"]))
        return lambda t: c0 + (np.clip(t, low, high) ** n)[:, None] * (c1 - c0)
    if kind == 3:
        inner = [function(doc, x) for x in doc.get(head["Functions"])]
        edges, ends = np.array([low, *row("Bounds", ()), high]), row("Encode", ()).reshape(-1, 2)

        def stitched(t: np.ndarray) -> np.ndarray:
            t = np.clip(t, low, high)
            k = np.clip(np.searchsorted(edges[1:-1], t, side="right"), 0, len(inner) - 1)
            out: np.ndarray | None = None
            for i, g in enumerate(inner):
                a, b = edges[i], edges[i + 1]
                share = (t - a) / (b - a) if b > a else np.zeros_like(t)
                got = g(ends[i, 0] + share * (ends[i, 1] - ends[i, 0]))
                out = got if out is None else np.where((k == i)[:, None], got, out)
            return out

        return stitched
    if kind == 0 and isinstance(f, Stream):
        size, bits, span = int(row("Size", ())[0]), int(doc.get(head["BitsPerSample"])), row("Range", ()).reshape(-1, 2)
        if bits not in (1, 2, 4, 8, 16, 32):
            raise ValueError("samples of this width are not read")
        raw = np.unpackbits(np.frombuffer(doc.stream_bytes(f), dtype=np.uint8))[: size * len(span) * bits].reshape(size, len(span), bits)
        values = raw.astype(float) @ (2.0 ** np.arange(bits)[::-1]) / (2.0**bits - 1)
        decode = row("Decode", span.ravel()).reshape(-1, 2)
        values = decode[:, 0] + values * (decode[:, 1] - decode[:, 0])
        first, last = row("Encode", (0, size - 1))[:2]

        def sampled(t: np.ndarray) -> np.ndarray:
            at = np.clip(first + (np.clip(t, low, high) - low) / (high - low) * (last - first), 0, size - 1)
            return np.stack([np.interp(at, np.arange(size), values[:, j]) for j in range(len(span))], axis=1)

        return sampled
    raise ValueError(f"functions of kind {kind} are not read")


def rgb_of(parts: np.ndarray) -> np.ndarray:
    """Rows of one (grey), three or four (printing) parts as red, green and blue."""
    p = np.clip(parts, 0, 1)
    if p.shape[1] == 1:
        return np.repeat(p, 3, axis=1)
    return (1 - p[:, :3]) * (1 - p[:, 3:]) if p.shape[1] == 4 else p[:, :3]


def shading(doc: Document, head) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Colours, and whether there is one, at the places (x, y) of the shading's own plane."""
    head = doc.get(head)
    head = head.header if isinstance(head, Stream) else head
    kind = int(doc.get(head["ShadingType"]))
    if kind not in (2, 3):
        raise ValueError(f"shadings of kind {kind} are not painted")
    c = [float(doc.get(v)) for v in doc.get(head["Coords"])]
    t0, t1 = (float(doc.get(v)) for v in doc.get(head.get("Domain")) or (0, 1))
    before, after = (bool(doc.get(v)) for v in doc.get(head.get("Extend")) or (False, False))
    colour = function(doc, head["Function"])

    def along(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dx, dy = c[2] - c[0], c[3] - c[1]
        if dx == 0 and dy == 0:
            return np.zeros_like(x), np.zeros(x.shape, dtype=bool)
        s = ((x - c[0]) * dx + (y - c[1]) * dy) / (dx * dx + dy * dy)
        return s, (before | (s >= 0)) & (after | (s <= 1))

    def between(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # of the circles through a place, the last one with a radius counts
        dx, dy, dr = c[3] - c[0], c[4] - c[1], c[5] - c[2]
        px, py = x - c[0], y - c[1]
        a, b, d = dx * dx + dy * dy - dr * dr, px * dx + py * dy + c[2] * dr, px * px + py * py - c[2] ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            if abs(a) < 1e-12:
                roots = [d / (2 * b)]
            else:
                root = np.sqrt(b * b - a * d)
                roots = [np.maximum((b + root) / a, (b - root) / a), np.minimum((b + root) / a, (b - root) / a)]
        best, found = np.zeros_like(x), np.zeros(x.shape, dtype=bool)
        for s in roots:
            good = np.isfinite(s) & ~found
            good &= np.where(good, c[2] + np.where(good, s, 0) * dr, -1) >= 0
            good &= (before | (s >= 0)) & (after | (s <= 1))
            best, found = np.where(good, s, best), found | good
        return best, found

    def paint(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, there = (along if kind == 2 else between)(x.astype(float), y.astype(float))
        got = rgb_of(colour(t0 + np.clip(s, 0, 1).ravel() * (t1 - t0)))
        return got.reshape(*x.shape, 3), there

    return paint
