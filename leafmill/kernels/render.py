"""Pages as pictures: paths, colours, clips and images of content streams, painted with 4 x 4 samples a pixel.

Text is painted with the outlines of embedded TrueType fonts; runs in other fonts as boxes of their extent (half an em a
character without a width) unless ``text=False``. Annotations are painted by their normal appearance.
"""

from __future__ import annotations

import zlib

import numpy as np

from . import jpeg
from .faces import DEFAULT, Face
from .pdf import Document, Name, Stream, box_of, operations, rotation_of, text_string
from .shading import shading

SAMPLES = 4
_ID = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    return (a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


def at(m: tuple, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def bezier(p0, p1, p2, p3, steps: int = 16) -> list[tuple[float, float]]:
    t = np.linspace(0, 1, steps + 1)[1:, None]
    p0, p1, p2, p3 = map(np.array, (p0, p1, p2, p3))
    return list(map(tuple, (1 - t) ** 3 * p0 + 3 * (1 - t) ** 2 * t * p1 + 3 * (1 - t) * t**2 * p2 + t**3 * p3))


def coverage(width: int, height: int, polygons: list[list[tuple[float, float]]], even_odd: bool = False) -> np.ndarray:
    """The share of each pixel's samples inside the polygons, by winding number or parity."""
    h, w = height * SAMPLES, width * SAMPLES
    # crossings change the winding of all samples to their right; sums along rows give it
    turns = np.zeros((h, w + 1), dtype=np.int32)
    for poly in polygons:
        for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1], strict=True):
            if y0 == y1:
                continue
            sign, (xa, ya, xb, yb) = (1, (x0, y0, x1, y1)) if y0 < y1 else (-1, (x1, y1, x0, y0))
            rows = np.arange(max(0, int(np.ceil(ya * SAMPLES - 0.5))), min(h, int(np.ceil(yb * SAMPLES - 0.5))))
            if len(rows):
                xs = xa + ((rows + 0.5) / SAMPLES - ya) * (xb - xa) / (yb - ya)
                np.add.at(turns, (rows, np.clip(np.ceil(xs * SAMPLES - 0.5), 0, w).astype(np.int64)), sign)
    wind = turns[:, :w].cumsum(axis=1)
    inside = wind % 2 != 0 if even_odd else wind != 0
    return inside.reshape(height, SAMPLES, width, SAMPLES).mean(axis=(1, 3))


def outline(points: list[tuple[float, float]], closed: bool, half: float) -> list[list[tuple[float, float]]]:
    """A stroke as a quadrilateral of each segment."""
    out = []
    ends = points[1:] + (points[:1] if closed else [])
    for (x0, y0), (x1, y1) in zip(points, ends, strict=False):
        n = float(np.hypot(x1 - x0, y1 - y0))
        if n:
            dx, dy = (y1 - y0) / n * half, -(x1 - x0) / n * half
            out.append([(x0 + dx, y0 + dy), (x1 + dx, y1 + dy), (x1 - dx, y1 - dy), (x0 - dx, y0 - dy)])
    return out


def colour_of(parts: list[float]) -> tuple[float, float, float]:
    p = [min(1.0, max(0.0, float(x))) for x in parts]
    if len(p) == 1:
        return p[0], p[0], p[0]
    if len(p) == 4:
        return tuple((1 - x) * (1 - p[3]) for x in p[:3])
    return p[0], p[1], p[2]


class Painter:
    def __init__(self, doc: Document, width: int, height: int, text: bool = True):
        self.doc, self.width, self.height, self.text = doc, width, height, text
        self.pixels = np.ones((height, width, 3))
        self.faces: dict[int, tuple[dict, Face | None]] = {}

    def fill(self, polygons, colour, even_odd: bool, clip, alpha: float = 1.0) -> None:
        """Only the pixels about the polygons are touched. A colour is fixed, or a function of the pixels' places."""
        points = np.array([p for poly in polygons for p in poly])
        if not len(points) or not np.isfinite(points).all():
            return
        (x0, y0), (x1, y1) = np.floor(points.min(axis=0)), np.ceil(points.max(axis=0))
        x0, x1 = (int(min(max(v, 0), self.width)) for v in (x0, x1))
        y0, y1 = (int(min(max(v, 0), self.height)) for v in (y0, y1))
        if x0 >= x1 or y0 >= y1:
            return
        cover = coverage(x1 - x0, y1 - y0, [[(x - x0, y - y0) for x, y in poly] for poly in polygons], even_odd)
        cover = (cover if clip is None else cover * clip[y0:y1, x0:x1])[:, :, None] * alpha
        if callable(colour):
            colour, there = colour(*(np.mgrid[y0:y1, x0:x1][::-1] + 0.5))
            cover = cover * there[:, :, None]
        self.pixels[y0:y1, x0:x1] = self.pixels[y0:y1, x0:x1] * (1 - cover) + np.array(colour) * cover

    def shaded(self, head, m: tuple):
        """A shading as a colour; ``m`` leads from its plane to pixels."""
        paint, det = shading(self.doc, head), m[0] * m[3] - m[1] * m[2]

        def colour(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            dx, dy = xs - m[4], ys - m[5]
            return paint((m[3] * dx - m[2] * dy) / det, (m[0] * dy - m[1] * dx) / det)

        return colour

    def pattern(self, resources: dict, name: str, base: tuple):
        found = self.doc.get((self.doc.get(resources.get("Pattern")) or {}).get(name)) or {}
        if not isinstance(found, dict) or self.doc.get(found.get("PatternType")) != 2:
            raise ValueError("this pattern is not painted")
        return self.shaded(found["Shading"], times(tuple(float(self.doc.get(v)) for v in self.doc.get(found.get("Matrix")) or _ID), base))

    def face(self, resources: dict, name: str) -> Face | None:
        font = self.doc.get((self.doc.get(resources.get("Font")) or {}).get(name))
        if not isinstance(font, dict):
            return None
        if id(font) not in self.faces:
            try:
                self.faces[id(font)] = font, Face(self.doc, font)
            except (AttributeError, IndexError, TypeError, ValueError):
                self.faces[id(font)] = font, None
        return self.faces[id(font)][1]

    def space(self, v) -> tuple[int, np.ndarray | None]:
        """The parts of a colour space, 0 for one that isn't known, and its table of colours. Calibrated colours are taken
        as those of the device."""
        v = self.doc.get(v)
        if isinstance(v, Name):
            return {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(v, 0), None
        if not isinstance(v, list) or not v:
            return 0, None
        kind = self.doc.get(v[0])
        if kind == "Indexed" and len(v) == 4:
            parts, inner = self.space(v[1])
            held = self.doc.get(v[3])
            held = self.doc.stream_bytes(held) if isinstance(held, Stream) else bytes(held)
            rows = len(held) // parts if parts and inner is None else 0
            return (parts, np.frombuffer(held[: rows * parts], dtype=np.uint8).reshape(rows, parts) / 255) if rows else (0, None)
        if kind == "ICCBased" and len(v) == 2:
            return int(self.doc.get(self.doc.get(v[1]).header["N"])), None
        return {"CalGray": 1, "CalRGB": 3}.get(kind, self.space(kind)[0] if isinstance(kind, Name) else 0), None

    def samples(self, s: Stream) -> np.ndarray | None:
        """(height, width, parts) from 0 to 1."""
        head = s.header
        names = self.doc.get(head.get("Filter"))
        if (names[-1:] if isinstance(names, list) else [names]) == ["DCTDecode"]:
            if isinstance(names, list) and len(names) > 1:
                return None
            w, h, rgba = jpeg.decode(s.body)
            return np.frombuffer(rgba, dtype=np.uint8).reshape(h, w, 4)[:, :, :3] / 255
        w, h = self.doc.get(head.get("Width")), self.doc.get(head.get("Height"))
        stencil = self.doc.get(head.get("ImageMask")) is True
        parts, table = (1, None) if stencil else self.space(head.get("ColorSpace"))
        count = 1 if table is not None else parts
        raw, bits = self.doc.stream_bytes(s), 1 if stencil else self.doc.get(head.get("BitsPerComponent"))
        if not parts or bits not in (1, 2, 4, 8) or len(raw) < (row := (w * count * bits + 7) // 8) * h:
            return None
        px = np.unpackbits(np.frombuffer(raw[: row * h], dtype=np.uint8).reshape(h, row), axis=1)[:, : w * count * bits]
        px = px.reshape(h, w, count, bits) @ (1 << np.arange(bits)[::-1])
        if table is not None:
            return table[np.minimum(px[:, :, 0], len(table) - 1)]
        px = px / (2**bits - 1)
        ends = [float(x) for x in self.doc.get(head.get("Decode")) or ()]
        if len(ends) == 2 * parts:
            px = np.array(ends[::2]) + px * np.diff(np.array(ends).reshape(-1, 2), axis=1)[:, 0]
        return px

    def image(self, s: Stream, ctm: tuple, clip, colour=(0.0, 0.0, 0.0), alpha: float = 1.0) -> None:
        px, mask = self.samples(s), self.doc.get(s.header.get("SMask"))
        if px is None:
            return
        stencil, parts = self.doc.get(s.header.get("ImageMask")) is True, px.shape[2]
        px = np.repeat(px, 3, axis=2) if parts == 1 else (1 - px[:, :, :3]) * (1 - px[:, :, 3:]) if parts == 4 else px
        soft = self.samples(mask) if isinstance(mask, Stream) else None
        det = ctm[0] * ctm[3] - ctm[1] * ctm[2]
        if abs(det) < 1e-12:
            return
        ys, xs = np.mgrid[0 : self.height, 0 : self.width] + 0.5
        dx, dy = xs - ctm[4], ys - ctm[5]
        u, v = (ctm[3] * dx - ctm[2] * dy) / det, (ctm[0] * dy - ctm[1] * dx) / det
        cover = coverage(self.width, self.height, [[at(ctm, *c) for c in ((0, 0), (1, 0), (1, 1), (0, 1))]])
        cover = (cover if clip is None else cover * clip)[:, :, None]
        near = lambda a: a[np.clip((1 - v) * a.shape[0], 0, a.shape[0] - 1).astype(int), np.clip(u * a.shape[1], 0, a.shape[1] - 1).astype(int)]
        shown, cover = near(px), cover * alpha
        if soft is not None:
            cover = cover * near(soft)[:, :, :1]
        if stencil:
            cover, shown = cover * (1 - shown[:, :, :1]), np.array(colour(xs, ys)[0] if callable(colour) else colour)
        self.pixels = self.pixels * (1 - cover) + shown * cover

    def run(self, content: bytes, resources: dict, ctm: tuple, depth: int = 0) -> None:
        state = {"ctm": ctm, "fill": (0.0, 0.0, 0.0), "stroke": (0.0, 0.0, 0.0), "width": 1.0, "clip": None}
        state |= {"face": None, "size": 0.0, "between": 0.0, "words": 0.0, "scale": 1.0, "rise": 0.0, "mode": 0, "see": (1.0, 1.0)}
        stack: list[dict] = []
        paths: list[tuple[list, bool]] = []
        pending = None
        tm = lm = _ID
        lead = 0.0
        point = (0.0, 0.0)

        def start(x, y):
            paths.append(([(x, y)], False))

        def close():
            if paths:
                paths[-1] = (paths[-1][0], True)

        def polygons():
            return [[at(state["ctm"], *p) for p in pts] for pts, _ in paths]

        def paint(fill: bool, stroke: bool, even_odd: bool = False):
            if fill and paths:
                self.fill(polygons(), state["fill"], even_odd, state["clip"], state["see"][0])
            if stroke and paths:
                m = state["ctm"]
                half = max(0.5, state["width"] * abs(m[0] * m[3] - m[1] * m[2]) ** 0.5 / 2)
                for pts, closed in paths:
                    for quad in outline([at(m, *p) for p in pts], closed, half):
                        self.fill([quad], state["stroke"], False, state["clip"], state["see"][1])
            done()

        def done():
            nonlocal pending
            if pending is not None and paths:
                mask = coverage(self.width, self.height, polygons(), pending)
                state["clip"] = mask if state["clip"] is None else state["clip"] * mask
            pending = None
            paths.clear()

        def show(s: bytes):
            nonlocal tm
            face, size, scale = state["face"], state["size"], state["scale"]
            if face is None:
                codes, text = list(s), text_string(s)
                along = [DEFAULT / 1000] * len(text)
            else:
                codes = list(face.codes(s))
                along = [face.advance(c) for c in codes]
            spaced = [w * size + state["between"] + (state["words"] if c == 32 and not (face and face.wide) else 0) for w, c in zip(along, codes, strict=False)]
            if self.text and codes and state["mode"] not in (3, 7):
                m = times((scale, 0, 0, 1, 0, state["rise"]), times(tm, state["ctm"]))
                if face and face.program:
                    x, rings = 0.0, []
                    for c, step in zip(codes, spaced, strict=True):
                        rings += [[at(m, x + px * size, py * size) for px, py in ring] for ring in face.rings(c)]
                        x += step
                else:
                    rings = [[at(m, *c) for c in ((0, 0), (sum(spaced), 0), (sum(spaced), size * 0.7), (0, size * 0.7))]]
                if state["mode"] in (0, 2, 4, 6):
                    self.fill(rings, state["fill"], False, state["clip"], state["see"][0])
                if state["mode"] in (1, 2, 5, 6):
                    half = max(0.5, state["width"] * abs(m[0] * m[3] - m[1] * m[2]) ** 0.5 / 2)
                    for ring in rings:
                        for quad in outline(ring, True, half):
                            self.fill([quad], state["stroke"], False, state["clip"], state["see"][1])
            tm = times((1, 0, 0, 1, sum(spaced) * scale, 0), tm)

        for op, args in operations(content):
            try:
                if op == "q":
                    stack.append(dict(state))
                elif op == "Q" and stack:
                    state = stack.pop()
                elif op == "cm":
                    state["ctm"] = times(tuple(map(float, args)), state["ctm"])
                elif op == "w":
                    state["width"] = float(args[0])
                elif op in ("g", "rg", "k", "sc", "scn") and all(isinstance(x, int | float) for x in args):
                    state["fill"] = colour_of(args)
                elif op in ("G", "RG", "K", "SC", "SCN") and all(isinstance(x, int | float) for x in args):
                    state["stroke"] = colour_of(args)
                elif op in ("scn", "SCN") and isinstance(args[-1], Name):
                    state["fill" if op == "scn" else "stroke"] = self.pattern(resources, str(args[-1]), ctm)
                elif op == "sh":
                    head = (self.doc.get(resources.get("Shading")) or {})[str(args[0])]
                    whole = [[(0, 0), (self.width, 0), (self.width, self.height), (0, self.height)]]
                    self.fill(whole, self.shaded(head, state["ctm"]), False, state["clip"], state["see"][0])
                elif op == "gs":
                    given = self.doc.get((self.doc.get(resources.get("ExtGState")) or {})[str(args[0])])
                    state["see"] = tuple(float(self.doc.get(given.get(k, old))) for k, old in zip(("ca", "CA"), state["see"], strict=True))
                    state["width"] = float(self.doc.get(given.get("LW", state["width"])))
                elif op == "re":
                    x, y, w, h = map(float, args)
                    paths.append(([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], True))
                elif op == "m":
                    start(*map(float, args))
                elif op == "l":
                    paths[-1][0].append(tuple(map(float, args)))
                elif op in ("c", "v", "y"):
                    p = list(map(float, args))
                    point = paths[-1][0][-1]
                    one, two, end = {"c": lambda: (p[:2], p[2:4], p[4:]), "v": lambda: (point, p[:2], p[2:]), "y": lambda: (p[:2], p[2:], p[2:])}[op]()
                    paths[-1][0].extend(bezier(point, one, two, end))
                elif op == "h":
                    close()
                elif op in ("f", "F", "f*"):
                    paint(True, False, op == "f*")
                elif op in ("S", "s"):
                    if op == "s":
                        close()
                    paint(False, True)
                elif op in ("B", "B*", "b", "b*"):
                    if op[0] == "b":
                        close()
                    paint(True, True, op.endswith("*"))
                elif op == "n":
                    done()
                elif op in ("W", "W*"):
                    pending = op == "W*"
                elif op == "BT":
                    tm = lm = _ID
                elif op == "Tf":
                    state["face"], state["size"] = self.face(resources, str(args[0])), float(args[1])
                elif op in ("Tc", "Tw", "Ts"):
                    state[{"Tc": "between", "Tw": "words", "Ts": "rise"}[op]] = float(args[0])
                elif op == "Tz":
                    state["scale"] = float(args[0]) / 100
                elif op == "Tr":
                    state["mode"] = int(args[0])
                elif op == "TL":
                    lead = float(args[0])
                elif op in ("Td", "TD"):
                    lead = -float(args[1]) if op == "TD" else lead
                    tm = lm = times((1, 0, 0, 1, float(args[0]), float(args[1])), lm)
                elif op == "Tm":
                    tm = lm = tuple(map(float, args))
                elif op in ("T*", "'", '"'):
                    tm = lm = times((1, 0, 0, 1, 0, -lead), lm)
                    if op == '"':
                        state["words"], state["between"] = float(args[0]), float(args[1])
                    if op != "T*":
                        show(args[-1])
                elif op == "Tj":
                    show(args[0])
                elif op == "TJ":
                    for x in args[0]:
                        if isinstance(x, bytes):
                            show(x)
                        else:
                            tm = times((1, 0, 0, 1, -float(x) / 1000 * state["size"] * state["scale"], 0), tm)
                elif op == "Do" and depth < 8:
                    found = self.doc.get(resources.get("XObject")) or {}
                    s = self.doc.get(found.get(str(args[0])))
                    if isinstance(s, Stream) and s.header.get("Subtype") == "Image":
                        self.image(s, state["ctm"], state["clip"], state["fill"], state["see"][0])
                    elif isinstance(s, Stream) and s.header.get("Subtype") == "Form":
                        m = tuple(map(float, self.doc.get(s.header.get("Matrix")) or _ID))
                        self.run(self.doc.stream_bytes(s), self.doc.get(s.header.get("Resources")) or resources, times(m, state["ctm"]), depth + 1)
            except (AttributeError, IndexError, TypeError, ValueError, KeyError):
                continue


    def annotation(self, note: dict, ctm: tuple) -> None:
        """The normal appearance, moved and stretched into the annotation's rectangle; hidden ones stay out."""
        look = self.doc.get((self.doc.get(note.get("AP")) or {}).get("N"))
        if isinstance(look, dict):
            look = self.doc.get(look.get(str(self.doc.get(note.get("AS")))))
        flags, box = int(self.doc.get(note.get("F")) or 0), [float(self.doc.get(v)) for v in self.doc.get(note.get("Rect")) or ()]
        if not isinstance(look, Stream) or flags & 0x22 or len(box) != 4 or self.doc.get(note.get("Subtype")) == "Popup":
            return
        m = tuple(float(self.doc.get(v)) for v in self.doc.get(look.header.get("Matrix")) or _ID)
        x0, y0, x1, y1 = (float(self.doc.get(v)) for v in self.doc.get(look.header.get("BBox")) or (0, 0, 1, 1))
        corners = np.array([at(m, x, y) for x in (x0, x1) for y in (y0, y1)])
        low, high = corners.min(axis=0), corners.max(axis=0)
        to_low, to_high = np.minimum(box[:2], box[2:]), np.maximum(box[:2], box[2:])
        if (high <= low).any():
            return
        sx, sy = (to_high - to_low) / (high - low)
        fit = (sx, 0, 0, sy, to_low[0] - low[0] * sx, to_low[1] - low[1] * sy)
        self.run(self.doc.stream_bytes(look), self.doc.get(look.header.get("Resources")) or {}, times(times(m, fit), ctm), 1)


def render(doc: Document, page: dict, dpi: float = 72.0, text: bool = True) -> tuple[int, int, bytes]:
    """(width, height, RGBA) of a page."""
    x0, y0, x1, y1 = box_of(page, doc)
    w, h, turn = x1 - x0, y1 - y0, rotation_of(page, doc)
    across, up = (w, h) if turn in (0, 180) else (h, w)
    size = lambda v: max(1, int(np.ceil(v * dpi / 72 - 1e-6)))
    width, height = size(across), size(up)
    turned = {0: _ID, 90: (0, -1, 1, 0, 0, w), 180: (-1, 0, 0, -1, w, h), 270: (0, 1, -1, 0, h, 0)}[turn]
    ctm = times(times((1, 0, 0, 1, -x0, -y0), turned), (width / across, 0, 0, -height / up, 0, height))
    painter = Painter(doc, width, height, text)
    painter.run(doc.contents(page), doc.get(page.get("Resources")) or {}, ctm)
    for note in doc.get(page.get("Annots")) or []:
        note = doc.get(note)
        if isinstance(note, dict):
            try:
                painter.annotation(note, ctm)
            except (AttributeError, TypeError, ValueError, IndexError):
                continue
    rgb = np.floor(painter.pixels * 255 + 0.5).astype(np.uint8)
    return width, height, np.dstack([rgb, np.full((height, width), 255, dtype=np.uint8)]).tobytes()


def checksum(rgba: bytes) -> int:
    return zlib.adler32(rgba)
