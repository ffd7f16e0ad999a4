"""Reading documents: tokens, objects, cross references, page trees, content streams, text and outlines.

The grammar is that of ISO 32000. Values are Python's: None, bool, int, float, Name, Str, Ref, list, dict and
Stream. Damaged objects are skipped; a damaged cross-reference table is rebuilt by scanning for objects.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from . import encodings
from .codecs import apply_filters


class Name(str):
    __slots__ = ()


class Str(bytes):
    __slots__ = ()


class Ref(NamedTuple):
    id: int
    gen: int


@dataclass
class Stream:
    header: dict
    body: bytes


class Keyword(str):
    __slots__ = ()


_TOKEN = re.compile(
    rb"(?P<space>[\x00\t\n\x0c\r ]+)|(?P<comment>%[^\r\n]*)|(?P<open><<)|(?P<close>>>)|<(?P<hex>[0-9A-Fa-f\x00\t\n\x0c\r ]*)>|(?P<str>\()|"
    rb"/(?P<name>[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z))|(?P<array>[\[\]{}])|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<other>.)",
    re.S,
)
_ESCAPE = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}


def tokens(data: bytes, at: int = 0):
    """(kind, value, start, end) of each token but white space and comments."""
    while at < len(data):
        m = _TOKEN.match(data, at)
        kind = m.lastgroup
        start, at = at, m.end()
        if kind in ("space", "comment"):
            continue
        if kind == "str":
            value, at = _literal(data, at)
            yield "str", Str(value), start, at
        elif kind == "hex":
            digits = re.sub(rb"\s|\x00", b"", m["hex"])
            yield "str", Str(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), start, at
        elif kind == "name":
            yield "name", Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes((int(x[1], 16),)), m["name"]).decode("latin-1")), start, at
        elif kind == "number":
            raw = m["number"]
            yield "number", (float(raw) if b"." in raw else int(raw)), start, at
        else:
            yield kind, Keyword(m[0].decode("latin-1")), start, at


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x5C and at < len(data):
            c = data[at]
            at += 1
            if 48 <= c <= 55:
                n, k = c - 48, 1
                while k < 3 and at < len(data) and 48 <= data[at] <= 55:
                    n, at, k = n * 8 + data[at] - 48, at + 1, k + 1
                out.append(n & 255)
            elif c in _ESCAPE:
                out.append(_ESCAPE[c])
            elif c == 13:
                at += data[at : at + 1] == b"\n"
            elif c != 10:
                out.append(c)
            continue
        if c == 40:
            depth += 1
        elif c == 41:
            depth -= 1
            if not depth:
                break
        out.append(c)
    return bytes(out), at


class Reader:
    """Values from a position on."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.stream = data, tokens(data, at)
        self.back: list = []
        self.at = at

    def next(self):
        t = self.back.pop() if self.back else next(self.stream, None)
        if t is not None:
            self.at = t[3]
        return t

    def value(self):
        """The next value; Keyword for operators; raises ValueError at the end."""
        t = self.next()
        if t is None:
            raise ValueError("the data ends")
        kind, v = t[0], t[1]
        if kind == "number" and isinstance(v, int) and v >= 0:
            second = self.next()
            if second and second[0] == "number" and isinstance(second[1], int):
                third = self.next()
                if third and third[1] == "R" and third[0] == "word":
                    return Ref(v, second[1])
                if third:
                    self.back.append(third)
            if second:
                self.back.append(second)
            self.at = t[3]
            return v
        if kind in ("number", "str", "name"):
            return v
        if kind == "array" and v == "[":
            out = []
            while True:
                x = self.value()
                if isinstance(x, Keyword) and x == "]":
                    return out
                out.append(x)
        if kind == "open":
            out: dict = {}
            while True:
                key = self.value()
                if isinstance(key, Keyword) and key == ">>":
                    return out
                if not isinstance(key, Name):
                    raise ValueError("a key is no name")
                item = self.value()
                if isinstance(item, Keyword):
                    if item == ">>":
                        return out
                    raise ValueError("a value is missing")
                out.setdefault(str(key), item)  # of equal keys the first counts
        if kind == "word":
            if v in ("true", "false"):
                return v == "true"
            if v == "null":
                return None
        return v


def _object_at(data: bytes, at: int, length_of=None) -> tuple[int, int, object]:
    r = Reader(data, at)
    head = [r.next() for _ in range(3)]
    if any(t is None for t in head) or head[2][1] != "obj" or not isinstance(head[0][1], int):
        raise ValueError("no object here")
    v = r.value()
    if isinstance(v, dict):
        m = re.compile(rb"[\x00\t\n\x0c\r ]*stream(?:\r\n|\n|\r)?").match(data, r.at)
        if m:
            n = v.get("Length")
            n = length_of(n) if isinstance(n, Ref) and length_of else n
            body = data[m.end() : m.end() + n] if isinstance(n, int) and n >= 0 else None
            if body is None or not re.match(rb"[\x00\t\n\x0c\r ]*endstream", data[m.end() + n : m.end() + n + 20]):
                end = data.find(b"endstream", m.end())
                body = data[m.end() : end if end >= 0 else len(data)]
                body = body.removesuffix(b"\n").removesuffix(b"\r") if end >= 0 else body
            v = Stream(v, body)
    return head[0][1], head[1][1], v


@dataclass
class Entry:
    kind: str
    offset: int  # or the number of the stream that holds the object
    index: int = 0


@dataclass
class Document:
    data: bytes
    xref: dict[tuple[int, int], Entry] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    objects: dict[int, tuple[int, object]] = field(default_factory=dict)
    recovered: bool = False

    key: bytes | None = None

    @classmethod
    def open(cls, data: bytes, password: bytes = b"") -> Document:
        """Encrypted documents open with the user's or owner's password, and raise ValueError for another."""
        doc = cls(data)
        try:
            doc._follow()
            if not isinstance(doc.trailer.get("Root"), Ref):
                raise ValueError("the trailer names no root")
        except (ValueError, IndexError, TypeError, KeyError):
            doc._rebuild()
        doc._load()
        if doc.trailer.get("Encrypt") is not None:
            doc._decrypt(password)
        return doc

    def _decrypt(self, password: bytes) -> None:
        from .crypto import authenticate

        ref = self.trailer["Encrypt"]
        d = self.get(ref)
        if not isinstance(d, dict) or d.get("Filter") != "Standard":
            raise ValueError("the security handler is unknown")
        file_id = self.get(self.trailer.get("ID")) or [b""]
        found = authenticate({k: bytes(v) if isinstance(v, bytes) else v for k, v in d.items()}, password, bytes(file_id[0]))
        if not found:
            raise ValueError("the password is wrong")
        self.key = found[1]
        filters = d.get("CF") or {}
        method = lambda k: str((filters.get(d.get(k, "Identity")) or {}).get("CFM", "Identity")) if d.get("V", 1) >= 4 else "V2"
        for i, (gen, v) in list(self.objects.items()):
            e = self.xref.get((i, gen))
            if (isinstance(ref, Ref) and i == ref.id) or (e and e.kind == "compressed"):
                continue
            self.objects[i] = (gen, crypt_value(v, method("StrF"), method("StmF"), self.key, i, gen))

    def _follow(self) -> None:
        at = self.data.rfind(b"startxref")
        m = re.compile(rb"startxref\s*(\d+)").match(self.data, at) if at >= 0 else None
        if not m:
            raise ValueError("no cross references")
        nxt, seen = int(m[1]), set()
        while nxt is not None and nxt not in seen:
            seen.add(nxt)
            nxt = self._section(nxt)

    def _section(self, at: int) -> int | None:
        """One section; entries already there are newer and stay."""
        m = re.compile(rb"\s*xref\s").match(self.data, at)
        if not m:
            _, _, v = _object_at(self.data, at)
            if not isinstance(v, Stream) or v.header.get("Type") != "XRef":
                raise ValueError("no cross-reference stream")
            self._xref_stream(v)
            head = v.header
        else:
            r = Reader(self.data, m.end())
            while True:
                t = r.next()
                if t is None:
                    raise ValueError("no trailer")
                if t[1] == "trailer":
                    break
                first, count = t[1], r.next()[1]
                for i in range(count):
                    offset, gen, kind = (r.next()[1] for _ in range(3))
                    if kind == "n" and offset:
                        self.xref.setdefault((first + i, gen), Entry("inuse", offset))
            head = r.value()
            if isinstance(head.get("XRefStm"), int):
                self._section(head["XRefStm"])
        for k, x in head.items():
            self.trailer.setdefault(k, x)
        return head.get("Prev")

    def _xref_stream(self, s: Stream) -> None:
        body, w = self.stream_bytes(s), s.header["W"]
        index = s.header.get("Index", [0, s.header["Size"]])
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for i in range(first, first + count):
                f = []
                for k, n in enumerate(w):
                    f.append(int.from_bytes(body[at : at + n], "big") if n else (1 if k == 0 else 0))
                    at += n
                if f[0] == 1:
                    self.xref.setdefault((i, f[2]), Entry("inuse", f[1]))
                elif f[0] == 2:
                    self.xref.setdefault((i, 0), Entry("compressed", f[1], f[2]))

    def _rebuild(self) -> None:
        """Objects are found by their heads; of equal ids the last one counts."""
        self.recovered, self.xref, self.trailer = True, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b", self.data):
            self.xref[(int(m[1]), int(m[2]))] = Entry("inuse", m.start())
        for m in re.finditer(rb"trailer", self.data):
            try:
                head = Reader(self.data, m.end()).value()
                if isinstance(head, dict):
                    self.trailer |= head
            except ValueError:
                continue

    def _load(self) -> None:
        def length_of(ref: Ref):
            e = self.xref.get((ref.id, ref.gen))
            try:
                return _object_at(self.data, e.offset)[2] if e else None
            except ValueError:
                return None

        packed: dict[int, Stream] = {}
        for (i, gen), e in sorted(self.xref.items()):
            if e.kind != "inuse":
                continue
            try:
                found, _, v = _object_at(self.data, e.offset, length_of)
            except (ValueError, RecursionError, IndexError, TypeError):
                continue
            if found == i:
                self.objects.setdefault(i, (gen, v))
            if isinstance(v, Stream) and v.header.get("Type") == "ObjStm":
                packed[i] = v
            if self.recovered and isinstance(v, dict) and v.get("Type") == "Catalog":
                self.trailer.setdefault("Root", Ref(i, gen))
        for s in packed.values():
            try:
                body, first = self.stream_bytes(s), s.header["First"]
                r = Reader(body)
                pairs = [(r.next()[1], r.next()[1]) for _ in range(s.header["N"])]
                for i, offset in pairs:
                    if i not in self.objects:
                        self.objects[i] = (0, Reader(body, first + offset).value())
            except (ValueError, TypeError, KeyError, IndexError):
                continue

    def get(self, v):
        """What a reference refers to; other values, and references to nothing, stay."""
        for _ in range(32):
            if not isinstance(v, Ref) or v.id not in self.objects:
                break
            v = self.objects[v.id][1]
        return v

    def stream_bytes(self, s: Stream) -> bytes:
        names, parms = self.get(s.header.get("Filter")), self.get(s.header.get("DecodeParms"))
        names = [names] if isinstance(names, Name) else [self.get(n) for n in names or []]
        parms = [parms] if isinstance(parms, dict) else [self.get(p) or {} for p in parms or []]
        return apply_filters(list(map(str, names)), s.body, parms) if names else s.body

    def root(self) -> dict:
        v = self.get(self.trailer.get("Root"))
        return v if isinstance(v, dict) else {}

    def pages(self) -> list[dict]:
        """The leaves in order, with what they inherit and their number in ``_id``."""
        out: list[dict] = []

        def walk(ref, inherited: dict, seen: frozenset) -> None:
            node = self.get(ref)
            if not isinstance(node, dict) or ref in seen or len(seen) > 200:
                return
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    if isinstance(kid, Ref):
                        walk(kid, own, seen | {ref})
            else:
                out.append(own | node | {"_id": ref.id if isinstance(ref, Ref) else 0})

        walk(self.root().get("Pages"), {}, frozenset())
        return out

    def contents(self, page: dict) -> bytes:
        c = self.get(page.get("Contents"))
        parts = [c] if isinstance(c, Stream) else [self.get(x) for x in c] if isinstance(c, list) else []
        return b"\n".join(self.stream_bytes(p) for p in parts if isinstance(p, Stream))

    def outline(self) -> list[tuple[int, str]]:
        """(depth, title) in preorder."""
        out: list[tuple[int, str]] = []
        seen: set = set()

        def walk(ref, depth: int) -> None:
            while isinstance(ref, Ref) and ref not in seen and depth < 100:
                seen.add(ref)
                item = self.get(ref)
                if not isinstance(item, dict):
                    return
                out.append((depth, text_string(self.get(item.get("Title")))))
                walk(item.get("First"), depth + 1)
                ref = item.get("Next")

        top = self.get(self.root().get("Outlines"))
        if isinstance(top, dict):
            walk(top.get("First"), 0)
        return out

    def tree(self, node, key: str = "Names", depth: int = 0) -> list[tuple[object, object]]:
        """The pairs of a name tree (key "Names") or number tree ("Nums")."""
        node = self.get(node)
        if not isinstance(node, dict) or depth > 50:
            return []
        flat = self.get(node.get(key)) or []
        out = list(zip(flat[::2], flat[1::2], strict=False))
        for kid in self.get(node.get("Kids")) or []:
            out += self.tree(kid, key, depth + 1)
        return out


def crypt_value(v, strings: str, streams: str, key: bytes, i: int, gen: int, iv: bytes | None = None):
    """A value with its strings and streams decrypted, or encrypted if there is an ``iv``."""
    from .crypto import crypt

    again = lambda x: crypt_value(x, strings, streams, key, i, gen, iv)
    if isinstance(v, bytes):
        return Str(crypt(strings, key, i, gen, bytes(v), iv))
    if isinstance(v, list):
        return [again(x) for x in v]
    if isinstance(v, dict):
        return {k: again(x) for k, x in v.items()}
    if isinstance(v, Stream):
        if v.header.get("Type") == "XRef":
            return v
        return Stream({k: again(x) for k, x in v.header.items()}, crypt(streams, key, i, gen, v.body, iv))
    return v


def text_string(v) -> str:
    if not isinstance(v, bytes):
        return str(v) if isinstance(v, str) else ""
    if v[:2] == b"\xfe\xff":
        return v[2:].decode("utf-16-be", "replace")
    if v[:3] == b"\xef\xbb\xbf":
        return v[3:].decode("utf-8", "replace")
    return v.decode("latin-1")


def operations(data: bytes) -> list[tuple[str, list]]:
    """(operator, operands) of a content stream; inline images become INLINE_IMAGE with their entries."""
    out: list[tuple[str, list]] = []
    operands: list = []
    r = Reader(data)
    while True:
        try:
            v = r.value()
        except ValueError:
            return out
        if not isinstance(v, Keyword):
            operands.append(v)
        elif v == "BI":
            m = re.compile(rb"(.*?)\bID[\x00\t\n\x0c\r ](.*?)[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)", re.S).match(data, r.at)
            if not m:
                return out
            head = Reader(b"<<" + m[1] + b">>").value()
            out.append(("INLINE_IMAGE", [head]))
            operands, r = [], Reader(data, m.end())
        elif v not in ("]", ">>", "{", "}"):
            out.append((str(v), operands))
            operands = []


def canonical(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, Name):
        return "/" + v
    if isinstance(v, bytes):
        return f"<{v.hex().upper()}>"
    if isinstance(v, Ref):
        return f"{v.id} {v.gen} R"
    if isinstance(v, list):
        return " ".join(["[", *map(canonical, v), "]"])
    if isinstance(v, dict):
        return " ".join(["<<", *(f"/{k} {canonical(x)}" for k, x in sorted(v.items())), ">>"])
    if isinstance(v, Stream):
        return f"{canonical(v.header)} stream {len(v.body)}"
    return f"{v:g}" if isinstance(v, float) else str(v)


def references(v) -> list[Ref]:
    if isinstance(v, Ref):
        return [v]
    if isinstance(v, Stream):
        v = v.header
    parts = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
    return [r for x in parts for r in references(x)]


class CMap:
    """Codespaces and mappings of a ToUnicode stream."""

    def __init__(self, data: bytes):
        self.spaces: list[tuple[int, int, int]] = []
        self.map: dict[tuple[int, int], str] = {}
        chars, ranges = [], []
        stack: list = []
        inner: list | None = None
        for kind, v, _, _ in tokens(data):
            if kind == "word" and v in ("begincodespacerange", "beginbfchar", "beginbfrange"):
                stack = []
            elif kind == "word" and v == "endcodespacerange":
                self.spaces += [(len(a), int.from_bytes(a, "big"), int.from_bytes(b, "big")) for a, b in zip(stack[::2], stack[1::2], strict=False)]
            elif kind == "word" and v == "endbfchar":
                chars += zip(stack[::2], stack[1::2], strict=False)
            elif kind == "word" and v == "endbfrange":
                ranges += [stack[k : k + 3] for k in range(0, len(stack) - 2, 3)]
            elif kind == "array":
                inner = [] if v == "[" else None
                if inner is not None:
                    stack.append(inner)
            elif kind == "str":
                (stack if inner is None else inner).append(v)
        for a, b in chars:
            self.map[len(a), int.from_bytes(a, "big")] = b.decode("utf-16-be", "replace")
        for low, high, to in ranges:
            first, last = int.from_bytes(low, "big"), int.from_bytes(high, "big")
            for k, code in enumerate(range(first, last + 1)):
                if isinstance(to, list):
                    if k < len(to):
                        self.map[len(low), code] = to[k].decode("utf-16-be", "replace")
                else:
                    unit = int.from_bytes(to[-2:], "big") + k
                    if unit > 0xFFFF:
                        raise ValueError("a range runs over its last unit")
                    self.map[len(low), code] = (to[:-2] + unit.to_bytes(2, "big")).decode("utf-16-be", "replace")

    def decode(self, s: bytes) -> str:
        out, at = [], 0
        while at < len(s):
            for n, low, high in self.spaces or [(1, 0, 255)]:
                code = int.from_bytes(s[at : at + n], "big")
                if at + n <= len(s) and low <= code <= high:
                    out.append(self.map.get((n, code), chr(s[at])))
                    at += n
                    break
            else:
                out.append(chr(s[at]))
                at += 1
        return "".join(out)


def font_encoding(doc: Document, font: dict) -> dict[int, str] | None:
    """Characters by code where a font has an encoding of its own."""
    enc = doc.get(font.get("Encoding"))
    base = enc if isinstance(enc, Name) else enc.get("BaseEncoding") if isinstance(enc, dict) else None
    if enc is None:
        return None
    table = {i: chr(i) for i in range(256)}
    if found := encodings.from_name(str(base)):
        table = table | encodings.table(found)
    code = 0
    for x in doc.get(enc.get("Differences")) or [] if isinstance(enc, dict) else []:
        if isinstance(x, int):
            code = x
        elif isinstance(x, Name):
            table[code] = glyph_text(x) or table.get(code, "")
            code += 1
    return table


def glyph_text(name: str) -> str:
    """Text of a glyph name: uniXXXX groups, uXXXX to uXXXXXX, single characters, and parts joined by "_"; the
    name's ending from the first "." on doesn't count. Empty where a part has no text."""
    out = []
    for part in name.split(".", 1)[0].split("_"):
        if re.fullmatch(r"uni(?:[0-9A-F]{4})+", part):
            codes = [int(part[k : k + 4], 16) for k in range(3, len(part), 4)]
        elif re.fullmatch(r"u[0-9A-F]{4,6}", part):
            codes = [int(part[1:], 16)]
        elif part in GLYPHS:
            codes = [ord(GLYPHS[part])]
        elif len(part) == 1:
            codes = [ord(part)]
        else:
            return ""
        if any(0xD800 <= c < 0xE000 or c > 0x10FFFF for c in codes):
            return ""
        out += map(chr, codes)
    return "".join(out)


#: Characters by glyph name.
GLYPHS = encodings.names()


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    return (a * n[0] + b * n[2], a * n[1] + b * n[3], c * n[0] + d * n[2], c * n[1] + d * n[3], e * n[0] + f * n[2] + n[4], e * n[1] + f * n[3] + n[5])


def text_runs(doc: Document, page: dict) -> list[tuple[str, float, float, float]]:
    """(text, x, y, font size) of every text-showing operator of a page."""
    resources = doc.get(page.get("Resources"))
    fonts = doc.get(resources.get("Font")) if isinstance(resources, dict) else {}
    decoders: dict[str, object] = {}

    def decoder(name: str):
        if name not in decoders:
            font = doc.get((fonts or {}).get(name))
            decode = lambda s: text_string(s)
            if isinstance(font, dict):
                to_unicode = doc.get(font.get("ToUnicode"))
                if isinstance(to_unicode, Stream):
                    decode = CMap(doc.stream_bytes(to_unicode)).decode
                elif (table := font_encoding(doc, font)) is not None:
                    decode = lambda s, t=table: text_string(s) if s[:2] == b"\xfe\xff" else "".join(t[c] for c in s)
            decoders[name] = decode
        return decoders[name]

    out: list[tuple[str, float, float, float]] = []
    identity = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    ctm, tm, lm, lead, font, size, stack = identity, identity, identity, 0.0, "", 0.0, []

    def show(s: bytes) -> None:
        at = _times(tm, ctm)
        out.append((decoder(font)(s), at[4], at[5], size))

    for op, args in operations(doc.contents(page)):
        try:
            if op == "q":
                stack.append(ctm)
            elif op == "Q" and stack:
                ctm = stack.pop()
            elif op == "cm":
                ctm = _times(tuple(map(float, args)), ctm)
            elif op == "BT":
                tm = lm = identity
            elif op == "Tf":
                font, size = str(args[0]), float(args[1])
            elif op == "TL":
                lead = float(args[0])
            elif op in ("Td", "TD"):
                lead = -float(args[1]) if op == "TD" else lead
                tm = lm = _times((1, 0, 0, 1, float(args[0]), float(args[1])), lm)
            elif op == "Tm":
                tm = lm = tuple(map(float, args))
            elif op == "T*":
                tm = lm = _times((1, 0, 0, 1, 0, -lead), lm)
            elif op == "Tj":
                show(args[0])
            elif op == "TJ":
                show(b"".join(x for x in args[0] if isinstance(x, bytes)) if len({x[:2] == b"\xfe\xff" for x in args[0] if isinstance(x, bytes)}) < 2 else args[0][0])
            elif op in ("'", '"'):
                tm = lm = _times((1, 0, 0, 1, 0, -lead), lm)
                show(args[-1])
        except (IndexError, TypeError, ValueError):
            continue
    return out


def page_text(doc: Document, page: dict) -> str:
    """Runs on a new baseline begin a new line; white space at the ends of the text goes."""
    out, before = [], None
    for text, _, y, _ in text_runs(doc, page):
        if before is not None and abs(y - before) > 1e-3:
            out.append("\n")
        out.append(text)
        before = y
    return "".join(out).rstrip()


def box_of(page: dict, doc: Document) -> tuple[float, float, float, float]:
    box = doc.get(page.get("MediaBox")) or [0, 0, 612, 792]
    try:
        x0, y0, x1, y1 = (float(doc.get(v)) for v in box)
    except (TypeError, ValueError):
        x0, y0, x1, y1 = 0.0, 0.0, 612.0, 792.0
    return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)


def rotation_of(page: dict, doc: Document) -> int:
    r = doc.get(page.get("Rotate")) or 0
    quarters = int(abs(r) / 90 + 0.5)
    return (quarters if r >= 0 else -quarters) * 90 % 360
