"""Edits of documents: each is (operation, arguments), applied in turn to a document's objects, which are then
written anew. Page numbers count from 1."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from .pdf import Document, Keyword, Name, Reader, Ref, Str, Stream, operations, text_runs, text_string, tokens
from .pdf_write import _operand, _value, write


class Editor:
    def __init__(self, data: bytes):
        self.doc = Document.open(data)
        self.objects = {i: v for i, (_, v) in self.doc.objects.items()}
        self.trailer = {k: self.doc.trailer[k] for k in ("Root", "Info", "ID") if k in self.doc.trailer}
        self._flatten()

    def save(self) -> bytes:
        return write(self.objects, self.trailer)

    # objects

    def add(self, v) -> Ref:
        i = max(self.objects, default=0) + 1
        self.put(Ref(i, 0), v)
        return Ref(i, 0)

    def put(self, ref: Ref, v) -> None:
        self.objects[ref.id] = v
        self.doc.objects[ref.id] = (0, v)

    def get(self, v):
        return self.doc.get(v)

    @property
    def root(self) -> dict:
        return self.objects[self.trailer["Root"].id]

    def _flatten(self) -> None:
        """All leaves become children of one node and hold what they inherited."""
        top = self.root.get("Pages")
        kids = []
        for leaf in self.doc.pages():
            ref = Ref(leaf.pop("_id"), 0)
            self.put(ref, {**leaf, "Parent": top})
            kids.append(ref)
        self._set_kids(kids)

    @property
    def kids(self) -> list[Ref]:
        return self.objects[self.root["Pages"].id]["Kids"]

    def _set_kids(self, kids: list[Ref]) -> None:
        self.put(self.root["Pages"], {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})

    def page(self, n: int) -> dict:
        if not 1 <= n <= len(self.kids):
            raise ValueError(f"there is no page {n}")
        return self.objects[self.kids[n - 1].id]

    # pages

    def add_page(self, at: int | None = None, width: float = 595, height: float = 842, copy_of: int | None = None) -> None:
        page = dict(self.page(copy_of)) if copy_of else {"Type": Name("Page"), "MediaBox": [0, 0, width, height], "Resources": {}}
        kids = list(self.kids)
        kids.insert(len(kids) if at is None else at - 1, self.add({**page, "Parent": self.root["Pages"]}))
        self._set_kids(kids)

    def delete_pages(self, pages: list[int]) -> None:
        self._set_kids([k for n, k in enumerate(self.kids, 1) if n not in set(pages)])

    def set_rotation(self, page: int, degrees: int) -> None:
        self.page(page)["Rotate"] = degrees % 360

    def set_box(self, page: int, box: str, rect: list[float]) -> None:
        self.page(page)[box] = list(map(float, rect))

    # text and pictures

    def _draw(self, page: int, ops: bytes, **resources: dict) -> None:
        """Content after that of the page, in a state of its own."""
        p = self.page(page)
        held = self.get(p.get("Contents"))
        old = list(held) if isinstance(held, list) else [p["Contents"]] if isinstance(held, Stream) else []
        p["Contents"] = [self.add(Stream({}, b"q")), *old, self.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"Q q " + ops + b" Q")))]
        mine = dict(self.get(p.get("Resources")) or {})
        for kind, entries in resources.items():
            mine[kind] = {**(self.get(mine.get(kind)) or {}), **entries}
        p["Resources"] = mine

    def add_text(self, page: int, text: str, x: float, y: float, size: float = 12, font: str = "Helvetica") -> None:
        ref = self.add({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(font)})
        name = f"Lm{ref.id}"
        self._draw(page, b"BT /%s %g Tf %g %g Td %s Tj ET" % (name.encode(), size, x, y, _value(_operand(text))), Font={name: ref})

    def stamp(self, text: str, y: float, number_from: int = 1) -> None:
        """The text on every page; "#" stands for the page's number, which follows the text where there is none."""
        for n in range(1, len(self.kids) + 1):
            k = str(n + number_from - 1)
            self.add_text(n, text.replace("#", k) if "#" in text else text + k, 72, y, 10)

    def header(self, text: str) -> None:
        for n in range(1, len(self.kids) + 1):
            self.add_text(n, text, 72, 800, 10)

    def footer(self, text: str) -> None:
        for n in range(1, len(self.kids) + 1):
            self.add_text(n, text, 72, 30, 10)

    def add_image(self, page: int, width: int, height: int, rgb: bytes, rect: list[float]) -> None:
        ref = self.add(Stream({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": width, "Height": height, "ColorSpace": Name("DeviceRGB"), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}, zlib.compress(rgb)))
        x0, y0, x1, y1 = rect
        name = f"Im{ref.id}"
        self._draw(page, b"%g 0 0 %g %g %g cm /%s Do" % (x1 - x0, y1 - y0, x0, y0, name.encode()), XObject={name: ref})

    def delete_images(self, page: int, names: list[str] | None = None) -> None:
        p = self.page(page)
        resources = dict(self.get(p.get("Resources")) or {})
        found = dict(self.get(resources.get("XObject")) or {})
        gone = {k for k, r in found.items() if isinstance(self.get(r), Stream) and self.get(r).header.get("Subtype") == "Image" and (names is None or k in names)}
        p["Resources"] = {**resources, "XObject": {k: r for k, r in found.items() if k not in gone}}
        self._rewrite(page, lambda op, args: None if op == "Do" and args and args[0] in gone else (op, args))

    def _rewrite(self, page: int, change: Callable) -> None:
        out = []
        for op, args in operations(self.doc.contents(self.page(page))):
            new = change(op, args)
            if new is None:
                continue
            op, args = new
            if op == "INLINE_IMAGE":
                continue
            out.append(b" ".join([*map(_value, args), op.encode()]))
        self.page(page)["Contents"] = self.add(Stream({"Filter": Name("FlateDecode")}, zlib.compress(b"\n".join(out))))

    def replace_text(self, old: str, new: str, page: int | None = None) -> int:
        """Shown strings that equal ``old`` whole; the number of replacements."""
        count = 0

        def change(op: str, args: list):
            nonlocal count
            if op in ("Tj", "'", '"') and args and isinstance(args[-1], bytes) and text_string(args[-1]) == old:
                count += 1
                return op, [*args[:-1], _operand(new)]
            return op, args

        for n in [page] if page else range(1, len(self.kids) + 1) if old else []:
            self._rewrite(n, change)
        return count

    def redact(self, page: int, rect: list[float]) -> None:
        """Drops text runs whose boxes (half an em a character, open intervals) overlap the region, and covers it."""
        x0, y0, x1, y1 = rect
        inside = [x < x1 and x0 < x + len(t) * s * 0.5 and y < y1 and y0 < y + s for t, x, y, s in text_runs(self.doc, {**self.page(page)})]
        spots = iter(inside)

        def change(op: str, args: list):
            if op in ("Tj", "TJ", "'", '"') and next(spots, False):
                return (op, [[]]) if op == "TJ" else (op, [*args[:-1], Str(b"")])
            return op, args

        self._rewrite(page, change)
        self._draw(page, b"0 g %g %g %g %g re f" % (x0, y0, x1 - x0, y1 - y0))

    # document parts

    def set_info(self, entries: dict[str, str | None]) -> None:
        held = dict(self.get(self.trailer.get("Info")) or {})
        for k, v in entries.items():
            held.pop(k, None)
            if v is not None:
                held[k] = _operand(v)
        self.trailer["Info"] = self.add(held)

    def set_metadata(self, packet: bytes) -> None:
        self.root["Metadata"] = self.add(Stream({"Type": Name("Metadata"), "Subtype": Name("XML")}, packet))

    def set_outline(self, items: list[tuple[int, str, int]]) -> None:
        """(depth, title, page) in preorder; a page that isn't there counts as the first."""
        top = self.add({"Type": Name("Outlines"), "Count": len(items)})
        at, last = [top], {}
        for depth, title, page in items:
            del at[depth + 1 :]
            parent = at[-1]
            dest = self.kids[page - 1 if 1 <= page <= len(self.kids) else 0]
            item = self.add({"Title": _operand(title), "Parent": parent, "Dest": [dest, Name("Fit")]})
            if parent in last:
                self.objects[last[parent].id]["Next"], self.objects[item.id]["Prev"] = item, last[parent]
            else:
                self.objects[parent.id]["First"] = item
            last[parent] = self.objects[parent.id]["Last"] = item
            at.append(item)
        self.root["Outlines"] = top

    def rename_bookmarks(self, old: str, new: str) -> None:
        for i, v in self.objects.items():
            if isinstance(v, dict) and "Title" in v and "Parent" in v and text_string(self.get(v["Title"])) == old:
                self.objects[i]["Title"] = _operand(new)

    def add_annotation(self, page: int, subtype: str, rect: list[float], contents: str = "", name: str = "") -> None:
        p = self.page(page)
        a = self.add({"Type": Name("Annot"), "Subtype": Name(subtype), "Rect": list(map(float, rect)), "Contents": _operand(contents), "NM": _operand(name)})
        p["Annots"] = [*(self.get(p.get("Annots")) or []), a]

    def delete_annotations(self, subtype: str | None = None, name: str | None = None) -> None:
        for n in range(1, len(self.kids) + 1):
            p = self.page(n)
            keep = []
            for ref in self.get(p.get("Annots")) or []:
                a = self.get(ref)
                hit = isinstance(a, dict) and (subtype is None or a.get("Subtype") == subtype) and (name is None or text_string(self.get(a.get("NM"))) == name)
                keep += [] if hit else [ref]
            p["Annots"] = keep

    def _tree(self, key: str) -> list[tuple[str, object]]:
        names = self.get(self.root.get("Names")) or {}
        return [(text_string(k), v) for k, v in self.doc.tree(names.get(key))]

    def _set_tree(self, key: str, pairs: list[tuple[str, object]]) -> None:
        flat = [x for k, v in sorted(pairs, key=lambda kv: kv[0]) for x in (_operand(k), v)]
        self.root["Names"] = {**(self.get(self.root.get("Names")) or {}), key: self.add({"Names": flat})}

    def attach(self, name: str, data: bytes, mime: str = "application/octet-stream") -> None:
        body = self.add(Stream({"Type": Name("EmbeddedFile"), "Subtype": Name(mime), "Filter": Name("FlateDecode"), "Params": {"Size": len(data)}}, zlib.compress(data)))
        spec = self.add({"Type": Name("Filespec"), "F": _operand(name), "UF": _operand(name), "EF": {"F": body}})
        self._set_tree("EmbeddedFiles", [(k, v) for k, v in self._tree("EmbeddedFiles") if k != name] + [(name, spec)])

    def detach(self, name: str) -> None:
        self._set_tree("EmbeddedFiles", [(k, v) for k, v in self._tree("EmbeddedFiles") if k != name])

    def set_destination(self, name: str, page: int, verb: str = "Fit", operands: list[float] = ()) -> None:
        self._set_tree("Dests", [(k, v) for k, v in self._tree("Dests") if k != name] + [(name, [self.kids[page - 1], Name(verb), *operands])])

    def set_page_label(self, start: int, style: str = "D", prefix: str = "", first: int = 1) -> None:
        """A range that begins at the page with index ``start``, counted from 0."""
        pairs = {k: v for k, v in self.doc.tree(self.root.get("PageLabels"), "Nums")}
        pairs[start] = {"S": Name(style), "St": first} | ({"P": _operand(prefix)} if prefix else {})
        self.root["PageLabels"] = self.add({"Nums": [x for k in sorted(pairs) for x in (k, pairs[k])]})

    def add_field(self, name: str, kind: str, page: int, rect: list[float], value: str = "", flags: int = 0) -> None:
        field = {"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name(kind), "T": _operand(name), "Ff": flags, "Rect": list(map(float, rect))}
        ref = self.add(field | ({"V": _operand(value)} if value else {}))
        form = dict(self.get(self.root.get("AcroForm")) or {})
        self.root["AcroForm"] = {**form, "Fields": [*(self.get(form.get("Fields")) or []), ref]}
        p = self.page(page)
        p["Annots"] = [*(self.get(p.get("Annots")) or []), ref]

    def _drop_fields(self, gone: set[int], form: dict | None) -> None:
        for n in range(1, len(self.kids) + 1):
            p = self.page(n)
            if "Annots" in p:
                p["Annots"] = [r for r in self.get(p["Annots"]) or [] if not (isinstance(r, Ref) and r.id in gone)]
        if form is None:
            self.root.pop("AcroForm", None)
        else:
            self.root["AcroForm"] = form

    def remove_field(self, name: str) -> None:
        form = dict(self.get(self.root.get("AcroForm")) or {})
        fields = self.get(form.get("Fields")) or []
        gone = {r.id for r in fields if isinstance(r, Ref) and text_string(self.get((self.get(r) or {}).get("T"))) == name}
        self._drop_fields(gone, {**form, "Fields": [r for r in fields if not (isinstance(r, Ref) and r.id in gone)]})

    def flatten_form(self) -> None:
        """Fields and form go; values aren't drawn."""
        fields = self.get((self.get(self.root.get("AcroForm")) or {}).get("Fields")) or []
        self._drop_fields({r.id for r in fields if isinstance(r, Ref)}, None)

    def wrap_paragraph(self, page: int, text: str, x: float, y: float, width: float, size: float = 12) -> int:
        """Words filled greedily into lines 1.2 sizes apart, half an em a character; the number of lines."""
        lines: list[str] = []
        for word in text.split():
            if lines and (len(lines[-1]) + 1 + len(word)) * size * 0.5 <= width:
                lines[-1] += " " + word
            else:
                lines.append(word)
        for k, line in enumerate(lines):
            self.add_text(page, line, x, y - 1.2 * size * k, size)
        return len(lines)


OPERATIONS = tuple(n for n in vars(Editor) if not n.startswith("_") and n not in ("save", "add", "put", "get", "root", "kids", "page"))


def apply_edits(data: bytes, edits: list[tuple[str, dict]]) -> bytes:
    """No edits leave the bytes as they are."""
    if not edits:
        return data
    editor = Editor(data)
    for op, args in edits:
        if op not in OPERATIONS:
            raise ValueError(f"unknown edit: {op}")
        getattr(editor, op)(**args)
    return editor.save()


def escape_literal(s: bytes) -> bytes:
    return re.sub(rb"([\\()])", rb"\\\1", s)


def lex(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all tokens."""
    return [(kind, a, b) for kind, _, a, b in tokens(data)]


def parse_value(data: bytes):
    v = Reader(data).value()
    if isinstance(v, Keyword):
        raise ValueError("no value here")
    return v
