"""Writing documents: a fresh file from pages of text lines, incremental updates, compaction, and page sets."""

from __future__ import annotations

import hashlib
import zlib

from .crypto import authenticate, encrypt_entries
from .pdf import Document, Name, Ref, Str, Stream, crypt_value, references


def _value(v) -> bytes:
    if isinstance(v, Stream):
        head = {**v.header, "Length": len(v.body)}
        return _value(head) + b"\nstream\n" + v.body + b"\nendstream"
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return b"/" + b"".join(bytes((c,)) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in v.encode("latin-1", "replace"))
    if isinstance(v, bytes):
        return b"<" + v.hex().upper().encode() + b">"
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, list):
        return b"[" + b" ".join(map(_value, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(_value(Name(k)) + b" " + _value(x) for k, x in v.items()) + b">>"
    return (f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)).encode()


def _xref(offsets: dict[int, tuple[int, int]]) -> bytes:
    lines, ids = [], sorted(offsets)
    k = 0
    while k < len(ids):
        end = k
        while end + 1 < len(ids) and ids[end + 1] == ids[end] + 1:
            end += 1
        lines.append(b"%d %d\n" % (ids[k], end - k + 1))
        lines += [b"%010d %05d %s \n" % (*offsets[i], b"n" if i else b"f") for i in ids[k : end + 1]]
        k = end + 1
    return b"xref\n" + b"".join(lines)


def write(objects: dict[int, object], trailer: dict) -> bytes:
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    offsets = {0: (0, 65535)}
    for i, v in sorted(objects.items()):
        offsets[i] = (len(out), 0)
        out += b"%d 0 obj\n" % i + _value(v) + b"\nendobj\n"
    at = len(out)
    free = [i for i in range(max(objects, default=0) + 1) if i not in offsets]
    for i in free:
        offsets[i] = (0, 65535)
    body = _xref({i: o for i, o in offsets.items() if i == 0 or i in objects})
    out += body + b"trailer\n" + _value({**trailer, "Size": max(objects, default=0) + 1}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def append(data: bytes, changed: dict[int, object]) -> bytes:
    """An incremental update: the file as it is, changed objects, and a section that points back."""
    doc = Document.open(data)
    prev = int(data[data.rfind(b"startxref") + 9 :].split()[0])
    out, offsets = bytearray(data if data.endswith(b"\n") else data + b"\n"), {}
    for i, v in sorted(changed.items()):
        offsets[i] = (len(out), 0)
        out += b"%d 0 obj\n" % i + _value(v) + b"\nendobj\n"
    at = len(out)
    keep = {k: doc.trailer[k] for k in ("Root", "Info", "ID", "Encrypt") if k in doc.trailer}
    size = max([int(doc.trailer.get("Size", 0)), *(i + 1 for i in changed)])
    out += _xref(offsets) + b"trailer\n" + _value({**keep, "Size": size, "Prev": prev}) + b"\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def reachable(doc: Document) -> set[int]:
    todo = references(dict(doc.trailer))
    found: set[int] = set()
    while todo:
        ref = todo.pop()
        if ref.id not in found and ref.id in doc.objects:
            found.add(ref.id)
            todo += references(doc.objects[ref.id][1])
    return found


def compact(data: bytes) -> bytes:
    """Only what the trailer reaches, written anew."""
    doc = Document.open(data)
    keep = reachable(doc)
    return write({i: doc.objects[i][1] for i in keep}, {k: doc.trailer[k] for k in ("Root", "Info", "ID") if k in doc.trailer})


def empty_document() -> bytes:
    return write({1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 2: {"Type": Name("Pages"), "Kids": [], "Count": 0}}, {"Root": Ref(1, 0)})


def _operand(text: str) -> bytes:
    return Str(text.encode("ascii")) if text.isascii() else Str(b"\xfe\xff" + text.encode("utf-16-be"))


def from_pages(pages: list[list[str]], size: float = 12.0, info: dict[str, str] | None = None, outline: list[tuple[int, str]] = (), compress: bool = True) -> bytes:
    """A document of pages of lines, with information entries and an outline of (depth, title)."""
    font, kids = 3, []
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, font: {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica")}}
    for lines in pages:
        ops = [b"BT /F1 %g Tf 72 720 Td" % size]
        for k, line in enumerate(lines):
            if k:
                ops.append(b"0 %g Td" % (-1.2 * size))
            ops.append(_value(_operand(line)) + b" Tj")
        body = b"\n".join([*ops, b"ET"])
        i = max(objects) + 1
        objects[i] = Stream({"Filter": Name("FlateDecode")}, zlib.compress(body)) if compress else Stream({}, body)
        objects[i + 1] = {"Type": Name("Page"), "Parent": Ref(2, 0), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": {"F1": Ref(font, 0)}}, "Contents": Ref(i, 0)}
        kids.append(Ref(i + 1, 0))
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}
    trailer: dict = {"Root": Ref(1, 0)}
    if info:
        i = max(objects) + 1
        objects[i] = {k: _operand(v) for k, v in info.items()}
        trailer["Info"] = Ref(i, 0)
    if outline:
        top = max(objects) + 1
        objects[top] = {"Type": Name("Outlines")}
        at, last = [top], {}
        for depth, title in outline:
            del at[depth + 1 :]
            i, parent = max(objects) + 1, at[-1]
            objects[i] = {"Title": _operand(title), "Parent": Ref(parent, 0)}
            if parent in last:
                objects[last[parent]]["Next"], objects[i]["Prev"] = Ref(i, 0), Ref(last[parent], 0)
            else:
                objects[parent]["First"] = Ref(i, 0)
            last[parent] = i
            objects[parent]["Last"] = Ref(i, 0)
            at.append(i)
        objects[1]["Outlines"] = Ref(top, 0)
    return write(objects, trailer)


def encrypt(data: bytes, user: bytes, owner: bytes, revision: int = 6, permissions: int = -44, seed: bytes = b"") -> bytes:
    """The document under passwords: RC4 for revisions 2 and 3, AES for 4 to 6. Keys and vectors come from ``seed``,
    which must be random where the result is to be secret."""
    doc = Document.open(data)
    salt, file_id = hashlib.sha256(b"salt" + seed).digest(), hashlib.md5(b"id" + seed + data).digest()
    bits = {2: 40, 3: 128, 4: 128}.get(revision, 256)
    entries = encrypt_entries(user, owner, revision, bits, permissions, file_id, salt, hashlib.sha256(b"key" + seed).digest())
    key = authenticate(entries, user, file_id)[1]
    method = {2: "V2", 3: "V2", 4: "AESV2"}.get(revision, "AESV3")
    iv = hashlib.md5(b"iv" + seed).digest()
    keep = reachable(doc)
    objects = {i: crypt_value(doc.objects[i][1], method, method, key, i, 0, iv if revision >= 4 else b"") for i in keep}
    head: dict = {"Filter": Name("Standard"), "V": {2: 1, 3: 2, 4: 4}.get(revision, 5), **{k: Str(v) if isinstance(v, bytes) else v for k, v in entries.items()}}
    if revision >= 4:
        head |= {"CF": {"StdCF": {"CFM": Name(method), "AuthEvent": Name("DocOpen"), "Length": bits // 8}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    top = max(objects, default=0) + 1
    objects[top] = head
    trailer = {k: doc.trailer[k] for k in ("Root", "Info") if k in doc.trailer}
    return write(objects, {**trailer, "Encrypt": Ref(top, 0), "ID": [Str(file_id), Str(file_id)]})


def decrypt(data: bytes, password: bytes) -> bytes:
    """The document without its passwords."""
    doc = Document.open(data, password)
    doc.trailer.pop("Encrypt", None)
    keep = reachable(doc)
    return write({i: doc.objects[i][1] for i in keep}, {k: doc.trailer[k] for k in ("Root", "Info", "ID") if k in doc.trailer})


def _shifted(v, by: int):
    if isinstance(v, Ref):
        return Ref(v.id + by, 0)
    if isinstance(v, list):
        return [_shifted(x, by) for x in v]
    if isinstance(v, dict):
        return {k: _shifted(x, by) for k, x in v.items()}
    return Stream(_shifted(v.header, by), v.body) if isinstance(v, Stream) else v


def assemble(parts: list[tuple[bytes, list[int] | None]]) -> bytes:
    """One document of chosen pages (numbers from 1, None for all) of several, in that order."""
    objects: dict[int, object] = {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}}
    kids: list[Ref] = []
    top = 2
    for data, chosen in parts:
        doc = Document.open(data)
        leaves = doc.pages()
        for n in chosen if chosen is not None else range(1, len(leaves) + 1):
            if not 1 <= n <= len(leaves):
                raise ValueError(f"there is no page {n}")
            leaf = leaves[n - 1]
            top += 1
            kids.append(Ref(top, 0))
            objects[top] = (doc, {k: v for k, v in leaf.items() if k not in ("_id", "Parent")})
    out: dict[int, object] = {1: objects[1], 2: {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}}
    bases: dict[int, int] = {}
    for i, held in objects.items():
        if i <= 1:
            continue
        doc, leaf = held
        if id(doc) not in bases:
            bases[id(doc)] = top
            top += max(doc.objects, default=0)
        by = bases[id(doc)]
        out[i] = {**_shifted(leaf, by), "Parent": Ref(2, 0)}
        todo = references(leaf)
        seen: set[int] = set()
        while todo:
            ref = todo.pop()
            if ref.id in seen or ref.id not in doc.objects:
                continue
            seen.add(ref.id)
            v = doc.objects[ref.id][1]
            if isinstance(v, dict) and v.get("Type") in ("Pages", "Page", "Catalog"):
                continue
            out[ref.id + by] = _shifted(v, by)
            todo += references(v)
    return write(out, {"Root": Ref(1, 0)})
