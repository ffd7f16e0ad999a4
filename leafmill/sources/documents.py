"""Documents as tables: a binary column becomes rows of objects, pages, text, outlines and more.

Each table is one ``mapInArrow`` pass that yields only what the table needs; a document is parsed in the task
that holds its row, and nothing is shuffled. A document that can't be read gives no rows, or raises with
``mode="FAILFAST"``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.kernels import pdf, signing


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and content of the files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")


def _xref(d: pdf.Document):
    for (i, gen), e in sorted(d.xref.items()):
        yield {"id": i, "gen": gen, "kind": e.kind, "offset_or_stream": e.offset, "index_in_stream": e.index, "recovered": d.recovered}


def _trailer(d: pdf.Document):
    num = lambda k: d.trailer[k].id if isinstance(d.trailer.get(k), pdf.Ref) else 0
    yield {"size": int(d.trailer.get("Size", 0)), "root_id": num("Root"), "info_id": num("Info"), "encrypt_id": num("Encrypt")}


def _kind(v) -> str:
    for kind, name in ((pdf.Stream, "stream"), (dict, "dict"), (list, "array"), (pdf.Name, "name"), (bytes, "string"), (bool, "bool"), (pdf.Ref, "ref"), (int, "int"), (float, "double")):
        if isinstance(v, kind):
            return name
    return "null"


def _objects(d: pdf.Document):
    for i, (gen, v) in sorted(d.objects.items()):
        yield {"id": i, "gen": gen, "kind": _kind(v), "value": pdf.canonical(v), "refs": [{"id": r.id, "gen": r.gen} for r in pdf.references(v)]}


def _pages(d: pdf.Document):
    for n, p in enumerate(d.pages(), 1):
        x0, y0, x1, y1 = pdf.box_of(p, d)
        yield {"object_id": p["_id"], "pagenum": n, "width": x1 - x0, "height": y1 - y0, "rotation": pdf.rotation_of(p, d)}


def _ops(d: pdf.Document):
    for n, p in enumerate(d.pages(), 1):
        for k, (op, args) in enumerate(pdf.operations(d.contents(p))):
            yield {"pagenum": n, "seq": k, "op": op, "operands": list(map(pdf.canonical, args))}


def _text(d: pdf.Document):
    for n, p in enumerate(d.pages(), 1):
        yield {"pagenum": n, "text": pdf.page_text(d, p)}


def _runs(d: pdf.Document):
    for n, p in enumerate(d.pages(), 1):
        for k, (text, x, y, size) in enumerate(pdf.text_runs(d, p)):
            yield {"pagenum": n, "seq": k, "text": text, "x": float(x), "y": float(y), "font_size": float(size)}


def _outlines(d: pdf.Document):
    for k, (depth, title) in enumerate(d.outline()):
        yield {"seq": k, "depth": depth, "title": title}


def _outline_items(d: pdf.Document):
    numbers = {p["_id"]: n for n, p in enumerate(d.pages(), 1)}
    seen: set = set()

    def target(v):
        v = d.get(v)
        v = d.get(v.get("D")) if isinstance(v, dict) else v
        if isinstance(v, list) and v:
            return numbers.get(v[0].id) if isinstance(v[0], pdf.Ref) else None, str(v[1]) if len(v) > 1 else ""
        return None, ""

    def walk(ref, depth: int):
        while isinstance(ref, pdf.Ref) and ref not in seen and depth < 100:
            seen.add(ref)
            item = d.get(ref)
            if not isinstance(item, dict):
                return
            action = d.get(item.get("A"))
            action = action if isinstance(action, dict) else {}
            page, verb = target(item["Dest"] if "Dest" in item else action.get("D"))
            flags, colour = d.get(item.get("F")), [float(x) for x in d.get(item.get("C")) or [] if isinstance(x, int | float)]
            flags = flags if isinstance(flags, int) else 0
            yield {
                "depth": depth, "title": pdf.text_string(d.get(item.get("Title"))), "page": page, "verb": verb, "action": str(d.get(action.get("S")) or ""), "uri": pdf.text_string(d.get(action.get("URI"))),
                "italic": bool(flags & 1), "bold": bool(flags & 2), "colour": colour, "open": not (isinstance(d.get(item.get("Count")), int) and d.get(item.get("Count")) < 0),
            }
            yield from walk(item.get("First"), depth + 1)
            ref = item.get("Next")

    top = d.get(d.root().get("Outlines"))
    for k, row in enumerate(walk(top.get("First"), 0) if isinstance(top, dict) else []):
        yield {"seq": k, **row}


#: What a page's box is where the page has none.
_BOX_DEFAULTS = {"MediaBox": None, "CropBox": "MediaBox", "BleedBox": "CropBox", "TrimBox": "CropBox", "ArtBox": "CropBox"}


def _page_boxes(d: pdf.Document):
    for n, p in enumerate(d.pages(), 1):
        found: dict[str, list[float]] = {}
        for box, otherwise in _BOX_DEFAULTS.items():
            own = [d.get(x) for x in d.get(p.get(box)) or []]
            own = own if len(own) == 4 and all(isinstance(x, int | float) for x in own) else None
            if own is not None:
                found[box] = [float(min(own[0], own[2])), float(min(own[1], own[3])), float(max(own[0], own[2])), float(max(own[1], own[3]))]
            else:
                found[box] = found[otherwise] if otherwise else list(pdf.box_of(p, d))
            yield {"pagenum": n, "box": box, "rect": found[box], "own": own is not None}


def _widgets(d: pdf.Document):
    numbers = {p["_id"]: n for n, p in enumerate(d.pages(), 1)}
    places = {ref.id: n for n, p in enumerate(d.pages(), 1) for ref in d.get(p.get("Annots")) or [] if isinstance(ref, pdf.Ref)}
    for i, (_, f) in sorted(d.objects.items()):
        if isinstance(f, dict) and f.get("Subtype") == "Widget":
            page = places.get(i) or (numbers.get(f["P"].id) if isinstance(f.get("P"), pdf.Ref) else None)
            if page is None:  # on no page any more
                continue
            yield {"name": pdf.text_string(d.get(f.get("T"))), "pagenum": page, "rect": [float(x) for x in d.get(f.get("Rect")) or [] if isinstance(x, int | float)]}


def _metadata(d: pdf.Document):
    s = d.get(d.root().get("Metadata"))
    if isinstance(s, pdf.Stream):
        yield {"packet": d.stream_bytes(s)}


def _canonical(d: pdf.Document):
    """Dumps of a document's parts, a line each."""
    lines: dict[str, list[str]] = {"xref": [], "trailer": [], "objects": [], "pages_tree": [], "outlines": [], "content_stream": [], "to_unicode": [], "digest": []}
    for r in _xref(d):
        if r["kind"] == "compressed":
            lines["xref"].append(f"{r['id']} {r['gen']} compressed {r['offset_or_stream']} {r['index_in_stream']}")
        else:
            lines["xref"].append(f"{r['id']} {r['gen']} {r['kind']} {r['offset_or_stream']}")
    for r in _trailer(d):
        lines["trailer"] += [f"size {r['size']}", *(f"{k} {r[k + '_id']}" for k in ("root", "info", "encrypt") if r[k + "_id"])]
    for r in _objects(d):
        lines["objects"].append(f"{r['id']} {r['gen']} {r['value']}")
    for r in _pages(d):
        lines["pages_tree"].append(f"page {r['object_id']} {r['width']:g} {r['height']:g} {r['rotation']}")
    for r in _outlines(d):
        lines["outlines"].append(f"{r['depth']}\t{r['title']}")
    for r in _ops(d):
        lines["content_stream"].append(" ".join([*r["operands"], r["op"]]))
    for _, (_, v) in sorted(d.objects.items()):
        s = d.get(v.get("ToUnicode")) if isinstance(v, dict) else None
        if isinstance(s, pdf.Stream):
            cmap = pdf.CMap(d.stream_bytes(s))
            lines["to_unicode"] += [f"codespace {w} {a:0{2 * w}X} {b:0{2 * w}X}" for w, a, b in cmap.spaces]
            lines["to_unicode"] += [f"bf {w} {c:0{2 * w}X} {' '.join(f'{ord(x):04X}' for x in t)}" for (w, c), t in sorted(cmap.map.items())]
    lines["digest"] = [f"{name}: {hashlib.new(name, d.data).hexdigest()}" for name in ("md5", "sha1", "sha256", "sha384", "sha512")]
    for dump, found in lines.items():
        for k, line in enumerate(found):
            yield {"dump": dump, "seq": k, "line": line}


def _info(d: pdf.Document):
    info = d.get(d.trailer.get("Info"))
    for k, v in (info if isinstance(info, dict) else {}).items():
        yield {"key": k, "value": pdf.text_string(d.get(v))}


def _annotations(d: pdf.Document):
    for n, p in enumerate(d.pages(), 1):
        for ref in d.get(p.get("Annots")) or []:
            a = d.get(ref)
            if isinstance(a, dict) and isinstance(a.get("Subtype"), pdf.Name):
                rect = d.get(a.get("Rect")) or []
                yield {"pagenum": n, "subtype": str(a["Subtype"]), "rect": [float(x) for x in rect if isinstance(x, int | float)], "contents": pdf.text_string(d.get(a.get("Contents")))}


def _fields(d: pdf.Document):
    form = d.get(d.root().get("AcroForm"))

    def walk(refs, prefix: str, kind: str, flags: int, depth: int):
        for ref in refs or []:
            f = d.get(ref)
            if not isinstance(f, dict) or depth > 50:
                continue
            part = pdf.text_string(d.get(f.get("T")))
            name = f"{prefix}.{part}" if prefix and part else prefix or part
            mine, own = str(d.get(f.get("FT")) or kind), d.get(f.get("Ff")) if isinstance(d.get(f.get("Ff")), int) else flags
            kids = [k for k in d.get(f.get("Kids")) or [] if isinstance(d.get(k), dict) and "T" in d.get(k)]
            if kids:
                yield from walk(kids, name, mine, own, depth + 1)
            else:
                yield {"name": name, "kind": field_kind(mine, own), "value": pdf.text_string(d.get(f.get("V"))), "flags": own}

    if isinstance(form, dict):
        yield from walk(d.get(form.get("Fields")), "", "", 0, 0)


def field_kind(kind: str, flags: int) -> str:
    """The class of a field from its type and flags."""
    if kind == "Btn":
        return "push" if flags & 1 << 16 else "radio" if flags & 1 << 15 else "checkbox"
    if kind == "Ch":
        return "combo" if flags & 1 << 17 else "list"
    return {"Tx": "text", "Sig": "signature"}.get(kind, "unknown")


def _attachments(d: pdf.Document):
    names = d.get(d.root().get("Names"))
    for key, spec in d.tree(names.get("EmbeddedFiles")) if isinstance(names, dict) else []:
        spec = d.get(spec)
        files = d.get(spec.get("EF")) if isinstance(spec, dict) else None
        s = d.get((files or {}).get("F"))
        if isinstance(s, pdf.Stream):
            yield {"name": pdf.text_string(key), "mime": str(d.get(s.header.get("Subtype")) or ""), "bytes": d.stream_bytes(s)}


def _dests(d: pdf.Document):
    names = d.get(d.root().get("Names"))
    pairs = d.tree(names.get("Dests")) if isinstance(names, dict) else []
    legacy = d.get(d.root().get("Dests"))
    pairs += list(legacy.items()) if isinstance(legacy, dict) else []
    numbers = {p["_id"]: n for n, p in enumerate(d.pages(), 1)}
    for key, v in pairs:
        v = d.get(v)
        v = d.get(v.get("D")) if isinstance(v, dict) else v
        if isinstance(v, list) and v:
            yield {"name": key if isinstance(key, str) else pdf.text_string(key), "page": numbers.get(v[0].id) if isinstance(v[0], pdf.Ref) else None, "verb": str(v[1]) if len(v) > 1 else "", "operands": list(map(pdf.canonical, v[2:]))}


def _labels(d: pdf.Document):
    for start, v in d.tree(d.root().get("PageLabels"), "Nums"):
        v = d.get(v)
        if isinstance(v, dict) and isinstance(start, int):
            yield {"start_page": start, "style": str(v.get("S") or ""), "prefix": pdf.text_string(d.get(v.get("P"))), "start_value": int(v.get("St", 1))}


def _images(d: pdf.Document):
    for n, p in enumerate(d.pages(), 1):
        resources = d.get(p.get("Resources"))
        found = d.get(resources.get("XObject")) if isinstance(resources, dict) else None
        for name, ref in (found if isinstance(found, dict) else {}).items():
            s = d.get(ref)
            if isinstance(s, pdf.Stream) and s.header.get("Subtype") == "Image":
                names = d.get(s.header.get("Filter"))
                yield {"pagenum": n, "name": name, "width": int(d.get(s.header.get("Width")) or 0), "height": int(d.get(s.header.get("Height")) or 0), "filter": pdf.canonical(names), "bytes": s.body}


def _signatures(d: pdf.Document):
    for i, (_, v) in sorted(d.objects.items()):
        if isinstance(v, dict) and v.get("FT") == "Sig":
            sig = d.get(v.get("V"))
            sig = sig if isinstance(sig, dict) else {}
            br = [x for x in d.get(sig.get("ByteRange")) or [] if isinstance(x, int)]
            text = lambda k, sig=sig: pdf.text_string(d.get(sig.get(k)))
            intact, signer = signing.verify_document(d, sig)
            yield {"field": pdf.text_string(d.get(v.get("T"))), "intact": intact, "signer": signer, "name": text("Name"), "reason": text("Reason"), "location": text("Location"), "byte_range": br, "has_value": bool(sig), "covers_whole": len(br) == 4 and br[2] + br[3] == len(d.data)}


_ref = "array<struct<id: int, gen: int>>"
#: table -> (schema without doc_id, rows of a document)
TABLES: dict[str, tuple[str, Callable[[pdf.Document], Iterator[dict]]]] = {
    "xref_entries": ("id int, gen int, kind string, offset_or_stream long, index_in_stream int, recovered boolean", _xref),
    "trailers": ("size long, root_id int, info_id int, encrypt_id int", _trailer),
    "objects": (f"id int, gen int, kind string, value string, refs {_ref}", _objects),
    "pages": ("object_id int, pagenum int, width double, height double, rotation int", _pages),
    "content_ops": ("pagenum int, seq int, op string, operands array<string>", _ops),
    "page_text": ("pagenum int, text string", _text),
    "text_runs": ("pagenum int, seq int, text string, x double, y double, font_size double", _runs),
    "outlines": ("seq int, depth int, title string", _outlines),
    "outline_items": ("seq int, depth int, title string, page int, verb string, action string, uri string, italic boolean, bold boolean, colour array<double>, open boolean", _outline_items),
    "page_boxes": ("pagenum int, box string, rect array<double>, own boolean", _page_boxes),
    "widgets": ("name string, pagenum int, rect array<double>", _widgets),
    "metadata": ("packet binary", _metadata),
    "canonical": ("dump string, seq int, line string", _canonical),
    "info": ("key string, value string", _info),
    "annotations": ("pagenum int, subtype string, rect array<double>, contents string", _annotations),
    "form_fields": ("name string, kind string, value string, flags int", _fields),
    "attachments": ("name string, mime string, bytes binary", _attachments),
    "named_dests": ("name string, page int, verb string, operands array<string>", _dests),
    "page_labels": ("start_page int, style string, prefix string, start_value int", _labels),
    "images": ("pagenum int, name string, width int, height int, filter string, bytes binary", _images),
    "signatures": ("field string, name string, reason string, location string, byte_range array<long>, has_value boolean, covers_whole boolean, intact boolean, signer string", _signatures),
}


#: Rows that are gathered before they are given away; a document's are never parted.
ROWS = 2_000


def load(docs: DataFrame, name: str, mode: str = "PERMISSIVE", password: str = "") -> DataFrame:
    """The table ``name`` of documents in (doc_id, content); encrypted ones open with ``password``."""
    columns, rows = TABLES[name]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {columns}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    held += [{"doc_id": doc_id, **r} for r in rows(pdf.Document.open(content.as_py() or b"", password.encode()))]
                except (ValueError, TypeError, KeyError, IndexError, RecursionError):
                    if mode == "FAILFAST":
                        raise
                    continue
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return docs.select("doc_id", F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)
