"""XMP packets: properties by prefixed name, and packets from properties."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

#: Names of the markup.
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
_LANG = "{http://www.w3.org/XML/1998/namespace}lang"
#: Namespaces by their usual prefixes.
NAMESPACES = {"dc": "http://purl.org/dc/elements/1.1/", "xmp": "http://ns.adobe.com/xap/1.0/", "pdf": "http://ns.adobe.com/pdf/1.3/", "xmpMM": "http://ns.adobe.com/xap/1.0/mm/", "photoshop": "http://ns.adobe.com/photoshop/1.0/", "pdfaid": "http://www.aiim.org/pdfa/ns/id/"}


def _text(node) -> str:
    for kind in ("Alt", "Seq", "Bag"):
        box = node.find(_RDF + kind)
        if box is not None:
            items = [(li.get(_LANG), "".join(li.itertext()).strip()) for li in box.findall(_RDF + "li")]
            if kind == "Alt":  # the default language, else the first
                return next((t for lang, t in items if lang == "x-default"), items[0][1] if items else "")
            texts = [t for _, t in items]
            return "\t".join(texts if kind == "Seq" else sorted(texts, key=str.encode))
    return "".join(node.itertext()).strip()


def parse(packet: bytes) -> dict[str, str]:
    """Properties in the order of the packet; of equal names the first stays."""
    text = packet.decode("utf-8", "replace")
    m = re.search(r"<(?:\w+:)?RDF\b.*?</(?:\w+:)?RDF>", text, re.S)
    if not m:
        return {}
    spaces = dict(re.findall(r'xmlns:([\w-]+)\s*=\s*["\']([^"\']*)["\']', text))
    missing = "".join(f' xmlns:{p}="{u}"' for p, u in spaces.items() if f"xmlns:{p}=" not in m[0].split(">", 1)[0])
    head = m[0].split(">", 1)[0]
    closing = "/" if head.endswith("/") else ""
    root = ET.fromstring(head.rstrip("/") + missing + closing + ">" + m[0].split(">", 1)[1])
    names = {u: p for p, u in spaces.items()}
    short = lambda tag: f"{names.get(tag[1:].split('}')[0], '?')}:{tag.split('}')[1]}" if tag.startswith("{") else tag
    out: dict[str, str] = {}
    for d in root.findall(_RDF + "Description"):
        for k, v in d.attrib.items():
            if not k.startswith(_RDF) and k.startswith("{"):
                out.setdefault(short(k), v)
        for node in d:
            out.setdefault(short(node.tag), _text(node))
    return out


def packet(properties: dict[str, str]) -> bytes:
    used = sorted({k.split(":", 1)[0] for k in properties})
    spaces = "".join(f" xmlns:{p}={quoteattr(NAMESPACES.get(p, 'http://example.org/' + p + '/'))}" for p in used)
    body = "".join(f"<{k}>{escape(v)}</{k}>" for k, v in properties.items())
    rdf = f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about=""{spaces}>{body}</rdf:Description></rdf:RDF>'
    return f'<?xpacket begin="﻿" id="W5M0MpCehiHzreSzNTczkc9d"?><x:xmpmeta xmlns:x="adobe:ns:meta/">{rdf}</x:xmpmeta><?xpacket end="w"?>'.encode()
