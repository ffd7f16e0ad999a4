"""Detached signatures of documents: RSA with SHA-256 over signed attributes, in the cryptographic message syntax.

Keys and certificates come as DER; ``derived_key`` and ``self_signed`` make ones for tests, which keep nothing secret.
"""

from __future__ import annotations

import hashlib
import random
from dataclasses import dataclass
from datetime import UTC, datetime

from .pdf import Document, Name, Ref, Stream, text_string
from .pdf_write import append

# Object identifiers.
_DATA, _SIGNED_DATA = "1.2.840.113549.1.7.1", "1.2.840.113549.1.7.2"
_CONTENT_TYPE, _DIGEST, _TIME = "1.2.840.113549.1.9.3", "1.2.840.113549.1.9.4", "1.2.840.113549.1.9.5"
_RSA, _RSA_SHA256, _SHA256, _COMMON_NAME = "1.2.840.113549.1.1.1", "1.2.840.113549.1.1.11", "2.16.840.1.101.3.4.2.1", "2.5.4.3"
#: Bytes kept free for a signature.
CAPACITY = 8192


@dataclass(frozen=True)
class Key:
    modulus: int
    public: int
    private: int

    @property
    def size(self) -> int:
        return (self.modulus.bit_length() + 7) // 8


# DER


def tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    wide = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes((tag, n) if n < 128 else (tag, 0x80 | len(wide), *wide)) + body


def whole(v: int) -> bytes:
    return tlv(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))


def oid(dotted: str) -> bytes:
    first, second, *rest = map(int, dotted.split("."))
    out = bytearray()
    for v in (40 * first + second, *rest):
        part = [v & 127]
        while v := v >> 7:
            part.append(v & 127 | 128)
        out += bytes(reversed(part))
    return tlv(6, bytes(out))


def seq(*parts: bytes) -> bytes:
    return tlv(0x30, *parts)


def read(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """(tag, body, the element itself) of the elements that stand in a row."""
    out, at = [], 0
    while at < len(data):
        tag, n, start = data[at], data[at + 1], at + 2
        if n & 0x80:
            start += n & 0x7F
            n = int.from_bytes(data[at + 2 : start], "big")
        if start + n > len(data):
            raise ValueError("an element is cut off")
        out.append((tag, data[start : start + n], data[at : start + n]))
        at = start + n
    return out


def parts_of(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """The elements inside the first element."""
    return read(read(data)[0][1])


def key_of(der: bytes) -> Key:
    """A private key in its own form or wrapped with its algorithm."""
    inner = parts_of(der)
    if inner[1][0] == 0x30:
        inner = parts_of(inner[2][1])
    n, e, d = (int.from_bytes(x[1], "big") for x in inner[1:4])
    return Key(n, e, d)


# keys and certificates


def _prime(draw: random.Random, bits: int) -> int:
    while True:
        n = draw.getrandbits(bits) | 3 << bits - 2 | 1
        if any(n % p == 0 for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)) or n % 65537 == 1:
            continue
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for _ in range(24):
            x = pow(draw.randrange(2, n - 1), odd, n)
            if x in (1, n - 1):
                continue
            for _ in range(twos - 1):
                x = x * x % n
                if x == n - 1:
                    break
            else:
                break
        else:
            return n


def derived_key(seed: int, bits: int = 1024) -> Key:
    """A key that follows from the seed; for tests only."""
    draw = random.Random(seed)
    p, q = _prime(draw, bits // 2), _prime(draw, bits // 2)
    return Key(p * q, 65537, pow(65537, -1, (p - 1) * (q - 1)))


def _rsa(key: Key, message: bytes) -> bytes:
    return pow(int.from_bytes(_padded(message, key.size), "big"), key.private, key.modulus).to_bytes(key.size, "big")


def _padded(message: bytes, size: int) -> bytes:
    info = seq(seq(oid(_SHA256), tlv(5)), tlv(4, hashlib.sha256(message).digest()))
    if len(info) + 11 > size:
        raise ValueError("the key is too short")
    return b"\0\1" + b"\xff" * (size - len(info) - 3) + b"\0" + info


def self_signed(key: Key, name: str, start: datetime = datetime(2020, 1, 1, tzinfo=UTC), end: datetime = datetime(2049, 1, 1, tzinfo=UTC)) -> bytes:
    who = seq(tlv(0x31, seq(oid(_COMMON_NAME), tlv(0x0C, name.encode()))))
    public = seq(seq(oid(_RSA), tlv(5)), tlv(3, b"\0" + seq(whole(key.modulus), whole(key.public))))
    how = seq(oid(_RSA_SHA256), tlv(5))
    body = seq(tlv(0xA0, whole(2)), whole(1), how, who, seq(_time(start), _time(end)), who, public)
    return seq(body, how, tlv(3, b"\0" + _rsa(key, body)))


def _time(t: datetime) -> bytes:
    return tlv(0x17, t.astimezone(UTC).strftime("%y%m%d%H%M%SZ").encode())


@dataclass(frozen=True)
class Certificate:
    serial: bytes
    issuer: bytes
    name: str
    modulus: int
    public: int


def certificate(der: bytes) -> Certificate:
    """The fields of a certificate that a signature needs; the name is the subject's common name."""
    fields = [x for x in read(parts_of(der)[0][1]) if x[0] != 0xA0]
    name = ""
    for _, entry, _ in read(fields[4][1]):
        kind, value = parts_of(entry)[:2]
        if kind[2] == oid(_COMMON_NAME):
            name = value[1].decode("utf-16-be" if value[0] == 0x1E else "utf-8", "replace")
    n, e = (int.from_bytes(x[1], "big") for x in parts_of(read(fields[5][1])[1][1][1:]))
    return Certificate(fields[0][2], fields[2][2], name, n, e)


# signatures


def sign_detached(content: bytes, key: Key, cert: bytes, time: datetime) -> bytes:
    about = certificate(cert)
    attributes = b"".join((
        seq(oid(_CONTENT_TYPE), tlv(0x31, oid(_DATA))), seq(oid(_TIME), tlv(0x31, _time(time))), seq(oid(_DIGEST), tlv(0x31, tlv(4, hashlib.sha256(content).digest()))),
    ))
    # a set's elements stand in the order of their bytes
    attributes = b"".join(sorted(x[2] for x in read(attributes)))
    sha, signer = seq(oid(_SHA256), tlv(5)), seq(about.issuer, about.serial)
    info = seq(whole(1), signer, sha, tlv(0xA0, attributes), seq(oid(_RSA), tlv(5)), tlv(4, _rsa(key, tlv(0x31, attributes))))
    return seq(oid(_SIGNED_DATA), tlv(0xA0, seq(whole(1), tlv(0x31, sha), seq(oid(_DATA)), tlv(0xA0, cert), tlv(0x31, info))))


def verify_detached(content: bytes, der: bytes) -> tuple[bool, str]:
    """Whether a signature with signed attributes fits the content and its own certificate, and the signer's name. The
    certificate's issuer isn't judged; other algorithms than RSA with SHA-256 don't fit."""
    fields = parts_of(parts_of(der)[1][1])
    certs = [c[2] for tag, body, _ in fields if tag == 0xA0 for c in read(body)]
    info = read(read(fields[-1][1])[0][1])
    signer = info[1][1]
    for der_cert in certs:
        about = certificate(der_cert)
        if about.issuer + about.serial == signer:
            break
    else:
        return False, ""
    if info[3][0] != 0xA0 or parts_of(info[2][2])[0][2] != oid(_SHA256):
        return False, about.name
    attributes = {parts_of(x[2])[0][2]: parts_of(x[2])[1][1] for x in read(info[3][1])}
    if attributes.get(oid(_DIGEST)) != tlv(4, hashlib.sha256(content).digest()):
        return False, about.name
    size = (about.modulus.bit_length() + 7) // 8
    opened = pow(int.from_bytes(info[5][1], "big"), about.public, about.modulus).to_bytes(size, "big")
    return opened == _padded(tlv(0x31, info[3][1]), size), about.name


def sign_document(data: bytes, key: Key, cert: bytes, time: datetime, field: str = "Signature1", page: int = 1, rect: tuple = (0, 0, 0, 0), **texts: str) -> bytes:
    """An update with a signature field on a page; ``texts`` may hold Name, Reason, Location and ContactInfo. Raises for an
    encrypted document, a missing page and a field name that is taken."""
    doc = Document.open(data)
    leaves = doc.pages()
    if doc.trailer.get("Encrypt") is not None or not 1 <= page <= len(leaves):
        raise ValueError("the document is encrypted or has no such page")
    held = {text_string(doc.get(v.get("T"))) for _, v in doc.objects.values() if isinstance(v, dict) and "FT" in v}
    if field in held:
        raise ValueError(f"there is a field {field} already")
    sig, widget = (Ref(max(doc.objects) + i, 0) for i in (1, 2))
    leaf = leaves[page - 1]["_id"]
    root_ref = doc.trailer["Root"]
    root = dict(doc.get(root_ref))
    changed: dict[int, object] = {root_ref.id: root}
    form = {**(doc.get(root.get("AcroForm")) or {}), "SigFlags": 3}
    form["Fields"] = [*(doc.get(form.get("Fields")) or []), widget]
    if isinstance(root.get("AcroForm"), Ref):
        changed[root["AcroForm"].id] = form
    else:
        root["AcroForm"] = form
    shown = dict(doc.objects[leaf][1])
    changed[leaf] = {**shown, "Annots": [*(doc.get(shown.get("Annots")) or []), widget]}
    changed[widget.id] = {"Type": Name("Annot"), "Subtype": Name("Widget"), "FT": Name("Sig"), "T": field.encode("latin-1"), "V": sig, "F": 132, "Rect": list(map(float, rect)), "P": Ref(leaf, 0)}
    free = [0, *[9999999999] * 3]
    changed[sig.id] = {
        "Type": Name("Sig"), "Filter": Name("Adobe.PPKLite"), "SubFilter": Name("adbe.pkcs7.detached"), "M": f"D:{time.astimezone(UTC):%Y%m%d%H%M%SZ}".encode(),
        **{k: v.encode("latin-1") if v.isascii() else b"\xfe\xff" + v.encode("utf-16-be") for k, v in texts.items() if v}, "ByteRange": free, "Contents": bytes(CAPACITY),
    }
    out = bytearray(append(data, changed))
    at = out.rindex(b"/ByteRange [") + len(b"/ByteRange ")
    start = out.index(b"<", out.index(b"/Contents ", at))
    end = start + 2 * CAPACITY + 2
    spot = b"[0 %d %d %d]" % (start, end, len(out) - end)
    size = out.index(b"]", at) + 1 - at
    out[at : at + size] = spot + b" " * (size - len(spot))
    made = sign_detached(bytes(out[:start] + out[end:]), key, cert, time)
    if len(made) > CAPACITY:
        raise ValueError("the signature is longer than the room for it")
    out[start + 1 : start + 1 + 2 * len(made)] = made.hex().upper().encode()
    return bytes(out)


def verify_document(doc: Document, sig: dict) -> tuple[bool, str]:
    """Whether a signature dictionary fits the bytes of its range, and the signer's name."""
    spans, held = doc.get(sig.get("ByteRange")) or [], doc.get(sig.get("Contents"))
    try:
        if len(spans) != 4 or not isinstance(held, bytes) or isinstance(held, Stream):
            return False, ""
        a, n, b, m = map(int, spans)
        if a != 0 or min(n, m) < 0 or b < n or b + m > len(doc.data):
            return False, ""
        # what the ranges leave out is the signature itself and nothing else
        if bytes.fromhex(doc.data[n:b].strip(b"<> \r\n").decode("ascii")) != bytes(held):
            return False, ""
        der = read_first(bytes(held))
        return verify_detached(doc.data[:n] + doc.data[b : b + m], der)
    except (ValueError, IndexError, TypeError, UnicodeDecodeError):
        return False, ""


def read_first(data: bytes) -> bytes:
    """The first element, without the room behind it."""
    n, start = data[1], 2
    if n & 0x80:
        start += n & 0x7F
        n = int.from_bytes(data[2:start], "big")
    return data[: start + n]
