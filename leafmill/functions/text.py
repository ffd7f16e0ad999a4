"""Strings, bytes and charsets as column expressions. Charsets that Spark lacks or is strict about go through
the Arrow kernels of ``leafmill.kernels.charsets``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted names, web names and code pages.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "utf-16": "UTF-16LE", "unicode": "UTF-16LE", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "windows-1252": "windows-1252", "cp1252": "windows-1252"}
CODE_PAGES = {"UTF-8": 65001, "UTF-16LE": 1200, "UTF-16BE": 1201, "ISO-8859-1": 28591, "windows-1252": 1252}
PREAMBLES = {"UTF-8": "EFBBBF", "UTF-16LE": "FFFE", "UTF-16BE": "FEFF", "ISO-8859-1": "", "windows-1252": ""}


def charset(name: str) -> str:
    try:
        return CHARSETS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown charset: {name}") from None


def get_bytes(s: Column, name: str) -> Column:
    """Encoded text; what Latin-1 lacks becomes "?" before Spark would refuse it."""
    found = charset(name)
    if found == "windows-1252":
        from leafmill.kernels.charsets import encode_cp1252

        return encode_cp1252(s)
    if found == "ISO-8859-1":
        s = F.regexp_replace(s, "[^\\x{00}-\\x{ff}]", "?")
    return F.encode(s, found)


def get_string(b: Column, name: str) -> Column:
    found = charset(name)
    if found == "windows-1252":
        from leafmill.kernels.charsets import decode_cp1252

        return decode_cp1252(b)
    return F.decode(b, found)


def byte_count(s: Column, name: str) -> Column:
    return F.octet_length(get_bytes(s, name))


def pdf_string(s: Column) -> Column:
    """ASCII as it is, other text as UTF-16 with a byte-order mark."""
    return F.when(s.rlike(r"^[\x00-\x7f]*$"), s.cast("binary")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(s, "UTF-16BE")))


def pdf_text(b: Column) -> Column:
    marked = F.hex(F.substring(b, 1, 2)) == "FEFF"
    return F.when(marked, F.decode(F.substring(b, 3, 2**31 - 1), "UTF-16BE")).otherwise(F.decode(b, "ISO-8859-1"))


def hex_encode(b: Column) -> Column:
    return F.hex(b)


def hex_decode(s: Column) -> Column:
    """White space is skipped, ">" ends, an odd digit is padded on the right; null for other characters."""
    digits = F.regexp_replace(F.split(s, ">", 2)[0], r"[\x00\x09\x0A\x0C\x0D\x20]", "")
    even = F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(even.rlike("^[0-9A-Fa-f]*$"), F.unhex(even))


def xml_text_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attr_escape(s: Column) -> Column:
    return F.replace(xml_text_escape(s), F.lit('"'), F.lit("&quot;"))


def decode_entities(s: Column) -> Column:
    """The five named references and numeric ones, decimal or hexadecimal, each once, from left to right. A number that
    is no character stays as it is. Texts are cut at references, so a decoded "&" begins no other."""
    names = F.create_map(*(F.lit(x) for kv in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")) for x in kv))
    pattern = F.lit(r"&(#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|lt|gt|quot|apos|amp);")
    between, found = F.split(s, r"&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,8}|lt|gt|quot|apos|amp);", -1), F.regexp_extract_all(s, pattern, 1)

    def one(ref: Column) -> Column:
        code = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 9)).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code >= 0xE000) & (code <= 0x10FFFF))
        units = F.lpad(F.hex(code), 8, "0")
        return F.when(~ref.startswith("#"), names[ref]).when(valid, F.decode(F.unhex(units), "UTF-32")).otherwise(F.concat(F.lit("&"), ref, F.lit(";")))

    parts = F.zip_with(between, found, lambda x, y: F.concat(x, F.coalesce(F.when(y.isNotNull(), one(y)), F.lit(""))))
    return F.when(F.contains(s, F.lit("&")), F.array_join(parts, "")).otherwise(s)


def char_count(b: Column, charset: str) -> Column:
    """Characters of encoded bytes, as UTF-16 counts them."""
    return F.octet_length(F.encode(get_string(b, charset), "UTF-16BE")).cast("int") / F.lit(2)


def content_literal_escape(s: Column) -> Column:
    for c in ("\\", "(", ")"):
        s = F.replace(s, F.lit(c), F.lit("\\" + c))
    return s


def page_number(form: Column, n: Column) -> Column:
    """"#" stands for the number, which follows the text where there is none."""
    n = n.cast("string")
    return F.when(F.contains(form, F.lit("#")), F.replace(form, F.lit("#"), n)).otherwise(F.concat(form, n))


def output_name(path: Column, tag: Column) -> Column:
    """stem_tag.ext"""
    return F.when(path.rlike(r"\.[^./\\]*$"), F.concat(F.regexp_extract(path, r"^(.*)\.[^./\\]*$", 1), F.lit("_"), tag, F.regexp_extract(path, r"(\.[^./\\]*)$", 1))).otherwise(F.concat(path, F.lit("_"), tag))


def occurrences(s: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return (F.length(s) - F.length(F.replace(s, F.lit(needle), F.lit("")))) / len(needle) if needle else F.lit(0)


def last_slice(s: Column, mark: str = "%%EOF") -> Column:
    """What follows the last mark but one."""
    return F.substring_index(s, mark, -2)
