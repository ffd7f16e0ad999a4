"""Queries on scalars: digests, charsets, escapes, geometry, colours, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import colour, geometry, maps, text

from ._tables import table
from .catalog import query


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def digest_bundle(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"))


@query("SELECT doc_id, hex(encode(text)) AS coded, text AS decoded FROM documents")
def hex_codec(spark: SparkSession, d: str) -> DataFrame:
    """ASCIIHex there and back."""
    b = F.col("text").cast("binary")
    rows = table(spark, d, "documents").select("doc_id", text.hex_encode(b).alias("coded"))
    return rows.select("doc_id", "coded", text.hex_decode(F.concat("coded", F.lit(">"))).cast("string").alias("decoded"))


@query("""
SELECT doc_id, CAST(strlen(text) AS INT) AS utf8, CAST(2 * length(text) + 2 * (length(text) - length(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g'))) AS INT) AS utf16,
       CAST(length(text) AS INT) AS latin1 FROM documents""")
def charset_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.byte_count(F.col("text"), "utf-8").alias("utf8"), text.byte_count(F.col("text"), "utf-16").alias("utf16"), text.byte_count(F.col("text"), "latin1").alias("latin1"))


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n, CAST(length(replace(text, 'the', 'THE!')) AS BIGINT) AS new_length FROM documents")
def replace_text_count(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.occurrences(t, "the").cast("long").alias("n"), F.length(F.replace(t, F.lit("the"), F.lit("THE!"))).cast("long").alias("new_length"))


@query(r"""
SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attr,
       replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)') AS literal FROM documents""")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.xml_attr_escape(F.col("text")).alias("attr"), text.content_literal_escape(F.col("text")).alias("literal"))


@query("SELECT doc_id, text FROM documents")
def entity_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.decode_entities(text.xml_attr_escape(F.col("text"))).alias("text"))


@query("SELECT doc_id, text FROM documents")
def pdf_string_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Text strings: ASCII bytes, or UTF-16 with a mark."""
    coded = table(spark, d, "documents").select("doc_id", text.pdf_string(F.col("text")).alias("b"))
    return coded.select("doc_id", text.pdf_text(F.col("b")).alias("text"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Page ' || p_size || ' of part' ELSE 'Page ' || p_size END AS label,
       'docs/' || p_partkey || '_' || p_size || '.pdf' AS name FROM part""")
def page_number_format(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("p_size") % 2 == 0, "Page # of part").otherwise("Page ")
    path = F.concat(F.lit("docs/"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    return table(spark, d, "part").select("p_partkey", text.page_number(form, F.col("p_size")).alias("label"), text.output_name(path, F.col("p_size").cast("string")).alias("name"))


@query("SELECT event_id, (event_id & 4) <> 0 AS can_print, (event_id & 8) <> 0 AS can_modify, (event_id & 16) <> 0 AS can_copy, CAST((event_id % 2) * 4 + (event_id % 3 = 0)::INT * 8 + (event_id % 5 = 0)::INT * 16 AS INT) AS mask FROM events")
def permissions_mask(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    bit = lambda n: e.bitwiseAND(F.lit(n)) != 0
    mask = F.when(e % 2 == 1, 4).otherwise(0) + F.when(e % 3 == 0, 8).otherwise(0) + F.when(e % 5 == 0, 16).otherwise(0)
    return table(spark, d, "events").select("event_id", bit(4).alias("can_print"), bit(8).alias("can_modify"), bit(16).alias("can_copy"), mask.cast("int").alias("mask"))


@query("SELECT l_orderkey, l_linenumber, CAST(((round((l_linenumber * 77 - 300) / 90.0)::INT * 90) % 360 + 360) % 360 AS INT) AS rotation FROM lineitem")
def rotation_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.normalize_rotation(F.col("l_linenumber") * 77 - 300).alias("rotation"))


@query("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 5 AS c, l_tax * 4 AS m, l_quantity / 50 AS y, l_discount AS k FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, least(1, c) AS c, least(1, m) AS m, least(1, y) AS y, least(1, k) AS k FROM c)
SELECT l_orderkey, l_linenumber, CAST(floor((1 - c) * (1 - k) * 255 + 0.5) AS INT) AS r, CAST(floor((1 - m) * (1 - k) * 255 + 0.5) AS INT) AS g, CAST(floor((1 - y) * (1 - k) * 255 + 0.5) AS INT) AS b FROM s""")
def colour_srgb(spark: SparkSession, d: str) -> DataFrame:
    parts = F.array(F.col("l_discount") * 5, F.col("l_tax") * 4, F.col("l_quantity") / 50, F.col("l_discount"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", colour.to_srgb(F.lit("cmyk"), parts).alias("s"))
    return rows.select("l_orderkey", "l_linenumber", *(colour.quantize(F.col(f"s.{c}")).alias(c) for c in "rgb"))


@query("""
SELECT p_partkey, CAST(2 * p_size + 3 * (p_partkey % 7) + 5 AS DOUBLE) AS x, CAST(-p_size + 4 * (p_partkey % 7) - 2 AS DOUBLE) AS y,
       CAST(2 * p_size + 5 AS DOUBLE) AS llx, CAST(2 * p_size + 35 AS DOUBLE) AS urx FROM part""")
def affine_apply(spark: SparkSession, d: str) -> DataFrame:
    m = geometry.matrix(2, -1, 3, 4, 5, -2)
    r = geometry.apply_to_rect(m, geometry.rect(F.col("p_size").cast("double"), 0, F.col("p_size").cast("double"), 10))
    p = geometry.apply(m, F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"))
    return table(spark, d, "part").select("p_partkey", p["x"].alias("x"), p["y"].alias("y"), r["llx"].alias("llx"), r["urx"].alias("urx"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 7 AS DOUBLE) AS y FROM part")
def affine_inverse(spark: SparkSession, d: str) -> DataFrame:
    """A matrix and its inverse give each point back (to nine digits)."""
    m = geometry.compose(geometry.compose(geometry.scale(2, 4), geometry.skew(0.25, 0.5)), geometry.translate(8, -16))
    p = geometry.apply(m, F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"))
    rows = table(spark, d, "part").select("p_partkey", p.alias("p"), geometry.inverse(m).alias("inv"))
    back = geometry.apply(F.col("inv"), F.col("p.x"), F.col("p.y"))
    return rows.select("p_partkey", F.abs(F.round(back["x"], 9)).alias("x"), F.abs(F.round(back["y"], 9)).alias("y"))


@query("""
WITH b AS (SELECT p_partkey AS id, p_partkey % 40 AS x0, p_size AS y0, p_partkey % 40 + p_size % 6 AS x1, p_size + 3 AS y1, p_brand AS g FROM part WHERE p_partkey <= 1000)
SELECT a.id AS a, c.id AS b FROM b a JOIN b c ON a.g = c.g AND a.id < c.id AND a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1
WHERE a.id % 25 = 0""")
def rect_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of one page that meet those of a stated query set; the page is the equality that bounds the join."""
    p = table(spark, d, "part").where("p_partkey <= 1000")
    box = geometry.rect(F.col("p_partkey") % 40, F.col("p_size"), F.col("p_partkey") % 40 + F.col("p_size") % 6, F.col("p_size") + 3)
    a = p.where("p_partkey % 25 = 0").select(F.col("p_partkey").alias("a"), F.col("p_brand").alias("ga"), box.alias("ra"))
    b = p.select(F.col("p_partkey").alias("b"), F.col("p_brand").alias("gb"), box.alias("rb"))
    return a.join(b, (F.col("ga") == F.col("gb")) & (F.col("a") < F.col("b")) & geometry.is_intersect(F.col("ra"), F.col("rb"))).select("a", "b")


@query("""
SELECT p_partkey, CAST(greatest(1, ceil(p_size * 150.0 / 72 - 0.000001)) AS INT) AS px, p_size > 25 AS landscape FROM part""")
def device_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", geometry.device_size(F.col("p_size"), 150.0).alias("px"), geometry.is_landscape(F.col("p_size"), F.lit(25)).alias("landscape"))


@query("""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""")
def info_map(spark: SparkSession, d: str) -> DataFrame:
    """Information entries as a map, with one removed and one put."""
    html = F.col("html")
    m = F.create_map(F.lit("Title"), F.regexp_extract(html, "<title>([^<]*)</title>", 1), F.lit("Lang"), F.regexp_extract(html, '<html lang="([^"]*)"', 1), F.lit("Junk"), F.lit("x"))
    rows = table(spark, d, "pages").select("page_id", maps.put(maps.remove(m, "Junk"), "Pages", F.lit("1")).alias("m"))
    return rows.select("page_id", maps.get(F.col("m"), "Title").alias("title"), maps.get(F.col("m"), "Lang").alias("lang"))


@query("""SELECT page_id, 'lang' || chr(9) || regexp_extract(html, '<html lang="([^"]*)"', 1) || chr(10) || 'title' || chr(9) || regexp_extract(html, '<title>([^<]*)</title>', 1) AS dump FROM pages""")
def xmp_props(spark: SparkSession, d: str) -> DataFrame:
    """Properties in the order of their keys, one a line; of equal keys the first counts."""
    html = F.col("html")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    entries = F.array(pair("title", F.regexp_extract(html, "<title>([^<]*)</title>", 1)), pair("lang", F.regexp_extract(html, '<html lang="([^"]*)"', 1)), pair("title", F.lit("later")))
    return table(spark, d, "pages").select("page_id", maps.canonical(maps.first_wins(entries)).alias("dump"))


@query("SELECT event_id, try_cast(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT) AS number, value AS real FROM events")
def xmp_casts(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("props", "(-?[0-9]+)", 1)
    return table(spark, d, "events").select("event_id", n.try_cast("long").alias("number"), F.col("value").cast("string").try_cast("double").alias("real"))


@query("SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY user_id, event_type")
def event_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
