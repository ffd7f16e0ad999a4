"""Queries through the kernels: each row's text becomes a document or a coded stream and comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as strings
from leafmill.kernels import ccitt, codecs, crypto
from leafmill.sources import documents, writers

from ._tables import table
from .catalog import query

_TRIMMED = "rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(32) || chr(160))"


def _as_documents(spark: SparkSession, d: str) -> DataFrame:
    return writers.from_text(table(spark, d, "documents"), info=("lang", "source"))


@query(f"SELECT doc_id, 1 AS pagenum, {_TRIMMED} AS text FROM documents")
def pdf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as documents and read back."""
    return documents.load(_as_documents(spark, d), "page_text").select("doc_id", "pagenum", "text")


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, 0 AS rotation FROM conversations")
def pdf_page_tree(spark: SparkSession, d: str) -> DataFrame:
    made = writers.from_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return documents.load(made, "pages").select("doc_id", "pagenum", "width", "height", "rotation")


@query("SELECT conv_id AS doc_id, CAST(turn AS INT) AS seq, 0 AS depth, 'Page ' || (turn + 1) AS title FROM conversations")
def pdf_outline(spark: SparkSession, d: str) -> DataFrame:
    made = writers.from_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")
    return documents.load(made, "outlines").select("doc_id", "seq", "depth", "title")


@query("SELECT doc_id, lang, source FROM documents")
def pdf_info(spark: SparkSession, d: str) -> DataFrame:
    info = documents.load(_as_documents(spark, d), "info").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return info.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents)
SELECT doc_id, CAST(k AS INT) AS seq, line AS text, 72.0::DOUBLE AS x, CAST(7200 - 144 * k AS BIGINT) AS y_tenths FROM l""")
def pdf_text_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its place on the page."""
    runs = documents.load(_as_documents(spark, d), "text_runs")
    return runs.select("doc_id", "seq", "text", "x", F.round(F.col("y") * 10).cast("long").alias("y_tenths"))


@query("SELECT doc_id, 1 AS n_pages, 1 AS n_catalogs FROM documents")
def pdf_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects by type, from the object table."""
    o = documents.load(_as_documents(spark, d), "objects").groupBy("doc_id")
    count = lambda t: F.count_if(F.contains("value", F.lit(f"/Type /{t} ")) | F.endswith("value", F.lit(f"/Type /{t} >>"))).cast("int")
    return o.agg(count("Page").alias("n_pages"), count("Catalog").alias("n_catalogs"))


@query("SELECT conv_id, string_agg(rtrim(text), '' ORDER BY turn) AS text FROM conversations WHERE turn <> 1 GROUP BY conv_id")
def pdf_delete_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page is cut out of each document."""
    c = table(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    made = writers.from_pages(c, "conv_id", "turn", "text").join(n, F.col("doc_id") == F.col("conv_id"))
    kept = writers.keep_pages(made.select("doc_id", "content", F.array_except(F.sequence(F.lit(1), "n"), F.array(F.lit(2))).alias("keep")))
    pages = documents.load(kept, "page_text")
    rows = F.sort_array(F.collect_list(F.struct("pagenum", "text")))
    return pages.groupBy(F.col("doc_id").alias("conv_id")).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))


def _trip(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        b = F.col("text").cast("binary")
        coded = table(spark, d, "documents").select("doc_id", b.alias("b"), codecs.encode(name, b).alias("coded"))
        back = coded.select("doc_id", codecs.decode(name, F.col("coded")).cast("string").alias("text"), (F.col("coded") != F.col("b")).alias("changed"))
        return back

    return run


for _key, _name in (("lzw_round_trip", "LZWDecode"), ("ascii85_round_trip", "ASCII85Decode"), ("runlength_round_trip", "RunLengthDecode"), ("flate_round_trip", "FlateDecode")):
    _f = _trip(_name)
    _f.__name__ = _key
    query("SELECT doc_id, text, true AS changed FROM documents")(_f)


@query("SELECT conv_id, turn, text, CAST(ceil(octet_length(encode(text)) / 8) AS BIGINT) AS n_lines FROM conversations")
def ccitt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Texts as rasters of 64 columns, coded line by line from the line above, and decoded."""
    b = F.col("text").cast("binary")
    lines = F.ceil(F.length(b) / 8)
    coded = codecs.on_bytes(lambda x: ccitt.encode(x + b" " * (-len(x) % 8), 64, -(-len(x) // 8)), b)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length(b).alias("n"), lines.alias("n_lines"), coded.alias("coded"))
    back = codecs.on_bytes(lambda x: ccitt.decode(x, 64, 0, -1), F.col("coded"))
    return rows.select("conv_id", "turn", "n", "n_lines", back.alias("back")).select("conv_id", "turn", F.expr("cast(substring(back, 1, n) as string)").alias("text"), "n_lines")


@query("SELECT doc_id, text, true AS changed FROM documents")
def rc4_round_trip(spark: SparkSession, d: str) -> DataFrame:
    b, key = F.col("text").cast("binary"), crypto.object_key_column(F.lit(b"0123456789abcdef"), F.col("doc_id"), F.lit(0).cast("long"), False, 16)
    rows = table(spark, d, "documents").select("doc_id", b.alias("b"), key.alias("k"))
    coded = rows.select("doc_id", "b", "k", crypto.rc4_column(F.col("k"), F.col("b")).alias("c"))
    return coded.select("doc_id", crypto.rc4_column(F.col("k"), F.col("c")).cast("string").alias("text"), (F.col("c") != F.col("b")).alias("changed"))


@query("SELECT doc_id, text, true AS changed FROM documents")
def aes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """By Spark's own function, in the engine."""
    b, key, iv = F.col("text").cast("binary"), F.lit(b"0123456789abcdef"), F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary")))
    coded = table(spark, d, "documents").select("doc_id", b.alias("b"), iv.alias("iv"), crypto.aes_encrypt(key, iv, b).alias("c"))
    return coded.select("doc_id", crypto.aes_decrypt(key, F.col("iv"), F.col("c")).cast("string").alias("text"), (F.col("c") != F.col("b")).alias("changed"))


@query("SELECT doc_id, text FROM documents")
def cp1252_round_trip(spark: SparkSession, d: str) -> DataFrame:
    coded = table(spark, d, "documents").select("doc_id", strings.get_bytes(F.col("text"), "cp1252").alias("b"))
    return coded.select("doc_id", strings.get_string(F.col("b"), "cp1252").alias("text"))


@query("SELECT doc_id, lang, source FROM documents")
def pdf_encrypted_info(spark: SparkSession, d: str) -> DataFrame:
    """The documents under a password and opened with it; AES by key of the document."""
    from leafmill.kernels.pdf_write import encrypt

    rows = _as_documents(spark, d)
    locked = rows.select("doc_id", codecs.on_bytes(lambda c: encrypt(c, b"user", b"owner", 4), F.col("content")).alias("content"))
    info = documents.load(locked, "info", password="user").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    return info.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))
