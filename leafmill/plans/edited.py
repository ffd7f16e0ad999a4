"""Queries through edited documents: conversations become documents, a page a turn, a table of edits is applied to
them, and what they hold afterwards is read back."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import bignum, metrics
from leafmill.functions import text as strings
from leafmill.kernels import signing
from leafmill.sources import devices, documents, edits, writers

from ._tables import table
from .catalog import query

def _page() -> Column:
    return F.col("turn").cast("int") + 1


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return writers.from_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")


def _steps(spark: SparkSession, d: str, op: str, at: int = 0, where: str = "true", **args: Column) -> DataFrame:
    """An edit for each turn, in the order of turns; ``at`` puts whole kinds of edits after others."""
    rows = table(spark, d, "conversations").where(where)
    return rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + at * 100_000).alias("seq"), F.lit(op).alias("op"), F.to_json(F.struct(*(v.alias(k) for k, v in args.items()))).alias("args"))


def _load(spark: SparkSession, d: str, name: str, *steps: DataFrame) -> DataFrame:
    todo = steps[0]
    for s in steps[1:]:
        todo = todo.unionByName(s)
    return documents.load(edits.apply(_documents(spark, d), todo), name)


def _rect(*parts: Column | int) -> Column:
    return F.array(*(F.lit(p).cast("double") if isinstance(p, int) else p.cast("double") for p in parts))


def _annotate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "Text").otherwise("Highlight")
    return _steps(spark, d, "add_annotation", page=_page(), subtype=kind, rect=_rect(10, 20, F.col("turn") + 30, 40), contents=F.col("role"), name=F.concat(F.lit("n"), F.col("turn").cast("string")))


_ANNOTATIONS = "SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, CASE WHEN role = 'user' THEN 'Text' ELSE 'Highlight' END AS subtype, CAST(turn + 30 AS DOUBLE) AS x1, role AS contents FROM conversations"


@query(_ANNOTATIONS)
def pdf_annotations(spark: SparkSession, d: str) -> DataFrame:
    found = _load(spark, d, "annotations", _annotate(spark, d))
    return found.select("doc_id", "pagenum", "subtype", F.get("rect", F.lit(2)).alias("x1"), "contents")


@query(f"SELECT * FROM ({_ANNOTATIONS}) WHERE subtype = 'Text'")
def pdf_delete_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Annotations of one kind go."""
    found = _load(spark, d, "annotations", _annotate(spark, d), _steps(spark, d, "delete_annotations", 1, "turn = 0", subtype=F.lit("Highlight")))
    return found.select("doc_id", "pagenum", "subtype", F.get("rect", F.lit(2)).alias("x1"), "contents")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    kind, flags = F.when(F.col("role") == "user", "Tx").otherwise("Btn"), F.when(F.col("turn") % 2 == 0, 1 << 15).otherwise(1 << 16)
    at = F.col("turn") * 10
    return _steps(spark, d, "add_field", name=F.concat(F.lit("f"), F.col("turn").cast("string")), kind=kind, page=_page(), rect=_rect(at, 50, at + 60, 70), value=F.col("role"), flags=flags)


_FIELDS = """SELECT conv_id AS doc_id, 'f' || turn AS name, CASE WHEN role = 'user' THEN 'text' WHEN turn % 2 = 0 THEN 'radio' ELSE 'push' END AS kind, role AS value FROM conversations"""


@query(_FIELDS)
def pdf_form_fields(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, "form_fields", _fields(spark, d)).select("doc_id", "name", "kind", "value")


@query(f"{_FIELDS} WHERE turn <> 1")
def pdf_remove_field(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, "form_fields", _fields(spark, d), _steps(spark, d, "remove_field", 1, "turn = 1", name=F.lit("f1"))).select("doc_id", "name", "kind", "value")


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, 'f' || turn AS name FROM conversations WHERE turn * 10 >= 10 AND turn * 10 + 60 <= 100")
def pdf_fields_in_rect(spark: SparkSession, d: str) -> DataFrame:
    """Fields whose places lie within a rectangle."""
    found = _load(spark, d, "widgets", _fields(spark, d))
    side = lambda k: F.get("rect", F.lit(k))
    return found.where((side(0) >= 10) & (side(1) >= 0) & (side(2) <= 100) & (side(3) <= 100)).select("doc_id", "pagenum", "name")


@query("SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS n_fields, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def pdf_flatten_form(spark: SparkSession, d: str) -> DataFrame:
    """After flattening no widget is left; the pages stay."""
    made = edits.apply(_documents(spark, d), _fields(spark, d).unionByName(_steps(spark, d, "flatten_form", 1, "turn = 0")))
    pages = documents.load(made, "pages").groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    left = documents.load(made, "widgets").groupBy(F.col("doc_id").alias("w")).agg(F.count("*").alias("n"))
    return pages.join(left, F.col("doc_id") == F.col("w"), "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_fields"), "n_pages")


def _attach(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(".txt"))
    return _steps(spark, d, "attach", name=name, data=F.base64(F.col("text").cast("binary")), mime=F.lit("text/plain"))


_ATTACHED = "SELECT conv_id AS doc_id, 'turn ' || turn || '.txt' AS name, 'text/plain' AS mime, sha256(text) AS sha256, CAST(strlen(text) AS INT) AS size FROM conversations"


@query(_ATTACHED)
def pdf_attachments(spark: SparkSession, d: str) -> DataFrame:
    found = _load(spark, d, "attachments", _attach(spark, d))
    return found.select("doc_id", "name", "mime", F.sha2("bytes", 256).alias("sha256"), F.octet_length("bytes").alias("size"))


@query(f"{_ATTACHED} WHERE turn <> 0")
def pdf_detach(spark: SparkSession, d: str) -> DataFrame:
    found = _load(spark, d, "attachments", _attach(spark, d), _steps(spark, d, "detach", 1, "turn = 0", name=F.lit("turn 0.txt")))
    return found.select("doc_id", "name", "mime", F.sha2("bytes", 256).alias("sha256"), F.octet_length("bytes").alias("size"))


@query("SELECT conv_id AS doc_id, 'd' || turn AS name, CAST(turn + 1 AS INT) AS page, 'XYZ' AS verb, CAST(turn AS VARCHAR) AS top FROM conversations")
def pdf_destinations(spark: SparkSession, d: str) -> DataFrame:
    place = F.array(F.lit(0).cast("long"), F.col("turn").cast("long"), F.lit(1).cast("long"))
    found = _load(spark, d, "named_dests", _steps(spark, d, "set_destination", name=F.concat(F.lit("d"), F.col("turn").cast("string")), page=_page(), verb=F.lit("XYZ"), operands=place))
    return found.select("doc_id", "name", "page", "verb", F.get("operands", F.lit(1)).alias("top"))


@query("SELECT conv_id AS doc_id, CAST(turn AS INT) AS start_page, CASE WHEN turn % 2 = 0 THEN 'D' ELSE 'r' END AS style, 'c' || conv_id AS prefix, CAST(turn + 5 AS INT) AS start_value FROM conversations")
def pdf_page_labels(spark: SparkSession, d: str) -> DataFrame:
    style = F.when(F.col("turn") % 2 == 0, "D").otherwise("r")
    made = _steps(spark, d, "set_page_label", start=F.col("turn").cast("int"), style=style, prefix=F.concat(F.lit("c"), F.col("conv_id").cast("string")), first=F.col("turn").cast("int") + 5)
    return _load(spark, d, "page_labels", made).select("doc_id", "start_page", "style", "prefix", "start_value")


_BOXES = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, unnest(['MediaBox', 'CropBox', 'BleedBox', 'TrimBox', 'ArtBox']) AS box,
  unnest([612.0::DOUBLE, 600.0 - turn, 600.0 - turn, CASE WHEN role = 'user' THEN 500.0 ELSE 600.0 - turn END, 600.0 - turn]) AS x1 FROM conversations"""


@query(_BOXES)
def pdf_page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The five boxes of pages, of which the crop box is set everywhere and the trim box on some; others follow them."""
    crop = _steps(spark, d, "set_box", page=_page(), box=F.lit("CropBox"), rect=_rect(5, 5, F.lit(600) - F.col("turn"), 700))
    trim = _steps(spark, d, "set_box", 1, "role = 'user'", page=_page(), box=F.lit("TrimBox"), rect=_rect(500, 600, 9, 9))
    return _load(spark, d, "page_boxes", crop, trim).select("doc_id", "pagenum", "box", F.get("rect", F.lit(2)).alias("x1"))


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, CAST((turn * 90) % 360 AS INT) AS rotation FROM conversations")
def pdf_rotation(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d, "pages", _steps(spark, d, "set_rotation", page=_page(), degrees=(F.col("turn") * 90).cast("int"))).select("doc_id", "pagenum", "rotation")


def _outline(spark: SparkSession, d: str) -> DataFrame:
    """One edit a document: turns at even places stand at the top, the others below them."""
    item = F.array((F.col("turn") % 2).cast("string"), F.concat(F.lit("Turn "), F.col("turn").cast("string")), _page().cast("string"))
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("item")))).alias("rows"))
    text = F.transform("rows", lambda r: F.concat(F.lit("["), r["item"][0], F.lit(', "'), r["item"][1], F.lit('", '), r["item"][2], F.lit("]")))
    return rows.select("doc_id", F.lit(0).cast("long").alias("seq"), F.lit("set_outline").alias("op"), F.concat(F.lit('{"items": ['), F.array_join(text, ", "), F.lit("]}")).alias("args"))


@query("SELECT conv_id AS doc_id, CAST(turn AS INT) AS seq, CAST(turn % 2 AS INT) AS depth, 'Turn ' || turn AS title, CAST(turn + 1 AS INT) AS page, 'Fit' AS verb FROM conversations")
def pdf_outline_items(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks with the pages that they lead to."""
    return _load(spark, d, "outline_items", _outline(spark, d)).select("doc_id", "seq", "depth", "title", "page", "verb")


@query("SELECT conv_id AS doc_id, CAST(turn AS INT) AS seq, CASE WHEN turn = 1 THEN 'Renamed' ELSE 'Turn ' || turn END AS title FROM conversations")
def pdf_rename_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    renamed = _steps(spark, d, "rename_bookmarks", 1, "turn = 1", old=F.lit("Turn 1"), new=F.lit("Renamed"))
    return _load(spark, d, "outlines", _outline(spark, d), renamed).select("doc_id", "seq", "title")


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    data = F.base64(F.unhex(F.repeat(F.lit("FF8000"), 6)))
    return _steps(spark, d, "add_image", 0, "role = 'assistant'", page=_page(), width=F.lit(3), height=F.lit(2), rgb=data, rect=_rect(0, 0, 30, 20))


@query("SELECT conv_id AS doc_id, count(*) AS n_images, CAST(sum(6) AS BIGINT) AS pixels FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def pdf_count_images(spark: SparkSession, d: str) -> DataFrame:
    found = _load(spark, d, "images", _pictures(spark, d))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_images"), F.sum(F.col("width") * F.col("height")).alias("pixels"))


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, 306 AS width, 396 AS height, CAST(CASE WHEN role = 'assistant' THEN 150 ELSE 0 END AS BIGINT) AS orange FROM conversations")
def pdf_painted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a picture; the orange pixels are those of the image put on it."""
    made = edits.apply(_documents(spark, d), _pictures(spark, d))
    shown, orange = F.hex("image"), "FF8000FF"
    count = (F.length(shown) - F.length(F.replace(shown, F.lit(orange), F.lit("")))) / len(orange)
    return devices.pages(made, "rgba", 36.0).select("doc_id", "pagenum", "width", "height", count.cast("long").alias("orange"))


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum FROM conversations WHERE role = 'assistant' AND turn <> 1")
def pdf_delete_images(spark: SparkSession, d: str) -> DataFrame:
    gone = _steps(spark, d, "delete_images", 1, "turn = 1", page=_page())
    return _load(spark, d, "images", _pictures(spark, d), gone).select("doc_id", "pagenum")


@query("SELECT conv_id AS doc_id, '<x>' || conv_id || '</x>' AS packet FROM (SELECT DISTINCT conv_id FROM conversations)")
def pdf_metadata(spark: SparkSession, d: str) -> DataFrame:
    packet = F.base64(F.concat(F.lit("<x>"), F.col("conv_id").cast("string"), F.lit("</x>")).cast("binary"))
    return _load(spark, d, "metadata", _steps(spark, d, "set_metadata", 0, "turn = 0", packet=packet)).select("doc_id", F.col("packet").cast("string").alias("packet"))


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, 'Page ' || (turn + 3) AS last FROM conversations")
def pdf_page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """A stamp with each page's number, counted from three."""
    runs = _load(spark, d, "text_runs", _steps(spark, d, "stamp", 0, "turn = 0", text=F.lit("Page #"), y=F.lit(30), number_from=F.lit(3)))
    return runs.groupBy("doc_id", "pagenum").agg(F.max_by("text", "seq").alias("last"))


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS pagenum, rtrim(text) AS text FROM conversations")
def pdf_split_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a document of its own."""
    made = _documents(spark, d)
    pages = documents.load(made, "pages").select(F.col("doc_id").alias("of"), "pagenum")
    single = writers.keep_pages(made.join(pages, F.col("doc_id") == F.col("of")).select(F.struct("doc_id", "pagenum").alias("doc_id"), "content", F.array("pagenum").alias("keep")))
    return documents.load(single, "page_text").select("doc_id.doc_id", F.col("doc_id.pagenum").alias("pagenum"), "text")


@query("""
SELECT conv_id AS doc_id, n, 'page ' || (4 + 2 * 0 + 1) || ' 612 792 0' AS first_page, 'root 1' AS root, 1 + 2 + 2 * n + 1 + n AS n_objects
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)""")
def pdf_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The dumps of the documents' parts: lines of the page tree, the trailer and the cross references."""
    found = documents.load(_documents(spark, d), "canonical").groupBy("doc_id")
    of = lambda dump: F.col("dump") == dump
    return found.agg(
        F.count_if(of("pages_tree")).alias("n"), F.min(F.when(of("pages_tree") & (F.col("seq") == 0), F.col("line"))).alias("first_page"),
        F.min(F.when(of("trailer") & F.startswith("line", F.lit("root")), F.col("line"))).alias("root"), F.count_if(of("objects")).alias("n_objects"),
    )


@query("SELECT DISTINCT conv_id AS doc_id, 'Signature1' AS field, 'Tester' AS signer, 'Approved' AS reason, true AS covers_whole, true AS intact FROM conversations")
def pdf_signed(spark: SparkSession, d: str) -> DataFrame:
    """Documents signed with a key for tests, and their signatures read back and verified."""
    key = signing.derived_key(42)
    made = writers.signed(_documents(spark, d), key, signing.self_signed(key, "Tester"), datetime(2024, 1, 1, tzinfo=UTC), Reason="Approved")
    return documents.load(made, "signatures").select("doc_id", "field", "signer", "reason", "covers_whole", "intact")


@query("""
WITH x AS (SELECT o_orderkey, CAST(o_orderkey AS HUGEINT) * 1000003 * 998244353 + 7 AS a, CAST(o_custkey AS HUGEINT) * 65537 + 1 AS b FROM orders)
SELECT o_orderkey, CAST(a + b AS VARCHAR) AS total, CAST(greatest(a, b) - least(a, b) AS VARCHAR) AS gap, CAST(a * b AS VARCHAR) AS product, CAST(a // b AS VARCHAR) AS quotient, CAST(a % b AS VARCHAR) AS rest,
       CAST(CASE WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END AS INT) AS sign, CAST(((b % 1009) * (b % 1009) % 1009) * (b % 1009) % 1009 AS VARCHAR) AS cube FROM x""")
def big_integers(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers beyond a long, as bytes."""
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    rows = table(spark, d, "orders").select("o_orderkey", (wide("o_orderkey") * 1000003 * 998244353 + 7).cast("string").alias("a"), (wide("o_custkey") * 65537 + 1).cast("string").alias("b"))
    rows = rows.select("o_orderkey", bignum.from_decimal(F.col("a")).alias("a"), bignum.from_decimal(F.col("b")).alias("b"))
    sign = bignum.compare(F.col("a"), F.col("b"))
    rows = rows.select("o_orderkey", "a", "b", sign.alias("sign"), F.when(sign >= 0, F.col("a")).otherwise(F.col("b")).alias("most"), F.when(sign >= 0, F.col("b")).otherwise(F.col("a")).alias("least"))
    a, b, small = F.col("a"), F.col("b"), F.lit(bignum.to_bytes(1009))
    out = {"total": bignum.add(a, b), "gap": bignum.sub(F.col("most"), F.col("least")), "product": bignum.mul(a, b), "quotient": bignum.div(a, b), "rest": bignum.mod(a, b), "cube": bignum.mod_pow(b, F.lit(bignum.to_bytes(3)), small)}
    return rows.select("o_orderkey", "sign", *(bignum.to_decimal(v).alias(k) for k, v in out.items()))


@query("""
WITH w AS (SELECT unnest(string_split('{chars}', '')) AS c, unnest([{widths}]) AS n), ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents)
SELECT doc_id, CAST(sum(coalesce(n, 500)) AS BIGINT) AS units FROM ch LEFT JOIN w ON ch.c = w.c WHERE ch.c <> '' GROUP BY doc_id""".format(
    chars="".join(metrics.widths("Helvetica")).replace("'", "''"), widths=", ".join(map(str, metrics.widths("Helvetica").values()))
))
def measure_string(spark: SparkSession, d: str) -> DataFrame:
    """The sum of the advances of each text's characters in Helvetica; characters without a metric count half an em."""
    return table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", metrics.string_units(F.col("text")).alias("units"))


@query("SELECT doc_id, text AS decoded, CAST(length(text) AS INT) AS chars FROM documents WHERE NOT regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]')")
def numeric_entities(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose signs and vowels are written as references, decimal and hexadecimal, and decoded; characters counted
    from their bytes."""
    t = F.col("text")
    for c, ref in (("&", "&#38;"), ("#", "&#35;"), ("<", "&lt;"), (">", "&gt;"), ("a", "&#x61;"), ("e", "&#101;"), ("é", "&#xE9;")):
        t = F.replace(t, F.lit(c), F.lit(ref)) if c != "#" else F.regexp_replace(t, "(?<!&)#", ref)
    rows = table(spark, d, "documents").where(~F.col("text").rlike("[\\x{10000}-\\x{10FFFF}]"))
    rows = rows.select("doc_id", strings.decode_entities(t).alias("decoded"))
    return rows.select("doc_id", "decoded", strings.char_count(F.encode("decoded", "UTF-8"), "utf-8").cast("int").alias("chars"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, 96 AS n384, 128 AS n512 FROM documents")
def digest_five(spark: SparkSession, d: str) -> DataFrame:
    """All five digests of the bundle; of the two that SQL lacks, the lengths (their values are tested beside it)."""
    b = F.col("text").cast("binary")
    return table(spark, d, "documents").select("doc_id", F.md5(b).alias("md5"), F.sha1(b).alias("sha1"), F.sha2(b, 256).alias("sha256"), F.length(F.sha2(b, 384)).alias("n384"), F.length(F.sha2(b, 512)).alias("n512"))
