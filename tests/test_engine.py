"""Functions, operators, sources and streams on small tables."""

import math

from pyspark.sql import functions as F

from leafmill.functions import colour, geometry, maps, text
from leafmill.kernels import crypto, pdf_write
from leafmill.operators import ordered, pages, trees
from leafmill.sources import documents, writers
from leafmill.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry(spark):
    m = geometry.compose(geometry.rotate(math.pi / 2), geometry.translate(10, 0))
    p = one(spark, geometry.apply(m, 1, 0).alias("p"))["p"]
    assert abs(p["x"] - 10) < 1e-9 and abs(p["y"] - 1) < 1e-9
    assert one(spark, geometry.inverse(geometry.scale(0, 1)).alias("i"))["i"] is None
    view = one(spark, geometry.apply(geometry.viewport(geometry.rect(0, 0, 100, 200), 90, 200, 100), 0, 0).alias("p"))["p"]
    assert (round(view["x"], 6), round(view["y"], 6)) == (0.0, 0.0)
    a, b = geometry.rect(0, 0, 10, 10), geometry.rect(10, 10, 20, 20)
    r = one(spark, geometry.is_intersect(a, b).alias("closed"), geometry.overlaps(a, b).alias("open"), geometry.join(a, b).alias("j"))
    assert r["closed"] and not r["open"] and r["j"]["urx"] == 20
    turned = [r[0] for r in spark.createDataFrame([(44,), (45,), (-45,), (-100,), (450,)], "r int").select(geometry.normalize_rotation(F.col("r"))).collect()]
    assert turned == [0, 90, 270, 270, 90]


def test_colour(spark):
    nan = F.lit(float("nan"))
    r = one(spark, colour.cmyk_to_srgb(F.lit(0.5), nan, F.lit(2.0), F.lit(0.5)).alias("c"), colour.quantize(F.lit(0.5)).alias("q"), colour.hex_colour(F.lit(255), F.lit(0), F.lit(10)).alias("h"))
    assert tuple(r["c"]) == (0.25, 0.5, 0.0) and r["q"] == 128 and r["h"] == "#FF000A"


def test_text(spark):
    r = one(spark, text.hex_decode(F.lit("48 6>zz")).alias("x"), text.page_number(F.lit("p. #"), F.lit(3)).alias("n"), text.get_bytes(F.lit("é中"), "latin1").alias("l"), text.last_slice(F.lit("a%%EOFb%%EOFc")).alias("s"))
    assert bytes(r["x"]) == b"H`" and r["n"] == "p. 3" and bytes(r["l"]) == b"\xe9?" and r["s"] == "b%%EOFc"
    key = one(spark, crypto.object_key_column(F.lit(b"abcde"), F.lit(300).cast("long"), F.lit(1).cast("long"), True, 5).alias("k"))["k"]
    assert bytes(key) == crypto.object_key(b"abcde", 300, 1, True)


def test_maps(spark):
    m = F.create_map(F.lit("Title"), F.lit("a"), F.lit("Mine"), F.lit("b"))
    r = one(spark, maps.clear_custom(m).alias("c"), maps.put(m, "Title", F.lit("z")).alias("p"), maps.canonical(m).alias("t"))
    assert r["c"] == {"Title": "a"} and r["p"]["Title"] == "z" and r["t"] == "Mine\tb\nTitle\ta"


def test_pages_and_order(spark):
    p = spark.createDataFrame([(1, i, f"t{i}") for i in range(1, 5)], "doc int, page int, text string")
    assert [r["page"] for r in pages.delete(p, "doc", "page", p.where("page = 2")).orderBy("new_page").collect()] == [1, 3, 4]
    assert pages.text_of(p, "doc", "page", "text", "|").first()["text"] == "t1|t2|t3|t4"
    starts = spark.createDataFrame([(1, 2, "a"), (1, 4, "b")], "doc int, start int, label string")
    assert [r["label"] for r in ordered.as_of(p, starts, ["doc"], "page", "start", "label").orderBy("page").collect()] == [None, "a", "a", "b"]
    assert ordered.newest(p, ["doc"], F.col("page").desc()).first()["page"] == 4


def test_trees(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r["node"] for r in trees.reachable(roots, edges).collect()} == {"a", "b", "c"}
    nodes = spark.createDataFrame([(n,) for n in "abcxy"], "node string")
    assert {r["node"] for r in trees.garbage(nodes, roots, edges).collect()} == {"x", "y"}


def test_document_tables(spark, tmp_path):
    body = pdf_write.from_pages([["a", "b"], ["c"]], info={"Title": "T"}, outline=[(0, "One"), (1, "Two")])
    docs = spark.createDataFrame([(1, body), (2, b"junk"), (3, None)], "doc_id int, content binary")
    assert [(r["pagenum"], r["text"]) for r in documents.load(docs, "page_text").orderBy("pagenum").collect()] == [(1, "a\nb"), (2, "c")]
    for name in documents.TABLES:
        documents.load(docs, name).collect()
    assert documents.load(docs, "info").first()["value"] == "T"
    both = writers.concatenate(spark.createDataFrame([("g", 1, body), ("g", 2, body)], "g string, n int, content binary"), "g", "n")
    assert documents.load(both.withColumnRenamed("g", "doc_id"), "page_text").count() == 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(body)
    assert documents.load(documents.read_binary(spark, str(tmp_path / "in")), "pages").count() == 2
    stream = ingest.document_stream(spark, str(tmp_path / "in"), "page_text").writeStream.format("memory").queryName("pages_in").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    assert spark.table("pages_in").count() == 2


def test_event_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 05:00:00", "b")], "event_id long, ts string, event_type string")
    rows.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    q = ingest.event_counts(events).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").where("event_type = 'a'").agg(F.max("n")).first()[0] == 2
