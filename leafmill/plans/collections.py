"""Queries on a document's collections: annotations, fields, destinations, attachments, boxes and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import geometry, layout
from leafmill.kernels import encodings, pdf
from leafmill.operators import trees

from ._tables import table
from .catalog import query


@query("SELECT event_id, event_type FROM events WHERE event_type <> (SELECT min(event_type) FROM events)")
def delete_annotations(spark: SparkSession, d: str) -> DataFrame:
    """All annotations but those of one type."""
    e = table(spark, d, "events").select("event_id", "event_type")
    first = e.groupBy().agg(F.min("event_type").alias("gone"))
    return e.join(F.broadcast(first), F.col("event_type") == F.col("gone"), "left_anti")


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def annotations_by_type(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""
WITH f AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Btn' WHEN 1 THEN 'Ch' WHEN 2 THEN 'Tx' WHEN 3 THEN 'Sig' ELSE 'No' END AS ft, (event_id % 8) << 15 AS ff FROM events)
SELECT event_id, CASE ft WHEN 'Btn' THEN CASE WHEN ff & 65536 <> 0 THEN 'push' WHEN ff & 32768 <> 0 THEN 'radio' ELSE 'checkbox' END
  WHEN 'Ch' THEN CASE WHEN ff & 131072 <> 0 THEN 'combo' ELSE 'list' END WHEN 'Tx' THEN 'text' WHEN 'Sig' THEN 'signature' ELSE 'unknown' END AS kind FROM f""")
def field_kinds(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    ft = F.when(e % 5 == 0, "Btn").when(e % 5 == 1, "Ch").when(e % 5 == 2, "Tx").when(e % 5 == 3, "Sig").otherwise("No")
    return table(spark, d, "events").select("event_id", layout.field_kind(ft, F.shiftleft((e % 8).cast("long"), 15)).alias("kind"))


@query("""
SELECT o.o_orderkey, p.page FROM orders o LEFT JOIN (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS page FROM customer) p ON o.o_custkey = p.c_custkey""")
def dest_page_number(spark: SparkSession, d: str) -> DataFrame:
    """Destinations by the number of the page they refer to."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    p = table(spark, d, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("page"), "c_nationkey").drop("c_nationkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(p, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "page")


@query("""
WITH m AS (SELECT max(n_nationkey) AS top FROM nation)
SELECT s_suppkey, top + row_number() OVER (ORDER BY s_suppkey) AS new_id FROM supplier, m WHERE s_nationkey < 5""")
def import_remap(spark: SparkSession, d: str) -> DataFrame:
    """Imported objects get numbers above those in use: ranks in chunks of ids plus the chunks' offsets."""
    s = table(spark, d, "supplier").where("s_nationkey < 5").select("s_suppkey", F.floor(F.col("s_suppkey") / 4096).alias("chunk"))
    top = table(spark, d, "nation").agg(F.max("n_nationkey")).first()[0]
    sizes = s.groupBy("chunk").count()
    offset = F.coalesce(F.sum("count").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy("s_suppkey"))
    joined = s.withColumn("rank", rank).join(sizes.select("chunk", offset.alias("offset")), "chunk")
    return joined.select("s_suppkey", (F.lit(top).cast("long") + F.col("offset") + F.col("rank")).alias("new_id"))


@query("""
SELECT p_partkey, label FROM (SELECT p_partkey, p_brand AS label FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT p_partkey, 'new-' || p_partkey FROM part WHERE p_partkey % 10 = 0)""")
def label_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Labels that are put replace those of the same page."""
    p = table(spark, d, "part")
    new = p.where("p_partkey % 10 = 0").select("p_partkey", F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("label"))
    old = p.select("p_partkey", F.col("p_brand").alias("label"))
    return old.join(new.select("p_partkey"), "p_partkey", "left_anti").unionByName(new)


@query("""
WITH r AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x0, CAST(p_partkey % 9 AS DOUBLE) AS y0, CAST(p_size + 10 AS DOUBLE) AS x1, CAST(p_partkey % 9 + 6 AS DOUBLE) AS y1 FROM part),
c AS (SELECT *, x0 <= 30 AND 20 <= x1 AND y0 <= 9 AND 4 <= y1 AS meets FROM r)
SELECT p_partkey, CASE WHEN meets THEN greatest(x0, 20) ELSE 0 END AS ix0, CASE WHEN meets THEN least(y1, 9) ELSE 0 END AS iy1, least(x0, 20) AS jx0, greatest(y1, 9) AS jy1,
       25 BETWEEN x0 AND x1 AND 7 BETWEEN y0 AND y1 AS holds, abs(x0 - 20) <= 1 AND abs(y0 - 4) <= 1 AND abs(x1 - 30) <= 1 AND abs(y1 - 9) <= 1 AS near FROM c""")
def rectangle_algebra(spark: SparkSession, d: str) -> DataFrame:
    r = geometry.rect(F.col("p_size").cast("double"), (F.col("p_partkey") % 9).cast("double"), (F.col("p_size") + 10).cast("double"), (F.col("p_partkey") % 9 + 6).cast("double"))
    q = geometry.rect(20, 4, 30, 9)
    rows = table(spark, d, "part").select("p_partkey", r.alias("r"))
    cut, hull = geometry.intersect(F.col("r"), q), geometry.join(F.col("r"), q)
    return rows.select(
        "p_partkey", cut["llx"].alias("ix0"), cut["ury"].alias("iy1"), hull["llx"].alias("jx0"), hull["ury"].alias("jy1"),
        geometry.contains(F.col("r"), F.lit(25.0), F.lit(7.0)).alias("holds"), geometry.near_equals(F.col("r"), q, 1.0).alias("near"),
    )


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN l_quantity ELSE CASE WHEN l_quantity < 30 THEN 10 + (l_quantity - 10) * 2 ELSE 50 - (l_quantity - 30) END END AS v FROM lineitem""")
def stitched_function(spark: SparkSession, d: str) -> DataFrame:
    """A shading function of three parts over quantities."""
    v = layout.stitched(F.col("l_quantity"), 0.0, 50.0, [10.0, 30.0], [(0.0, 10.0), (10.0, 50.0), (50.0, 30.0)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(v, 9).alias("v"))


@query("""
SELECT doc_id, n_lines, longest FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) AS longest FROM documents)""")
def line_shapes(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_max(F.transform(lines, F.length)).cast("long").alias("longest"))


@query("SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS words, true AS fits FROM documents")
def word_wrap(spark: SparkSession, d: str) -> DataFrame:
    """Wrapped at 80 characters: the words stay, and every line fits or is one word."""
    rows = table(spark, d, "documents").select("doc_id", layout.wrap(F.col("text"), 80).alias("lines"))
    return rows.select("doc_id", F.array_join("lines", " ").alias("words"), F.forall("lines", lambda x: (F.length(x) <= 80) | ~F.contains(x, F.lit(" "))).alias("fits"))


@query("""
WITH c AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents)
SELECT ch, unicode(ch) AS code FROM c WHERE ch <> '' AND (unicode(ch) BETWEEN 32 AND 126 OR unicode(ch) BETWEEN 192 AND 255)""")
def glyph_names(spark: SparkSession, d: str) -> DataFrame:
    """The printable ASCII and Latin-1 letters of all texts by way of their glyph names and back: the characters of each
    text meet in sets, and the table of names is joined to what is left."""
    known = spark.createDataFrame([(k, v) for k, v in pdf.GLYPHS.items()], "name string, text string")
    chars = table(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).distinct().where(F.col("ch").rlike("^[ -~À-ÿ]$"))
    glyphs = spark.createDataFrame([(c, n) for c, n in encodings.glyph_of().items()], "c string, glyph string")
    named = chars.join(F.broadcast(glyphs), F.col("ch") == F.col("c")).select("glyph")
    back = named.join(F.broadcast(known), F.col("glyph") == F.col("name")).select(F.col("text").alias("ch"))
    return back.select("ch", F.expr("ascii(ch)").alias("code"))


@query("SELECT r_name, count(DISTINCT n_nationkey) + count(c_custkey) AS visible FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0 GROUP BY r_name")
def visible_count(spark: SparkSession, d: str) -> DataFrame:
    """Descendants that show: those of nations that are open."""
    n = table(spark, d, "nation").withColumn("open", F.col("n_nationkey") % 2 == 0)
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("seq"))
    edges = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("seq"))
    c = table(spark, d, "customer").join(n.where("open").select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = edges.unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_name").alias("seq")))
    below = trees.descend(roots, edges).where("depth > 1")
    return below.groupBy(F.col("path")[0].alias("r_name")).agg(F.count("*").alias("visible"))


@query("SELECT vec_id, label, len(embedding) AS n, CAST(floor(embedding[1] * 1000) AS BIGINT) AS first_value FROM embeddings")
def vector_table(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by their first value in thousandths, multiplied in the vectors' own type: as doubles, the float 0.029
    gives 28.99. An empty vector has no first value."""
    e = table(spark, d, "embeddings")
    thousand = F.lit(1000).cast(e.schema["embedding"].dataType.elementType)
    return e.select("vec_id", "label", F.size("embedding").cast("long").alias("n"), F.floor(F.get("embedding", F.lit(0)) * thousand).cast("long").alias("first_value"))


@query("SELECT conv_id, array_to_string(list(DISTINCT role ORDER BY role), ',') AS roles, array_to_string(list(turn ORDER BY turn) FILTER (turn <> 1), ',') AS kept FROM conversations GROUP BY conv_id")
def choice_options(spark: SparkSession, d: str) -> DataFrame:
    """Options of a field in order, without one that is removed."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return g.select("conv_id", F.array_join("roles", ",").alias("roles"), F.array_join(F.array_remove("turns", 1), ",").alias("kept"))
