"""Queries on pages, references, trees and ordered runs, on tables that stand for a document's parts.

A conversation stands for a document and its turns for pages; orders, customers and nations for objects and
the references between them; events for runs in the order in which they are shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import ordered, pages, trees

from ._tables import table
from .catalog import query


@query("""
WITH runs AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS y FROM documents)
SELECT doc_id, lang, CAST(sum(len(string_split(line, 'the')) - 1) AS BIGINT) AS n_matches, CAST(min(y) FILTER (contains(line, 'the')) AS BIGINT) AS first_line
FROM runs GROUP BY doc_id, lang HAVING sum(len(string_split(line, 'the')) - 1) > 0""")
def find_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Literal phrase search over lines: non-overlapping matches, and the first line that has one."""
    runs = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("y", "line"))
    n = F.size(F.split("line", r"\Qthe\E", -1)) - 1
    out = runs.select("doc_id", "lang", "y", n.alias("n")).where("n > 0").groupBy("doc_id", "lang")
    return out.agg(F.sum("n").cast("long").alias("n_matches"), F.min("y").cast("long").alias("first_line"))


@query("""
WITH runs AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS y FROM documents),
parts AS (SELECT doc_id, y, string_split(line, 'the') AS p FROM runs WHERE contains(line, 'the')),
spots AS (SELECT doc_id, y, p, unnest(range(1, len(p))) AS k FROM parts)
SELECT doc_id, CAST(y AS BIGINT) AS y, CAST(k AS BIGINT) AS occurrence,
       CAST(list_sum(list_transform(p[1:k], lambda s: length(s))) + 3 * (k - 1) AS DOUBLE) * 12 * 0.5 AS x FROM spots""")
def phrase_positions(spark: SparkSession, d: str) -> DataFrame:
    """Every match with its place: half an em (of size 12) a character from the start of its line."""
    runs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("y", "line"))
    parts = runs.where(F.contains("line", F.lit("the"))).select("doc_id", "y", F.split("line", r"\Qthe\E", -1).alias("p"))
    spots = parts.select("doc_id", "y", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    offset = F.aggregate(F.slice("p", 1, F.col("k")), F.lit(0), lambda t, s: t + F.length(s)) + 3 * (F.col("k") - 1)
    return spots.select("doc_id", F.col("y").cast("long").alias("y"), F.col("k").cast("long").alias("occurrence"), (offset.cast("double") * 12 * 0.5).alias("x"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE turn BETWEEN 1 AND 2 GROUP BY conv_id")
def page_range_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.text_of(pages.between(table(spark, d, "conversations"), "turn", 1, 2), "conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def absorb_concat(spark: SparkSession, d: str) -> DataFrame:
    return pages.text_of(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT conv_id, string_agg(text, chr(12) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def canonical_formfeed(spark: SparkSession, d: str) -> DataFrame:
    return pages.text_of(table(spark, d, "conversations"), "conv_id", "turn", "text", "\f\n")


@query("""
WITH n AS (SELECT conv_id, CAST(count(*) AS INT) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, n, list_min([greatest(2, 1), 99]) AS first_page, CASE WHEN greatest(2, 1) <= n THEN n - 1 ELSE 0 END AS n_pages FROM n""")
def page_range_clamp(spark: SparkSession, d: str) -> DataFrame:
    """The pages of [2, last] of each document."""
    n = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    r = pages.clamp_range(F.col("n"), F.lit(2), F.lit(0))
    return n.select("conv_id", "n", F.lit(2).alias("first_page"), F.coalesce(F.size(r), F.lit(0)).alias("n_pages")).withColumn("n_pages", F.greatest("n_pages", F.lit(0)))


@query("""
WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, unnest(range(1, n + 1)) AS page FROM n
EXCEPT SELECT conv_id, turn + 1 FROM conversations WHERE role = 'user'""")
def complement_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that aren't a user's turn."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"), F.collect_set(F.when(F.col("role") == "user", (F.col("turn") + 1).cast("int"))).alias("keep"))
    return g.select("conv_id", F.explode(pages.complement(F.col("n"), F.col("keep")).cast("array<bigint>")).alias("page"))


@query("""
SELECT source_doc, item, row_number() OVER (ORDER BY part, item) AS page FROM (
  SELECT 0 AS part, 'documents' AS source_doc, doc_id AS item FROM documents WHERE lang = 'es'
  UNION ALL SELECT 1, 'benchmark', item_id FROM benchmark)""")
def concat_docs(spark: SparkSession, d: str) -> DataFrame:
    """Two documents' pages one after the other, numbered through. The second's numbers go on from the count of
    the first, so no sort of everything in one task is needed: ranks within chunks plus the chunks' offsets."""
    a = table(spark, d, "documents").where("lang = 'es'").select(F.lit("documents").alias("source_doc"), F.col("doc_id").alias("item"))
    b = table(spark, d, "benchmark").select(F.lit("benchmark").alias("source_doc"), F.col("item_id").alias("item"))
    rows = pages.concatenate([a, b], "page").withColumn("chunk", F.floor(F.col("item") / 4096))
    sizes = rows.groupBy("part", "chunk").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("part", "chunk", before.alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part", "chunk").orderBy("item"))
    return rows.withColumn("rank", rank).join(offsets, ["part", "chunk"]).select("source_doc", "item", (F.col("rank") + F.col("offset")).cast("long").alias("page"))


@query("""
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY k, turn) AS INT) AS page, text FROM (
  SELECT conv_id, turn, text, CASE WHEN turn < 1 THEN 0 ELSE 2 END AS k FROM conversations
  UNION ALL SELECT conv_id, 0, 'inserted', 1 FROM (SELECT DISTINCT conv_id FROM conversations))""")
def insert_splice(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    new = c.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("inserted").alias("text"))
    return pages.insert(c, "conv_id", "turn", new, 1).select("conv_id", F.col("new_page").alias("page"), "text")


@query("""
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS new_page FROM conversations WHERE turn % 3 <> 1""")
def delete_pages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return pages.delete(c, "conv_id", "turn", c.where("turn % 3 = 1")).select("conv_id", "turn", "new_page")


@query("""
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS new_page FROM conversations WHERE role = 'assistant'""")
def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return pages.extract(c.select("conv_id", "turn"), "conv_id", "turn", c.where("role = 'assistant'")).select("conv_id", "turn", "new_page")


@query("""
SELECT conv_id, g AS bulk, string_agg(text, '' ORDER BY turn) AS text FROM conversations
JOIN (VALUES (0, 0, 1), (1, 2, 3), (2, 4, 1000000)) t(g, a, b) ON turn BETWEEN a AND b GROUP BY conv_id, g""")
def split_bulks(spark: SparkSession, d: str) -> DataFrame:
    """One output for each group of pages."""
    c = table(spark, d, "conversations").withColumn("bulk", F.when(F.col("turn") <= 1, 0).when(F.col("turn") <= 3, 1).otherwise(2))
    rows = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return c.groupBy("conv_id", "bulk").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "").alias("text"))


@query("SELECT conv_id, turn, 'first' AS half FROM conversations WHERE turn <= 1 UNION ALL SELECT conv_id, turn, 'rest' FROM conversations WHERE turn >= 2")
def split_two(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.where("turn <= 1").select("conv_id", "turn", F.lit("first").alias("half")).unionByName(c.where("turn >= 2").select("conv_id", "turn", F.lit("rest").alias("half")))


@query("""
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def xref_newest_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of entries with one key the newest stays: one aggregation with map-side combine, where a window would sort."""
    e = table(spark, d, "events")
    top = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return e.groupBy("user_id", "event_type").agg(top.alias("top")).select("user_id", "event_type", "top.event_id", "top.value")


@query("SELECT o_orderkey, o_custkey, c_name AS target FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def deref_left(spark: SparkSession, d: str) -> DataFrame:
    """References resolve where the object exists, and stay as they are elsewhere."""
    o, c = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", F.col("c_name").alias("target"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unresolved_refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def has_field(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("""
WITH starts AS (SELECT user_id, ts AS start_ts, event_id AS label FROM events WHERE event_id % 7 = 0)
SELECT e.event_id, e.user_id, (SELECT max_by(label, (start_ts, label)) FROM starts s WHERE s.user_id = e.user_id AND s.start_ts <= e.ts) AS label FROM events e""")
def page_label_asof(spark: SparkSession, d: str) -> DataFrame:
    """As-of lookup: the label of the largest start that isn't after a page."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    s = e.where("event_id % 7 = 0").groupBy("user_id", "ts").agg(F.max("event_id").alias("label"))
    return ordered.as_of(e, s.withColumnRenamed("ts", "start_ts"), ["user_id"], "ts", "start_ts", "label").select("event_id", "user_id", "label")


@query("""
WITH lines AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS y, unnest(string_split(text, chr(10))) AS line FROM documents),
regions AS (SELECT doc_id, doc_id % 5 AS y0, doc_id % 5 + 2 AS y1 FROM labels)
SELECT doc_id, CAST(y AS BIGINT) AS y, line FROM lines l WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.doc_id = l.doc_id AND l.y < r.y1 AND r.y0 < l.y + 1)""")
def redact_anti(spark: SparkSession, d: str) -> DataFrame:
    """Lines that no redaction region of their document overlaps (open intervals); the equality bounds the join."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("y", "line")).withColumn("y", F.col("y").cast("long"))
    regions = table(spark, d, "labels").select(F.col("doc_id").alias("r_doc"), (F.col("doc_id") % 5).alias("y0"), (F.col("doc_id") % 5 + 2).alias("y1"))
    return lines.join(regions, (F.col("doc_id") == F.col("r_doc")) & (F.col("y") < F.col("y1")) & (F.col("y0") < F.col("y") + 1), "left_anti")


@query("""
SELECT r_name || '/' || n_name || '/' || c_name AS path, 3 AS depth, c_custkey AS node FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT r_name || '/' || n_name, 2, n_nationkey FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT r_name, 1, r_regionkey FROM region""")
def outline_flatten(spark: SparkSession, d: str) -> DataFrame:
    """A tree in preorder paths, level by level."""
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    key = lambda kind, k: F.concat(F.lit(kind), k.cast("string"))
    roots = r.select(key("r", F.col("r_regionkey")).alias("node"), F.col("r_name").alias("seq"))
    edges = n.select(key("r", F.col("n_regionkey")).alias("parent"), key("n", F.col("n_nationkey")).alias("node"), F.col("n_name").alias("seq")).unionByName(
        c.select(key("n", F.col("c_nationkey")).alias("parent"), key("c", F.col("c_custkey")).alias("node"), F.col("c_name").alias("seq")))
    out = trees.descend(roots, edges)
    return out.select(F.array_join("path", "/").alias("path"), "depth", F.substring("node", 2, 20).cast("long").alias("node"))


@query("""
WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS src, 'o' || o_orderkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
t AS (SELECT 'n3' AS node UNION SELECT dst FROM t JOIN e ON t.node = e.src)
SELECT o_orderkey FROM orders WHERE 'o' || o_orderkey NOT IN (SELECT node FROM t)""")
def reachable_gc(spark: SparkSession, d: str) -> DataFrame:
    """Objects that nothing reachable from a root refers to."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    name = lambda kind, k: F.concat(F.lit(kind), F.col(k).cast("string"))
    edges = o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")).unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    roots = spark.range(1).select(F.lit("n3").alias("node"))
    nodes = o.select(name("o", "o_orderkey").alias("node"))
    return trees.garbage(nodes, roots, edges).select(F.substring("node", 2, 20).cast("long").alias("o_orderkey"))


@query("""
SELECT 'n' || n_nationkey AS node, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE r_name END AS box FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'r' || r_regionkey, r_name FROM region""")
def inherit_box(spark: SparkSession, d: str) -> DataFrame:
    """A page's own box, or that of its nearest ancestor with one."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    nodes = r.select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("box")).unionByName(
        n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("node"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("box")))
    return trees.inherit(nodes, "box")


@query("""
SELECT o_custkey, o_orderkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS revision FROM orders""")
def revision_running(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).over(w).cast("long").alias("revision"))


@query("""
SELECT user_id, event_id, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)) > 0.001, false) AS breaks FROM events""")
def baseline_breaks(spark: SparkSession, d: str) -> DataFrame:
    return ordered.line_breaks(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value").select("user_id", "event_id", "breaks")


@query("""
WITH n AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN event_id END AS reset, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
l AS (SELECT *, last_value(reset IGNORE NULLS) OVER w AS last_reset, last_value(CASE WHEN reset IS NOT NULL THEN k END IGNORE NULLS) OVER w AS at_k FROM n
      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, last_reset + k - at_k AS code FROM l""")
def differences_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Codes that count on from the last explicit one."""
    e = table(spark, d, "events").select("user_id", "event_id")
    return ordered.since_reset(e, ["user_id"], "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_id")), "code").select("user_id", "event_id", "code")


@query("""
SELECT n_name, lag(n_name) OVER w AS prev, lead(n_name) OVER w AS next FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_name)""")
def siblings(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    return table(spark, d, "nation").select("n_name", F.lag("n_name").over(w).alias("prev"), F.lead("n_name").over(w).alias("next"))


@query("""
WITH g AS (SELECT l_linenumber AS x, CAST(l_quantity AS INT) AS y, CAST(count(*) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2),
r AS (SELECT x, y, v, sum(v) OVER (PARTITION BY y ORDER BY x) AS rs FROM g)
SELECT x, y, CAST(sum(rs) OVER (PARTITION BY x ORDER BY y) AS BIGINT) AS total FROM r""")
def integral_image(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("x"), F.col("l_quantity").cast("int").alias("y")).agg(F.count("*").alias("v"))
    return ordered.integral(g, "x", "y", "v").select("x", "y", F.col("total").cast("long").alias("total"))


@query("SELECT l_returnflag AS bucket, min(l_linenumber) AS lo, max(l_linenumber) AS hi, CAST(floor(sum(l_linenumber) / count(*)) AS BIGINT) AS mean, count(*) AS n FROM lineitem GROUP BY 1")
def bucket_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds and truncated means of colour buckets."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("bucket"))
    return g.agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.floor(F.sum("l_linenumber") / F.count("*")).alias("mean"), F.count("*").alias("n"))


@query("""
WITH px AS (SELECT p_partkey, p_size * 5 AS r, p_partkey % 256 AS g, (p_partkey * 7) % 256 AS b FROM part),
pal AS (SELECT i, (i * 37) % 256 AS pr, (i * 91) % 256 AS pg, (i * 53) % 256 AS pb FROM range(16) t(i))
SELECT p_partkey, CAST(arg_min(i, (((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)), i)) AS INT) AS idx FROM px, pal GROUP BY p_partkey""")
def nearest_palette(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of 16 palette colours for each pixel, ties to the lowest index; the palette is a literal."""
    from leafmill.functions.palette import nearest

    palette = [((i * 37) % 256, (i * 91) % 256, (i * 53) % 256) for i in range(16)]
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"), ((F.col("p_partkey") * 7) % 256).alias("b"))
    return p.select("p_partkey", nearest(F.col("r"), F.col("g"), F.col("b"), palette).alias("idx"))


@query("""
WITH f AS (SELECT conv_id, count(*) FILTER (role = 'assistant') AS signed, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, signed AS total_revision, signed > 0 AS contains_signature, n AS pages FROM f""")
def signature_summary(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "conversations").groupBy("conv_id")
    return g.agg(F.count_if(F.col("role") == "assistant").alias("total_revision"), F.bool_or(F.col("role") == "assistant").alias("contains_signature"), F.count("*").alias("pages"))


@query("SELECT conv_id, turn, text FROM conversations WHERE turn = 1")
def next_page(spark: SparkSession, d: str) -> DataFrame:
    """The cursor's second page of each document."""
    return table(spark, d, "conversations").where("turn = 1").select("conv_id", "turn", "text")


@query("""
SELECT n_nationkey AS bookmark, n_name AS title, coalesce(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey END, 1) AS page FROM nation WHERE n_name <> 'NATION_3'""")
def bookmarks_edit(spark: SparkSession, d: str) -> DataFrame:
    """Bookmarks of titles and pages, a missing page meaning the first, without a deleted title."""
    n = table(spark, d, "nation")
    page = F.coalesce(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")), F.lit(1))
    return n.where("n_name <> 'NATION_3'").select(F.col("n_nationkey").alias("bookmark"), F.col("n_name").alias("title"), page.alias("page"))
