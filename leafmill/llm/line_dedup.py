"""Line dedup: lines that many sites share are boilerplate, in DataFrame operations only.

A HyperLogLog sketch of the sites is kept for each line's hash and merged by the aggregation. Lines whose
estimate is near the threshold get an exact count of distinct sites; the estimate decides the others. Of a
boilerplate line the document with the smallest id keeps its occurrences, and all others lose theirs. Hashes of lines,
not lines, are counted; texts are shuffled once, to meet the hashes that they lose, whatever their number.

Null texts have no lines and stay null; blank lines are never boilerplate. A null source is a site of its own.
Rows that repeat an id count as one document. Documents that lose all lines stay, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import materialize, release

MIN_SITES = 10
LG_K = 12
#: Estimates this far from the threshold, relatively, are decided by an exact count (over six standard errors).
BAND = 0.15


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def lines_of(docs: DataFrame, site: str = "source") -> DataFrame:
    """id, text hash (t), site and line hash (h), once for each document and line. A null site differs from all others."""
    lines = F.filter(F.array_distinct(F.split("text", "\n")), lambda x: F.trim(x) != "")
    named = F.coalesce(F.concat(F.lit("="), F.col(site).cast("string")), F.lit(""))
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), _text_hash(F.col("text")).alias("t"), named.alias("site"), F.transform(lines, lambda x: F.xxhash64(x)).alias("hs"))
    return rows.select("id", "t", "site", F.explode("hs").alias("h"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h and the id that keeps it (keep_id) of each line that at least ``min_sites`` sites have.

    Most lines have one site; their least and largest are equal, which a hash aggregation finds. Sketches are
    built for the rest only."""
    several = materialize(lines.groupBy("h").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.min("id").alias("keep_id")).where("a < b").select(F.col("h").alias("sh"), "keep_id"), "several")
    rest = lines.join(several, F.col("h") == F.col("sh")).select("h", "site", "keep_id")
    merged = rest.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.first("keep_id").alias("keep_id"))
    spread = materialize(merged.select("h", "keep_id", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    near = F.abs(F.col("sites") - min_sites) <= max(1.0, BAND * min_sites)
    asked = spread.where(near).select(F.col("h").alias("nh"), "keep_id")
    exact = lines.join(asked, F.col("h") == F.col("nh")).groupBy("h", "site").agg(F.first("keep_id").alias("keep_id"))
    exact = exact.groupBy("h").agg(F.count("*").alias("sites"), F.first("keep_id").alias("keep_id")).where(F.col("sites") >= min_sites)
    out = materialize(spread.where(~near & (F.col("sites") >= min_sites)).select("h", "keep_id").unionByName(exact.select("h", "keep_id")), "boilerplate")
    release(several, spread)
    return out


def removals(lines: DataFrame, bad: DataFrame) -> DataFrame:
    """lost_id, lost_t and the hashes of the lines that the text loses, for each id and text that loses any."""
    bad = bad.select(F.col("h").alias("bh"), "keep_id")
    hit = lines.join(bad, F.col("h") == F.col("bh")).where(~F.col("id").eqNullSafe(F.col("keep_id")))
    return materialize(hit.groupBy(F.col("id").alias("lost_id"), F.col("t").alias("lost_t")).agg(F.collect_set("h").alias("lost")), "lost")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """The documents with their columns; boilerplate lines are gone from the texts (``n_chars``, if there, follows)."""
    lines = materialize(lines_of(docs, site), "lines")
    bad = boilerplate(lines, min_sites)
    # what texts lose grows with the input, so it is joined by a merge at every size
    lost = removals(lines, bad).hint("merge")
    release(lines, bad)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(lost, F.col("row.doc_id").eqNullSafe(F.col("lost_id")) & (_text_hash(F.col("row.text")) == F.col("lost_t")), "left")
    left = F.array_join(F.filter(F.split("row.text", "\n"), lambda x: ~F.array_contains(F.col("lost"), F.xxhash64(x)) | (F.trim(x) == "")), "\n")
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(left)
    out = joined.select("row", text.alias("new"))
    if "n_chars" not in docs.columns:
        return out.select(*[F.col("new").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    count = F.length("new").cast(docs.schema["n_chars"].dataType)
    return out.select(*[F.col("new").alias(c) if c == "text" else count.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, lines before and after, and the digest of the text that is left, of every document."""
    n = lambda c: F.coalesce(F.when(F.length(c) == 0, 0).otherwise(F.size(F.split(c, "\n"))), F.lit(0)).cast("long")
    after = dedup_lines(docs.select("doc_id", "source", "text", n(F.col("text")).alias("n_lines")), min_sites)
    return after.select("doc_id", "n_lines", n(F.col("text")).alias("n_kept"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


CLEAN_SQL = """
  l AS (SELECT doc_id, coalesce('=' || source, '') AS site, r, pos, line FROM (
          SELECT doc_id, source, r, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line
          FROM (SELECT doc_id, source, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM {table}))),
  bad AS (SELECT line, min(doc_id) AS keep_id FROM l WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
  cleaned AS (SELECT l.r, any_value(l.doc_id) AS doc_id, count(*) AS n_all, count(*) FILTER (bad.line IS NULL OR l.doc_id = bad.keep_id) AS n_kept,
                     coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (bad.line IS NULL OR l.doc_id = bad.keep_id), '') AS text
              FROM l LEFT JOIN bad ON l.line = bad.line GROUP BY l.r)"""
SQL = f"""WITH {CLEAN_SQL.format(table="documents")}
SELECT doc_id, n_all AS n_lines, CASE WHEN text = '' THEN 0 ELSE n_kept END AS n_kept, sha256(text) AS text_sha256 FROM cleaned"""
