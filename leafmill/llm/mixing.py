"""Mixing sources to target weights, in DataFrame operations only.

Words are counted per document and summed per source. The targets follow from the weights by water-filling;
a source's rate is its target over its size, and each document is taken floor(rate) times plus once more if a
hash of its id, seeded, falls below the fraction.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null id hashes as empty
text. Rows that repeat an id draw alike. A source without words has target 0 and its documents are not taken.
An empty table mixes to an empty result. The targets need all sources in order: the rows of a table with one row a
source are sorted in one task, on disk if need be; documents never are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import materialize

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Above so many sources the table of rates isn't broadcast but joined by a shuffle, whose skew Spark splits.
MAX_BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """From (source, size) per document: source, source_size, target per source.

    With caps 2s and weights w, the reshared shares settle where each source has min(2s, level * w). Sources
    reach their cap in the order of s / w; one is capped if the level that holds when all before it are
    capped is not below its own. All sums are of whole numbers, so nothing depends on their order.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy().orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long"))
    by_level = Window.partitionBy().orderBy(F.col("source_size") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    per = per.select(
        "source", "source_size", "w",
        F.sum("source_size").over(all_rows).alias("total"),
        (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("open_w"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("before_size"),
        F.row_number().over(by_level).alias("k"),
    )
    # twice what is left for this source and those after it: 2 * (1.5 * total - 2 * sizes before)
    left = 3 * F.col("total") - 4 * F.col("before_size")
    # as decimals, since products of sizes and weights of very many sources exceed a long
    big = lambda c, n: c.cast(f"decimal({n},0)")
    capped = big(left, 20) * big(F.col("w"), 14) >= big(4 * F.col("source_size"), 20) * big(F.col("open_w"), 14)
    per = per.withColumn("left", left).withColumn("capped", capped)
    first = Window.partitionBy()
    open_k = F.min(F.when(~F.col("capped"), F.col("k"))).over(first)
    per = per.withColumn("open_k", open_k)
    level = F.max(F.when(F.col("k") == F.col("open_k"), F.struct("left", "open_w"))).over(first)
    per = per.withColumn("level", level)
    target = F.when(F.col("open_k").isNull() | (F.col("k") < F.col("open_k")), 2.0 * F.col("source_size")).otherwise(
        (big(F.col("level.left"), 20) * big(F.col("w"), 14)).cast("double") / (2 * F.col("level.open_w")).cast("double")
    )
    return per.select("source", "source_size", target.alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the hash of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def copies(doc_id: Column, target: Column, source_size: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    whole = F.floor(rate).cast("long")
    return whole + F.when(draw(doc_id) < rate - whole, 1).otherwise(0)


def _with_rates(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    rates = materialize(targets(sizes, weights), "rates")
    small = rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    rates = rates.withColumnRenamed("source", "rate_source")
    return sizes.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col("rate_source"))).drop("rate_source")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = _with_rates(sizes, weights)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), F.col("target"), F.col("source_size"))).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with ``copy`` counting from 1 (``mix_copy`` and so on
    where a column has this name)."""
    sizes = materialize(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    rates = materialize(_with_rates(sizes, weights).select(F.col("source").alias("rate_source"), "source_size", "target"), "mix-rates")
    small = rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(F.broadcast(rates) if small else rates, F.col("row.source").eqNullSafe(F.col("rate_source")))
    times = copies(F.col("row.doc_id"), F.col("target"), F.col("source_size")).cast("int")
    out = out.select("row", times.alias("times")).where("times > 0")
    name = "copy"
    while name in docs.columns:
        name = f"mix_{name}"
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("at")).select("row.*", F.col("at").alias(name))


_SIZES = r"""SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {table}"""
_TARGETS = """
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w FROM per),
levels AS (SELECT *, row_number() OVER o AS k, sum(source_size) OVER () AS total, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS open_w,
                  coalesce(sum(source_size) OVER b, 0) AS before_size
           FROM ranked WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST),
                              b AS (ORDER BY CAST(source_size AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (SELECT k, 3 * total - 4 * before_size AS l, open_w FROM levels
           WHERE (3 * total - 4 * before_size) * w < 4 * source_size * open_w ORDER BY k LIMIT 1),
rates AS (SELECT v.source, v.source_size, CASE WHEN o.k IS NULL OR v.k < o.k THEN 2.0::DOUBLE * v.source_size
                 ELSE CAST(o.l * v.w AS DOUBLE) / CAST(2 * o.open_w AS DOUBLE) END AS target
          FROM levels v LEFT JOIN opened o ON true)"""
_TARGETS = _TARGETS.replace(' COLLATE "binary"', "")
_COPIES = """(CASE WHEN source_size > 0 THEN floor(target / source_size) + CASE WHEN
  CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END ELSE 0 END)"""
SQL = f"""WITH sizes AS ({_SIZES.format(table="documents")}), {_TARGETS}
SELECT doc_id, size, source_size, target, CAST(size * {_COPIES} AS BIGINT) AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source"""
