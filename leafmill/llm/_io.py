"""Reading tables, cutting lineage, and text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most bytes of rows that bound_batches() lets go to a Python worker at once.
BATCH_BYTES = 4 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one on a single machine (tests); executors
    of a cluster would not share it, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there, and a lost
    executor costs nothing that was written before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leafmill-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._leafmill_path = path
    return out


def release(*frames: DataFrame | None) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_leafmill_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of rounds that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python workers in batches of at most BATCH_BYTES (a longer row is a batch of its
    own). Spark's own bounds are 10,000 rows and 64 MB, which the JVM, the worker and what the worker returns hold at once,
    in every task. A lower setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m
