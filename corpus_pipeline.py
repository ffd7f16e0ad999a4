"""The corpus pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of their input. Nulls, empty texts and repeated
rows are treated as the operators' modules say; no stage fails on an empty table. Stages that use Python workers
bound the bytes of the session's batches, so that memory doesn't follow the texts' lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontam, line_dedup, mixing, simhash, toxicity
from leafmill.llm._io import bound_batches, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 and more go."""
    bound_batches(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sources share stay in one document only; no document goes."""
    return line_dedup.dedup_lines(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    bound_batches(spark)
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that mostly consist of them go."""
    bound_batches(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, numbered by ``copy``."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("simhash_dedup", drop_copies), ("decontamination", drop_leaks), ("mixing", mix_sources)]

#: The toxicity model and the sketches of near duplicates are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
