"""The pipeline on the smallest tables, stage by stage."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafmill.llm import decontam, mixing
from leafmill.llm._io import BATCH_BYTES, bound_batches, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "mixing"]
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
        if i == 3:
            assert decontam.report(docs, table(spark, SF, "benchmark")).where("contaminated").count() == 0
            mixed = mixing.mix_report(docs).agg({"taken": "sum"}).first()[0]
    assert counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    assert docs.select(mixing.word_count(docs["text"]).alias("n")).agg({"n": "sum"}).first()[0] == mixed


_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.mark.parametrize("name", ["toxicity", "simhash_dedup", "decontamination"])
def test_python_workers_get_batches_of_bounded_bytes(spark, name):
    spark.conf.unset(_BOUND)
    dict(corpus_pipeline.STAGES)[name](spark, table(spark, SF, "documents").limit(20), SF)
    long = F.when(F.col("id") == 5, F.repeat(F.lit("x"), F.lit(2 * BATCH_BYTES))).otherwise(F.repeat(F.lit("y"), F.lit(20_000)))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes]), pa.array([sum(len(t.as_py()) for t in batch.column(0))])], names=["n", "size", "chars"])

    got = spark.range(0, 2000, 1, 1).select(long.alias("text")).mapInArrow(sizes, "n long, size long, chars long").collect()
    assert sum(r["n"] for r in got) == 2000 and sum(r["chars"] for r in got) == 1999 * 20_000 + 2 * BATCH_BYTES
    assert max(r["size"] for r in got if r["chars"] < 2 * BATCH_BYTES) < BATCH_BYTES + 50_000
    assert max(r["size"] for r in got) < 3 * BATCH_BYTES + 50_000


@pytest.mark.parametrize(("held", "then"), [("1m", "1m"), ("64m", str(BATCH_BYTES))])
def test_a_lower_bound_stays(spark, held, then):
    try:
        spark.conf.set(_BOUND, held)
        bound_batches(spark)
        assert spark.conf.get(_BOUND) == then
    finally:
        spark.conf.unset(_BOUND)
