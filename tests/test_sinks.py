"""Files written by the executors."""

import pytest
from pyspark.sql import functions as F

from leafmill.sources import documents, sinks, writers


def test_documents_and_texts_as_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One\nline"), (2, "Zwei ä"), (3, None)], "doc_id long, text string")
    made = writers.from_text(docs)
    saved = sinks.save(made, f"file://{tmp_path}/out", sinks.safe_name(F.col("doc_id"), F.lit("a/b.pdf")), F.col("content")).collect()
    assert sorted(r["path"] for r in saved) == [f"{tmp_path}/out/{i}_a_b.pdf" for i in (1, 2, 3)]
    back = documents.load(documents.read_binary(spark, f"{tmp_path}/out"), "page_text")
    assert sorted(r["text"] for r in back.collect()) == ["", "One\nline", "Zwei ä"]
    sinks.save_text(docs, f"{tmp_path}/t", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), "utf-16", preamble=True).collect()
    assert (tmp_path / "t" / "2.txt").read_bytes() == b"\xff\xfe" + "Zwei ä".encode("utf-16-le") and (tmp_path / "t" / "3.txt").read_bytes() == b"\xff\xfe"
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith(".")]
    sinks.save(docs, str(tmp_path / "t"), F.lit("same"), F.col("text")).collect()
    assert (tmp_path / "t" / "same").exists()


def test_names_that_are_no_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for name in ("../x", "", ".."):
        with pytest.raises(Exception, match="not a file name"):
            sinks.save(docs, str(tmp_path), F.lit(name), F.col("text")).collect()
    with pytest.raises(ValueError):
        sinks.save(docs, "s3://bucket/x", F.lit("a"), F.col("text"))
