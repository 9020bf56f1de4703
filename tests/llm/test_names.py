"""Columns of the documents may be called as the stages' own."""

from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, langid, ngramjoin, toxicity
from ledgerloom.llm.common import free_name

OWN = ["__llm_text", "__llm_toxicity", "__llm_lang", "__llm_score", "__llm_doc", "_marked", "_gone", "row", "h", "at", "key", "node", "n"]


def _docs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in OWN})


def _kept(frame, docs):
    assert frame.columns == docs.columns
    rows = frame.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in OWN)
    return {r.doc_id for r in rows}


def test_stages_pass_any_column_name_through(spark):
    docs = _docs(spark)
    plain = docs.drop(*OWN)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    for stage in (
        lambda d: toxicity.without_toxic(d, labels), langid.known_language, ngramjoin.one_of_each,
        lambda d: decontaminate.decontaminated(d, benchmark),
    ):
        assert _kept(stage(docs), docs) == {r.doc_id for r in stage(plain).select("doc_id").collect()}


def test_free_names(spark):
    frame = spark.createDataFrame([], "a int, _A int")
    assert free_name(frame, "a") == "__a" and free_name(frame, "b") == "b"
