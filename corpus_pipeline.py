"""A corpus in five stages: no toxic texts, known languages only, one copy of each text, no benchmark, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table. All but the last return the columns of
``documents``. ``run`` writes the result of each stage as Parquet to the shared folder and reads it
again as the next one's input, so a lost executor never costs more than a stage.

Defined results: an empty table passes every stage empty. Rows with a null text pass the first stage and go in the second.
Extra columns pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontaminate, langid, ngramjoin, toxicity
from ledgerloom.llm.common import stored, table
from ledgerloom.session import prepare

NEAR_WORDS, NEAR_LEAST = 5, 80  # near copies: shingles of so many words, percent of them shared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.one_of_each(docs, NEAR_WORDS, NEAR_LEAST)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# Two stages learn a model, which SQL cannot express; tests/llm holds the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
