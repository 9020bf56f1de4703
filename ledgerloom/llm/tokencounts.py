"""Token counts through a digest cache.

The cache is a Parquet folder per tokenizer version with one row per content digest. Documents are
joined to it by digest; of the distinct texts that are not there, each is encoded once, and the new
counts are appended. Copies of a text, and texts of earlier runs, cost a digest and no encoding.

The content that is digested is the text with null read as empty. Nothing else is folded together:
case, white space and Unicode forms all change counts. The version digest covers the tokenizer file
and the version of the library.

Defined results: a null or empty text has 0 tokens and 0 bytes. Repeated rows get one result each;
other columns are ignored, whatever their names. An empty table gives no rows and appends nothing. A
digest that two concurrent runs appended counts once.

The counts are those of the ``tokenizers`` library for the ``.json`` file. Where the same vocabulary is
also given as ranks, texts of Latin letters without very long words go through ``tiktoken``, which gives
the same numbers at a fifth of the time (``tests/llm`` compares both); the rest goes through ``tokenizers``.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.llm.common import slices, strings
from ledgerloom.session import scratch_folder

CACHE_KEY = "spark.ledgerloom.tokenCountCache"  # folder of a lasting cache; unset: one for the run
OVER = 512
# What the fast way takes: code points below U+0250 and no run of this many letters or blanks.
SLOW_TEXT = re.compile(r"[^\x00-ɏ]|\S{2000}|\s{2000}")


def version_digest(path: str) -> str:
    import tokenizers

    digest = hashlib.sha256(tokenizers.__version__.encode())
    with open(path, "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _ranked(path: str, specials: tuple[tuple[str, int], ...]):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
        special_tokens=dict(specials),
    )


def count_texts(texts: list[str], path: str, ranks: str | None = None) -> list[int]:
    tokenizer = _tokenizer(path)
    if ranks is None:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    specials = tuple(
        sorted((t.content, i) for i, t in tokenizer.get_added_tokens_decoder().items())
    )
    fast = _ranked(ranks, specials)
    return [
        len(tokenizer.encode(t, add_special_tokens=False)) if SLOW_TEXT.search(t)
        else len(fast.encode(t, allowed_special="all"))
        for t in texts
    ]


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.exists(target)


def cached_counts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per digest that the cache holds."""
    schema = "digest binary, n_tokens bigint"
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder).groupBy("digest").agg(
        F.max("n_tokens").alias("n_tokens")
    )


def cache_folder(spark: SparkSession) -> str:
    """The lasting cache the session names, or a new one that goes with the application."""
    return spark.conf.get(CACHE_KEY, None) or scratch_folder(spark, "llm-token-counts")


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"),
    )


def fill_cache(docs: DataFrame, folder: str, path: str, ranks: str | None = None) -> None:
    """Count the distinct texts that ``folder`` lacks and append them."""
    spark = docs.sparkSession
    # Combined before the shuffle: a text that fills a third of the table is sent once per task.
    distinct = _digested(docs).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(cached_counts(spark, folder), "digest", "left_anti")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in slices(part, 256):
                counts = count_texts(strings(batch, "text"), path, ranks)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
                )

    misses.select("digest", "text").mapInArrow(count, "digest binary, n_tokens bigint").write.mode(
        "append"
    ).parquet(folder)


def token_counts(
    docs: DataFrame, path: str, ranks: str | None = None, cache: str | None = None, over: int = OVER
) -> DataFrame:
    """Bytes and tokens of every text."""
    spark = docs.sparkSession
    folder = f"{cache or cache_folder(spark)}/version={version_digest(path)}"
    fill_cache(docs, folder, path, ranks)
    counts = cached_counts(spark, folder)
    return (
        _digested(docs)
        .drop("text")
        .join(counts, "digest", "left")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
    )
