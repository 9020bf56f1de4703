"""How five filters of a corpus interact: what each removes in every order, alone, or after others.

The filters: A few words, B few distinct words, C many capitals, D symbols, E a text that a smaller doc_id has too.

E is an existential self-join: every document is a left-semi match on hash, exact text and smaller doc_id. Its right side
is one row per distinct text with its smallest doc_id, combined before the shuffle. A text of very many copies is
no hot group: the hashes that hold more than ``1 / HOT_HASHES`` of the table (and more than ``SALT_ROWS`` rows) are
fewer than ``HOT_HASHES``, so they are broadcast; their rows are dealt over as many salts as they need, and their
right row goes to each of them. Hashes that only one row has need no partner; where the others are few enough to broadcast
(``KNOWN_HASHES``), single texts are not shuffled, and beyond that the semi-join itself drops them.

The ids that E marks are united with the ids that fail the other filters, and one group-by makes a combination of
five bits of them. What follows are counts of at most 32 combinations per part: an order keeps what fails nothing
up to its step, so every figure is a sum over combinations. For the Shapley column no order is walked: among the m
filters that a document fails, each comes first in 120 / m orders.

Defined results: a null text is empty, fails A only (and E, after another empty one). A null doc_id is smaller than none and
has no smaller one, so its row never fails E, makes no other fail, and has no label. Rows that share a doc_id and a text
do not make each other fail and count once each. Several labels of a doc_id count as the best quality and as toxic if any says so. A null
lang is the part ''. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import stored

FILTERS = "ABCDE"
# The limits of the filters.
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"

HOT_HASHES = 100_000  # hashes that may be told apart as hot; 24 bytes each when broadcast
SALT_ROWS = 1_000  # rows of a hot hash per salt, at least
KNOWN_HASHES = 1 << 20  # hashes of several rows that are broadcast; 16 MB


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_failures(text: Column) -> Column:
    """The bits of A to D, which need the text alone."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * capitals.cast("bigint") > CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    bits = F.lit(0)
    for letter, failed in fails.items():
        bits = bits + F.when(failed, _bit(letter)).otherwise(0)
    return bits


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("hash"), part.alias("part"), text.alias("text"))


def repeats(docs: DataFrame, hot_rows: int = SALT_ROWS, known: int = KNOWN_HASHES) -> DataFrame:
    """``doc_id``, ``hash`` and ``part`` of every row whose text a smaller doc_id has too."""
    texts = _texts(docs.where("doc_id is not null"))
    counts = stored(
        texts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "repeat-hashes"
    )
    # A sum over repeated hashes only; the bound on hot ones holds for any part of the table.
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    share = max(hot_rows, -(-total // HOT_HASHES))
    hot = F.broadcast(
        counts.where(F.col("n") > share)
        .select("hash", F.expr(f"(n + {share} - 1) div {share}").alias("salts"))
    )
    if counts.count() <= known:
        texts = texts.join(F.broadcast(counts.select("hash")), "hash", "left_semi")
    salts = F.coalesce("salts", F.lit(1).cast("bigint"))
    one = (
        texts.join(hot, "hash", "left")
        .select("doc_id", "hash", "part", "text", F.pmod(F.xxhash64("doc_id"), salts).alias("salt"))
    )
    other = (
        texts.groupBy("hash", "text")
        .agg(F.min("doc_id").alias("first"))
        .join(hot, "hash", "left")
        .select("hash", "text", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("salt"))
    )
    met = (
        (one["hash"] == other["hash"]) & (one["salt"] == other["salt"]) & (one["text"] == other["text"])
        & (other["first"] < one["doc_id"])
    )
    return one.join(other, met, "left_semi").select("doc_id", "hash", "part")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``bits`` of the filters failed, and how many documents, good ones and toxic ones fail just these."""
    rows = _texts(docs).select("doc_id", "hash", "part", text_failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    repeated = repeats(docs).distinct().select("*", F.lit(_bit("E")).alias("bits"), F.lit(0).alias("n"))
    # Rows of one id, text and part are one line; each counts, and each fails what the others fail.
    marked = (
        rows.union(repeated)
        .groupBy("doc_id", "hash", "part")
        .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    )
    judged = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    return (
        marked.join(judged, "doc_id", "left")
        .groupBy("part", "bits")
        .agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("good") == 1, F.col("n"))), F.lit(0)).alias("good"),
            F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("toxic"),
        )
    )


def _steps() -> Column:
    """Every order and step, with the bit of its filter and those of the filters before it, as an array."""
    steps = []
    for order in permutations(FILTERS):
        earlier = 0
        for place, letter in enumerate(order):
            steps.append((("".join(order)), place + 1, _bit(letter), earlier))
            earlier |= _bit(letter)
    rows = ", ".join(f"('{order}', {step}, {bit}, {earlier})" for order, step, bit, earlier in steps)
    fields = "array<struct<filter_order:string,step:int,bit:int,earlier:int>>"
    return F.expr(f"cast(array({rows}) as {fields})")


def interactions(found: DataFrame) -> DataFrame:
    """The figures of every part, order and step from a table of ``combinations``."""
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    gone = F.col("bits").bitwiseAND(F.col("earlier")) != 0
    orders = 120  # of five filters

    def count(condition: Column, value: Column = F.col("n")) -> Column:
        return F.sum(F.when(condition, value).otherwise(0)).cast("bigint")

    return (
        found.select("*", F.inline(_steps()))
        .groupBy("part", "filter_order", "step")
        .agg(
            count(~fails & ~gone).alias("kept"),
            count(fails & ~gone).alias("removed"),
            count(fails & gone).alias("redundant"),
            count(F.col("bits") == F.col("bit")).alias("unique_fails"),
            count(fails & ~gone, F.col("good")).alias("good_lost"),
            count(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
            count(fails, F.expr(f"n * ({orders} div greatest(bit_count(bits), 1))")).alias("shapley"),
        )
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(combinations(docs, labels))
