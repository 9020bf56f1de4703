"""Benchmark decontamination by spaced seeds.

A window is ``SPAN`` successive tokens. Its positions fall into four interleaved groups, position i into
group i modulo 4; each of the six masks keeps two groups and ignores the others. Every window of the
benchmark is hashed under each mask, and so is every window of a document. Where two hashes meet, all
positions of the two windows are compared, and at most ``SUBSTITUTED`` may differ. Two differing
positions lie in at most two groups, so a mask that ignores both exists: no overlap within the
tolerance is missed.

An item of fewer than ``SPAN`` tokens is one window of its own length, and overlaps where all its tokens
stand in a document. It takes part if it has at least ``SHORTEST_TOKENS`` tokens, or at least
``SHORTEST_LETTERS`` letters and digits, as items in scripts without blanks do; what is shorter than
both cannot be told from common phrases.

Tokens are runs of letters and digits in lower case.

Defined results: a null or empty text is clean, and so is one shorter than every item that takes part. Without
items every document is clean. Rows that share a doc_id share one verdict: one that overlaps marks all.
Repeated items report every item id. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import free_name

SPAN = 12
GROUPS = 4
SUBSTITUTED = 2
SHORTEST_TOKENS, SHORTEST_LETTERS = 6, 24  # items below both take no part
MASKS = list(combinations(range(GROUPS), GROUPS - SUBSTITUTED))
BROADCAST_WINDOWS = 100_000  # more windows than this are joined by a shuffle


def tokens(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_remove(words, "")


def _hashed(rows: DataFrame, key: str) -> DataFrame:
    """Rows of ``key`` and the hashes of the tokens."""
    return rows.select(key, F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))


def _windows(hashed: DataFrame) -> DataFrame:
    """A row per window, with its first position as ``at``."""
    last = F.size("h") - SPAN
    places = F.when(last >= 0, F.sequence(F.lit(0), last))
    return hashed.select("*", F.explode(places).alias("at"))


def _seeds(token) -> Column:
    """The hash of a window under each mask; ``token(i)`` is its i-th token."""
    kept = [[i for i in range(SPAN) if i % GROUPS in mask] for mask in MASKS]
    return F.array(*[F.xxhash64(F.lit(n), *[token(i) for i in places]) for n, places in enumerate(kept)])


def _short_items(benchmark: DataFrame) -> DataFrame:
    """The items of fewer than ``SPAN`` tokens that take part, each as one window."""
    n, letters = F.size("words"), F.length(F.concat_ws("", "words"))
    return (
        benchmark.select("item_id", tokens(F.col("text")).alias("words"))
        .where((n > 0) & (n < SPAN) & ((n >= SHORTEST_TOKENS) | (letters >= SHORTEST_LETTERS)))
        .select("item_id", F.transform("words", lambda t: F.xxhash64(t)).alias("item_tokens"))
    )


def _exact(docs: DataFrame, short: DataFrame, lengths: list[int]) -> DataFrame:
    """The places in documents where all tokens of a short item stand; there are fewer than ``SPAN`` lengths."""
    wanted = short.select("item_tokens").distinct().withColumn("hash", F.xxhash64("item_tokens"))
    if wanted.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    return (
        _hashed(docs, "doc_id")
        .select("doc_id", "h", F.explode(F.array(*[F.lit(n) for n in lengths])).alias("n"))
        .where(F.size("h") >= F.col("n"))
        .select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("n"))).alias("at"))
        .select("doc_id", "at", F.slice("h", F.col("at") + 1, F.col("n")).alias("doc_tokens"))
        .withColumn("hash", F.xxhash64("doc_tokens"))
        .join(wanted, "hash")
        .where(F.col("doc_tokens") == F.col("item_tokens"))
        .select("doc_id", "at", "item_tokens")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id`` and the number of windows of the document that overlap the item.

    The benchmark side is broadcast if it has at most ``BROADCAST_WINDOWS`` windows, else shuffled.
    """
    items = _windows(_hashed(benchmark, "item_id")).select(
        "item_id", F.slice("h", F.col("at") + 1, SPAN).alias("item_tokens")
    )
    # Windows that several items share, or that an item repeats, are compared once.
    distinct = items.select("item_tokens").distinct()
    short = _short_items(benchmark)
    lengths = sorted(r["n"] for r in short.select(F.size("item_tokens").alias("n")).distinct().collect())
    owners = items.union(short) if lengths else items
    owners = owners.select(F.xxhash64("item_tokens").alias("window"), "item_id").distinct()
    seeds = distinct.select(
        "item_tokens", F.explode(_seeds(lambda i: F.col("item_tokens")[i])).alias("hash")
    )
    probes = _windows(_hashed(docs, "doc_id")).select(
        "doc_id", "h", "at", F.explode(_seeds(lambda i: F.col("h")[F.col("at") + i])).alias("hash")
    )
    if distinct.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        # All probing happens in one generated loop over a document; only hits leave it.
        probes = probes.join(F.broadcast(seeds.select("hash").distinct()), "hash", "left_semi")
        seeds = F.broadcast(seeds)
    probes = probes.select(
        "doc_id", "at", "hash", F.slice("h", F.col("at") + 1, SPAN).alias("doc_tokens")
    )
    same = F.size(F.filter(F.zip_with("doc_tokens", "item_tokens", lambda a, b: a == b), lambda x: x))
    met = probes.join(seeds, "hash").where(same >= SPAN - SUBSTITUTED).select("doc_id", "at", "item_tokens")
    if lengths:
        met = met.union(_exact(docs, short, lengths))
    found = (
        # A window that meets under several masks counts once.
        met.groupBy("doc_id", "at", F.xxhash64("item_tokens").alias("window"))
        .agg(F.lit(1).alias("n"))
        .groupBy("doc_id", "window")
        .agg(F.sum("n").alias("n"))
    )
    return (
        found.join(owners, "window")
        .groupBy("doc_id", "item_id")
        .agg(F.sum("n").alias("n_windows"))
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every document whether it overlaps the benchmark, and with which items."""
    by_doc = (
        overlaps(docs, benchmark)
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(
            F.count("*").alias("n_items"),
            F.sum("n_windows").alias("n_windows"),
            # At most one entry per item of the benchmark and per window of the document.
            F.concat_ws(",", F.sort_array(F.collect_list("item_id"))).alias("item_ids"),
        )
    )
    return (
        docs.select("doc_id")
        .join(by_doc, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
        .select(
            "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
            F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("n_windows", F.lit(0)).cast("bigint").alias("n_windows"),
            F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        )
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no item; columns as they came."""
    name = free_name(docs, "_marked")
    marked = overlaps(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(marked, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
