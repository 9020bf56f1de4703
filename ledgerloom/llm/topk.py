"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into ``BLOCKS`` blocks of successive components. A node holds one block of a group of
candidates; its list for a query holds partial scores, and the score of a candidate is the sum of its
partial scores over the blocks.

1. Every node sends the ``k`` best entries of its list. The best ``k`` of each block are scored exactly;
   the k-th best of these scores is a cutoff that no result can lie below.
2. A sum that reaches the cutoff has at least one of ``BLOCKS`` summands that reaches the cutoff divided
   by ``BLOCKS``. That uniform threshold goes to all nodes, and they send every entry that reaches it.
3. The entries' candidates are scored exactly and ranked.

Queries and candidates meet in cells of a bounded number of queries and candidates. Of equal vectors
only the ``k + 1`` with the smallest ids can be among the best ``k`` of a query, so only these enter.

Components are floor(1024 * x); sums are exact. Defined results: null vectors, vectors holding null or a
non-finite component, and rows with a null vec_id take no part. Shorter vectors count as padded with
zeros. Repeated rows count once; rows with the query's own vec_id are no candidates for it. Ties go to
the smaller vec_id. A score beyond 64 bits is cut to the largest such number. Fewer candidates than ``k``
are all returned. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import stored

K = 10
EVERY = 100  # queries are the rows with an id divisible by this
SCALE = 1024
BLOCKS = 2
CELL_CANDIDATES = 8192
CELL_QUERIES = 1024
EXACT = 2.0**53
LARGEST = 2**63 - 1
PAIRS = 65536  # pairs scored at a time


def _whole(vectors: list) -> np.ndarray:
    """Scaled components, padded to one length."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for row, v in enumerate(vectors):
        out[row, : len(v)] = v
    return np.floor(SCALE * out)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, width)
    if most < EXACT:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return whole(a).reshape(a.shape) @ whole(b).reshape(b.shape).T


def _long(scores) -> list[int]:
    return [max(-LARGEST - 1, min(LARGEST, int(s))) for s in scores]


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` and a ``row`` number of the usable vectors, repeated rows once."""
    infinite = float("inf")
    usable = F.forall(
        "v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < F.lit(infinite)) & (x > F.lit(-infinite))
    )
    return (
        embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & usable)
        .distinct()
        .withColumn("row", F.xxhash64("vec_id", "v"))
    )


_ENTRY = {"query": "int64", "candidate": "int64"}
_SCORE = {"query": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64"}


def _table(kinds: dict[str, str], parts: list[pd.DataFrame]) -> pd.DataFrame:
    if parts:
        return pd.concat(parts)
    return pd.DataFrame({name: pd.Series([], dtype=kind) for name, kind in kinds.items()})


class _Cells:
    """Queries and candidates, dealt to cells by their row numbers; a cell sees all pairs of its own."""

    def __init__(self, queries: DataFrame, candidates: DataFrame, blocks: int) -> None:
        told = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
        self.blocks = blocks
        self.width = max(1, -(-(told["width"] or 1) // blocks))
        self.groups = max(1, -(-told["n"] // CELL_CANDIDATES))
        self.batches = max(1, -(-queries.count() // CELL_QUERIES))
        self.queries, self.candidates = queries, candidates

    # Both sides of a cell must have the same types: equal numbers of other types hash differently.
    def _group(self, row):
        return F.pmod(F.xxhash64(row), F.lit(self.groups)).cast("int").alias("group")

    def _batch(self, row):
        return F.pmod(F.xxhash64(row), F.lit(self.batches)).cast("int").alias("batch")

    def _asked(self, queries: DataFrame) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("group")
        return queries.select("*", self._batch("row")).select("*", every)

    def _held(self) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(self.batches - 1))).alias("batch")
        return self.candidates.select("*", self._group("row")).select("*", every)

    def _blocks(self, rows: DataFrame) -> DataFrame:
        block = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block")
        rows = rows.select("*", block)
        return rows.withColumn("v", F.slice("v", F.col("block") * self.width + 1, self.width))

    def lists(self, queries: DataFrame, k: int | None) -> DataFrame:
        """Entries of the nodes' lists, a node being a block of a cell: the best ``k`` with their
        partial scores, or all that reach the query's threshold."""
        blocks = self.blocks

        def entries(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(asked) and len(held):
                ids, rows = held["vec_id"].to_numpy(), held["row"].to_numpy()
                scores = _products(_whole(list(asked["v"])), _whole(list(held["v"])))
                for at, (query, query_id) in enumerate(zip(asked["row"], asked["vec_id"])):
                    line, other = scores[at], ids != query_id
                    if k is None:
                        cutoff = asked["cutoff"].iloc[at]
                        if cutoff is not None and not np.isnan(cutoff):
                            # Doubles may have rounded the cutoff of very large scores.
                            other &= (line * blocks >= cutoff - abs(cutoff) * 1e-12).astype(bool)
                        best = np.flatnonzero(other)
                    else:
                        best = np.flatnonzero(other)
                        best = best[np.argsort(-line[best], kind="stable")[:k]]
                    if best.size:
                        found.append(pd.DataFrame({"query": query, "candidate": rows[best]}))
                        if k is not None:
                            found[-1]["block"] = key[2]
                            found[-1]["partial"] = line[best].astype(np.float64)
            kinds = _ENTRY if k is None else _ENTRY | {"block": "int32", "partial": "float64"}
            return _table(kinds, found)

        node = ["group", "batch", "block"]
        schema = "query bigint, candidate bigint" + ("" if k is None else ", block int, partial double")
        return (
            self._blocks(self._asked(queries)).groupBy(*node)
            .cogroup(self._blocks(self._held()).groupBy(*node))
            .applyInPandas(entries, schema)
        )

    def scored(self, pairs: DataFrame) -> DataFrame:
        """The exact score of each pair of row numbers, worked out in the cell that has both."""

        def resolve(pairs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(pairs):
                asked, held = own[own["asked"]], own[~own["asked"]]
                asked, held = asked.sort_values("row"), held.sort_values("row")
                left, right = _whole(list(asked["v"])), _whole(list(held["v"]))
                width = min(left.shape[1], right.shape[1])
                left, right = left[:, :width], right[:, :width]
                exact = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, width) < EXACT
                i = np.searchsorted(asked["row"].to_numpy(), pairs["query"].to_numpy())
                j = np.searchsorted(held["row"].to_numpy(), pairs["candidate"].to_numpy())
                for a in range(0, i.size, PAIRS):
                    one, two = left[i[a : a + PAIRS]], right[j[a : a + PAIRS]]
                    if exact:
                        scores = np.einsum("ij,ij->i", one, two).astype(np.int64)
                    else:
                        scores = np.array(_long(
                            sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(one, two)), np.int64)
                    found.append(pd.DataFrame({
                        "query": pairs["query"].to_numpy()[a : a + PAIRS],
                        "query_id": asked["vec_id"].to_numpy()[i[a : a + PAIRS]],
                        "vec_id": held["vec_id"].to_numpy()[j[a : a + PAIRS]],
                        "score": scores,
                    }))
            return _table(_SCORE, found)

        cell = ["group", "batch"]
        columns = ["group", "batch", "row", "vec_id", "v"]
        own = self._asked(self.queries).select(*columns, F.lit(True).alias("asked")).union(
            self._held().select(*columns, F.lit(False).alias("asked"))
        )
        return (
            pairs.select("query", "candidate", self._group("candidate"), self._batch("query"))
            .groupBy(*cell)
            .cogroup(own.groupBy(*cell))
            .applyInPandas(resolve, "query bigint, query_id bigint, vec_id bigint, score bigint")
        )


def top_products(
    embeddings: DataFrame, k: int = K, every: int = EVERY, blocks: int = BLOCKS
) -> DataFrame:
    """The ``k`` candidates with the largest inner products for every query, ranked."""
    vectors = stored(valid_vectors(embeddings), "topk-vectors")
    queries = vectors.where(F.col("vec_id") % every == 0)
    # Spark cuts each task's rows to k + 1 per vector before the shuffle.
    same = Window.partitionBy("v").orderBy("vec_id")
    candidates = stored(
        vectors.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n"),
        "topk-candidates",
    )
    cells = _Cells(queries, candidates, blocks)

    best = Window.partitionBy("query", "block").orderBy(F.desc("partial"), "candidate")
    gathered = (
        cells.lists(queries, k)
        .withColumn("_n", F.row_number().over(best))
        .where(F.col("_n") <= k)
        .select("query", "candidate")
        .distinct()
    )
    # A vec_id with several vectors is one candidate.
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    cutoffs = (
        cells.scored(gathered)
        .groupBy("query", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("_n", F.row_number().over(ranked))
        .where(F.col("_n") == k)
        .select("query", F.col("score").cast("double").alias("cutoff"))
    )
    asked = queries.join(cutoffs, F.col("row") == F.col("query"), "left").drop("query")
    sufficient = cells.lists(stored(asked, "topk-cutoffs"), None).distinct()
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        cells.scored(sufficient)
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
