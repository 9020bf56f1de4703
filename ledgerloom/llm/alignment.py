"""Alignment of two tokenizers' tokens of one text by merge paths.

Both tokenizers cut the same bytes, a space and the text. The ends of the A tokens and of the B tokens are two
sorted lists; merging them gives every pair of tokens that overlap (one at each distinct end) and, where both
lists hold an end, the border of a group. The texts of a batch are laid end to end, so a batch is one merge. Diagonals
of ``WORK`` steps each cross its merge path at one place, which a binary search finds for all diagonals at
once; between two crossings lies a piece of equal work that needs nothing from the others. A piece emits its
overlaps and the borders it sees. An end in A and B that a diagonal parts is seen by the first piece only, and a group
that reaches over pieces is stitched from the borders on either side of it.

How many documents hold an id pair linked is counted by Spark over the stored pairs of all documents. The pairs that most
documents hold, ``KEPT_PAIRS`` at most, are broadcast and looked up in place; every other pair is joined, and as it
is in fewer documents than those, it is no hot key. Results do not depend on how many are kept.

Defined results: a null or empty text, and one whose tokens do not spell a space and the text in either tokenizer (a text
with U+2581, say), has no tokens. Repeated rows get one result each and count once each. A null doc_id is
aligned as any other. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from ledgerloom.llm.common import stored
from ledgerloom.llm.tokencounts import SLOW_TEXT

WORK = 1 << 16  # steps of the merge path per piece
BATCH_BYTES = 1 << 21  # bytes of text aligned at a time; a longer text is alone
KEPT_PAIRS = 1 << 21  # pairs whose counts are broadcast, 17 bytes each
BORDER = "▁"  # the sign of the piece vocabulary for a space


# --- tokens -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Files:
    """``a``: a byte-level vocabulary (.json), ``a_ranks``: the same as ranks, ``b``: a piece model."""

    a: str
    a_ranks: str
    b: str


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    table = {chr(b): b for b in own}
    for place, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + place)] = b
    return table


class Encoders:
    """The two tokenizers, and the bytes of each of their tokens."""

    def __init__(self, files: Files) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(files.a)
        self._exact.no_truncation()
        self._exact.no_padding()
        self._exact.encode_special_tokens = True
        with open(files.a_ranks, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._fast = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        with open(files.a, encoding="utf-8") as file:
            said = json.load(file)
        byte_of = _byte_of_letter()
        self.a_bytes = [b""] * self._exact.get_vocab_size(with_added_tokens=True)
        for token, i in said["model"]["vocab"].items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.b_bytes = [self._piece_bytes(i) for i in range(self._pieces.get_piece_size())]
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.digits, self.n_digits = _decimal(max(len(self.a_bytes), len(self.b_bytes)))

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._pieces.id_to_piece(i)
        if self._pieces.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BORDER, " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and of B; none where the tokens of either do not spell the text."""
        a, b = [], []
        a_bytes, b_bytes = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for text, pieces in zip(texts, self._pieces.encode(texts, num_threads=1)):
            said = " " + text
            if SLOW_TEXT.search(said):
                ids = self._exact.encode(said, add_special_tokens=False).ids
            else:
                ids = self._fast.encode_ordinary(said)
            whole = said.encode()
            if not text or b"".join(map(a_bytes, ids)) != whole or b"".join(map(b_bytes, pieces)) != whole:
                ids, pieces = [], []
            a.append(ids)
            b.append(pieces)
        return a, b


@lru_cache(maxsize=1)
def encoders(files: Files) -> Encoders:
    return Encoders(files)


# --- merge paths --------------------------------------------------------------------------


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many entries of ``a`` are among the first d of the merge, for each d; of equal ones ``a`` is first."""
    low, high = np.maximum(0, diagonals - b.size), np.minimum(diagonals, a.size)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low[open_] + high[open_]) // 2
        up = a[middle] <= b[diagonals[open_] - middle - 1]
        low[open_] = np.where(up, middle + 1, low[open_])
        high[open_] = np.where(up, high[open_], middle)


def piece(a: np.ndarray, b: np.ndarray, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The overlaps of the merge between two crossings, as places in ``a`` and ``b``, and which of them end both."""
    own_a, own_b = a[i], b[j]
    if own_b.size and i.start and a[i.start - 1] == own_b[0]:
        j = slice(j.start + 1, j.stop)  # the piece before has seen this end in ``a``
        own_b = own_b[1:]
    ends = np.concatenate((own_a, own_b))
    ends.sort(kind="stable")
    first = np.ones(ends.size, bool)
    np.not_equal(ends[1:], ends[:-1], out=first[1:])
    ends = ends[first]
    of_a = i.start + np.searchsorted(own_a, ends)
    of_b = j.start + np.searchsorted(own_b, ends)
    return of_a, of_b, (a[of_a] == ends) & (b[of_b] == ends)


def merged(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two lists of ends with the same last end, in order, and the borders of the groups as
    counts of tokens before them."""
    total = a.size + b.size
    diagonals = np.append(np.arange(0, total, work), total)
    at_a = crossings(a, b, diagonals)
    at_b = diagonals - at_a
    pieces = [
        piece(a, b, slice(*map(int, at_a[n : n + 2])), slice(*map(int, at_b[n : n + 2])))
        for n in range(diagonals.size - 1)
    ]
    if not pieces:
        none = np.empty(0, np.int64)
        return none, none, none, none
    of_a, of_b, border = (np.concatenate(x) for x in zip(*pieces))
    return of_a, of_b, of_a[border] + 1, of_b[border] + 1


# --- documents ----------------------------------------------------------------------------


@dataclass
class Aligned:
    """A batch of texts. ``*_starts`` hold, for each text and the end, the first of its tokens, links or groups."""

    a: np.ndarray
    b: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_starts: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    group_starts: np.ndarray


def _starts(lists: list[list[int]]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)


def align_texts(coder: Encoders, texts: list[str], work: int = WORK) -> Aligned:
    a_lists, b_lists = coder.encode(texts)
    a_starts, b_starts = _starts(a_lists), _starts(b_lists)
    a = np.fromiter(chain.from_iterable(a_lists), np.int64, int(a_starts[-1]))
    b = np.fromiter(chain.from_iterable(b_lists), np.int64, int(b_starts[-1]))
    # Texts end in both lists at once, so no overlap reaches over two of them.
    link_a, link_b, a_cuts, b_cuts = merged(np.cumsum(coder.a_length[a]), np.cumsum(coder.b_length[b]), work)
    return Aligned(
        a, b, a_starts, b_starts, link_a, link_b, np.searchsorted(link_a, a_starts), a_cuts, b_cuts,
        np.searchsorted(a_cuts, a_starts, side="right"),
    )


def _decimal(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``size``, a row each, and how many there are."""
    texts = [str(i).encode() for i in range(size)]
    width = len(texts[-1])
    table = np.frombuffer(b"".join(t.ljust(width) for t in texts), np.uint8).reshape(size, width)
    return table, np.array([len(t) for t in texts], np.int64)


def spelled(coder: Encoders, found: Aligned) -> list[bytes]:
    """For each text its groups as ``a1,a2|b1;a3|b2,b3``."""
    a_before, b_before = (np.concatenate(([0], x))[:-1] for x in (found.a_cuts, found.b_cuts))
    n = found.a.size + found.b.size
    ids = np.empty(n, np.int64)
    # In a group the A tokens come first.
    ids[np.arange(found.a.size) + np.repeat(b_before, found.a_cuts - a_before)] = found.a
    ids[np.arange(found.b.size) + np.repeat(found.a_cuts, found.b_cuts - b_before)] = found.b
    marks = np.full(n, ord(","), np.uint8)
    marks[found.a_cuts + b_before - 1] = ord("|")
    marks[found.a_cuts + found.b_cuts - 1] = ord(";")
    sizes = coder.n_digits[ids]
    ends = np.cumsum(sizes + 1)
    text = np.empty(int(ends[-1]) if n else 0, np.uint8)
    text[ends - 1] = marks
    begins = ends - 1 - sizes
    for place in range(coder.digits.shape[1]):
        has = sizes > place
        text[begins[has] + place] = coder.digits[ids[has], place]
    whole = text.tobytes()
    starts = np.concatenate(([0], ends))[found.a_starts + found.b_starts]
    return [whole[s : max(s, e - 1)] for s, e in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _by_bytes(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows with about ``BATCH_BYTES`` of text."""
    texts = [t or "" for t in batch.column("text").to_pylist()]
    start = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > BATCH_BYTES:
            yield batch.slice(start, at - start), texts[start:at]
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield batch.slice(start), texts[start:]


def _lists(starts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def align(docs: DataFrame, files: Files) -> DataFrame:
    """``a_ids`` and ``b_ids`` of every text, and for each group the end of its tokens in either list: ``a_cuts``, ``b_cuts``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoders(files)
        for part in parts:
            for batch, texts in _by_bytes(part):
                found = align_texts(coder, texts)
                groups = np.diff(found.group_starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), _lists(found.a_starts, found.a, pa.int32()),
                        _lists(found.b_starts, found.b, pa.int32()),
                        _lists(found.group_starts, found.a_cuts - np.repeat(found.a_starts[:-1], groups), pa.int32()),
                        _lists(found.group_starts, found.b_cuts - np.repeat(found.b_starts[:-1], groups), pa.int32()),
                    ],
                    names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"],
                )

    rows = docs.select("doc_id", "text")
    schema = rows.drop("text").schema
    for name in ("a_ids", "b_ids", "a_cuts", "b_cuts"):
        schema = schema.add(name, ArrayType(IntegerType()))
    return rows.mapInArrow(run, schema)


# --- counts over the corpus ---------------------------------------------------------------


def _digested(files: Files) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoders(files)
        width = len(coder.b_bytes)
        for part in parts:
            for batch, texts in _by_bytes(part):
                found = align_texts(coder, texts)
                # Distinct pairs of a text and how often each is linked there.
                links = np.diff(found.link_starts)
                pairs = found.a[found.link_a] * width + found.b[found.link_b]
                most = len(coder.a_bytes) * width
                keys = np.sort(np.repeat(np.arange(links.size), links) * most + pairs)
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else keys
                times = np.diff(np.append(first, keys.size))
                starts = np.searchsorted(keys[first], np.arange(links.size + 1) * most)
                groups = [
                    hashlib.sha256(g).hexdigest() if g else "" for g in spelled(coder, found)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), *[
                            pa.array(np.diff(x), pa.int64())
                            for x in (found.a_starts, found.b_starts, found.group_starts, found.link_starts)
                        ],
                        pa.array(groups, pa.string()), _lists(starts, keys[first] % most, pa.int64()),
                        _lists(starts, times, pa.int32()),
                    ],
                    names=["doc_id", *_COUNTS, "groups_sha256", "pairs", "times"],
                )

    return run


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _looked_up(shared) -> Callable:
    """Sums over the links whose pair is known, and the others beside them."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = shared.value
        for part in parts:
            rows = part.num_rows
            lists, times = part.column("pairs"), part.column("times").flatten().to_numpy()
            pairs = lists.flatten().to_numpy()
            of_row = np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, pairs), max(0, known.size - 1))
            has = known[at] == pairs if known.size else np.zeros(pairs.size, bool)
            sums, bests = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(sums, of_row[has], counts[at[has]] * times[has])
            np.add.at(bests, of_row[has], best[at[has]] * times[has])
            rest = np.concatenate(([0], np.cumsum(np.bincount(of_row[~has], minlength=rows))))
            left = pa.StructArray.from_arrays(
                [pa.array(pairs[~has], pa.int64()), pa.array(times[~has], pa.int32())], ["pair", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in ("row", "doc_id", *_COUNTS, "groups_sha256")],
                    pa.array(bests), pa.array(sums),
                    pa.ListArray.from_arrays(pa.array(rest, pa.int32()), left),
                ],
                names=["row", "doc_id", *_COUNTS, "groups_sha256", "n_best", "count_sum", "rest"],
            )

    return run


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """``pair``, the number of rows that hold it, and whether no pair of its A id has more. An A id is ``pair div width``."""
    counts = pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    # At most one row per A id.
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return stored(
        counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("int").alias("best")),
        "pair-bests",
    )


def _kept(counts: DataFrame, most: int) -> int:
    """The least number of documents, a power of two, that at most ``most`` pairs reach."""
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("n"))
    total, least = 0, 1 << 62
    for power, n in sorted(((r["power"], r["n"]) for r in by_size.collect()), reverse=True):
        total += n
        if total > most:
            break
        least = 1 << power
    return least


def alignment(docs: DataFrame, files: Files, kept: int = KEPT_PAIRS) -> DataFrame:
    """Token, group and link counts of every text, the digest of its groups, and sums over its links of
    how many documents hold their id pair."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    schema = rows.drop("text").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("groups_sha256", "string").add("pairs", ArrayType(LongType())).add("times", ArrayType(IntegerType()))
    found = stored(
        rows.mapInArrow(_digested(files), schema).withColumn("row", F.monotonically_increasing_id()), "token-links"
    )
    counts = pair_counts(found, len(encoders(files).b_bytes))
    least = _kept(counts, kept)
    table = counts.where(F.col("n") >= least).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy(np.int64) for c in ("pair", "n", "best")))
    kind = schema["doc_id"].dataType.simpleString()
    sums = stored(
        found.mapInArrow(
            _looked_up(shared),
            f"row bigint, doc_id {kind}, {', '.join(f'{c} bigint' for c in _COUNTS)}, groups_sha256 string, "
            "n_best bigint, count_sum bigint, rest array<struct<pair:bigint,times:int>>",
        ),
        "link-sums",
    )
    rest = (
        sums.select("row", F.inline("rest"))
        .join(counts.where(F.col("n") < least), "pair")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.col("best") * F.col("times")).alias("_best")
        )
    )
    return sums.join(rest, "row", "left").select(
        "doc_id", *_COUNTS, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
