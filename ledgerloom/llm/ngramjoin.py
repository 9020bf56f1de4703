"""Similarity join of documents on their word shingles, and the components of its links.

Two documents link when the Jaccard similarity of their sets of ``words``-word shingles is at least
``least`` percent, by default ``WORDS`` and ``LEAST``. Equal sets are folded first; what follows sees
each set once.

Candidates come from prefixes with token combinations. Shingles that more than ``FREQUENT`` documents hold
are frequent, the others are rare. A set is ordered rare before frequent, then by hash. If two sets link, the first
``n - ceil(least * n / 100) + c`` shingles of both share at least ``c``. Frequent shingles fall into
``CLASSES`` classes. With ``c = CLASSES + 1`` two linked prefixes share a rare shingle or two of one class, so a
prefix is indexed under each rare shingle and under each pair of frequent ones of one class: a
passage that many documents repeat makes no candidates by one shingle. Small and very large sets, for
which that prefix is too long or has too many pairs, are indexed under single shingles with ``c = 1``;
sizes near a limit are indexed both ways, so two sets that can link always share a way.

No bucket is expanded into all pairs. First every member is verified against the first one of its bucket,
and the links found give components. Members of a bucket that are now in one component need no further
look; all pairs of members in different components are then verified too, so no link between components
is missed. What is not verified are pairs that are already connected.

Defined results: null or wordless text has an empty set, links with nothing and is its own component.
Fewer words than ``words`` make one shingle. Rows that share a doc_id are one node. Rows with a null doc_id
link with nothing and get a null component. Repeated rows get one result each; other columns are ignored,
whatever their names. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import free_name, release_memory, slices, stored
from ledgerloom.llm.components import components

WORDS = 4
LEAST = 85  # percent
FREQUENT = 100
CLASSES = 8
SMALL, LARGE = 60, 1500  # set sizes up to which, and from which, single shingles are indexed
MOST_FREQUENT = 1 << 20  # entries of the table of frequent shingles, which is broadcast
RANGES = 256  # ranges of fingerprints at least
RANGE_BYTES = 4 << 20  # bytes of text per range, which is at most half as many shingles
HELD = 2_000_000  # shingles a task counts at a time
BATCH = 256  # texts taken at a time
KNOWN_IDS = 1 << 20  # more candidate documents than this are joined, not broadcast

_ODD = [np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD,
    0xC4CEB9FE1A85EC53)]
KEPT_WORDS = 60_000  # hashes of words a task keeps, some 160 bytes each
_words: dict[bytes, bytes] = {}


# --- shingles -----------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _ODD[4]
    h = (h ^ (h >> np.uint64(29))) * _ODD[5]
    return h ^ (h >> np.uint64(32))


def _word_hash(word: bytes) -> bytes:
    if len(_words) >= KEPT_WORDS:
        _words.clear()
    found = _words[word] = xxhash.xxh3_64_digest(word)
    return found


def _freed(task: Callable) -> Callable:
    """``task`` over a partition; the words it kept go when the partition ends."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(parts)
        finally:
            _words.clear()
            release_memory()

    return run


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    known = _words.get
    # Lower-casing and splitting bytes touch A-Z and the six blanks of ASCII only.
    split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    joined = b"".join([known(w) or _word_hash(w) for text in split for w in text])
    hashes = np.frombuffer(joined, np.uint64)
    n = max(0, hashes.size - words + 1)
    sums = np.zeros(n, np.uint64)
    for place in range(words):
        sums = (sums ^ (sums >> np.uint64(31))) * _ODD[place % 4] + hashes[place : place + n]
    sums = _mixed(sums)
    sets, at = [], 0
    for text in split:
        if len(text) >= words:
            own = np.sort(sums[at : at + len(text) - words + 1])
            new = np.ones(own.size, bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            sets.append(own[new])
        elif text:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text), len(text))], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
        at += len(text)
    return sets


# --- frequent shingles --------------------------------------------------------------------


def _fingerprints(h: np.ndarray, ranges: int) -> np.ndarray:
    """A range in the upper and 32 bits of the hash in the lower half. Two shingles that share
    one count together, which can only make a rare shingle frequent."""
    part = ((h >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
    return (part << np.uint64(32)) | ((h >> np.uint64(8)) & np.uint64(0xFFFFFFFF))


def _counted(words: int, ranges: int) -> Callable:
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(prints >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
            rows = [(r, a, b) for r, a, b in zip(range(ranges), cuts[:-1], cuts[1:]) if a < b]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r for r, _, _ in rows], pa.int32()),
                    pa.array([prints[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary()),
                    pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary()),
                ],
                names=["part", "prints", "counts"],
            )

        for part in parts:
            for batch in slices(part, BATCH):
                found = np.concatenate(shingle_sets(batch.column("text").to_pylist(), words))
                held.append(_fingerprints(found, ranges))
                size += found.size
                if size >= HELD:
                    yield emit()
                    held, size = [], 0
        if size:
            yield emit()

    return _freed(count)


def _summed(least: int) -> Callable:
    def add(table: pa.Table) -> pa.Table:
        prints = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("prints")])
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")])
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order].astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], prints[1:] != prints[:-1])))
        sums = np.add.reduceat(counts, starts)
        often = sums > least
        part = int(table.column("part")[0].as_py()) << 32
        return pa.table({
            "print": pa.array(prints[starts][often].astype(np.int64) + part, pa.int64()),
            "n": pa.array(sums[often], pa.int64()),
        })

    return add


def ranges_for(docs: DataFrame, partitions: int) -> int:
    """So many ranges that the counts of one, which a task holds, do not grow with the corpus."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    return min(1 << 24, max(RANGES, 4 * partitions, -(-size // RANGE_BYTES)))


def frequent_shingles(docs: DataFrame, words: int, least: int, ranges: int) -> np.ndarray:
    """Sorted fingerprints of the shingles that more than ``least`` documents hold.

    If these are more than ``MOST_FREQUENT``, ``least`` is doubled until they are not; the
    result of the join does not depend on it.
    """
    often = stored(
        docs.select("text")
        .mapInArrow(_counted(words, ranges), "part int, prints binary, counts binary")
        .groupBy("part")
        .applyInArrow(_summed(least), "print bigint, n bigint"),
        "frequent-shingles",
    )
    by_size = often.groupBy(F.floor(F.log2(F.col("n") / least)).cast("int").alias("power")).agg(
        F.count("*").alias("n")
    )
    powers = sorted(((r["power"], r["n"]) for r in by_size.collect()), reverse=True)
    total, lowest = 0, 0
    for power, n in powers:
        total += n
        if total > MOST_FREQUENT:
            lowest = power + 1
            break
    kept = often.where(F.col("n") >= least * 2**lowest).select("print").toPandas()["print"]
    return np.sort(kept.to_numpy(np.int64)).astype(np.uint64)


# --- prefixes -----------------------------------------------------------------------------


def _has(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not sorted_values.size:
        return np.zeros(values.size, bool)
    at = np.searchsorted(sorted_values, values)
    at[at == sorted_values.size] = 0
    return sorted_values[at] == values


def prefix_size(n: int, least: int = LEAST) -> int:
    """Of ``n`` shingles in order, so many are the prefix in which linked sets share CLASSES + 1."""
    return min(n, n - -(-least * n // 100) + CLASSES + 1)


def keys_of(h: np.ndarray, frequent: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is indexed; ``frequent`` tells which shingles are.

    Beside each key, how many shingles of the set can be shared if the key holds the first shared one:
    those from its place on, and for a pair of frequent ones all frequent ones. Two sets are candidates
    under a key only if both numbers are large enough. Sets that link meet at their first shared
    shingle, or share frequent ones only.
    """
    n = h.size
    # A set links with equal ones only if one shingle more is too many (at 85 percent, up to five shingles).
    if 100 * n < least * (n + 1):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rare, often = h[~frequent], h[frequent]
    size = prefix_size(n, least)
    # Of any two linked sets, so many of the first shingles share one.
    single = n - -(-least * n // 100) + 1
    both = n <= SMALL or n >= LARGE
    paired = n * 100 >= SMALL * least and n * least <= LARGE * 100
    first = rare[: size if paired else single]
    keys, rest = [first], [n - np.arange(first.size)]
    if both and rare.size < single:
        more = often[: single - rare.size]
        keys.append(more)
        rest.append(n - rare.size - np.arange(more.size))
    # With more rare shingles, the shared one among the first is rare.
    if paired and rare.size < single:
        often = often[: size - rare.size]
        kind = often & np.uint64(CLASSES - 1)
        for c in range(CLASSES):
            own = often[kind == np.uint64(c)]
            if own.size > 1:
                a, b = np.triu_indices(own.size, 1)
                keys.append(_mixed(own[a] * _ODD[0] + own[b]))
                rest.append(np.full(a.size, n - rare.size))
    return np.concatenate(keys), np.concatenate(rest)


def head_of(h: np.ndarray, frequent: np.ndarray, least: int = LEAST) -> tuple[bytes, int]:
    """Sorted 32-bit parts of the prefix, and the place of its last shingle in the order."""
    size = prefix_size(h.size, least)
    rare = h[~frequent][:size]
    often = h[frequent][: size - rare.size]
    last = int(often[-1] >> np.uint64(1)) if often.size else int(rare[-1] >> np.uint64(1)) - 2**63
    both = np.concatenate((rare, often)) if often.size else rare
    return np.sort(both.astype(np.uint32)).tobytes(), last


def may_link(
    n: int, last: int, head: np.ndarray, other_n: int, other_last: int, other: np.ndarray, least: int = LEAST
) -> bool:
    """Whether two prefixes leave room for enough shared shingles.

    Of the set whose prefix ends first, every shared shingle up to that end is in both prefixes, and all
    later ones may be shared. Equal 32-bit parts can only add to the count.
    """
    both = np.concatenate((head, other))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    rest = n - head.size if last <= other_last else other_n - other.size
    return (shared + rest) * (100 + least) >= least * (n + other_n)


def _lists(indexed: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([k.size for k, _ in indexed]))).astype(np.int32)
    keys = np.concatenate([k for k, _ in indexed]).view(np.int64)
    rest = np.concatenate([r for _, r in indexed]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.StructArray.from_arrays([pa.array(keys), pa.array(rest)], ["key", "rest"])
    )


def _indexed(words: int, least: int, ranges: int, shared) -> Callable:
    def index(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        for part in parts:
            for batch in slices(part, BATCH):
                sets = shingle_sets(batch.column("text").to_pylist(), words)
                cuts = np.cumsum([h.size for h in sets])[:-1]
                often = np.split(_has(frequent, _fingerprints(np.concatenate(sets), ranges)), cuts)
                keys = [keys_of(h, f, least) for h, f in zip(sets, often)]
                heads = [head_of(h, f, least) if h.size else (None, None) for h, f in zip(sets, often)]
                digests = [xxhash.xxh3_128_digest(h.tobytes()) if h.size else None for h in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([h.size for h in sets], pa.int64()),
                        pa.array(digests, pa.binary()), pa.array([x for _, x in heads], pa.int64()),
                        pa.array([x for x, _ in heads], pa.binary()), _lists(keys),
                    ],
                    names=["doc_id", "n", "digest", "last", "head", "keys"],
                )

    return _freed(index)


# --- buckets and links --------------------------------------------------------------------


_MEMBER = ("key", "node", "n", "rest")
_LEADER = ("leader", "leader_n", "leader_rest")


def _led(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and node: every row but a bucket's first, with that one as leader."""
    last = None  # key, and node, n and rest of the leader
    for batch in parts:
        if not batch.num_rows:
            continue
        key, *own = (batch.column(c).to_numpy(zero_copy_only=False) for c in _MEMBER)
        first = np.concatenate(([last is None or key[0] != last[0]], key[1:] != key[:-1]))
        at = np.maximum.accumulate(np.where(first, np.arange(key.size), -1))
        ahead = at < 0  # rows of a bucket that began in an earlier batch
        lead = [np.where(ahead, last[i + 1] if last else 0, x[at]) for i, x in enumerate(own)]
        last = (key[-1], *(x[-1] for x in lead))
        kept = ~first
        if kept.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[kept], pa.int64()) for x in (key, *lead, *own)],
                names=["key", *_LEADER, *_MEMBER[1:]],
            )


def _sets_of(words: int) -> Callable:
    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in slices(part, BATCH):
                found = shingle_sets(batch.column("text").to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([h.tobytes() for h in found], pa.binary())],
                    names=["doc_id", "h"],
                )

    return _freed(sets)


def _possible(least: int) -> Callable:
    def possible(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in slices(part, 2048):
                columns = [batch.column(c).to_pylist() for c in ("un", "ul", "uh", "vn", "vl", "vh")]
                keep = [
                    may_link(un, ul, np.frombuffer(uh, np.uint32), vn, vl, np.frombuffer(vh, np.uint32), least)
                    for un, ul, uh, vn, vl, vh in zip(*columns)
                ]
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return possible


def _verified(least: int) -> Callable:
    def verified(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for batch in slices(part, 512):
                keep = []
                for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    both = int(_has(y, x).sum())
                    keep.append(100 * both >= least * (x.size + y.size - both))
                yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return verified


def _fits(least: int, n: str, rest: str, other_n: str, other_rest: str):
    """Whether two members of a bucket can link; see ``keys_of``."""
    return F.least(rest, other_rest) * (100 + least) >= (F.col(n) + F.col(other_n)) * least


class _Join:
    def __init__(self, docs: DataFrame, words: int, least: int) -> None:
        self.spark = docs.sparkSession
        self.words, self.least = words, least
        self.docs = docs.select("doc_id", "text")
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = ranges_for(self.docs, partitions)
        frequent = self.spark.sparkContext.broadcast(
            frequent_shingles(self.docs, words, FREQUENT, ranges)
        )
        index = _indexed(words, least, ranges, frequent)
        kind = dict(self.docs.dtypes)["doc_id"]
        self.rows = stored(
            self.docs.mapInArrow(
                index,
                f"doc_id {kind}, n bigint, digest binary, last bigint, head binary, keys array<struct<key:bigint,rest:int>>",
            ),
            "shingle-keys",
        )
        # A row per distinct set, under the smallest doc_id that has it; combined before the shuffle.
        self.classes = stored(
            self.rows.where("digest is not null and doc_id is not null")
            .groupBy("digest")
            .agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n", "last", "head", "keys")]),
            "shingle-classes",
        )

    def buckets(self) -> DataFrame:
        """The members of every bucket but the first, beside the first."""
        postings = self.classes.select("node", "n", F.inline("keys").alias("key", "rest"))
        return stored(
            postings.repartition("key")
            .sortWithinPartitions("key", "node")
            .mapInArrow(_led, ", ".join(f"{c} bigint" for c in ("key", *_LEADER, *_MEMBER[1:]))),
            "shingle-buckets",
        )

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``u`` and ``v`` whose sets are similar enough."""
        def heads(side: str) -> DataFrame:
            return self.classes.select(
                F.col("node").alias(side), F.col("n").alias(f"{side}n"), F.col("last").alias(f"{side}l"),
                F.col("head").alias(f"{side}h"),
            )

        pairs = (
            pairs.join(heads("u"), "u")
            .join(heads("v"), "v")
            .select("u", "v", "un", "ul", "uh", "vn", "vl", "vh")
            .mapInArrow(_possible(self.least), "u bigint, v bigint")
        )
        # A doc_id with several texts may hold several classes.
        pairs = stored(pairs.distinct(), "shingle-pairs")
        ids = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
        if ids.limit(KNOWN_IDS + 1).count() <= KNOWN_IDS:
            ids = F.broadcast(ids)
        docs = self.docs.join(ids, "doc_id", "left_semi")
        sets = stored(docs.mapInArrow(_sets_of(self.words), "doc_id bigint, h binary"), "shingle-sets")
        # Rows that share a doc_id may have several sets; a pair links if any of them do.
        return stored(
            pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("h").alias("a")), "u")
            .join(sets.select(F.col("doc_id").alias("v"), F.col("h").alias("b")), "v")
            .select("u", "v", "a", "b")
            .mapInArrow(_verified(self.least), "u bigint, v bigint")
            .distinct(),
            "shingle-links",
        )

    def components(self) -> DataFrame:
        """``node`` and ``component`` of every node that is linked with a smaller one."""
        buckets = self.buckets()
        pairs = (
            buckets.where(_fits(self.least, "n", "rest", "leader_n", "leader_rest"))
            .select(F.col("leader").alias("u"), F.col("node").alias("v"))
            .distinct()
        )
        # A doc_id with several texts ties their sets together.
        held = self.rows.where("digest is not null and doc_id is not null").join(
            self.classes.select("digest", "node"), "digest"
        )
        least = held.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("_most"))
        tied = (
            held.join(least.where("v <> _most"), "doc_id")
            .where("node <> v")
            .select(F.col("node").alias("u"), "v")
        )
        first = stored(self.links(pairs).union(tied).distinct(), "links-1")
        found = components(first)

        known = found.withColumnRenamed("component", "c")
        label = stored(
            buckets.join(known.select(F.col("node").alias("leader"), F.col("c").alias("_a")), "leader", "left")
            .join(known.select("node", F.col("c").alias("_b")), "node", "left")
            .select(
                "key", F.coalesce("_a", "leader").alias("leader_c"), "node", "n", "rest",
                F.coalesce("_b", "node").alias("c"),
            ),
            "shingle-labels",
        )
        # The pairs with the leader are done. A bucket whose others are all in its component is, too.
        apart = label.where("c <> leader_c")
        one = apart.select("key", *[F.col(c).alias(f"u_{c}") for c in ("node", "n", "rest", "c", "leader_c")])
        two = label.join(apart.select("key").distinct(), "key", "left_semi").select(
            "key", *[F.col(c).alias(f"v_{c}") for c in ("node", "n", "rest", "c")]
        )
        crossing = (
            one.join(two, "key")
            .where("u_c <> v_c and (v_c = u_leader_c or u_node < v_node)")
            .where(_fits(self.least, "u_n", "u_rest", "v_n", "v_rest"))
            .select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
            .distinct()
        )
        second = self.links(crossing)
        if second.isEmpty():
            return found
        return components(first.union(second))


def ngram_components(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """Set size and component of every document."""
    join = _Join(docs, words, least)
    found = join.components().select(F.col("node").alias("_node"), "component")
    classes = (
        join.classes
        .select(F.col("digest").alias("_digest"), F.col("node"))
        .join(found, F.col("node") == F.col("_node"), "left")
        .select("_digest", F.coalesce("component", "node").alias("_component"))
    )
    return join.rows.join(classes, F.col("digest") == F.col("_digest"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """The document with the smallest id of every component; columns as they came.

    Rows that share a doc_id stay or go together; rows with a null doc_id stay.
    """
    name = free_name(docs, "_gone")
    gone = (
        ngram_components(docs, words, least)
        .where("component_id <> doc_id")
        .select(F.col("doc_id").alias(name))
        .distinct()
    )
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
