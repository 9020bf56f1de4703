"""Shards by jump consistent hashing, with DataFrame functions only.

The 64-bit hash of a row's key seeds the generator of the published algorithm; the key jumps from shard to
shard until the next jump would leave them. No ring table is kept: key and shard count decide. If shards
are appended, a key either stays or goes to a new shard, so only the necessary fraction moves; the last
state of the walk tells both the shard among ``n`` and the one among ``n + 1``.

Spark's arithmetic checks for overflow, so the generator's product modulo 2**64 is built from 32-bit halves.

Slots number the rows of a shard without gaps, in the order of the key's hash. No window holds a shard: rows that
show the same (key, size, checksum) are counted first, ``2**CELL_BITS`` ranges of the hash make the cells of a shard,
and running sums go over ranges of cells, then cells, then the rows of a cell. A row that stands for
many repeats is dealt out in pieces.

Defined results: a null key has a hash as any other and one shard. A null text has no bytes and checksum 0, as the empty
one. Rows that share a doc_id share a shard; repeated rows get one slot each. An empty table gives no rows.
Other columns are ignored by ``placed``, and kept by ``write_shards`` and ``moves``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import free_name, stored

SHARDS = 16
LAW = "key"
CELL_BITS = 20  # a shard of a thousand billion rows has cells of about a million
COARSE_BITS = 10
PIECE = 10_000  # repeats of one row that a task deals out at a time
STEPS = 64  # jumps in the first stretch; about ln(shards) are needed, the rare rest goes on after it
# The multiplier of the published algorithm.
MULTIPLIER = 2862933555777941757

_HALF, _QUARTER = 0xFFFFFFFF, 0xFFFF
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & _HALF


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _drawn(high: Column, low: Column, shard: Column) -> Column:
    """The state after a jump to ``shard``: the generator moved on by one draw."""
    upper = F.shiftright(low, 16) * _long(_LOW)
    lower = (
        low.bitwiseAND(_long(_QUARTER)) * _long(_LOW)
        + F.shiftleft(upper.bitwiseAND(_long(_QUARTER)), 16) + _long(1)
    )
    crossed = F.shiftleft((F.shiftright(high, 16) * _long(_LOW)).bitwiseAND(_long(_QUARTER)), 16)
    next_high = (
        F.shiftright(lower, 32) + F.shiftright(upper, 16) + high.bitwiseAND(_long(_QUARTER)) * _long(_LOW)
        + crossed + low * _long(_HIGH)
    )
    return F.struct(
        next_high.bitwiseAND(_long(_HALF)).alias("high"), lower.bitwiseAND(_long(_HALF)).alias("low"),
        shard.alias("shard"),
    )


def _target(state: Column) -> Column:
    """Where the next jump goes."""
    fraction = F.lit(float(1 << 31)) / (F.shiftright(state["high"], 1) + 1).cast("double")
    return ((state["shard"] + 1).cast("double") * fraction).cast("bigint")


def _walk(start: Column, shards: int, steps: int) -> Column:
    def jump(state: Column, _: Column) -> Column:
        target = _target(state)
        return F.when(target < shards, _drawn(state["high"], state["low"], target)).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)


def last_jump(key: Column, shards: int) -> Column:
    """The state in which the walk of a 64-bit ``key`` ends: its shard, and what the next jump starts from."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    low, high = key.bitwiseAND(_long(_HALF)), F.shiftrightunsigned(key, 32)
    state = _drawn(high, low, _long(0))
    # Every jump goes up by one at least.
    if shards > 1:
        state = _walk(state, shards, min(STEPS, shards - 1))
    if shards - 1 > STEPS:
        state = F.when(_target(state) < shards, _walk(state, shards, shards - 1 - STEPS)).otherwise(state)
    return state


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key, from 0."""
    return last_jump(key, shards)["shard"].cast("int")


def key_of(doc_id: Column) -> Column:
    return F.xxhash64(doc_id)


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard, slot, and the shard with one more of them, of every row."""
    state = F.col("_state")
    rows = stored(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        )
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
        .withColumn("_key", key_of(F.col("doc_id")))
        .withColumn("_state", last_jump(F.col("_key"), shards))
        .select(
            "doc_id", "size", "text_crc32", "n", state["shard"].cast("int").alias("shard"),
            F.when(_target(state) == shards, shards).otherwise(state["shard"]).cast("int").alias("grown_shard"),
            F.shiftrightunsigned("_key", 64 - CELL_BITS).alias("cell"), "_key",
        ),
        "shard-rows",
    )
    cells = rows.groupBy("shard", "cell").agg(F.sum("n").alias("held")).withColumn(
        "range", F.shiftright("cell", CELL_BITS - COARSE_BITS)
    )

    def before(keys: list[str], order: list[str]) -> Column:
        rest = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("held").over(rest), F.lit(0))

    ranges = cells.groupBy("shard", "range").agg(F.sum("held").alias("held")).select(
        "shard", "range", before(["shard"], ["range"]).alias("first")
    )
    starts = cells.join(ranges, ["shard", "range"]).select(
        "shard", "cell", (F.col("first") + before(["shard", "range"], ["cell"])).alias("first")
    )
    slots = stored(
        rows.withColumnRenamed("n", "held")
        .join(starts, ["shard", "cell"])
        .select(
            "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "held", "grown_shard",
            (F.col("first") + before(["shard", "cell"], ["_key", "doc_id", "size", "text_crc32"])).alias("slot"),
        ),
        "shard-slots",
    )
    # A row that stands for many is cut to pieces, which other tasks deal out.
    pieces = (
        slots.where(F.col("held") > PIECE)
        .withColumn("_piece", F.explode(F.sequence(_long(0), F.expr(f"(held - 1) div {PIECE}"))))
        .repartition("doc_id", "_piece")
        .withColumn("slot", F.col("slot") + F.col("_piece") * PIECE)
        .withColumn("held", F.least(_long(PIECE), F.col("held") - F.col("_piece") * PIECE))
        .drop("_piece")
    )
    repeats = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("held") - 1))
    return (
        slots.where(F.col("held") <= PIECE)
        .union(pieces)
        .withColumn("slot", repeats)
        .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, files: int = 1) -> str:
    """Write the rows as they came to ``folder``, one subfolder a shard and about ``files`` files in each.

    Returns the name of the partition column: ``shard``, or the next free one. Rows are dealt by shard and the rest of
    the key's hash, so no task holds a whole shard unless ``files`` is 1.
    """
    name, part = free_name(docs, "shard"), free_name(docs, "_part")
    key = key_of(F.col("doc_id"))
    (
        docs.withColumn(name, shard_of(key, shards))
        .withColumn(part, F.pmod(F.shiftrightunsigned(key, 20), _long(files)))
        .repartition(shards * files, name, part)
        .drop(part)
        .write.partitionBy(name)
        .parquet(folder)
    )
    return name


def moves(docs: DataFrame, shards: int, grown: int) -> DataFrame:
    """The rows that go to a new shard when ``shards`` become ``grown``, with the shard they leave and the new one."""
    if grown < shards:
        raise ValueError("shards are appended, not taken away")
    left, new = free_name(docs, "from_shard"), free_name(docs, "to_shard")
    key = key_of(F.col("doc_id"))
    return docs.withColumn(left, shard_of(key, shards)).withColumn(new, shard_of(key, grown)).where(
        F.col(left) != F.col(new)
    )
