"""The order-dependent step of weighted-average-cost accounting.

Both divisions of an averaging step cut toward zero, so the result depends on
the order of trades and has no closed form. The step runs inside tasks over
Arrow batches that Spark has already partitioned and sorted: state per key is
a handful of numbers, no group is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

SCALE = 100_000_000
LOW, HIGH = -(2**63), 2**63 - 1

KEY_FIELDS = "tenant_id string, instrument string, segment bigint"
STATE_SCHEMA = (
    f"{KEY_FIELDS}, position bigint, average_cost bigint, realized_pnl decimal(38,0), "
    "last_transaction_id bigint, episode bigint, low_pnl decimal(38,0), high_pnl decimal(38,0), "
    "rejected bigint, beyond bigint"
)
TRACE_SCHEMA = (
    f"{KEY_FIELDS}, id bigint, position bigint, average_cost bigint, realized bigint, "
    "realized_pnl bigint, opened bigint, closed boolean, episode bigint, problem string"
)
ENTRY = ["entry_position", "entry_cost", "entry_pnl", "entry_last_id", "entry_episode"]
BRACKET_SCHEMA = f"{KEY_FIELDS}, moved decimal(38,0), exit_low bigint, exit_high bigint, torn bigint"

_STATE_TYPES = [
    pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0),
    pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64(), pa.int64(),
]
_TRACE_TYPES = [
    pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
    pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(),
]
_ENTRY_TYPES = [pa.int64(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64()]
_BRACKET_TYPES = [
    pa.string(), pa.string(), pa.int64(), pa.decimal128(38, 0), pa.int64(), pa.int64(), pa.int64(),
]

# Failure texts are fixed values: readers of dead letters match them.
UNKNOWN_SIDE = "unknown transaction side"
PNL_SUM = "compute realized pnl: sum out of range"


def _names(schema: str) -> list[str]:
    return [f.strip().split(" ")[0] for f in schema.replace("(38,0)", "").split(",")]


def _record_batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array(column, type=t) for column, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=_names(schema))


def _cut(product: int) -> int:
    return product // SCALE if product >= 0 else -(-product // SCALE)


def apply_trade(position: int, cost: int, pnl: int, quantity: int | None, price: int):
    """``(position, average cost, realized, problem)`` after one trade.

    A trade whose result leaves the 64-bit range changes nothing and names why.
    """
    if quantity is None:
        return position, cost, 0, UNKNOWN_SIDE
    if position == 0 or (position > 0) == (quantity > 0):
        held = _cut(position * cost)
        if not LOW <= held <= HIGH:
            return position, cost, 0, "compute existing cost basis: product out of range"
        added = _cut(quantity * price)
        if not LOW <= added <= HIGH:
            return position, cost, 0, "compute trade cost: product out of range"
        total, larger = held + added, position + quantity
        if not (LOW <= total <= HIGH and LOW <= larger <= HIGH):
            return position, cost, 0, "compute new average cost: sum out of range"
        if larger == 0:
            return position, cost, 0, "compute new average cost: division by zero"
        average = abs(total) * SCALE // abs(larger)
        if (total >= 0) != (larger > 0):
            average = -average
        if not LOW <= average <= HIGH:
            return position, cost, 0, "compute new average cost: quotient out of range"
        return larger, average, 0, None
    closing = min(abs(quantity), abs(position))
    per_unit = price - cost if position > 0 else cost - price
    realized = _cut(closing * per_unit)
    if not (LOW <= per_unit <= HIGH and LOW <= realized <= HIGH):
        return position, cost, 0, "compute realized pnl: product out of range"
    if not LOW <= pnl + realized <= HIGH:
        return position, cost, 0, PNL_SUM
    left = position + quantity
    if left == 0:
        cost = 0
    elif abs(quantity) > closing:
        cost = price
    return left, cost, realized, None


def _runs(batch: pa.RecordBatch) -> list[int]:
    """Row numbers at which a new (tenant, instrument, segment) starts, and the row count."""
    n = batch.num_rows
    changed = None
    for name in ("tenant_id", "instrument", "segment"):
        column = batch.column(name)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        changed = differs if changed is None else pc.or_(changed, differs)
    starts = [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist())] if n > 1 else [0]
    return [*starts, n]


def _entry(batch: pa.RecordBatch, at: int) -> tuple[int, int, int, int | None, int]:
    """State the run starting at row ``at`` begins with."""
    if "entry_position" not in batch.schema.names:
        return 0, 0, 0, None, 0
    values = [
        batch.column(name)[at].as_py()
        for name in ENTRY
    ]
    return values[0] or 0, values[1] or 0, int(values[2] or 0), values[3], values[4] or 0


def fold_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (key, segment): the state after its last trade.

    ``rejected`` counts the trades that could not be applied, ``beyond`` those of them that
    the sum of realized P&L kept out.
    """
    key = None
    out: list[tuple] = []
    position = cost = pnl = episode = low = high = rejected = beyond = 0
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = _runs(batch)
        ids = batch.column("id").to_pylist()
        quantities = batch.column("quantity").to_pylist()
        prices = batch.column("price").to_pylist()
        for a, b in zip(bounds, bounds[1:]):
            run = tuple(batch.column(c)[a].as_py() for c in ("tenant_id", "instrument", "segment"))
            if run != key:
                if key is not None:
                    out.append((*key, position, cost, pnl, last, episode, low, high, rejected, beyond))
                key = run
                position, cost, pnl, last, episode = _entry(batch, a)
                low = high = pnl
                rejected = beyond = 0
            for i in range(a, b):
                after, cost, realized, problem = apply_trade(
                    position, cost, pnl, quantities[i], prices[i]
                )
                if problem is not None:
                    rejected += 1
                    beyond += problem == PNL_SUM
                    continue
                if realized:
                    pnl += realized
                    if pnl < low:
                        low = pnl
                    elif pnl > high:
                        high = pnl
                if position and (after == 0 or (after > 0) != (position > 0)):
                    episode += 1
                position = after
                last = ids[i]
        if len(out) > 50_000:
            yield _record_batch(out, STATE_SCHEMA, _STATE_TYPES)
            out = []
    if key is not None:
        out.append((*key, position, cost, pnl, last, episode, low, high, rejected, beyond))
    if out:
        yield _record_batch(out, STATE_SCHEMA, _STATE_TYPES)


def fold_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, with the state their segment starts from in the entry columns.

    Rows come by key, block, segment and id. The entry columns, where there are any, hold what the block starts from.
    """
    key = here = None
    position = cost = pnl = episode = 0
    last = start = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = _runs(batch)
        ids = batch.column("id").to_pylist()
        quantities = batch.column("quantity").to_pylist()
        prices = batch.column("price").to_pylist()
        starts: list[tuple] = []
        for a, b in zip(bounds, bounds[1:]):
            block = tuple(batch.column(c)[a].as_py() for c in ("tenant_id", "instrument", "block"))
            run = (*block, batch.column("segment")[a].as_py())
            if run != here:
                if block != key:
                    position, cost, pnl, last, episode = _entry(batch, a)
                key, here = block, run
                start = position, cost, pnl, last, episode
            starts.append(start)
            for i in range(a, b):
                after, cost, realized, problem = apply_trade(
                    position, cost, pnl, quantities[i], prices[i]
                )
                if problem is not None:
                    continue
                pnl += realized
                if position and (after == 0 or (after > 0) != (position > 0)):
                    episode += 1
                position = after
                last = ids[i]
        numbers = pa.array(range(len(starts)), type=pa.int32())
        at = pc.run_end_decode(pa.RunEndEncodedArray.from_arrays(pa.array(bounds[1:], type=pa.int32()), numbers))
        kept = [c for c in batch.schema.names if c not in ENTRY]
        entry = [pa.array(c, type=t).take(at) for c, t in zip(zip(*starts), _ENTRY_TYPES)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *entry], names=[*kept, *ENTRY])


def in_segments(function):
    """``function`` over the segments of every block, each from the state that the block hands it."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return function(fold_entries(batches))

    return folded


def fold_trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per trade: the state after it, what it realized, or why it was not applied.

    ``episode`` counts the position's earlier returns to zero or flips; ``opened``
    is the quantity a flip carries into the next episode.
    """
    key = None
    position = cost = pnl = episode = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = _runs(batch)
        ids = batch.column("id").to_pylist()
        quantities = batch.column("quantity").to_pylist()
        prices = batch.column("price").to_pylist()
        out: list[tuple] = []
        for a, b in zip(bounds, bounds[1:]):
            run = tuple(batch.column(c)[a].as_py() for c in ("tenant_id", "instrument", "segment"))
            if run != key:
                key = run
                position, cost, pnl, _, episode = _entry(batch, a)
            for i in range(a, b):
                after, cost, realized, problem = apply_trade(
                    position, cost, pnl, quantities[i], prices[i]
                )
                pnl += realized
                flipped = bool(position and after and (after > 0) != (position > 0))
                closed = bool(position) and (after == 0 or flipped) and problem is None
                out.append((
                    *key, ids[i], after, cost, realized, pnl, after if flipped else None, closed,
                    episode, problem,
                ))
                position = after
                episode += closed
        yield _record_batch(out, TRACE_SCHEMA, _TRACE_TYPES)


def _apply_bracket(position: int, low: int, high: int, quantity: int | None, price: int):
    """``(position, low, high, torn)`` after one trade, whatever the P&L.

    The step is monotone in the cost and the costs it accepts are an interval, so the two
    ends stand for all costs between. Where they disagree the result is ``torn``: a guess
    that takes the trade as applied if either end applies it.
    """
    after, new_low, _, problem = apply_trade(position, low, 0, quantity, price)
    if low == high:
        return after, new_low, new_low, False
    other, new_high, _, other_problem = apply_trade(position, high, 0, quantity, price)
    if problem is None and other_problem is None:
        return after, new_low, new_high, False
    if problem is None:
        return after, new_low, new_low, True
    if other_problem is None:
        return other, new_high, new_high, True
    # A closing trade can fail by gain at one end and by loss at the other, and apply between.
    closes = quantity is not None and position != 0 and (position > 0) != (quantity > 0)
    return position, low, high, closes and (price > low) != (price > high)


def fold_brackets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a segment moves, and the lowest and highest average cost it can end with.

    ``torn`` counts the trades whose verdict depends on where in the bracket the segment
    starts; with any, the row is a guess.
    """
    key = None
    out: list[tuple] = []
    start = position = low = high = torn = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bounds = _runs(batch)
        quantities = batch.column("quantity").to_pylist()
        prices = batch.column("price").to_pylist()
        for a, b in zip(bounds, bounds[1:]):
            run = tuple(batch.column(c)[a].as_py() for c in ("tenant_id", "instrument", "segment"))
            if run != key:
                if key is not None:
                    out.append((*key, position - start, low, high, torn))
                key = run
                position, low, high = (
                    batch.column(c)[a].as_py() for c in ("entry_position", "entry_low", "entry_high")
                )
                start, torn = position, 0
            for i in range(a, b):
                position, low, high, doubt = _apply_bracket(
                    position, low, high, quantities[i], prices[i]
                )
                torn += doubt
    if key is not None:
        out.append((*key, position - start, low, high, torn))
    if out:
        yield _record_batch(out, BRACKET_SCHEMA, _BRACKET_TYPES)
