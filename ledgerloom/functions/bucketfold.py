"""The order-dependent step of a token bucket, in whole units.

A token is ``token_units`` units and one microsecond refills ``refill_units``,
so the arithmetic is exact for any rational rate.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

VERDICT_SCHEMA = "key string, segment bigint, ts_us bigint, call_id bigint, allowed boolean"
ENTRY_SCHEMA = "key string, segment bigint, entry_us bigint, entry_tokens bigint"
EFFECT_SCHEMA = (
    "key string, segment bigint, first_us bigint, last_us bigint, "
    "starts array<bigint>, exits array<bigint>, moves array<boolean>"
)
_ENTRY_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
_EFFECT_TYPES = [
    pa.string(), pa.int64(), pa.int64(), pa.int64(),
    pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()),
]
BATCH = 10_000

Fold = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _runs(batch: pa.RecordBatch) -> list[int]:
    n = batch.num_rows
    if n < 2:
        return [0, n]
    changed = None
    for name in ("key", "segment"):
        column = batch.column(name)
        differs = pc.not_equal(column.slice(1), column.slice(0, n - 1))
        changed = differs if changed is None else pc.or_(changed, differs)
    return [0, *(i + 1 for i in pc.indices_nonzero(changed).to_pylist()), n]


def _record_batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    names = [f.split(" ")[0] for f in schema.split(", ")]
    columns = [pa.array(column, type=t) for column, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(columns, names=names)


def folder(token_units: int, refill_units: int, burst: int) -> Fold:
    """A fold over batches sorted by key, segment, time and call: one verdict per call.

    A segment starts from ``entry_tokens`` at ``entry_us``; without them, full.
    """
    full = burst * token_units

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = None
        tokens, last = full, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            has_entry = "entry_tokens" in batch.schema.names
            times = batch.column("ts_us").to_pylist()
            allowed: list[bool] = []
            bounds = _runs(batch)
            for a, b in zip(bounds, bounds[1:]):
                here = (batch.column("key")[a].as_py(), batch.column("segment")[a].as_py())
                if here != run:
                    run = here
                    tokens, last = full, None
                    if has_entry:
                        tokens = batch.column("entry_tokens")[a].as_py()
                        last = batch.column("entry_us")[a].as_py()
                for i in range(a, b):
                    now = times[i]
                    if last is not None:
                        tokens = min(full, tokens + (now - last) * refill_units)
                    last = now
                    if tokens >= token_units:
                        tokens -= token_units
                        allowed.append(True)
                    else:
                        allowed.append(False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("segment"), batch.column("ts_us"),
                    batch.column("call_id"), pa.array(allowed),
                ],
                names=["key", "segment", "ts_us", "call_id", "allowed"],
            )

    return fold


def after_call(
    pieces: list[tuple[int, int, bool]], gained: int, token_units: int, full: int
) -> list[tuple[int, int, bool]]:
    """``pieces`` of a function on 0 to ``full`` after a refill of ``gained`` units and one call.

    A piece is ``(start, value at the start, moves)``: up to the next start the value rises with the entry,
    or stays. More tokens at the start never let fewer calls pass, and one token more at most one call more,
    so rejected calls leave at most ``burst`` steps; a full bucket makes pieces constant.
    """
    cut: list[tuple[int, int, bool]] = []
    ends = [start for start, _, _ in pieces[1:]]
    ends.append(full + 1)
    for (start, value, moves), end in zip(pieces, ends):
        value += gained
        highest = value + end - start - 1 if moves else value
        if value >= full:
            value, highest, moves = full, full, False
        parts = [(start, value, moves, min(highest, full))]
        if highest > full:
            reach = start + full - value
            parts = [(start, value, True, full - 1), (reach, full, False, full)]
        for start, value, moves, highest in parts:
            if value >= token_units:
                cut.append((start, value - token_units, moves))
            else:
                cut.append((start, value, moves))
                if highest >= token_units:
                    cut.append((start + token_units - value, 0, True))
    joined: list[tuple[int, int, bool]] = []
    for piece in cut:
        if joined:
            start, value, moves = joined[-1]
            if moves == piece[2] and piece[1] == (value + piece[0] - start if moves else value):
                continue
        joined.append(piece)
    return joined


def effects(token_units: int, refill_units: int, burst: int) -> Fold:
    """A fold over the same batches: per segment, what it leaves of any number of units at its first call."""
    full = burst * token_units

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = first = last = None
        pieces: list[tuple[int, int, bool]] = []
        found: list[tuple] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            times = batch.column("ts_us").to_pylist()
            bounds = _runs(batch)
            for a, b in zip(bounds, bounds[1:]):
                here = (batch.column("key")[a].as_py(), batch.column("segment")[a].as_py())
                if here != run:
                    if run is not None:
                        found.append((*run, first, last, *zip(*pieces)))
                    run, first, last = here, times[a], None
                    pieces = [(0, 0, True)]
                for i in range(a, b):
                    now = times[i]
                    gained = 0 if last is None else (now - last) * refill_units
                    last = now
                    if len(pieces) == 1 and not pieces[0][2]:
                        # One value for every entry: a bucket that has been full.
                        tokens = min(full, pieces[0][1] + gained)
                        pieces = [(0, tokens - token_units if tokens >= token_units else tokens, False)]
                    else:
                        pieces = after_call(pieces, gained, token_units, full)
            if len(found) > BATCH:
                yield _record_batch(found, EFFECT_SCHEMA, _EFFECT_TYPES)
                found = []
        if run is not None:
            found.append((*run, first, last, *zip(*pieces)))
            yield _record_batch(found, EFFECT_SCHEMA, _EFFECT_TYPES)

    return fold


def walker(token_units: int, refill_units: int, burst: int) -> Fold:
    """A fold over what ``effects`` gives, sorted by key and segment: the state every segment starts from."""
    full = burst * token_units

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tokens, last = None, full, None
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, tokens, last = row["key"], full, None
                found.append((key, row["segment"], last, tokens))
                if last is not None:
                    tokens = min(full, tokens + (row["first_us"] - last) * refill_units)
                at = bisect_right(row["starts"], tokens) - 1
                risen = tokens - row["starts"][at] if row["moves"][at] else 0
                tokens, last = row["exits"][at] + risen, row["last_us"]
            if found:
                yield _record_batch(found, ENTRY_SCHEMA, _ENTRY_TYPES)

    return walk
