import random
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedupe, limits, placement, prefix

S = 1_000_000


def _bucket(calls, rate, burst):
    tokens, last, out = Fraction(burst), None, []
    for t in calls:
        if last is not None:
            tokens = min(Fraction(burst), tokens + Fraction(t - last, S) * rate)
        last = t
        out.append(tokens >= 1)
        tokens -= tokens >= 1
    return out


@pytest.mark.parametrize(
    "times,rate,burst,expected",
    [
        ([0, 0, 0, 0], 1, 3, [True, True, True, False]),
        ([0, 0, S], 1, 1, [True, False, True]),
        ([0, 0, 3600 * S, 3600 * S, 3600 * S], 1, 2, [True, True, True, True, False]),
        ([0, S, 2 * S], 0.5, 1, [True, False, True]),
    ],
)
def test_bucket_cases(spark, times, rate, burst, expected):
    rows = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, ts_us bigint, call_id bigint")
    got = limits.rate_limit_verdicts(rows, rate, burst).orderBy("call_id").collect()
    assert [r.allowed for r in got] == expected


def test_bucket_segments_equal_one_walk(spark):
    rng = random.Random(2)
    times, t = [], 0
    for _ in range(600):
        t += rng.choice([0, 20_000, 90_000, 130_000, 2 * S if rng.random() < 0.02 else 60_000])
        times.append(t)
    rows = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, ts_us bigint, call_id bigint")
    expected = _bucket(times, Fraction(10), 5)
    for segment_rows in (10**6, 50):
        got = limits.rate_limit_verdicts(rows, 10, 5, segment_rows, cell_us=S).orderBy("call_id").collect()
        assert [r.allowed for r in got] == expected


@pytest.mark.parametrize("spread", [1, 40])
def test_calls_of_one_moment_are_cut_by_rank(spark, spread):
    rng = random.Random(7)
    times = sorted(rng.randrange(spread) for _ in range(700))
    rows = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, ts_us bigint, call_id bigint")
    expected = _bucket(times, Fraction(50_000), 4)
    got = limits.rate_limit_verdicts(rows, 50_000, 4, segment_rows=60).orderBy("call_id").collect()
    assert [r.allowed for r in got] == expected


def test_an_overloaded_bucket_takes_no_rounds_over_segments(spark, monkeypatch):
    # One token in 1,000 s, a call every 130 s or so: never full again, so no segment forgets what it starts with.
    rng = random.Random(6)
    times, t = [], 0
    for _ in range(600):
        t += rng.randrange(260 * S)
        times.append(t)
    rows = spark.createDataFrame([("k", t, i) for i, t in enumerate(times)], "key string, ts_us bigint, call_id bigint")
    written = []
    cut = limits.cut_lineage
    monkeypatch.setattr(limits, "cut_lineage", lambda df: written.append(df) or cut(df))
    got = limits.rate_limit_verdicts(rows, Fraction(1, 1000), 3, segment_rows=10).orderBy("call_id").collect()
    assert [r.allowed for r in got] == _bucket(times, Fraction(1, 1000), 3)
    assert len(written) <= 3


def test_small_cells_share_a_task(spark):
    rows = spark.range(3_000).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), "id")
    cells = prefix.ranked_cells(rows, ["k"], ["t", "id"], 10)
    assert cells.rdd.getNumPartitions() <= 2
    assert cells.groupBy("_cell").agg(F.count("*").alias("n")).where("n > 10").isEmpty()


def test_what_a_segment_makes_of_every_entry():
    rng = random.Random(9)
    for _ in range(300):
        unit, burst = rng.choice([1, 5, 12]), rng.randrange(1, 6)
        full = unit * burst
        gains = [0] + [
            rng.choice([0, 1, rng.randrange(2 * unit), rng.randrange(full + 5) if rng.random() < 0.1 else 0])
            for _ in range(40)
        ]
        pieces = [(0, 0, True)]
        for gained in gains:
            pieces = limits.bucketfold.after_call(pieces, gained, unit, full)
        for entry in range(full + 1):
            tokens = entry
            for gained in gains:
                tokens = min(full, tokens + gained)
                tokens -= unit * (tokens >= unit)
            start, value, moves = [p for p in pieces if p[0] <= entry][-1]
            assert tokens == value + (entry - start) * moves


def test_ranked_cells_hold_few_rows_whatever_the_clock(spark):
    rows = spark.range(6_000).select(F.lit("hot").alias("k"), F.lit(5).alias("t"), "id").union(
        spark.range(500).select(F.concat(F.lit("k"), F.col("id") % 7), F.col("id").cast("int"), "id")
    )
    cells = prefix.ranked_cells(rows, ["k"], ["t", "id"], 500)
    sizes = [r["count"] for r in cells.groupBy("_cell").count().collect()]
    assert sum(sizes) == 6_500 and max(sizes) < 1_500
    summed = prefix.running_sum(cells.withColumn("one", F.lit(1)), ["k"], "_cell", ["t", "id"], "one", "place")
    hot = [r.place for r in summed.where("k = 'hot'").orderBy("id").collect()]
    assert hot == list(range(1, 6_001))


@pytest.mark.parametrize("by_rank", [False, True])
def test_failure_streaks_against_brute_force(spark, by_rank):
    rng = random.Random(4)
    at = datetime(2026, 1, 1)
    rows = [
        (f"d{rng.randrange(2)}", at + timedelta(seconds=37 * i), i,
         rng.choice(["success", "failure", "failure", "duplicate"]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "dependency string, ts timestamp, call_id bigint, outcome string")
    got = {(r.dependency, r.started_at, r.failures)
           for r in limits.failure_streaks(df, 3, None if by_rank else F.date_trunc("hour", F.col("ts"))).collect()}
    expected = set()
    for d in ("d0", "d1"):
        run = []
        for _, ts, _, outcome in [*(r for r in rows if r[0] == d and r[3] != "duplicate"), (d, at, 0, "success")]:
            if outcome == "failure":
                run.append(ts)
            else:
                if len(run) >= 3:
                    expected.add((d, run[0], len(run)))
                run = []
    assert got == expected


def test_outage_intervals(spark):
    at = datetime(2026, 1, 1)
    states = [0, 0, 2, 2, 1, 0]
    df = spark.createDataFrame(
        [("db", at + timedelta(seconds=10 * i), s) for i, s in enumerate(states)],
        "dependency string, ts timestamp, state bigint",
    )
    got = [(r.state, r.samples, r.duration_us) for r in limits.outage_intervals(df).orderBy("run").collect()]
    assert got == [(0, 2, 20 * S), (2, 2, 20 * S), (1, 1, 10 * S), (0, 1, 0)]


def _plans():
    rng = random.Random(12)
    for _ in range(8):
        tenants = [f"r{i}" for i in range(rng.randrange(1, 6))]
        yield {t: rng.randrange(-1, 7) for t in tenants}, rng.randrange(1, 4), rng.randrange(1, 20)


@pytest.mark.parametrize("reserved,default,total", list(_plans()))
def test_reservations_hold_their_properties(spark, reserved, default, total):
    config = spark.createDataFrame(list(reserved.items()), "tenant_id string, size int")
    tenants = [*reserved, *(f"p{i}" for i in range(5))]
    seen = spark.createDataFrame([(t, i) for i, t in enumerate(tenants)], "tenant_id string, first_seen bigint")
    held = {r.tenant_id: (r.start, r.size) for r in placement.reservation_table(config, total).collect()}
    dropped = {r.tenant_id for r in placement.dropped_tenants(config, total).collect()}
    pool = {r.tenant_id: (r.start, r.size) for r in placement.pool_ranges(seen, config, default, total).collect()}

    # Every reservation is held or dropped; those held lie side by side in name order from 0 on.
    assert held.keys() | dropped == reserved.keys() and not held.keys() & dropped
    assert list(sorted(held)) == sorted(held, key=lambda t: held[t][0])
    ends = [0, *(start + size for start, size in sorted(held.values()))]
    assert [start for start, _ in sorted(held.values())] == ends[:-1]
    # One partition at least stays for the pool, if there is more than one; nobody is dropped before it is full.
    room = max(total - 1, 1)
    assert ends[-1] <= room and (not dropped or ends[-1] == room)
    assert all(not dropped or t < min(dropped) for t in held)
    # Sizes are as asked for, one at least; only the last one may be cut.
    last = max(held, key=lambda t: held[t][0], default=None)
    for t, (_, size) in held.items():
        asked = max(reserved[t], 1)
        assert size == asked or (t == last and size < asked and ends[-1] == room)
    # The pool's ranges follow without overlap, in order of arrival, for tenants without a reservation.
    at = ends[-1]
    for t in sorted(pool, key=lambda t: pool[t][0]):
        start, size = pool[t]
        assert start == at and t not in held and 1 <= size <= max(default, 1)
        at += size
    assert at <= total
    assert [t for t in tenants if t in pool] == sorted(pool, key=lambda t: pool[t][0])
    # Records stay in their tenant's range, or in the pool.
    rows = spark.createDataFrame([(t, f"I{i}") for t in tenants for i in range(10)], "tenant_id string, instrument string")
    for r in placement.partition_for(rows, seen, config, default, total).collect():
        low, size = (held | pool).get(r.tenant_id, (ends[-1], total - ends[-1]))
        assert 0 <= r.partition < total
        assert size <= 0 or low <= r.partition < low + size


def test_first_payload_wins(spark):
    rows = spark.createDataFrame(
        [("e", 2, "late"), ("e", 1, "first"), ("f", 5, "only")], "event_id string, id bigint, payload string"
    )
    got = {r.event_id: (r.id, r.payload) for r in dedupe.dedupe_events(rows, ["id"]).collect()}
    assert got == {"e": (1, "first"), "f": (5, "only")}
    ledger = spark.createDataFrame([("e",)], "event_id string")
    assert [r.event_id for r in dedupe.new_events(rows, ledger, ["id"]).collect()] == ["f"]


def test_bad_map_version_keeps_the_last_good_one(spark):
    rows = spark.createDataFrame(
        [(1, '{"a":{"start":0,"count":2}}'), (2, '{"a":{"start":0,"count":3},"b":{"start":3,"count":0}}'),
         (3, "not json")],
        "version bigint, value string",
    )
    assert [tuple(r) for r in placement.valid_map_version(rows).collect()] == [(1, "a", 2)]
    assert [tuple(r) for r in placement.valid_tenant_ranges(rows).collect()] == [("a", 2, 0, 3)]
