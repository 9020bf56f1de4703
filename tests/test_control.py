import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import control, prefix, telemetry
from ledgerloom.schemas import SIGNALS

CASES = [
    (3, False, 2000, 100, 12, "Scaling", 10, False), (3, False, 2000, 10, 6, "Scaling", 6, False),
    (6, False, 2000, 10, 6, "Isolated", 6, True), (4, False, 100, 100, 12, "Degraded", 4, False),
    (4, False, 100, 10, 12, "Stable", 4, False), (4, True, 100, 10, 12, "Isolated", 4, False),
    (1, False, 100, 100, 12, "Degraded", 1, False), (9, False, 2000, 100, 20, "Scaling", 10, False),
    (2, False, 2000, 10, 50, "Scaling", 10, False), (0, False, 2000, 10, 1, "Scaling", 2, False),
]


def test_classifier_cases(spark):
    rows = spark.createDataFrame(
        [(i, *c[:5]) for i, c in enumerate(CASES)],
        "i int, baseline int, latched boolean, lag bigint, p99_ms int, partition_count int",
    ).withColumns(
        {"min_replicas": F.lit(2), "max_replicas": F.lit(10), "kafka_lag_threshold": F.lit(1000),
         "p99_latency_threshold_ms": F.lit(50)}
    )
    got = {r.i: (r.state, r.replicas, r.sets_latch) for r in control.classify_tenants(rows).collect()}
    assert got == {i: c[5:] for i, c in enumerate(CASES)}


def _walk(signals, spec, resets):
    """One decision after the other."""
    low, high, lag_limit, p99_limit, replicas, latch = spec
    out = []
    for at, lag, p99, parts in signals:
        if at in resets:
            latch = False
        base = max(replicas, low)
        if lag > lag_limit and p99 > p99_limit:
            state, replicas = "Scaling", high
        elif lag > lag_limit and base < parts:
            state, replicas = "Scaling", min(max(min(high, parts), low), high)
        elif lag > lag_limit:
            state, replicas = "Isolated", base
        elif p99 > p99_limit:
            state, replicas = "Degraded", base
        else:
            state, replicas = ("Isolated" if latch else "Stable"), base
        if lag > lag_limit and p99 <= p99_limit and base >= parts:
            latch = True
        out.append((at, base, state, replicas, latch))
    return out


def test_history_equals_a_sequential_walk(spark):
    rng = random.Random(1)
    start = datetime(2026, 1, 1)
    signals, specs, resets, expected = [], [], [], {}
    for t in range(25):
        low = rng.randrange(1, 4)
        high = low + rng.randrange(0, 8)
        spec = (low, high, 50, 50, rng.choice([0, 0, low, high, high + 3]), rng.random() < 0.2)
        mine = [
            (start + timedelta(minutes=m), rng.randrange(100), rng.randrange(100), rng.randrange(1, 16))
            for m in range(40)
        ]
        cleared = {m[0] for m in mine if rng.random() < 0.05}
        signals += [(f"t{t}", *m[:3], m[3], 0) for m in mine]
        resets += [(f"t{t}", at) for at in cleared]
        specs.append((f"t{t}", *spec))
        expected[f"t{t}"] = _walk(mine, spec, cleared)
    history = control.tenant_status_history(
        spark.createDataFrame(signals, SIGNALS),
        spark.createDataFrame(
            specs,
            "tenant_id string, min_replicas int, max_replicas int, kafka_lag_threshold bigint, "
            "p99_latency_threshold_ms int, current_replicas int, latched boolean",
        ),
        spark.createDataFrame(resets, "tenant_id string, observed_at timestamp"),
    )
    got = {}
    for r in history.orderBy("tenant_id", "observed_at").collect():
        got.setdefault(r.tenant_id, []).append(
            (r.observed_at, r.baseline, r.state, r.replicas, r.latched_after)
        )
    assert got == expected


@pytest.mark.parametrize("segment", [1024, 3])
def test_history_under_changing_specs_equals_a_sequential_walk(spark, monkeypatch, segment):
    monkeypatch.setattr(prefix, "SEGMENT", segment)
    rng = random.Random(2)
    start = datetime(2026, 1, 1)
    signals, specs, resets, expected = [], [], [], {}
    for t in range(30):
        mine = [
            (start + timedelta(minutes=m), rng.randrange(100), rng.randrange(100), rng.randrange(1, 16))
            for m in range(25)
        ]
        cleared = {m[0] for m in mine if rng.random() < 0.1}
        first = rng.choice([None, 4])  # a tenant without a spec at first
        begins = [first] + sorted(rng.sample(range(6, 25), 3))
        versions = []
        for place, minute in enumerate(begins):
            low = rng.randrange(1, 8)
            current = (rng.choice([0, 5, 12]), rng.random() < 0.3)
            spec = (low, low + rng.randrange(0, 8), rng.randrange(20, 80), rng.randrange(20, 80), *current)
            at = None if minute is None else start + timedelta(minutes=minute)
            versions.append((at, spec))
            specs += [(f"t{t}", at, *spec)] * rng.choice([1, 2])
            if rng.random() < 0.5:  # the same moment, smaller by current_replicas
                specs.append((f"t{t}", at, *spec[:4], current[0] - 1, True))
        signals += [(f"t{t}", *m[:3], m[3], 0) for m in mine]
        resets += [(f"t{t}", at) for at in cleared]
        replicas, latch, walked = *versions[0][1][4:], []
        for row in mine:
            spec = [s for at, s in versions if at is None or at <= row[0]]
            if spec:
                walked += _walk([row], (*spec[-1][:4], replicas, latch), cleared)
                replicas, latch = walked[-1][3], walked[-1][4]
        expected[f"t{t}"] = walked
    history = control.tenant_status_history(
        spark.createDataFrame(signals, SIGNALS),
        spark.createDataFrame(
            specs,
            "tenant_id string, valid_from timestamp, min_replicas int, max_replicas int, kafka_lag_threshold bigint, "
            "p99_latency_threshold_ms int, current_replicas int, latched boolean",
        ),
        spark.createDataFrame(resets, "tenant_id string, observed_at timestamp"),
    )
    got = {}
    for r in history.orderBy("tenant_id", "observed_at").collect():
        got.setdefault(r.tenant_id, []).append(
            (r.observed_at, r.baseline, r.state, r.replicas, r.latched_after)
        )
    assert got == expected


def test_a_key_of_too_many_rows_fails(spark, monkeypatch):
    monkeypatch.setattr(prefix, "SEGMENT", 2)
    rows = spark.range(9).select(F.lit("k").alias("k"), F.lit(0).alias("cell"), "id", F.lit(5).alias("start")).withColumn(
        "step", prefix.step_below(F.col("id"), F.col("id"))
    )
    placed = prefix.segmented(rows, ["k"], "cell", ["id"])
    with pytest.raises(Exception, match="too many rows of one key"):
        prefix.before_each(placed, ["k"], "step", "start", "found").collect()
    few = prefix.segmented(rows.where("id < 8"), ["k"], "cell", ["id"])
    found = prefix.before_each(few, ["k"], "step", "start", "found").orderBy("id").collect()
    assert [r.found for r in found] == [5, 5, 5, 5, 5, 5, 5, 6]


def test_transition_counts_are_preseeded(spark):
    empty = spark.createDataFrame([], "transition string")
    assert {r.transition: r.transitions for r in control.transition_counts(empty).collect()} == {
        t: 0 for t in control.TRANSITIONS
    }


def test_alert_pending_then_firing(spark):
    at = datetime(2026, 1, 1, 12, 0, 0)
    rows = spark.createDataFrame(
        [("Isolated", at), ("Scaling", at), ("Scaling", at), ("Scaling", at + timedelta(minutes=1))],
        "transition string, observed_at timestamp",
    )
    states = {}
    for r in control.alert_rules(rows).orderBy("ts").collect():
        states.setdefault(r.alert, []).append(r.state)
    isolated = states["TenantIsolatedNoisyNeighborSuspected"]
    assert isolated == ["pending"] * 2 + ["firing"] * 8
    # Three scalings lie in the look-back from the second minute on.
    assert len(states["TenantAtMaxReplicasWithGrowingLag"]) == 28
    assert states["TenantAtMaxReplicasWithGrowingLag"].count("pending") == 10
    assert "TenantDegradedDownstreamBottleneck" not in states


def test_lag_and_active_consumers(spark):
    schema = "poll bigint, partition bigint, offset bigint, tenant_id string, decodable boolean, high_watermark bigint"
    rows = spark.createDataFrame(
        [(1, 0, 0, "t1", True, 10), (1, 0, 1, "t1", True, 10), (2, 0, 5, "t1", True, 6),
         (2, 1, 3, "t1", True, 3), (2, 2, 1, "tenant-2", True, 9), (3, 0, 6, "", False, 9)],
        schema,
    )
    known = spark.createDataFrame([("tenant-2",)], "tenant_id string")
    lag = {(r.poll, r.tenant): r.lag for r in telemetry.consumer_lag(rows, known).collect()}
    assert lag == {(1, "unregistered"): 8, (2, "unregistered"): 0, (2, "tenant-2"): 7, (3, "unregistered"): 2}
    active = {(r.poll, r.tenant): r.active_partitions for r in telemetry.active_consumers(rows, known).collect()}
    assert active[(2, "unregistered")] == 2 and active[(2, "tenant-2")] == 1


def test_quantile_edges(spark):
    inf = float("inf")
    rows = spark.createDataFrame(
        [("none", 0.1, 0), ("none", inf, 0), ("over", 0.1, 0), ("over", inf, 5), ("single", inf, 5),
         ("mid", 0.1, 0), ("mid", 0.2, 4), ("mid", inf, 4), ("first", 0.1, 4), ("first", inf, 4)],
        "s string, le double, value bigint",
    )
    got = {r.s: r.p for r in telemetry.histogram_quantile(rows, ["s"], {"p": 0.5}).collect()}
    assert got["none"] is None and got["over"] == 0.1 and got["single"] is None
    assert abs(got["mid"] - 0.15) < 1e-12 and abs(got["first"] - 0.05) < 1e-12


def test_counter_reset_inside_the_window(spark):
    at = datetime(2026, 1, 1)
    rows = spark.createDataFrame(
        [("s", at + timedelta(seconds=10 * i), float(v)) for i, v in enumerate([5, 9, 2, 4])],
        "s string, ts timestamp, value double",
    )
    got = [r.increase for r in telemetry.counter_increase(rows, ["s"], 25).orderBy("ts").collect()]
    assert got == [None, 4.0, 6.0, 4.0]
    assert [r.increase for r in telemetry.counter_increase(rows, ["s"], 60).orderBy("ts").collect()][-1] == 8.0
    stretched = telemetry.counter_increase(rows, ["s"], 60, extrapolate=True).orderBy("ts").collect()
    assert stretched[-1].increase > 8.0


def test_instant_value(spark):
    at = datetime(2026, 1, 1)
    rows = spark.createDataFrame(
        [("a", "x", at, 41.0), ("a", "x", at + timedelta(seconds=1), 42.0), ("b", "x", at, 1.0),
         ("b", "y", at, 2.0), ("c", "x", at, 1e30), ("d", "x", at, 0.1235), ("e", "x", at, float("nan"))],
        "tenant_id string, pod string, ts timestamp, value double",
    )
    got = {r.tenant_id: (r.value, r.problem) for r in telemetry.instant_value(
        rows, ["tenant_id", "pod"], ["tenant_id"], -(2**31), 2**31 - 1, 1000.0).collect()}
    assert got["a"] == (42000, None) and got["d"] == (124, None)
    assert got["b"][0] is None and got["c"][0] is None and got["e"][0] is None
