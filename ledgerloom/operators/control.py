"""Tenant decisions: classify, keep history, report transitions, raise alerts.

The history looks sequential (this decision's replicas are the next one's
baseline, and the spec may change between them) but has a closed form. Whatever
spec is in force, a snapshot sets the replicas to one value if they are below a
threshold and else leaves them: below the minimum to the minimum, below the
partition count to the headroom target, below anything to the maximum. Such
steps are closed under composition, so the replicas before each snapshot are a
parallel prefix over pairs (``operators/prefix.py``), and the isolation latch
compares the last place that set it with the last one that cleared it. A tenant
is cut into segments of bounded length for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.operators.prefix import before_each, last_places, segmented, step_below
from ledgerloom.session import cut_lineage

# States and the other transition names, in reporting order.
STABLE, SCALING, ISOLATED, DEGRADED = "Stable", "Scaling", "Isolated", "Degraded"
POOL_CREATED = "DedicatedPoolCreated"
POOL_PROVISIONED = "DedicatedPoolProvisioned"
POOL_TORN_DOWN = "DedicatedPoolTornDown"
TRANSITIONS = [
    STABLE, SCALING, ISOLATED, DEGRADED, POOL_CREATED, POOL_PROVISIONED, POOL_TORN_DOWN,
]

# Alert name, transition counted, look-back s, threshold, hold s, severity.
ALERT_RULES = [
    ("TenantScalingEvent", SCALING, 300, 0, 60, "info"),
    ("TenantAtMaxReplicasWithGrowingLag", SCALING, 900, 2, 300, "warning"),
    ("TenantIsolatedNoisyNeighborSuspected", ISOLATED, 300, 0, 60, "warning"),
    ("TenantDegradedDownstreamBottleneck", DEGRADED, 300, 0, 60, "warning"),
]


def _lag_high() -> Column:
    return F.col("lag") > F.col("kafka_lag_threshold")


def _latency_high() -> Column:
    return F.col("p99_ms") > F.col("p99_latency_threshold_ms")


def baseline_replicas(current: Column, minimum: Column) -> Column:
    """Never below the minimum; deliberately not capped at the maximum."""
    return F.greatest(F.coalesce(current, F.lit(0)), minimum)


def _headroom_target() -> Column:
    wanted = F.least("max_replicas", "partition_count")
    return F.least(F.greatest(wanted, F.col("min_replicas")), F.col("max_replicas"))


def join_spec_signals(specs: DataFrame, **signals: DataFrame) -> DataFrame:
    """Specs with one column per signal frame ``tenant_id, value, problem``.

    ``missing`` lists the signals without a usable value; such a tenant gets no
    decision this round.
    """
    joined = specs
    for name, frame in signals.items():
        one = frame.select(
            "tenant_id",
            F.col("value").alias(name),
            F.coalesce("problem", F.when(F.col("value").isNull(), "no value")).alias(f"_{name}"),
        )
        joined = joined.join(one, "tenant_id", "left")
    problems = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(name).isNull(),
                    F.concat_ws(": ", F.lit(name), F.coalesce(f"_{name}", F.lit("no series matched"))),
                )
                for name in signals
            ]
        )
    )
    return joined.withColumn("missing", F.concat_ws("; ", problems)).drop(
        *[f"_{n}" for n in signals]
    )


def classify_tenants(rows: DataFrame) -> DataFrame:
    """One decision per row: ``state, replicas, sets_latch``.

    Reads the spec columns, ``baseline``, ``latched``, ``lag``, ``p99_ms`` and
    ``partition_count``; both thresholds must be exceeded, not met.
    """
    has_headroom = F.col("baseline") < F.col("partition_count")
    only_lag = _lag_high() & ~_latency_high()
    return rows.withColumns(
        {
            "state": F.when(_lag_high() & _latency_high(), SCALING)
            .when(only_lag & has_headroom, SCALING)
            .when(only_lag, ISOLATED)
            .when(_latency_high(), DEGRADED)
            .when(F.col("latched"), ISOLATED)
            .otherwise(STABLE),
            "replicas": F.when(_lag_high() & _latency_high(), F.col("max_replicas"))
            .when(only_lag & has_headroom, _headroom_target())
            .otherwise(F.col("baseline")),
            "sets_latch": only_lag & ~has_headroom,
        }
    )


def specs_in_force(signals: DataFrame, specs: DataFrame) -> DataFrame:
    """Every snapshot with the spec of its tenant that was in force at ``observed_at``.

    A spec holds from its ``valid_from`` to the next one of the tenant; a null one, or no such column, means from the
    beginning. Of several specs with one ``valid_from`` the greatest counts, by its columns in the order of their
    names. Snapshots before the first spec are left out. ``first_*`` are what the first spec starts with.
    """
    if "valid_from" not in specs.columns:
        specs = specs.withColumn("valid_from", F.lit(None).cast("timestamp"))
    if "current_replicas" not in specs.columns:
        specs = specs.withColumn("current_replicas", F.lit(0))
    if "latched" not in specs.columns:
        specs = specs.withColumn("latched", F.lit(False))
    values = sorted(set(specs.columns) - {"tenant_id", "valid_from"})
    along = Window.partitionBy("tenant_id").orderBy(F.col("valid_from").asc_nulls_first())
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per change of a spec, a small table.
    changes = (
        specs.groupBy("tenant_id", "valid_from")
        .agg(F.max(F.struct(*values)).alias("_spec"))
        .withColumn("_until", F.lead("valid_from").over(along))
        .withColumn("_first", F.first("_spec").over(whole))
        .select(
            "tenant_id", "valid_from", "_until", "_spec.*",
            F.col("_first.current_replicas").alias("first_replicas"), F.col("_first.latched").alias("first_latched"),
        )
        .drop("latched")
    )
    at = F.col("observed_at")
    in_force = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (
        F.col("_until").isNull() | (at < F.col("_until"))
    )
    return signals.join(changes, "tenant_id").where(in_force).drop("valid_from", "_until")


def _replica_step() -> Column:
    """What a snapshot does to the replicas it finds, under its own spec."""
    only_lag = _lag_high() & ~_latency_high()
    minimum, partitions = F.col("min_replicas"), F.col("partition_count")
    room = only_lag & (minimum < partitions)
    return (
        F.when(_lag_high() & _latency_high(), step_below(F.lit(2**62), F.col("max_replicas")))
        .when(room, step_below(partitions, _headroom_target()))
        .otherwise(step_below(minimum, minimum))
    )


def tenant_status_history(
    signals: DataFrame, specs: DataFrame, resets: DataFrame | None = None
) -> DataFrame:
    """Decision after every snapshot of ``signals``, replicas and latch carried forward.

    ``specs`` may change over time, see ``specs_in_force``, and may hold ``current_replicas`` and ``latched``
    to start from. ``resets(tenant_id, observed_at)`` are manual clearings of the latch, in
    force from that snapshot on.
    """
    rows = specs_in_force(signals, specs)
    if resets is None:
        rows = rows.withColumn("_reset", F.lit(False))
    else:
        marks = resets.select("tenant_id", "observed_at").distinct().withColumn("_reset", F.lit(True))
        rows = rows.join(marks, ["tenant_id", "observed_at"], "left").withColumn(
            "_reset", F.coalesce("_reset", F.lit(False))
        )
    keys = ["tenant_id"]
    rows = rows.withColumn("_hour", F.date_trunc("hour", "observed_at")).withColumn("_step", _replica_step())
    # Places, segments and the walk read the rows again.
    rows = segmented(cut_lineage(rows), keys, "_hour", ["observed_at"]).drop("_hour")
    rows = before_each(rows, keys, "_step", "first_replicas", "_before")
    rows = rows.withColumn(
        "baseline", baseline_replicas(F.col("_before"), F.col("min_replicas")).cast("int")
    )
    only_lag = _lag_high() & ~_latency_high()
    sets = only_lag & ~(F.col("baseline") < F.col("partition_count"))
    rows = last_places(rows, keys, {"_set_at": (sets, False), "_reset_at": (F.col("_reset"), True)})
    latched = F.when(F.col("_reset_at").isNull(), F.col("first_latched") | F.col("_set_at").isNotNull()).otherwise(
        # A snapshot that clears the latch may set it again for the next one.
        F.coalesce(F.col("_set_at") >= F.col("_reset_at"), F.lit(False))
    )
    decided = classify_tenants(rows.withColumn("latched", F.coalesce(latched, F.lit(False))))
    return decided.withColumn("latched_after", F.col("latched") | F.col("sets_latch")).drop(
        "_before", "_reset", "_set_at", "_reset_at", "_place", "_segment", "first_replicas", "first_latched"
    )


def isolation_latch(rows: DataFrame, sets: str, resets: str) -> DataFrame:
    """Latch after every snapshot: set once, it holds until a reset row."""
    order = Window.partitionBy("tenant_id").orderBy("observed_at")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    epochs = rows.withColumn("_epoch", F.sum(F.col(resets).cast("int")).over(upto))
    in_epoch = Window.partitionBy("tenant_id", "_epoch").orderBy("observed_at")
    held = F.max(sets).over(in_epoch.rowsBetween(Window.unboundedPreceding, 0))
    return epochs.withColumn("latched", held).drop("_epoch")


def transition_severity(transition: Column) -> Column:
    return F.when(transition.isin(ISOLATED, DEGRADED), "Warning").otherwise("Normal")


def state_transitions(history: DataFrame) -> DataFrame:
    """One row per change: of the state, of the latch, of the dedicated pool.

    The pool follows the latch, so it is provisioned when the latch first holds
    and torn down when a reset lets go of it.
    """
    order = Window.partitionBy("tenant_id").orderBy("observed_at")
    held = F.coalesce(F.lag("latched_after").over(order), F.lit(False))
    rows = history.withColumns({"_held": held, "old_state": F.lag("state").over(order)})
    names = F.array_compact(
        F.array(
            F.when(F.col("sets_latch") & ~F.col("latched"), POOL_CREATED),
            F.when(F.col("latched_after") & ~F.col("_held"), POOL_PROVISIONED),
            F.when(~F.col("latched_after") & F.col("_held"), POOL_TORN_DOWN),
            F.when(~F.col("state").eqNullSafe(F.col("old_state")), F.col("state")),
        )
    )
    return rows.select(
        "tenant_id", "observed_at", F.posexplode(names).alias("step", "transition"),
        F.coalesce("old_state", F.lit("")).alias("old_state"),
    ).withColumn("severity", transition_severity(F.col("transition")))


def transition_counts(transitions: DataFrame) -> DataFrame:
    """All seven transitions, also those that never happened."""
    one = transitions.agg(
        *[F.count(F.when(F.col("transition") == t, 1)).alias(t) for t in TRANSITIONS]
    )
    return one.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("transition"), F.col(t).alias("transitions"))
                    for t in TRANSITIONS
                ]
            )
        ).alias("c")
    ).select("c.*")


def held_for(rows: DataFrame, keys: list[str], condition: str, hold_s: int) -> DataFrame:
    """``state`` of a condition on an evaluation grid: pending, then firing once held long enough.

    ``since`` is the evaluation that started the unbroken run. Rows where the
    condition fails are dropped after they have ended their run.
    """
    order = Window.partitionBy(*keys).orderBy("ts")
    breaks = F.sum((~F.col(condition)).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    runs = rows.withColumn(condition, F.coalesce(condition, F.lit(False))).withColumn("_run", breaks)
    active = runs.where(F.col(condition))
    since = F.min("ts").over(Window.partitionBy(*keys, "_run"))
    held = (F.unix_micros("ts") - F.unix_micros("since")) >= F.lit(hold_s * 1_000_000)
    return active.withColumn("since", since).withColumn(
        "state", F.when(held, "firing").otherwise("pending")
    ).drop("_run")


def alert_rules(
    transitions: DataFrame, grid_s: int = 30, rules: list[tuple] = tuple(ALERT_RULES)
) -> DataFrame:
    """Pending and firing alerts of the transition rules on an evaluation grid.

    Transitions are counted per grid step first. The grid spans the observed
    time; each rule sums its look-back and keeps a run of evaluations over the
    threshold.
    """
    step_us = grid_s * 1_000_000
    at = F.ceil(F.unix_micros("observed_at") / step_us).cast("bigint")
    counted = transitions.groupBy("transition", at.alias("step")).agg(F.count("*").alias("n"))
    table = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("alert"), F.lit(t).alias("transition"),
                    F.lit(look).alias("look_s"), F.lit(limit).alias("limit"),
                    F.lit(hold).alias("hold_s"), F.lit(severity).alias("severity"),
                )
                for name, t, look, limit, hold, severity in rules
            ]
        )
    )
    # A burst matters to the evaluations of its look-back only, so each count
    # is handed to those and the grid needs no empty steps.
    per_rule = counted.withColumn("rule", table).where(
        F.col("rule.transition") == F.col("transition")
    )
    steps = F.explode(
        F.sequence(
            F.col("step"), F.col("step") + F.expr(f"cast(rule.look_s div {grid_s} as bigint)") - 1
        )
    )
    looked = (
        per_rule.select("rule.*", "n", steps.alias("step"))
        .groupBy("alert", "severity", "limit", "hold_s", "step")
        .agg(F.sum("n").alias("increase"))
        .where(F.col("increase") > F.col("limit"))
    )
    order = Window.partitionBy("alert").orderBy("step")
    run = F.col("step") - F.row_number().over(order)
    runs = looked.withColumn("_run", run).withColumn(
        "since_step", F.min("step").over(Window.partitionBy("alert", "_run"))
    )
    held = (F.col("step") - F.col("since_step")) * grid_s >= F.col("hold_s")
    return runs.select(
        "alert", "severity",
        F.timestamp_micros(F.col("step") * step_us).alias("ts"),
        F.timestamp_micros(F.col("since_step") * step_us).alias("since"),
        "increase",
        F.when(held, "firing").otherwise("pending").alias("state"),
    )


def lag_growing(signals: DataFrame, steps: int) -> DataFrame:
    """Snapshots at which a tenant's lag has risen ``steps`` times in a row."""
    order = Window.partitionBy("tenant_id").orderBy("observed_at")
    rising = F.coalesce(F.col("lag") > F.lag("lag").over(order), F.lit(False))
    rows = signals.withColumn("_up", rising.cast("int"))
    recent = F.sum("_up").over(order.rowsBetween(-(steps - 1), 0))
    return rows.withColumn("_recent", recent).where(F.col("_recent") == steps).select(
        "tenant_id", "observed_at", "lag"
    )


def p99_breach(signals: DataFrame, specs: DataFrame, hold_s: int) -> DataFrame:
    """Latency over its threshold, pending until held for ``hold_s``."""
    rows = signals.join(specs, "tenant_id").withColumns(
        {"ts": F.col("observed_at"), "breach": _latency_high()}
    )
    return held_for(rows, ["tenant_id"], "breach", hold_s).select(
        "tenant_id", "ts", "since", "p99_ms", "state"
    )


def breaker_open_too_long(samples: DataFrame, limit_s: int) -> DataFrame:
    """Breakers seen open without a break for at least ``limit_s``."""
    rows = samples.withColumn("is_open", F.col("state") == 2).drop("state")
    return held_for(rows, ["dependency"], "is_open", limit_s).where(
        "state = 'firing'"
    ).select("dependency", "ts", "since")


def partition_skew(
    rows: DataFrame, bucket: Column, concentrated: float = 0.5
) -> DataFrame:
    """Message counts per tenant and time bucket: growth or concentration on one partition.

    ``hot_share`` is the busiest partition's part of the tenant's messages;
    ``growth`` compares with the tenant's previous bucket.
    """
    per_partition = rows.groupBy("tenant_id", bucket.alias("bucket"), "partition").agg(
        F.count("*").alias("n")
    )
    per_bucket = per_partition.groupBy("tenant_id", "bucket").agg(
        F.sum("n").alias("messages"),
        F.count("*").alias("partitions"),
        F.max("n").alias("hottest"),
        F.max_by("partition", F.struct("n", "partition")).alias("hot_partition"),
    )
    order = Window.partitionBy("tenant_id").orderBy("bucket")
    share = F.col("hottest") / F.col("messages")
    return per_bucket.select(
        "tenant_id", "bucket", "messages", "partitions", "hot_partition",
        share.alias("hot_share"),
        (F.col("messages") / F.lag("messages").over(order)).alias("growth"),
        F.when((F.col("partitions") > 1) & (share > concentrated), "key skew")
        .otherwise("even").alias("verdict"),
    )


def tenant_baseline_change(rows: DataFrame, at: str, days: int = 30) -> DataFrame:
    """Daily volume against the mean of the tenant's active days in the ``days`` before."""
    daily = rows.groupBy("tenant_id", F.to_date(at).alias("day")).agg(F.count("*").alias("events"))
    order = Window.partitionBy("tenant_id").orderBy(F.unix_date("day"))
    past = order.rangeBetween(-days, -1)
    total, active = F.sum("events").over(past), F.count("*").over(past)
    return daily.select(
        "tenant_id", "day", "events", active.alias("past_days"),
        F.coalesce(total, F.lit(0)).alias("past_events"),
        (F.col("events") * active / total).alias("change"),
    )


def at_max_replicas(history: DataFrame, steps: int = 2) -> DataFrame:
    """Tenants at their maximum whose lag keeps rising, and whether partitions are the bound."""
    order = Window.partitionBy("tenant_id").orderBy("observed_at")
    rising = F.coalesce(F.col("lag") > F.lag("lag").over(order), F.lit(False)).cast("int")
    rows = history.withColumn("_up", rising)
    recent = F.sum("_up").over(order.rowsBetween(-(steps - 1), 0))
    return (
        rows.withColumn("_recent", recent)
        .where((F.col("replicas") >= F.col("max_replicas")) & (F.col("_recent") == steps))
        .select(
            "tenant_id", "observed_at", "lag", "replicas", "partition_count",
            F.when(F.col("partition_count") <= F.col("max_replicas"), "partition-bound")
            .otherwise("raiseable").alias("verdict"),
        )
    )
