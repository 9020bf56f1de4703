"""Queries over calls and samples: roll-ups, look-backs, tenant decisions, alerts."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators import control, limits, telemetry
from ledgerloom.plans import sqltext as S, views as V
from ledgerloom.session import scratch_folder
from ledgerloom.plans.registry import ORACLES, query
from ledgerloom.sources import samples as metric_source

QUANTILES = {"p50": 0.5, "p99": 0.99}


def _us(name: str, alias: str | None = None):
    return F.unix_micros(name).alias(alias or f"{name}_us")


# --- roll-ups of calls -------------------------------------------------------------------


@query(
    "outcome_counts",
    f"""with {S.CALLS} select tenant_id, o.outcome, count(*) filter (where c.outcome = o.outcome) as calls
    from call_log c, (values ('success'), ('failure')) o(outcome) group by 1, 2""",
)
def outcome_counts(spark, sf):
    return telemetry.outcome_counts(V.call_log(spark, sf), ["tenant_id"])


@query(
    "tenant_label",
    f"""with {S.DELIVERIES}, known as (
      select distinct concat('tenant-', cast(s_suppkey % 20 as varchar)) as tenant_id
      from supplier where s_acctbal > 5000)
    select case when tenant_id in (select tenant_id from known) then tenant_id else 'unregistered' end as tenant,
      count(*) as deliveries from trade_deliveries group by 1""",
)
def tenant_label(spark, sf):
    per_tenant = V.trade_deliveries(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("n"))
    return telemetry.tenant_label(per_tenant, V.known_tenants(spark, sf)).groupBy("tenant").agg(
        F.sum("n").alias("deliveries")
    )


@query(
    "latency_histogram",
    f"""with {S.CALLS} {S.bucket_rows('call_log', 'tenant_id, outcome', S.BOUNDS, 'buckets')}
    select tenant_id, outcome, le, bucket, observations, sum_us from buckets""",
)
def latency_histogram(spark, sf):
    return telemetry.latency_histogram(V.call_log(spark, sf), ["tenant_id", "outcome"])


@query(
    "histogram_quantile",
    f"""with {S.CALLS} {S.bucket_rows('call_log', 'tenant_id, outcome', S.WIDE_BOUNDS, 'buckets')}
    {S.quantile_rows('buckets', 'tenant_id, outcome', 'bucket', 'quantiles')}
    select tenant_id, outcome, p50, p99 from quantiles""",
)
def histogram_quantile(spark, sf):
    by = ["tenant_id", "outcome"]
    buckets = telemetry.latency_histogram(V.call_log(spark, sf), by, V.WIDE_BOUNDS_US)
    return telemetry.histogram_quantile(buckets, by, QUANTILES, "bucket")


@query(
    "histogram_quantile_overflow",
    f"""with {S.CALLS} {S.bucket_rows('call_log', 'tenant_id', S.BOUNDS, 'buckets')}
    {S.quantile_rows('buckets', 'tenant_id', 'bucket', 'quantiles')}
    select tenant_id, p50, p99 from quantiles""",
)
def histogram_quantile_overflow(spark, sf):
    """The usual bounds end at 0.1 s, so a slower 99th percentile reads as 0.1 s."""
    buckets = telemetry.latency_histogram(V.call_log(spark, sf), ["tenant_id"])
    return telemetry.histogram_quantile(buckets, ["tenant_id"], QUANTILES, "bucket")


@query(
    "exact_quantile",
    f"""with {S.CALLS} select tenant_id, outcome, count(*) as observations,
      quantile_disc(latency_us, 0.5) as p50_us, quantile_disc(latency_us, 0.99) as p99_us
    from call_log group by 1, 2""",
)
def exact_quantile(spark, sf):
    return telemetry.exact_quantile(
        V.call_log(spark, sf), ["tenant_id", "outcome"], {"p50_us": 0.5, "p99_us": 0.99}
    )


@query(
    "consumer_lag",
    f"""with {S.POLLS} select poll, tenant, cast(arg_max(lag, "partition") as bigint) as lag,
      cast(sum(lag) as bigint) as lag_sum, cast(max(lag) as bigint) as lag_max
    from labelled group by poll, tenant""",
)
def consumer_lag(spark, sf):
    return telemetry.consumer_lag(V.polls(spark, sf), V.known_tenants(spark, sf))


@query(
    "active_consumers",
    f"""with {S.POLLS} select poll, tenant, count(*) as active_partitions from labelled group by 1, 2""",
)
def active_consumers(spark, sf):
    return telemetry.active_consumers(V.polls(spark, sf), V.known_tenants(spark, sf))


@query(
    "lag_panel",
    f"""with {S.POLLS}, gauge as (select poll, tenant, cast(arg_max(lag, "partition") as bigint) as lag
      from labelled group by poll, tenant)
    select tenant, max(poll) as poll, arg_max(lag, poll) as lag from gauge group by tenant""",
)
def lag_panel(spark, sf):
    return telemetry.lag_panel(consumer_lag(spark, sf))


@query(
    "consumers_panel",
    f"""with {S.POLLS}, gauge as (select poll, tenant, count(*) as n from labelled group by 1, 2)
    select tenant, max(poll) as poll, arg_max(n, poll) as active_partitions from gauge group by tenant""",
)
def consumers_panel(spark, sf):
    return telemetry.consumers_panel(active_consumers(spark, sf))


# --- look-backs over samples -------------------------------------------------------------


@query(
    "read_metric_samples",
    f"""with {S.BUCKET_SAMPLES} select tenant_id, outcome, count(*) as samples,
      cast(max(value) as bigint) as highest from bucket_samples
    where le = 'infinity'::double group by 1, 2""",
)
def read_metric_samples(spark, sf):
    """One metric out of the long sample table, its labels as columns."""
    folder = scratch_folder(spark, "samples") + "/rows"
    V.metric_samples(spark, sf).write.parquet(folder)
    series = metric_source.series_of(
        metric_source.read_metric_samples(spark, folder), "processor_transaction_duration_seconds_bucket",
        {"tenant_id": "tenant", "outcome": "outcome", "le": "le"},
    )
    return series.where("le = 'Infinity'").groupBy("tenant_id", "outcome").agg(
        F.count("*").alias("samples"), F.max("value").cast("bigint").alias("highest")
    )


@query(
    "instant_value",
    f"""with {S.OUTCOME_SAMPLES}, latest as (select tenant_id, outcome, arg_max(value, ts) as value
      from outcome_samples group by 1, 2)
    select tenant_id, case when count(*) = 1 then cast(round(max(value)) as bigint) end as value,
      case when count(*) > 1 then 'several series matched' end as problem
    from latest where outcome = 'failure' or tenant_id in ('tenant-1', 'tenant-3') group by tenant_id""",
)
def instant_value(spark, sf):
    """Latest failure counter; for two tenants the matcher lets a second series through."""
    matched = (F.col("outcome") == "failure") | F.col("tenant_id").isin("tenant-1", "tenant-3")
    return telemetry.instant_value(
        V.outcome_samples(spark, sf).where(matched), ["tenant_id", "outcome"], ["tenant_id"],
        -(2**31), 2**31 - 1,
    )


@query(
    "counter_increase",
    f"""with {S.OUTCOME_SAMPLES} {S.increases('outcome_samples', 'tenant_id, outcome', 21600, 'grown')}
    select tenant_id, outcome, epoch_us(ts) as ts_us, cast(value as bigint) as value,
      cast(increase as bigint) as increase from grown""",
)
def counter_increase(spark, sf):
    rows = telemetry.counter_increase(V.outcome_samples(spark, sf), ["tenant_id", "outcome"], 21600)
    return rows.select(
        "tenant_id", "outcome", _us("ts"), F.col("value").cast("bigint").alias("value"),
        F.col("increase").cast("bigint").alias("increase"),
    )


@query(
    "counter_rate",
    f"""with {S.OUTCOME_SAMPLES} {S.increases('outcome_samples', 'tenant_id, outcome', 86400, 'grown')}
    select tenant_id, outcome, epoch_us(ts) as ts_us, increase / 86400.0::double as rate from grown""",
)
def counter_rate(spark, sf):
    rows = telemetry.counter_rate(V.outcome_samples(spark, sf), ["tenant_id", "outcome"], 86400)
    return rows.select("tenant_id", "outcome", _us("ts"), "rate")


@query(
    "throughput_panel",
    f"""with {S.OUTCOME_SAMPLES} {S.increases('outcome_samples', 'tenant_id, outcome', 21600, 'grown')}
    select epoch_us(ts) as ts_us, outcome, cast(sum(increase) as bigint) as increase,
      cast(sum(increase) as bigint) / 21600.0::double as rate from grown group by ts, outcome""",
)
def throughput_panel(spark, sf):
    rows = telemetry.throughput_panel(V.outcome_samples(spark, sf), 21600)
    return rows.select(_us("ts"), "outcome", "increase", "rate")


@query(
    "latency_panel",
    f"""with {S.BUCKET_SAMPLES} {S.increases('bucket_samples', 'tenant_id, outcome, le', 86400, 'grown')},
    seen as (select * from grown where increase is not null)
    {S.quantile_rows('seen', 'ts, tenant_id, outcome', 'increase', 'quantiles')}
    select epoch_us(ts) as ts_us, tenant_id, outcome, p50, p99 from quantiles""",
)
def latency_panel(spark, sf):
    rows = telemetry.latency_panel(
        V.bucket_samples(spark, sf), ["tenant_id", "outcome"], ["tenant_id", "outcome"], 86400,
        QUANTILES,
    )
    return rows.select(_us("ts"), "tenant_id", "outcome", "p50", "p99")


@query(
    "breaker_state_value",
    """select event_type as state, case event_type when 'closed' then 0 when 'half_open' then 1
      when 'open' then 2 else 3 end::bigint as value, count(*) as calls
    from (select case event_type when 'view' then 'closed' when 'click' then 'half_open'
      when 'error' then 'open' else event_type end as event_type from events) e group by 1, 2""",
)
def breaker_state_value(spark, sf):
    kind = F.col("event_type")
    state = (
        F.when(kind == "view", "closed").when(kind == "click", "half_open")
        .when(kind == "error", "open").otherwise(kind)
    )
    rows = V.call_log(spark, sf).groupBy(state.alias("state")).agg(F.count("*").alias("calls"))
    return rows.select("state", telemetry.breaker_state_value(F.col("state")).alias("value"), "calls")


@query(
    "breaker_panel",
    f"""with {S.BREAKERS} select dependency, arg_max(state, ts) as state,
      count(*) filter (where state = 0) as closed_samples,
      count(*) filter (where state = 1) as half_open_samples,
      count(*) filter (where state = 2) as open_samples from breaker_samples group by 1""",
)
def breaker_panel(spark, sf):
    return telemetry.breaker_panel(V.breaker_samples(spark, sf))


# --- tenant decisions --------------------------------------------------------------------


def _decision_rows(spark, sf) -> DataFrame:
    return V.signals(spark, sf).join(V.tenant_spec(spark), "tenant_id").withColumns(
        {
            "baseline": control.baseline_replicas(
                (F.dayofmonth("observed_at") % 8).cast("int"), F.col("min_replicas")
            ),
            "latched": F.dayofmonth("observed_at") % 5 == 0,
        }
    )


@query(
    "classify_tenants",
    f"""with {S.SIGNALS}, rows as (
      select g.*, s.*, greatest(day(observed_at) % 8, min_replicas) as baseline,
        day(observed_at) % 5 = 0 as latched, lag > kafka_lag_threshold as lag_high,
        p99_ms > p99_latency_threshold_ms as p99_high
      from signals g join specs s on s.tenant_id = g.tenant_id)
    select tenant_id, epoch_us(observed_at) as observed_at_us, cast(baseline as bigint) as baseline,
      case when lag_high and p99_high then 'Scaling'
        when lag_high and baseline < partition_count then 'Scaling' when lag_high then 'Isolated'
        when p99_high then 'Degraded' when latched then 'Isolated' else 'Stable' end as state,
      cast(case when lag_high and p99_high then max_replicas
        when lag_high and baseline < partition_count
          then least(greatest(least(max_replicas, partition_count), min_replicas), max_replicas)
        else baseline end as bigint) as replicas,
      lag_high and not p99_high and baseline >= partition_count as sets_latch
    from rows""",
)
def classify_tenants(spark, sf):
    return control.classify_tenants(_decision_rows(spark, sf)).select(
        "tenant_id", _us("observed_at"), F.col("baseline").cast("bigint").alias("baseline"),
        "state", F.col("replicas").cast("bigint").alias("replicas"), "sets_latch",
    )


@query(
    "baseline_replicas",
    f"""with {S.SIGNALS} select g.tenant_id, epoch_us(observed_at) as observed_at_us,
      cast(greatest(day(observed_at) % 8, min_replicas) as bigint) as baseline
    from signals g join specs s on s.tenant_id = g.tenant_id""",
)
def baseline_replicas(spark, sf):
    return _decision_rows(spark, sf).select(
        "tenant_id", _us("observed_at"), F.col("baseline").cast("bigint").alias("baseline")
    )


@query(
    "join_spec_signals",
    f"""with {S.SIGNALS}, latest as (
      select tenant_id, arg_max(lag, observed_at) as lag, arg_max(p99_ms, observed_at) as p99_ms,
        arg_max(partition_count, observed_at) as partition_count from signals group by 1),
    more as (select tenant_id, min_replicas from specs union all select 'tenant-9', 1)
    select m.tenant_id, cast(min_replicas as bigint) as min_replicas, lag, p99_ms, partition_count,
      case when l.tenant_id is null then
        'lag: no series matched; p99_ms: no series matched; partition_count: no series matched'
      else '' end as missing
    from more m left join latest l on l.tenant_id = m.tenant_id""",
)
def join_spec_signals(spark, sf):
    """Latest signals per spec; one tenant has a spec and no signals."""
    extra = spark.createDataFrame([("tenant-9", 1, 2, 10, 10)], V.tenant_spec(spark).schema)
    rows = V.signals(spark, sf)

    def latest(name):
        one = rows.groupBy("tenant_id").agg(F.max_by(name, "observed_at").alias("value"))
        return one.withColumn("problem", F.lit(None).cast("string"))

    joined = control.join_spec_signals(
        V.tenant_spec(spark).unionByName(extra), lag=latest("lag"), p99_ms=latest("p99_ms"),
        partition_count=latest("partition_count"),
    )
    return joined.select(
        "tenant_id", F.col("min_replicas").cast("bigint").alias("min_replicas"), "lag",
        F.col("p99_ms").cast("bigint").alias("p99_ms"),
        F.col("partition_count").cast("bigint").alias("partition_count"), "missing",
    )


def _history(spark, sf) -> DataFrame:
    return control.tenant_status_history(
        V.signals(spark, sf), V.tenant_spec(spark), V.resets(spark, sf)
    )


@query(
    "tenant_status_history",
    f"""with recursive {S.HISTORY} select tenant_id, epoch_us(observed_at) as observed_at_us,
      baseline, state, replicas, latched, latched_after from steps""",
)
def tenant_status_history(spark, sf):
    return _history(spark, sf).select(
        "tenant_id", _us("observed_at"), F.col("baseline").cast("bigint").alias("baseline"), "state",
        F.col("replicas").cast("bigint").alias("replicas"), "latched", "latched_after",
    )


@query(
    "tenant_status_history_specs",
    f"""with recursive {S.CHANGING_HISTORY} select tenant_id, epoch_us(observed_at) as observed_at_us,
      baseline, state, replicas, latched, latched_after from steps""",
)
def tenant_status_history_specs(spark, sf):
    """Every tenant's spec changes half way, and the change is in the table more than once."""
    rows = control.tenant_status_history(
        V.signals(spark, sf), V.tenant_spec_history(spark, sf), V.resets(spark, sf)
    )
    return rows.select(
        "tenant_id", _us("observed_at"), F.col("baseline").cast("bigint").alias("baseline"), "state",
        F.col("replicas").cast("bigint").alias("replicas"), "latched", "latched_after",
    )


@query(
    "isolation_latch",
    f"""with recursive {S.HISTORY} select tenant_id, epoch_us(observed_at) as observed_at_us,
      latched_after as latched from steps""",
)
def isolation_latch(spark, sf):
    marks = V.resets(spark, sf).withColumn("clears", F.lit(True))
    rows = _history(spark, sf).select("tenant_id", "observed_at", "sets_latch").join(
        marks, ["tenant_id", "observed_at"], "left"
    ).withColumn("clears", F.coalesce("clears", F.lit(False)))
    return control.isolation_latch(rows, "sets_latch", "clears").select(
        "tenant_id", _us("observed_at"), "latched"
    )


@query(
    "state_transitions",
    f"""with recursive {S.TRANSITIONS} select tenant_id, epoch_us(observed_at) as observed_at_us,
      transition, old_state,
      case when transition in ('Isolated', 'Degraded') then 'Warning' else 'Normal' end as severity
    from transitions""",
)
def state_transitions(spark, sf):
    return control.state_transitions(_history(spark, sf)).select(
        "tenant_id", _us("observed_at"), "transition", "old_state", "severity"
    )


@query(
    "transition_severity",
    f"""with recursive {S.TRANSITIONS} select
      case when transition in ('Isolated', 'Degraded') then 'Warning' else 'Normal' end as severity,
      count(*) as transitions from transitions group by 1""",
)
def transition_severity(spark, sf):
    return control.state_transitions(_history(spark, sf)).groupBy("severity").agg(
        F.count("*").alias("transitions")
    )


@query(
    "transition_counts",
    f"""with recursive {S.TRANSITIONS} select n.transition, count(t.transition) as transitions
    from (values ('Stable'), ('Scaling'), ('Isolated'), ('Degraded'), ('DedicatedPoolCreated'),
      ('DedicatedPoolProvisioned'), ('DedicatedPoolTornDown')) n(transition)
    left join transitions t on t.transition = n.transition group by 1""",
)
def transition_counts(spark, sf):
    return control.transition_counts(control.state_transitions(_history(spark, sf)))


@query(
    "transitions_panel",
    f"""with recursive {S.TRANSITIONS} select transition, epoch_us(observed_at) as observed_at_us,
      count(*) as transitions, count(*) / 86400.0::double as rate from transitions group by 1, 2""",
)
def transitions_panel(spark, sf):
    per_day = control.state_transitions(_history(spark, sf)).groupBy("transition", "observed_at").agg(
        F.count("*").alias("transitions")
    )
    return per_day.select(
        "transition", _us("observed_at"), "transitions", (F.col("transitions") / 86400.0).alias("rate")
    )


ALERTS = f"""{S.TRANSITIONS},
rules(alert, transition, look_s, limit_n, hold_s, severity) as (values
  ('TenantScalingEvent', 'Scaling', 300, 0, 60, 'info'),
  ('TenantAtMaxReplicasWithGrowingLag', 'Scaling', 900, 2, 300, 'warning'),
  ('TenantIsolatedNoisyNeighborSuspected', 'Isolated', 300, 0, 60, 'warning'),
  ('TenantDegradedDownstreamBottleneck', 'Degraded', 300, 0, 60, 'warning')),
spots as (select distinct r.alert, r.transition, r.look_s, r.limit_n, r.hold_s, r.severity,
    t.observed_at + to_seconds(30 * k) as tick
  from transitions t join rules r on r.transition = t.transition, range(0, 30) g(k)
  where 30 * k < r.look_s),
grown as (select s.*, (select count(*) from transitions t where t.transition = s.transition
    and t.observed_at <= s.tick and t.observed_at > s.tick - to_seconds(s.look_s)) as increase from spots s),
high as (select *, row_number() over (partition by alert order by tick) as rn from grown where increase > limit_n),
runs as (select *, min(tick) over (partition by alert, epoch_us(tick) // 30000000 - rn) as since from high)"""


@query(
    "alert_rules",
    f"""with recursive {ALERTS} select alert, severity, epoch_us(tick) as ts_us, epoch_us(since) as since_us,
      increase, case when epoch_us(tick) - epoch_us(since) >= hold_s * 1000000 then 'firing' else 'pending' end as state
    from runs""",
)
def alert_rules(spark, sf):
    alerts = control.alert_rules(control.state_transitions(_history(spark, sf)))
    return alerts.select("alert", "severity", _us("ts"), _us("since"), "increase", "state")


@query(
    "lag_growing",
    f"""with {S.SIGNALS}, up as (select *, lag > lag(lag) over w as rising,
      lag(lag) over w > lag(lag, 2) over w as before
      from signals window w as (partition by tenant_id order by observed_at))
    select tenant_id, epoch_us(observed_at) as observed_at_us, lag from up where rising and before""",
)
def lag_growing(spark, sf):
    return control.lag_growing(V.signals(spark, sf), 2).select("tenant_id", _us("observed_at"), "lag")


@query(
    "p99_breach",
    f"""with {S.SIGNALS}, rows as (select g.*, p99_ms > p99_latency_threshold_ms as breach
      from signals g join specs s on s.tenant_id = g.tenant_id),
    runs as (select *, count(*) filter (where not breach) over (partition by tenant_id order by observed_at) as run
      from rows),
    held as (select *, min(observed_at) over (partition by tenant_id, run) as since from runs where breach)
    select tenant_id, epoch_us(observed_at) as ts_us, epoch_us(since) as since_us, p99_ms,
      case when observed_at - since >= interval 1 day then 'firing' else 'pending' end as state from held""",
)
def p99_breach(spark, sf):
    rows = control.p99_breach(V.signals(spark, sf), V.tenant_spec(spark), 86400)
    return rows.select(
        "tenant_id", _us("ts"), _us("since"), F.col("p99_ms").cast("bigint").alias("p99_ms"), "state"
    )


@query(
    "breaker_open_too_long",
    f"""with {S.BREAKERS}, runs as (select *, count(*) filter (where state <> 2)
      over (partition by dependency order by ts) as run from breaker_samples),
    held as (select *, min(ts) over (partition by dependency, run) as since from runs where state = 2)
    select dependency, epoch_us(ts) as ts_us, epoch_us(since) as since_us from held
    where ts - since >= interval 2 hour""",
)
def breaker_open_too_long(spark, sf):
    rows = control.breaker_open_too_long(V.breaker_samples(spark, sf), 7200)
    return rows.select("dependency", _us("ts"), _us("since"))


@query(
    "partition_skew",
    f"""with {S.TRADES} {S.ranges(0, 2, 'ranges')},
    placed as (select t.tenant_id, date_trunc('year', occurred_at) as bucket,
        {S.partition_of('ranges', 't')} as part
      from trades t left join ranges x on x.tenant_id = t.tenant_id),
    per_part as (select tenant_id, bucket, part, count(*) as n from placed group by 1, 2, 3),
    per_bucket as (select tenant_id, bucket, cast(sum(n) as bigint) as messages, count(*) as partitions,
      max(n) as hottest, arg_max(part, n * 1000 + part) as hot_partition from per_part group by 1, 2)
    select tenant_id, epoch_us(bucket) as bucket_us, messages, partitions, hot_partition,
      hottest / messages as hot_share,
      messages / lag(messages) over (partition by tenant_id order by bucket) as growth,
      case when partitions > 1 and hottest / messages > 0.5 then 'key skew' else 'even' end as verdict
    from per_bucket""",
)
def partition_skew(spark, sf):
    rows = control.partition_skew(
        V.placed(V.trades(spark, sf), spark, sf), F.date_trunc("year", "occurred_at")
    )
    return rows.withColumn("bucket", F.unix_micros("bucket")).withColumnRenamed("bucket", "bucket_us")


@query(
    "tenant_baseline_change",
    f"""with {S.CALLS}, daily as (select tenant_id, cast(ts as date) as day, count(*) as events
      from call_log group by 1, 2),
    past as (select d.tenant_id, d.day, d.events, count(p.events) as past_days,
        coalesce(cast(sum(p.events) as bigint), 0) as past_events
      from daily d left join daily p on p.tenant_id = d.tenant_id and p.day < d.day and p.day >= d.day - 30
      group by 1, 2, 3)
    select tenant_id, cast(date_diff('day', date '1970-01-01', day) as bigint) as day_no, events, past_days,
      past_events, (events * past_days) / nullif(past_events, 0) as change from past""",
)
def tenant_baseline_change(spark, sf):
    rows = control.tenant_baseline_change(V.call_log(spark, sf), "ts")
    return rows.select(
        "tenant_id", F.unix_date("day").cast("bigint").alias("day_no"), "events", "past_days",
        "past_events", "change",
    )


@query(
    "at_max_replicas",
    f"""with recursive {S.HISTORY}, up as (select *, lag > lag(lag) over w as rising
      from steps window w as (partition by tenant_id order by observed_at))
    select tenant_id, epoch_us(observed_at) as observed_at_us, lag, replicas, partition_count,
      case when partition_count <= max_replicas then 'partition-bound' else 'raiseable' end as verdict
    from up where rising and replicas >= max_replicas""",
)
def at_max_replicas(spark, sf):
    rows = control.at_max_replicas(_history(spark, sf), 1)
    return rows.select(
        "tenant_id", _us("observed_at"), "lag", F.col("replicas").cast("bigint").alias("replicas"),
        F.col("partition_count").cast("bigint").alias("partition_count"), "verdict",
    )


# --- request-path controls ---------------------------------------------------------------


@query(
    "rate_limit_verdicts",
    f"""with recursive {S.CALLS}, n as (select tenant_id as key, call_id, epoch_us(ts) as t,
      row_number() over (partition by tenant_id order by ts, call_id) as rn from call_log),
    walk as (select key, call_id, t, rn, cast(2000000000 as bigint) as tokens, true as allowed
      from n where rn = 1
      union all
      select key, call_id, t, rn, case when filled >= 1000000000 then filled - 1000000000 else filled end,
        filled >= 1000000000
      from (select n.*, least(3000000000, w.tokens + (n.t - w.t)) as filled
        from walk w join n on n.key = w.key and n.rn = w.rn + 1) x)
    select key, call_id, t as ts_us, allowed from walk""",
)
def rate_limit_verdicts(spark, sf):
    """A thousandth of a call per second and tenant, bursts of three."""
    return limits.rate_limit_verdicts(_limited_calls(spark, sf), Fraction(1, 1000), 3)


def _limited_calls(spark, sf) -> DataFrame:
    return V.call_log(spark, sf).select(
        F.col("tenant_id").alias("key"), F.unix_micros("ts").alias("ts_us"), "call_id"
    )


@query("rate_limit_segmented", ORACLES["rate_limit_verdicts"])
def rate_limit_segmented(spark, sf):
    """The same verdicts by the path of long keys, several segments per tenant."""
    return limits.rate_limit_verdicts(
        _limited_calls(spark, sf), Fraction(1, 1000), 3, segment_rows=200
    )


@query(
    "rate_limit_one_second",
    f"""with recursive {S.CALLS}, n as (select tenant_id as key, call_id, epoch_us(ts) % 1000 as t,
      row_number() over (partition by tenant_id order by epoch_us(ts) % 1000, call_id) as rn from call_log),
    walk as (select key, call_id, t, rn, cast(2000000 as bigint) as tokens, true as allowed from n where rn = 1
      union all
      select key, call_id, t, rn, case when filled >= 1000000 then filled - 1000000 else filled end,
        filled >= 1000000
      from (select n.*, least(3000000, w.tokens + 20000 * (n.t - w.t)) as filled
        from walk w join n on n.key = w.key and n.rn = w.rn + 1) x)
    select key, call_id, t as ts_us, allowed from walk""",
)
def rate_limit_one_second(spark, sf):
    """All calls of a tenant in one millisecond, in segments by rank: twenty thousand calls a second, bursts of three."""
    calls = _limited_calls(spark, sf).withColumn("ts_us", F.col("ts_us") % 1000)
    return limits.rate_limit_verdicts(calls, 20_000, 3, segment_rows=200)


@query(
    "outage_intervals",
    f"""with {S.BREAKERS}, starts as (select *, case when state is distinct from
        lag(state) over (partition by dependency order by ts) then 1 else 0 end as s from breaker_samples),
    runs as (select *, cast(sum(s) over (partition by dependency order by ts) as bigint) as run from starts),
    spans as (select dependency, run, min(state) as state, min(ts) as started_at, max(ts) as last_seen,
      count(*) as samples from runs group by 1, 2),
    ended as (select *, lead(started_at) over (partition by dependency order by run) as ended_at from spans)
    select dependency, run, state, epoch_us(started_at) as started_at_us, epoch_us(ended_at) as ended_at_us,
      samples, epoch_us(coalesce(ended_at, last_seen)) - epoch_us(started_at) as duration_us from ended""",
)
def outage_intervals(spark, sf):
    rows = limits.outage_intervals(V.breaker_samples(spark, sf))
    return rows.select(
        "dependency", "run", "state", _us("started_at"), _us("ended_at"), "samples", "duration_us"
    )


@query(
    "failure_streaks",
    f"""with {S.BREAKERS}, counted as (select *, count(*) filter (where outcome = 'success')
      over (partition by dependency order by ts, call_id) as run
      from dependency_calls where outcome <> 'duplicate')
    select dependency, epoch_us(min(ts)) as started_at_us, epoch_us(max(ts)) as last_failure_at_us,
      count(*) as failures from counted where outcome = 'failure' group by dependency, run having count(*) >= 3""",
)
def failure_streaks(spark, sf):
    rows = limits.failure_streaks(V.dependency_calls(spark, sf), 3)
    return rows.select("dependency", _us("started_at"), _us("last_failure_at"), "failures")
