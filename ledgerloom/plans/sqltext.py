"""SQL views the oracle statements start from, in DuckDB's dialect."""

DELIVERIES = """
trade_deliveries as (
  select l_orderkey*8+l_linenumber as id,
    concat(substr(m,1,8),'-',substr(m,9,4),'-',substr(m,13,4),'-',substr(m,17,4),'-',substr(m,21,12)) as event_id,
    concat('tenant-',cast(l_suppkey%20 as varchar)) as tenant_id,
    concat('P',cast(l_partkey%50 as varchar)) as instrument,
    case when l_returnflag='R' or l_linenumber%2=0 then 'SELL' else 'BUY' end as side,
    cast(l_quantity as bigint)*100000000 as quantity,
    cast(round(l_extendedprice*100) as bigint)*1000000 as price,
    'USD' as currency, l_shipdate as occurred_at, l_partkey, l_suppkey
  from (select *, md5(concat(cast(l_orderkey as varchar),'-',cast(l_linenumber as varchar))) as m
        from lineitem) q)
"""

TRADES = (
    DELIVERIES
    + """,
trades as (
  select id,event_id,tenant_id,instrument,side,quantity,price,currency,occurred_at from (
    select d.*, row_number() over (partition by event_id
           order by occurred_at,l_partkey,l_suppkey,side,quantity,price) as rn
    from trade_deliveries d) r where rn=1)
"""
)


def amount_text(value: str) -> str:
    return (
        f"concat(cast({value} // 100000000 as varchar), '.', "
        f"lpad(cast({value} % 100000000 as varchar), 8, '0'))"
    )


def fnv(value: str) -> str:
    """32-bit FNV-1a of an ASCII text."""
    return (
        f"list_reduce(list_transform(string_split({value}, ''), lambda c: cast(ord(c) as bigint)), "
        "lambda h, b: (xor(h, b) * 16777619) & 4294967295, cast(2166136261 as bigint))"
    )


TIME_TEXT = "strftime(occurred_at, '%Y-%m-%dT%H:%M:%SZ')"

# Why a record of the wire view cannot be decoded, by its defect.
DECODE_REASON = """
case id % 97
  when 1 then 'decode transaction event: unmarshal payload'
  when 8 then 'decode transaction event: unmarshal payload'
  when 10 then 'decode transaction event: unmarshal payload'
  when 2 then 'decode transaction event: parse event id'
  when 3 then 'decode transaction event: parse quantity: amount "x" is not a valid decimal number'
  when 13 then 'decode transaction event: parse quantity: amount "0.000000001" has more than 8 fractional digits'
  when 4 then 'decode transaction event: parse price: amount "x" is not a valid decimal number'
  when 12 then 'decode transaction event: parse price: amount "1e400" is out of range'
  when 5 then 'decode transaction event: parse occurred_at'
end
"""

CHECK_REASON = """
case id % 97
  when 6 then 'reconcile: insert transaction: transactions_side_check'
  when 7 then 'reconcile: insert transaction: transactions_quantity_check'
end
"""

REST_ERROR = """
case id % 97
  when 1 then 'invalid request body'
  when 10 then 'invalid request body'
  when 8 then 'invalid request body: trailing data'
  when 2 then 'event_id must be a valid UUID'
  when 15 then 'instrument must be 1-16 uppercase letters, digits, or dots'
  when 6 then 'side must be "BUY" or "SELL"'
  when 3 then 'quantity must be a positive decimal number no greater than 10000000000.00000000'
  when 7 then 'quantity must be a positive decimal number no greater than 10000000000.00000000'
  when 13 then 'quantity must be a positive decimal number no greater than 10000000000.00000000'
  when 4 then 'price must be a positive decimal number no greater than 10000000000.00000000'
  when 12 then 'price must be a positive decimal number no greater than 10000000000.00000000'
  when 16 then 'currency must be a 3-letter uppercase ISO 4217 code'
  when 5 then 'occurred_at must be an RFC3339 timestamp'
end
"""

TYPED_ERROR = """
case id % 97
  when 5 then 'missing required fields'
  when 18 then 'missing required fields'
  when 2 then 'event_id must be a valid UUID'
  when 15 then 'instrument must be 1-16 uppercase letters, digits, or dots'
  when 6 then 'side must be SIDE_BUY or SIDE_SELL'
  when 7 then 'quantity must be a positive decimal number no greater than 10000000000.00000000'
  when 4 then 'price must be a positive decimal number no greater than 10000000000.00000000'
  when 16 then 'currency must be a 3-letter uppercase ISO 4217 code'
end
"""

# Trades as the wire view's records decode and pass the ledger checks.
APPLICABLE = (
    TRADES
    + f""",
decoded as (
  select t.id, t.event_id, t.tenant_id,
    case when id % 97 = 15 then 'aapl' else t.instrument end as instrument,
    case when id % 97 = 6 then 'HOLD' else t.side end as side,
    case when id % 97 = 7 then 0 else t.quantity end as quantity, t.price,
    case when id % 97 = 16 then 'usd' else t.currency end as currency, t.occurred_at,
    {DECODE_REASON} as reason, {CHECK_REASON} as check_reason,
    concat(t.tenant_id, ':', case when id % 97 = 15 then 'aapl' else t.instrument end) as key
  from trades t),
ledger as (select * from decoded where reason is null and check_reason is null)
"""
)


def fold(source: str, name: str = "folded") -> str:
    """State per key: a list fold of its trades in id order, in 128-bit integers."""
    return f""",
{name}_in as (
  select tenant_id, instrument,
    list({{'id': cast(id as hugeint),
           'q': cast(case when side='BUY' then quantity else -quantity end as hugeint),
           'p': cast(price as hugeint)}} order by id) as trades
  from {source} group by tenant_id, instrument),
{name} as (
  select tenant_id, instrument, list_reduce(trades, lambda s, t:
    case when s.pos = 0 or (s.pos > 0) = (t.q > 0) then
      {{'pos': s.pos + t.q,
        'avg': ((s.pos * s.avg) // 100000000 + (t.q * t.p) // 100000000) * 100000000 // (s.pos + t.q),
        'pnl': s.pnl, 'last': t.id}}
    else
      {{'pos': s.pos + t.q,
        'avg': case when s.pos + t.q = 0 then cast(0 as hugeint)
                    when abs(t.q) > abs(s.pos) then t.p else s.avg end,
        'pnl': s.pnl + (least(abs(t.q), abs(s.pos))
                        * (case when s.pos > 0 then t.p - s.avg else s.avg - t.p end)) // 100000000,
        'last': t.id}}
    end,
    {{'pos': cast(0 as hugeint), 'avg': cast(0 as hugeint), 'pnl': cast(0 as hugeint),
      'last': cast(0 as hugeint)}}) as s
  from {name}_in)
"""


STATE_COLUMNS = """tenant_id, instrument, cast(s.pos as bigint) as "position",
  cast(s.avg as bigint) as average_cost, cast(s.pnl as bigint) as realized_pnl,
  cast(s.last as bigint) as last_transaction_id"""


def trace(source: str) -> str:
    """State after every trade, by walking each key's trades one at a time.

    A trade whose result leaves the 64-bit range is skipped. Start the statement
    with ``with recursive``.
    """
    low, high = -(2**63), 2**63 - 1

    def out(e: str) -> str:
        return f"({e}) not between {low} and {high}"

    held, added = "(r.pos * r.avg) // 100000000", "(n.q * n.p) // 100000000"
    realized = (
        "(least(abs(n.q), abs(r.pos)) "
        "* (case when r.pos > 0 then n.p - r.avg else r.avg - n.p end)) // 100000000"
    )
    average = f"(({held} + {added}) * 100000000) // nullif(r.pos + n.q, 0)"
    return f""",
numbered as (
  select tenant_id, instrument, id,
    cast(case when side='BUY' then quantity else -quantity end as hugeint) as q,
    cast(price as hugeint) as p,
    row_number() over (partition by tenant_id, instrument order by id) as rn
  from {source}),
walk as (
  select tenant_id, instrument, cast(0 as bigint) as rn, cast(null as bigint) as id,
    cast(0 as hugeint) as pos, cast(0 as hugeint) as avg, cast(0 as hugeint) as realized,
    cast(0 as hugeint) as pnl, cast(0 as bigint) as episode, cast(null as hugeint) as opened,
    false as closed, cast(null as varchar) as problem
  from (select distinct tenant_id, instrument from numbered) k
  union all
  select tenant_id, instrument, rn, id,
    case when problem is null then pos + q else pos end,
    case when problem is not null then avg
         when same then average
         when pos + q = 0 then 0
         when abs(q) > abs(pos) then p else avg end,
    case when problem is null and not same then gain else 0 end,
    case when problem is null and not same then pnl + gain else pnl end,
    episode + before_closed,
    case when problem is null and not same and abs(q) > abs(pos) then pos + q end,
    problem is null and not same and abs(q) >= abs(pos),
    problem
  from (
    select n.tenant_id, n.instrument, n.rn, n.id, n.q, n.p, r.pos, r.avg, r.pnl, r.episode,
      cast(r.closed as bigint) as before_closed,
      (r.pos = 0 or (r.pos > 0) = (n.q > 0)) as same,
      {average} as average, {realized} as gain,
      case when r.pos = 0 or (r.pos > 0) = (n.q > 0) then
        case when {out(held)} then 'compute existing cost basis: product out of range'
             when {out(added)} then 'compute trade cost: product out of range'
             when {out(f"{held} + {added}")} or {out("r.pos + n.q")}
               then 'compute new average cost: sum out of range'
             when {out(average)} then 'compute new average cost: quotient out of range' end
      else
        case when {out(realized)} then 'compute realized pnl: product out of range'
             when {out(f"r.pnl + {realized}")} then 'compute realized pnl: sum out of range' end
      end as problem
    from walk r join numbered n
      on n.tenant_id = r.tenant_id and n.instrument = r.instrument and n.rn = r.rn + 1) step),
traced as (select * from walk where rn > 0)
"""


# Partition ranges of a reservation map and of the tenants outside it.
def ranges(low: int, high: int, name: str, total: int = 24, default: int = 1) -> str:
    return f""",
{name}_reserved as (
  select concat('tenant-', cast(s_suppkey % 20 as varchar)) as tenant_id, count(*) as size
  from supplier where s_nationkey between {low} and {high} group by 1),
{name}_laid as (
  select tenant_id, size,
    cast(sum(size) over (order by tenant_id) - size as bigint) as start from {name}_reserved),
{name}_explicit as (
  select tenant_id, start, least(size, {total - 1} - start) as size
  from {name}_laid where start < {total - 1}),
{name}_pool as (
  select coalesce(cast(sum(size) as bigint), 0) as pool_start,
    {total} - coalesce(cast(sum(size) as bigint), 0) as pool_size from {name}_explicit),
{name}_arrivals as (
  select tenant_id, min(id) as first_seen from trade_deliveries group by tenant_id),
{name}_new as (
  select tenant_id,
    (row_number() over (order by first_seen, tenant_id) - 1) * {default} as pos
  from {name}_arrivals where tenant_id not in (select tenant_id from {name}_explicit)),
{name} as (
  select tenant_id, start, size, 'reserved' as kind from {name}_explicit
  union all
  select tenant_id, pool_start + pos, least({default}, pool_size - pos), 'pool'
  from {name}_new, {name}_pool where pos < pool_size)
"""


def partition_of(name: str, rows: str) -> str:
    """Scalar partition of a row ``rows`` left-joined to the ranges ``name`` as ``x``."""
    return (
        f"case when x.start is not null then x.start + {fnv(rows + '.instrument')} % x.size "
        f"else (select pool_start from {name}_pool) + {fnv(rows + '.tenant_id')} "
        f"% (select pool_size from {name}_pool) end"
    )


POLLS = (
    APPLICABLE
    + ranges(0, 2, "ranges")
    + f""",
placed as (
  select t.*, {partition_of("ranges", "t")} as part
  from decoded t left join ranges x on x.tenant_id = t.tenant_id),
polls as (
  select id // 4096 as poll, part as "partition", id as "offset", tenant_id,
    ({DECODE_REASON}) is null as decodable, (id // 4096 + 1) * 4096 + part * 100 as high_watermark
  from placed),
known as (
  select distinct concat('tenant-', cast(s_suppkey % 20 as varchar)) as tenant_id
  from supplier where s_acctbal > 5000),
per_partition as (
  select poll, "partition", max("offset") as last_offset, max(high_watermark) as high_watermark,
    arg_max(tenant_id, "offset") filter (where decodable) as tenant_id
  from polls group by 1, 2),
labelled as (
  select p.*, greatest(high_watermark - 1 - last_offset, 0) as lag,
    case when p.tenant_id in (select tenant_id from known) then p.tenant_id else 'unregistered' end as tenant
  from per_partition p)
"""
)

CALLS = """
call_log as (
  select event_id as call_id, ts, concat('tenant-',cast(user_id%5 as varchar)) as tenant_id,
    case when event_type='error' then 'failure' else 'success' end as outcome,
    cast(round(value*1000) as bigint) as latency_us, user_id%12 as partition_id, user_id, event_type
  from events)
"""

BOUNDS = [25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 25000, 50000, 100000]
WIDE_BOUNDS = [*BOUNDS, 250000, 500000, 1000000]


def bucket_rows(source: str, by: str, bounds: list[int], name: str) -> str:
    """Cumulative buckets per ``by`` in long form: ``le`` in seconds, ``bucket``."""
    values = ", ".join(f"({b}, {b} / 1e6)" for b in bounds)
    return f""",
{name}_bounds(bound_us, le) as (values {values}, (9223372036854775807, 'infinity'::double)),
{name} as (
  select {by}, b.le, count(*) filter (where c.latency_us <= b.bound_us) as bucket,
    count(*) as observations, cast(sum(c.latency_us) as bigint) as sum_us
  from {source} c, {name}_bounds b group by {by}, b.le)
"""


def quantile_rows(source: str, by: str, value: str, name: str) -> str:
    """For each ``by``: its sorted buckets joined to the quantile wanted, one column per rank."""
    return f""",
{name}_sum as (select {by}, le, cast(sum({value}) as double) as value from {source} group by {by}, le),
{name}_total as (select {by}, max(value) filter (where le = 'infinity'::double) as total
  from {name}_sum group by {by}),
{name}_steps as (
  select {by}, le, value,
    coalesce(lag(le) over (partition by {by} order by le), 0.0) as floor_le,
    coalesce(lag(value) over (partition by {by} order by le), 0.0) as floor_value
  from {name}_sum),
{name} as (
  select {by},
    {_quantile("0.5")} as p50, {_quantile("0.99")} as p99
  from {name}_steps s join {name}_total t using ({by}) group by {by})
"""


def _quantile(q: str) -> str:
    finite = "s.le <> 'infinity'::double"
    return (
        f"case when max(t.total) > 0 then "
        f"case when count(*) filter (where {finite} and s.value >= {q}::double * t.total) = 0 "
        f"then max(s.le) filter (where {finite}) "
        f"else arg_min(s.floor_le + (s.le - s.floor_le) "
        f"* (({q}::double * t.total - s.floor_value) / (s.value - s.floor_value)), s.le) "
        f"filter (where {finite} and s.value >= {q}::double * t.total) end end"
    )


SCRAPED = (
    CALLS
    + """,
scraped as (
  select *, date_trunc('hour', ts) + interval 1 hour as scraped_at from call_log)
"""
)

OUTCOME_SAMPLES = (
    SCRAPED
    + """,
outcome_samples as (
  select tenant_id, outcome, scraped_at as ts,
    cast(sum(count(*)) over (partition by tenant_id, outcome, scraped_at > timestamp '2024-01-16 00:00:00'
         order by scraped_at) as double) as value
  from scraped group by tenant_id, outcome, scraped_at)
"""
)

BUCKET_SAMPLES = (
    SCRAPED
    + bucket_rows("scraped", "scraped_at, tenant_id, outcome", WIDE_BOUNDS, "hourly")
    + """,
bucket_samples as (
  select tenant_id, outcome, le, scraped_at as ts,
    cast(sum(bucket) over (partition by tenant_id, outcome, le, scraped_at > timestamp '2024-01-16 00:00:00'
         order by scraped_at) as double) as value
  from hourly)
"""
)


def increases(source: str, series: str, window_s: int, name: str) -> str:
    """Increase at every sample: steps between consecutive samples that both lie in the window."""
    return f""",
{name}_steps as (
  select *, lag(ts) over (partition by {series} order by ts) as before_ts,
    lag(value) over (partition by {series} order by ts) as before
  from {source}),
{name}_jumps as (
  select *, case when value < before then value else value - before end as jump from {name}_steps),
{name} as (
  select a.*, (
    select sum(b.jump) from {name}_jumps b
    where {" and ".join(f"b.{s.strip()} = a.{s.strip()}" for s in series.split(","))}
      and b.ts <= a.ts and b.before_ts > a.ts - interval {window_s} second) as increase
  from {name}_jumps a)
"""


BREAKERS = (
    SCRAPED
    + """,
dependency_calls as (
  select concat('dep-', cast(partition_id % 3 as varchar)) as dependency, ts, call_id, scraped_at,
    case when event_type = 'signup' then 'duplicate' else outcome end as outcome from scraped),
hourly_calls as (
  select dependency, scraped_at, count(*) as n, count(*) filter (where outcome = 'failure') as failed
  from dependency_calls group by 1, 2),
breaker_samples as (
  select dependency, scraped_at as ts,
    cast(case when failed * 3 >= n then 2
      when lag(failed * 3 >= n) over (partition by dependency order by scraped_at) then 1
      else 0 end as bigint) as state
  from hourly_calls)
"""
)

SIGNALS = (
    CALLS
    + """,
daily_calls as (select *, date_trunc('day', ts) as observed_at from call_log)
"""
    + bucket_rows("daily_calls", "tenant_id, observed_at", WIDE_BOUNDS, "daily_buckets")
    + quantile_rows("daily_buckets", "tenant_id, observed_at", "bucket", "daily_quantiles")
    + """,
signals as (
  select v.tenant_id, v.observed_at, lag, cast(round(p99 * 1000) as bigint) as p99_ms, partition_count
  from (select tenant_id, observed_at, count(*) as lag,
          count(distinct case when outcome = 'failure' then partition_id end) as partition_count
        from daily_calls group by 1, 2) v
  join daily_quantiles q on q.tenant_id = v.tenant_id and q.observed_at = v.observed_at),
specs(tenant_id, min_replicas, max_replicas, kafka_lag_threshold, p99_latency_threshold_ms) as (
  values ('tenant-0',1,6,65,330), ('tenant-1',2,10,70,300), ('tenant-2',3,8,60,400),
         ('tenant-3',1,3,64,250), ('tenant-4',2,12,1000,350)),
resets as (
  select distinct tenant_id, date_trunc('day', ts) as observed_at from call_log
  where event_type = 'signup' and hour(ts) = 0)
"""
)

# The decision after every snapshot, walked one snapshot at a time.
HISTORY = (
    SIGNALS
    + """,
snaps as (
  select g.*, s.min_replicas, s.max_replicas, s.kafka_lag_threshold, s.p99_latency_threshold_ms,
    r.tenant_id is not null as reset, lag > kafka_lag_threshold as lag_high,
    p99_ms > p99_latency_threshold_ms as p99_high,
    row_number() over (partition by g.tenant_id order by g.observed_at) as rn
  from signals g join specs s on s.tenant_id = g.tenant_id
  left join resets r on r.tenant_id = g.tenant_id and r.observed_at = g.observed_at),
history as (
  select tenant_id, cast(0 as bigint) as rn, cast(null as timestamp) as observed_at,
    cast(0 as bigint) as lag, cast(0 as bigint) as p99_ms, cast(0 as bigint) as partition_count,
    cast(0 as bigint) as max_replicas, cast(0 as bigint) as baseline, cast(null as varchar) as state,
    cast(0 as bigint) as replicas, false as latched, false as latched_after, false as sets_latch
  from (select distinct tenant_id from snaps) t
  union all
  select tenant_id, rn, observed_at, lag, p99_ms, partition_count, max_replicas, base,
    case when lag_high and p99_high then 'Scaling'
         when lag_high and base < partition_count then 'Scaling'
         when lag_high then 'Isolated' when p99_high then 'Degraded'
         when latch then 'Isolated' else 'Stable' end,
    case when lag_high and p99_high then max_replicas
         when lag_high and base < partition_count
           then least(greatest(least(max_replicas, partition_count), min_replicas), max_replicas)
         else base end,
    latch, latch or (lag_high and not p99_high and base >= partition_count),
    lag_high and not p99_high and base >= partition_count
  from (select s.*, greatest(h.replicas, s.min_replicas) as base,
          h.latched_after and not s.reset as latch
        from history h join snaps s on s.tenant_id = h.tenant_id and s.rn = h.rn + 1) x),
steps as (select * from history where rn > 0)
"""
)

# The same walk, with the spec in force on the day.
CHANGING_HISTORY = HISTORY.replace(
    "snaps as (",
    """middle as (
  select tenant_id, min(day) + to_days(cast(date_diff('day', min(day), max(day)) // 2 as integer)) as valid_from
  from (select tenant_id, date_trunc('day', ts) as day from call_log) d group by tenant_id),
spec_versions as (
  select tenant_id, min_replicas, max_replicas, kafka_lag_threshold, p99_latency_threshold_ms,
    timestamp '1900-01-01' as valid_from, valid_from as until from specs join middle using (tenant_id)
  union all
  select tenant_id, min_replicas + 2, max_replicas - 1, kafka_lag_threshold - 3, p99_latency_threshold_ms - 20,
    valid_from, timestamp '2900-01-01' from specs join middle using (tenant_id)),
snaps as (""",
    1,
).replace(
    "join specs s on s.tenant_id = g.tenant_id",
    "join spec_versions s on s.tenant_id = g.tenant_id and g.observed_at >= s.valid_from and g.observed_at < s.until",
)

TRANSITIONS = (
    HISTORY
    + """,
changes as (
  select *, coalesce(lag(latched_after) over w, false) as held, lag(state) over w as old_state
  from steps window w as (partition by tenant_id order by observed_at)),
transitions as (
  select tenant_id, observed_at, 'DedicatedPoolCreated' as transition, coalesce(old_state,'') as old_state
    from changes where sets_latch and not latched
  union all
  select tenant_id, observed_at, 'DedicatedPoolProvisioned', coalesce(old_state,'')
    from changes where latched_after and not held
  union all
  select tenant_id, observed_at, 'DedicatedPoolTornDown', coalesce(old_state,'')
    from changes where not latched_after and held
  union all
  select tenant_id, observed_at, state, coalesce(old_state,'')
    from changes where state is distinct from old_state)
"""
)
