"""Queries over trades: read, check, de-duplicate, fold, dead-letter, place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.text import partition_key
from ledgerloom.operators import dedupe, dlq, placement, validate, wac
from ledgerloom.plans import sqltext as S, views as V
from ledgerloom.plans.registry import query
from ledgerloom.session import cut_lineage, scratch_folder
from ledgerloom.sources import letters, tables, topic

STATE = ["tenant_id", "instrument", "position", "average_cost", "realized_pnl", "last_transaction_id"]


def _micros(name: str):
    return F.unix_micros(name).alias(f"{name}_us")


# --- de-duplication and the fold ---------------------------------------------------------


@query(
    "wac_state",
    f"with {S.TRADES} {S.fold('trades')} select {S.STATE_COLUMNS} from folded",
)
def wac_state(spark, sf):
    return wac.wac_state(V.trades(spark, sf), sizing=V.trade_deliveries(spark, sf))


@query(
    "wac_trace",
    f"""with recursive {S.TRADES} {S.trace('trades')}
    select tenant_id, instrument, id, cast(pos as bigint) as "position",
      cast(avg as bigint) as average_cost, cast(realized as bigint) as realized,
      cast(pnl as bigint) as realized_pnl from traced""",
)
def wac_trace(spark, sf):
    traced = wac.wac_trace(V.trades(spark, sf), sizing=V.trade_deliveries(spark, sf))
    return traced.select(
        "tenant_id", "instrument", "id", "position", "average_cost", "realized", "realized_pnl"
    )


SEGMENT_ROWS = 16


@query(
    "wac_trace_segmented",
    f"""with recursive {S.TRADES} {S.trace('trades')}
    select tenant_id, instrument, id, cast(pos as bigint) as "position",
      cast(avg as bigint) as average_cost, cast(realized as bigint) as realized,
      cast(pnl as bigint) as realized_pnl from traced""",
)
def wac_trace_segmented(spark, sf):
    """The trace by the path of long keys: segments so short that most keys have several."""
    traced = wac.wac_trace(
        V.trades(spark, sf), sizing=V.trade_deliveries(spark, sf), segment_rows=SEGMENT_ROWS
    )
    return traced.select(
        "tenant_id", "instrument", "id", "position", "average_cost", "realized", "realized_pnl"
    )


def _one_key(spark, sf) -> DataFrame:
    """All trades of a tenant under one instrument."""
    return V.trades(spark, sf).withColumn("instrument", F.lit("ALL"))


@query(
    "wac_state_hot_key",
    f"""with {S.TRADES}, hot as (select id, tenant_id, 'ALL' as instrument, side, quantity, price
      from trades) {S.fold('hot')} select {S.STATE_COLUMNS} from folded""",
)
def wac_state_hot_key(spark, sf):
    """A few keys hold everything and are folded in segments of their rows."""
    return wac.wac_state(_one_key(spark, sf), segment_rows=20 * SEGMENT_ROWS)


@query(
    "wac_incremental",
    f"""with {S.TRADES},
    middle as (select max(id) // 2 as half from trade_deliveries),
    newer as (select distinct tenant_id, instrument from trades where id > (select half from middle))
    {S.fold('trades')}
    select {S.STATE_COLUMNS} from folded join newer using (tenant_id, instrument)""",
)
def wac_incremental(spark, sf):
    """The ledger's first half is already folded; the second half is applied on top."""
    trades = V.trades(spark, sf)
    sizing = V.trade_deliveries(spark, sf)
    at = sizing.agg(F.expr("max(id) div 2")).first()[0]
    stored = wac.wac_state(trades.where(F.col("id") <= at), sizing=sizing)
    return wac.wac_incremental(stored, trades, sizing=sizing)


@query(
    "resume_deferred",
    f"""with {S.TRADES} {S.fold('trades')} select {S.STATE_COLUMNS} from folded""",
)
def resume_deferred(spark, sf):
    """Every ledger row is stored but the state never advanced: the next run applies them all."""
    trades = V.trades(spark, sf)
    nothing = spark.createDataFrame([], "tenant_id string, instrument string, position bigint, "
                                    "average_cost bigint, realized_pnl bigint, last_transaction_id bigint")
    return wac.wac_incremental(nothing, trades, sizing=V.trade_deliveries(spark, sf))


@query(
    "wac_episodes",
    f"""with recursive {S.TRADES} {S.trace('trades')},
    legs as (
      select tenant_id, instrument, id, episode, realized, closed,
        case when opened is not null then 0 else pos end as held from traced
      union all
      select tenant_id, instrument, id, episode + 1, 0, false, opened from traced
      where opened is not null)
    select tenant_id, instrument, episode, min(id) as opened_id,
      max(case when closed then id end) as closed_id, count(*) as legs,
      cast(sum(realized) as bigint) as realized, cast(max(abs(held)) as bigint) as peak_position
    from legs group by tenant_id, instrument, episode""",
)
def wac_episodes(spark, sf):
    return wac.wac_episodes(V.trades(spark, sf), sizing=V.trade_deliveries(spark, sf))


def _poisoned(spark, sf) -> DataFrame:
    """Trades of which some carry a price the arithmetic cannot hold."""
    price = F.when(F.col("id") % 97 == 14, 9 * 10**18).otherwise(F.col("price"))
    return V.trades(spark, sf).withColumn("price", price)


POISONED = f"""{S.TRADES},
poisoned as (
  select id, tenant_id, instrument, side, quantity,
    case when id % 97 = 14 then 9000000000000000000 else price end as price from trades)"""


@query(
    "reconcile_poison",
    f"""with recursive {POISONED} {S.trace('poisoned')}
    select tenant_id, instrument, id, problem as failure_reason from traced where problem is not null""",
)
def reconcile_poison(spark, sf):
    return wac.reconcile_poison(_poisoned(spark, sf), sizing=V.trade_deliveries(spark, sf))


@query(
    "wac_state_with_poison",
    f"""with recursive {POISONED} {S.trace('poisoned')}
    select tenant_id, instrument, cast(arg_max(pos, rn) as bigint) as "position",
      cast(arg_max(avg, rn) as bigint) as average_cost, cast(arg_max(pnl, rn) as bigint) as realized_pnl,
      max(id) filter (where problem is null) as last_transaction_id
    from traced group by tenant_id, instrument""",
)
def wac_state_with_poison(spark, sf):
    return wac.wac_state(_poisoned(spark, sf), sizing=V.trade_deliveries(spark, sf))


@query(
    "wac_hot_key_with_poison",
    f"""with recursive {POISONED}, hot as (select id, tenant_id, 'ALL' as instrument,
      case when id % 101 = 7 then 'HOLD' else side end as side, quantity, price from poisoned)
    {S.trace('hot')}
    select tenant_id, instrument, id, cast(pos as bigint) as "position",
      cast(avg as bigint) as average_cost, cast(realized as bigint) as realized,
      cast(pnl as bigint) as realized_pnl, problem from traced""",
)
def wac_hot_key_with_poison(spark, sf):
    """A few keys hold everything, and most of their segments hold trades that cannot be applied."""
    side = F.when(F.col("id") % 101 == 7, "HOLD").otherwise(F.col("side"))
    trades = _poisoned(spark, sf).withColumns({"instrument": F.lit("ALL"), "side": side})
    traced = wac.wac_trace(trades, segment_rows=20 * SEGMENT_ROWS)
    return traced.select(
        "tenant_id", "instrument", "id", "position", "average_cost", "realized", "realized_pnl",
        "problem",
    )


@query(
    "position",
    f"""with {S.TRADES} select tenant_id, instrument,
    cast(sum(case when side='BUY' then quantity else -quantity end) as bigint) as "position"
    from trades group by tenant_id, instrument""",
)
def position(spark, sf):
    return wac.position(V.trades(spark, sf))


@query(
    "open_positions",
    f"""with {S.TRADES} {S.fold('trades')} select tenant_id,
    count(*) filter (where s.pos > 0) as long_positions,
    count(*) filter (where s.pos < 0) as short_positions,
    count(*) filter (where s.pos = 0) as flat_positions from folded group by tenant_id""",
)
def open_positions(spark, sf):
    return wac.open_positions(wac_state(spark, sf))


@query(
    "realized_by_tenant",
    f"""with {S.TRADES} {S.fold('trades')} select tenant_id, count(*) as instruments,
    cast(sum(s.pnl) as bigint) as realized_pnl from folded group by tenant_id""",
)
def realized_by_tenant(spark, sf):
    return wac.realized_by_tenant(wac_state(spark, sf))


@query(
    "dedupe_events",
    f"""with {S.TRADES} select id, event_id, tenant_id, instrument, side, quantity, price, currency,
    epoch_us(occurred_at) as occurred_at_us from trades""",
)
def dedupe_events(spark, sf):
    return V.trades(spark, sf).select(
        "id", "event_id", "tenant_id", "instrument", "side", "quantity", "price", "currency",
        _micros("occurred_at"),
    )


@query(
    "duplicate_report",
    f"""with {S.DELIVERIES} select event_id, count(*) as deliveries,
    count(distinct tenant_id) as tenants from trade_deliveries group by event_id having count(*) > 1""",
)
def duplicate_report(spark, sf):
    return dedupe.duplicate_report(V.trade_deliveries(spark, sf))


@query(
    "duplicates_by_tenant",
    f"""with {S.TRADES} select d.tenant_id, d.n as deliveries, coalesce(t.n, 0) as accepted,
    d.n - coalesce(t.n, 0) as duplicates
    from (select tenant_id, count(*) as n from trade_deliveries group by 1) d
    left join (select tenant_id, count(*) as n from trades group by 1) t on t.tenant_id = d.tenant_id""",
)
def duplicates_by_tenant(spark, sf):
    return dedupe.duplicates_by_tenant(V.trade_deliveries(spark, sf), V.ARRIVAL)


@query(
    "get_by_event_id",
    f"""with {S.TRADES},
    m as (select md5(concat(cast(o_orderkey as varchar), '-1')) as m from orders),
    wanted as (select distinct concat(substr(m,1,8),'-',substr(m,9,4),'-',substr(m,13,4),'-',
      substr(m,17,4),'-',substr(m,21,12)) as event_id from m)
    select w.event_id, t.id, t.tenant_id, t.instrument,
      case when t.id is null then 'not found' else 'found' end as outcome
    from wanted w left join trades t on t.event_id = w.event_id""",
)
def get_by_event_id(spark, sf):
    """Look up the first line of every order."""
    wanted = V.table(spark, sf, "orders").select(
        V.uuid_of(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1"))).alias("event_id")
    ).distinct()
    return dedupe.get_by_event_id(wanted, V.trades(spark, sf)).select(
        "event_id", "id", "tenant_id", "instrument", "outcome"
    )


@query(
    "list_by_tenant",
    f"""with {S.TRADES} select id, event_id, tenant_id, instrument, side, quantity, price,
    epoch_us(occurred_at) as occurred_at_us from trades
    where tenant_id = 'tenant-3' and occurred_at >= timestamp '1997-01-01' order by occurred_at, id""",
)
def list_by_tenant(spark, sf):
    since = F.lit("1997-01-01").cast("timestamp")
    return dedupe.list_by_tenant(V.trades(spark, sf), "tenant-3", since).select(
        "id", "event_id", "tenant_id", "instrument", "side", "quantity", "price",
        _micros("occurred_at"),
    )


@query(
    "get_state",
    f"""with {S.TRADES} {S.fold('trades')},
    wanted as (select distinct concat('tenant-', cast(s_suppkey % 25 as varchar)) as tenant_id,
      concat('P', cast(s_nationkey as varchar)) as instrument from supplier)
    select w.tenant_id, w.instrument, cast(coalesce(s.pos, 0) as bigint) as "position",
      cast(coalesce(s.avg, 0) as bigint) as average_cost,
      cast(coalesce(s.pnl, 0) as bigint) as realized_pnl, cast(s.last as bigint) as last_transaction_id
    from wanted w left join folded f on f.tenant_id = w.tenant_id and f.instrument = w.instrument""",
)
def get_state(spark, sf):
    wanted = V.table(spark, sf, "supplier").select(
        F.concat(F.lit("tenant-"), (F.col("s_suppkey") % 25).cast("string")).alias("tenant_id"),
        F.concat(F.lit("P"), F.col("s_nationkey").cast("string")).alias("instrument"),
    ).distinct()
    return dedupe.get_state(wanted, wac_state(spark, sf)).select(*STATE)


@query(
    "skip_applied",
    f"""with {S.TRADES}, middle as (select tenant_id, instrument, max(id) as mark from trades
      where quantity < 2500000000 group by 1, 2)
    select t.id, t.tenant_id, t.instrument from trades t
    left join middle m on m.tenant_id = t.tenant_id and m.instrument = t.instrument
    where m.mark is null or m.mark < t.id""",
)
def skip_applied(spark, sf):
    """Watermarks stand at each key's last small trade."""
    trades = V.trades(spark, sf)
    marks = trades.where("quantity < 2500000000").groupBy("tenant_id", "instrument").agg(
        F.max("id").alias("last_transaction_id")
    )
    return dedupe.skip_applied(trades, marks).select("id", "tenant_id", "instrument")


# --- reading and checking ----------------------------------------------------------------


@query(
    "validate_rest",
    f"""with {S.TRADES}, checked as (select *, {S.REST_ERROR} as error from trades)
    select id, error, case when error is null then event_id end as event_id,
      case when error is null then quantity end as quantity,
      case when error is null then price end as price,
      case when error is null then epoch_us(occurred_at) end as occurred_at_us from checked""",
)
def validate_rest(spark, sf):
    rows = validate.validate_rest(V.rest_json(spark, sf))
    good = F.col("error").isNull()
    return rows.select(
        "id", "error", *[F.when(good, F.col(c)).alias(c) for c in ("event_id", "quantity", "price")],
        F.when(good, F.unix_micros("occurred_at")).alias("occurred_at_us"),
    )


@query(
    "validate_typed",
    f"""with {S.TRADES}, checked as (select *, {S.TYPED_ERROR} as error from trades)
    select id, error, case when error is null then side end as side from checked""",
)
def validate_typed(spark, sf):
    rows = validate.validate_typed(V.typed_events(spark, sf))
    return rows.select("id", "error", F.when(F.col("error").isNull(), F.col("side")).alias("side"))


@query(
    "split_valid",
    f"""with {S.TRADES}, checked as (select *, {S.REST_ERROR} as error from trades)
    select case when error is null then 'accepted' else 'rejected' end as outcome, tenant_id,
      count(*) as events from checked group by 1, 2""",
)
def split_valid(spark, sf):
    """Accepted and rejected events per tenant; together they are every event."""
    bodies = V.with_defects(V.trades(spark, sf), []).select(
        "id", "value", F.col("tenant_id").alias("owner")
    )
    # Both sides read the verdicts that are written once.
    checked = cut_lineage(validate.validate_rest(bodies).select("owner", "error"))
    accepted, rejected = validate.split_valid(checked)

    def counted(rows, outcome):
        return rows.groupBy(F.lit(outcome).alias("outcome"), F.col("owner").alias("tenant_id")).agg(
            F.count("*").alias("events")
        )

    return counted(accepted, "accepted").unionByName(counted(rejected, "rejected"))


@query(
    "reject_summary",
    f"""with {S.TRADES}, checked as (select {S.REST_ERROR} as error from trades)
    select error as reason, count(*) as rejects from checked where error is not null group by 1""",
)
def reject_summary(spark, sf):
    return validate.reject_summary(validate.validate_rest(V.rest_json(spark, sf)))


@query(
    "decode_wire",
    f"""with {S.APPLICABLE}
    select id, reason, case when reason is null then event_id end as event_id,
      case when reason is null then tenant_id end as tenant_id,
      case when reason is null then instrument end as instrument,
      case when reason is null then side end as side,
      case when reason is null then quantity end as quantity,
      case when reason is null then price end as price,
      case when reason is null then currency end as currency,
      case when reason is null then epoch_us(occurred_at) end as occurred_at_us,
      case when reason is null then cast(1 as bigint) end as schema_version
    from decoded""",
)
def decode_wire(spark, sf):
    rows = validate.decode_wire(V.wire_json(spark, sf).select("id", "key", "value"))
    good = F.col("reason").isNull()
    names = ["event_id", "tenant_id", "instrument", "side", "quantity", "price", "currency"]
    return rows.select(
        "id", "reason", *[F.when(good, F.col(c)).alias(c) for c in names],
        F.when(good, F.unix_micros("occurred_at")).alias("occurred_at_us"),
        F.when(good, F.col("schema_version").cast("bigint")).alias("schema_version"),
    )


def _decoded(spark, sf) -> DataFrame:
    return validate.decode_wire(V.topic_records(spark, sf))


def _checked(spark, sf) -> DataFrame:
    return validate.ledger_checks(_decoded(spark, sf).where("reason is null"))


@query(
    "ledger_checks",
    f"""with {S.APPLICABLE} select id, check_reason from decoded
    where reason is null and check_reason is not null""",
)
def ledger_checks(spark, sf):
    return _checked(spark, sf).where("check_reason is not null").select(
        F.col("offset").alias("id"), "check_reason"
    )


def _amount_texts(spark, sf) -> DataFrame:
    """Quantity and price strings as clients write them, some with exponents or junk."""
    return V.trades(spark, sf).select(
        F.when(F.col("id") % 97 == 3, "x").when(F.col("id") % 97 == 7, "0")
        .when(F.col("id") % 5 == 0, F.concat(F.expr("cast(quantity div 10000000 as string)"), F.lit("e-1")))
        .otherwise(V.format_amount(F.col("quantity"))).alias("quantity"),
        F.when(F.col("id") % 97 == 4, "1e400").when(F.col("id") % 97 == 5, "")
        .when(F.col("id") % 97 == 6, "10000000000.00000001")
        .when(F.col("id") % 7 == 0, F.concat(F.expr("cast(price div 1000000 as string)"), F.lit("E-02")))
        .otherwise(V.format_amount(F.col("price"))).alias("price"),
    )


@query(
    "amount_audit",
    f"""with {S.TRADES}, verdicts as (
      select 'quantity' as field, case id % 97 when 3 then 'is not a valid decimal number'
        when 7 then 'outside accepted range' else 'ok' end as verdict,
        case id % 97 when 3 then null when 7 then 0 else quantity end as amount from trades
      union all
      select 'price', case id % 97 when 4 then 'is out of range' when 5 then 'must not be empty'
        when 6 then 'outside accepted range' else 'ok' end,
        case id % 97 when 4 then null when 5 then null when 6 then 1000000000000000001 else price end
      from trades)
    select field, verdict, count(*) as "rows", cast(sum(amount) as varchar) as total
    from verdicts group by 1, 2""",
)
def amount_audit(spark, sf):
    return validate.amount_audit(_amount_texts(spark, sf), ["quantity", "price"])


def _numeric_state(spark, sf) -> DataFrame:
    """Order totals as old decimal amounts; every 97th is too large for a scaled bigint."""
    price = F.round(F.col("o_totalprice"), 2).cast("decimal(20,8)")
    big = F.lit("99999999999.5").cast("decimal(20,8)")
    rows = V.table(spark, sf, "orders")
    return rows.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 97 == 0, big).otherwise(price).alias("amount")
    )


@query(
    "rescale_audit",
    """select count(*) as too_large from orders where o_orderkey % 97 = 0""",
)
def rescale_audit(spark, sf):
    return validate.rescale_audit(_numeric_state(spark, sf), ["amount"]).agg(
        F.count("*").alias("too_large")
    )


@query(
    "rescale_amounts_up",
    """select o_orderkey, case when o_orderkey % 97 <> 0
      then cast(round(o_totalprice * 100) as bigint) * 1000000 end as amount from orders""",
)
def rescale_amounts_up(spark, sf):
    return validate.rescale_up(_numeric_state(spark, sf), ["amount"])


@query(
    "rescale_amounts_down",
    f"""with {S.TRADES} {S.fold('trades')} select tenant_id, instrument,
      {S.amount_text('cast(s.avg as bigint)')} as average_cost,
      cast(cast(round(cast(s.pnl as decimal(38,0)) / 10000) as bigint) as varchar) as pnl_e4
    from folded""",
)
def rescale_amounts_down(spark, sf):
    down = validate.rescale_down(wac_state(spark, sf), ["average_cost"], ["realized_pnl"])
    return down.select(
        "tenant_id", "instrument", F.col("average_cost").cast("string").alias("average_cost"),
        (F.col("realized_pnl") * 10000).cast("bigint").cast("string").alias("pnl_e4"),
    )


SEPARATOR = "\x1e"


@query(
    "read_rest_events",
    f"""with {S.TRADES} select case when id % 97 in (1, 10) then 'invalid request body'
      when id % 97 = 8 then 'invalid request body: trailing data' else 'readable' end as verdict,
      count(*) as bodies from trades group by 1""",
)
def read_rest_events(spark, sf):
    """Bodies written to files, a record separator between two of them, and read back."""
    folder = scratch_folder(spark, "bodies") + "/text"
    V.rest_json(spark, sf).select("value").write.option("lineSep", SEPARATOR).text(folder)
    rows = validate.validate_rest(topic.read_rest_events(spark, folder, separator=SEPARATOR))
    verdict = F.when(F.col("error").startswith("invalid request body"), F.col("error"))
    return rows.groupBy(F.coalesce(verdict, F.lit("readable")).alias("verdict")).agg(
        F.count("*").alias("bodies")
    )


@query(
    "read_typed_events",
    f"""with {S.TRADES}, checked as (select *, {S.TYPED_ERROR} as error from trades)
    select id, event_id, tenant_id, instrument, side, quantity, price, currency,
      epoch_us(occurred_at) as occurred_at_us, cast(1 as bigint) as schema_version
    from checked where error is null""",
)
def read_typed_events(spark, sf):
    folder = scratch_folder(spark, "typed-events") + "/rows"
    V.typed_events(spark, sf).write.parquet(folder)
    rows = topic.read_typed_events(spark, folder, extra="id bigint")
    accepted, _ = validate.split_valid(validate.validate_typed(rows))
    return accepted.select(
        "id", "event_id", "tenant_id", "instrument", "side", "quantity", "price", "currency",
        _micros("occurred_at"), F.col("schema_version").cast("bigint").alias("schema_version"),
    )


@query(
    "encode_wire_event",
    f"""with {S.TRADES} select id, concat(tenant_id, ':', instrument) as key,
      concat('{{"event_id":"', event_id, '","tenant_id":"', tenant_id,
        '","schema_version":1,"instrument":"', instrument, '","side":"', side,
        '","quantity":"', {S.amount_text('quantity')}, '","price":"', {S.amount_text('price')},
        '","currency":"', currency, '","occurred_at":"', {S.TIME_TEXT}, '"}}') as value
    from trades""",
)
def encode_wire_event(spark, sf):
    rows = V.trades(spark, sf).withColumn("schema_version", F.lit(1).cast("smallint"))
    return topic.encode_wire_event(rows).select("id", "key", "value")


# --- ledger and state tables -------------------------------------------------------------


def _arrived(spark, sf) -> DataFrame:
    """Deliveries as records of one topic partition per supplier group, payloads decoded."""
    return V.trade_deliveries(spark, sf).select(
        F.lit("trades").alias("topic"), F.expr("l_suppkey % 4").alias("partition"),
        F.expr("(unix_date(cast(occurred_at as date)) * 1000000L + l_partkey) * 100000L + id % 100000").alias("offset"),
        "event_id", "tenant_id", "instrument", "side", "quantity", "price", "currency", "occurred_at",
    )


@query(
    "append_transactions",
    f"""with {S.DELIVERIES}, arrived as (
      select *, l_suppkey % 4 as part,
        (cast(date_diff('day', date '1970-01-01', cast(occurred_at as date)) as bigint) * 1000000
          + l_partkey) * 100000 + id % 100000 as pos from trade_deliveries),
    spans as (select part, min(pos) as low, max(pos) - min(pos) + 1 as span from arrived group by part),
    blocks as (select part, low, 1 + cast(coalesce(sum(span) over (order by part rows between unbounded
      preceding and 1 preceding), 0) as bigint) as block from spans),
    numbered as (select a.*, b.block + a.pos - b.low as ledger_id
      from arrived a join blocks b on b.part = a.part),
    known as (select distinct md5(concat(cast(l_orderkey as varchar),'-',cast(l_linenumber as varchar))) as m
      from lineitem where l_returnflag = 'N')
    select min(ledger_id) as id, event_id from numbered
    where replace(event_id, '-', '') not in (select m from known) group by event_id""",
)
def append_transactions(spark, sf):
    """Deliveries appended to a ledger that already holds every event once seen with flag N."""
    raw = V.table(spark, sf, "lineitem")
    held = V.deliveries_of(raw.where("l_returnflag = 'N'")).select("event_id").distinct()
    rows = tables.append_transactions(_arrived(spark, sf), held, 1, F.current_timestamp())
    return rows.select("id", "event_id")


@query(
    "upsert_state",
    f"""with {S.TRADES},
    stored as (select tenant_id, instrument, max(id) as mark, cast(sum(quantity) as bigint) as pos
      from trades where side = 'BUY' group by 1, 2),
    changed as (select tenant_id, instrument, max(id) as mark, cast(sum(quantity) as bigint) as pos
      from trades where side = 'SELL' group by 1, 2)
    select coalesce(s.tenant_id, c.tenant_id) as tenant_id,
      coalesce(s.instrument, c.instrument) as instrument,
      case when s.mark is null or c.mark > s.mark then c.pos else s.pos end as "position",
      case when s.mark is null or c.mark > s.mark then c.mark else s.mark end as last_transaction_id
    from stored s full join changed c on s.tenant_id = c.tenant_id and s.instrument = c.instrument""",
)
def upsert_state(spark, sf):
    """A stored state per key meets a change per key; the higher watermark wins."""
    def summed(side):
        zero = F.lit(0).cast("bigint")
        return V.trades(spark, sf).where(F.col("side") == side).groupBy("tenant_id", "instrument").agg(
            F.sum("quantity").alias("position"), zero.alias("average_cost"),
            zero.alias("realized_pnl"), F.max("id").alias("last_transaction_id"),
            F.lit(None).cast("timestamp").alias("updated_at"),
        )

    return tables.upsert_state(summed("BUY"), summed("SELL")).select(
        "tenant_id", "instrument", "position", "last_transaction_id"
    )


# --- dead letters ------------------------------------------------------------------------


def _letters(spark, sf) -> DataFrame:
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return dlq.dead_letters(validate.ledger_checks(_decoded(spark, sf)), at)


LETTERS = f"""{S.APPLICABLE} {S.ranges(0, 2, 'ranges')},
letters as (
  select d.id, d.key, coalesce(reason, check_reason) as failure_reason,
    cast(case when reason is null then 4 else 1 end as bigint) as attempts,
    {S.partition_of('ranges', 't')} as part
  from decoded d join trades t on t.id = d.id left join ranges x on x.tenant_id = t.tenant_id
  where reason is not null or check_reason is not null)"""


def _letter_columns(letters: DataFrame) -> DataFrame:
    return letters.select(
        "original_topic", F.col("original_partition").cast("bigint").alias("original_partition"),
        "original_offset", "failure_reason", F.col("attempts").cast("bigint").alias("attempts"), "key",
    )


def _letter_sql(where: str) -> str:
    return f"""with {LETTERS} select 'trades' as original_topic, part as original_partition,
      id as original_offset, failure_reason, attempts, key from letters where {where}"""


@query("route_decode_failures", _letter_sql("attempts = 1"))
def route_decode_failures(spark, sf):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return _letter_columns(dlq.route_decode_failures(_decoded(spark, sf), at))


@query("route_reconcile_failures", _letter_sql("attempts = 4"))
def route_reconcile_failures(spark, sf):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return _letter_columns(dlq.route_reconcile_failures(_checked(spark, sf), at))


@query("dlq_envelope", _letter_sql("true"))
def dlq_envelope(spark, sf):
    return _letter_columns(_letters(spark, sf))


@query("write_dlq", _letter_sql("true"))
def write_dlq(spark, sf):
    """Dead letters written as records under their key, and read back."""
    folder = scratch_folder(spark, "letters")
    letters.write_letter_files(_letters(spark, sf), folder)
    return _letter_columns(letters.read_letter_files(spark, folder))


@query(
    "dlq_by_tenant",
    f"""with {LETTERS} select split_part(key, ':', 1) as tenant_id, failure_reason,
    count(*) as letters, max(attempts) as attempts from letters group by 1, 2""",
)
def dlq_by_tenant(spark, sf):
    return dlq.dlq_by_tenant(_letters(spark, sf))


@query(
    "dlq_count",
    f"with {LETTERS} select 'trades' as original_topic, count(*) as letters from letters",
)
def dlq_count(spark, sf):
    return dlq.dlq_count(_letters(spark, sf))


@query(
    "replay_dlq",
    f"""with {LETTERS} select id, case when attempts = 1 then failure_reason end as reason from letters""",
)
def replay_dlq(spark, sf):
    """Every dead letter decoded again: undecodable ones fail alike, the others decode."""
    return dlq.replay_dlq(_letters(spark, sf)).select(F.col("offset").alias("id"), "reason")


@query(
    "no_head_of_line_block",
    f"""with {S.APPLICABLE} {S.ranges(0, 2, 'ranges')}
    select {S.partition_of('ranges', 'd')} as "partition", count(*) as records,
      count(*) filter (where reason is null and check_reason is null) as applied,
      count(*) filter (where reason is not null) as undecodable,
      count(*) filter (where reason is null and check_reason is not null) as refused
    from decoded d left join ranges x on x.tenant_id = d.tenant_id
    group by 1""",
)
def no_head_of_line_block(spark, sf):
    """Per partition, every record ends up applied, undecodable or refused."""
    rows = validate.ledger_checks(_decoded(spark, sf))
    undecodable = F.col("reason").isNotNull()
    refused = ~undecodable & F.col("check_reason").isNotNull()
    return rows.groupBy(F.col("partition").cast("bigint").alias("partition")).agg(
        F.count("*").alias("records"),
        F.count(F.when(~undecodable & ~refused, 1)).alias("applied"),
        F.count(F.when(undecodable, 1)).alias("undecodable"),
        F.count(F.when(refused, 1)).alias("refused"),
    )


@query(
    "process_topic",
    f"""with {S.APPLICABLE} {S.fold('ledger')} select {S.STATE_COLUMNS} from folded""",
)
def process_topic(spark, sf):
    """Topic records to state: decode, check, count every event once, fold."""
    good = _checked(spark, sf).where("check_reason is null").withColumn("id", F.col("offset"))
    good = good.select("event_id", "id", "tenant_id", "instrument", "side", "quantity", "price")
    return wac.wac_state(dedupe.dedupe_events(good, ["id"]), sizing=V.trade_deliveries(spark, sf))


# --- placement ---------------------------------------------------------------------------


@query(
    "partition_for",
    f"""with {S.TRADES} {S.ranges(0, 2, 'ranges')}
    select t.id, {S.partition_of('ranges', 't')} as "partition"
    from trades t left join ranges x on x.tenant_id = t.tenant_id""",
)
def partition_for(spark, sf):
    return V.placed(V.trades(spark, sf), spark, sf).select("id", "partition")


@query(
    "read_partitions",
    f"""with {S.APPLICABLE} {S.ranges(0, 2, 'ranges')}, placed as (
      select t.id, {S.partition_of('ranges', 't')} as part
      from decoded t left join ranges x on x.tenant_id = t.tenant_id)
    select part as "partition", count(*) as records, min(id) as first_offset, max(id) as last_offset
    from placed where part in (0, 5, 11, 23) group by part""",
)
def read_partitions(spark, sf):
    """A consumer assigned to a list of partitions."""
    records = topic.read_partitions(
        V.topic_records(spark, sf), topic.partition_list("0, 5, 11, 23")
    )
    return records.groupBy(F.col("partition").cast("bigint").alias("partition")).agg(
        F.count("*").alias("records"), F.min("offset").alias("first_offset"),
        F.max("offset").alias("last_offset"),
    )


@query(
    "reservation_table",
    f"""with {S.DELIVERIES} {S.ranges(0, 2, 'ranges')} select tenant_id, start, size from ranges_explicit""",
)
def reservation_table(spark, sf):
    return placement.reservation_table(V.reserved(spark, sf), V.TOTAL_PARTITIONS)


@query(
    "dropped_tenants",
    f"""with {S.DELIVERIES} {S.ranges(0, 24, 'ranges')} select tenant_id from ranges_laid where start >= 23""",
)
def dropped_tenants(spark, sf):
    """Reservations of all suppliers, far more than there are partitions."""
    return placement.dropped_tenants(V.reserved(spark, sf, (0, 24)), V.TOTAL_PARTITIONS)


@query(
    "pool_ranges",
    f"""with {S.DELIVERIES} {S.ranges(0, 2, 'ranges')} select tenant_id, start, size from ranges where kind = 'pool'""",
)
def pool_ranges(spark, sf):
    return placement.pool_ranges(
        V.arrivals(V.trade_deliveries(spark, sf)), V.reserved(spark, sf), 1, V.TOTAL_PARTITIONS
    )


@query(
    "pool_ranges_clipped",
    f"""with {S.DELIVERIES} {S.ranges(0, 2, 'ranges', default=4)} select tenant_id, start, size from ranges where kind = 'pool'""",
)
def pool_ranges_clipped(spark, sf):
    """Ranges of four: the last one is cut to what is left."""
    return placement.pool_ranges(
        V.arrivals(V.trade_deliveries(spark, sf)), V.reserved(spark, sf), 4, V.TOTAL_PARTITIONS
    )


@query(
    "partition_gauges",
    f"""with {S.DELIVERIES} {S.ranges(0, 2, 'ranges')}
    select tenant_id, size as partition_count, start as partition_start from ranges""",
)
def partition_gauges(spark, sf):
    ranges = placement.placement(
        V.arrivals(V.trade_deliveries(spark, sf)), V.reserved(spark, sf),
        V.DEFAULT_PARTITIONS, V.TOTAL_PARTITIONS,
    )
    return placement.partition_gauges(ranges)


@query(
    "placement_moves",
    f"""with {S.TRADES} {S.ranges(0, 2, 'a')} {S.ranges(1, 3, 'b')},
    before as (select t.*, {S.partition_of('a', 't')} as old_partition
      from trades t left join a x on x.tenant_id = t.tenant_id),
    after as (select t.*, {S.partition_of('b', 't')} as new_partition
      from before t left join b x on x.tenant_id = t.tenant_id)
    select tenant_id, instrument, old_partition, new_partition, count(*) as "rows"
    from after where old_partition <> new_partition group by 1, 2, 3, 4""",
)
def placement_moves(spark, sf):
    return placement.placement_moves(
        V.trades(spark, sf), V.arrivals(V.trade_deliveries(spark, sf)),
        V.reserved(spark, sf, (0, 2)), V.reserved(spark, sf, (1, 3)),
        V.DEFAULT_PARTITIONS, V.TOTAL_PARTITIONS,
    )


@query(
    "assignment_changes",
    f"""with {S.DELIVERIES} {S.ranges(0, 2, 'a')} {S.ranges(1, 3, 'b')},
    pa as (select tenant_id, unnest(range(start, start + size)) as part from a_explicit),
    pb as (select tenant_id, unnest(range(start, start + size)) as part from b_explicit)
    select tenant_id, part as "partition", 'added' as change from (select * from pb except select * from pa)
    union all
    select tenant_id, part, 'removed' from (select * from pa except select * from pb)""",
)
def assignment_changes(spark, sf):
    return placement.assignment_changes(
        placement.reservation_table(V.reserved(spark, sf, (0, 2)), V.TOTAL_PARTITIONS),
        placement.reservation_table(V.reserved(spark, sf, (1, 3)), V.TOTAL_PARTITIONS),
    )


DAILY_MAPS = """daily as (
  select cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as version,
    concat('tenant-', cast(o_custkey % 5 as varchar)) as tenant_id, count(*) as n
  from orders group by 1, 2)"""


@query(
    "read_partition_map",
    f"""with {DAILY_MAPS} select version, tenant_id, n * 2 as start, n % 7 as "count" from daily""",
)
def read_partition_map(spark, sf):
    rows = placement.read_partition_map(V.map_versions(spark, sf))
    return rows.select(
        "version", "tenant_id", F.col("start").cast("bigint").alias("start"),
        F.col("count").cast("bigint").alias("count"),
    )


@query(
    "valid_map_version",
    f"""with {DAILY_MAPS}, good as (select version from daily group by version having min(n % 7) >= 1)
    select version, tenant_id, n % 7 as size from daily where version = (select max(version) from good)""",
)
def valid_map_version(spark, sf):
    return placement.valid_map_version(V.map_versions(spark, sf))


@query(
    "valid_tenant_ranges",
    f"""with {DAILY_MAPS}, latest as (select tenant_id, max(version) as version from daily
      where n % 7 >= 1 group by 1)
    select d.tenant_id, d.version, n * 2 as start, n % 7 as size
    from daily d join latest l on l.tenant_id = d.tenant_id and l.version = d.version""",
)
def valid_tenant_ranges(spark, sf):
    return placement.valid_tenant_ranges(V.map_versions(spark, sf))


@query(
    "partition_keys",
    f"""with {S.TRADES} select concat(tenant_id, ':', instrument) as key, count(*) as trades,
    {S.fnv("concat(any_value(tenant_id), ':', any_value(instrument))")} as key_hash
    from trades group by tenant_id, instrument""",
)
def partition_keys(spark, sf):
    """Partition keys with their hash."""
    from ledgerloom.functions.text import fnv1a32

    rows = V.trades(spark, sf).groupBy("tenant_id", "instrument").agg(F.count("*").alias("trades"))
    key = partition_key(F.col("tenant_id"), F.col("instrument"))
    return rows.select(key.alias("key"), "trades", fnv1a32(key).alias("key_hash"))
