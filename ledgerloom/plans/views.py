"""The ledger's inputs as views over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions.amounts import format_amount
from ledgerloom.functions.binding import evaluated
from ledgerloom.functions.text import partition_key
from ledgerloom.operators.dedupe import dedupe_events

ARRIVAL = ["occurred_at", "l_partkey", "l_suppkey", "side", "quantity", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uuid_of(text: Column) -> Column:
    digest = F.md5(text.cast("binary"))
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)


def _arrivals_of(lineitem: DataFrame) -> DataFrame:
    """What a delivery brings; ``_described`` derives the rest from it, so that this is all a shuffle has to carry."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    sells = (F.col("l_returnflag") == "R") | (line % 2 == 0)
    return lineitem.select(
        (order * 8 + line).alias("id"),
        F.concat(order.cast("string"), F.lit("-"), line.cast("string")).alias("_event"),
        F.when(sells, "SELL").otherwise("BUY").alias("side"),
        (F.col("l_quantity").cast("bigint") * 100_000_000).alias("quantity"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 1_000_000).alias("price"),
        F.col("l_shipdate").cast("timestamp").alias("occurred_at"),
        "l_partkey",
        "l_suppkey",
    )


def _described(arrivals: DataFrame) -> DataFrame:
    return arrivals.select(
        "id",
        uuid_of(F.col("_event")).alias("event_id"),
        F.concat(F.lit("tenant-"), (F.col("l_suppkey") % 20).cast("string")).alias("tenant_id"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 50).cast("string")).alias("instrument"),
        "side",
        "quantity",
        "price",
        F.lit("USD").alias("currency"),
        "occurred_at",
        "l_partkey",
        "l_suppkey",
    )


def deliveries_of(lineitem: DataFrame) -> DataFrame:
    return _described(_arrivals_of(lineitem))


def trade_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per delivery, repeated deliveries included."""
    return deliveries_of(table(spark, sf_dir, "lineitem"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First delivery of every event."""
    arrivals = _arrivals_of(table(spark, sf_dir, "lineitem"))
    return _described(dedupe_events(arrivals, ARRIVAL, "_event")).drop("l_partkey", "l_suppkey")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with outcome and latency in whole microseconds."""
    return calls_of(table(spark, sf_dir, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("call_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("tenant-"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"),
        F.round(F.col("value") * 1000).cast("bigint").alias("latency_us"),
        (F.col("user_id") % 12).alias("partition_id"),
        "user_id",
        "event_type",
    )


# --- raw inputs with deliberate defects, chosen by id -----------------------------------

DEFECT_EVERY = 97


def _defect(number: int) -> Column:
    return F.col("id") % DEFECT_EVERY == number


def with_defects(rows: DataFrame, version: list[str]) -> DataFrame:
    """Column ``value``: the JSON of a trade, broken in one way for some ids."""
    from ledgerloom.functions.text import format_rfc3339

    quantity = (
        F.when(_defect(3), "x").when(_defect(7), "0").when(_defect(13), "0.000000001")
        .otherwise(format_amount(F.col("quantity")))
    )
    price = (
        F.when(_defect(4), "x").when(_defect(12), "1e400").otherwise(format_amount(F.col("price")))
    )
    occurred = format_rfc3339(F.col("occurred_at"))
    event_id = F.when(_defect(2), "not-a-uuid").when(
        _defect(11), F.concat(F.lit("urn:uuid:"), F.upper("event_id"))
    ).otherwise(F.col("event_id"))
    text = F.to_json(
        F.struct(
            event_id.alias("event_id"), "tenant_id",
            *[F.lit(1).cast("smallint").alias(v) for v in version],
            F.when(_defect(15), "aapl").otherwise(F.col("instrument")).alias("instrument"),
            F.when(_defect(6), "HOLD").otherwise(F.col("side")).alias("side"),
            quantity.alias("quantity"),
            price.alias("price"),
            F.when(_defect(16), "usd").otherwise(F.col("currency")).alias("currency"),
            F.when(_defect(5), F.date_format("occurred_at", "yyyy-MM-dd")).otherwise(occurred)
            .alias("occurred_at"),
        )
    )
    rows = evaluated(rows, {"_text": text})
    text = F.col("_text")
    value = (
        F.when(_defect(1), F.regexp_replace(text, r"\}\z", ""))
        .when(_defect(8), F.concat(text, F.lit(" x")))
        .when(_defect(9), F.replace(text, F.lit('"event_id"'), F.lit('"Event_ID"')))
        .when(_defect(10), F.regexp_replace(text, r'"side":"[A-Z]+"', '"side":5'))
        .when(_defect(17), F.concat(text, F.lit(" \n")))
        .otherwise(text)
    )
    return rows.withColumn("value", value).drop("_text")


def rest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defects(trades(spark, sf_dir), []).select("id", "value")


def wire_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire payloads under the key the publisher derives from the event itself."""
    rows = with_defects(trades(spark, sf_dir), ["schema_version"]).withColumn(
        "instrument", F.when(_defect(15), "aapl").otherwise(F.col("instrument"))
    )
    return rows.select(
        "id", partition_key(F.col("tenant_id"), F.col("instrument")).alias("key"), "tenant_id",
        "instrument", "occurred_at", "value",
    )


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(_defect(6), 0).when(F.col("side") == "BUY", 1).otherwise(2)
    return trades(spark, sf_dir).select(
        "id",
        F.when(_defect(2), "not-a-uuid").otherwise(F.col("event_id")).alias("event_id"),
        F.when(_defect(18), "").otherwise(F.col("tenant_id")).alias("tenant_id"),
        F.when(_defect(15), "aapl").otherwise(F.col("instrument")).alias("instrument"),
        code.alias("side"),
        F.when(_defect(7), 0).otherwise(F.col("quantity")).alias("quantity"),
        F.when(_defect(4), 10**18 + 1).otherwise(F.col("price")).alias("price"),
        F.when(_defect(16), "usd").otherwise(F.col("currency")).alias("currency"),
        F.when(~_defect(5), F.col("occurred_at")).alias("occurred_at"),
    )


# --- placement --------------------------------------------------------------------------

TOTAL_PARTITIONS = 24
DEFAULT_PARTITIONS = 1


def reserved(spark: SparkSession, sf_dir: str, nations: tuple[int, int] = (0, 2)) -> DataFrame:
    """Reservations: one partition per supplier a tenant has in the given nations."""
    return (
        table(spark, sf_dir, "supplier")
        .where(F.col("s_nationkey").between(*nations))
        .groupBy(F.concat(F.lit("tenant-"), (F.col("s_suppkey") % 20).cast("string")).alias("tenant_id"))
        .agg(F.count("*").alias("size"))
    )


def arrivals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id").agg(F.min("id").alias("first_seen"))


def placed(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerloom.operators.placement import partition_for

    # Every tenant occurs in the raw deliveries with the same or an earlier id.
    seen = arrivals(trade_deliveries(spark, sf_dir))
    return partition_for(
        rows, seen, reserved(spark, sf_dir), DEFAULT_PARTITIONS, TOTAL_PARTITIONS
    )


def topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire events as topic records; the ledger id serves as offset."""
    return placed(wire_json(spark, sf_dir), spark, sf_dir).select(
        F.lit("trades").alias("topic"), F.col("partition").cast("int").alias("partition"),
        F.col("id").alias("offset"), "key", "value", F.col("occurred_at").alias("timestamp"),
    )


POLL_OFFSETS = 4096


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each poll of a partition returned, with the partition's end at that time."""
    from ledgerloom.operators.validate import decode_wire

    decoded = decode_wire(topic_records(spark, sf_dir))
    poll = F.expr(f"offset div {POLL_OFFSETS}")
    return decoded.select(
        poll.alias("poll"), F.col("partition").cast("bigint").alias("partition"), "offset",
        "tenant_id", F.col("reason").isNull().alias("decodable"),
        ((poll + 1) * POLL_OFFSETS + F.col("partition") * 100).alias("high_watermark"),
    )


def known_tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants with a supplier in credit."""
    return (
        table(spark, sf_dir, "supplier")
        .where("s_acctbal > 5000")
        .select(F.concat(F.lit("tenant-"), (F.col("s_suppkey") % 20).cast("string")).alias("tenant_id"))
        .distinct()
    )


def map_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partition map per order day; a tenant's count is its orders that day, modulo seven."""
    daily = table(spark, sf_dir, "orders").groupBy(
        F.to_date("o_orderdate").alias("day"),
        F.concat(F.lit("tenant-"), (F.col("o_custkey") % 5).cast("string")).alias("tenant_id"),
    ).agg(F.count("*").alias("n"))
    entry = F.struct(
        "tenant_id",
        F.struct(
            (F.col("n") * 2).cast("int").alias("start"), (F.col("n") % 7).cast("int").alias("count")
        ).alias("range"),
    )
    # Five tenants at most, so a version's map is small.
    return daily.groupBy(F.unix_date("day").cast("bigint").alias("version")).agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")
    )


# --- telemetry --------------------------------------------------------------------------

# The usual bounds and three more, so that slow calls fall into finite buckets.
WIDE_BOUNDS_US = [
    25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000,
    250_000, 500_000, 1_000_000,
]
COUNTER_RESET = "2024-01-16 00:00:00"
SCRAPE_S = 3600


def _scrape(calls: DataFrame) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts")) + F.expr("interval 1 hour")
    return calls.withColumn("scraped_at", hour)


def outcome_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call counters per tenant and outcome, scraped hourly, restarted once."""
    from pyspark.sql import Window

    counted = _scrape(call_log(spark, sf_dir)).groupBy("scraped_at", "tenant_id", "outcome").agg(
        F.count("*").alias("n")
    )
    order = (
        Window.partitionBy("tenant_id", "outcome", F.col("scraped_at") > F.lit(COUNTER_RESET))
        .orderBy("scraped_at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return counted.select(
        "tenant_id", "outcome", F.col("scraped_at").alias("ts"),
        F.sum("n").over(order).cast("double").alias("value"),
    )


def bucket_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency bucket counters per tenant, outcome and bound, scraped hourly, restarted once."""
    from pyspark.sql import Window

    from ledgerloom.operators.telemetry import latency_histogram

    hourly = latency_histogram(
        _scrape(call_log(spark, sf_dir)), ["scraped_at", "tenant_id", "outcome"], WIDE_BOUNDS_US
    )
    order = (
        Window.partitionBy(
            "tenant_id", "outcome", "le", F.col("scraped_at") > F.lit(COUNTER_RESET)
        )
        .orderBy("scraped_at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return hourly.select(
        "tenant_id", "outcome", "le", F.col("scraped_at").alias("ts"),
        F.sum("bucket").over(order).cast("double").alias("value"),
    )


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counters in the long form scrapes are stored in."""
    return bucket_samples(spark, sf_dir).select(
        F.lit("processor_transaction_duration_seconds_bucket").alias("metric"),
        F.create_map(
            F.lit("tenant"), F.col("tenant_id"), F.lit("outcome"), F.col("outcome"),
            F.lit("le"), F.col("le").cast("string"),
        ).alias("labels"),
        "ts", "value",
    )


def dependency_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by dependency; sign-ups stand for an expected outcome."""
    return call_log(spark, sf_dir).select(
        F.concat(F.lit("dep-"), (F.col("partition_id") % 3).cast("string")).alias("dependency"),
        "ts", "call_id",
        F.when(F.col("event_type") == "signup", "duplicate").otherwise(F.col("outcome")).alias("outcome"),
    )


def breaker_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly breaker state: open with every third call failing, half open the hour after."""
    from pyspark.sql import Window

    hourly = _scrape(dependency_calls(spark, sf_dir)).groupBy("dependency", "scraped_at").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("outcome") == "failure", 1)).alias("failed")
    )
    is_open = F.col("failed") * 3 >= F.col("n")
    order = Window.partitionBy("dependency").orderBy("scraped_at")
    state = F.when(is_open, 2).when(F.lag(is_open).over(order), 1).otherwise(0)
    return hourly.select("dependency", F.col("scraped_at").alias("ts"), state.cast("bigint").alias("state"))


# --- tenant control ---------------------------------------------------------------------

SPECS = [
    ("tenant-0", 1, 6, 65, 330),
    ("tenant-1", 2, 10, 70, 300),
    ("tenant-2", 3, 8, 60, 400),
    ("tenant-3", 1, 3, 64, 250),
    ("tenant-4", 2, 12, 1000, 350),
]


def tenant_spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SPECS,
        "tenant_id string, min_replicas int, max_replicas int, kafka_lag_threshold bigint, "
        "p99_latency_threshold_ms int",
    )


def tenant_spec_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs that change on the middle day of each tenant's calls. The change comes twice, once more with lower limits."""
    day = F.date_trunc("day", "ts")
    middle = call_log(spark, sf_dir).groupBy("tenant_id").agg(
        (F.min(day) + F.make_interval(days=F.expr("datediff(max(date_trunc('day', ts)), min(date_trunc('day', ts))) div 2")))
        .alias("valid_from")
    )
    first = tenant_spec(spark).withColumn("valid_from", F.lit(None).cast("timestamp"))
    changed = tenant_spec(spark).join(middle, "tenant_id").withColumns(
        {
            "min_replicas": F.col("min_replicas") + 2,
            "max_replicas": F.col("max_replicas") - 1,
            "kafka_lag_threshold": F.col("kafka_lag_threshold") - 3,
            "p99_latency_threshold_ms": F.col("p99_latency_threshold_ms") - 20,
        }
    )
    lower = changed.withColumn("kafka_lag_threshold", F.col("kafka_lag_threshold") - 10)
    return first.unionByName(changed).unionByName(changed).unionByName(lower)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant and day: calls as lag, 99th percentile in ms, partitions with failures."""
    from ledgerloom.operators.telemetry import histogram_quantile, latency_histogram

    calls = call_log(spark, sf_dir).withColumn("observed_at", F.date_trunc("day", "ts"))
    by = ["tenant_id", "observed_at"]
    buckets = latency_histogram(calls, by, WIDE_BOUNDS_US)
    p99 = histogram_quantile(buckets, by, {"q99": 0.99}, "bucket")
    volume = calls.groupBy(*by).agg(
        F.count("*").alias("lag"),
        # Twelve partitions at most.
        F.size(F.collect_set(F.when(F.col("outcome") == "failure", F.col("partition_id")))).alias(
            "partition_count"
        ),
    )
    return volume.join(p99, by).select(
        *by, "lag", F.round(F.col("q99") * 1000).cast("int").alias("p99_ms"), "partition_count"
    )


def resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual clearings of the latch: days on which a tenant had a sign-up in the first minute."""
    calls = call_log(spark, sf_dir)
    early = (F.col("event_type") == "signup") & (F.hour("ts") == 0)
    return calls.where(early).select(
        "tenant_id", F.date_trunc("day", "ts").alias("observed_at")
    ).distinct()
