"""Canonical schemas. Amounts are bigint scaled by 10^8."""

TRADE_EVENT = (
    "event_id string, tenant_id string, schema_version smallint, instrument string, side string, "
    "quantity bigint, price bigint, currency string, occurred_at timestamp"
)
TRANSACTIONS = "id bigint, " + TRADE_EVENT + ", received_at timestamp"
RECONCILED_STATE = (
    "tenant_id string, instrument string, position bigint, average_cost bigint, "
    "realized_pnl bigint, last_transaction_id bigint, updated_at timestamp"
)
TOPIC_RECORD = (
    "topic string, partition int, offset bigint, key string, value string, timestamp timestamp"
)
DLQ = (
    "original_topic string, original_partition int, original_offset bigint, payload string, "
    "failure_reason string, attempts int, failed_at timestamp, key string"
)
TENANT_SPEC = (
    "tenant_id string, min_replicas int, max_replicas int, kafka_lag_threshold bigint, "
    "p99_latency_threshold_ms int"
)
SIGNALS = (
    "tenant_id string, observed_at timestamp, lag bigint, p99_ms int, partition_count int, "
    "partition_start int"
)
METRIC_SAMPLES = "metric string, labels map<string,string>, ts timestamp, value double"
TYPED_EVENT = (
    "event_id string, tenant_id string, instrument string, side int, quantity bigint, "
    "price bigint, currency string, occurred_at timestamp"
)
