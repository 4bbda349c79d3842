"""Declared schemas of the entities (names and types are fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "DOUBLE": T.DoubleType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP": T.TimestampType(),
}


def _struct(text: str) -> T.StructType:
    """Nullable fields from ``name TYPE, ...`` (needs no session, unlike DDL parsing)."""
    pairs = (field.split() for field in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Where a reader puts a record it cannot parse.
CORRUPT = "_corrupt_record"

# Historical transaction as it arrives: timestamp is epoch seconds or ISO text.
RAW_TRANSACTION = _struct(
    "transaction_id STRING, user_id STRING, merchant_id STRING, item_name STRING,"
    " amount DOUBLE, currency STRING, timestamp STRING, lat DOUBLE, lon DOUBLE,"
    " card_provider STRING, location STRING, vector_text STRING"
)

# Payload of one live message. Fields that scoring does not need are read as
# text, so that an odd value in them does not make the message unusable.
LIVE_TRANSACTION = _struct(
    "transaction_id STRING, user_id STRING, merchant_id STRING, amount DOUBLE,"
    " currency STRING, timestamp STRING, card_provider STRING, location STRING,"
    " run_id STRING, is_fraud STRING, synthetic STRING, device_info STRING, category STRING"
)

USER_PROFILE = _struct(
    "user_id STRING, first_seen BIGINT, preferred_card STRING, user_segment STRING,"
    " home_location STRING, registration_date BIGINT"
)

RESULT_MESSAGE = _struct(
    "data STRING, transaction_id STRING, is_fraud STRING, fraud_probability STRING,"
    " user_id STRING, worker_id STRING, latency_ms STRING, run_id STRING"
)

STATS_EVENT = _struct(
    "run_id STRING, worker_id STRING, transaction_id STRING, latency_ms DOUBLE,"
    " is_fraud BOOLEAN, batch_processed BOOLEAN, batch_size INT, timestamp TIMESTAMP"
)

# A committed micro-batch: times in microseconds since 1970, the reach of its transactions in seconds.
COMMIT = _struct(
    "source STRING, batch_id BIGINT, attempt STRING, committed_at BIGINT, messages BIGINT, transactions BIGINT,"
    " fraud_count BIGINT, oldest BIGINT, newest BIGINT, batch_ms DOUBLE, avg_ms DOUBLE"
)

WORKER_SNAPSHOT = _struct(
    "run_id STRING, worker_id STRING, transactions BIGINT, fraud_count BIGINT, latency_count BIGINT,"
    " min_ms DOUBLE, max_ms DOUBLE, p50_ms DOUBLE, p95_ms DOUBLE, p99_ms DOUBLE, avg_ms DOUBLE, batch_size INT,"
    " parallel_mode BOOLEAN, threads INT, start_time TIMESTAMP, processing_time DOUBLE, throughput DOUBLE,"
    " fraud_ratio DOUBLE, saved_at TIMESTAMP"
)

RUN_CHANGE = _struct(
    "run_id STRING, seq BIGINT, start_time TIMESTAMP, end_time TIMESTAMP, pattern STRING,"
    " target_tps DOUBLE, fraud_ratio DOUBLE, thread_count INT, complete BOOLEAN,"
    " transactions BIGINT, fraud_count BIGINT, fraud_percentage DOUBLE,"
    " duration_seconds DOUBLE, actual_tps DOUBLE"
)

NUMERIC_FEATURES = (
    "amount",
    "hour",
    "day_of_week",
    "is_weekend",
    "transaction_velocity",
    "avg_transaction_amount",
    "amount_vs_average_ratio",
    "days_since_first_seen",
)

CATEGORICAL_FEATURES = (
    "card_provider",
    "merchant_id",
    "amount_category",
    "user_segment",
    "is_preferred_card",
    "is_home_location",
)

MODEL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES


def require_columns(df, names, what: str = "features") -> None:
    """Fail before any job starts if ``df`` lacks one of ``names``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing {what}: {', '.join(missing)}")
