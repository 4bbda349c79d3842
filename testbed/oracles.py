"""DuckDB statements that say, independently, what each registered query must return."""

from __future__ import annotations

from testbed.views import dialect, with_views

ORACLES: dict[str, str] = {}


def _put(name: str, views: list[str], body: str) -> None:
    ORACLES[name] = with_views(views, dialect(body, "duckdb"))


def _r2(x: str) -> str:
    return f"floor(({x}) * 100e0 + 0.5e0) / 100e0"


def _r4(x: str) -> str:
    return f"floor(({x}) * 10000e0 + 0.5e0) / 10000e0"


_MONEY = "DECIMAL(24,6)"
_SEGMENT = "CASE WHEN {0} > 5000 THEN 'PREMIUM' WHEN {0} > 1000 THEN 'STANDARD' ELSE 'BASIC' END"
_CATEGORY = "WHEN amount <= 100 THEN 'low' WHEN amount <= 500 THEN 'medium' WHEN amount <= 1000 THEN 'high' ELSE 'very_high' END"


def _epoch(x: str) -> str:
    return (
        f"coalesce(CAST(floor(TRY_CAST(trim({x}) AS DECIMAL(27,9))) AS BIGINT),"
        f" CAST(floor(epoch(TRY_CAST(trim({x}) AS TIMESTAMPTZ))) AS BIGINT))"
    )


def _mode(name: str, rows: str, value: str, where: str) -> str:
    """CTE: per user the most frequent value; earliest seen, then smallest, on ties."""
    return (
        f"{name} AS (SELECT user_id, value AS {name}_value FROM (SELECT user_id, value,"
        " row_number() OVER (PARTITION BY user_id ORDER BY c DESC, f, value) AS rn"
        f" FROM (SELECT user_id, {value} AS value, count(*) AS c, min(timestamp) AS f FROM {rows}"
        f" WHERE {where} GROUP BY 1, 2)) WHERE rn = 1)"
    )


def _profiles(rows: str) -> str:
    return (
        _mode("pc", rows, "coalesce(card_provider, 'UNKNOWN')", "true")
        + ", "
        + _mode("ph", rows, "location", "location IS NOT NULL AND location <> ''")
        + f""", profiles AS (SELECT t.user_id, t.first_seen, pc_value AS preferred_card,
 {_SEGMENT.format('t.spend')} AS user_segment, coalesce(ph_value, '0,0') AS home_location,
 t.first_seen AS registration_date
 FROM (SELECT user_id, min(timestamp) AS first_seen, sum(CAST(amount AS {_MONEY})) AS spend FROM {rows} GROUP BY 1) t
 LEFT JOIN pc USING (user_id) LEFT JOIN ph USING (user_id))"""
    )


# --- scans and sinks -------------------------------------------------------

_put(
    "scan_json_txns",
    ["deliveries"],
    f"""SELECT transaction_id, user_id, merchant_id, item_name, amount, currency,
 {_epoch('timestamp')} AS timestamp, lat, lon, card_provider,
 CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR) AS location, vector_text FROM deliveries""",
)
_put(
    "load_history",
    ["deliveries"],
    f"""SELECT transaction_id, user_id, merchant_id, item_name, amount, currency, {_epoch('timestamp')} AS timestamp,
 card_provider, coalesce(location, CAST(lon AS VARCHAR) || ',' || CAST(lat AS VARCHAR)) AS location, vector_text, seq
 FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY seq DESC) AS rn FROM deliveries) WHERE rn = 1""",
)
_REJECTED = f"""reasoned AS (SELECT *, {_epoch('timestamp')} AS epoch, CASE WHEN coalesce(trim(transaction_id), '') = '' THEN 'no transaction id'
 WHEN coalesce(trim(user_id), '') = '' THEN 'no user' WHEN {_epoch('timestamp')} IS NULL THEN 'unreadable time'
 WHEN isnan(amount) OR isinf(amount) OR abs(amount) >= 1e18 THEN 'unusable amount' END AS reason FROM rough_deliveries)"""
_put("rejected_history", ["rough_deliveries"], f", {_REJECTED} SELECT seq, transaction_id, user_id, reason FROM reasoned WHERE reason IS NOT NULL")
_put(
    "load_rough_history",
    ["rough_deliveries"],
    f""", {_REJECTED} SELECT transaction_id, user_id, amount, epoch AS timestamp, location, seq FROM
 (SELECT * REPLACE ('2.0,1.0' AS location), row_number() OVER (PARTITION BY transaction_id ORDER BY seq DESC) AS rn FROM reasoned WHERE reason IS NULL)
 WHERE rn = 1""",
)
_put(
    "rough_history_averages",
    ["rough_deliveries"],
    f""", {_REJECTED}, dated AS (SELECT *, CASE WHEN abs(amount) < 1e18 THEN CAST(amount AS {_MONEY}) END AS money FROM reasoned
 WHERE user_id IS NOT NULL AND epoch IS NOT NULL)
 SELECT seq, floor(coalesce((SELECT CAST(sum(b.money) AS DOUBLE) / count(b.money) FROM dated b
 WHERE b.user_id = a.user_id AND b.epoch < a.epoch), 0e0) * 1000000e0 + 0.5e0) / 1000000e0 AS avg_transaction_amount
 FROM dated a""",
)
_put("parquet_round_trip", ["txns"], "SELECT transaction_id, user_id, amount, timestamp FROM txns")
_put(
    "latest_by_key",
    ["deliveries"],
    """SELECT transaction_id, seq, user_id, amount, card_provider
 FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY seq DESC) AS rn FROM deliveries) WHERE rn = 1""",
)

_REASONED = """parsed AS (SELECT event_id, data, CASE WHEN json_valid(data) THEN data END AS j FROM messages),
 reasoned AS (SELECT *, CASE WHEN data IS NULL THEN 'no payload'
 WHEN contains(data, '"amount":NaN') OR contains(data, '"amount":1e19') THEN 'unusable amount' WHEN j IS NULL OR json_type(j) <> 'OBJECT'
 OR json_type(j, '$.amount') = 'VARCHAR' THEN 'malformed'
 WHEN json_extract_string(j, '$.timestamp') = 'soon' THEN 'unreadable time' END AS reason FROM parsed)"""
_DECODED = _REASONED + f""", decoded AS (SELECT event_id, json_extract_string(j, '$.transaction_id') AS transaction_id,
 json_extract_string(j, '$.user_id') AS user_id, json_extract_string(j, '$.merchant_id') AS merchant_id,
 CAST(json_extract_string(j, '$.amount') AS DOUBLE) AS amount,
 {_epoch("json_extract_string(j, '$.timestamp')")} AS timestamp,
 json_extract_string(j, '$.card_provider') AS card_provider, json_extract_string(j, '$.location') AS location,
 json_extract_string(j, '$.run_id') AS run_id, CAST(json_extract_string(j, '$.is_fraud') AS INT) AS is_fraud,
 CAST(json_extract_string(j, '$.synthetic') AS INT) AS synthetic FROM reasoned WHERE reason IS NULL)"""
_put("decode_messages", ["messages"], f", {_DECODED} SELECT * FROM decoded")
_put("dead_letters", ["messages"], f", {_REASONED} SELECT event_id, data, reason FROM reasoned WHERE reason IS NOT NULL")
_put(
    "stream_dead_letters",
    ["messages"],
    f", {_REASONED} SELECT data, reason FROM reasoned WHERE reason IS NOT NULL",
)
_put(
    "stream_transactions",
    ["messages"],
    f""", {_DECODED} SELECT transaction_id, user_id, merchant_id, amount, timestamp, card_provider, location,
 coalesce(run_id, 'unknown') AS run_id, is_fraud AS label FROM decoded""",
)
_put(
    "latest_predictions",
    ["deliveries"],
    """SELECT transaction_id, seq, user_id, CAST(seq % 100 AS DOUBLE) / 100 AS fraud_probability,
 CASE WHEN CAST(seq % 100 AS DOUBLE) / 100 >= 0.7e0 THEN 1 ELSE 0 END AS is_fraud
 FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY seq DESC) AS rn FROM deliveries) WHERE rn = 1""",
)

_RUN_FIELDS = (
    "start_time", "end_time", "pattern", "target_tps", "fraud_ratio", "thread_count",
    "complete", "transactions", "fraud_count", "duration_seconds", "actual_tps",
)
_RUN_DEFAULTS = {"pattern": "'constant'", "target_tps": "0e0", "fraud_ratio": "0.1e0", "thread_count": "1", "complete": "false"}


def _defaulted() -> str:
    return ", ".join(
        f"coalesce({f}, {_RUN_DEFAULTS[f]}) AS {f}" if f in _RUN_DEFAULTS else f for f in _RUN_FIELDS
    )


_put(
    "run_metadata",
    ["run_log"],
    f"""SELECT run_id, {_defaulted()} FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rn
 FROM run_log) WHERE rn = 1""",
)
_MERGED = "merged AS (SELECT run_id, " + ", ".join(
    f"(array_agg({f} ORDER BY seq DESC) FILTER (WHERE {f} IS NOT NULL))[1] AS {f}" for f in _RUN_FIELDS
) + " FROM run_log GROUP BY run_id)"
_RUNS = f"{_MERGED}, runs AS (SELECT run_id, {_defaulted()} FROM merged)"
_put("run_metadata_merge", ["run_log"], f", {_MERGED} SELECT * FROM merged")
_put(
    "retention",
    ["results"],
    """SELECT transaction_id, run_id, worker_id FROM results
 WHERE timestamp >= (SELECT max(timestamp) FROM results) - INTERVAL 24 HOUR""",
)
_put(
    "purge",
    ["scored", "run_log"],
    """SELECT 'predictions' AS "table", CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'results', count(*) FROM scored
 UNION ALL SELECT 'kept', count(*) FROM run_log""",
)

_put(
    "run_log_expiry",
    ["run_log"],
    """, early AS (SELECT * FROM run_log WHERE seq % 3 < 2),
 kept AS (SELECT run_id FROM early GROUP BY 1 HAVING max(seq) >= (SELECT max(seq) FROM early) - 100)
 SELECT run_id, seq, pattern, complete, transactions FROM run_log WHERE seq % 3 = 2 OR run_id IN (SELECT run_id FROM kept)""",
)

# --- scalar functions ------------------------------------------------------

_put("parse_timestamp", ["time_texts"], f"SELECT event_id, {_epoch('raw')} AS epoch FROM time_texts")
_TIME = """hour(make_timestamp(timestamp * 1000000)) AS hour,
 isodow(make_timestamp(timestamp * 1000000)) - 1 AS day_of_week,
 CASE WHEN isodow(make_timestamp(timestamp * 1000000)) >= 6 THEN 1 ELSE 0 END AS is_weekend"""
_put("time_features", ["txns"], f"SELECT transaction_id, timestamp, {_TIME} FROM txns")
_put(
    "amount_category",
    ["amounts"],
    f"""SELECT event_id, CASE WHEN amount IS NULL OR amount <= 0 THEN NULL {_CATEGORY} AS batch_category,
 CASE WHEN amount IS NULL THEN 'low' {_CATEGORY} AS serving_category FROM amounts""",
)


def _km(a: str, b: str) -> str:
    part = lambda s, i: f"CAST(split_part({s}, ',', {i}) AS DOUBLE)"
    dlat, dlon = f"({part(b, 2)} - {part(a, 2)})", f"({part(b, 1)} - {part(a, 1)})"
    return f"CASE WHEN {b} <> '0,0' THEN sqrt({dlat} * {dlat} + {dlon} * {dlon}) * 111.2e0 END"


_HOMES = f", {_profiles('txns')}, homes AS (SELECT transaction_id, location, coalesce(home_location, '0,0') AS home" \
    " FROM txns LEFT JOIN profiles USING (user_id))"
_put(
    "near_home",
    ["txns"],
    f"{_HOMES} SELECT transaction_id, CASE WHEN {_km('location', 'home')} <= 10 THEN 1 ELSE 0 END AS near_home FROM homes",
)
_put(
    "location_deviation",
    ["txns"],
    f"{_HOMES} SELECT transaction_id, round({_km('location', 'home')}, 6) AS km_from_home FROM homes",
)

# --- profiles --------------------------------------------------------------

_put("user_profiles", ["txns"], f", {_profiles('txns')} SELECT * FROM profiles")
_put(
    "preferred_card",
    ["order_txns"],
    f", {_mode('pc', 'order_txns', 'card_provider', 'true')} SELECT user_id, pc_value AS card_provider FROM pc",
)
_put(
    "home_location",
    ["txns"],
    f", {_mode('ph', 'txns', 'location', 'true')} SELECT user_id, ph_value AS location FROM ph",
)
_put(
    "user_segments",
    ["order_txns"],
    f"""SELECT user_id, CAST(spend AS DOUBLE) AS total_spend, {_SEGMENT.format('spend')} AS user_segment
 FROM (SELECT user_id, sum(CAST(amount AS {_MONEY})) AS spend FROM order_txns GROUP BY 1)""",
)
_put("user_count", ["order_txns"], "SELECT count(DISTINCT user_id) AS users FROM order_txns")
_LOOKUP = """coalesce(first_seen, 0) AS first_seen, coalesce(preferred_card, 'UNKNOWN') AS preferred_card,
 coalesce(user_segment, 'NEW') AS user_segment, coalesce(home_location, '0,0') AS home_location,
 coalesce(registration_date, 0) AS registration_date"""
_put(
    "profile_lookup",
    ["txns"],
    f", {_profiles('txns')} SELECT transaction_id, user_id, {_LOOKUP} FROM txns LEFT JOIN profiles USING (user_id)",
)

# --- batch features --------------------------------------------------------


def _windows(rows: str) -> str:
    prior = "PARTITION BY user_id ORDER BY timestamp RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    recent = "PARTITION BY user_id ORDER BY timestamp RANGE BETWEEN 2591999 PRECEDING AND 1 PRECEDING"
    return f"""windowed AS (SELECT *, count(*) OVER p AS n_prior, sum(CAST(amount AS {_MONEY})) OVER p AS spend_prior,
 max(timestamp) OVER p AS previous, count(*) OVER r AS n_recent, min(timestamp) OVER r AS oldest,
 min(timestamp) OVER (PARTITION BY user_id) AS first_seen FROM {rows} WINDOW p AS ({prior}), r AS ({recent})),
 history_rows AS (SELECT *,
 CASE WHEN n_recent > 0 THEN n_recent / greatest(1e0, (timestamp - oldest) / 86400e0) ELSE 0e0 END AS transaction_velocity,
 CASE WHEN n_prior > 0 THEN CAST(spend_prior AS DOUBLE) / n_prior ELSE 0e0 END AS avg_transaction_amount,
 CASE WHEN n_prior > 0 THEN (timestamp - first_seen) / 86400e0 ELSE 0e0 END AS days_since_first_seen,
 timestamp - previous AS time_since_last_txn FROM windowed)"""


_RATIO = "CASE WHEN avg_transaction_amount > 0 THEN amount / avg_transaction_amount ELSE 1e0 END"


def _offline(rows: str) -> str:
    return f"""{_windows(rows)}, {_mode('pc', rows, 'card_provider', 'card_provider IS NOT NULL')},
 {_mode('ph', rows, 'location', 'location IS NOT NULL')},
 spends AS (SELECT user_id, sum(CAST(amount AS {_MONEY})) AS spend FROM {rows} GROUP BY 1),
 offline AS (SELECT h.*, {_TIME}, CASE WHEN amount <= 0 THEN NULL {_CATEGORY} AS amount_category,
 {_RATIO} AS amount_vs_average_ratio,
 CASE WHEN n_prior > 0 AND card_provider = pc_value THEN 1 ELSE 0 END AS is_preferred_card,
 CASE WHEN n_prior > 0 AND location = ph_value THEN 1 ELSE 0 END AS is_home_location,
 CASE WHEN n_prior > 0 THEN {_SEGMENT.format('spend')} ELSE 'NEW' END AS user_segment
 FROM history_rows h LEFT JOIN pc USING (user_id) LEFT JOIN ph USING (user_id) LEFT JOIN spends USING (user_id))"""


_OFFLINE_COLUMNS = """hour, day_of_week, is_weekend, amount_category, transaction_velocity, avg_transaction_amount,
 amount_vs_average_ratio, days_since_first_seen, is_preferred_card, is_home_location, user_segment"""
_put(
    "offline_features",
    ["txns"],
    f""", {_offline('txns')} SELECT transaction_id, user_id, merchant_id, amount, timestamp, card_provider, location,
 {_OFFLINE_COLUMNS} FROM offline""",
)
_put(
    "offline_features_sparse",
    ["order_txns"],
    f""", {_offline('order_txns')} SELECT transaction_id, user_id, amount, timestamp, card_provider, location,
 {_OFFLINE_COLUMNS} FROM offline""",
)
for _name, _column in {
    "txn_velocity_30d": "transaction_velocity",
    "prior_avg_amount": "avg_transaction_amount",
    "amount_ratio": f"{_RATIO} AS amount_vs_average_ratio",
    "days_since_first_seen": "days_since_first_seen",
    "time_since_last_txn": "time_since_last_txn",
}.items():
    _put(_name, ["order_txns"], f", {_windows('order_txns')} SELECT transaction_id, {_column} FROM history_rows")
_put(
    "recent_transactions",
    ["txns"],
    """SELECT transaction_id, user_id, timestamp, amount, recency FROM (SELECT *, row_number() OVER
 (PARTITION BY user_id ORDER BY timestamp DESC, transaction_id DESC) AS recency FROM txns) WHERE recency <= 10""",
)
_put("user_history", ["txns"], "SELECT transaction_id, user_id, amount, timestamp FROM txns WHERE user_id = 'USER7'")
_put(
    "search_txns",
    ["deliveries"],
    f"""SELECT seq, transaction_id, user_id, amount, location FROM deliveries
 WHERE card_provider IN ('VISA', 'AMEX') AND currency = 'USD' AND amount BETWEEN 50 AND 900
 AND regexp_matches(lower(vector_text), '\\buser\\b') AND regexp_matches(lower(item_name), '\\bitem\\b')
 AND {_km('location', "'-74.0059,40.7128'")} <= 15""",
)
_SCORE = f"""offline_scores AS (SELECT transaction_id, amount / (SELECT max(amount) FROM txns) * 0.4e0
 + greatest(0e0, least(5e0, amount_vs_average_ratio)) / 5e0 * 0.3e0 + (1 - is_preferred_card) * 0.2e0
 + (1 - is_home_location) * 0.1e0
 + sqrt(ln((CAST('0x' || substr(md5('42:' || transaction_id), 1, 8) AS BIGINT) + 1) / 4294967296e0) * -2e0)
 * cos(CAST('0x' || substr(md5('42:' || transaction_id), 9, 8) AS BIGINT) / 4294967296e0 * 6.283185307179586e0) * 0.1e0
 AS raw FROM offline),
 scores AS (SELECT transaction_id, floor((raw - lo) / (hi - lo) * 1e9 + 0.5e0) / 1e9 AS score FROM offline_scores
 JOIN (SELECT min(raw) AS lo, max(raw) AS hi FROM offline_scores) ON true)"""
_put(
    "fraud_score",
    ["txns"],
    f", {_offline('txns')}, {_SCORE} SELECT transaction_id, round(score, 6) AS fraud_score FROM scores",
)
_put(
    "fraud_labels",
    ["txns"],
    f""", {_offline('txns')}, {_SCORE} SELECT transaction_id, CASE WHEN row_number() OVER
 (ORDER BY score DESC, md5(transaction_id), transaction_id) <= (SELECT floor(count(*) * 0.15e0) FROM txns)
 THEN 1 ELSE 0 END AS is_fraud FROM scores""",
)
_put(
    "stratified_split",
    ["scored"],
    """, sizes AS (SELECT label, count(*) AS size FROM scored GROUP BY 1),
 wanted AS (SELECT ceil(sum(size) * 0.2e0) AS w, sum(size) AS n FROM sizes),
 shares AS (SELECT label, floor(size * w / n) AS share, size * w / n - floor(size * w / n) AS part, w
 FROM sizes JOIN wanted ON true),
 quotas AS (SELECT label, share + CASE WHEN row_number() OVER (ORDER BY part DESC, label)
 <= w - sum(share) OVER () THEN 1 ELSE 0 END AS quota FROM shares)
 SELECT transaction_id, label, CASE WHEN row_number() OVER (PARTITION BY label
 ORDER BY md5('42:' || transaction_id), transaction_id) <= quota THEN 1 ELSE 0 END AS is_test
 FROM scored JOIN quotas USING (label)""",
)

# --- serving features ------------------------------------------------------


def _served(asking: str, stored: str, upper: str = "") -> str:
    return f"""{_profiles(stored)},
 asks AS (SELECT DISTINCT user_id, timestamp FROM {asking}),
 counted AS (SELECT a.user_id, a.timestamp, count(s.transaction_id) AS n,
 coalesce(CAST(sum(CAST(s.amount AS {_MONEY})) AS DOUBLE), 0e0) AS spend FROM asks a LEFT JOIN {stored} s
 ON s.user_id = a.user_id AND s.timestamp >= a.timestamp - 2592000 {upper} GROUP BY 1, 2),
 metrics AS (SELECT user_id, timestamp, n AS transaction_count_30d, n / 30e0 AS transaction_velocity,
 spend / greatest(1, n) AS avg_transaction_amount,
 (timestamp - coalesce(first_seen, 0)) / 86400e0 AS days_since_first_seen
 FROM counted LEFT JOIN profiles USING (user_id))"""


_put("serving_metrics", ["history", "live"], f", {_served('live', 'history')} SELECT * FROM metrics")
_put(
    "serving_metrics_as_of",
    ["txns"],
    f", {_served('txns', 'txns', 'AND s.timestamp < a.timestamp')}"
    " SELECT user_id, timestamp, transaction_count_30d, avg_transaction_amount FROM metrics",
)


def _features(asking: str, stored: str) -> str:
    return f"""{_served(asking, stored)}, served AS (SELECT t.transaction_id, amount, {_TIME}, transaction_velocity,
 avg_transaction_amount, {_RATIO} AS amount_vs_average_ratio, days_since_first_seen,
 coalesce(card_provider, 'UNKNOWN') AS card_provider, merchant_id, CASE {_CATEGORY} AS amount_category,
 coalesce(user_segment, 'NEW') AS user_segment,
 CASE WHEN card_provider = coalesce(preferred_card, 'UNKNOWN') THEN 1 ELSE 0 END AS is_preferred_card,
 CASE WHEN {_km('location', "coalesce(home_location, '0,0')")} <= 10 THEN 1 ELSE 0 END AS is_home_location
 FROM {asking} t JOIN metrics USING (user_id, timestamp) LEFT JOIN profiles USING (user_id))"""


_put(
    "user_data",
    ["history", "live"],
    f""", {_served('live', 'history')}, newest AS (SELECT user_id, string_agg(transaction_id, ',' ORDER BY rn) AS ids
 FROM (SELECT user_id, transaction_id, row_number() OVER (PARTITION BY user_id
 ORDER BY timestamp DESC, transaction_id DESC) AS rn FROM history) WHERE rn <= 10 GROUP BY 1)
 SELECT m.user_id, timestamp, coalesce(preferred_card, 'UNKNOWN') AS preferred_card, transaction_count_30d,
 coalesce(ids, '') AS recent_ids FROM metrics m LEFT JOIN profiles USING (user_id) LEFT JOIN newest USING (user_id)""",
)
_put("serving_features", ["history", "live"], f", {_features('live', 'history')} SELECT * FROM served")
_NUMERIC = (
    "amount", "hour", "day_of_week", "is_weekend", "transaction_velocity", "avg_transaction_amount",
    "amount_vs_average_ratio", "days_since_first_seen",
)
_put(
    "scaler_fit",
    ["txns"],
    f", {_features('txns', 'txns')} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM served"
        for c in _NUMERIC
    ),
)
_put(
    "scaled_features",
    ["txns"],
    f", {_features('txns', 'txns')}, fitted AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _NUMERIC)
    + " FROM served) SELECT transaction_id, "
    + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 6) AS {c}" for c in _NUMERIC)
    + " FROM served JOIN fitted ON true",
)
_CATEGORICAL = (
    "card_provider", "merchant_id", "amount_category", "user_segment", "is_preferred_card", "is_home_location",
)
_put(
    "encoder_fit",
    ["txns"],
    f", {_features('txns', 'txns')} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS category, count(*) AS rows FROM served GROUP BY 2"
        for c in _CATEGORICAL
    ),
)
_put(
    "encoded_features",
    ["txns"],
    f", {_features('txns', 'txns')} SELECT transaction_id, (SELECT 8 + "
    + " + ".join(f"count(DISTINCT {c})" for c in _CATEGORICAL)
    + " FROM served) AS width, "
    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _CATEGORICAL)
    + " FROM served",
)

# --- the model: what holds of it whatever it learnt ------------------------

_put(
    "train_eval",
    ["txns"],
    """, n AS (SELECT count(*) AS n, floor(count(*) * 0.15e0) AS ones, ceil(count(*) * 0.2e0) AS wanted FROM txns),
 s AS (SELECT *, (n - ones) * wanted / n AS s0, ones * wanted / n AS s1 FROM n),
 q AS (SELECT *, wanted - floor(s0) - floor(s1) AS spare, s0 - floor(s0) AS r0, s1 - floor(s1) AS r1 FROM s)
 SELECT CAST(wanted AS BIGINT) AS rows,
 CAST(floor(s0) + CASE WHEN spare = 1 AND r0 >= r1 THEN 1 ELSE 0 END AS BIGINT) AS negatives,
 CAST(floor(s1) + CASE WHEN spare = 1 AND r1 > r0 THEN 1 ELSE 0 END AS BIGINT) AS positives,
 true AS all_counted, true AS in_range FROM q""",
)
_put(
    "score_batch",
    ["txns"],
    """SELECT transaction_id, user_id, merchant_id, amount, timestamp, card_provider, location,
 true AS in_range, true AS flag_fits FROM txns""",
)
_put("forest_walk", ["txns"], "SELECT transaction_id, true AS walk_agrees, true AS flag_agrees FROM txns")
_put(
    "model_versions",
    ["txns"],
    """SELECT 'fraud-detection-model' AS name, description, has_metrics, n AS rows_scored
 FROM (VALUES ('first', false), ('second', true)) t(description, has_metrics), (SELECT count(*) AS n FROM txns)""",
)
_put(
    "stream_progress",
    ["messages"],
    f""", {_DECODED} SELECT (SELECT count(*) FROM messages) AS messages, count(*) AS transactions,
 (SELECT count(*) FROM messages) - count(*) AS dead, true AS adds_up, true AS no_gap, true AS timed FROM decoded""",
)
_put(
    "stream_score",
    ["messages"],
    f""", {_DECODED} SELECT transaction_id, user_id, coalesce(run_id, 'unknown') AS run_id, amount, timestamp,
 true AS in_range, true AS flag_fits FROM decoded""",
)
_put(
    "stream_results",
    ["messages"],
    f""", {_DECODED} SELECT transaction_id, user_id, 'spark' AS worker_id, coalesce(run_id, 'unknown') AS run_id,
 true AS in_range, true AS flag_fits, merchant_id, true AS batched, true AS measured, true AS stamped FROM decoded""",
)
_put(
    "batch_stats",
    ["messages"],
    f", {_DECODED} SELECT count(*) AS transactions, true AS fraud_fits, true AS times_fit FROM decoded",
)
_put(
    "live_worker_stats",
    ["messages"],
    f""", {_DECODED} SELECT coalesce(run_id, 'unknown') AS run_id, 'spark' AS worker_id, count(*) AS transactions,
 count(*) AS latency_count, true AS ordered, true AS fraud_fits FROM decoded GROUP BY 1""",
)

# --- statistics mart -------------------------------------------------------


def _latency(rows: str, keys: str, value: str = "latency_ms") -> str:
    """Latency columns per group, by sorting each group; rows with n < 10 take one sample."""

    def pick(q: float) -> str:
        lo = f"list_extract(v, CAST(floor((n - 1) * {q}e0) AS BIGINT) + 1)"
        hi = f"list_extract(v, CAST(ceil((n - 1) * {q}e0) AS BIGINT) + 1)"
        part = f"((n - 1) * {q}e0 - floor((n - 1) * {q}e0))"
        few = f"list_extract(v, CAST(floor(n * {q}e0) AS BIGINT) + 1)"
        return _r2(f"CASE WHEN n >= 10 THEN {lo} + ({hi} - {lo}) * {part} ELSE {few} END")

    return f"""SELECT {keys}, {_r2("total / n")} AS avg_ms, {pick(0.5)} AS p50_ms, {pick(0.95)} AS p95_ms,
 {pick(0.99)} AS p99_ms, {_r2("lo")} AS min_ms, {_r2("hi")} AS max_ms, n AS count FROM
 (SELECT {keys}, CAST(sum(CAST({value} AS {_MONEY})) AS DOUBLE) AS total, count({value}) AS n, min({value}) AS lo,
 max({value}) AS hi, list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL)) AS v FROM {rows} GROUP BY {keys})
 WHERE n > 0"""


_put("latency_stats", ["results"], _latency("results", "run_id, worker_id"))
_put(
    "latency_small_sample",
    ["results"],
    ", daily AS (SELECT *, strftime(timestamp, '%Y%m%d') AS day FROM results) " + _latency("daily", "day, user_num"),
)
_ZERO = ", ".join(f"coalesce({c}, 0e0) AS {c}" for c in ("avg_ms", "p50_ms", "p95_ms", "p99_ms", "min_ms", "max_ms"))
_SPAN = "CAST(epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS DOUBLE) / 1e6"


def _per_second(n: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN {_r2(f'{n} / {t}')} ELSE 0e0 END"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {_r4(f'CAST({a} AS DOUBLE) / {b}')} ELSE 0e0 END"


_WORKERS = f"""masked AS (SELECT * REPLACE (CASE WHEN worker_id <> 'generator' THEN latency_ms END AS latency_ms) FROM results),
 lat AS ({_latency('masked', 'run_id, worker_id')}),
 counts AS (SELECT run_id, worker_id, count(*) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
 max(batch_size) AS batch_size, min(timestamp) AS start_time, {_SPAN} AS processing_time FROM results GROUP BY 1, 2),
 workers AS (SELECT run_id, worker_id, transactions, fraud_count, batch_size, false AS parallel_mode, 1 AS threads, start_time, processing_time, {_ZERO},
 coalesce(count, 0) AS latency_count, {_per_second('transactions', 'processing_time')} AS throughput,
 {_share('fraud_count', 'transactions')} AS fraud_ratio FROM counts LEFT JOIN lat USING (run_id, worker_id))"""
_put("worker_stats", ["results"], f", {_WORKERS} SELECT * FROM workers")
_put(
    "worker_stats_snapshot",
    ["results"],
    f", {_WORKERS} SELECT run_id, worker_id, transactions, fraud_count, p95_ms FROM workers",
)


def _merge(count: str) -> str:
    some = f"FILTER (WHERE {count} > 0)"
    weighted = f"CAST(sum(CAST(avg_ms AS DECIMAL(18,6)) * {count}) {some} AS DOUBLE) / sum({count}) {some}"
    columns = [f"coalesce({_r2(weighted)}, 0e0) AS avg_ms"]
    columns += [f"coalesce(max({c}) {some}, 0e0) AS {c}" for c in ("p50_ms", "p95_ms", "p99_ms", "max_ms")]
    columns += [f"coalesce(min(min_ms) {some}, 0e0) AS min_ms", f"CAST(coalesce(sum({count}) {some}, 0) AS BIGINT) AS {count}"]
    return ", ".join(columns)


_put(
    "latency_merge",
    ["results"],
    f", {_WORKERS} SELECT run_id, {_merge('latency_count')} FROM workers GROUP BY run_id",
)
_DAILY = f"""days AS (SELECT * REPLACE (CASE WHEN user_num % 7 <> 0 THEN latency_ms END AS latency_ms),
 strftime(timestamp, '%Y%m%d') AS day FROM results),
 dlat AS ({_latency('days', 'run_id, worker_id, day')}),
 dcount AS (SELECT run_id, worker_id, day, count(*) AS transactions, sum(is_fraud) AS fraud_count,
 max(batch_size) AS batch_size, bool_or(batch_size > 9) AS parallel_mode, max(batch_size % 4) AS threads,
 min(timestamp) AS start_time, count(*) * 2e0 AS processing_time FROM days GROUP BY 1, 2, 3),
 daily AS (SELECT * EXCLUDE (count), coalesce(count, 0) AS latency_count FROM dcount LEFT JOIN dlat USING (run_id, worker_id, day)),
 merged_workers AS (SELECT run_id, worker_id, CAST(sum(transactions) AS BIGINT) AS transactions,
 CAST(sum(fraud_count) AS BIGINT) AS fraud_count, {_merge('latency_count')}, max(batch_size) AS batch_size,
 bool_or(parallel_mode) AS parallel_mode, max(threads) AS threads, min(start_time) AS start_time,
 sum(processing_time) AS processing_time FROM daily GROUP BY 1, 2)"""
_MERGED_WORKERS = f"""{_DAILY}, wm AS (SELECT *, {_per_second('transactions', 'processing_time')} AS throughput,
 {_share('fraud_count', 'transactions')} AS fraud_ratio FROM merged_workers)"""
_put("worker_merge", ["results"], f", {_MERGED_WORKERS} SELECT * FROM wm")


def _duration(s: str) -> str:
    rest = f"({s} % 60)"
    minutes = f"CAST(floor({s} % 3600 / 60) AS INT)"
    hours = f"CAST(floor({s} / 3600) AS INT)"
    return (
        f"CASE WHEN {s} < 60 THEN printf('%.1fs', {s}) WHEN {s} < 3600 THEN printf('%dm %.1fs', {minutes}, {rest})"
        f" ELSE printf('%dh %dm %.1fs', {hours}, {minutes}, {rest}) END"
    )


_BANDS = ", ".join(
    f"CASE WHEN {c}_ms > 100 THEN 'red' WHEN {c}_ms > 50 THEN 'yellow' ELSE 'green' END AS {c}_band"
    for c in ("avg", "p50", "p95", "p99", "min", "max")
)
_TPS = "CASE WHEN {0} > 500 THEN 'green' WHEN {0} > 100 THEN 'yellow' ELSE 'red' END AS tps_band"
_PERCENT = "floor(fraud_ratio * 100e0 * 10e0 + 0.5e0) / 10e0 AS fraud_percent"
_put(
    "worker_report",
    ["results"],
    f""", {_MERGED_WORKERS} SELECT run_id, worker_id, CASE WHEN parallel_mode THEN 'Parallel' ELSE 'Sequential' END AS mode,
 batch_size, threads, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS started, {_duration('processing_time')} AS processing,
 transactions, throughput, {_TPS.format('throughput')}, fraud_count, {_PERCENT}, {_BANDS} FROM wm""",
)
_put(
    "worker_union",
    ["results"],
    """, base AS (SELECT run_id, worker_id, count(*) AS transactions FROM results GROUP BY 1, 2)
 SELECT run_id, worker_id, CASE WHEN worker_id = 'worker-1' THEN transactions ELSE transactions - 1 END AS transactions,
 CASE WHEN worker_id = 'worker-1' THEN 'own' ELSE 'stored' END AS source FROM base""",
)


def _run_stats(workers: str) -> str:
    return f"""{_RUNS}, {_WORKERS}, chosen AS ({workers}),
 real AS (SELECT run_id, sum(transactions) AS wt, sum(fraud_count) AS wf, count(*) AS worker_count,
 string_agg(worker_id, ',' ORDER BY worker_id) AS worker_ids, {_merge('latency_count')}
 FROM chosen WHERE worker_id <> 'generator' GROUP BY run_id),
 gen AS (SELECT run_id, sum(transactions) AS gt, sum(fraud_count) AS gf FROM chosen WHERE worker_id = 'generator' GROUP BY run_id),
 picked AS (SELECT r.run_id, r.start_time, r.end_time, r.pattern, target_tps, fraud_ratio AS target_fraud_ratio, thread_count,
 complete, CAST(coalesce(wt, gt, nullif(transactions, 0), 0) AS BIGINT) AS transactions,
 CAST(CASE WHEN wt IS NOT NULL THEN wf WHEN gt IS NOT NULL THEN gf WHEN transactions > 0 THEN coalesce(fraud_count, 0)
 ELSE 0 END AS BIGINT) AS fraud_count, {_ZERO}, coalesce(latency_count, 0) AS latency_count,
 coalesce(CAST(epoch_us(r.end_time) - epoch_us(r.start_time) AS DOUBLE) / 1e6, 0e0) AS duration_seconds,
 coalesce(worker_count, 0) AS worker_count, coalesce(worker_ids, '') AS worker_ids
 FROM runs r LEFT JOIN real USING (run_id) LEFT JOIN gen USING (run_id)),
 stats AS (SELECT *, {_per_second('transactions', 'duration_seconds')} AS actual_tps,
 {_share('fraud_count', 'transactions')} AS fraud_ratio FROM picked)"""


_ALL = _run_stats("SELECT * FROM workers")
_put("run_stats", ["run_log", "results"], f", {_ALL} SELECT * FROM stats")
_put(
    "run_stats_json",
    ["run_log", "results"],
    f""", {_ALL} SELECT run_id, transactions, fraud_count, worker_count, latency_count, fraud_ratio, duration_seconds, actual_tps,
 avg_ms AS latency_avg_ms, p50_ms AS latency_p50_ms, p95_ms AS latency_p95_ms, p99_ms AS latency_p99_ms,
 min_ms AS latency_min_ms, max_ms AS latency_max_ms, pattern AS metadata_pattern, complete AS metadata_complete, worker_ids,
 CAST(coalesce((SELECT sum(w.transactions) FROM workers w WHERE w.run_id = stats.run_id AND w.worker_id <> 'generator'), 0) AS BIGINT)
 AS worker_transactions FROM stats""",
)
_put(
    "run_stats_generator_only",
    ["run_log", "results"],
    ", " + _run_stats("SELECT * FROM workers WHERE worker_id = 'generator'")
    + " SELECT run_id, transactions, fraud_count, worker_count, latency_count, p99_ms, fraud_ratio FROM stats",
)
_put(
    "latest_run_stats",
    ["run_log", "results"],
    f", {_ALL} SELECT * FROM stats ORDER BY start_time DESC NULLS LAST, run_id LIMIT 1",
)
_put(
    "run_report",
    ["run_log", "results"],
    f""", {_ALL} SELECT run_id, CASE WHEN complete THEN 'Complete' ELSE 'In Progress' END AS status,
 strftime(start_time, '%Y-%m-%d %H:%M:%S') AS started, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS ended,
 {_duration('duration_seconds')} AS duration, pattern, target_tps, actual_tps, {_TPS.format('actual_tps')},
 transactions, fraud_count, {_PERCENT}, worker_count,
 worker_count = 0 AND transactions > 0 AS generator_only, {_BANDS} FROM stats""",
)


def _spread(q: float) -> str:
    return f"CASE WHEN samples < 10 THEN avg_ms ELSE quantile_cont(x, {q}) END"


_put(
    "legacy_run_stats",
    ["run_log", "results"],
    f""", {_RUNS}, {_WORKERS}, real AS (SELECT * FROM workers WHERE worker_id <> 'generator'),
 spread AS (SELECT run_id, avg_ms AS x FROM real, unnest(range(latency_count)) WHERE latency_count > 0),
 sums AS (SELECT run_id, sum(latency_count) AS samples,
 CAST(sum(CAST(avg_ms AS DECIMAL(18,6)) * latency_count) AS DOUBLE) / sum(latency_count) AS avg_ms
 FROM real WHERE latency_count > 0 GROUP BY 1),
 marks AS (SELECT run_id, {', '.join(f"quantile_cont(x, {q}) AS {n}" for n, q in (('p50_ms', 0.5), ('p95_ms', 0.95), ('p99_ms', 0.99)))}
 FROM spread GROUP BY 1),
 heads AS (SELECT run_id, sum(transactions) AS wt, count(*) AS workers,
 string_agg(worker_id, ',' ORDER BY worker_id) AS worker_ids FROM real GROUP BY 1)
 SELECT run_id, start_time, end_time, coalesce(fraud_ratio, 0e0) AS fraud_ratio, coalesce(target_tps, 0e0) AS target_tps,
 coalesce(actual_tps, 0e0) AS actual_tps, coalesce(duration_seconds, 0e0) AS duration_seconds,
 CAST(coalesce(transactions, wt, 0) AS BIGINT) AS transaction_count, coalesce({_r2('avg_ms')}, 0e0) AS avg_ms,
 {', '.join(f"coalesce(CASE WHEN samples < 10 THEN {_r2('avg_ms')} ELSE {_r2(n)} END, 0e0) AS {n}" for n in ('p50_ms', 'p95_ms', 'p99_ms'))},
 coalesce(workers, 0) AS workers, coalesce(worker_ids, '') AS worker_ids, coalesce(pattern, 'unknown') AS pattern,
 coalesce(complete, false) AS complete
 FROM merged LEFT JOIN heads USING (run_id) LEFT JOIN sums USING (run_id) LEFT JOIN marks USING (run_id)""",
)
_put(
    "feed_stats",
    ["results"],
    """SELECT run_id, transactions, fraud_count, duration_seconds,
 floor(fraud_count * 100e0 / transactions * 10000e0 + 0.5e0) / 10000e0 AS fraud_percentage,
 CASE WHEN duration_seconds > 0 THEN floor(transactions / duration_seconds * 1e6 + 0.5e0) / 1e6 ELSE 0e0 END AS actual_tps
 FROM (SELECT run_id, count(*) AS transactions, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
 CAST(max({EPOCH:timestamp}) - min({EPOCH:timestamp}) AS DOUBLE) AS duration_seconds FROM results GROUP BY 1)""",
)
_put(
    "list_runs",
    ["run_log"],
    f""", {_RUNS} SELECT run_id, start_time, end_time,
 coalesce(CAST(epoch_us(end_time) - epoch_us(start_time) AS DOUBLE) / 1e6, 0e0) AS duration,
 coalesce(pattern, 'unknown') AS pattern, coalesce(target_tps, 0e0) AS target_tps, coalesce(complete, false) AS complete
 FROM merged ORDER BY start_time DESC NULLS LAST, run_id LIMIT 10""",
)
_put(
    "run_ids",
    ["run_keys"],
    """SELECT DISTINCT split_part(key, ':', -1) AS run_id FROM run_keys WHERE key LIKE 'scores:runs:run-%'
 AND split_part(key, ':', -1) NOT LIKE '%worker%' ORDER BY 1 DESC LIMIT 10""",
)
_put("base_run_keys", ["run_keys"], "SELECT key FROM run_keys WHERE len(string_split(key, ':')) = 3")

_TYPED = """typed AS (SELECT event_id, transaction_id, user_id, worker_id,
 coalesce(json_extract_string(data, '$.run_id'), run_id, 'unknown') AS run_id, CAST(is_fraud AS INT) AS is_fraud,
 CAST(fraud_probability AS DOUBLE) AS fraud_probability, coalesce(TRY_CAST(latency_ms AS DOUBLE), 0e0) AS latency_ms,
 CASE WHEN is_fraud = '1' THEN 'FRAUD' ELSE 'OK' END AS status FROM result_messages)"""
_put(
    "latest_results",
    ["result_messages"],
    f", {_TYPED} SELECT * FROM typed WHERE run_id = 'run-015' ORDER BY event_id DESC LIMIT 10",
)
_put("tail_results", ["result_messages"], f", {_TYPED} SELECT * EXCLUDE (event_id) FROM typed WHERE run_id = 'run-020'")
_put("tail_latency", ["result_messages"], f", {_TYPED} " + _latency("typed", "run_id"))

# --- evaluation ------------------------------------------------------------

_put(
    "flag_predictions",
    ["scored"],
    """SELECT transaction_id, label, fraud_probability,
 CASE WHEN fraud_probability >= 0.7e0 THEN 1 ELSE 0 END AS is_fraud FROM scored""",
)
_AUC = """auc AS (SELECT sum(r) FILTER (WHERE label = 1) AS ranks, count(*) FILTER (WHERE label = 1) AS p,
 count(*) FILTER (WHERE label = 0) AS q FROM (SELECT label, rank() OVER (ORDER BY fraud_probability)
 + (count(*) OVER (PARTITION BY fraud_probability) - 1) / 2e0 AS r FROM scored))"""
_AUC_VALUE = "(2 * ranks - CAST(p AS DOUBLE) * (p + 1)) / (CAST(p AS DOUBLE) * q * 2)"
_put("roc_auc", ["scored"], f", {_AUC} SELECT {_AUC_VALUE} AS roc_auc FROM auc")
_P1 = "CASE WHEN fraud_probability >= 0.7e0 THEN 1 ELSE 0 END"
_P0 = "CASE WHEN fraud_probability > 0.5e0 THEN 1 ELSE 0 END"


def _cells(rule: str, tail: str = "") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE label = {y} AND {rule} = {p}) AS {c}{tail}"
        for c, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )


_put(
    "eval_metrics",
    ["scored"],
    f""", {_AUC} SELECT count(*) AS rows, avg(CASE WHEN {_P0} = label THEN 1 ELSE 0 END) AS accuracy,
 avg(CASE WHEN {_P1} = label THEN 1 ELSE 0 END) AS accuracy_at_threshold, {_cells(_P0)}, {_cells(_P1, '_at_threshold')},
 (SELECT {_AUC_VALUE} FROM auc) AS roc_auc FROM scored""",
)
_put(
    "confusion_matrix",
    ["scored"],
    f"""SELECT label, count(*) FILTER (WHERE {_P1} = 0) AS predicted_0, count(*) FILTER (WHERE {_P1} = 1) AS predicted_1
 FROM scored GROUP BY label""",
)


def _quot(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0e0 END"


def _class_line(name: str, hit: str, wrong: str, missed: str) -> str:
    return (
        f"SELECT '{name}' AS class, {_quot(hit, f'{hit} + {wrong}')} AS precision, {_quot(hit, f'{hit} + {missed}')} AS recall,"
        f" {_quot(f'2 * {hit}', f'2 * {hit} + {wrong} + {missed}')} AS f1_score, {hit} + {missed} AS support FROM cells"
    )


_put(
    "classification_report",
    ["scored"],
    f""", cells AS (SELECT {_cells(_P1)} FROM scored),
 lines AS ({_class_line('0', 'tn', 'fn', 'fp')} UNION ALL {_class_line('1', 'tp', 'fp', 'fn')}),
 totals AS (SELECT CAST(sum(support) AS BIGINT) AS n FROM lines)
 SELECT * FROM lines UNION ALL
 SELECT 'accuracy', a, a, a, n FROM (SELECT CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp) AS a FROM cells), totals UNION ALL
 SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), any_value(n) FROM lines, totals UNION ALL
 SELECT 'weighted avg', sum(precision * support) / any_value(n), sum(recall * support) / any_value(n),
 sum(f1_score * support) / any_value(n), any_value(n) FROM lines, totals""",
)

# --- streaming -------------------------------------------------------------
# The scored stream keeps every usable message once; probabilities come from a model
# and are checked by the tests, so the query itself has no statement here.


def _clean() -> None:
    """A statement without views starts with SELECT; one with views chains its CTEs."""
    for name, text in ORACLES.items():
        head, sep, tail = text.partition("\n, ")
        if sep:
            ORACLES[name] = head + ",\n" + tail


_clean()
