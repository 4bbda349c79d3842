"""Test inputs derived from the supplied tables, once for Spark and once for DuckDB.

Every view is a projection (and filter) of one table, so it grows with it. The
text below is shared; three macros differ between the engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_MACROS = {
    "spark": {
        "EPOCH": "unix_seconds(CAST({0} AS TIMESTAMP))",
        "JSONK": "get_json_object({0}, '$.k')",
        "HEX8": "CAST(conv(substr(md5({0}), 1, 8), 16, 10) AS BIGINT)",
        "DAYTEXT": "date_format({0}, 'yyyyMMdd')",
        "ISO": "date_format(CAST({0} AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss\")",
    },
    "duckdb": {
        "EPOCH": "CAST(floor(epoch({0})) AS BIGINT)",
        "JSONK": "json_extract_string({0}, '$.k')",
        "HEX8": "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT)",
        "DAYTEXT": "strftime({0}, '%Y%m%d')",
        "ISO": "strftime({0}, '%Y-%m-%dT%H:%M:%S')",
    },
}
_MACRO = re.compile(r"\{(" + "|".join(_MACROS["spark"]) + "):")


def dialect(text: str, engine: str) -> str:
    """Expand ``{NAME:argument}`` macros for one engine; other braces stay."""
    macros = _MACROS[engine]
    out, at = [], 0
    while found := _MACRO.search(text, at):
        depth, end = 1, found.end()
        while depth:
            depth += {"{": 1, "}": -1}.get(text[end], 0)
            end += 1
        argument = dialect(text[found.end(): end - 1], engine)
        out += [text[at: found.start()], macros[found[1]].replace("{0}", argument)]
        at = end
    return "".join(out) + text[at:]


_LATITUDE = (
    "lpad(CAST(CASE user_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 407128 WHEN 2 THEN 515074"
    " WHEN 3 THEN 356895 WHEN 4 THEN 488566 ELSE 13521 END"
    " + CASE WHEN event_id % 10 < 5 THEN 0 ELSE (event_id % 10 - 4) * 500 END AS STRING), 6, '0')"
)
_LAT = f"concat(substr({_LATITUDE}, 1, 2), '.', substr({_LATITUDE}, 3, 4))"
_LON = (
    "CASE user_id % 6 WHEN 0 THEN '0' WHEN 1 THEN '-74.0059' WHEN 2 THEN '-0.1278'"
    " WHEN 3 THEN '139.6917' WHEN 4 THEN '2.3522' ELSE '103.8198' END"
)
_CARD = (
    "CASE event_type WHEN 'click' THEN 'VISA' WHEN 'view' THEN 'MASTERCARD'"
    " WHEN 'purchase' THEN 'AMEX' WHEN 'signup' THEN 'DISCOVER' END"
)
_MERCHANT = "concat('MERCH', CAST(CAST({JSONK:props} AS BIGINT) % 20 AS STRING))"
_EVENT_RUN = "concat('run-', lpad(CAST(10 + event_id % 40 AS STRING), 3, '0'))"
_WORKER = (
    "CASE WHEN event_id % 11 = 0 THEN 'generator'"
    " ELSE concat('worker-', CAST(user_id % 4 AS STRING)) END"
)
_CENTS = "CAST(CAST(value AS DECIMAL(18,2)) AS STRING)"
_AMOUNT_TEXT = "CAST(CAST(value * 10 AS DECIMAL(18,2)) AS STRING)"

_TXNS = {
    "transaction_id": "CAST(event_id AS STRING)",
    "event_id": "event_id",
    "user_id": "concat('USER', CAST(user_id AS STRING))",
    "user_num": "user_id",
    "merchant_id": _MERCHANT,
    "amount": "value * 10",
    "currency": "'USD'",
    "timestamp": "{EPOCH:ts}",
    "card_provider": _CARD,
    "location": f"concat({_LON}, ',', {_LAT})",
}

# Live payload built as text, so both engines decode the same characters.
_PAYLOAD = (
    "concat('{\"transaction_id\":\"', CAST(event_id AS STRING), '\",\"user_id\":\"USER', CAST(user_id AS STRING),"
    f" '\",\"merchant_id\":\"', {_MERCHANT}, '\",\"amount\":', {_AMOUNT_TEXT},"
    " ',\"currency\":\"USD\",\"timestamp\":', CASE WHEN event_id % 4 = 0"
    " THEN concat('\"', {ISO:ts}, '\"') ELSE CAST({EPOCH:ts} AS STRING) END,"
    f" ',\"location\":\"', {_LON}, ',', {_LAT}, '\"',"
    f" CASE WHEN event_type = 'error' THEN '' ELSE concat(',\"card_provider\":\"', {_CARD}, '\"') END,"
    f" CASE WHEN event_id % 13 = 0 THEN '' ELSE concat(',\"run_id\":\"', {_EVENT_RUN}, '\"') END,"
    " CASE WHEN event_id % 5 = 0 THEN ',\"extra\":{\"a\":1}' ELSE '' END,"
    " ',\"is_fraud\":', CASE WHEN event_type = 'error' THEN '1' ELSE '0' END, ',\"synthetic\":1}')"
)
_MESSAGE = (
    f"CASE event_id % 23 WHEN 3 THEN NULL WHEN 5 THEN substr({_PAYLOAD}, 1, 40) WHEN 7 THEN 'init:reset'"
    f" WHEN 11 THEN replace({_PAYLOAD}, '\"amount\":', '\"amount\":\"x\",\"was\":')"
    f" WHEN 13 THEN replace({_PAYLOAD}, '\"timestamp\":', '\"timestamp\":\"soon\",\"was\":')"
    f" WHEN 17 THEN concat('[', {_PAYLOAD}, ']')"
    f" WHEN 19 THEN replace({_PAYLOAD}, '\"amount\":', '\"amount\":NaN,\"was\":')"
    f" WHEN 21 THEN replace({_PAYLOAD}, '\"amount\":', '\"amount\":1e19,\"was\":')"
    f" WHEN 2 THEN replace({_PAYLOAD}, '\"timestamp\":', '\"timestamp\":1704067300.75,\"was\":')"
    f" ELSE {_PAYLOAD} END"
)

_RUN_OF_ORDER = "concat('run-', lpad(CAST(o_custkey % 40 AS STRING), 3, '0'))"


def _of(status: str, value: str) -> str:
    return f"CASE WHEN o_orderstatus = '{status}' THEN {value} END"


# name -> (table, {column: expression}, filter or None)
VIEWS: dict[str, tuple[str, dict[str, str], str | None]] = {
    # Dense feed: about 67 rows per user in 30 days.
    "txns": ("events", _TXNS, None),
    # Serving split; users ending in 9 have no history.
    "history": ("events", _TXNS, "ts < TIMESTAMP '2024-01-21' AND user_id % 10 <> 9"),
    "live": ("events", _TXNS, "ts >= TIMESTAMP '2024-01-21'"),
    # Sparse history over years, with ties and mixed segments.
    "order_txns": (
        "orders",
        {
            "transaction_id": "CAST(o_orderkey AS STRING)",
            "user_id": "concat('USER', CAST(o_custkey AS STRING))",
            "amount": "o_totalprice / 1000",
            "timestamp": "{EPOCH:o_orderdate}",
            "card_provider": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'VISA' WHEN '2' THEN 'MASTERCARD'"
            " WHEN '3' THEN 'AMEX' ELSE 'DISCOVER' END",
            "location": "concat(CAST(o_custkey % 7 AS STRING), ',', CAST(o_orderkey % 3 AS STRING))",
        },
        None,
    ),
    # Raw history as delivered: ISO or integer time, partly with a location,
    # every seventh delivery replaces the transaction before it.
    "deliveries": (
        "events",
        {
            "transaction_id": "CAST(CASE WHEN event_id % 7 = 0 AND event_id > 0 THEN event_id - 1 ELSE event_id END AS STRING)",
            "user_id": "concat('USER', CAST(user_id AS STRING))",
            "merchant_id": _MERCHANT,
            "item_name": "concat(event_type, ' item ', CAST(event_id % 9 AS STRING))",
            "amount": "value * 10",
            "currency": "'USD'",
            "timestamp": "CASE WHEN event_id % 2 = 0 THEN CAST({EPOCH:ts} AS STRING) ELSE {ISO:ts} END",
            "lat": f"CASE WHEN event_id % 6 <> 5 THEN CAST({_LAT} AS DOUBLE) END",
            "lon": f"CASE WHEN event_id % 6 <> 5 THEN CAST({_LON} AS DOUBLE) END",
            "card_provider": _CARD,
            "location": f"CASE WHEN event_id % 3 = 0 THEN concat({_LON}, ',', {_LAT}) END",
            "vector_text": "concat(event_type, ' by user ', CAST(user_id AS STRING))",
            "seq": "event_id",
        },
        None,
    ),
    # Deliveries of which some cannot be used.
    "rough_deliveries": (
        "events",
        {
            "transaction_id": "CASE event_id % 17 WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE CAST(event_id - event_id % 2 AS STRING) END",
            "user_id": "CASE WHEN event_id % 17 <> 5 THEN concat('USER', CAST(user_id AS STRING)) END",
            "amount": "CASE event_id % 17 WHEN 11 THEN CAST('NaN' AS DOUBLE) WHEN 12 THEN CAST('Infinity' AS DOUBLE)"
            " WHEN 13 THEN CAST('1e19' AS DOUBLE) WHEN 14 THEN NULL ELSE value * 10 END",
            "timestamp": "CASE event_id % 17 WHEN 7 THEN 'soon' WHEN 8 THEN NULL"
            " WHEN 9 THEN concat(CAST({EPOCH:ts} AS STRING), '.75') ELSE CAST({EPOCH:ts} AS STRING) END",
            "location": "CAST(NULL AS STRING)",
            "lat": "CAST(1 AS DOUBLE)",
            "lon": "CAST(2 AS DOUBLE)",
            "seq": "event_id",
        },
        None,
    ),
    "messages": ("events", {"event_id": "event_id", "data": _MESSAGE}, None),
    # Scored output, as stats events.
    "results": (
        "events",
        {
            "transaction_id": "CAST(event_id AS STRING)",
            "run_id": _EVENT_RUN,
            "worker_id": _WORKER,
            "latency_ms": "value",
            "is_fraud": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
            "batch_size": "CAST(1 + event_id % 10 AS INT)",
            "timestamp": "CAST(ts AS TIMESTAMP)",
            "user_num": "user_id",
        },
        None,
    ),
    # Results stream: all text, some fields missing or unreadable.
    "result_messages": (
        "events",
        {
            "event_id": "event_id",
            "data": "CASE WHEN event_id % 3 = 0 THEN concat('{\"run_id\":\"', "
            + _EVENT_RUN
            + ", '\"}') ELSE '{}' END",
            "transaction_id": "CAST(event_id AS STRING)",
            "is_fraud": "CASE WHEN event_type = 'error' THEN '1' ELSE '0' END",
            "fraud_probability": "CAST(CAST(CAST(event_id % 100 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2)) AS STRING)",
            "user_id": "concat('USER', CAST(user_id AS STRING))",
            "worker_id": "concat('worker-', CAST(user_id % 4 AS STRING))",
            "latency_ms": f"CASE WHEN event_id % 97 = 0 THEN 'n/a' ELSE {_CENTS} END",
            "run_id": f"CASE WHEN event_id % 13 <> 0 THEN {_EVENT_RUN} END",
        },
        None,
    ),
    # Fixed label and probability with ties, for the evaluation metrics.
    "scored": (
        "events",
        {
            "transaction_id": "CAST(event_id AS STRING)",
            "label": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
            "fraud_probability": "CAST({HEX8:concat('42:', CAST(event_id AS STRING))} % 80"
            " + CASE WHEN event_type = 'error' THEN 20 ELSE 0 END AS DOUBLE) / 100",
        },
        None,
    ),
    # Change log of run metadata: started (O), progress (P) and finished (F) records.
    "run_log": (
        "orders",
        {
            "run_id": _RUN_OF_ORDER,
            "seq": "o_orderkey",
            "start_time": _of("O", "CAST(o_orderdate AS TIMESTAMP)"),
            "end_time": "CASE WHEN o_orderstatus = 'F' AND o_custkey % 4 <> 0"
            " THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2000 DAY + INTERVAL 13505 SECOND END",
            "pattern": "CASE WHEN o_orderstatus = 'O' AND o_custkey % 5 <> 0 THEN " + ("CASE o_orderkey % 4 WHEN 0 THEN 'constant' WHEN 1 THEN 'wave' WHEN 2 THEN 'spike' END END"),
            "target_tps": _of("O", "floor(o_totalprice / 1000) + 0.5e0"),
            "fraud_ratio": _of("O", "CAST(o_orderkey % 30 AS DOUBLE) / 100"),
            "thread_count": _of("O", "CAST(1 + o_orderkey % 4 AS INT)"),
            "complete": "CASE WHEN o_orderstatus = 'F' AND o_custkey % 4 <> 0 THEN true END",
            "transactions": _of("P", "o_orderkey % 5000"),
            "fraud_count": _of("P", "o_orderkey % 5000 % 100"),
            "duration_seconds": _of("P", "CAST(o_orderkey % 1000 AS DOUBLE) / 4"),
            "actual_tps": _of("P", "CAST(o_orderkey % 300 AS DOUBLE) / 8"),
        },
        None,
    ),
    # Per-day worker snapshots from several sources, some without measurements.
    "run_keys": (
        "orders",
        {
            "key": "CASE o_orderkey % 4"
            f" WHEN 0 THEN concat('scores:runs:', {_RUN_OF_ORDER})"
            f" WHEN 1 THEN concat('scores:runs:', {_RUN_OF_ORDER}, ':worker:w', CAST(o_custkey % 5 AS STRING), ':stats')"
            f" WHEN 2 THEN concat('scores:runs:', {_RUN_OF_ORDER}, '-worker')"
            " ELSE concat('scores:runs:test-', CAST(o_custkey % 9 AS STRING)) END",
        },
        None,
    ),
    # Time stamps as text in every accepted form.
    "time_texts": (
        "events",
        {
            "event_id": "event_id",
            "raw": "CASE event_id % 8 WHEN 0 THEN CAST({EPOCH:ts} AS STRING) WHEN 1 THEN {ISO:ts}"
            " WHEN 2 THEN concat({ISO:ts}, 'Z') WHEN 3 THEN concat({ISO:ts}, '+02:00')"
            " WHEN 4 THEN replace({ISO:ts}, 'T', ' ') WHEN 5 THEN '' WHEN 6 THEN 'not a time'"
            " ELSE CASE event_id % 3 WHEN 0 THEN '1704067300.75' WHEN 1 THEN '-1.5' END END",
        },
        None,
    ),
    # Amounts on and around every category edge.
    "amounts": (
        "events",
        {
            "event_id": "event_id",
            "amount": "CASE event_id % 16 WHEN 0 THEN NULL WHEN 1 THEN -value WHEN 2 THEN 0e0 WHEN 3 THEN 0.01e0"
            " WHEN 4 THEN 100e0 WHEN 5 THEN 100.01e0 WHEN 6 THEN 500e0 WHEN 7 THEN 500.01e0 WHEN 8 THEN 1000e0"
            " WHEN 9 THEN 1000.01e0 ELSE value * 10 END",
        },
        None,
    ),
}


def spark_view(spark: SparkSession, sf_dir: str, name: str, tasks: int | None = None) -> DataFrame:
    """A view; with ``tasks`` its table's rows are dealt over so many before its columns are made."""
    table, columns, where = VIEWS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    rows = rows if tasks is None else rows.repartition(tasks)
    if where:
        rows = rows.filter(dialect(where, "spark"))
    return rows.selectExpr(*[f"{dialect(e, 'spark')} AS {c}" for c, e in columns.items()])


def duck_view(name: str) -> str:
    """``name AS (SELECT ...)`` for a WITH clause."""
    table, columns, where = VIEWS[name]
    select = ", ".join(f"{dialect(e, 'duckdb')} AS {c}" for c, e in columns.items())
    tail = f" WHERE {dialect(where, 'duckdb')}" if where else ""
    return f"{name} AS (SELECT {select} FROM {table}{tail})"


def with_views(names: list[str], body: str) -> str:
    return "WITH " + ",\n".join(duck_view(n) for n in names) + "\n" + body
