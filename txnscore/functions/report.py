"""Column functions for report text and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def duration_text(seconds: Column) -> Column:
    """``12.3s``, ``3m 4.5s`` or ``1h 2m 3.4s``."""
    hours = F.floor(seconds / 3600).cast("int")
    in_hour = F.pmod(seconds, F.lit(3600.0))
    minutes = F.floor(in_hour / 60).cast("int")
    rest = F.pmod(in_hour, F.lit(60.0))
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%dm %.1fs", minutes, rest))
        .otherwise(F.format_string("%dh %dm %.1fs", hours, minutes, rest))
    )


def latency_band(latency_ms: Column) -> Column:
    return F.when(latency_ms > 100, "red").when(latency_ms > 50, "yellow").otherwise("green")


def tps_band(tps: Column) -> Column:
    return F.when(tps > 500, "green").when(tps > 100, "yellow").otherwise("red")


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_text(ts: Column) -> Column:
    """ISO-8601 text, with microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.when(micros == 0, whole).otherwise(
        F.concat(whole, F.format_string(".%06d", micros))
    )


def fraud_status(is_fraud: Column) -> Column:
    return F.when(is_fraud == 1, "FRAUD").otherwise("OK")


def run_status(complete: Column) -> Column:
    return F.when(complete, "Complete").otherwise("In Progress")


def worker_mode(parallel: Column) -> Column:
    return F.when(parallel, "Parallel").otherwise("Sequential")


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, 0 if either is missing."""
    micros = F.unix_micros(end) - F.unix_micros(start)
    return F.coalesce(micros / F.lit(1e6), F.lit(0.0))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def key_part(key: Column) -> Column:
    """Last ``:``-separated part of a key."""
    return F.element_at(F.split(key, ":"), -1)
