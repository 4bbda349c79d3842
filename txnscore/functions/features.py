"""Column functions behind the features; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86_400
HISTORY_SECONDS = 30 * DAY_SECONDS

# Category edges (inclusive above), segment edges, map scale.
AMOUNT_EDGES = ((100.0, "low"), (500.0, "medium"), (1000.0, "high"))
AMOUNT_TOP = "very_high"
SEGMENT_EDGES = ((5000, "PREMIUM"), (1000, "STANDARD"))
SEGMENT_BASE = "BASIC"
SEGMENT_NEW = "NEW"
KM_PER_DEGREE = 111.2
NO_HOME = "0,0"
UNKNOWN = "UNKNOWN"

# Money sums run on a decimal so that the total does not depend on row order.
MONEY = "decimal(24,6)"


def finite(value: Column) -> Column:
    """The number itself; NULL for NaN and the infinities."""
    return F.when(F.abs(value) < float("inf"), value)


def money(amount: Column) -> Column:
    """The exact amount; NULL for one that is no finite number below 10**18.

    Such an amount is unusable everywhere: it is in no sum and in no count, and a
    message or a delivery that has one is routed aside with a reason.
    """
    return amount.try_cast(MONEY)


def unusable(amount: Column) -> Column:
    return amount.isNotNull() & money(amount).isNull()


def half_up(value: Column, digits: int) -> Column:
    """Round by plain double arithmetic, so every engine gets the same bits.

    A double of 9e15 or more has no digit behind the point, so it is rounded already.
    """
    scale = float(10**digits)
    rounded = F.floor(value * scale + 0.5) / F.lit(scale)
    return F.when(F.abs(value) < 9.0e15 / scale, rounded).otherwise(value)


def epoch_seconds(raw: Column) -> Column:
    """Epoch seconds from a number or ISO-8601 text; NULL if neither.

    Fractions of a second are cut off downwards. A number has at most 18 digits
    before the point, so that times can be added without overflow.
    """
    text = F.trim(raw.cast("string"))
    whole = text.try_cast("decimal(18,0)").cast("bigint")
    number = F.floor(text.try_cast("decimal(27,9)")).cast("bigint")
    plain = F.when(text.rlike("^[+-]?[0-9]+$"), whole).otherwise(number)
    return F.coalesce(plain, F.unix_seconds(F.try_to_timestamp(text)))


def hour_of_day(epoch: Column) -> Column:
    return F.pmod(F.floor(epoch / 3600), F.lit(24)).cast("int")


def day_of_week(epoch: Column) -> Column:
    """Monday is 0; day 0 of the epoch was a Thursday."""
    return F.pmod(F.floor(epoch / DAY_SECONDS) + 3, F.lit(7)).cast("int")


def weekend_flag(epoch: Column) -> Column:
    return F.when(day_of_week(epoch) >= 5, 1).otherwise(0)


def time_features(epoch: Column) -> dict[str, Column]:
    return {
        "hour": hour_of_day(epoch),
        "day_of_week": day_of_week(epoch),
        "is_weekend": weekend_flag(epoch),
    }


def amount_category(amount: Column, null_nonpositive: bool) -> Column:
    """Batch features leave amounts at or below zero uncategorised; serving calls them low."""
    branches = F.when(amount.isNull(), F.lit(None).cast("string"))
    if null_nonpositive:
        branches = branches.when(amount <= 0, F.lit(None).cast("string"))
    for edge, name in AMOUNT_EDGES:
        branches = branches.when(amount <= edge, name)
    return branches.otherwise(AMOUNT_TOP)


def spend_segment(total: Column) -> Column:
    branches = None
    for edge, name in SEGMENT_EDGES:
        branches = (F if branches is None else branches).when(total > edge, name)
    return branches.otherwise(SEGMENT_BASE)


def compose_location(lon: Column, lat: Column) -> Column:
    """``"lon,lat"`` without a space, NULL unless both parts are there."""
    return F.concat(lon.cast("string"), F.lit(","), lat.cast("string"))


def _coordinates(location: Column) -> tuple[Column, Column]:
    parts = F.split(location, ",")
    valid = F.size(parts) == 2
    lon = F.when(valid, F.trim(parts[0]).try_cast("double"))
    lat = F.when(valid, F.trim(parts[1]).try_cast("double"))
    return lon, lat


def distance_km(location: Column, home: Column) -> Column:
    """Planar distance; NULL if either place is empty, malformed or no home is known."""
    lon1, lat1 = _coordinates(location)
    lon2, lat2 = _coordinates(home)
    dlat, dlon = lat2 - lat1, lon2 - lon1
    km = F.sqrt(dlat * dlat + dlon * dlon) * KM_PER_DEGREE
    return F.when(home != NO_HOME, km)


def near_home(location: Column, home: Column, radius_km: float = 10.0) -> Column:
    return F.coalesce(distance_km(location, home) <= radius_km, F.lit(False))


def ratio_to_average(amount: Column, average: Column) -> Column:
    return F.when(average > 0, amount / average).otherwise(1.0)


def same_value(left: Column, right: Column) -> Column:
    return F.when(left.eqNullSafe(right), 1).otherwise(0)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def hash_bits(text: Column, start: int, digits: int) -> Column:
    """``digits`` hex digits of the md5 of ``text`` as a BIGINT."""
    return F.conv(F.substring(F.md5(text), start, digits), 16, 10).cast("bigint")


def seeded_normal(identifier: Column, seed: int, sigma: float) -> Column:
    """Repeatable N(0, sigma) noise per identifier (Box-Muller over md5 digits)."""
    text = F.concat(F.lit(f"{seed}:"), identifier)
    u1 = (hash_bits(text, 1, 8) + 1) / F.lit(4294967296.0)
    u2 = hash_bits(text, 9, 8) / F.lit(4294967296.0)
    radius = F.sqrt(F.log(u1) * -2.0)
    return radius * F.cos(u2 * 6.283185307179586) * sigma
