"""Column functions: bands, keys, lags, measures and the rules that reject rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bands' edges and names, the directions, the limits and the severity of weather conditions.
TEMPERATURE_EDGES, TEMPERATURE_NAMES = (-5, 5, 15, 25), ("Below -5", "-5 to 5", "5 to 15", "15 to 25", "Above 25")
PRECIPITATION_EDGES, PRECIPITATION_NAMES = (2.5, 7.5), ("Light", "Moderate", "Heavy")
VISIBILITY_EDGES, VISIBILITY_NAMES = (500, 2000), ("Poor", "Reduced", "Good")
CONDITIONS = ("DRY", "RAIN", "FOG", "SNOW", "ICE", "STORM")
DIRECTIONS = ("NB", "SB", "EB", "WB")
SENTINELS = ("", "N/A", "NA", "-", "NULL")
MAX_SPEED = 250
RESPONSE_MINUTES, CLEARANCE_MINUTES = 8, 45
UNKNOWN_KEY, UNKNOWN_CODE = -1, "UNK"


def band(value: Column, edges: Sequence[float], names: Sequence[str], missing: str) -> Column:
    """The name of the half-open interval that holds value: names[k] lies under edges[k], the last has no upper edge."""
    under = [F.when(value < e, n) for e, n in zip(edges, names, strict=False)]
    return F.when(value.isNull(), missing).otherwise(F.coalesce(*under, F.lit(names[-1])))


def band_temperature(value: Column) -> Column:
    return band(value, TEMPERATURE_EDGES, TEMPERATURE_NAMES, "Unknown")


def band_precipitation(value: Column) -> Column:
    return band(F.nullif(value, F.lit(0).cast("double")), PRECIPITATION_EDGES, PRECIPITATION_NAMES, "None")


def band_visibility(value: Column) -> Column:
    return band(value, VISIBILITY_EDGES, VISIBILITY_NAMES, "Good")


def normalized(value: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """Trimmed upper case; words that stand for nothing become null."""
    clean = F.upper(F.trim(value))
    return F.when(~clean.isin(*sentinels), clean)


def date_key(ts: Column) -> Column:
    """yyyymmdd as an integer; null becomes -1."""
    return F.coalesce(F.year(ts) * 10000 + F.month(ts) * 100 + F.day(ts), F.lit(UNKNOWN_KEY))


def time_key(ts: Column) -> Column:
    """Minute of the day; null becomes -1."""
    return F.coalesce(F.hour(ts) * 60 + F.minute(ts), F.lit(UNKNOWN_KEY))


def minute_lag(start: Column, end: Column) -> Column:
    """Minute boundaries between two times: 08:00:59 to 08:01:00 is one."""
    whole = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / 60_000_000)
    return (whole(end) - whole(start)).cast("int")


def hash_diff(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns in order; a null is told from an empty text and from a column that isn't there."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def over_limit(speed: Column, limit: Column) -> Column:
    return speed - limit


def congestion_index(speed: Column, limit: Column) -> Column:
    """1 - speed / limit within 0 and 1, to three decimals; null without a speed or a positive limit."""
    free = F.lit(1) - speed / F.when(limit > 0, limit)
    return F.when(free.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(1), free))).cast("decimal(4,3)")


def within(minutes: Column, most: int) -> Column:
    """1 or 0; null where the milestone isn't reached."""
    return F.when(minutes.isNotNull(), (minutes <= most).cast("int"))


def rush_by_hour(hour: Column) -> Column:
    """The report's rush hours; the time dimension has its own, by minutes."""
    return F.when(hour.isin(7, 8, 16, 17, 18), "Rush").otherwise("Off-peak")


def severity_rank(condition: Column) -> Column:
    """1 for DRY and for anything unknown, up to 6 for STORM."""
    return F.coalesce(*[F.when(condition == c, k) for k, c in enumerate(CONDITIONS, 1)], F.lit(1))


class Rule(NamedTuple):
    """A reason and the rows it rejects; a null condition rejects nothing."""

    reason: str
    fails: Column


def missing_key(*columns: str) -> Rule:
    lacks = F.lit(False)
    for c in columns:
        lacks = lacks | F.col(c).isNull()
    return Rule("MISSING_KEY", lacks)


def speed_range(column: str = "speed_kmh", most: float = MAX_SPEED) -> Rule:
    return Rule("SPEED_RANGE", (F.col(column) <= 0) | (F.col(column) > most))


def occupancy_range(column: str = "occupancy_pct") -> Rule:
    return Rule("OCCUPANCY_RANGE", (F.col(column) < 0) | (F.col(column) > 100))


def future_timestamp(column: str = "event_ts", now: Column | None = None) -> Rule:
    return Rule("FUTURE_TIMESTAMP", F.col(column) > (F.current_timestamp() if now is None else now))


def date_mismatch(event: str = "event_date", ingest: str = "ingest_date") -> Rule:
    return Rule("DATE_MISMATCH", F.col(event) != F.col(ingest))


def unknown_ingest_date(ingest: str = "ingest_date") -> Rule:
    """A file whose name has no date: no later read of a date would find its rows."""
    return Rule("UNKNOWN_INGEST_DATE", F.col(ingest).isNull())


def bad_direction(column: str = "direction", known: Sequence[str] = DIRECTIONS) -> Rule:
    return Rule("BAD_DIRECTION", ~F.col(column).isin(*known))


def event_rules(now: Column | None = None) -> list[Rule]:
    """The rules of the event feed, the first that fails being the reason."""
    return [missing_key("event_id", "detector_code", "event_ts"), speed_range(), occupancy_range(), future_timestamp(now=now), date_mismatch(), bad_direction()]


def boundary_rules() -> list[Rule]:
    """What is checked again where rows enter the warehouse."""
    return [missing_key("event_id", "detector_code", "event_ts"), speed_range(), occupancy_range(), date_mismatch()]


def reject_reason(rules: Sequence[Rule]) -> Column:
    """The first failing rule's reason, or null."""
    return F.coalesce(*[F.when(r.fails, r.reason) for r in rules], F.lit(None).cast("string"))
