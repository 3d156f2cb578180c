"""RFC 3339 timestamps and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"

# Text shown where a session or message has no valid time.
NO_DATE = "0001-01-01"
NO_CLOCK = "00:00:00"


def parse_time(raw: Column) -> Column:
    """Timestamp of a strict RFC 3339 text, NULL for anything else (a bare date too)."""
    return F.when(raw.rlike(_RFC3339), F.replace(raw, F.lit(","), F.lit(".")).try_cast("timestamp"))


def wall_date(raw: Column, ts: Column) -> Column:
    """``yyyy-mm-dd`` as written in the log, whatever its zone."""
    return F.when(ts.isNotNull(), F.substring(raw, 1, 10)).otherwise(F.lit(NO_DATE))


def wall_clock(raw: Column, ts: Column) -> Column:
    """``hh:mm:ss`` as written in the log, whatever its zone."""
    return F.when(ts.isNotNull(), F.substring(raw, 12, 8)).otherwise(F.lit(NO_CLOCK))


def wall_weekday(raw: Column, ts: Column) -> Column:
    return F.when(ts.isNotNull(), F.date_format(F.substring(raw, 1, 10).try_cast("date"), "E")).otherwise(F.lit("Mon"))


def recency(ts_micros: Column, as_of_micros: Column) -> Column:
    """Age bucket of a time against a given moment; never against the clock."""
    secs = F.floor((as_of_micros - ts_micros) / F.lit(1_000_000))
    return (
        F.when(ts_micros.isNull(), F.lit("N/A"))
        .when(as_of_micros - ts_micros < 60 * 1_000_000, F.lit("just now"))
        .when(secs < 3600, F.concat(F.floor(secs / 60).cast("string"), F.lit("m ago")))
        .when(secs < 86400, F.concat(F.floor(secs / 3600).cast("string"), F.lit("h ago")))
        .when(secs < 7 * 86400, F.concat(F.floor(secs / 86400).cast("string"), F.lit("d ago")))
        .otherwise(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts_micros / F.lit(86_400_000_000)).cast("int")).cast("string"))
    )
