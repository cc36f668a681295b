"""Reading fields out of JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.defaults import DEFAULT_REFRESH_SECONDS

_SECONDS_IN_RANGE = 253_402_300_799  # last second of the year 9999


def json_text(document: Column, path: str, default: str | None = None) -> Column:
    value = F.get_json_object(document, path)
    return value if default is None else F.coalesce(value, F.lit(default))


def json_number(document: Column, path: str, kind: str = "bigint", default: int | None = None) -> Column:
    value = F.get_json_object(document, path).try_cast(kind)
    return value if default is None else F.coalesce(value, F.lit(default).cast(kind))


def public_settings(value: Column, default_name: str = "") -> list[Column]:
    """The settings a public board may read, each with its default."""
    return [
        json_text(value, "$.system_name", default_name).alias("system_name"),
        json_text(value, "$.logo_url", "").alias("logo_url"),
        json_number(value, "$.refresh_seconds", "int", DEFAULT_REFRESH_SECONDS).alias("refresh_seconds"),
        json_text(value, "$.status_thresholds", "[]").alias("status_thresholds"),
    ]


def epoch_or_arrival(epoch_text: Column, arrived_at: Column) -> Column:
    """Timestamp of a text that starts with epoch seconds; the arrival second for anything else, 0 or out of range.

    All digits count, leading zeros do not; more digits than a decimal holds are out of range anyway.
    """
    number = r"^\s*([+-]?)0*(\d+)"
    digits = F.concat(F.regexp_extract(epoch_text, number, 1), F.regexp_extract(epoch_text, number, 2))
    seconds = F.nullif(digits.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    usable = F.when(F.abs(seconds) <= _SECONDS_IN_RANGE, seconds.try_cast("bigint"))
    return F.coalesce(F.timestamp_seconds(usable), F.date_trunc("second", arrived_at))
