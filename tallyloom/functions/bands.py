"""Percentages and status bands, exact to the last digit."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import DEFAULT_BANDS, NO_BAND
from tallyloom.schemas import BAND_LIST, LIMIT, PERCENT


@dataclass(frozen=True)
class Band:
    label: str
    min_pct: Decimal


def _highest_first(bands: list[Band]) -> list[Band]:
    return sorted(bands, key=lambda band: (-band.min_pct, band.label))


def bands_from_json(thresholds: str) -> list[Band]:
    """Bands of a JSON list of ``{label, min}``, highest limit first; entries without a limit never apply."""
    entries = json.loads(thresholds, parse_float=Decimal)
    return _highest_first(
        [Band(e["label"], Decimal(str(e["min"]))) for e in entries if e.get("min") is not None])


def default_bands() -> list[Band]:
    return bands_from_json(json.dumps(DEFAULT_BANDS))


def threshold_rows(settings: DataFrame, *keep: str) -> DataFrame:
    """One row per band of every settings row, the limit as it is written, to twelve places."""
    thresholds = F.from_json(F.get_json_object("value", "$.status_thresholds"), BAND_LIST)
    return (settings.select(*keep, F.inline(thresholds))
            .select(*keep, "label", F.col("min").try_cast(LIMIT).alias("min_pct"), "color"))


def load_bands(settings: DataFrame, key: str = "system") -> list[Band]:
    """Bands of one settings row, which is one document. No row or no thresholds means no bands."""
    rows = threshold_rows(settings.filter(F.col("key") == key)).collect()
    return _highest_first([Band(r["label"], r["min_pct"]) for r in rows if r["min_pct"] is not None])


def _chain(bands: list[Band], reached) -> Column:
    """First band reached, tried from the highest limit down."""
    label = F.lit(NO_BAND)
    for band in reversed(_highest_first(bands)):
        label = F.when(reached(F.lit(band.min_pct)), F.lit(band.label)).otherwise(label)
    return label


def status_label(percentage: Column, bands: list[Band]) -> Column:
    return _chain(bands, lambda limit: percentage >= limit)


def status_of_ratio(achieved: Column, target: Column, bands: list[Band]) -> Column:
    """Band of the unrounded percentage; no division, so no rounding can move a row across a limit."""
    return (F.when(target > 0, _chain(bands, lambda limit: achieved * 100 >= limit * target))
            .otherwise(status_label(F.lit(Decimal(0)), bands)))


def percentage_of_target(achieved: Column, target: Column) -> Column:
    """``achieved / target * 100`` rounded half away from zero to two places; 0 without a target.

    A decimal quotient is rounded by the division, so its floor is corrected by the remainder it leaves. A
    percentage that does not fit its type is NULL, which ``check_performance`` reports.
    """
    doubled = (F.abs(achieved) * 20000 + target).try_cast("decimal(38,2)")
    width = (target * 2).try_cast("decimal(20,2)")
    rough = F.floor(F.try_divide(doubled, width)).try_cast("decimal(30,0)")
    left = F.try_subtract(doubled, F.try_multiply(rough, width))
    hundredths = F.when(left < 0, rough - 1).when(left >= width, rough + 1).otherwise(rough)
    signed = F.when(achieved < 0, -hundredths).otherwise(hundredths)
    return (F.when(target > 0, (signed * F.lit(Decimal("0.01"))).try_cast(PERCENT))
            .otherwise(F.lit(Decimal("0.00")).cast(PERCENT)))
