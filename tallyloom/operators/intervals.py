"""Half-open intervals of time: which overlap, and how many are alive in each hour.

Overlaps are an equality join on time buckets. An interval is cut into the buckets it touches, and a pair is reported in its
first common bucket only, so a long interval meets every partner once. Counting needs no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400


def _bucket(moment: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(moment) / seconds)


def _last_bucket(end: Column, seconds: int) -> Column:
    """Bucket of the last instant before ``end``."""
    return F.floor((F.unix_micros(end) - 1) / (seconds * 1_000_000))


def overlapping_pairs(rows: DataFrame, id_: str, by: str, start: str, end: str, bucket_seconds: int = 7 * DAY) -> DataFrame:
    """``by``, ``left_id`` and ``right_id`` (left < right) of intervals of one key that share an instant.

    Empty intervals, and those without a bound or key, overlap nothing. Buckets near the usual length keep rows and pairs few.
    """
    first, last = _bucket(F.col("_start"), bucket_seconds), _last_bucket(F.col("_end"), bucket_seconds)
    cut = (rows.select(F.col(by).alias("_by"), F.col(id_).alias("_id"), F.col(start).cast("timestamp").alias("_start"),
                       F.col(end).cast("timestamp").alias("_end"))
           .filter("_start < _end").select("*", first.alias("_first"), F.explode(F.sequence(first, last)).alias("_bucket")))
    left, right = (cut.select("_by", "_bucket", *[F.col(c).alias(f"{side}{c}") for c in ("_id", "_start", "_end", "_first")])
                   for side in ("left", "right"))
    met = left.join(right, ["_by", "_bucket"])
    overlap = (F.col("left_id") < F.col("right_id")) & (F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end"))
    once = F.col("_bucket") == F.greatest("left_first", "right_first")
    return met.filter(overlap & once).select(F.col("_by").alias(by), "left_id", "right_id")


def alive_per_hour(rows: DataFrame, start: str, end: str) -> DataFrame:
    """``hour`` and ``n_alive`` of every hour in which an interval is alive.

    Starts and ends are counted per hour. Each day begins with the number of intervals that reach into it, so that days are summed
    up apart from each other; an interval gives one row for each of its days, not for each of its hours.
    """
    first = _bucket(F.col("_start"), HOUR)
    until = _last_bucket(F.col("_end"), HOUR) + 1
    spans = (rows.select(F.col(start).cast("timestamp").alias("_start"), F.col(end).cast("timestamp").alias("_end"))
             .filter("_start < _end").groupBy(first.alias("_first"), until.alias("_until")).agg(F.count("*").alias("n")))
    day = lambda hour: F.floor(hour / 24)
    changes = F.array(F.struct(F.col("_first").alias("hour"), F.col("n").alias("change")), F.struct(F.col("_until").alias("hour"), (-F.col("n")).alias("change")))
    steps = spans.select(F.inline(changes))
    # Days an interval lives in beyond the first: it is there when the day begins.
    later = F.sequence(day(F.col("_first")) + 1, day(F.col("_until") - 1))
    carried = (spans.filter(day(F.col("_until") - 1) > day(F.col("_first"))).select("n", F.explode(later).alias("day"))
               .select((F.col("day") * 24).alias("hour"), F.col("n").alias("change")))
    # What a day takes over is taken out again where the interval ends on that day; an end at a day's first hour has no row to correct.
    ends_at_midnight = steps.filter((F.col("change") > 0) | (F.col("hour") % 24 != 0))
    per_hour = ends_at_midnight.unionByName(carried).groupBy("hour").agg(F.sum("change").alias("change"))
    hours = per_hour.select(day(F.col("hour")).alias("day")).distinct().select(
        "day", F.explode(F.sequence(F.col("day") * 24, F.col("day") * 24 + 23)).alias("hour"))
    running = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    alive = hours.join(per_hour, "hour", "left").select("hour", F.sum(F.coalesce("change", F.lit(0))).over(running).alias("n_alive"))
    return alive.filter("n_alive > 0").select(F.timestamp_seconds(F.col("hour") * HOUR).alias("hour"), "n_alive")
