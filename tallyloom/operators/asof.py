"""As-of join: the last step at or below a value, per key.

Values and steps are put under each other, sorted, and the last step is carried to the values that follow. A key may hold most values:
its values are dealt to ``parts`` groups by a hash of the row, and its steps, which are few, go to each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(values: DataFrame, steps: DataFrame, by: list[str], value: str, step: str, carry: list[str], parts: int = 16) -> DataFrame:
    """``values`` with the columns ``carry`` of the step with the largest ``step <= value`` of its key.

    NULL without such a step, and for a NULL value or key. Of equal steps of a key, that with the smallest carried columns holds.
    """
    carried = F.struct(*carry)
    ranked = steps.filter(F.col(step).isNotNull()).groupBy(*by, F.col(step).alias("_at")).agg(F.min(carried).alias("_carried"))
    spread = ranked.select(*by, "_at", F.lit(0).alias("_kind"), "_carried", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    rows = values.select("*", F.struct(*values.columns).alias("_row"))
    part = F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int")
    kind = spread.schema["_carried"].dataType
    dealt = rows.select(*by, F.col(value).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_carried"), part.alias("_part"), "_row")
    both = spread.withColumn("_row", F.lit(None).cast(dealt.schema["_row"].dataType)).unionByName(dealt)
    below = Window.partitionBy(*by, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_carried", F.last("_carried", ignorenulls=True).over(below)).filter("_kind = 1")
    known = F.col("_at").isNotNull()
    for key in by:
        known = known & F.col(key).isNotNull()
    return seen.select("_row.*", *[F.when(known, F.col(f"_carried.{c}")).alias(c) for c in carry])
