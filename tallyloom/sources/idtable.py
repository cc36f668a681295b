"""Stored ids in hash-bucket folders: a batch is compared with the buckets its own ids fall into, and with no other file.

Layout under ``root``::

    recent/batch_id=<n>/id_bucket=<b>/    ids first stored by batch n
    settled/until=<n>/id_bucket=<b>/      all ids of batches up to n, sorted, one file per bucket
    switches/                             one row per settled generation, written after it is whole

A batch writes its own folders only, so a retried batch replaces them. Settling writes a new generation beside the old one and
then a switch row; a reader uses the newest generation that has a switch, so a settling that died changes nothing. The batch being
written is never settled, since a retry of it must not find its own ids. With settling after every ``settle_every`` batches, a lookup
opens at most one settled file and ``settle_every`` recent files per touched bucket, however many batches there were. The buckets of a batch are read as a list, which has at most ``buckets`` entries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators.keyed import absent, first_per_key
from tallyloom.sources.tables import read_or_empty

_SWITCHES = T.StructType([T.StructField("until", T.LongType())])


@dataclass(frozen=True)
class IdTable:
    """Ids of one column under ``root``. The number of buckets is fixed once ids are stored."""

    spark: SparkSession
    root: str
    buckets: int = 1024
    settle_every: int = 16

    def _bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("int")

    def _bucketed(self, ids: DataFrame) -> DataFrame:
        """One column, ``id`` as text, with its bucket; NULL ids are left out."""
        named = ids.toDF("id").select(F.col("id").cast("string")).filter(F.col("id").isNotNull())
        return named.withColumn("id_bucket", self._bucket(F.col("id")))

    def _read(self, path: str, *partitions: str) -> DataFrame:
        fields = [T.StructField("id", T.StringType())]
        fields += [T.StructField(p, T.IntegerType() if p == "id_bucket" else T.LongType()) for p in partitions]
        return read_or_empty(self.spark, path, T.StructType(fields))

    def settled_until(self) -> int:
        """Last batch of the newest whole generation; -1 before the first."""
        switches = read_or_empty(self.spark, f"{self.root}/switches", _SWITCHES)
        last = switches.agg(F.max("until")).first()[0]
        return -1 if last is None else last

    def candidates(self, ids: DataFrame, before: int) -> DataFrame:
        """Stored ids (id, id_bucket) of batches under ``before``, from the buckets of the given ids only."""
        touched = [r[0] for r in self._bucketed(ids).select("id_bucket").distinct().collect()]
        inside = F.col("id_bucket").isin(touched) if touched else F.lit(False)
        until = self.settled_until()
        recent = self._read(f"{self.root}/recent", "batch_id", "id_bucket").filter(
            inside & (F.col("batch_id") > until) & (F.col("batch_id") < before))
        rows = recent.select("id", "id_bucket")
        if until >= 0:
            rows = rows.unionByName(self._read(f"{self.root}/settled/until={until}", "id_bucket").filter(inside))
        return rows

    def known(self, ids: DataFrame, before: int) -> DataFrame:
        """The given ids that batches under ``before`` have stored, as ``id``."""
        asked = self._bucketed(ids).distinct()
        return self.candidates(ids, before).join(asked, ["id_bucket", "id"], "left_semi").select("id").distinct()

    def add(self, ids: DataFrame, batch_id: int) -> None:
        """Store the ids of a batch; ``ids`` has one column. Settles earlier batches when enough have come since the last time."""
        rows = self._bucketed(ids).distinct()
        (rows.repartition("id_bucket").sortWithinPartitions("id_bucket", "id").write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("id_bucket").parquet(f"{self.root}/recent/batch_id={batch_id}"))
        if batch_id - 1 - self.settled_until() >= self.settle_every:
            self.settle(batch_id - 1)

    def settle(self, until: int) -> None:
        """Merge all batches up to ``until`` into a new generation and switch to it."""
        before = self.settled_until()
        rows = self._read(f"{self.root}/recent", "batch_id", "id_bucket").filter(
            (F.col("batch_id") > before) & (F.col("batch_id") <= until)).select("id", "id_bucket")
        if before >= 0:
            rows = rows.unionByName(self._read(f"{self.root}/settled/until={before}", "id_bucket"))
        self._switch_to(rows, until)

    def rebuild(self, ids: DataFrame, until: int) -> None:
        """Take all ids anew from the table they come from, as of batch ``until``."""
        self._switch_to(self._bucketed(ids), until)

    def _switch_to(self, rows: DataFrame, until: int) -> None:
        (rows.distinct().repartition("id_bucket").sortWithinPartitions("id_bucket", "id").write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("id_bucket").parquet(f"{self.root}/settled/until={until}"))
        self.spark.createDataFrame([(until,)], _SWITCHES).coalesce(1).write.mode("append").parquet(f"{self.root}/switches")


def new_by_table(arrived: DataFrame, key: str, order: list[str], table: IdTable, before: int) -> DataFrame:
    """First row of each key that the table does not know; rows without a key all pass."""
    identified = arrived.filter(F.col(key).isNotNull())
    known = table.known(identified.select(key), before).withColumnRenamed("id", key)
    first = absent(first_per_key(identified, [key], order), known, [key])
    return first.unionByName(arrived.filter(F.col(key).isNull()))
