"""Search index of notes: postings of three-letter pieces, kept as notes are appended.

A pattern is cut at its wildcards; a note that matches holds every piece of three letters of what is left, in the same column. The
postings of these pieces give candidates, and each candidate is tested with the pattern itself, so the index never changes a result.
A pattern without three letters in a row has no pieces and scans the notes.

Layout: ``batch_id=<n>/gram_bucket=<b>/``. A batch writes its own folder, so a retry replaces it; a search opens the buckets of the
pattern's pieces only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.text import grams
from tallyloom.plans.quality import filter_notes
from tallyloom.sources.tables import read_or_empty

GRAM = 3
SEARCHED = ("message_text", "customer_name")
_POSTINGS = T.StructType([T.StructField("gram", T.StringType()), T.StructField("field", T.IntegerType()), T.StructField("id", T.LongType()),
                          T.StructField("batch_id", T.LongType()), T.StructField("gram_bucket", T.IntegerType())])


def literal_parts(pattern: str) -> list[str]:
    """What stands between the wildcards ``%`` and ``_``; a backslash makes the next character literal."""
    parts, escaped = [""], False
    for c in pattern:
        if escaped or c not in "\\%_":
            parts[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            parts.append("")
    return [part for part in parts if part]


@dataclass(frozen=True)
class SearchIndex:
    """Postings under ``root`` of notes with id, message_text and customer_name."""

    spark: SparkSession
    root: str
    buckets: int = 256

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, notes: DataFrame, batch_id: int) -> None:
        """Store the postings of one batch of notes. A column of a note gives each piece once."""
        parts = [notes.select(F.col("id").cast("bigint").alias("id"), F.lit(n).alias("field"),
                              F.explode(grams(F.lower(F.coalesce(column, F.lit(""))), GRAM)).alias("gram"))
                 for n, column in enumerate(SEARCHED)]
        rows = reduce(DataFrame.unionByName, parts).withColumn("gram_bucket", self._bucket(F.col("gram")))
        # A common piece is split over several files; rebalancing keeps them even.
        (rows.hint("rebalance", "gram_bucket").sortWithinPartitions("gram_bucket", "gram").write.mode("overwrite")
         .option("partitionOverwriteMode", "static").partitionBy("gram_bucket").parquet(f"{self.root}/batch_id={batch_id}"))

    def pieces(self, search: str) -> list[str]:
        """Distinct pieces of a pattern, as they stand in lower-cased texts."""
        lowered = [self.spark.range(1).select(F.lower(F.lit(part))).first()[0] for part in literal_parts(search)]
        return sorted({part[n:n + GRAM] for part in lowered for n in range(len(part) - GRAM + 1)})

    def postings(self, pieces: list[str]) -> DataFrame:
        """Postings (gram, field, id, batch_id) of some pieces, read from their buckets."""
        buckets = self.spark.createDataFrame([(p,) for p in pieces], "gram string").select(self._bucket(F.col("gram"))).distinct().collect()
        stored = read_or_empty(self.spark, self.root, _POSTINGS)
        return stored.filter(F.col("gram_bucket").isin([r[0] for r in buckets]) & F.col("gram").isin(pieces)).select("gram", "field", "id", "batch_id")

    def search(self, notes: DataFrame, search: str) -> DataFrame:
        """Notes whose text or customer is like the pattern, in either case; the same rows as ``filter_notes(search=...)``."""
        pieces = self.pieces(search)
        if not pieces:
            return filter_notes(notes, search=search)
        held = self.postings(pieces).groupBy("id", "field").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(pieces))
        return filter_notes(notes.join(held.select("id").distinct(), "id", "left_semi"), search=search)
