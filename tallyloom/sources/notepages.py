"""Pages of the newest notes by keyset: a page starts after the last row of the one before, and opens only files that can hold it.

Notes are stored sorted by range, newest first, ties by id, notes without a time last. A manifest beside them has one row per file with
its first and last key and its number of rows. A page asks the manifest for the files that end after its token, and takes as many as
hold enough rows; at most one row of the manifest per row of the page reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.defaults import NOTES_PAGE_ROWS

_LAST = (1 << 63) - 1
_MANIFEST = "path string, first struct<at: bigint, id: bigint>, last struct<at: bigint, id: bigint>, n bigint"


def _key() -> Column:
    """Place of a note in the list: newest first, no time last, then by id."""
    return F.struct(F.coalesce(-F.unix_micros(F.col("message_at").cast("timestamp")), F.lit(_LAST)).alias("at"), F.col("id").cast("bigint").alias("id"))


@dataclass(frozen=True)
class NotePages:
    """Stored notes under ``root``; a token is the (place, id) of the last row that was shown."""

    spark: SparkSession
    root: str

    def write(self, notes: DataFrame, files: int) -> None:
        """Store the notes in about as many files."""
        keyed = notes.withColumn("_key", _key())
        keyed.repartitionByRange(files, "_key").sortWithinPartitions("_key").write.mode("overwrite").parquet(f"{self.root}/notes")
        stored = self.spark.read.schema(keyed.schema).parquet(f"{self.root}/notes")
        manifest = stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.min("_key").alias("first"), F.max("_key").alias("last"), F.count("*").alias("n"))
        manifest.write.mode("overwrite").parquet(f"{self.root}/manifest")

    def _files(self, rows: int, token: tuple[int, int] | None) -> list[str]:
        manifest = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
        if token is not None:
            manifest = manifest.filter(F.col("last") > _token(token))
        # Of the first file any number of rows may have been shown; the ones after it count in full.
        chosen, held = [], 0
        for file in manifest.orderBy("first").limit(rows + 1).collect():
            if chosen and held >= rows:
                break
            held += file["n"] if chosen or token is None else 0
            chosen.append(file["path"])
        return chosen

    def page(self, rows: int = NOTES_PAGE_ROWS, token: tuple[int, int] | None = None) -> DataFrame:
        """The next notes after a token, or the first ones."""
        schema = self.spark.read.parquet(f"{self.root}/notes").schema
        files = self._files(rows, token)
        stored = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        if token is not None:
            stored = stored.filter(F.col("_key") > _token(token))
        return stored.orderBy("_key").limit(rows)

    @staticmethod
    def next_token(page: DataFrame) -> tuple[int, int] | None:
        """Token of a page's last row; None after the last page. Only that row is brought back."""
        last = page.agg(F.max("_key").alias("k")).first()["k"]
        return None if last is None else (last["at"], last["id"])


def _token(token: tuple[int, int]) -> Column:
    kind = T.StructType([T.StructField("at", T.LongType()), T.StructField("id", T.LongType())])
    return F.struct(F.lit(token[0]).cast("bigint").alias("at"), F.lit(token[1]).cast("bigint").alias("id")).cast(kind)
