"""Stored tables and the chat feed as DataFrames."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.schemas import SALES


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet table with its fixed schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same for a table that may not have been written yet."""
    try:
        return read_table(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_sales(spark: SparkSession, path: str, since: date, until: date) -> DataFrame:
    """Sales of some days, the end excluded, from the month folders they can be in."""
    month, day = F.col("sale_month"), F.col("sale_date")
    schema = T.StructType([*SALES.fields, T.StructField("sale_month", T.DateType())])
    rows = read_table(spark, path, schema)
    inside = (month >= F.lit(since.replace(day=1))) & (month < F.lit(until)) & (day >= F.lit(since)) & (day < F.lit(until))
    return rows.filter(inside).drop("sale_month")


def read_sales_days(spark: SparkSession, path: str, days: DataFrame, months: list[date]) -> DataFrame:
    """Sales of the given days (``sale_date``), from the folders of the given months."""
    schema = T.StructType([*SALES.fields, T.StructField("sale_month", T.DateType())])
    rows = read_table(spark, path, schema).filter(F.col("sale_month").isin(months) if months else F.lit(False)).drop("sale_month")
    return rows.join(days, "sale_date", "left_semi").select(*SALES.fieldNames())


def _files(spark: SparkSession, streaming: bool):
    return spark.readStream if streaming else spark.read


def feed_documents(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Feed landed as one JSON document per file; the file is the delivery and its time the arrival."""
    rows = _files(spark, streaming).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("payload_id"), F.col("value").alias("payload"),
                       F.col("_metadata.file_modification_time").alias("received_at"))


def feed_envelopes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Feed landed as JSON lines ``{payload_id, received_at, payload}`` with the document as text."""
    schema = "payload_id string, received_at timestamp, payload string"
    return _files(spark, streaming).schema(schema).json(path).select("payload_id", "payload", "received_at")


def feed_of_records(records: DataFrame) -> DataFrame:
    """Feed read from a message log, with its usual columns topic, partition, offset, value, timestamp."""
    return records.select(F.concat_ws("/", "topic", "partition", "offset").alias("payload_id"),
                          F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("received_at"))
