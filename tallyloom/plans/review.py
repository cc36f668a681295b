"""Sales nobody was matched to: the review queue and manual assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import REVIEW_QUEUE_ROWS
from tallyloom.functions.jsontext import json_text
from tallyloom.operators.keyed import first_per_known_key, new_rows


def distinct_invoices(sales: DataFrame, order: list[str]) -> DataFrame:
    """First row per invoice; sales without an invoice are all kept."""
    return first_per_known_key(sales, "invoice_ref", order)


def new_sales(arrived: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """Arrived sales whose invoice is not stored yet, one per invoice; sales without an invoice all pass."""
    return new_rows(arrived, stored, "invoice_ref", order)


def unmatched_sales(sales: DataFrame, limit: int = REVIEW_QUEUE_ROWS) -> DataFrame:
    """The newest unmatched sales, with the fields a reviewer needs. JSON is read after the limit."""
    newest = (sales.filter(F.col("employee_id").isNull())
              .select("id", "amount", "sale_date", "raw")
              .orderBy(F.desc("sale_date"), "id").limit(limit))
    return newest.select("id", "amount", "sale_date", json_text(F.col("raw"), "$.reference").alias("reference"),
                         json_text(F.col("raw"), "$.notes").alias("notes"))


def unmatched_count(sales: DataFrame) -> DataFrame:
    return sales.filter(F.col("employee_id").isNull()).agg(F.count("*").alias("n_unmatched"))


def with_assignments(sales: DataFrame, assignments: DataFrame, order: str) -> DataFrame:
    """Sales with the latest manual assignment applied; an assignment to NULL clears the employee.

    Assignments of unknown sales have no effect. One without an order counts as the oldest; of several with the same
    order the highest employee wins, and clearing the employee is lowest.
    """
    latest = (assignments.filter(F.col("sale_id").isNotNull()).groupBy("sale_id")
              .agg(F.max(F.struct(F.col(order), "employee_id")).alias("_assigned")))
    employee = F.when(F.col("_assigned").isNotNull(), F.col("_assigned.employee_id")).otherwise(F.col("employee_id"))
    return (sales.join(latest, sales["id"] == latest["sale_id"], "left")
            .select(*[employee.alias(c) if c == "employee_id" else F.col(c) for c in sales.columns]))
