"""Quality notes: created from keyword hits, listed with filters, counted for reports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.defaults import LABEL_CHART_ROWS, NO_EMPLOYEE, NO_LABEL, NOTES_PAGE_ROWS
from tallyloom.operators.scanning import count_phrases, find_phrases


def scan_messages(messages: DataFrame, customers: DataFrame, keywords: DataFrame, **limits) -> DataFrame:
    """One note per (message, keyword) hit, with the message and customer as they are at scan time.

    ``messages`` needs message_id, customer_id, employee_id, body and sent_at; ``customers`` needs id,
    channel_id and name. The dimension is joined to the hits, not to the messages.
    """
    hits = find_phrases(messages.filter(F.col("body").isNotNull()), "message_id", "body", keywords,
                        keep=("customer_id", "employee_id", "body", "sent_at"), **limits)
    shown = customers.select(F.col("id").alias("customer_id"),
                             F.coalesce("name", "channel_id").alias("customer_name"))
    return (hits.join(shown, "customer_id", "left")
            .select("message_id", "customer_id", "employee_id", "customer_name", F.col("body").alias("message_text"),
                    F.col("sent_at").alias("message_at"), "keyword_id", "matched_phrase", "label"))


def notes_per_message(messages: DataFrame, keywords: DataFrame, **limits) -> DataFrame:
    return count_phrases(messages, "message_id", "body", keywords, **limits)


def in_dates(moment: Column, date_from: date | None, date_to: date | None) -> list[Column]:
    """Inclusive day range as a half-open range on the timestamp itself, so that it reaches the scan.

    An absent bound adds no predicate; a given one drops rows without a timestamp.
    """
    bounds = []
    if date_from is not None:
        bounds.append(moment >= F.lit(date_from))
    if date_to is not None:
        bounds.append(moment < F.lit(date_to + timedelta(days=1)))
    return bounds


def filter_notes(notes: DataFrame, *, employee_id: int | None = None, label: str | None = None,
                 date_from: date | None = None, date_to: date | None = None,
                 search: str | None = None) -> DataFrame:
    """Notes that meet every given filter. ``search`` is a case-blind pattern on text or customer."""
    conditions = in_dates(F.col("message_at"), date_from, date_to)
    if employee_id is not None:
        conditions.append(F.col("employee_id") == employee_id)
    if label is not None:
        conditions.append(F.col("label") == label)
    if search is not None:
        pattern = f"%{search}%"
        conditions.append(F.col("message_text").ilike(pattern) | F.col("customer_name").ilike(pattern))
    for condition in conditions:
        notes = notes.filter(condition)
    return notes


def latest_notes(notes: DataFrame, employees: DataFrame, *, limit: int = NOTES_PAGE_ROWS, **filters) -> DataFrame:
    """The newest notes that meet the filters; names are added to the page only."""
    page = (filter_notes(notes, **filters)
            .orderBy(F.desc_nulls_last("message_at"), "id").limit(limit))
    names = employees.select(F.col("id").alias("employee_id"), F.col("full_name").alias("employee_name"))
    return page.join(names, "employee_id", "left").select(
        "id", "employee_name", "customer_name", "message_text", "message_at", "label", "phrase")


def notes_stats(notes: DataFrame, as_of: date) -> DataFrame:
    """All notes and those of one day, in one pass over one column."""
    moment = F.col("message_at")
    today = (moment >= F.lit(as_of)) & (moment < F.lit(as_of + timedelta(days=1)))
    return notes.agg(F.count("*").alias("total"), F.count_if(F.coalesce(today, F.lit(False))).alias("today"))


def quality_by_label(notes: DataFrame, date_from: date | None = None, date_to: date | None = None) -> DataFrame:
    return (filter_notes(notes, date_from=date_from, date_to=date_to)
            .groupBy(F.coalesce("label", F.lit(NO_LABEL)).alias("label"))
            .agg(F.count("*").alias("n_notes")))


def quality_by_employee(notes: DataFrame, employees: DataFrame, date_from: date | None = None,
                        date_to: date | None = None, unassigned: str = NO_EMPLOYEE) -> DataFrame:
    """Notes per employee name. Namesakes share a row; ids without an employee count as unassigned.

    Notes are counted per id first, so the join and the second count see one row per id.
    """
    per_id = (filter_notes(notes, date_from=date_from, date_to=date_to)
              .groupBy("employee_id").agg(F.count("*").alias("n")))
    names = employees.select(F.col("id").alias("employee_id"), "full_name")
    return (per_id.join(names, "employee_id", "left")
            .groupBy(F.coalesce("full_name", F.lit(unassigned)).alias("employee_name"))
            .agg(F.sum("n").alias("n_notes")))


def top_labels(notes: DataFrame, limit: int = LABEL_CHART_ROWS) -> DataFrame:
    return quality_by_label(notes).orderBy(F.desc("n_notes"), "label").limit(limit)


def label_counts_map(notes: DataFrame, limit: int = LABEL_CHART_ROWS) -> DataFrame:
    """The label chart as one JSON object. Only the chart's own rows, at most ``limit``, are gathered."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "n_notes")))
    return top_labels(notes, limit).agg(F.to_json(F.map_from_entries(pairs)).alias("by_label"))


def distinct_labels(keywords: DataFrame) -> DataFrame:
    return keywords.select("label").distinct()


def keyword_list(keywords: DataFrame) -> DataFrame:
    """Every rule, inactive ones included, in id order."""
    return keywords.select("id", "phrase", "label", "is_active").orderBy("id")


def employee_list(employees: DataFrame) -> DataFrame:
    return employees.filter("is_active").select("id", "full_name").orderBy("full_name", "id")


def dashboard_counts(notes: DataFrame, employees: DataFrame, keywords: DataFrame, as_of: date) -> DataFrame:
    """The four numbers of the overview, one row."""
    people = employees.filter("is_active").agg(F.count("*"))
    rules = keywords.agg(F.count("*"))
    return notes_stats(notes, as_of).select(
        "total", "today", people.scalar().alias("n_employees"), rules.scalar().alias("n_keywords"))
