"""The text, band and table functions for use in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyloom.defaults import DEFINITE_ARTICLE, DELETED_MARKS, FOLDED_INTO, FOLDED_LETTERS, NO_BAND, NOTES_PAGE_ROWS
from tallyloom.functions.bands import Band


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession, bands: list[Band]) -> None:
    """Create the temporary functions ``normalize_text(text)`` and ``status_label(percentage)``.

    Their bodies are SQL expressions, so a query that calls them is optimised as if they were written out.
    """
    article = _quoted(rf"(^|\s){DEFINITE_ARTICLE}")
    spark.sql(f"""
        create or replace temporary function normalize_text(t string) returns string return
        trim(regexp_replace(regexp_replace(translate(lower(
          regexp_replace(coalesce(t, ''), '<[^>]+>|&nbsp;', ' ')),
          {_quoted(FOLDED_LETTERS + DELETED_MARKS)}, {_quoted(FOLDED_INTO)}), {article}, '$1'), '\\\\s+', ' '))""")
    highest_first = sorted(bands, key=lambda band: (-band.min_pct, band.label))
    steps = " ".join(f"when percentage >= {band.min_pct} then {_quoted(band.label)}" for band in highest_first)
    body = f"case {steps} else {_quoted(NO_BAND)} end" if steps else _quoted(NO_BAND)
    spark.sql(f"create or replace temporary function status_label(percentage decimal(38,12)) returns string return {body}")



def register_table_functions(spark: SparkSession, *, sessions: str, users: str, notes: str, page_rows: int = NOTES_PAGE_ROWS) -> None:
    """Create temporary table functions over views of these names, for the FROM clause and lateral joins:

    ``live_sessions(as_of)``; ``notes_page(label, search, date_from, date_to)``, the newest notes that meet what is not NULL; and
    ``employee_labels(employee_id)``, the labels of an employee's notes with their counts. Their bodies are inlined into the query
    that calls them, so a lateral join by employee is an ordinary join of one count.
    """
    spark.sql(f"""
        create or replace temporary function live_sessions(as_of timestamp)
        returns table(session_id bigint, user_id bigint, full_name string, role string, expires_at timestamp) return
        select s.session_id, s.user_id, u.full_name, u.role, cast(s.expires_at as timestamp) from {sessions} s join {users} u on u.id = s.user_id
        where u.is_active and s.expires_at > live_sessions.as_of""")
    spark.sql(f"""
        create or replace temporary function notes_page(label string, search string, date_from date, date_to date)
        returns table(id bigint, customer_name string, message_text string, message_at timestamp, label string) return
        select n.id, n.customer_name, n.message_text, cast(n.message_at as timestamp), n.label
        from {notes} n
        where (notes_page.label is null or n.label = notes_page.label)
          and (notes_page.search is null or n.message_text ilike concat('%', notes_page.search, '%')
               or n.customer_name ilike concat('%', notes_page.search, '%'))
          and (notes_page.date_from is null or n.message_at >= notes_page.date_from)
          and (notes_page.date_to is null or n.message_at < date_add(notes_page.date_to, 1))
        order by n.message_at desc nulls last, n.id limit {int(page_rows)}""")
    spark.sql(f"""
        create or replace temporary function employee_labels(employee_id bigint) returns table(label string, n_notes bigint) return
        select n.label, count(*) from {notes} n where n.employee_id = employee_labels.employee_id group by n.label""")
