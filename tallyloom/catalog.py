"""The registered queries: each operator over the sample tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.defaults import NO_BAND
from tallyloom.functions.bands import (
    bands_from_json,
    percentage_of_target,
    status_label,
    status_of_ratio,
    threshold_rows,
)
from tallyloom.functions.jsontext import epoch_or_arrival, json_number, json_text, public_settings
from tallyloom.functions.periods import Periods, period_columns
from tallyloom.functions.register import register_table_functions
from tallyloom.functions.text import match_name, none_if_blank, normalize_text
from tallyloom.operators import access, integrity, intervals, keyed, matching
from tallyloom.operators.asof import asof_join
from tallyloom.operators.scanning import frequent_words
from tallyloom.plans import messages as feed
from tallyloom.plans import calendar, deltas, maintenance, performance, quality, review, roster
from tallyloom.plans.deletion import delete_many
from tallyloom.sources import samples
from tallyloom.sources.idtable import IdTable, new_by_table
from tallyloom.sources.notepages import NotePages
from tallyloom.sources.searchindex import SearchIndex
from tallyloom.sources.sinks import seed_rows
from tallyloom.sources.workspace import fresh_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PERIODS = Periods(samples.SALES_AS_OF)
DAY_BEFORE = Periods(date(2000, 5, 31))
BANDS = bands_from_json(samples.BANDS_JSON)
LEADER_USER = 102
NOTE_FILTERS = {"date_from": date(2024, 1, 10), "date_to": samples.NOTES_AS_OF}


class Tables:
    """Sample views and base tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        rows = samples.view(self._spark, self._folder, name)
        setattr(self, name, rows)
        return rows

    def base(self, name: str) -> DataFrame:
        return samples.table(self._spark, self._folder, name)


def _plain(rows: DataFrame) -> DataFrame:
    """Result columns in types every client compares alike: no decimals, no zoned timestamps."""
    names = {"decimal": "double", "timestamp": "timestamp_ntz"}
    casts = [(c, names.get(kind.split("(")[0])) for c, kind in rows.dtypes]
    return rows.select(*[F.col(c).cast(to).alias(c) if to else F.col(c) for c, to in casts])


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _plain(build(Tables(spark, folder)))

    QUERIES[build.__name__.rstrip("_")] = run
    return build


# Sales performance


@query
def active_employees(t):
    return quality.employee_list(t.employees)


@query
def match_names(t):
    return matching.employee_names(t.employees).select("id", "name", "first_word", "last_word")


@query
def period_bounds(t):
    orders = t.base("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return orders.select("o_orderkey", *period_columns(F.col("day")))


@query
def period_grid(t):
    return performance.period_grid(t.employees, PERIODS)


@query
def sales_by_employee_period(t):
    return performance.sales_by_employee_period(t.sales_lines, PERIODS)


@query
def sales_by_leader_period(t):
    return performance.sales_by_leader_period(t.sales_lines, t.employees, PERIODS)


@query
def employee_performance(t):
    return performance.employee_performance(t.sales_lines, t.employees, t.targets, PERIODS, BANDS)


@query
def leader_performance(t):
    return performance.leader_performance(t.sales_lines, t.employees, t.team_leaders, t.targets, PERIODS, BANDS)


def _snapshot(t, periods=PERIODS, sales=None):
    return performance.performance_snapshot(
        t.sales_lines if sales is None else sales, t.employees, t.team_leaders, t.targets, periods, BANDS)


@query
def performance_snapshot(t):
    return _snapshot(t)


@query
def live_display(t):
    return performance.live_display(_snapshot(t), t.employees, t.team_leaders, PERIODS)


@query
def performance_upsert(t):
    return performance.replace_current(_snapshot(t, DAY_BEFORE), _snapshot(t), t.employees, t.team_leaders, PERIODS)


@query
def percentage_calc(t):
    money = "decimal(14,2)"
    sums = t.base("lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_discount").cast(money)).cast(money).alias("achieved"),
        F.sum(F.col("l_tax").cast(money)).cast(money).alias("tax"))
    target = F.when(F.col("l_suppkey") % 13 == 0, F.lit(0).cast(money)).otherwise(F.col("tax"))
    rated = sums.select("l_suppkey", "achieved", target.alias("target"))
    return rated.select(
        "l_suppkey", "achieved", "target",
        percentage_of_target(F.col("achieved"), F.col("target")).alias("percentage"),
        status_of_ratio(F.col("achieved"), F.col("target"), BANDS).alias("status"))


@query
def status_bands(t):
    percentage = (F.col("c_acctbal").cast("decimal(14,2)") * F.lit(0.02).cast("decimal(3,2)")).alias("percentage")
    return t.base("customer").select("c_custkey", percentage).select(
        "c_custkey", "percentage", status_label(F.col("percentage"), BANDS).alias("status"))


@query
def team_status_bands(t):
    """Customers banded by the settings of their own team; a third of them belong to one team."""
    team = F.when(F.col("c_custkey") % 3 == 0, 7).otherwise(F.col("c_custkey") % 40 + 1)
    amount = (F.col("c_acctbal").cast("decimal(14,2)") * F.lit(0.02).cast("decimal(3,2)")).cast("decimal(38,12)")
    rated = t.base("customer").select("c_custkey", F.concat(F.lit("team-"), team.cast("string")).alias("key"), amount.alias("percentage"))
    found = asof_join(rated, threshold_rows(t.settings, "key"), ["key"], "percentage", "min_pct", ["label"])
    return found.select("c_custkey", "key", "percentage", F.coalesce("label", F.lit(NO_BAND)).alias("status"))


@query
def threshold_rows_(t):
    return threshold_rows(t.settings, "key")


@query
def settings_json(t):
    return t.settings.select("key", *public_settings(F.col("value"), "untitled"))


@query
def json_fields(t):
    props, raw = F.col("props"), F.to_json(F.struct("event_type", "value"))
    return t.base("events").select(
        "event_id", json_number(props, "$.k").alias("k"), json_number(props, "$.missing", "int", 20).alias("missing"),
        json_text(props, "$.k", "-").alias("k_text"), json_text(raw, "$.event_type").alias("event_type"))


# Review queue and assignments


@query
def unmatched_sales(t):
    return review.unmatched_sales(t.sales_records)


@query
def unmatched_count(t):
    return review.unmatched_count(t.sales_records)


@query
def sales_dedup(t):
    return review.distinct_invoices(t.sales_raw, ["line_order", "raw"])


def _assignments(sales):
    changed = sales.filter(F.col("id") % 97 == 0)
    employee = F.when(F.col("id") % 194 != 0, F.col("id") % 10)
    first = changed.select(F.col("id").alias("sale_id"), F.lit(99).cast("bigint").alias("employee_id"),
                           F.lit(1).alias("change_no"))
    return first.unionByName(changed.select(F.col("id").alias("sale_id"), employee.alias("employee_id"),
                                            F.lit(2).alias("change_no")))


def _assigned(t):
    return review.with_assignments(t.sales_records, _assignments(t.sales_records), "change_no")


@query
def sales_with_assignments(t):
    return _assigned(t)


@query
def performance_after_assign(t):
    return _snapshot(t, sales=_assigned(t))


@query
def performance_delta(t):
    """A tenth of the sales is new and some of the others move: the rows of all periods these touch."""
    stored, fresh = t.sales_records.filter("id % 11 <> 0"), t.sales_records.filter("id % 11 = 0")
    dimensions = (t.employees, t.team_leaders, t.targets, BANDS)
    signed = deltas.added_sales(fresh).unionByName(deltas.moved_sales(stored, _assignments(stored), "change_no"))
    return deltas.performance_delta(deltas.performance_history(stored, *dimensions), signed, *dimensions)


@query
def performance_calendar(t):
    return calendar.performance_calendar(t.sales_lines, t.employees, date(2000, 1, 1), date(2000, 12, 31))


# Text and matching


@query
def normalize_text_(t):
    documents = t.base("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = t.base("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    texts = documents.unionByName(pages)
    return texts.select("kind", "id", normalize_text(F.col("text")).alias("norm_text"))


@query
def match_employee(t):
    return matching.match_employees(t.messages, "message_id", "body", matching.employee_names(t.people))


@query
def match_employee_many(t):
    return matching.match_employees(t.base("documents"), "doc_id", "text",
                                    matching.employee_names(t.authors))


@query
def match_employee_shuffled(t):
    return matching.match_employees(t.base("documents"), "doc_id", "text",
                                    matching.employee_names(t.authors))


@query
def keyword_scan(t):
    return quality.scan_messages(t.messages, t.channel_customers, t.keywords, in_place=True)


def _passages(t):
    documents = t.base("documents")
    return documents.select(
        F.col("doc_id").alias("message_id"), (F.col("doc_id") % 150).alias("customer_id"),
        F.lit(None).cast("bigint").alias("employee_id"), F.col("text").alias("body"),
        F.lit(None).cast("timestamp_ntz").alias("sent_at"))


@query
def keyword_scan_many(t):
    return quality.scan_messages(_passages(t), t.channel_customers, t.passage_rules)


@query
def keyword_scan_shuffled(t):
    return quality.scan_messages(_passages(t), t.channel_customers, t.passage_rules)


@query
def keyword_scan_by_frequency(t):
    """The same with anchors chosen by how many texts hold them."""
    frequent = written(frequent_words(t.base("documents"), "text"), "frequent-words")
    return quality.scan_messages(_passages(t), t.channel_customers, t.passage_rules, frequent=frequent)


@query
def notes_per_message(t):
    return quality.notes_per_message(t.messages, t.keywords, in_place=True)


# Chat feed


def _payloads(t):
    """Each message as one delivery of the feed, with its contact."""
    customers = t.channel_customers.select(F.col("id").alias("customer_id"), "channel_id", "name")
    rows = t.messages.join(customers, "customer_id")
    contact = F.struct(F.col("channel_id").alias("wa_id"), F.struct(F.col("name").alias("name")).alias("profile"))
    message = F.struct(
        F.col("channel_message_id").alias("id"), F.col("channel_id").alias("from"),
        F.unix_seconds(F.col("sent_at")).cast("string").alias("timestamp"), F.lit("text").alias("type"),
        F.struct(F.col("body").alias("body")).alias("text"))
    value = F.struct(F.array(contact).alias("contacts"), F.array(message).alias("messages"))
    changes = F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))
    return rows.select(F.col("message_id").cast("string").alias("payload_id"),
                       F.to_json(F.struct(F.array(changes).alias("entry"))).alias("payload"),
                       F.lit(datetime(2024, 2, 1)).alias("received_at"))


@query
def webhook_flatten(t):
    rows = feed.flatten_payloads(feed.parse_payloads(_payloads(t)))
    return rows.select("payload_id", "channel_message_id", "channel_id", "customer_name", "direction", "body", "sent_at",
                       json_text(F.col("raw"), "$.type").alias("raw_type"))


@query
def webhook_kinds(t):
    """Deliveries of several messages of all kinds, with contacts that repeat or name nobody."""
    customers = t.channel_customers.select(F.col("id").alias("customer_id"), "channel_id", "name")
    rows, kind = t.messages.join(customers, "customer_id"), F.col("message_id") % 5

    def only(n: int, value):
        return F.when(kind == n, value)

    body = F.coalesce("body", F.lit(""))
    message = F.struct(
        F.col("channel_message_id").alias("id"), F.col("channel_id").alias("from"), F.unix_seconds("sent_at").cast("string").alias("timestamp"),
        F.when(kind == 4, "").otherwise(F.get(F.array(*map(F.lit, ("text", "button", "interactive", "image"))), kind.cast("int"))).alias("type"),
        F.when(kind.isin(0, 1), F.struct(F.when(kind == 0, body).otherwise("").alias("body"))).alias("text"),
        only(1, F.struct(F.concat(F.lit("B: "), body).alias("text"))).alias("button"),
        only(2, F.struct(F.concat(F.lit("r"), F.col("message_id").cast("string")).alias("id"))).alias("interactive"))
    gathered = rows.groupBy("customer_id", "channel_id", "name").agg(F.array_sort(F.collect_list(F.struct("message_id", message.alias("m")))).alias("sent"))
    contact = lambda wa_id, name: F.struct(wa_id.alias("wa_id"), F.struct(name.alias("name")).alias("profile"))
    contacts = F.array(contact(F.col("channel_id"), F.lit("First")), contact(F.lit(""), F.lit("Nobody")),
                       contact(F.col("channel_id"), F.coalesce("name", F.lit(""))), contact(F.lit("other"), F.lit("Other")))
    value = F.struct(contacts.alias("contacts"), F.transform("sent", lambda s: s["m"]).alias("messages"))
    changes = F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))
    payloads = gathered.select(F.col("customer_id").cast("string").alias("payload_id"), F.to_json(F.struct(F.array(changes).alias("entry"))).alias("payload"),
                               F.lit(datetime(2024, 2, 1)).alias("received_at"))
    return feed.flatten_payloads(feed.parse_payloads(payloads)).select(
        "payload_id", F.col("position.message_no").alias("message_no"), "message_id", "channel_message_id", "channel_id", "customer_name", "body", "sent_at",
        json_text(F.col("raw"), "$.from").alias("raw_from"), json_text(F.col("raw"), "$.interactive.id").alias("raw_reply"))


@query
def epoch_parse(t):
    seconds = (F.col("event_id") + 1_700_000_000).cast("string")
    case = F.col("event_id") % 9
    text = (F.when(case == 0, seconds).when(case == 1, F.concat(seconds, F.lit("abc")))
            .when(case == 2, "0").when(case == 3, "x").when(case == 5, F.concat(F.lit("0" * 20), seconds))
            .when(case == 6, F.concat(seconds, F.lit("0" * 12))).when(case == 7, F.concat(seconds, F.lit("0" * 40)))
            .when(case == 8, F.concat(F.lit("  +"), seconds)))
    return t.base("events").select(
        "event_id", epoch_or_arrival(text, F.col("ts").cast("timestamp")).alias("sent_at"))


@query
def messages_dedup(t):
    stored = t.messages.filter(F.col("customer_id") % 5 == 1)
    arrived = t.deliveries
    return feed.new_messages(arrived, stored, feed.ARRIVAL).select(
        "payload_id", "delivery", "channel_message_id", "channel_id", "body", "received_at")


@query
def messages_dedup_by_bucket(t):
    """The same through a stored id table, of which the batch reads its own buckets only."""
    ids = IdTable(t._spark, fresh_folder(t._spark, "message-ids"), buckets=16)
    ids.add(t.messages.filter(F.col("customer_id") % 5 == 1).select("channel_message_id"), 0)
    return new_by_table(t.deliveries, "channel_message_id", feed.ARRIVAL, ids, 1).select(
        "payload_id", "delivery", "channel_message_id", "channel_id", "body", "received_at")


@query
def customers_upsert(t):
    return feed.upsert_customers(t.channel_customers, feed.customer_changes(t.deliveries, feed.ARRIVAL))


@query
def customer_name_on_arrival(t):
    arrived = t.deliveries.withColumn("message_id", F.col("payload_id"))
    return feed.names_on_arrival(arrived, arrived, t.channel_customers)


@query
def feed_health(t):
    stored = t.messages.filter(F.col("customer_id") % 5 == 1)
    return feed.feed_health(feed.new_messages(t.deliveries, stored, feed.ARRIVAL))


# Quality notes


@query
def seed_keywords(t):
    stored = t.part_rules.filter("id % 3 <> 0")
    seeds = t.part_rules.withColumn("label", F.lit("seeded"))
    return seed_rows(stored, seeds, ["id"])


@query
def keyword_list(t):
    return quality.keyword_list(t.part_rules)


@query
def distinct_labels(t):
    return quality.distinct_labels(t.part_rules)


@query
def dashboard_counts(t):
    return quality.dashboard_counts(t.notes, t.employees, t.part_rules, samples.NOTES_AS_OF)


@query
def notes_filtered(t):
    return quality.latest_notes(t.notes, t.employees, label="click", search='"k": 8', **NOTE_FILTERS)


@query
def notes_latest(t):
    return quality.latest_notes(t.notes, t.employees)


@query
def notes_search(t):
    return quality.filter_notes(t.notes, search='VIEW {"K": 8').select("id", "customer_name", "message_text")


@query
def notes_search_indexed(t):
    """The same through postings that are stored first."""
    index = SearchIndex(t._spark, fresh_folder(t._spark, "note-index"), buckets=32)
    index.add(t.notes, 0)
    return index.search(t.notes, 'VIEW {"K": 8').select("id", "customer_name", "message_text")


@query
def sql_table_functions(t):
    """The table functions in SQL, one of them laterally."""
    views = {name: f"catalog_{name}" for name in ("sessions", "users", "notes")}
    for name, shown in views.items():
        getattr(t, name).createOrReplaceTempView(shown)
    t.employees.createOrReplaceTempView("catalog_employees")
    register_table_functions(t._spark, **views)
    return t._spark.sql("""
        select 'session' as kind, session_id as id, full_name as text, cast(user_id as bigint) as n from live_sessions(timestamp '2024-01-20')
        union all
        select 'note', id, message_text, length(customer_name) from notes_page('click', '"k": 8', date '2024-01-10', date '2024-01-20')
        union all
        select 'label', e.id, l.label, l.n_notes from catalog_employees e, lateral employee_labels(e.id) l""")


@query
def notes_date_range(t):
    return quality.filter_notes(t.notes, **NOTE_FILTERS).select("id", "message_at")


@query
def notes_pages(t):
    """The third page of the notes, by the token of the second."""
    pages = NotePages(t._spark, fresh_folder(t._spark, "note-pages"))
    pages.write(t.notes, 8)
    token = None
    for _ in range(2):
        token = pages.next_token(pages.page(40, token))
    return pages.page(40, token).select("id", "message_at", "label")


@query
def notes_stats(t):
    return quality.notes_stats(t.notes, samples.NOTES_AS_OF)


@query
def top_labels(t):
    return quality.top_labels(t.notes)


@query
def quality_by_label(t):
    return quality.quality_by_label(t.notes, **NOTE_FILTERS)


@query
def quality_by_employee(t):
    return quality.quality_by_employee(t.notes, t.employees, **NOTE_FILTERS)


@query
def label_counts_map(t):
    return quality.label_counts_map(t.notes)


# Roles, sessions, documents


def _leader(t):
    return access.leader_of_user(t.team_leaders, LEADER_USER)


@query
def leader_of_user(t):
    return _leader(t)


@query
def scoped_employees(t):
    return access.own_rows(t.employees, "team_leader", _leader(t), "team_leader_id")


@query
def scoped_team_leaders(t):
    return access.own_rows(t.team_leaders, "team_leader", _leader(t), "id")


@query
def scoped_targets(t):
    return access.own_team_rows(t.targets, "team_leader", _leader(t), t.employees)


@query
def scoped_performance(t):
    return access.own_team_rows(access.without_amounts(_snapshot(t)), "team_leader", _leader(t), t.employees)


@query
def user_directory(t):
    return access.user_directory(t.users)


@query
def active_sessions(t):
    return access.active_sessions(t.sessions.withColumn("expires_at", access.session_expiry(F.col("created_at"))),
                                  t.users, datetime(2024, 1, 20))


def _sessions(t):
    """All sessions, and one of a month."""
    long_one = t.users.filter("id = 1").select(F.col("id").alias("user_id")).select(
        F.lit(-1).cast("bigint").alias("session_id"), "user_id", F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("created_at"),
        F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz").alias("expires_at"))
    own = t.sessions.select("session_id", F.col("user_id").cast("bigint").alias("user_id"), F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                            access.session_expiry(F.col("created_at")).cast("timestamp_ntz").alias("expires_at"))
    return own.unionByName(long_one)


@query
def session_overlaps(t):
    pairs = intervals.overlapping_pairs(_sessions(t), "session_id", "user_id", "created_at", "expires_at")
    return pairs.groupBy("user_id").agg(F.count("*").alias("n_pairs"), F.sum("left_id").alias("left_ids"), F.sum("right_id").alias("right_ids"))


@query
def sessions_alive_hourly(t):
    return intervals.alive_per_hour(_sessions(t), "created_at", "expires_at")


@query
def active_admins(t):
    return access.active_admins(t.users)


@query
def team_roster_json(t):
    return roster.team_rosters(t.team_leaders, t.employees)


# Table maintenance


@query
def clean_strings(t):
    return t.employees.select("id", none_if_blank(F.col("external_ref")).alias("clean_ref"),
                              match_name(F.col("external_ref"), F.col("full_name")).alias("match_name"))


@query
def duplicate_names_ci(t):
    return integrity.same_ignoring_case(t.employees, "full_name")


@query
def target_duplicates(t):
    first = t.targets
    again = first.filter(F.col("id") % 7 == 0).withColumn("id", F.col("id") + 1_000_000)
    return keyed.duplicate_keys(first.unionByName(again), [F.col(c) for c in maintenance.TARGET_KEY])


def _employee_changes(t):
    e = t.employees
    renamed = e.filter("id % 5 = 0").select(
        "id", F.concat("full_name", F.lit(" (edited)")).alias("full_name"), F.lit("1").alias("external_ref"),
        "team_leader_id", F.lit(True).alias("is_active"), F.lit(1).alias("change_no"))
    again = e.filter("id % 15 = 0").select(
        "id", F.concat("full_name", F.lit(" (twice)")).alias("full_name"), F.lit(None).cast("string").alias("external_ref"),
        F.lit(None).cast("bigint").alias("team_leader_id"), F.lit(False).alias("is_active"), F.lit(2).alias("change_no"))
    added = e.filter("id % 25 = 1").select(
        F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("New "), F.col("id").cast("string")).alias("full_name"),
        F.lit(None).cast("string").alias("external_ref"), "team_leader_id", F.lit(True).alias("is_active"),
        F.lit(3).alias("change_no"))
    unknown = e.filter("id % 20 = 2").select(
        (F.col("id") + 5_000_000).alias("id"), "full_name", "external_ref", "team_leader_id", "is_active",
        F.lit(4).alias("change_no"))
    return renamed.unionByName(again).unionByName(added).unionByName(unknown)


def _upserted(t):
    new_id = F.element_at(F.split("full_name", " "), -1).cast("bigint") + 1_000_000
    return maintenance.upsert_employees(t.employees, _employee_changes(t), order="change_no", new_id=new_id)


@query
def employees_upsert(t):
    return _upserted(t)[0]


@query
def employees_upsert_rejects(t):
    return _upserted(t)[1]


@query
def team_leaders_upsert(t):
    leaders = t.team_leaders
    edits = leaders.filter("id % 5 = 0").select("id", F.when(F.col("id") % 15 != 0, F.concat("full_name", F.lit(" (edited)"))).alias("full_name"),
                                                F.lit(None).cast("boolean").alias("is_active"), F.lit(1).alias("change_no"))
    last = leaders.filter("id % 10 = 0 and id % 15 <> 0").select("id", F.concat("full_name", F.lit(" (last)")).alias("full_name"),
                                                                 F.lit(False).alias("is_active"), F.lit(2).alias("change_no"))
    added = leaders.filter("id % 20 = 3").select(F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("New "), F.col("id").cast("string")).alias("full_name"),
                                                 F.lit(None).cast("boolean").alias("is_active"), F.lit(3).alias("change_no"))
    new_id = F.element_at(F.split("full_name", " "), -1).cast("bigint") + 1_000_000
    return maintenance.upsert_team_leaders(leaders, edits.unionByName(last).unionByName(added), order="change_no", new_id=new_id)[0]


@query
def keywords_upsert(t):
    rules = t.part_rules
    edits = rules.filter("id % 4 = 0").select("id", F.concat(F.lit("  "), "phrase", F.lit(" x ")).alias("phrase"),
                                              F.when(F.col("id") % 8 == 0, "  ").otherwise(F.col("label")).alias("label"),
                                              F.lit(False).alias("is_active"), F.lit(1).alias("change_no"))
    refused = rules.filter("id % 9 = 1").select("id", F.lit("   ").alias("phrase"), "label", F.lit(False).alias("is_active"), F.lit(2).alias("change_no"))
    added = rules.filter("id % 10 = 7").select(F.lit(None).cast("bigint").alias("id"), F.concat(F.lit("rule "), F.col("id").cast("string")).alias("phrase"),
                                               F.lit(None).cast("string").alias("label"), F.lit(None).cast("boolean").alias("is_active"), F.lit(3).alias("change_no"))
    new_id = F.element_at(F.split("phrase", " "), -1).try_cast("bigint") + 1_000_000
    return maintenance.upsert_keywords(rules, edits.unionByName(refused).unionByName(added), order="change_no", new_id=new_id)[0]


@query
def targets_replace(t):
    changes = t.targets.filter("id % 4 = 0")
    first = changes.withColumn("target_amount", F.lit(1).cast("decimal(14,2)"))
    second = first.withColumn("id", F.col("id") + 1_000_000).withColumn(
        "target_amount", F.lit(2).cast("decimal(14,2)"))
    return maintenance.set_targets(t.targets, first.unionByName(second))[0]


@query
def delete_cascade(t):
    customers = written(t.channel_customers, "customers")
    notes = written(quality.scan_messages(t.messages, customers, t.keywords, in_place=True), "notes")
    tables = {"team_leaders": t.team_leaders, "targets": t.targets, "customers": customers, "messages": t.messages, "notes": notes}
    left = delete_many(tables, {"team_leaders": t.team_leaders.filter("id % 6 = 0"), "customers": customers.filter("id % 4 = 0")})
    parts = [left[name].select(F.lit(name).alias("table_name"), F.col("message_id" if name in ("messages", "notes") else "id").alias("row_id"))
             for name in tables]
    return reduce(DataFrame.unionByName, parts)


@query
def sales_append(t):
    stored = t.sales_records.filter("id % 3 = 0")
    return review.new_sales(t.sales_raw, stored, ["line_order", "raw"])


@query
def delete_set_null(t):
    return integrity.null_children_of(t.employees, t.team_leaders.filter("id % 6 = 0"), "team_leader_id")


@query
def validate_targets(t):
    no = F.abs("id")
    broken = t.targets.select(
        "id", F.when(no % 29 == 0, "office").otherwise(F.col("scope")).alias("scope"),
        F.when(no % 41 != 0, F.col("employee_id")).alias("employee_id"), "team_leader_id",
        F.when(no % 31 == 0, "yearly").otherwise(F.col("period_type")).alias("period_type"),
        F.when(no % 37 == 0, F.lit(-1).cast("decimal(14,2)")).otherwise(F.col("target_amount")).alias("target_amount"))
    return integrity.check_targets(broken).withColumn("reasons", F.array_join("reasons", ", "))


@query
def validate_employees(t):
    broken = (t.employees
              .withColumn("full_name", F.when(F.col("id") % 9 == 0, "  ").when(F.col("id") % 10 == 1, F.repeat("full_name", 40))
                          .otherwise(F.col("full_name")))
              .withColumn("is_active", F.when(F.col("id") % 7 != 0, F.col("is_active"))))
    return integrity.check_employees(broken).select("id", F.array_join("reasons", ", ").alias("reasons"))


@query
def validate_settings(t):
    broken = t.settings.withColumn("value", F.when(F.length("key") % 2 == 0, F.concat(F.lit("["), "value", F.lit("]")))
                                   .otherwise(F.col("value")))
    return integrity.check_settings(broken).select("key", F.array_join("reasons", ", ").alias("reasons"))


@query
def fk_orphans(t):
    return integrity.orphan_keys(t.notes, t.employees, "employee_id")
