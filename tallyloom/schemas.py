"""Fixed schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

BIGINT, TEXT, FLAG = T.LongType(), T.StringType(), T.BooleanType()
DATE, MOMENT = T.DateType(), T.TimestampType()
MONEY = T.DecimalType(14, 2)
TOTAL = T.DecimalType(24, 2)
PERCENT = T.DecimalType(21, 2)
LIMIT = T.DecimalType(38, 12)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


USERS = _struct(id=BIGINT, username=TEXT, email=TEXT, full_name=TEXT, role=TEXT, is_active=FLAG,
                last_login_at=MOMENT)
SESSIONS = _struct(session_id=BIGINT, user_id=BIGINT, created_at=MOMENT, expires_at=MOMENT)
TEAM_LEADERS = _struct(id=BIGINT, full_name=TEXT, user_id=BIGINT, is_active=FLAG)
EMPLOYEES = _struct(id=BIGINT, full_name=TEXT, employee_code=TEXT, external_ref=TEXT, team_leader_id=BIGINT,
                    show_in_display=FLAG, is_active=FLAG, updated_at=MOMENT)
TARGETS = _struct(id=BIGINT, scope=TEXT, employee_id=BIGINT, team_leader_id=BIGINT, period_type=TEXT,
                  target_amount=MONEY, effective_from=DATE)
ASSIGNMENTS = _struct(sale_id=BIGINT, employee_id=BIGINT, assigned_at=MOMENT)
SALES = _struct(id=BIGINT, employee_id=BIGINT, invoice_ref=TEXT, amount=MONEY, sale_date=DATE, raw=TEXT,
                synced_at=MOMENT)
TABLE_CHANGES = _struct(change_id=TEXT, tables=T.ArrayType(TEXT), state=TEXT)
SIGNED_SALES = _struct(employee_id=BIGINT, sale_date=DATE, amount=TOTAL)
SALES_LOADS = _struct(load_no=BIGINT, state=TEXT)
PERFORMANCE = _struct(scope=TEXT, employee_id=BIGINT, team_leader_id=BIGINT, period_type=TEXT, period_date=DATE,
                      achieved_amount=TOTAL, target_amount=MONEY, percentage=PERCENT, status=TEXT,
                      computed_at=MOMENT)
SETTINGS = _struct(key=TEXT, value=TEXT, updated_at=MOMENT, updated_by=BIGINT)
KEYWORDS = _struct(id=BIGINT, phrase=TEXT, label=TEXT, is_active=FLAG)
POSITION = _struct(entry_no=T.IntegerType(), change_no=T.IntegerType(), message_no=T.IntegerType())
CUSTOMER_CHANGES = _struct(channel_id=TEXT, name=TEXT,
                           name_at=_struct(received_at=MOMENT, payload_id=TEXT, position=POSITION), batch_id=BIGINT)
MESSAGES = _struct(message_id=TEXT, channel_message_id=TEXT, channel_id=TEXT, employee_id=BIGINT, direction=TEXT,
                   body=TEXT, sent_at=MOMENT, raw=TEXT, received_at=MOMENT, batch_id=BIGINT)
NOTES = _struct(message_id=TEXT, channel_id=TEXT, employee_id=BIGINT, customer_name=TEXT, message_text=TEXT,
                message_at=MOMENT, keyword_id=BIGINT, matched_phrase=TEXT, label=TEXT, batch_id=BIGINT)
REJECTS = _struct(payload_id=TEXT, payload=TEXT, reason=TEXT, received_at=MOMENT, batch_id=BIGINT)
FEED_HEALTH = _struct(last_event_at=MOMENT, connection_status=TEXT, new_messages=BIGINT, batch_id=BIGINT)
AUDIT_LOG = _struct(user_id=BIGINT, user_name=TEXT, role=TEXT, action=TEXT, entity_type=TEXT, entity_id=BIGINT,
                    details=TEXT, logged_at=MOMENT)
RUN_LOG = _struct(run_id=TEXT, started_at=MOMENT, finished_at=MOMENT, status=TEXT, records_synced=BIGINT,
                  message=TEXT, triggered_by=TEXT)

# One delivery of the chat feed. A message stays JSON text here so that its source can be stored.
CONTACT = _struct(wa_id=TEXT, profile=_struct(name=TEXT))
CHANGE = _struct(value=_struct(contacts=T.ArrayType(CONTACT), messages=T.ArrayType(TEXT)))
PAYLOAD = _struct(entry=T.ArrayType(_struct(changes=T.ArrayType(CHANGE))), malformed=TEXT)
CHAT_MESSAGE = _struct(**{"id": TEXT, "from": TEXT, "timestamp": TEXT, "type": TEXT, "text": _struct(body=TEXT),
                          "button": _struct(text=TEXT), "interactive": TEXT})
BAND_LIST = T.ArrayType(_struct(label=TEXT, min=TEXT, color=TEXT))
