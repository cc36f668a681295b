"""The engine's tables, derived from a folder of order, supplier, event and conversation tables.

Each view is one SQL text that Spark and DuckDB both run; ``[name]`` stands for a base table.
"""

from __future__ import annotations

import re
import zlib
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SALES_AS_OF = date(2000, 6, 1)
NOTES_AS_OF = date(2024, 1, 20)
BANDS_JSON = ('[{"label":"excellent","min":100},{"label":"very good","min":82.5},{"label":"good","min":61.125},'
              '{"label":"follow up","min":37.5},{"label":"weak","min":0}]')

_LINES = """
select l_orderkey * 10 + l_linenumber as id,
       case when l_orderkey % 40 <> 0 then 'INV-' || cast(l_orderkey * 10 + l_linenumber as string) end as invoice_ref,
       case when l_partkey % 25 <> 0 then l_suppkey end as employee_id,
       cast(l_extendedprice as decimal(14,2)) as amount, cast(l_shipdate as date) as sale_date,
       '{"reference":"R' || cast(l_partkey as string) || '","notes":"' || l_returnflag || ' ' || l_linestatus || '"}' as raw,
       cast(cast(l_shipdate as date) as string) || '/' || cast(l_partkey as string) || '/' || cast(l_suppkey as string)
         || '/' || cast(cast(l_extendedprice as decimal(14,2)) as string) as line_order
from [lineitem]"""



def _targets() -> str:
    """Targets of suppliers as employees and customers as team leaders for the three periods, some zero and some missing."""
    parts = []
    for no, (kind, share) in enumerate((("daily", 20), ("weekly", 4), ("monthly", 1)), start=1):
        parts.append(f"""
select s_suppkey * 10 + {no} as id, 'employee' as scope, s_suppkey as employee_id,
       cast(null as bigint) as team_leader_id, '{kind}' as period_type,
       cast(case when s_suppkey % 13 = 0 then 0 else (300000 + (s_suppkey % 17) * 10000) / {share} end as decimal(14,2)) as target_amount
from [supplier] where s_suppkey % 11 <> 4
union all
select -10 * c_custkey - {no}, 'team_leader', cast(null as bigint), c_custkey, '{kind}',
       cast(case when c_custkey % 13 = 5 then 0 else (1200000 + (c_custkey % 25) * 25000) / {share} end as decimal(14,2))
from [customer] where c_custkey % 11 <> 4""")
    return "\nunion all".join(parts)


def _delivery(no: int, condition: str) -> str:
    """One delivery of the conversations as feed rows; names change from message to message."""
    return f"""
select 'd{no}-' || cast(conv_id as string) || '-' || cast(turn as string) as payload_id,
       cast(turn as bigint) as position, {no} as delivery,
       case when conv_id % 20 <> 0 then cast(conv_id as string) || '-' || cast(turn as string) end as channel_message_id,
       'ch' || cast(conv_id % 60 as string) as channel_id,
       case when (conv_id + turn + {no}) % 3 <> 0
            then 'Client ' || cast(conv_id as string) || ' v' || cast(turn + {no} as string) end as customer_name,
       text as body,
       timestamp '2024-01-01 00:00:00' + interval '1' second * cast(conv_id * 20 + turn + {no * 7} as int) as received_at
from [conversations] where {condition}"""


VIEWS = {
    "team_leaders": """
select c_custkey as id, c_name as full_name, case when c_custkey % 5 <> 0 then c_custkey + 100 end as user_id,
       c_custkey % 7 <> 3 as is_active
from [customer]""",
    "employees": """
select s_suppkey as id, 'Employee ' || cast(s_suppkey % 90 as string) as full_name,
       case when s_suppkey % 4 = 0 then ' Ref ' || cast(s_suppkey as string) || ' '
            when s_suppkey % 4 = 1 then '  ' end as external_ref,
       case when s_suppkey % 10 <> 9 then cast(s_nationkey as bigint) end as team_leader_id,
       s_suppkey % 6 <> 5 as show_in_display, s_suppkey % 8 <> 7 as is_active
from [supplier]""",
    "sales_lines": """
select case when l_partkey % 25 <> 0 then l_suppkey end as employee_id,
       cast(l_extendedprice as decimal(14,2)) as amount, cast(l_shipdate as date) as sale_date
from [lineitem]""",
    "sales_raw": _LINES,
    "sales_records": f"""
select id, 'INV-' || cast(id as string) as invoice_ref, employee_id, amount, sale_date, raw from (
  select a.*, row_number() over (partition by id order by line_order, raw) as rn from ({_LINES}) a) b
where rn = 1""",
    "targets": _targets(),
    "channel_customers": """
select distinct conv_id as id, 'ch' || cast(conv_id as string) as channel_id,
       case when conv_id % 3 <> 0 then 'Client ' || cast(conv_id as string) end as name
from [conversations]""",
    "messages": """
select conv_id * 1000 + turn as message_id,
       case when conv_id % 20 <> 0 then cast(conv_id as string) || '-' || cast(turn as string) end as channel_message_id,
       conv_id as customer_id, cast(null as bigint) as employee_id,
       case when role = 'user' then 'inbound' else 'outbound' end as direction, text as body,
       timestamp '2024-01-01 00:00:00' + interval '1' minute * cast(conv_id * 10 + turn as int) as sent_at
from [conversations]""",
    "keywords": """
select * from (values
  (cast(1 as bigint), 'of the', 'common', true), (2, 'is the', 'verb', true), (3, 'die und', 'german', true),
  (4, 'the and', 'off', false), (5, ' <b>THE</b>  THAT ', 'markup', true), (6, 'es la', 'common', true)
) k(id, phrase, label, is_active)""",
    "part_rules": """
select p_partkey as id, p_name as phrase, p_type as label, p_size % 5 <> 0 as is_active from [part]""",
    "passage_rules": """
select item_id as id, text as phrase, 'passage ' || cast(item_id % 3 as string) as label,
       item_id % 10 <> 9 as is_active
from [benchmark]""",
    "people": """
select id, name as full_name, cast(null as string) as external_ref, true as is_active from (values
  (cast(1 as bigint), 'The That'), (2, 'Und x Der'), (3, 'Los'), (4, 'that <i>the</i>'), (5, 'a Pour')
) p(id, name)""",
    "authors": """
select item_id as id, text as full_name, cast(null as string) as external_ref, item_id % 9 <> 0 as is_active
from [benchmark]""",
    "notes": """
select event_id as id, case when user_id % 5 <> 0 then user_id end as employee_id,
       'Customer ' || cast(user_id % 7 as string) as customer_name,
       event_type || ' ' || props as message_text,
       case when event_id % 50 <> 0 then ts end as message_at,
       case when event_type <> 'error' then event_type end as label, event_type as phrase
from [events]""",
    "users": """
select c_custkey as id, c_name as full_name,
       case when c_custkey % 50 = 0 then 'admin' when c_custkey % 10 = 0 then 'manager' else 'team_leader' end as role,
       c_custkey % 9 <> 4 as is_active
from [customer]""",
    "sessions": """
select event_id as session_id, user_id, ts as created_at, ts + interval '7' day as expires_at
from [events]""",
    "settings": """
select 'team-' || cast(c_custkey as string) as key,
       '{' || case when c_custkey % 4 <> 0 then '"system_name":"Board ' || cast(c_custkey as string) || '",' else '' end
           || case when c_custkey % 3 <> 0 then '"refresh_seconds":' || cast(c_custkey % 60 as string) || ',' else '' end
           || '"status_thresholds":[{"label":"' || c_mktsegment || '","min":' || cast(c_custkey % 100 + 1 as string)
           || ',"color":"#16a34a"},{"label":"base","min":0,"color":"#ef4444"}]}' as value
from [customer]""",
    "deliveries": _delivery(1, "true") + "\nunion all" + _delivery(2, "conv_id % 7 = 0"),
}


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A base table; its schema is read from the files once."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    def registered(match: re.Match) -> str:
        temporary = f"sample_{match[1]}_{zlib.crc32(folder.encode())}"
        table(spark, folder, match[1]).createOrReplaceTempView(temporary)
        return temporary

    return spark.sql(re.sub(r"\[(\w+)\]", registered, VIEWS[name]))


def duckdb_views(*names: str) -> str:
    """The views as the head of a DuckDB query."""
    texts = [f"{name} as ({re.sub(r'\[(\w+)\]', r'\1', VIEWS[name])})" for name in names]
    return "with " + ",\n".join(texts)

