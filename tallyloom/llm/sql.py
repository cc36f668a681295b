"""DuckDB counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

from tallyloom.llm import chat, license_scan

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_PLAIN = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _lower(text: str) -> str:
    return f"translate({text}, {_UPPER}, {_LOWER})"


_URL = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
_OP1 = f"""
with u as (
  select page_id, {_lower(f"coalesce(regexp_extract(url, {_URL}, 1), '')")} as host,
         coalesce(regexp_extract(url, {_URL}, 2), '') as path from pages),
r(h, p, action) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                           ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hosts as (select distinct host, path from u),
best as (
  select host, path, max_by(h || p, length(h || p)) as rule, max_by(action, length(h || p)) as verdict
  from hosts join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by host, path)
select page_id, u.host, u.path, rule, coalesce(verdict, 'allow') as verdict
from u left join best on u.host = best.host and u.path = best.path
"""


def _phrase(phrase: str) -> str:
    words = phrase.split()
    test = " and ".join(f"w[i + {n}] = '{word}'" for n, word in enumerate(words))
    return f"list_filter(range(1, len(w) + 1), lambda i: coalesce({test}, false))"


def _op3() -> str:
    places = [f"list_transform({_phrase(p)}, lambda i: {{'at': i - 1, 'label': '{label}'}})" for p, label in license_scan.PHRASES.items()]
    step = license_scan.BLOCK_WORDS // 2
    templates = ", ".join(f"('{name}', '{name.split('/')[0]}', {sorted(set(text.split()))}, ' {license_scan.TELLING.get(name, '')} ')"
                          for name, text in license_scan.NOTICES.items())
    return f"""
with d as (
  select row_number() over () as k, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_PLAIN}) as w from documents),
base as (select k, doc_id, len(w) as n_words, list_concat({", ".join(places)}) as places from d),
blocks as (
  select k, list_distinct(w[b * {step} + 1 : b * {step} + {license_scan.BLOCK_WORDS}]) as part,
         ' ' || array_to_string(w[b * {step} + 1 : b * {step} + {license_scan.BLOCK_WORDS}], ' ') || ' ' as spaced
  from d, unnest(range(0, len(w) // {step} + 1)) t(b)),
hits as (
  select k, label, len(list_intersect(part, words)) / len(words) as share
  from blocks, (values {templates}) t(name, label, words, told)
  where (told = '  ' or contains(spaced, told)) and 100 * len(list_intersect(part, words)) >= {license_scan.PERCENT} * len(words)),
m as (select k, list(distinct label) as method, max(share) as share from hits group by k)
select doc_id, n_words, cast(len(places) as bigint) as n_base,
       list_min(list_transform(places, lambda p: p.at)) as first_word, list_max(list_transform(places, lambda p: p.at)) as last_word,
       coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: p.label), coalesce(method, [])))), ','), '') as labels,
       case when len(places) > 0 then 1.0 else coalesce(share, 0) end::double as score
from base left join m using (k)
"""


def _op4() -> str:
    words = r"'[^\x20\x09-\x0D]+'"
    return f"""
with recursive
d as (select row_number() over () as k, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {words}) as w from documents),
s as (select distinct k, array_to_string(w[i : i + 3], ' ') as x from d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) where len(w) > 0),
n as (select k, count(*) as size from s group by k),
shared as (select x from s group by x having count(*) > 1),
c as (select k, x from s join shared using (x)),
links as (
  select a.k as a, b.k as b
  from c a join c b on a.x = b.x and a.k < b.k join n na on na.k = a.k join n nb on nb.k = b.k
  group by a.k, b.k, na.size, nb.size
  having 100 * count(*) >= 85 * (na.size + nb.size - count(*))),
both_ways as (select a, b from links union select b, a from links),
reach(k, r) as (select k, k from d union select reach.k, both_ways.b from reach join both_ways on both_ways.a = reach.r),
least_id as (select reach.k, min(o.doc_id) as component_id from reach join d o on o.k = reach.r group by reach.k)
select doc_id, coalesce(size, 0) as n_shingles, component_id from d join least_id using (k) left join n using (k)
"""


def _either_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


def _op5() -> str:
    keys = "|".join(_either_case(k) for k in ("password", "passwd", "secret", "token", "api_?key"))
    mark = "[A-Z0-9 ]*PRIVATE KEY( BLOCK)?-----"
    kinds = [
        ("assign", rf"""({keys})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]+", 0, 32),
        ("pem", f"-----BEGIN {mark}([^-]*(-{{1,4}}[^-]+)*-----END {mark})?", 0, 1),
        ("hosttoken", "gh[oprsu]_[A-Za-z0-9]{36}", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ]
    parts = " union all ".join(f"""
select k, {rank} as rank, '{kind}' as kind, i, len(m[i]) as width,
       cast(list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) as bigint) as start
from (select k, t, regexp_extract_all(t, '{pattern}') as m, regexp_extract_all(t, '{pattern}', {group}) as c,
             string_split_regex(t, '{pattern}') as g from d), unnest(range(1, len(m) + 1)) u(i)
where len(c[i]) >= {shortest}""" for rank, (kind, pattern, group, shortest) in enumerate(kinds))
    return f"""
with d as (select row_number() over () as k, doc_id, coalesce(text, '') as t from documents),
s as ({parts}),
a as (
  select k, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access, count(*) filter (rank = 2) as n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || (start + width), ',' order by start, rank) filter (rank < 3), '') as base,
         string_agg(kind || ':' || start || ':' || (start + width), ',' order by start, rank) as spans
  from s group by k)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join a using (k)
"""


_OP6 = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
q as (select page_id, octet_length(payload) as n, sha256(payload) as digest from p),
f as (select *, case when n >= 100 then min(page_id) over (partition by digest, n >= 100) end as first_id from q)
select page_id, n as payload_bytes, digest as payload_digest,
       case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
       case when first_id is not null and page_id is distinct from first_id then first_id end as refers_to
from f
"""


def _op7() -> str:
    control = r"'([<\[])(\\*)(/?s>|/?INST\]|<SYS>>|/?ROLE\])'"
    headers = {"user": chat.USER, "assistant": chat.ASSISTANT, "system": chat.SYSTEM}
    cases = " ".join(f"when '{role}' then {len(header)}" for role, header in headers.items())
    escaped = lambda x: rf"length(regexp_replace({x}, {control}, '\1\\\2\3', 'g'))"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum({len(chat.OPEN) + len(chat.CLOSE)} + {escaped("text")}
                + case role {cases} else {len(chat.ROLE_OPEN) + len(chat.ROLE_CLOSE)} + {escaped("role")} end) as bigint) as formatted_chars
from c group by conv_id
"""


def _op9() -> str:
    return f"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_PLAIN}) as w from documents),
b as (select item_id, regexp_extract_all({_lower("coalesce(text, '')")}, {_PLAIN}) as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as x
  from b, unnest(range(1, len(w) - least(len(w), 13) + 2)) t(i) where len(w) > 0),
lengths as (select distinct m from win),
hit as (
  select k, i, m, array_to_string(w[i:i + m - 1], ' ') as x
  from d, lengths, unnest(range(1, len(w) - m + 2)) t(i)),
met as (select k, i, m, item_id from hit join win using (m, x)),
n as (select k, count(distinct j) as n_hit from met, unnest(range(i, i + m)) t(j) group by k),
items as (select k, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from met group by k)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(w) as contaminated
from d left join n using (k) left join items using (k)
"""


# CRC-32 of a list of bytes, by the usual table of 256 entries.
_CRC = """
crc_steps(i, x, k) as (
  select range, range::bigint, 0 from range(256)
  union all
  select i, case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, k + 1 from crc_steps where k < 8),
crc as (select list(x order by i) as t from crc_steps where k = 8)"""


def _bytes(text: str) -> str:
    """UTF-8 of a text whose code points are below 2048."""
    wide = "[192 + unicode(c) // 64, 128 + unicode(c) % 64]"
    return f"flatten(list_transform(string_split({text}, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else {wide} end))"


def _crc32(text: str, table: str = "t") -> str:
    folded = f"list_reduce({_bytes(text)}, lambda a, b: xor(a // 256, {table}[xor(a, b) % 256 + 1]), 4294967295::bigint)"
    return f"xor({folded}, 4294967295)"


def _op11() -> str:
    turned = "case when state = 2 then 3 else 2 end"
    role = "case when state = 2 then 'assistant' else 'user' end"
    return f"""
with recursive {_CRC},
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
                 coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
hashed as (select n.*, {_crc32("name")} % 20 as h from named n, crc),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
         case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, unnest(range(case when h = 3 then 2 else 1 end)) where h <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n from damaged),
judged as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank'
                 when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate'
                 when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else 'none' end as fault,
         lag(role) over (partition by conv_id order by n) as before
  from numbered),
ids as (select distinct conv_id, dense_rank() over (order by conv_id nulls first) as k from named),
todo as (select k, n, role, text, fault from judged j join ids on j.conv_id is not distinct from ids.conv_id),
last_row as (select k, max(n) as last_n from todo group by k),
-- one row per conversation, row and state: the cheapest edits so far, with what they write
walk(k, n, state, best) as (
  select k, 0::bigint, 0, {{'cost': 0, 'audit': '', 'out': []::varchar[]}} from last_row
  union all
  select k, n, state, min(best) from (
    with opened as (
      select k, n, state, best.cost as cost, best.audit as audit, best.out as out from walk),
    once as (
      select * from opened union all
      select k, n, {turned}, cost + 3, audit || 'I', list_append(out, {role} || ':') from opened),
    often as (
      select * from once union all
      select k, n, {turned}, cost + 3, audit || 'I', list_append(out, {role} || ':') from once where state = 2)
    select o.k, o.n + 1 as n, state, {{'cost': cost + 4, 'audit': audit || 'D', 'out': out}} as best
    from often o join todo t on t.k = o.k and t.n = o.n + 1
    union all
    select o.k, o.n + 1, {turned}, {{'cost': cost + 3 + case when fault = 'truncated' then 3 else 0 end, 'audit': audit || 'R',
                                   'out': list_append(out, {role} || ':' || text)}}
    from often o join todo t on t.k = o.k and t.n = o.n + 1 where fault not in ('blank', 'duplicate')
    union all
    select o.k, o.n + 1, case left(role, 1) when 's' then 1 when 'u' then 2 else 3 end,
           {{'cost': cost + case when fault = 'truncated' then 3 else 0 end, 'audit': audit || 'K', 'out': list_append(out, role || ':' || text)}}
    from often o join todo t on t.k = o.k and t.n = o.n + 1
    where fault not in ('blank', 'duplicate')
      and ((left(role, 1) = 's' and state = 0) or (left(role, 1) = 'u' and state <> 2) or (left(role, 1) = 'a' and state = 2)))
  group by k, n, state),
ended as (
  select k, min({{'cost': best.cost + 3 * extra, 'audit': best.audit || repeat('I', extra),
                 'out': list_concat(best.out, ['user:', 'assistant:'][3 - extra:])}}) as best
  from (select w.*, case state when 1 then 2 when 2 then 1 else 0 end as extra from walk w join last_row l on l.k = w.k and l.last_n = w.n)
  group by k),
counted as (
  select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id)
select i.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
       coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.out, chr(10)), '')) as repaired_sha256
from ids i left join ended e on e.k = i.k left join counted c on c.conv_id is not distinct from i.conv_id
"""


def _op12() -> str:
    return f"""
with recursive {_CRC},
runs as (
  select doc_id, run, count(*) as m
  from (select doc_id, unnest(regexp_extract_all({_lower("text")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents) group by all),
hashed as (select run, m, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs, crc where length(run) >= 7),
made as (select case when h % 31 = 0 then run[1 : h % length(run)] || run[h % length(run) + 2 :] else run end as word, m from hashed),
v as (select word, sum(m)::bigint as n from made where length(word) >= 7 group by word having sum(m) >= 2),
shorter as (select word, n, i, word[1 : i - 1] || word[i + 1 :] as rest from v, unnest(range(1, length(word) + 1)) t(i)),
pairs as (
  select a.word, a.n, b.word as other, b.n as other_n from shorter a join shorter b using (i, rest) where a.word <> b.word
  union
  select s.word, s.n, v.word, v.n from shorter s join v on v.word = s.rest
  union
  select v.word, v.n, s.word, s.n from shorter s join v on v.word = s.rest),
near as (select word, count(*) as n_near, min({{'m': -other_n, 'other': other}}) as best from pairs group by word),
judged as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when -best.m >= 10 * v.n then best.other end as form,
         case when -best.m >= 10 * v.n then -best.m end as form_n
  from v left join near on near.word = v.word),
chains(word, root, steps) as (
  select word, word, 0 from judged
  union all
  select c.word, j.form, steps + 1 from chains c join judged j on j.word = c.root where j.form is not null),
roots as (select word, max_by(root, steps) as root from chains group by word)
select word, n, n_near, form, form_n, root from judged join roots using (word)
"""


ORACLE = {"op1_url_filter": _OP1, "op3_license_scan": _op3(), "op4_ngram_join": _op4(), "op5_secret_scan": _op5(), "op6_warc": _OP6,
          "op7_chat_format": _op7(),
          "op9_decontamination": _op9(),
          "op11_conversation_repair": _op11(), "op12_spelling_variants": _op12()}
