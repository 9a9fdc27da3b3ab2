"""Queries over a runtime's history with planted faults: conversations stand for snapshots, their turns for messages, calls and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import snapshots as S
from mnemospark.plans.registry import query

SQL = """
with recursive b as (select conv_id as c, turn as t, (conv_id + turn) as x from conversations),
sn as (select distinct conv_id as session, case when conv_id % 31 = 0 then 2 else 1 end as ver, case when conv_id % 37 = 0 then ' ' else 'r' end as runtime, 's' || conv_id as sid, case when conv_id % 41 = 0 then '' else '/w' end as root from conversations),
ms as (select c as session, t as position, case when x % 17 = 0 then '' when x % 19 = 0 then 'm' || c || ':' || (t - 1) else 'm' || c || ':' || t end as message_id, 'e' || t as source_entry, case when x % 3 = 0 then 'import' else 'runtime-session' end as origin,
  case when x % 43 = 0 then 'q' else 'r' end as origin_runtime, case when x % 47 = 0 then 's' else 's' || c end as origin_session, case when x % 53 = 0 then 'e' else 'e' || t end as origin_entry,
  case when t % 2 = 1 then list_concat(['k' || (t // 2)], list_concat(case when x % 7 = 0 then ['k' || (t // 2 - 1)] else [] end, case when x % 23 = 0 then [''] else [] end)) else [] end as calls,
  case when t % 2 = 0 and t > 0 then list_concat(['k' || (t // 2 - 1)], case when x % 11 = 0 then ['zz'] else [] end) else [] end as results from b),
gr as (select c as session, t as place, case when x % 29 = 0 then ' ' else 'g' || t end as group_id, x % 13 <> 0 as complete,
  list_concat(['m' || c || ':' || t], list_concat(case when x % 5 = 0 then [] else ['m' || c || ':' || (t + 1)] end, list_concat(case when x % 8 = 0 then ['ghost'] else [] end, case when x % 12 = 0 then ['m' || c || ':' || (t - 1)] else [] end))) as message_ids,
  list_concat(['k' || (t // 2)], list_concat(case when x % 9 = 0 then ['yy'] else [] end, case when x % 6 = 0 then ['k0'] else [] end)) as call_ids from b where t % 2 = 1 and x % 10 <> 0),
us as (select session, position, message_id, unnest(calls) as call_id, true as called from ms union all select session, position, message_id, unnest(results), false from ms),
bc as (select session, call_id, count(*) filter (where called) as nc, count(*) filter (where not called) as nr from us group by 1, 2),
lk as (select distinct p.session, p.position as a, q.position as z from us p join us q on p.session = q.session and p.call_id = q.call_id join bc on bc.session = p.session and bc.call_id = p.call_id where nc > 0),
re as (select distinct session, position as a, position as z from us union select re.session, re.a, lk.z from re join lk on re.session = lk.session and re.z = lk.a),
ro as (select session, a as position, min(z) as root from re group by 1, 2),
eg as (select ro.session, root, string_agg(message_id, '|' order by message_id) as members from ro join ms on ms.session = ro.session and ms.position = ro.position group by 1, 2),
ig as (select distinct us.session, root, call_id from us join ro on ro.session = us.session and ro.position = us.position),
wh as (select ig.session, root, bool_and(nc = 1 and nr > 0) as complete from ig join bc on bc.session = ig.session and bc.call_id = ig.call_id group by 1, 2),
ids as (select session, message_id, count(*) as n from ms group by 1, 2),
nm as (select session, unnest(message_ids) as message_id from gr), cl as (select session, place, unnest(call_ids) as call_id from gr),
tk as (select session, call_id, count(*) as n, max(place) as place from cl group by 1, 2),
ac as (select tk.session, call_id, complete, (select string_agg(y, '|' order by y) from unnest(message_ids) u(y)) as members from tk join gr on gr.session = tk.session and gr.place = tk.place),
bo as (select ig.session, ig.call_id, eg.members = ac.members and wh.complete = ac.complete as same, ac.session is not null as there from ig join eg on eg.session = ig.session and eg.root = ig.root join wh on wh.session = ig.session and wh.root = ig.root left join ac on ac.session = ig.session and ac.call_id = ig.call_id),
al as (select session, 'history-schema-incompatible' as code, null as message_id, null as call_id, 1 as n from sn where ver <> 1
union all select session, 'history-identity-invalid', null, null, 1 from sn where trim(runtime) = '' union all select session, 'trusted-project-root-missing', null, null, 1 from sn where root = ''
union all select session, 'history-message-id-duplicate', message_id, null, n - 1 from ids where n > 1 union all select session, 'history-message-id-missing', message_id, null, 1 from ids where message_id = ''
union all select ms.session, 'history-provenance-invalid', message_id, null, 1 from ms join sn on sn.session = ms.session where origin_session <> sid or source_entry <> origin_entry or (origin = 'runtime-session' and origin_runtime <> runtime)
union all select session, 'tool-call-identity-invalid', null, call_id, 1 from bc where nc > 0 and (call_id = '' or nc <> 1) union all select session, 'tool-result-orphaned', null, call_id, 1 from bc where nr > 0 and (call_id = '' or nc = 0)
union all select session, 'tool-atomic-group-invalid', null, null, 1 from gr where trim(group_id) = ''
union all select nm.session, 'tool-atomic-message-missing', nm.message_id, null, 1 from nm left join ids on ids.session = nm.session and ids.message_id = nm.message_id where ids.session is null
union all select nm.session, 'tool-atomic-message-overlap', nm.message_id, null, count(*) - 1 from nm join ids on ids.session = nm.session and ids.message_id = nm.message_id group by 1, 3 having count(*) > 1
union all select session, 'tool-atomic-call-overlap', null, call_id, n - 1 from tk where n > 1
union all select session, 'tool-atomic-group-missing', null, call_id, 1 from bo where not there union all select session, 'tool-atomic-group-mismatch', null, call_id, 1 from bo where there and not same
union all select tk.session, 'tool-atomic-call-unknown', null, tk.call_id, 1 from tk left join bc on bc.session = tk.session and bc.call_id = tk.call_id where bc.session is null)
select session, code, message_id, call_id, cast(sum(n) as bigint) as n from al group by all
"""


def planted(t):
    rows = t.conversations.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), (F.col("conv_id") + F.col("turn")).alias("x"))
    at = lambda d: f"concat('m', c, ':', t + {d})"
    some = lambda *parts: "filter(array(" + ", ".join(parts) + "), v -> v is not null)"
    snapshots = t.conversations.select("conv_id").distinct().selectExpr(
        "conv_id as session", "if(conv_id % 31 = 0, 2, 1) as schema_version", "if(conv_id % 37 = 0, ' ', 'r') as runtime_id", "concat('s', conv_id) as session_id", "'v' as revision", "if(conv_id % 41 = 0, '', '/w') as project_root"
    )
    messages = rows.selectExpr(
        "c as session", "t as position", f"case when x % 17 = 0 then '' when x % 19 = 0 then {at(-1)} else {at(0)} end as message_id", "concat('e', t) as source_entry", "if(x % 3 = 0, 'import', 'runtime-session') as origin",
        "if(x % 43 = 0, 'q', 'r') as origin_runtime", "if(x % 47 = 0, 's', concat('s', c)) as origin_session", "if(x % 53 = 0, 'e', concat('e', t)) as origin_entry",
        "if(t % 2 = 1, " + some("concat('k', t div 2)", "if(x % 7 = 0, concat('k', t div 2 - 1), null)", "if(x % 23 = 0, '', null)") + ", cast(array() as array<string>)) as calls",
        "if(t % 2 = 0 and t > 0, " + some("concat('k', t div 2 - 1)", "if(x % 11 = 0, 'zz', null)") + ", cast(array() as array<string>)) as results",
    )
    declared = rows.where("t % 2 = 1 and x % 10 != 0").selectExpr(
        "c as session", "t as place", "if(x % 29 = 0, ' ', concat('g', t)) as group_id", "x % 13 != 0 as complete", some(at(0), f"if(x % 5 = 0, null, {at(1)})", "if(x % 8 = 0, 'ghost', null)", f"if(x % 12 = 0, {at(-1)}, null)") + " as message_ids",
        some("concat('k', t div 2)", "if(x % 9 = 0, 'yy', null)", "if(x % 6 = 0, 'k0', null)") + " as call_ids",
    )
    return snapshots, messages, declared


@query(SQL)
def history_issues(t):
    """What is wrong with each snapshot: all fifteen kinds of faults are planted."""
    return S.issues(*planted(t))
