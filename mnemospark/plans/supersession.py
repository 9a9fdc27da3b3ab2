"""Queries over memory of many sessions. Events stand for mutations; they refer back, forward and to themselves, so chains fork, break and close."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import supersession as S
from mnemospark.plans.registry import query

SQL = """
with recursive m as (select event_id as id, user_id % 50 as session, 'p' || user_id % 2 as project, (event_id * 37) % 1000 as created_at, case event_id % 6 when 0 then 'status' when 1 then 'add' when 2 then 'add' else 'supersede' end as op,
  case when event_id % 13 = 0 then event_id - 1 else event_id end as item, case when event_id % 8 = 0 then 'session' else 'project' end as scope,
  case when event_id % 17 = 0 then null when event_id % 19 = 0 then 'p9' else 'p' || user_id % 2 end as item_project, case when event_id % 4 <> 0 then 'k' || event_id % 400 end as key, event_type as claim,
  event_id + event_id % 7 - 4 as previous, event_id + event_id % 5 - 3 as target, case event_id % 5 when 0 then 'active' when 1 then 'expired' else 'invalid' end as st from events),
o as (select *, row_number() over (order by created_at, session, id) rn, not (session % 11 = 0 or session % 7 in (0, 1)) or (session % 5 = 4 and session % 11 <> 0) as enabled from m),
tried as (select * from o where op <> 'status' and not (scope = 'project' and not enabled)),
it as (select * from tried where scope <> 'project' or coalesce(item_project = project, false) qualify row_number() over (partition by item order by rn) = 1),
w1 as (select case when a.rn > it.rn and (a.claim <> it.claim or a.scope <> it.scope) then 'id-collision' when (it.rn is null or a.rn < it.rn) and a.scope = 'project' and a.item_project is null then 'no-project'
  when (it.rn is null or a.rn < it.rn) and a.scope = 'project' and a.item_project <> a.project then 'other-project' end as kind, a.id as mutation_id, a.item from tried a left join it on a.item = it.item),
ev as (select id, rn, op, session, project, enabled, created_at, target, st, cast(null as bigint) as by_item from o where op = 'status' union all select id, rn, op, session, project, enabled, created_at, previous, 'superseded', item from tried where op = 'supersede'),
j as (select ev.*, case when t.item is null then 'missing-target' when ev.op = 'supersede' and not coalesce(r.id = ev.id, false) then 'no-replacement' when ev.op = 'supersede' and t.scope <> r.scope then 'crosses-scope'
    when not case when t.scope = 'session' then t.session = ev.session else coalesce(t.item_project = ev.project, false) end then 'crosses-scope' end as fault
  from ev left join it t on ev.target = t.item left join it r on ev.op = 'supersede' and ev.by_item = r.item where not (ev.op = 'status' and not ev.enabled and (t.item is null or t.scope = 'project'))),
la as (select target, arg_max(st, rn) as st, max(rn) as rn, arg_max(created_at, rn) as upd from j where fault is null group by 1),
lb as (select la.*, j.by_item from la join j on la.rn = j.rn),
f as (select it.item, it.scope, it.session, it.item_project as project, it.key, it.claim, coalesce(lb.st, 'active') as status, lb.by_item, coalesce(lb.upd, it.created_at) as updated_at, it.rn, it.id from it left join lb on it.item = lb.target),
g as (select *, status = 'active' and key is not null and row_number() over (partition by scope, case when scope = 'session' then session end, project, key, status order by rn) > 1 as clash from f),
walk as (select item as start, by_item as node from g where by_item is not null union select start, by_item from walk join g on g.item = walk.node where by_item is not null),
fin as (select start, node from walk join g on g.item = walk.node where g.by_item is null)
"""


def mutations(t):
    e, user = F.col("event_id"), F.col("user_id")
    project = F.concat(F.lit("p"), user % 2)
    name = lambda c: F.concat(F.lit("m"), c)
    return t.events.select(
        e.alias("mutation_id"), (user % 50).alias("session"), project.alias("project"), ((e * 37) % 1000).alias("created_at"), F.lit(0).alias("nth"),
        F.when(e % 6 == 0, "status").when((e % 6).isin(1, 2), "add").otherwise("supersede").alias("op"), name(F.when(e % 13 == 0, e - 1).otherwise(e)).alias("item_id"),
        F.when(e % 8 == 0, "session").otherwise("project").alias("scope"), F.when(e % 17 == 0, None).when(e % 19 == 0, "p9").otherwise(project).alias("item_project"),
        F.when(e % 4 != 0, F.concat(F.lit("k"), e % 400)).alias("key"), F.col("event_type").alias("claim"), name(e + e % 7 - 4).alias("previous_id"), name(e + e % 5 - 3).alias("target_id"),
        F.when(e % 5 == 0, "active").when(e % 5 == 1, "expired").otherwise("invalid").alias("status"),
    )


def sources(t):
    """Some are excluded, some missing or corrupt, some not known."""
    s = F.col("session")
    rows = t.events.select((F.col("user_id") % 50).alias("session")).distinct().where((s % 5 != 4) | (s % 11 == 0))
    return rows.select("session", F.when(s % 7 == 0, "missing").when(s % 7 == 1, "corrupt").otherwise("ready").alias("status"), (s % 11 == 0).alias("excluded"))


@query(
    SQL + "select 'm' || g.item as item_id, scope, session, project, key, claim, case when clash then 'invalid' else status end as status, 'm' || by_item as superseded_by, "
    "'m' || case when by_item is null then g.item else fin.node end as current, by_item is not null and fin.node is null as cyclic, updated_at from g left join fin on fin.start = g.item"
)
def memory_supersession(t):
    """What each item of all sessions is, and where the chain of its replacements ends."""
    return S.materialized(mutations(t), sources(t))[0]


@query(
    SQL + "select kind, mutation_id, 'm' || item as item_id from w1 where kind is not null union all select fault, id, 'm' || target from j where fault is not null union all select 'key-conflict', id, 'm' || item from g where clash"
)
def memory_warnings(t):
    """Mutations that are not in force, and why."""
    return S.materialized(mutations(t), sources(t))[1]
