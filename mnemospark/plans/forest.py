"""Queries over forests: entries that fork, sessions that descend from others, and what askers recall in four scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import forest as R
from mnemospark.plans.history import TERMS
from mnemospark.plans.registry import query
from mnemospark.storage import materialize

FORKED = (
    "e as (select conv_id as session, turn, conv_id || ':' || turn as entry_id, case when turn >= 2 and (conv_id + turn) % 4 = 0 then conv_id || ':' || (turn - 2) when turn >= 1 then conv_id || ':' || (turn - 1) end as parent_id, text from conversations), "
    "s as (select distinct conv_id as session, case when conv_id % 5 <> 0 then conv_id // 2 end as parent, conv_id // 8 as project from conversations)"
)
UP = "up as (select entry_id as node, entry_id as top from e union select up.node, e.parent_id from up join e on e.entry_id = up.top where e.parent_id in (select entry_id from e))"


def forked(t):
    turn, own = F.col("turn"), lambda d: F.concat_ws(":", "conv_id", F.col("turn") - d)
    parent = F.when((turn >= 2) & ((F.col("conv_id") + turn) % 4 == 0), own(2)).when(turn >= 1, own(1))
    return t.conversations.select(F.col("conv_id").alias("session"), "turn", own(0).alias("entry_id"), parent.alias("parent_id"), "text")


def families(t):
    k = F.col("conv_id")
    return t.conversations.select("conv_id").distinct().select(k.alias("session"), F.when(k % 5 != 0, F.floor(k / 2)).alias("parent"), F.floor(k / 8).alias("project"))


@query(f"with recursive {FORKED}, {UP} select top as node, count(*) - 1 as descendants from up group by 1")
def forest_labels(t):
    """How many entries descend from each, by the numbers that the walk gives: half the width of its interval."""
    rows = R.labels(forked(t).select(F.col("entry_id").alias("node"), F.col("parent_id").alias("parent")))
    return rows.select("node", F.floor((F.col("exit") - F.col("enter")) / 2).alias("descendants"))


@query(
    f"with recursive {FORKED}, {UP}, su as (select session as node, session as top from s union select su.node, s.parent from su join s on s.session = su.top where s.parent in (select session from s)), "
    f"a as (select session, max(turn) as turn, ['branch', 'session', 'lineage', 'project'][session % 4 + 1] as scope from e group by 1), q as (select a.session as asker, scope, e.entry_id as leaf, {TERMS.format('text')} as ws from a join e on e.session = a.session and e.turn = a.turn), "
    "w as (select asker, scope, leaf, unnest(list_filter(ws, lambda x, i: length(x) >= 4 and list_position(ws, x) = i)[1:8]) as term from q), "
    "re as (select asker, asker as session, 'own' as relation from q where scope in ('branch', 'session') union all select asker, top, case when top = asker then 'own' else 'lineage' end from q join su on su.node = q.asker where scope = 'lineage' "
    "union all select asker, y.session, case when y.session = asker then 'own' else 'project' end from q join s x on x.session = q.asker join s y on y.project = x.project where scope = 'project'), "
    f"en as (select q.asker, re.relation, e.session, e.entry_id, {TERMS.format('e.text')} as ws from q join re on re.asker = q.asker join e on e.session = re.session where scope <> 'branch' or exists (select 1 from up where up.node = q.leaf and up.top = e.entry_id)), "
    "z as (select asker, count(*) as n, avg(len(ws)) as a from en group by 1), p as (select en.asker, session, entry_id, relation, len(ws) as dl, w.term, len(list_filter(ws, lambda x: x = w.term)) as tf from en join w on w.asker = en.asker where list_contains(ws, w.term)), "
    "f as (select asker, term, count(*) as df from p group by 1, 2), b as (select p.asker, session, entry_id, relation, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) as score from p join f on f.asker = p.asker and f.term = p.term join z on z.asker = p.asker group by all) "
    "select *, cast(row_number() over (partition by asker order by score desc, entry_id) - 1 as int) as rank from b qualify rank < 5"
)
def scoped_recall(t):
    """What the last words of each conversation recall of their branch, their session, its lineage or its project."""
    entries = materialize(forked(t), "entries")
    last = entries.groupBy("session").agg(F.max(F.struct("turn", "entry_id", "text")).alias("last"))
    words = T.terms(F.col("last.text"))
    scope = F.element_at(F.array(*map(F.lit, ("branch", "session", "lineage", "project"))), (F.col("session") % 4 + 1).cast("int"))
    some = F.slice(F.filter(F.array_distinct(words), lambda x: F.length(x) >= 4), 1, 8)
    askers = materialize(last.select(F.col("session").alias("asker"), "session", F.col("last.entry_id").alias("leaf"), scope.alias("scope"), some.alias("terms")), "askers")
    return R.recall(entries, families(t), askers)
