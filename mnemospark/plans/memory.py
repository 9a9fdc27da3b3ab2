"""Queries over memories, groups and plans. Customers' claims stand for memories, benchmark passages for requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import context as X
from mnemospark.operators import history as H
from mnemospark.operators import memory as Y
from mnemospark.operators import planning as G
from mnemospark.plans.context import DESCRIBED
from mnemospark.plans.context import said as said_requests
from mnemospark.plans.history import ENTRIES
from mnemospark.plans.registry import query
from mnemospark.plans.state import FACTS, claims

SLUG = "regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}._/-]+', '-', 'g'), '^-+|-+$', '', 'g')"

MEMORIES = (
    f"{FACTS}, me as (select session, id, case when id % 2 = 0 then 'session' else 'project' end scope, key, claim, id * 7 % 1000 created_at, cast(8 + ceil(length(claim) / 4.0) as bigint) tokens from fc), "
    "rq as (select item_id session, list_transform(list_concat(terms, case item_id % 4 when 0 then ['machinery', 'cache'] when 1 then ['BUILDING limit'] when 2 then ['household'] else [] end), lambda x: lower(x)) ts from ds), "
    f"sc as (select me.*, 30 + case when scope = 'session' then 8 else 4 end + case when coalesce(key <> '' and len(list_filter(ts, lambda x: contains(key, {SLUG.format('x')}))) > 0, false) then 45 else 0 end + least(60, 12 * len(list_filter(ts, lambda x: contains(lower(claim), x)))) score, "
    f"coalesce(key <> '' and len(list_filter(ts, lambda x: contains(key, {SLUG.format('x')}))) > 0, false) or len(list_filter(ts, lambda x: contains(lower(claim), x))) > 0 hit from me join rq using (session))"
)


def memories(t):
    c, k = F.col("claim"), F.col("id")
    return claims(t).select("session", "id", F.when(k % 2 == 0, "session").otherwise("project").alias("scope"), T.derived_key(c).alias("key"), "claim", (k * 7 % 1000).alias("created_at"), (8 + F.ceil(F.length(c) / 4)).cast("long").alias("tokens"))


def asking(t):
    more = F.element_at(F.array(F.array(F.lit("machinery"), F.lit("cache")), F.array(F.lit("BUILDING limit")), F.array(F.lit("household")), F.array().cast("array<string>")), (F.col("item_id") % 4 + 1).cast("int"))
    return X.described(said_requests(t)).select(F.col("item_id").alias("session"), F.concat("terms", more).alias("terms"))


@query(f"with {DESCRIBED}, {MEMORIES} select session, id, cast(score as int) score, hit matched from sc")
def memory_scores(t):
    return Y.scored(memories(t), asking(t)).select("session", "id", F.col("score").cast("int").alias("score"), "matched")


@query(
    f"with recursive {DESCRIBED}, {MEMORIES}, an as (select *, bool_or(hit) over (partition by session) any_hit, row_number() over (partition by session order by score desc, created_at desc, id) r0 from sc), "
    "mp as (select session, id, score, tokens, row_number() over (partition by session order by score desc, created_at desc, id) - 1 place from an where hit or (not any_hit and r0 <= 3) qualify place < 200), "
    "g as (select session, id, score, place, tokens <= 70 ok, case when tokens <= 70 then tokens else 0 end used, cast(tokens <= 70 as int) n from mp where place = 0 union all select mp.session, mp.id, mp.score, mp.place, used + mp.tokens <= 70 and n < 5, used + case when used + mp.tokens <= 70 and n < 5 then mp.tokens else 0 end, "
    "n + cast(used + mp.tokens <= 70 and n < 5 as int) from g join mp on mp.session = g.session and mp.place = g.place + 1) select session, id, cast(score as int) score, place from g where ok"
)
def memory_selection(t):
    """Memories that go into each session's request: by score, then the newest, within 70 tokens and five of them."""
    return Y.select(memories(t), asking(t), 5, 70).select("session", "id", F.col("score").cast("int").alias("score"), F.col("place").cast("long").alias("place"))


ASKED = ("building cache", "The  MACHINERY cache is enabled", "household limit", "cache disabled furniture", "nothing of that kind")


@query(
    f"with {FACTS}, q(query) as (values {', '.join(f'({chr(39)}{a}{chr(39)})' for a in ASKED)}), i as (select id, key, claim body, case when id % 3 = 0 then 'active' else 'archived' end status, id % 4 <> 0 applicable, id * 13 % 101 updated_at, lower(trim(regexp_replace(claim, '\\s+', ' ', 'g'))) b from fc), "
    "m as (select query, id, status, applicable, updated_at, list_distinct(regexp_extract_all(lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))), '[\\p{L}\\p{N}]+')) w, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) qn, key, b, list_distinct(regexp_extract_all(b, '[\\p{L}\\p{N}]+')) bw from q, i), "
    "s as (select *, case when key <> '' and lower(key) = qn then 'exact-key' when contains(b, qn) then 'exact-phrase' when len(list_intersect(w, bw)) = len(w) then 'all-terms' when len(list_intersect(w, bw)) > 0 then 'partial-terms' end match from m), "
    "z as (select *, case match when 'exact-key' then 100 when 'exact-phrase' then 80 when 'all-terms' then 60 else 30 end score from s where match is not null) "
    "select query, id, match, score, row_number() over (partition by query order by score desc, case when status = 'active' then 0 else 1 end, cast(applicable as int) desc, updated_at desc, id) - 1 as rank from z"
)
def memory_find(t):
    k, c = F.col("id"), F.col("claim")
    items = claims(t).select("id", T.derived_key(c).alias("key"), c.alias("body"), F.when(k % 3 == 0, "active").otherwise("archived").alias("status"), (k % 4 != 0).alias("applicable"), (k * 13 % 101).alias("updated_at"))
    found = Y.find(items, t.spark.createDataFrame([(a,) for a in ASKED], "query string"))
    return found.select("query", "id", "match", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "with p as (select o_orderkey id, o_custkey session, case o_orderkey % 3 when 0 then 'branch' when 1 then 'session' else 'project' end scope, l.l_linenumber leaf, o_orderkey % 11 = 0 inherited from orders left join lineitem l on l_orderkey = o_orderkey and l_linenumber = 1 + o_orderkey % 3), "
    "b as (select distinct o_custkey session, 1 + o_orderkey % 2 entry from orders) select distinct id, session from p where inherited or scope <> 'branch' or exists (select 1 from b where b.session = p.session and b.entry = p.leaf)"
)
def applicable_pins(t):
    k = F.col("o_orderkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("leaf"))
    pins = t.orders.join(lines, "o_orderkey", "left").withColumn("leaf", F.when(F.col("leaf") == 1 + k % 3, F.col("leaf")))
    pins = pins.select(k.alias("id"), F.col("o_custkey").alias("session"), F.when(k % 3 == 0, "branch").when(k % 3 == 1, "session").otherwise("project").alias("scope"), "leaf", (k % 11 == 0).alias("inherited"))
    return Y.applicable_pins(pins, t.orders.select(F.col("o_custkey").alias("session"), (1 + k % 2).cast("int").alias("entry_id"))).select("id", "session").distinct()


@query(
    "with m as (select event_id seq, user_id session, event_type op from events), s as (select c_custkey session, 'p' || c_nationkey % 4 project from customer), so as (select o_custkey session, case when max(o_orderkey) % 3 = 0 then 'corrupt' else 'ready' end status from orders group by 1) "
    "select m.session, seq, op, project, case when m.session % 7 = 0 then false when status is null then true else status = 'ready' end enabled from m join s using (session) left join so using (session)"
)
def project_mutations(t):
    mutations = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"))
    sessions = t.customer.select(F.col("c_custkey").alias("session"), F.concat(F.lit("p"), F.col("c_nationkey") % 4).alias("project"))
    sources = t.orders.groupBy(F.col("o_custkey").alias("session")).agg(F.when(F.max("o_orderkey") % 3 == 0, "corrupt").otherwise("ready").alias("status"))
    return Y.project_mutations(mutations, sessions, sources, sessions.where("session % 7 = 0")).select("session", "seq", "op", "project", "enabled")


@query(f"with {ENTRIES}, l as (select e.session_id memory, n - 1 as place, e.session_id || ':' || n entry_id from (select distinct session_id from e) e, unnest(range(1, 4)) u(n)) select memory, place, e.entry_id, created_at, tokens from l join e using (entry_id)")
def memory_sources(t):
    """Entries that a memory names, in its order; a name without an entry gives none."""
    found = H.entries(t.conversations)
    links = found.select(F.col("session_id").alias("memory")).distinct().select("memory", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    links = links.select("memory", (F.col("n") - 1).cast("long").alias("place"), F.concat_ws(":", "memory", "n").alias("entry_id"))
    return Y.memory_sources(links, found).select("memory", "place", "entry_id", "created_at", "tokens")


@query(f"with {ENTRIES} select entry_id, tokens from e where (tokens, entry_id) < (100, '5:0') order by tokens desc, entry_id desc limit 26")
def keyset_page(t):
    """The page after the cursor (100, '5:0') by tokens and id, both descending, and one row more to tell if any follow."""
    return Y.pages(H.entries(t.conversations).select("entry_id", "tokens"), [("tokens", True), ("entry_id", True)], (100, "5:0"), 25)


@query(f"with {ENTRIES}, s as (select * from e order by tokens desc, entry_id limit 40) select entry_id, tokens from s where role = 'assistant' order by tokens desc, entry_id limit 10")
def bounded_scan(t):
    return Y.bounded_scan(H.entries(t.conversations).select("entry_id", "tokens", "role"), [("tokens", True), ("entry_id", False)], F.col("role") == "assistant", 40, 10)[0].select("entry_id", "tokens")


@query("select count(distinct doc_id) n from documents where doc_id in (3, 5, 5, 8, 13, 21, 34, 55, 89, -1)")
def get_by_ids(t):
    """Rows of a set of ids, each once, whatever the set repeats or lacks."""
    wanted = t.spark.createDataFrame([(i,) for i in {3, 5, 8, 13, 21, 34, 55, 89, -1}], "doc_id long")
    return t.documents.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_id").distinct().agg(F.count("*").alias("n"))


@query(f"with {ENTRIES}, l as (select entry_id from e where created_at % 3 <> 1) select session_id, count(*) unlocated from e where not exists (select 1 from l where l.entry_id = e.entry_id) group by 1")
def unlocated_entries(t):
    """Entries without a place in their file."""
    found = H.entries(t.conversations)
    return found.join(found.where("created_at % 3 != 1").select("entry_id"), "entry_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("unlocated"))


@query("select p_partkey, exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45) or exists (select 1 from supplier where s_suppkey = p_partkey) used from part")
def existence_probe(t):
    """Whether anything refers to a part: a union of two sides, probed once."""
    either = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).unionAll(t.supplier.select("s_suppkey")).distinct().withColumn("u", F.lit(True))
    return t.part.select("p_partkey").join(either, "p_partkey", "left").select("p_partkey", F.coalesce("u", F.lit(False)).alias("used"))


@query(f"with {ENTRIES}, p as (select conv_id session, 'p' || conv_id % 3 project from (select distinct conv_id from conversations)) select session_id, count(*) entries from e where exists (select 1 from p where p.session = e.session_id and project = 'p1') group by 1")
def project_scope(t):
    """Entries of the sessions that belong to a project."""
    found = H.entries(t.conversations)
    sessions = found.select("session_id").distinct().where("session_id % 3 = 1")
    return found.join(sessions, "session_id", "left_semi").groupBy("session_id").agg(F.count("*").alias("entries"))


MESSAGES = (
    "ms as (select conv_id session, turn as index, case when turn % 11 = 9 then 'branchSummary' else role end role, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) tokens, case when turn % 3 = 0 then 'c' || turn // 6 end call, case when turn % 3 = 2 then 'c' || turn // 6 end result_of from conversations)"
)


def messages(t):
    turn = F.col("turn")
    name = F.concat(F.lit("c"), F.floor(turn / 6).cast("string"))
    return t.conversations.select(
        F.col("conv_id").alias("session"), turn.alias("index"), F.when(turn % 11 == 9, "branchSummary").otherwise(F.col("role")).alias("role"), T.text_tokens(F.col("text")).alias("tokens"),
        F.when(turn % 3 == 0, F.array(name)).otherwise(F.array().cast("array<string>")).alias("calls"), F.when(turn % 3 == 2, name).alias("result_of"),
    )


GROUPS = (
    f"{MESSAGES}, dr as (select *, sum(cast(role in ('user', 'branchSummary') or coalesce(lag_role = 'branchSummary', true) as int)) over (partition by session order by index) draft from (select *, lag(role) over (partition by session order by index) lag_role from ms)), "
    "rl as (select r.session, r.result_of call_id, r.index, (select max(c.index) from ms c where c.session = r.session and c.call = r.result_of and c.index < r.index) ci from ms r where result_of is not null), "
    "lk as (select distinct a.session, a.draft x, b.draft y from rl join dr a on a.session = rl.session and a.index = rl.ci join dr b on b.session = rl.session and b.index = rl.index where a.draft <> b.draft), "
    "bo as (select session, x, y from lk union select session, y, x from lk), rc as (select distinct session, draft node, draft reach from dr union select rc.session, rc.node, bo.y from rc join bo on bo.session = rc.session and bo.x = rc.reach), "
    "rt as (select session, node, min(reach) root from rc group by all), gm as (select dr.*, rt.root, exists (select 1 from rl where rl.session = dr.session and rl.ci = dr.index) ex, first_value(role) over (partition by dr.session, draft order by index) fr from dr join rt on rt.session = dr.session and rt.node = dr.draft)"
)


@query(
    f"with recursive {GROUPS} select session, case when bool_or(fr = 'user') then 'turn' when bool_and(fr = 'branchSummary') then 'summary' else 'prefix' end as kind, cast(min(index) as bigint) as first, cast(max(index) as bigint) as last, count(*) messages, cast(sum(tokens) as bigint) tokens, bool_or(ex) exchange from gm group by session, root"
)
def atomic_groups(t):
    """Turns, summaries and prefixes, put together where a call and its result are in different ones."""
    rows = G.groups(G.grouped(messages(t)))
    return rows.select("session", "kind", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "messages", "tokens", "exchange")


@query(
    f"with {MESSAGES}, pk as (select *, index % 4 <> 1 selected from ms), rl as (select r.session, r.result_of call_id, r.index, r.selected, (select max(c.index) from pk c where c.session = r.session and c.call = r.result_of and c.index < r.index) ci from pk r where result_of is not null), "
    "an as (select session, call_id, ci, count(*) n, count(*) filter (where selected) k from rl group by all), cl as (select session, index ci, call call_id, selected from pk where call is not null), "
    "pr as (select cl.session, cl.call_id, case when selected and n is null then 'no-result' when selected and k < n then 'missing-result' when not selected and k > 0 then 'no-call' end problem from cl left join an on an.session = cl.session and an.call_id = cl.call_id and an.ci = cl.ci "
    "union all select session, call_id, 'no-call' from an where ci is null and k > 0) select distinct session, call_id, problem from pr where problem is not null"
)
def atomic_validity(t):
    return G.broken_exchanges(messages(t).withColumn("selected", F.col("index") % 4 != 1))
