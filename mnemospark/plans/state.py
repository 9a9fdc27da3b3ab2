"""Queries over event-sourced state, graphs and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import state as S
from mnemospark.plans.registry import query

LOG = (
    "lg as (select user_id session, event_id % 40 item, event_id seq, case when event_id % 3 = 0 then 'status' else 'add' end op, 'k' || event_id % 9 as key, event_type claim, "
    "case event_id % 4 when 0 then 'archived' when 1 then 'active' else 'superseded' end status from events)"
)
REPLAY = (
    f"{LOG}, mk as (select session, item, min(seq) created, arg_min(key, seq) as key, arg_min(claim, seq) claim from lg where op = 'add' group by all), mv as (select session, item, max(seq) seq, arg_max(status, seq) status from lg where op = 'status' group by all), "
    "it as (select mk.session, mk.item, created, mk.key, claim, case when mv.seq > created then mv.status else 'active' end status from mk left join mv using (session, item)), "
    "rp as (select session, item, created, key, claim, case when status = 'active' and key is not null and row_number() over (partition by session, key, status order by created, item) > 1 then 'invalid' else status end status from it)"
)


def log(t):
    e = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("session"), (e % 40).alias("item"), e.alias("seq"), F.when(e % 3 == 0, "status").otherwise("add").alias("op"), F.concat(F.lit("k"), e % 9).alias("key"),
        F.col("event_type").alias("claim"), F.when(e % 4 == 0, "archived").when(e % 4 == 1, "active").otherwise("superseded").alias("status"),
    )


@query(f"with {REPLAY} select * from rp")
def memory_replay(t):
    return S.replay(log(t))


@query(f"with {REPLAY} select session, count(*) filter (where status = 'active') active, count(*) filter (where status <> 'active') inactive, count(distinct key) keys from rp group by 1")
def memory_stats(t):
    return S.replay(log(t)).groupBy("session").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") != "active").alias("inactive"), F.count_distinct("key").alias("keys"))


@query(
    f"with {REPLAY}, v as (select rp.*, case when item % 3 = 0 then 'project' else 'session' end scope, 'p' || session % 4 project from rp) select session, item from v where session = 7 or (scope = 'project' and project = 'p3')"
)
def memory_visible(t):
    items = S.replay(log(t)).withColumn("scope", F.when(F.col("item") % 3 == 0, "project").otherwise("session")).withColumn("project", F.concat(F.lit("p"), F.col("session") % 4))
    return S.visible(items, F.lit(7), F.lit("p3")).select("session", "item")


CLAIMS = (
    "cl as (select c_nationkey session, c_custkey id, case c_custkey % 4 when 0 then 'The ' || c_mktsegment || ' cache is enabled' when 1 then 'the ' || lower(c_mktsegment) || ' cache is disabled' "
    "when 2 then c_mktsegment || ' limit: ' || c_custkey % 3 else 'never the ' || c_mktsegment || '  cache' end claim from customer)"
)


def claims(t):
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    claim = (
        F.when(k % 4 == 0, F.concat(F.lit("The "), segment, F.lit(" cache is enabled"))).when(k % 4 == 1, F.concat(F.lit("the "), F.lower(segment), F.lit(" cache is disabled")))
        .when(k % 4 == 2, F.concat(segment, F.lit(" limit: "), (k % 3).cast("string"))).otherwise(F.concat(F.lit("never the "), segment, F.lit("  cache")))
    )
    return t.customer.select(F.col("c_nationkey").alias("session"), k.alias("id"), claim.alias("claim"))


SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9._/-]+', '-', 'g'), '^-+|-+$', '', 'g')"
FACTS = (
    f"{CLAIMS}, pl as (select *, trim(regexp_replace(claim, '\\s+', ' ', 'g')) n from cl), "
    "sb as (select *, coalesce(nullif(regexp_extract(n, '(?i)^(.{2,160}?) defaults? to .+$', 1), ''), nullif(regexp_extract(n, '(?i)^(.{2,160}?) (?:is|are|must be|should be) .+$', 1), ''), nullif(regexp_extract(n, '^(.{2,160}?) ?[:=] ?.+$', 1), '')) sub from pl), "
    f"fc as (select session, id, claim, {SLUG.format('sub')} as key, case when regexp_matches(lower(n), '(^|[^a-z0-9_])({T.NEGATIVE})([^a-z0-9_]|$)') then -1 when regexp_matches(lower(n), '(^|[^a-z0-9_])({T.POSITIVE})([^a-z0-9_]|$)') then 1 else 0 end polarity, "
    "array_to_string(list_filter(regexp_extract_all(lower(n), '[a-z0-9]+'), lambda w: w not in ('not','never','no','true','false','enabled','enable','disabled','disable','on','off','required','forbidden')), ' ') base from sb)"
)


@query(f"with {FACTS} select session, id, key, polarity, base from fc")
def memory_claims(t):
    c = F.col("claim")
    return claims(t).select("session", "id", T.derived_key(c).alias("key"), T.polarity(c).alias("polarity"), T.contradiction_base(c).alias("base"))


@query(
    f"with {FACTS}, cs as (select session, key, polarity, base, min(id) id from fc group by all) select session, 'member' part, cs.id left_id, fc.id right_id, cast(fc.key is not null as int) same_key, 0 opposite from fc join cs using (session) "
    "where fc.key is not distinct from cs.key and fc.polarity = cs.polarity and fc.base is not distinct from cs.base union all "
    "select a.session, 'pair', a.id, b.id, cast(coalesce(a.key = b.key, false) as int), cast(a.polarity <> 0 and a.polarity = -b.polarity and a.base = b.base as int) from cs a join cs b on a.session = b.session and a.id < b.id "
    "where a.key = b.key or (a.polarity <> 0 and a.polarity = -b.polarity and a.base = b.base)"
)
def contradictions(t):
    """Each claim with its class, and the pairs of classes that contradict each other; copies of a claim are not made into pairs."""
    return S.contradiction_classes(claims(t))


EDGES = "ed as (select distinct p_size % 40 + 40 * (p_partkey % 3) child, (p_size % 40) // 2 + 40 * (p_partkey % 3) parent from part where p_size % 40 > 0)"


def edges(t):
    size, tree = F.col("p_size") % 40, 40 * (F.col("p_partkey") % 3)
    return t.part.where(size > 0).select((size + tree).alias("child"), (F.floor(size / 2) + tree).alias("parent")).distinct()


@query(f"with recursive {EDGES}, r as (select parent ancestor, child node, 1 depth from ed union select r.ancestor, ed.child, depth + 1 from r join ed on ed.parent = r.node) select ancestor, node, cast(min(depth) as int) depth from r group by all")
def ancestor_chain(t):
    return S.reachable(edges(t))


@query(f"with recursive {EDGES}, r as (select parent, child from ed union select r.parent, ed.child from r join ed on ed.parent = r.child) select distinct node from (select parent node from r where child % 11 = 5 union all select child from ed where child % 11 = 5)")
def dag_invalidation(t):
    e = edges(t)
    return S.invalidated(e, e.where("child % 11 = 5").select(F.col("child").alias("node")).distinct())


@query("select o_custkey operation, case max(case o_orderstatus when 'F' then 3 when 'O' then 1 else 2 end) when 3 then 'committed' when 2 then 'failed' else 'prepared' end state from orders group by 1")
def lifecycle_state(t):
    state = F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "prepared").otherwise("failed")
    return S.lifecycle(t.orders.select(F.col("o_custkey").alias("operation"), state.alias("state")))


@query(
    "with n as (select o_orderkey, md5(o_orderstatus) hash from orders), o as (select o_orderkey, case when o_orderkey % 7 = 0 then 'x' else md5(o_orderstatus) end hash from orders where o_orderkey % 5 <> 0) "
    "select n.o_orderkey, n.hash, case when o.hash is null then 'insert' when o.hash = n.hash then 'unchanged' else 'rebuild' end as action from n left join o using (o_orderkey)"
)
def append_decision(t):
    rows = t.orders.select("o_orderkey", F.md5("o_orderstatus").alias("hash"))
    stored = rows.where("o_orderkey % 5 != 0").withColumn("hash", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("hash")))
    return S.append_decision(stored, rows, ["o_orderkey"])


SYNC = (
    "f as (select page_id session, 'd/' || page_id || '.jsonl' path, 'h' || page_id % 5 header_hash, length(html) size, page_id % 13 mtime, md5(html) prefix_hash, html, page_id k from pages), "
    "s as (select session, case when k % 17 = 3 then 'elsewhere' else path end old_path, case when k % 9 = 0 then 'other' else header_hash end old_header_hash, size + case k % 6 when 0 then 9 when 1 then 0 when 2 then 0 else -40 end old_size, "
    "case when k % 12 = 1 then -1 else mtime end old_mtime, size + case k % 6 when 0 then 9 when 1 then 0 when 2 then 0 else -40 end - case when k % 10 = 5 then 7 else 0 end old_offset, "
    "case when k % 8 = 7 then null when k % 7 = 4 then 'x' else prefix_hash end old_hash, k % 19 <> 4 old_located from f where k % 4 <> 2)"
)


@query(
    f"with {SYNC}, r as (select f.session, f.size, s.old_size, case when s.session is null then 'initial' when not old_located then 'locations-missing' when path <> old_path then 'path-changed' when header_hash <> old_header_hash then 'header-changed' "
    "when size < old_size then 'truncated' when size = old_size and mtime <> old_mtime then 'changed-in-place' when size > old_size and old_offset < old_size then 'unterminated-tail' when old_offset > 0 and old_hash is null then 'hash-missing' "
    "when old_offset > 0 and prefix_hash <> old_hash then 'hash-mismatch' end reason from f left join s on f.session = s.session) "
    "select session, case when reason is not null then 'rebuild' when size = old_size then 'noop' else 'append' end as action, reason from r"
)
def sync_decision(t):
    """Pages stand for session files; what an earlier run knew of them differs in every way that asks for a rebuild."""
    k, size = F.col("page_id"), F.length("html")
    files = t.pages.select(
        k.alias("session"), F.concat(F.lit("d/"), k, F.lit(".jsonl")).alias("path"), F.concat(F.lit("h"), k % 5).alias("header_hash"), size.alias("size"), (k % 13).alias("mtime"), F.md5("html").alias("prefix_hash")
    )
    old_size = size + F.when(k % 6 == 0, 9).when((k % 6 == 1) | (k % 6 == 2), 0).otherwise(-40)
    states = t.pages.where(k % 4 != 2).select(
        k.alias("session"), F.when(k % 17 == 3, "elsewhere").otherwise(F.concat(F.lit("d/"), k, F.lit(".jsonl"))).alias("old_path"), F.when(k % 9 == 0, "other").otherwise(F.concat(F.lit("h"), k % 5)).alias("old_header_hash"),
        old_size.alias("old_size"), F.when(k % 12 == 1, -1).otherwise(k % 13).alias("old_mtime"), (old_size - F.when(k % 10 == 5, 7).otherwise(0)).alias("old_offset"),
        F.when(k % 8 == 7, F.lit(None)).when(k % 7 == 4, "x").otherwise(F.md5("html")).alias("old_hash"), (k % 19 != 4).alias("old_located"),
    )
    return S.sync_decision(files, states)


@query("select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49 and l_partkey is not null)")
def orphan_objects(t):
    return S.orphans(t.part.select("p_partkey"), t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("select c_custkey, not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 150000) deleted from customer")
def stale_anti_join(t):
    return S.mark_deleted(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("with n as (select c_nationkey as key, c_mktsegment item from customer), i as (select s_nationkey as key, s_name item from supplier union all select n_nationkey, n_name from nation) "
       "select key, min(item) item, 'native' origin from n group by key union all select key, min(item), 'inherited' from i where key not in (select key from n) group by key")  # fmt: skip
def inheritance(t):
    """A nation's customers are its own items; it inherits those of its suppliers and its name."""
    native = t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_mktsegment").alias("item"))
    rows = t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("item")).union(t.nation.select("n_nationkey", "n_name"))
    return S.inherit(native, rows.groupBy("key").agg(F.min("item").alias("item")), "key")


@query(
    "with r as (select o_custkey session, o_orderkey id, o_orderdate created_at, cast(floor(o_totalprice) as bigint) bytes from orders), a as (select *, row_number() over (partition by session order by created_at desc, id desc) age from r), "
    "x as (select *, row_number() over (partition by session order by created_at, id) nth, sum(bytes) over (partition by session order by created_at, id) upto from a where age > 4) select session, id, nth, cast(upto as bigint) upto from x where nth = 1 or (nth <= 3 and upto <= 400000)"
)
def manifest_prune(t):
    rows = t.orders.select(F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.floor("o_totalprice").alias("bytes"))
    return S.bounded_prune(rows, 4, 3, 400_000).select("session", "id", F.col("nth").cast("long").alias("nth"), "upto")


@query(
    "with d as (select p_brand || ' ' || p_size capability, count(*) times, max(p_size) version from part group by 1), "
    "r as (select 'Brand#' || s_suppkey % 6 || s_nationkey % 6 || ' ' || s_suppkey % 55 capability, max(cast(s_acctbal as bigint) % 60) least, max(cast(s_acctbal > 4000 as int)) required from supplier group by 1) "
    "select coalesce(d.capability, r.capability) capability, case when times > 1 then 'duplicate' when required is null then 'unused' when times is not null and version >= least then 'granted' when required = 1 then 'missing' else 'optional-missing' end status from d full join r using (capability)"
)
def capability_negotiation(t):
    """Parts declare what suppliers request."""
    declared = t.part.select(F.concat_ws(" ", "p_brand", "p_size").alias("capability"), F.col("p_size").alias("version"))
    k = F.col("s_suppkey")
    name = F.concat(F.lit("Brand#"), k % 6, F.col("s_nationkey") % 6, F.lit(" "), k % 55)
    requested = t.supplier.select(name.alias("capability"), (F.round("s_acctbal").cast("long") % 60).alias("least"), (F.col("s_acctbal") > 4000).alias("required"))
    return S.negotiate(declared, requested)


@query(
    "with r as (select l_orderkey % 50 session, l_partkey * 40 + l_linenumber first, l_partkey * 40 + l_linenumber + cast(l_quantity as bigint) % 9 last from lineitem), n as (select *, coalesce(first > max(last) over (partition by session order by first, last rows between unbounded preceding and 1 preceding), true) new from r), "
    "i as (select *, sum(cast(new as int)) over (partition by session order by first, last) island from n) select session, cast(island as bigint) island, min(first) first, max(last) last, count(*) ranges from i group by all"
)
def segment_islands(t):
    first = F.col("l_partkey") * 40 + F.col("l_linenumber")
    return S.overlap_groups(t.lineitem.select((F.col("l_orderkey") % 50).alias("session"), first.alias("first"), (first + F.col("l_quantity").cast("long") % 9).alias("last")))


LINKS = (
    "lk as (select conv_id || ':' || turn node, case when turn % 4 = 3 and turn > 4 then conv_id || ':' || (turn - 3) when turn > 0 then conv_id || ':' || (turn - 1) end parent, "
    "row_number() over (partition by conv_id order by turn desc) = 1 leaf from conversations)"
)


@query(f"with recursive {LINKS}, b as (select node, parent from lk where leaf union select lk.node, lk.parent from b join lk on lk.node = b.parent) select node from b")
def active_branch(t):
    """Entries on the way from each session's last entry to its root, where some entries branch off earlier ones."""
    turn, at = F.col("turn"), lambda k: F.concat_ws(":", "conv_id", k)
    parent = F.when((turn % 4 == 3) & (turn > 4), at(turn - 3)).when(turn > 0, at(turn - 1))
    rows = t.conversations.select(at(turn).alias("child"), parent.alias("parent"), "conv_id", "turn")
    leaves = rows.groupBy("conv_id").agg(F.max_by("child", "turn").alias("node"))
    return S.upwards(rows, leaves)


@query("select max(o_orderkey) deepest, count(*) nodes from orders")
def deep_chain(t):
    """One chain over all orders, each the child of the one before: from the last all are reached."""
    keys = t.orders.select(F.col("o_orderkey").alias("child"))
    before = keys.select((F.col("child") + 1).alias("child"), F.col("child").alias("parent")).join(keys, "child", "left_semi")
    up = S.upwards(before, keys.agg(F.max("child").alias("node")))
    return up.agg(F.max("node").alias("deepest"), F.count("*").alias("nodes"))
