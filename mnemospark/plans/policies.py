"""Queries over decisions by rule, manifests and limits. Parts, orders and events stand for models, requests and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import evaluation as V
from mnemospark.operators import history as H
from mnemospark.operators import manifests as M
from mnemospark.operators import policies as P
from mnemospark.plans.history import ENTRIES, TOK
from mnemospark.plans.registry import query

CEILINGS = "case when win <= 40000 then {0} when win <= 131072 then {1} when win <= 262144 then {2} else {3} end"
LIMITS = {"tail": (24_000, (12_000, 24_000, 32_000, 64_000)), "history": (12_000, (4_000, 8_000, 16_000, 32_000)), "project": (16_000, (4_000, 12_000, 20_000, 32_000))}


def limit_sql(name: str) -> str:
    most, by = LIMITS[name]
    given = "case when p_size % 5 = 0 then 100 * p_size end" if name == "tail" else "cast(null as bigint)"
    return f"coalesce({given}, least({most}, {CEILINGS.format(*by)})) n_{name}, {given} g_{name}"


APPLIED = "least({most}, case when {grown} <= 0 then 0 else greatest(1, cast(floor({grown} / greatest(0.000001e0, ratio)) as bigint)) end)"


@query(
    "with m as (select p_partkey id, p_size, 4096 * (1 + p_size % 50) * 2 win, 0.6e0 + p_size % 9 / 10e0 ratio, case when p_partkey % 3 = 0 then 1.125e0 else 1.0e0 end boost from part), "
    f"n as (select *, {', '.join(limit_sql(k) for k in LIMITS)} from m), g as (select *, {', '.join(f'case when g_{k} is null and boost > 1 then least({LIMITS[k][0]}, cast(floor(n_{k} * boost) as bigint)) else n_{k} end w_{k}' for k in LIMITS)} from n) "
    f"select id, {', '.join(f'cast(n_{k} as bigint) nominal_{k}, cast({APPLIED.format(most=LIMITS[k][0], grown=f'w_{k}')} as bigint) {k}' for k in LIMITS)} from g"
)
def model_limits(t):
    size = F.col("p_size")
    rows = t.part.select(F.col("p_partkey").alias("id"), (4096 * (1 + size % 50) * 2).cast("long").alias("win"), (F.lit(0.6) + size % 9 / 10.0).alias("ratio"), F.when(F.col("p_partkey") % 3 == 0, 1.125).otherwise(1.0).alias("boost"), F.when(size % 5 == 0, 100 * size).cast("long").alias("given"))
    limits = P.model_limits(F.col("win"), F.col("ratio"), F.col("boost"), {k: v[0] for k, v in LIMITS.items()}, {"tail": F.col("given")})
    return rows.select("id", *[c.cast("long").alias(n) for n, c in limits.items()])


@query(
    "with r as (select l_orderkey * 10 + l_linenumber id, case when l_partkey % 11 = 0 then 'off' else 'on' end as mode, case when l_partkey % 7 <> 0 then l_quantity end ip, case when l_partkey % 5 <> 0 then l_quantity * l_discount * 10 end rp, case when l_suppkey % 6 <> 0 then l_discount * 10 end share, "
    "l_linenumber * 3 samples, cast(l_quantity as bigint) * 100 tail, cast(floor(l_extendedprice) as bigint) budget from lineitem), q as (select *, case when ip is not null and rp > 0 then ip / rp end ratio from r), "
    "s as (select *, list_filter([case when ratio is null then 'cache-pricing-incomplete' when ratio < 4 then 'miss-hit-ratio-below-threshold' end, case when share is null then 'cache-share-unobserved' when share < 0.5 then 'cache-read-share-below-threshold' end, "
    "case when samples < 8 then 'insufficient-samples' end], lambda x: x is not null) why from q) "
    "select id, mode <> 'off' and len(why) = 0 eligible, case when mode <> 'off' and len(why) = 0 then greatest(tail, cast(floor(budget * 0.5e0) as bigint)) else tail end tail, mode <> 'off' and len(why) = 0 and greatest(tail, floor(budget * 0.5e0)) <> tail extended, "
    "case when mode = 'off' then 'off-or-insufficient-evidence' else array_to_string(why, ',') end reasons from s"
)
def cache_aware_tail(t):
    r, q = t.lineitem, F.col("l_quantity")
    found = P.cache_aware_tail(
        F.when(F.col("l_partkey") % 11 == 0, "off").otherwise("on"), F.when(F.col("l_partkey") % 7 != 0, q), F.when(F.col("l_partkey") % 5 != 0, q * F.col("l_discount") * 10), F.when(F.col("l_suppkey") % 6 != 0, F.col("l_discount") * 10), F.col("l_linenumber") * 3,
        q.cast("long") * 100, F.floor("l_extendedprice"),
    )
    return r.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), *[(F.array_join(c, ",") if n == "reasons" else c).alias(n) for n, c in found.items()])


KV = {
    "enabled": "p_partkey % 31 <> 0", "capability": "p_partkey % 29 <> 0", "destination": "case when p_size % 9 = 0 then 'remote' else 'local' end", "provider": "case when p_partkey % 23 = 1 then '' else p_brand end", "model": "case when p_partkey % 19 = 2 then ' x' else replace(p_type, ' ', '-') end",
    "model_revision": "case when p_partkey % 37 = 3 then null else 'r' || p_size end", "runtime": "case when p_partkey % 41 = 4 then 'a b' else 'rt' end", "runtime_revision": "case when p_partkey % 43 = 5 then '-x' else '1.' || p_size end", "capability_version": "case when p_partkey % 47 = 6 then repeat('v', 65) else 'v1' end",
    "privacy_version": "case when p_partkey % 53 = 7 then null else 'p1' end", "prefix": "case when p_partkey % 17 = 8 then '' else p_name end", "prefix_tokens": "p_size", "context_tokens": "p_partkey % 60", "options": "case when p_partkey % 59 = 9 then null else '{}' end",
}
NAME = f"^[A-Za-z0-9][A-Za-z0-9._:/@+-]*$"  # noqa: F541
OK = [
    "enabled", "capability", "destination = 'local'", *[f"length({f}) <= {256 if f != 'capability_version' else 64} and regexp_matches({f}, '{NAME}')" for f in ("provider", "model", "model_revision", "runtime", "runtime_revision", "capability_version", "privacy_version")],
    "length(prefix) > 0", "prefix_tokens > 0 and context_tokens > 0 and prefix_tokens <= context_tokens", "length(options) > 0",
]


@query(
    "with r as (select p_partkey, " + ", ".join(f"{sql} as {name}" for name, sql in KV.items()) + " from part where p_brand is not null), b as (select *, replace(provider, '#', '') pv from r), c as (select * replace (pv as provider) from b), "
    "w as (select *, case " + " ".join(f"when not coalesce({ok}, false) then '{why}'" for ok, why in zip(OK, P.KV_REASONS)) + " end reason from c) select p_partkey, reason, case when reason is null then sha256(sha256(prefix) || chr(0) || sha256(provider || chr(0) || model || chr(0) || model_revision) || chr(0) || sha256(options) || chr(0) || "
    "sha256(destination || chr(0) || privacy_version) || chr(0) || sha256(runtime || chr(0) || runtime_revision || chr(0) || capability_version)) end fingerprint from w"
)
def local_cache_eligibility(t):
    rows = t.part.where("p_brand is not null").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in KV.items()]).withColumn("provider", F.replace("provider", F.lit("#"), F.lit("")))
    found = P.local_cache_eligibility({name: F.col(name) for name in KV})
    return rows.select("p_partkey", found["reason"].alias("reason"), found["fingerprint"].alias("fingerprint"))


@query(
    "with i as (select conv_id, turn, turn // 3 as \"at\", sha256(coalesce(text, '')) h from conversations), r as (select a.conv_id session, a.\"at\", max(a.turn) // 9 options, (select list(case when b.turn = 4 and a.\"at\" % 4 = 3 then 'edited' else b.h end order by b.turn) from i b where b.conv_id = a.conv_id and b.\"at\" <= a.\"at\") items from i a group by a.conv_id, a.\"at\"), "
    "l as (select *, lag(\"at\") over w la, lag(options) over w lo, lag(items) over w li from r window w as (partition by session order by \"at\")) "
    "select session, \"at\", case when la is null then 'start' when \"at\" - la > 1 then 'expired' when options <> lo then 'options-changed' when len(items) < len(li) or items[1:len(li)] <> li then 'prefix-changed' else 'continue' end status from l"
)
def continuation_state(t):
    """A session's requests every three turns, each with all items so far; now and then an old item was edited."""
    rows = t.conversations.select(F.col("conv_id").alias("session"), "turn", F.floor(F.col("turn") / 3).alias("at"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    asked = rows.groupBy("session", "at").agg((F.floor(F.max("turn") / 9)).alias("options"))
    seen = asked.join(rows.select("session", "turn", "h", F.col("at").alias("of")), "session").where("of <= at").withColumn("h", F.when((F.col("turn") == 4) & (F.col("at") % 4 == 3), "edited").otherwise(F.col("h")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "h"))), lambda x: x["h"])
    return P.continuation_state(seen.groupBy("session", "at", "options").agg(items.alias("items")), 1).select("session", "at", "status")


QUERIES = (
    "case event_id % 9 when 0 then '' when 1 then '  ' when 2 then repeat('q', 2001) when 3 then repeat('é', 1999) else event_type end", "case when user_id % 7 = 0 then 'everything' when user_id % 7 = 1 then null else 'project' end", "case when user_id % 3 = 0 then event_id % 14 end", "case when event_id % 5 = 0 then 200 + user_id * 90 end",
    "case event_id % 8 when 0 then '2026-01-01T00:00:00Z' when 1 then 'yesterday' when 2 then '2026-03-01T00:00:00Z' end", "case event_id % 4 when 0 then '2026-02-01T00:00:00Z' when 2 then '2026-13-01T00:00:00Z' end", "case event_id % 6 when 0 then 'user,assistant' when 1 then 'user,robot' when 2 then 'user,user,user,user,user,user,user' end",
)


@query(
    "with r as (select event_id, " + ", ".join(f"{sql} as {n}" for n, sql in zip(("q", "s", "l", "k", "a", "b", "r"), QUERIES)) + " from events), d as (select *, try_cast(a as timestamptz) ta, try_cast(b as timestamptz) tb from r) "
    "select event_id, case when length(trim(q)) = 0 or length(q) > 2000 or strlen(q) > 8000 then 'invalid-query' when s not in ('current-branch', 'current-session', 'current-lineage', 'project') then 'invalid-scope' when l not between 1 and 12 then 'invalid-budget' when k not between 256 and 6000 then 'invalid-budget' "
    "when (b is not null and (not regexp_matches(b, '^\\d{4}-\\d{2}-\\d{2}T') or tb is null)) or (a is not null and (not regexp_matches(a, '^\\d{4}-\\d{2}-\\d{2}T') or ta is null)) then 'invalid-date' when ta >= tb then 'invalid-date-range' "
    "when len(string_split(r, ',')) > 6 or len(list_filter(string_split(r, ','), lambda x: x not in ('user', 'assistant', 'toolResult', 'bashExecution', 'custom', 'summary'))) > 0 then 'invalid-role' end problem from d"
)
def history_query(t):
    q, s, l, k, a, b, r = (F.expr(x) for x in QUERIES)
    return t.events.select("event_id", P.query_problem(q, s, l, k, a, b, F.split(r, ",")).alias("problem"))


@query(
    "with r as (select user_id session, event_id id, epoch_us(ts) // 1000 issued_at from events), m as (select max(issued_at) now from r), k as (select r.*, row_number() over (partition by session order by issued_at desc, id desc) n from r, m where issued_at + 86400000 * 20 > now) select session, id, issued_at from k where n <= 6"
)
def live_references(t):
    rows = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("issued_at"))
    now = rows.agg(F.max("issued_at")).first()[0] or 0
    return P.live_references(rows, F.lit(now), 86_400_000 * 20, 6)


@query(
    "with recursive d as (select doc_id, string_split_regex(text, '\\r?\\n') ls, 1 + doc_id % 4 st from documents where text is not null), w as (select doc_id, st, len(ls) total, ls[st:st + 4] part from d), "
    "f as (select doc_id, st, total, part, 0 n, cast(0 as bigint) chars, true o from w union all select doc_id, st, total, part, n + 1, chars + length(part[n + 1]) + case when n > 0 then 1 else 0 end, ceil((chars + length(part[n + 1]) + case when n > 0 then 1 else 0 end) / 4.0) <= 200 from f where o and n < len(part)), "
    "b as (select doc_id, st, total, part, max(n) filter (where o) n from f group by all) "
    "select doc_id, case when st > total then 'out-of-bounds' when n = 0 then 'too-long' when st - 1 + n < total then 'partial' else 'complete' end status, cast(case when st <= total and n > 0 then n end as int) as lines, case when st <= total and n > 0 and st - 1 + n < total then st + n end as next, "
    "case when st <= total and n > 0 then sha256(array_to_string(part[1:n], chr(10))) end page from b"
)
def page_of_lines(t):
    rows = t.documents.where("text is not null").select("doc_id", P.page_of_lines(F.col("text"), (1 + F.col("doc_id") % 4).cast("int"), 5, 200).alias("p"))
    return rows.select("doc_id", "p.status", "p.lines", F.col("p.next").cast("long").alias("next"), F.sha2("p.page", 256).alias("page"))


@query(
    "with m as (select conv_id session, case when turn % 3 = 2 then 'toolResult' else role end role, length(coalesce(text, '')) chars, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) + 10 tokens, 9 other from conversations), "
    "s as (select session, count(*) filter (where role = 'toolResult' and chars > 120) n, sum(case when role = 'toolResult' and chars > 120 then other + 4 else tokens end) spent from m group by 1), b as (select session, n, 400 - 20 - spent left_over from s), "
    "i as (select session, n, case when n = 0 then 900 else least(900, greatest(120, cast(floor(greatest(0, left_over) * 4 * 0.75 / greatest(1, n)) as bigint))) end as inline from b) select session, cast(inline as bigint) as inline, cast(case when n = 0 then 300 else least(300, greatest(0, floor((inline - 1600) / 2.0))) end as bigint) excerpt from i"
)
def artifact_budget(t):
    rows = t.conversations.select(F.col("conv_id").alias("session"), F.when(F.col("turn") % 3 == 2, "toolResult").otherwise(F.col("role")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), (H.T.text_tokens(F.col("text")) + 10).alias("tokens"), F.lit(9).alias("other_tokens"))
    return P.artifact_budget(rows, rows.select("session", F.lit(400).alias("input_tokens"), F.lit(20).alias("fixed_tokens")).distinct(), 900, 300, 120)


@query("select event_id, isfinite(value) and value between 10 and 90 in_range, isfinite(value) and value = floor(value) whole, event_id between 5 and 50 and event_id = floor(event_id) safe from events")
def number_checks(t):
    v, k = F.col("value"), F.col("event_id")
    return t.events.select("event_id", P.in_range(v, 10, 90).alias("in_range"), P.safe_integer(v).alias("whole"), P.safe_integer(k, 5, 50).alias("safe"))


@query("select event_id, '{\"a\":[1,{\"x\":null,\"y\":\"' || event_type || '\"}],\"k\":' || cast(json_extract(props, '$.k') as varchar) || ',\"z\":true}' stable from events")
def stable_json(t):
    raw = F.concat(F.lit('{"z": true, "k": '), F.get_json_object("props", "$.k"), F.lit(' , "a": [1, {"y": "'), "event_type", F.lit('", "x": null}]}'))
    return t.events.select("event_id", P.stable_json(raw).alias("stable"))


OBSERVED = (
    "items as (select conv_id session, 'system' as kind, 'system-prompt' source, cast(null as varchar) role, cast(ceil(length('Answer in ' || conv_id) / 4.0) as bigint) + 8 tokens, 0 part, '' nm, 0 nth from (select distinct conv_id from conversations) where conv_id % 5 <> 0 "
    "union all select conv_id, 'tool', 'tool:' || tn, null, cast(ceil(length(tn || ' takes ' || conv_id) / 4.0) as bigint) + 12, 1, tn, 0 from (select distinct conv_id from conversations) c, (values ('read'), ('grep')) v(tn) where conv_id % 3 <> 0 or tn = 'grep' "
    "union all select session_id, case when created_at = max(created_at) filter (where role = 'user') over (partition by session_id) then 'current' when r2 = 'branchSummary' then 'summary' when r2 = 'toolResult' then 'tool-result' else 'message' end, 'message:' || created_at, r2, tokens, 2, '', created_at "
    "from (select *, case when role = 'user' then role when created_at % 7 = 5 then 'branchSummary' when created_at % 4 = 3 then 'toolResult' else role end r2 from e))"
)


def observed(t):
    found = H.entries(t.conversations)
    role = F.when(F.col("role") == "user", "user").when(F.col("created_at") % 7 == 5, "branchSummary").when(F.col("created_at") % 4 == 3, "toolResult").otherwise(F.col("role"))
    ids = found.select(F.col("session_id").alias("session")).distinct()
    systems = ids.select("session", F.when(F.col("session") % 5 != 0, F.concat(F.lit("Answer in "), "session")).otherwise("").alias("prompt"))
    tools = ids.select("session", F.explode(F.array(F.lit("read"), F.lit("grep"))).alias("name")).where("session % 3 != 0 or name = 'grep'").withColumn("definition", F.concat("name", F.lit(" takes "), "session"))
    return M.observed(systems, tools, found.select(F.col("session_id").alias("session"), F.col("created_at").alias("index"), role.alias("role"), "tokens"))


@query(f"with {ENTRIES}, {OBSERVED} select session, row_number() over (partition by session order by part, nm, nth) - 1 place, kind, source, role, tokens from items")
def observer_manifest(t):
    return observed(t).withColumn("place", F.col("place").cast("long"))


@query(
    f"with {ENTRIES}, {OBSERVED} select session, cast(sum(case when kind = 'system' then tokens else 0 end) as bigint) system_tokens, cast(sum(case when kind = 'tool' then tokens else 0 end) as bigint) tool_tokens, cast(sum(case when kind not in ('system', 'tool') then tokens else 0 end) as bigint) message_tokens, "
    "count(*) filter (where kind not in ('system', 'tool')) messages, count(*) filter (where kind = 'tool') tools, cast(sum(tokens) as bigint) estimated from items group by 1"
)
def observer_composition(t):
    return M.composition(observed(t))


@query(f"with {ENTRIES}, {OBSERVED} select session, source, kind from items where kind not in ('message', 'tool')")
def manifest_display(t):
    rows = observed(t).withColumn("included", ~F.col("kind").isin("message", "tool"))
    return M.shown(rows, "included").select("session", "source", "kind")


@query(
    "with i as (select user_id manifest, event_id place, event_id % 3 = 0 included, length(props) + event_id % 50 bytes from events), r as (select *, row_number() over (partition by manifest, included order by place) a, row_number() over (partition by manifest, included order by place desc) z from i), "
    "s as (select manifest, sum(bytes) bytes, count(*) items, count(*) filter (where included or a <= 2 or z <= 2) ends from r group by 1), q as (select *, case when bytes <= 200 then 'whole' when bytes <= 450 then 'projected' else 'skipped' end as mode from s) "
    "select manifest, mode, case mode when 'whole' then items when 'projected' then ends else 0 end kept from q"
)
def manifest_projection(t):
    k = F.col("event_id")
    return M.projected(t.events.select(F.col("user_id").alias("manifest"), k.alias("place"), (k % 3 == 0).alias("included"), (F.length("props") + k % 50).alias("bytes")), 200, 450, 2)


@query("select source as manifest, case when doc_id % 5 = 0 then 'normal' when doc_id % 5 = 1 then 'internal' when doc_id % 5 = 2 then 'sensitive' else 'normal' end classification, count(*) items, cast(sum(n_chars) as bigint) tokens from documents group by all")
def manifest_classes(t):
    k = F.col("doc_id") % 5
    rows = t.documents.select(F.col("source").alias("manifest"), F.when(k == 0, "normal").when(k == 1, "internal").when(k == 2, "sensitive").alias("classification"), F.col("n_chars").alias("tokens"))
    return M.classified(rows, "manifest")


USAGE = (
    "ma as (select o_orderkey id, cast(floor(o_totalprice / 100) as bigint) estimated, case when o_orderkey % 5 = 0 then 7 end actual from orders), rp as (select l_orderkey id, l_linenumber as \"at\", case when l_partkey % 9 = 0 then 0 else cast(floor(l_extendedprice / 90) as bigint) end actual from lineitem), "
    "fr as (select id, arg_min(actual, \"at\") actual, min(\"at\") as \"at\" from rp where actual > 0 group by 1)"
)


def usage(t):
    manifests = t.orders.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 100).alias("estimated"), F.when(F.col("o_orderkey") % 5 == 0, 7).cast("long").alias("actual"))
    reports = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("at"), F.when(F.col("l_partkey") % 9 == 0, 0).otherwise(F.floor(F.col("l_extendedprice") / 90)).cast("long").alias("actual"))
    # a line number comes once
    return M.recorded_usage(manifests, reports.groupBy("id", "at").agg(F.max("actual").alias("actual")))


@query(f"with {USAGE.replace('from lineitem)', 'from lineitem), rq as (select id, \"at\", max(actual) actual from rp group by all)').replace('from rp where', 'from rq where')} select ma.id, estimated, coalesce(ma.actual, fr.actual) actual from ma left join fr on ma.id = fr.id")
def usage_recorded(t):
    return usage(t)[0]


@query(f"with {USAGE.replace('from lineitem)', 'from lineitem), rq as (select id, \"at\", max(actual) actual from rp group by all)').replace('from rp where', 'from rq where')} select ma.id, \"at\", estimated, fr.actual, floor(fr.actual / cast(estimated as double) * 1000000 + 0.5) / 1000000 ratio from ma join fr on ma.id = fr.id where ma.actual is null and estimated > 0")
def usage_samples(t):
    return usage(t)[1]


@query(
    "with s as (select sha256('x' || page_id) sha, case page_id % 5 when 0 then 'broken' when 1 then null else 'x' || page_id end content, page_id from pages), f as (select distinct sha256('x' || page_id) sha, 'x' || page_id fresh from pages where page_id % 10 in (0, 2)), "
    "b as (select coalesce(s.sha, f.sha) sha, content, fresh from (select * from s where page_id % 5 <> 1) s full join f on s.sha = f.sha) select sha, case when sha256(content) = sha then content else fresh end content, case when content is null then 'added' when sha256(content) = sha then 'available' when fresh is not null then 'repaired' else 'quarantined' end status from b"
)
def artifact_put(t):
    k = F.col("page_id")
    name = F.concat(F.lit("x"), k)
    stored = t.pages.where(k % 5 != 1).select(F.sha2(name, 256).alias("sha"), F.when(k % 5 == 0, "broken").otherwise(name).alias("content"))
    return M.put(stored, t.pages.where((k % 10).isin(0, 2)).select(name.alias("content")))


@query("select page_id, case when length(html) > 300 then sha256(html) end sha, length(html) > 300 offloaded, sha256(case when length(html) > 300 then '[large output stored as artifact://sha256/' || sha256(html) || ', ' || length(html) || ' characters]' else html end) text from pages")
def artifact_offload(t):
    rows = M.offloaded(t.pages.select("page_id", F.col("html").alias("text")), 300)
    return rows.withColumn("text", F.sha2("text", 256))


@query(f"with {ENTRIES} select session_id, count(*) large, cast(sum({TOK.format('text')}) as bigint) tokens from e where {TOK.format('text')} > 40 group by 1")
def large_entries(t):
    rows = H.entries(t.conversations).withColumn("own", H.T.text_tokens(F.col("text")))
    return rows.where("own > 40").groupBy("session_id").agg(F.count("*").alias("large"), F.sum("own").alias("tokens"))


ROUND9 = "floor(least(1.0, greatest(0.0, {0})) * 1000000000 + 0.5) / 1000000000"


@query("select l_orderkey * 10 + l_linenumber id, " + ", ".join(f"{ROUND9.format(sql)} {name}" for name, sql in zip(V.FEATURES, ("l_quantity / 40e0", "l_discount * 9 - 0.1e0", "l_tax * 20", "coalesce(nullif(l_discount, 0.05), 0)", "l_linenumber / 7e0", "1.0", "0.0", "l_quantity - 20", "l_tax", "-1.0"))) + " from lineitem")
def ranking_features(t):
    d, q, x = F.col("l_discount"), F.col("l_quantity"), F.col("l_tax")
    given = dict(zip(V.FEATURES, (q / 40.0, d * 9 - 0.1, x * 20, F.nullif(d, F.lit(0.05)), F.col("l_linenumber") / 7.0, F.lit(1.0), F.lit(float("nan")), q - 20, x, F.lit(-1.0))))
    return V.features(t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_discount", "l_quantity", "l_tax", "l_linenumber"), **given).select("id", *V.FEATURES)
