"""Queries over requests, privacy, validation and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import context as X
from mnemospark.operators import history as H
from mnemospark.operators import privacy as P
from mnemospark.plans.history import ENTRIES, T
from mnemospark.plans.registry import ORACLES, query

#: What requests say besides a benchmark passage, by item.
SAYINGS = (
    """ see `src/a.ts` and lib/B.py with --dry-run ENOENT in python, "the exact phrase" """,
    """ sqlite ERR_FOO --x SRC/A.ts src/a.ts `run it` Foo.bar.baz std::vec snake_case camelCase""",
    """ adesso vorrei \'una frase intera\' HTTP_500 TS2304 kebab-word $dollar XMLHttp C:\\dir\\f.txt ./rel/p.rs""",
    "",
    """ --Flag --flag `Same` same SAME `two words` 12345 perché più node git""",
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SAID = "b as (select item_id, substr(trim(coalesce(text, '') || case item_id % 5 " + " ".join(f"when {k} then {quoted(s)}" for k, s in enumerate(SAYINGS)) + " end), 1, 20000) t from benchmark)"
FIRST = "list_filter({0}, lambda v, i: list_position(list_transform({0}, lambda y: lower(y)), lower(v)) = i)[1:{1}]"
EVERY = "regexp_extract_all({0}, {1}, 1)"
STOPPED = "list_contains([" + ", ".join(map(quoted, X.STOPWORDS)) + "], strip_accents(lower(w)))"
DESCRIBED = (
    f"{SAID}, m0 as (select item_id, t, lower(t) low, {EVERY.format('t', quoted(X.BACKTICKED))} bk, list_concat({EVERY.format('t', quoted(X.QUOTED[0]))}, {EVERY.format('t', quoted(X.QUOTED[1]))}) qt, {EVERY.format('t', quoted(X.FILE))} fl, "
    f"{EVERY.format('t', quoted(X.QUALIFIED))} qn, {EVERY.format('t', quoted(X.FLAG))} fg, list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_$-]+'), lambda x: regexp_matches(x, '^[\\p{{L}}_$]') and length(x) >= 3) wd from b), "
    f"m1 as (select *, {FIRST.format('fl', 16)} files, {FIRST.format('qt', 8)} phrases, list_filter(wd, lambda w: regexp_matches(w, {quoted(X.ERROR_LIKE)})) er0, "
    f"list_concat(list_concat(list_filter(bk, lambda v: not regexp_matches(v, '\\s')), qn), list_concat(fg, list_filter(wd, lambda w: regexp_matches(w, {quoted(X.SYMBOL_LIKE)}) and not {STOPPED}))) sy0, "
    f"list_filter({EVERY.format('low', quoted(X.KEYWORD))}, lambda w: not {STOPPED} and not regexp_matches(w, '^\\d+$')) kw0, list_filter([{', '.join(map(quoted, X.TECHNOLOGIES))}], lambda k: regexp_matches(low, '(^|[^a-z0-9])' || k || '([^a-z0-9]|$)')) technologies from m0), "
    f"m2 as (select *, {FIRST.format('sy0', 20)} symbols, {FIRST.format('er0', 12)} errors, {FIRST.format('kw0', 20)} keywords from m1), m3 as (select *, list_concat(list_concat(bk, files), list_concat(symbols, errors)) id0 from m2), "
    f"m4 as (select *, {FIRST.format('id0', 24)} identifiers from m3), m5 as (select *, list_concat(identifiers, technologies) en0, list_concat(identifiers, list_concat(phrases, keywords)) te0 from m4), "
    f"ds as (select *, {FIRST.format('en0', 24)} entities, {FIRST.format('te0', 24)} terms from m5)"
)
PARTS = ("files", "symbols", "errors", "technologies", "keywords", "phrases", "identifiers", "entities", "terms")


def said(t):
    tail = F.element_at(F.array(*map(F.lit, SAYINGS)), (F.col("item_id") % 5 + 1).cast("int"))
    return t.benchmark.select("item_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


@query(f"with {DESCRIBED} select item_id, {', '.join(f'array_to_string({p}, chr(10)) {p}' for p in PARTS)} from ds")
def describe_task(t):
    return X.described(said(t)).select("item_id", *[F.array_join(p, "\n").alias(p) for p in PARTS])


@query(f"with {DESCRIBED} select item_id, array_to_string(list_transform(terms[1:16], lambda x: '\"' || replace(x, '\"', '\"\"') || '\"'), ' OR ') fts from ds")
def fts_query(t):
    return X.described(said(t)).select("item_id", X.fts_query(F.col("terms")).alias("fts"))


#: Documents with marks: a stretch, a whole text, nested and unclosed ones, one after a backslash, and a class that isn't one.
MARKED = (
    "[ctx:internal]{0}[/ctx:internal] open {1} [CTX:sensitive]x[/ctx:sensitive]", "  [ctx:local-only] {0}{1}", "[ctx:internal] a [ctx:sensitive] b [/ctx:sensitive] {0}{1}", "\\[ctx:sensitive]{0}\\[/ctx:sensitive] password = hunter2xx {1}",
    "[ctx:odd]{0}[/ctx:odd]{1}", "{0}[/ctx:internal]{1}", "{0}{1}", "",
)
CUT = ("substr(coalesce(text, ''), 1, 40)", "substr(coalesce(text, ''), 41)")


def marked_sql(k: int) -> str:
    return quoted(MARKED[k]).replace("{0}", f"' || {CUT[0]} || '").replace("{1}", f"' || {CUT[1]} || '")


MARKS = "d as (select doc_id, doc_id % 2 = 0 remote, case doc_id % 8 " + " ".join(f"when {k} then {marked_sql(k)}" for k in range(8)) + " end t from documents)"
LEVELS = "['normal', 'internal', 'sensitive', 'local-only']"


def marked_texts(t):
    text = F.coalesce("text", F.lit(""))
    head, tail = F.substring(text, 1, 40), F.substring(text, F.lit(41), F.greatest(F.lit(1), F.length(text)))
    forms = [F.replace(F.replace(F.lit(m), F.lit("{0}"), head), F.lit("{1}"), tail) for m in MARKED]
    return t.documents.select("doc_id", (F.col("doc_id") % 2 == 0).alias("remote"), F.element_at(F.array(*forms), (F.col("doc_id") % 8 + 1).cast("int")).alias("t"))


@query(
    f"with {MARKS}, m as (select doc_id, remote, list_max(list_transform(regexp_extract_all(replace(t, '\\[', '('), '(?i)\\[/?ctx:(normal|internal|sensitive|local-only)\\]', 1), lambda c: list_position({LEVELS}, lower(c)))) r from d) "
    f"select doc_id, {LEVELS}[r] klass, not remote or coalesce(r, 1) <= 2 visible from m"
)
def privacy_floor(t):
    rows = marked_texts(t).select("doc_id", "remote", P.marked_class(F.col("t")).alias("klass"))
    return rows.select("doc_id", "klass", X.may_see(F.col("klass"), F.col("remote")).alias("visible"))


@query(
    f"with recursive {MARKS}, m as (select doc_id, regexp_extract_all(replace(t, '\\[', '('), '(?i)\\[/?ctx:(?:normal|internal|sensitive|local-only)\\]') ms from d), "
    f"x as (select doc_id, ms, 1 i, cast([] as int[]) st, 0 fl from m union all select doc_id, ms, i + 1, "
    f"case when ms[i][2] <> '/' then list_append(st, cast(list_position({LEVELS}, lower(regexp_extract(ms[i], ':([a-zA-Z-]+)', 1))) as int)) else st[1:len(st) - 1] end, "
    f"case when ms[i][2] <> '/' then case when len(st) = 0 then fl else greatest(fl, list_max(st), list_position({LEVELS}, lower(regexp_extract(ms[i], ':([a-zA-Z-]+)', 1)))) end "
    f"when len(st) = 0 or st[-1] <> list_position({LEVELS}, lower(regexp_extract(ms[i], ':([a-zA-Z-]+)', 1))) then greatest(fl, coalesce(st[-1], 0), list_position({LEVELS}, lower(regexp_extract(ms[i], ':([a-zA-Z-]+)', 1)))) else fl end "
    "from x where i <= len(ms)) "
    f"select doc_id, {LEVELS}[nullif(greatest(fl, coalesce(list_max(st), 0)), 0)] floor from x where i = len(ms) + 1"
)
def privacy_structure(t):
    """The least class that badly nested marks ask for."""
    return marked_texts(t).select("doc_id", P.structure_floor(F.col("t")).alias("floor"))


NOTE = "case when c <= 2 or not remote then b else '[' || " + LEVELS + "[c] || ' content excluded by privacy policy]' end"
CLOSED = "|".join(f"\\[ctx:{c}\\][\\s\\S]*?\\[/ctx:{c}\\]" for c in P.CLASSES)


@query(
    f"with {MARKS}, e as (select doc_id, remote, replace(t, '\\[', chr(1)) t from d), c as (select *, regexp_extract_all(t, '(?i){CLOSED}') sp, string_split_regex(t, '(?i){CLOSED}') bt, nullif(regexp_extract(t, '(?i)^\\s*\\[ctx:(normal|internal|sensitive|local-only)\\]', 1), '') pre from e), "
    "p as (select doc_id, remote, t, len(sp) > 0 or pre is not null marked, case when len(sp) > 0 then list_filter(flatten(list_transform(range(1, len(bt) + 1), lambda i: [struct_pack(c := 1, b := bt[i], k := bt[i] <> ''), "
    f"struct_pack(c := coalesce(list_position({LEVELS}, lower(regexp_extract(sp[i], ':([a-zA-Z-]+)', 1))), 1), b := regexp_replace(regexp_replace(sp[i], '^\\[[^\\]]*\\]', ''), '\\[/[^\\[\\]]*\\]$', ''), k := i <= len(sp))])), lambda x: x.k) "
    f"when pre is not null then [struct_pack(c := list_position({LEVELS}, lower(pre)), b := regexp_replace(t, '(?i)^\\s*\\[ctx:[a-z-]+\\]\\s*', ''), k := true)] else [struct_pack(c := 1, b := t, k := true)] end ps from c), "
    "s as (select doc_id, remote, t, marked, list_max(list_transform(ps, lambda x: x.c)) cl, len(list_filter(ps, lambda x: x.c > 2 and remote)) blocked, "
    f"array_to_string(list_transform(ps, lambda x: case when x.c <= 2 or not remote then x.b else '[' || {LEVELS}[x.c] || ' content excluded by privacy policy]' end), '') v from p), "
    "r as (select *, case when remote then regexp_replace(v, '(?i)\\b(password)\\b(\\s*[:=]\\s*)[^\\s,\"'';}\\]]{4,}', '\\1\\2[REDACTED SECRET]', 'g') else v end w from s) "
    f"select doc_id, case when t = '' then '' else replace(w, chr(1), '\\[') end as value, {LEVELS}[cl] classification, cast(case when t = '' then 0 else blocked end as int) blocked, t <> '' and (marked or w <> t) changed from r"
)
def privacy_sanitize(t):
    """What each text becomes for a provider: local ones see all, remote ones normal and internal text, without credentials."""
    rows = marked_texts(t)
    remote, allowed = P.provider_policy(F.when(F.col("remote"), "Elsewhere").otherwise(" HERE "), ["here"], {"strict": ["normal"]}, ["normal", "internal"])
    return rows.select("doc_id", P.sanitized(F.col("t"), allowed, remote).alias("s")).select("doc_id", "s.value", "s.classification", "s.blocked", "s.changed")


@query(
    f"with {ENTRIES}, o as (select session_id, case when created_at % 7 = 6 then session_id || ':0' else entry_id end entry_id, parent_id, created_at, case when created_at % 5 = 4 then 'robot' else role end role, case when created_at % 6 = 5 then ' ' else text end text from e), "
    "v as (select *, count(*) over (partition by entry_id) n, lag(entry_id) over w pe, lag(role) over w pr from o window w as (partition by session_id order by created_at, entry_id)) "
    "select entry_id, unnest(list_filter([case when n > 1 then 'duplicate-id' end, case when coalesce(role not in ('system', 'user', 'assistant', 'toolResult'), true) then 'unknown-role' end, case when coalesce(length(trim(text)), 0) = 0 then 'empty-text' end, "
    "case when parent_id <> pe then 'broken-parent' end, case when role = 'assistant' and pr = 'assistant' then 'answer-to-an-answer' end], lambda c: c is not null)) code from v"
)
def history_validation(t):
    e, at = H.entries(t.conversations), F.col("created_at")
    changed = e.withColumns({
        "entry_id": F.when(at % 7 == 6, F.concat("session_id", F.lit(":0"))).otherwise(F.col("entry_id")), "role": F.when(at % 5 == 4, "robot").otherwise(F.col("role")), "text": F.when(at % 6 == 5, " ").otherwise(F.col("text")),
    })
    return X.violations(changed)


@query(
    f"with recursive {ENTRIES}, g as (select *, count(*) filter (where role = 'user') over (partition by session_id order by created_at) turn from e), w as (select session_id, turn, cast(sum(tokens) as bigint) tokens from g group by all), "
    "o as (select *, row_number() over (partition by session_id order by turn) n from w), f as (select session_id, turn, tokens, n, 0 segment, tokens used from o where n = 1 union all select o.session_id, o.turn, o.tokens, o.n, "
    "segment + case when used > 0 and used + o.tokens > 400 and segment < 31 then 1 else 0 end, case when used > 0 and used + o.tokens > 400 and segment < 31 then o.tokens else used + o.tokens end from f join o on o.session_id = f.session_id and o.n = f.n + 1) "
    "select session_id, turn, tokens, segment from f"
)
def segment_pack(t):
    groups = H.turns(H.entries(t.conversations)).groupBy("session_id", "turn").agg(F.sum("tokens").alias("tokens"))
    return X.segments(groups, "session_id", "turn", 400)


@query(
    "select s_suppkey, s_nationkey % 4 = 0 excluded, (select count(*) from lineitem where l_suppkey = s_suppkey) items, (select count(distinct l_orderkey) from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R') returned from supplier"
)
def project_sources(t):
    """Sources with their exclusions and counts: the correlated counts are aggregated once and joined from the left."""
    counts = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("items"), F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.supplier.join(counts, "s_suppkey", "left").select("s_suppkey", (F.col("s_nationkey") % 4 == 0).alias("excluded"), zero("items"), zero("returned"))


@query("select conv_id, sha256(string_agg(role || ':' || coalesce(text, ''), chr(10) order by turn)) source_hash, count(*) entries from conversations group by 1")
def source_hashes(t):
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(":", "role", F.coalesce("text", F.lit(""))).alias("line"))))
    rows = t.conversations.groupBy("conv_id").agg(ordered.alias("lines"), F.count("*").alias("entries"))
    return rows.select("conv_id", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("source_hash"), "entries")


@query("select event_id, epoch_us(ts) // 1000 created_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') iso from events")
def iso_dates(t):
    return t.events.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("created_ms"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


# the retrieval of `hybrid_retrieval`, within 400 tokens
EVIDENCE = ORACLES["hybrid_retrieval"].replace("<= 600", "<= 400")


@query(
    f"with recursive {ENTRIES}, hy as ({EVIDENCE}), tu as (select *, count(*) filter (where role = 'user') over (partition by session_id order by created_at) turn from e), co as (select session_id, turn, cast(sum(tokens) as bigint) cost, max(turn) over (partition by session_id) cur from tu group by session_id, turn), "
    "sp as (select *, sum(cost) over (partition by session_id order by turn desc) spent, coalesce(sum(case when turn < cur then cost end) over (partition by session_id order by turn desc), 0) older from co), tk as (select * from sp where turn = cur or (older <= 500 and spent <= 1200)), rs as (select session_id, greatest(0, 1200 - max(spent)) rest from tk group by 1), "
    "rc as (select tu.session_id, entry_id, case when tk.turn = cur then 'current' else 'recent' end reason from tu join tk using (session_id, turn)), "
    "ca as (select hy.session_id, hy.entry_id, hy.tokens, rest, row_number() over (partition by hy.session_id order by place) r from hy join rs on rs.session_id = hy.session_id where hy.entry_id not in (select entry_id from rc)), "
    "fo as (select session_id, entry_id, r, tokens <= rest ok, case when tokens <= rest then tokens else 0 end used, cast(tokens <= rest as int) n from ca where r = 1 union all select ca.session_id, ca.entry_id, ca.r, used + ca.tokens <= rest and n < 6, used + case when used + ca.tokens <= rest and n < 6 then ca.tokens else 0 end, "
    "n + cast(used + ca.tokens <= rest and n < 6 as int) from fo join ca on ca.session_id = fo.session_id and ca.r = fo.r + 1) select * from rc union all select session_id, entry_id, 'retrieved' from fo where ok"
)
def context_plan(t):
    """Current turn, recent turns, then evidence in one window."""
    return X.plan(H.entries(t.conversations))
