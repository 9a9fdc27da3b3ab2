"""Queries over summaries and source code. Benchmark passages are summaries of documents; parts give source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import history as H
from mnemospark.operators import summaries as S
from mnemospark.operators import symbols as Y
from mnemospark.plans.history import ENTRIES
from mnemospark.plans.registry import query

NAMES = S.SECTIONS


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PARTS = (  # sections of a summary by item, then by their number
    "case item_id % 4 when 0 then range(1, 13) when 1 then [2, 1, 3, 3, 7] when 2 then [6, 7, 12, 13] else [] end"
)
SUMMARY = (
    f"su as (select item_id, coalesce(text, '') t, 'start' || array_to_string(list_transform({PARTS}, lambda k: chr(10) || '## ' || ({listed((*NAMES, 'Other'))})[k] || chr(10) || case when k % 5 = 2 then '' else 'say ' || k || ' `' || split_part(coalesce(text, ''), ' ', cast(k as int)) || '` `no\\such' || k || '`' end || chr(10)), '') s from benchmark)"
)


def summaries(t):
    k, text = F.col("item_id") % 4, F.coalesce("text", F.lit(""))
    parts = F.when(k == 0, F.sequence(F.lit(1), F.lit(12))).when(k == 1, F.array(*map(F.lit, (2, 1, 3, 3, 7)))).when(k == 2, F.array(*map(F.lit, (6, 7, 12, 13)))).otherwise(F.array().cast("array<int>"))
    names = F.array(*map(F.lit, (*NAMES, "Other")))
    body = lambda n: F.when(n % 5 == 2, "").otherwise(F.concat(F.lit("say "), n.cast("string"), F.lit(" `"), F.split_part(text, F.lit(" "), n), F.lit("` `no\\such"), n.cast("string"), F.lit("`")))
    section = lambda n: F.concat(F.lit("\n## "), F.element_at(names, n), F.lit("\n"), body(n), F.lit("\n"))
    return t.benchmark.select("item_id", text.alias("t"), F.concat(F.lit("start"), F.array_join(F.transform(parts, section), "")).alias("s"))


@query(
    f"with {SUMMARY}, n as (select item_id, regexp_extract_all(s, '(?m)^##[ \\t]+(.+?)[ \\t]*$', 1) nm, list_transform(string_split_regex(s, '(?m)^##[ \\t]+(?:.+?)[ \\t]*$'), lambda b: regexp_replace(b, '^\\s+|\\s+$', '', 'g')) bd from su), r as (select item_id, nm, bd, {listed(NAMES)} rq from n), "
    "p as (select item_id, list_concat(list_concat(list_transform(list_filter(rq, lambda x: not list_contains(nm, x)), lambda x: 'missing:' || x), list_transform(list_filter(rq, lambda x: len(list_filter(nm, lambda y: y = x)) > 1), lambda x: 'duplicate:' || x)), "
    "list_concat(list_concat(list_transform(list_filter(nm, lambda x, i: list_contains(rq, x) and bd[i + 1] = ''), lambda x: 'empty:' || x), list_transform(list_filter(nm, lambda x: not list_contains(rq, x)), lambda x: 'unknown:' || x)), "
    "case when list_transform(list_filter(nm, lambda x, i: list_contains(rq, x) and list_position(nm, x) = i), lambda x: list_position(rq, x)) <> list_sort(list_transform(list_filter(nm, lambda x, i: list_contains(rq, x) and list_position(nm, x) = i), lambda x: list_position(rq, x))) then ['order'] else [] end)) pr from r) "
    "select item_id, array_to_string(pr, ',') problems from p"
)
def summary_sections(t):
    return summaries(t).select("item_id", F.array_join(S.section_problems(S.sections(F.col("s"))), ",").alias("problems"))


@query(
    f"with {SUMMARY}, v as (select item_id, t, s, regexp_extract_all(s, '`([^`\\n]+)`', 1) vs, string_split_regex(s, '`[^`\\n]+`') bt from su) select item_id, array_to_string(list_filter(vs, lambda x: not (contains(t, x) or contains(t, replace(x, '\\', '\\\\')))), chr(10)) spans, "
    "sha256(array_to_string(list_transform(range(1, len(bt) + 1), lambda i: bt[i] || case when i > len(vs) then '' when contains(t, vs[i]) or contains(t, replace(vs[i], '\\', '\\\\')) then '`' || vs[i] || '`' else vs[i] end), '')) retracted from v"
)
def summary_exact_values(t):
    rows = summaries(t)
    return rows.select("item_id", F.array_join(S.unsupported_spans(F.col("s"), F.col("t")), "\n").alias("spans"), F.sha2(S.retracted(F.col("s"), F.col("t")), 256).alias("retracted"))


@query(
    f"with {SUMMARY}, v as (select t, unnest(regexp_extract_all(s, '`([^`\\n]+)`', 1)) x from su) select case when contains(t, x) then 'literal' else 'absent' end relation, case when regexp_matches(x, '^[\\w.@+-]*[/\\\\]') then 'path' when regexp_matches(x, '^-?\\d+(\\.\\d+)?$') then 'number' when regexp_matches(x, '^[A-Za-z_$][\\w$]*$') then 'identifier' "
    "when regexp_matches(x, '\\s') then 'phrase' else 'other' end shape, case when length(x) <= 8 then '1-8' when length(x) <= 32 then '9-32' when length(x) <= 128 then '33-128' else '129+' end length, count(*) n from v group by all"
)
def summary_span_counts(t):
    return S.span_counters(summaries(t).select(F.col("s").alias("summary"), F.col("t").alias("evidence")))


GRAPH = (
    "gn as (select o_orderkey node, o_custkey % 7 session, case when o_orderkey % 13 = 0 then 0 else o_orderkey % 9 end level, md5(o_orderpriority) hash from orders), st as (select node, session, level, case when node % 17 = 0 then 'x' else hash end hash from gn where node % 5 = 0), "
    "ed as (select distinct l_orderkey parent, l_orderkey - l_orderkey % 32 + (l_orderkey % 32 + l_linenumber * 3 + 23) % 32 child from lineitem)"
)


@query(
    f"with recursive {GRAPH}, im as (select gn.node, 'immutable' problem from gn join st on gn.node = st.node where gn.hash <> st.hash), ev as (select node, session, level from gn), "
    "bo as (select parent node, case when parent = child then 'self' when c.session is null or c.session <> p.session then 'missing-child' when c.level >= p.level then 'level' end problem from ed join ev p on p.node = parent left join ev c on c.node = child), "
    "re as (select parent a, child b from ed where parent <> child union select re.a, ed.child from re join ed on ed.parent = re.b and ed.parent <> ed.child) "
    "select node, problem from im union all select distinct node, problem from bo where problem is not null union all select a, 'cycle' from re where a = b"
)
def summary_graph(t):
    """Why orders, taken as summaries with lines as their edges, could not be saved."""
    k = F.col("o_orderkey")
    nodes = t.orders.select(k.alias("node"), (F.col("o_custkey") % 7).alias("session"), F.when(k % 13 == 0, 0).otherwise(k % 9).alias("level"), F.md5("o_orderpriority").alias("hash"))
    stored = nodes.where("node % 5 = 0").withColumn("hash", F.when(F.col("node") % 17 == 0, "x").otherwise(F.col("hash")))
    # children lie in their parent's block of 32, so that the SQL can close the graph
    edges = t.lineitem.select(F.col("l_orderkey").alias("parent"), F.expr("l_orderkey - l_orderkey % 32 + (l_orderkey % 32 + l_linenumber * 3 + 23) % 32").alias("child")).distinct()
    return S.graph_problems(nodes, edges, stored)


@query(f"with {ENTRIES}, l as (select conv_id summary, conv_id || ':' || n entry_id from (select distinct conv_id from conversations) c, unnest(range(0, 8)) u(n)) select summary, l.entry_id, created_at, tokens, created_at is null missing from l left join e on e.entry_id = l.entry_id")
def summary_sources(t):
    found = H.entries(t.conversations)
    links = found.select(F.col("session_id").alias("summary")).distinct().select("summary", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("n")).select("summary", F.concat_ws(":", "summary", "n").alias("entry_id"))
    return S.summary_sources(links, found)


@query(
    f"with recursive {ENTRIES}, n as (select session_id session, created_at as place, tokens, row_number() over (partition by session_id order by created_at) r from e), f as (select session, place, tokens, r, 0 batch, tokens used from n where r = 1 union all "
    "select n.session, n.place, n.tokens, n.r, batch + case when 30 + used + n.tokens <= 200 then 0 else 1 end, case when 30 + used + n.tokens <= 200 then used + n.tokens else n.tokens end from f join n on n.session = f.session and n.r = f.r + 1) "
    "select session, place, tokens, batch, count(*) over (partition by session, batch) = 1 and batch < max(batch) over (partition by session) stuck from f"
)
def summary_layer(t):
    rows = H.entries(t.conversations).select(F.col("session_id").alias("session"), F.col("created_at").alias("place"), "tokens")
    return S.layer(rows, 200, 30)


@query(
    f"with {ENTRIES}, c as (select session_id, arg_max(entry_id, created_at) leaf, arg_max(coalesce(text, ''), created_at) t from e group by 1) select session_id, case when length(trim(t)) = 0 then 'checkpoint-empty' when ceil((77 + length(t) + 17 + length('{{\"context\":\"\"}}') - 3) / 4.0) > 100000 then 'checkpoint-budget' end problem, "
    "case when length(trim(t)) > 0 then 'checkpoint_' || substr(sha256(session_id || ':' || leaf || ':' || sha256(t)), 1, 32) end id from c"
)
def rebase_checkpoint(t):
    rows = H.entries(t.conversations).groupBy("session_id").agg(F.max_by("entry_id", "created_at").alias("leaf"), F.max_by(F.coalesce("text", F.lit("")), "created_at").alias("t"))
    c = S.checkpoint(F.col("session_id"), F.col("leaf"), F.sha2("t", 256), F.col("t"), 100_000)
    return rows.select("session_id", c.alias("c")).select("session_id", "c.problem", "c.id")


CODE = (
    "py:class A{0}:\n    # def no(): pass\n    def run(self, x):\n        return helper(x, '''class Z:''')\n\ndef make{0}():\n    return A{0}()\n",
    "ts:import {{ C }} from './c';\n// class No {{}}\nexport class S{0} {{\n  async run(c: C): Promise<R> {{\n    if (c) {{ go(c); }}\n  }}\n}}\nconst text = 'function no() {{}}';\n",
    "go:package p\n\ntype T{0} struct {{ a int }}\n\nfunc (t *T{0}) Run() error {{\n  return t.a\n}}\n",
    "py:def broken(:\n  return [\n",
)
WANT = ("A{0}:class:1-4,A{0}.run:method:3-4,make{0}:function:6-7", "S{0}:class:3-7,text:variable:8-8,S{0}.run:method:4-6", "T{0}:struct:3-3,T{0}.Run:method:5-7", "")


@query("select p_partkey, replace(([" + ", ".join(f"'{w}'" for w in WANT) + "])[p_partkey % 4 + 1], '{0}', cast(p_partkey as varchar)) symbols from part")
def source_symbols(t):
    """Symbols of a small file for each part, in one of three languages or broken; the expected ones are written out."""
    k = F.col("p_partkey")
    form = F.element_at(F.array(*[F.lit(c.split(":", 1)[1].replace("{{", "{").replace("}}", "}")) for c in CODE]), (k % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("python", "typescript", "go", "python"))), (k % 4 + 1).cast("int"))
    found = t.part.select("p_partkey", Y.symbols(F.replace(form, F.lit("{0}"), k.cast("string")), kind).alias("s"))
    return found.select("p_partkey", F.array_join(F.transform("s", lambda x: F.concat(x["qualified"], F.lit(":"), x["kind"], F.lit(":"), x["first"].cast("string"), F.lit("-"), x["last"].cast("string"))), ",").alias("symbols"))
