"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions import vectors as V
from mnemospark.operators import history as H
from mnemospark.operators import neighbours as N
from mnemospark.plans.registry import query

TOK = "cast(ceil(length(coalesce({0}, '')) / 4.0) as bigint)"
ENTRIES = (
    "e as (select conv_id session_id, conv_id || ':' || turn entry_id, lag(conv_id || ':' || turn) over (partition by conv_id order by turn) parent_id, turn created_at, role, text, "
    f"{TOK.format('text')} + {TOK.format('role')} + 8 tokens from conversations)"
)
LEX = "lower(strip_accents({0}))"
TERMS = "regexp_extract_all(" + LEX.format("coalesce({0}, '')") + ", '[a-z0-9]+')"
NORM = LEX.format("trim(regexp_replace({0}, '[ \\t-\\r]+', ' ', 'g'))")
HALF_UP = "floor(({0}) * 1000000 + 0.5) / 1000000"
ASKED = (
    "lu as (select session_id, max(created_at) at_turn from e where role = 'user' group by 1), "
    "q as (select lu.session_id, at_turn asked_at, trim(coalesce(text, '')) request from lu join e on e.session_id = lu.session_id and e.created_at = lu.at_turn and role = 'user')"
)


@query(f"with {ENTRIES} select session_id, count(*) entries, cast(coalesce(sum(tokens), 0) as bigint) tokens from e group by 1")
def session_stats(t):
    return H.entries(t.conversations).groupBy("session_id").agg(F.count("*").alias("entries"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


@query(f"with {ENTRIES} select session_id, entry_id, parent_id, created_at, role, tokens, {TOK.format('text')} text_tokens, sha256(coalesce(text, '')) content_hash from e")
def entry_projection(t):
    rows = H.entries(t.conversations)
    return rows.select("session_id", "entry_id", "parent_id", "created_at", "role", "tokens", T.text_tokens(F.col("text")).alias("text_tokens"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@query(
    f"with {ENTRIES}, h as (select session_id, entry_id, row_number() over (partition by session_id order by created_at desc, entry_id desc) - 1 as rank from e where contains(text, 'the')) "
    "select * from h where rank < 3"
)
def exact_scan_topk(t):
    return H.exact_search(H.entries(t.conversations), "the", 3).select("session_id", "entry_id", F.col("rank").cast("long").alias("rank"))


@query(f"with {ENTRIES} select entry_id, tokens from e where session_id in (1, 2, 3, 5, 8, 13, 21) and entry_id not in ('1:0', '2:1') and role in ('user', 'assistant') and created_at < 9 and created_at > 0")
def scope_filter(t):
    scope = H.Scope(frozenset([1, 2, 3, 5, 8, 13, 21]), frozenset(["1:0", "2:1"]), frozenset(["user", "assistant"]), 0, 9)
    return H.entries(t.conversations).where(scope.condition()).select("entry_id", "tokens")


@query(f"with {ENTRIES} select entry_id, created_at from e where false")
def scope_empty_set(t):
    return H.entries(t.conversations).where(H.Scope(sessions=frozenset()).condition()).select("entry_id", "created_at")


@query(f"with {ENTRIES} select session_id, arg_max(entry_id, created_at) entry_id, max(created_at) created_at from e group by 1")
def latest_per_session(t):
    rows = H.entries(t.conversations).groupBy("session_id").agg(F.max_by("entry_id", "created_at").alias("entry_id"), F.max("created_at").alias("created_at"))
    return rows


@query(f"with {ENTRIES}, {ASKED} select * from q")
def current_request(t):
    return H.requests(H.entries(t.conversations))


@query(f"with {ENTRIES} select entry_id, count(*) filter (where role = 'user') over (partition by session_id order by created_at) turn from e")
def turn_groups(t):
    return H.turns(H.entries(t.conversations)).select("entry_id", "turn")


@query(
    f"with {ENTRIES}, g as (select *, count(*) filter (where role = 'user') over (partition by session_id order by created_at) turn from e), "
    "w as (select session_id, turn, cast(sum(tokens) as bigint) tokens, count(*) entries from g group by all), "
    "u as (select *, cast(sum(tokens) over (partition by session_id order by turn desc) as bigint) used from w) select * from u where used <= 700"
)
def recent_tail_window(t):
    return H.recent_tail(H.entries(t.conversations), 700)


@query(
    f"with {ENTRIES} select entry_id, 8.0 * case when max(created_at) over w > min(created_at) over w then (created_at - min(created_at) over w) / cast(max(created_at) over w - min(created_at) over w as double) "
    "else 1.0 end as recency, case role when 'user' then 8 when 'assistant' then 5 else 1 end authority from e window w as (partition by session_id)"
)
def recency_norm(t):
    every = Window.partitionBy("session_id")
    newest, oldest = F.max("created_at").over(every), F.min("created_at").over(every)
    recency = F.when(newest > oldest, (F.col("created_at") - oldest) / (newest - oldest)).otherwise(1.0)
    return H.entries(t.conversations).select("entry_id", (8.0 * recency).alias("recency"), T.role_authority(F.col("role")).alias("authority"))


@query(f"with d as (select doc_id, row_number() over (partition by {NORM.format('text')} order by n_chars desc, doc_id) c from documents where text is not null) select doc_id from d where c = 1")
def dedupe_normalized(t):
    return H.unique_texts(t.documents.where("text is not null"), [], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id")


BM25 = (
    "p as (select {s}, {d}, dl, term, count(*) tf from (select {s}, {d}, len(ws) dl, unnest(ws) term from (select {s}, {d}, " + TERMS.format("text") + " ws from {t})) group by all), "
    "z as (select {s}, count(*) n_docs, avg(len(" + TERMS.format("text") + ")) avg_dl from {t} group by 1), "
    "m as (select p.* from p join (select distinct {s}, term from want) w using ({s}, term)), f as (select {s}, term, count(*) df from m group by all), "
    "b as (select {s}, {d}, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) bm25 from m join f using ({s}, term) join z using ({s}) group by all)"
)


@query(
    f"with {ENTRIES}, {ASKED}, want as (select session_id, unnest({TERMS.format('request')}) term from q), "
    + BM25.format(s="session_id", d="entry_id", t="e")
    + ", r as (select session_id, entry_id, round(bm25, 6) bm25, row_number() over (partition by session_id order by round(bm25, 6) desc, entry_id) - 1 as rank from b) select * from r where rank < 5"
)
def bm25_topk(t):
    found = H.entries(t.conversations)
    wanted = H.requests(found).select("session_id", F.explode(T.terms(F.col("request"))).alias("term"))
    scored = H.bm25(H.postings(found, ["session_id", "entry_id"], {"text": (F.col("text"), 1.0)}), H.sizes(found, "session_id"), wanted, "session_id", "entry_id")
    ranked = H.top(scored.withColumn("bm25", F.round("bm25", 6)), ["session_id"], [F.desc("bm25"), F.asc("entry_id")], 5)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


@query(
    "with w as (select item_id, unnest(list_distinct(" + TERMS.format("text") + ")) term from benchmark), "
    "d as (select doc_id, " + TERMS.format("text") + " c, " + TERMS.format("source || ' ' || lang") + " p from documents), "
    "x as (select doc_id, unnest(c) term, 1.0 wt from d union all select doc_id, unnest(p), 3.0 from d), "
    "i as (select doc_id, term, sum(wt) tf from x group by all), l as (select doc_id, sum(wt) dl from x group by 1), n as (select count(*) n, avg(dl) a from l), "
    "f as (select term, count(*) df from i where term in (select term from w) group by 1), "
    "s as (select item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) score from w join i using (term) join f using (term) join l using (doc_id), n group by all), "
    "r as (select *, row_number() over (partition by item_id order by score desc, doc_id) - 1 as rank from s) select item_id, doc_id, score, rank from r where rank < 3"
)
def weighted_bm25(t):
    """Whole benchmark passages as requests against documents: content weighs 1, where it lies (source, language) 3."""
    wanted = t.benchmark.select("item_id", F.explode(F.array_distinct(T.terms(F.col("text")))).alias("term"))
    fields = {"content": (F.col("text"), 1.0), "place": (F.concat_ws(" ", "source", "lang"), 3.0)}
    return H.weighted_search(t.documents, "doc_id", fields, wanted, "item_id", 3).withColumn("rank", F.col("rank").cast("long"))


COS = "round(list_cosine_similarity(cast(a.embedding as double[]), cast(b.embedding as double[])), 6)"


@query(
    f"with s as (select a.vec_id query_id, b.vec_id, {COS} similarity from embeddings a join embeddings b on a.vec_id <> b.vec_id and a.label = b.label where a.vec_id % 10 = 0), "
    "r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) - 1 as rank from s where similarity >= 0.1) select * from r where rank < 5"
)
def cosine_topk(t):
    """The five most similar vectors of a query's own kind, at least 0.1; blocks of a kind's vectors meet packs of its queries."""
    found = N.of_kind(t.embeddings, "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, 5, 0.1)
    return found.withColumn("rank", F.col("rank").cast("long"))


RRF = "floor((coalesce(1.0 / (61 + {0}), 0) + coalesce(0.5 / (61 + {1}), 0)) * 1000000000 + 0.5) / 1000000000"


@query(
    "with a as (select doc_id, row_number() over (order by n_chars desc, doc_id) - 1 r from documents qualify r < 50), b as (select doc_id, row_number() over (order by length(text) % 997 desc, doc_id) - 1 r from documents qualify r < 50) "
    f"select coalesce(a.doc_id, b.doc_id) doc_id, a.r long_rank, b.r odd_rank, {RRF.format('a.r', 'b.r')} score from a full join b on a.doc_id = b.doc_id"
)
def rrf_fusion(t):
    """Two ranked channels merged by key (a full outer merge) and fused."""
    docs = t.documents.select("doc_id", "n_chars", (F.length("text") % 997).alias("odd"))
    best = lambda c: docs.orderBy(F.desc(c), "doc_id").limit(50).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(c), "doc_id")) - 1)
    merged = H.merge_channels({"long": best("n_chars"), "odd": best("odd")}, ["doc_id"])
    ranks = [F.col(f"{c}_rank").cast("long").alias(f"{c}_rank") for c in ("long", "odd")]
    return merged.select("doc_id", *ranks, V.reciprocal_rank_fusion((F.col("long_rank"), 1.0), (F.col("odd_rank"), 0.5)).alias("score"))


@query(
    f"with recursive {ENTRIES}, {ASKED}, qq as (select *, list_slice(list_transform(list_sort(list_transform(list_distinct(list_filter(ws, lambda x: length(x) >= 6)), lambda x: struct_pack(p := list_position(ws, x), x := x))), lambda s: s.x), 1, 3) xt "
    f"from (select *, {TERMS.format('request')} ws from q)), v as (select e.*, xt, ' ' || array_to_string({TERMS.format('text')}, ' ') || ' ' plain from e join qq on e.session_id = qq.session_id and created_at < asked_at and length(trim(text)) > 0), "
    "mk as (select *, len(list_filter(xt, lambda x: contains(plain, ' ' || x || ' '))) ne, len(xt) > 1 and contains(plain, ' ' || xt[1] || ' ' || xt[2] || ' ') hp from v), want as (select session_id, unnest(ws) term from qq), "
    + BM25.format(s="session_id", d="entry_id", t="v")
    + ", ft as (select session_id, entry_id, row_number() over (partition by session_id order by round(bm25, 6) desc, entry_id) - 1 fo from b qualify fo < 36), "
    "ca as (select mk.*, fo from mk left join ft using (session_id, entry_id) where ne > 0 or coalesce(hp, false) or fo is not null), "
    "sc as (select *, case when ne > 0 then 2 when hp then 1 else 0 end literal, "
    + HALF_UP.format(
        "case when ne > 0 then 100 + least(12, 3 * (ne - 1)) else 0 end + case when hp then 85 else 0 end + coalesce(60 + greatest(0, 10 - fo), 0) + 15 + case role when 'user' then 8 when 'assistant' then 5 else 1 end "
        "+ 8 * case when max(created_at) over w > min(created_at) over w then (created_at - min(created_at) over w) / cast(max(created_at) over w - min(created_at) over w as double) else 1.0 end - least(12.0, tokens / 1000.0)"
    )
    + " score from ca window w as (partition by session_id)), "
    f"de as (select *, row_number() over (partition by session_id, {NORM.format('text')} order by literal desc, score desc, created_at desc, entry_id) cp from sc qualify cp = 1), "
    "pl as (select *, row_number() over (partition by session_id order by literal desc, score desc, created_at desc, entry_id) - 1 place from de qualify place < 24), "
    "g as (select session_id, entry_id, score, literal, tokens, place, case when tokens <= 600 then tokens else 0 end used, case when tokens <= 600 then 1 else 0 end n, tokens <= 600 ok from pl where place = 0 "
    "union all select pl.session_id, pl.entry_id, pl.score, pl.literal, pl.tokens, pl.place, used + case when used + pl.tokens <= 600 and n < 6 then pl.tokens else 0 end, n + case when used + pl.tokens <= 600 and n < 6 then 1 else 0 end, "
    "used + pl.tokens <= 600 and n < 6 from g join pl on pl.session_id = g.session_id and pl.place = g.place + 1) select session_id, entry_id, score, literal, tokens, place from g where ok"
)
def hybrid_retrieval(t):
    return H.hybrid(H.entries(t.conversations))


@query(f"with {ENTRIES} select session_id, entry_id, parent_id, h from (select *, lag(sha256(coalesce(text, ''))) over (partition by session_id order by created_at) h from e) where parent_id is null or h is not null")
def parent_link(t):
    before = F.lag(F.sha2(F.coalesce("text", F.lit("")), 256)).over(Window.partitionBy("session_id").orderBy("created_at"))
    return H.entries(t.conversations).withColumn("h", before).where("parent_id is null or h is not null").select("session_id", "entry_id", "parent_id", "h")


@query(
    "with m as (select conv_id session_id, turn // 4 call_id, turn as index, case when turn % 3 = 0 then 'call' else 'result' end kind from conversations) "
    "select r.session_id, r.index, (select max(c.index) from m c where c.kind = 'call' and c.session_id = r.session_id and c.call_id = r.call_id and c.index < r.index) call_index from m r where kind = 'result'"
)
def tool_relations(t):
    """Results with the latest call of their id before them, as of their index."""
    messages = t.conversations.select(
        F.col("conv_id").alias("session_id"), F.floor(F.col("turn") / 4).alias("call_id"), F.col("turn").alias("index"), F.when(F.col("turn") % 3 == 0, "call").otherwise("result").alias("kind")
    )
    return H.calls_and_results(messages).select("session_id", "index", "call_index")
