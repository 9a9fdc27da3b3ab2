"""Queries over session files and project files. Documents stand for both; conversations give the messages of logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import project as K
from mnemospark.plans.history import TOK
from mnemospark.plans.registry import query
from mnemospark.sources import sessions as S


def files(t):
    return t.documents.select(F.concat(F.lit("f"), "doc_id").alias("file"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit(0).cast("long").alias("start"))


LINES = (
    "l as (select 'f' || doc_id file, string_split(coalesce(text, ''), chr(10)) a, strlen(coalesce(text, '')) size from documents), u as (select file, a, unnest(range(1, len(a) + 1)) i from l), "
    "s as (select file, i, a[i] line, len(a) total, cast(sum(strlen(a[i]) + 1) over (partition by file order by i) as bigint) e from u)"
)


@query(f"with {LINES} select file, e - strlen(line) - 1 as start, case when i < total then e else e - 1 end as \"end\", sha256(line) raw_hash, i < total \"terminated\" from s where length(trim(line)) > 0")
def jsonl_lines(t):
    """Every line that is not blank with its place in the file's bytes."""
    rows = S.lines(files(t))
    return rows.select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "raw_hash", "terminated")


@query(f"with {LINES}, r as (select file, e - strlen(line) - 1 as start, line, i, total from s where i > 3) select file, start, sha256(line) raw_hash from r where length(trim(line)) > 0 and line is not null")
def jsonl_tail(t):
    """Lines from a stored offset on, here that of each file's fourth line: offsets are still those of the whole file."""
    head = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(1), F.lit(3)), "\n")
    more = F.size(F.split(F.coalesce("text", F.lit("")), "\n")) > 3
    rows = files(t).join(t.documents.where(more).select(F.concat(F.lit("f"), "doc_id").alias("file"), (F.octet_length(head) + 1).cast("long").alias("from")), "file").withColumn("start", F.col("from"))
    return S.lines(rows).select("file", F.col("start").cast("long").alias("start"), "raw_hash")


@query(
    "with d as (select 'f' || doc_id file, coalesce(text, '') t, string_split(coalesce(text, ''), chr(10)) a from documents) select file, cast(case when len(a) > 1 then strlen(t) - strlen(a[-1]) else 0 end as bigint) as \"offset\", cast(case when len(a) > 1 then strlen(t) - strlen(a[-1]) - strlen(a[-2]) - 1 else 0 end as bigint) hash_start, "
    "case when len(a) > 1 then sha256(a[-2] || chr(10)) end hash from d"
)
def log_checkpoints(t):
    return S.checkpoints(files(t)).select("file", "offset", "hash_start", "hash")


@query("select 'f' || doc_id file, case when strlen(coalesce(text, '')) >= 50 then sha256(unhex(substr(hex(encode(coalesce(text, ''))), 21, 80))) end hash from documents")
def range_hash(t):
    """The hash of bytes 10 to 50 of each file, whatever characters they cut; null where a file ends before."""
    return files(t).select("file", S.range_hash(F.col("content"), F.lit(10), F.lit(50)).alias("hash"))


@query("select 'logs/' || doc_id || '.jsonl' file, n_chars size from documents")
def session_files(t):
    rows = t.documents.select(F.concat(F.lit("logs/"), "doc_id", F.lit(".jsonl")).alias("file"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    return S.listed(rows).select("file", "size")


@query(
    "select 'f' || doc_id file, 's' || doc_id session_id, '/w' cwd, cast(3 as int) as version from documents where doc_id % 5 in (0, 1, 2)"
)
def session_headers(t):
    """Of files that begin with a header, a blank line, a line that is no JSON, another record, or a header without an id, the first three have one."""
    head = F.concat(F.lit('{"type":"session","id":"s'), "doc_id", F.lit('","cwd":"/w","version":3}'))
    other, k = F.lit('{"type":"message","id":"m"}'), F.col("doc_id") % 5
    body = F.when(k == 0, head).when(k == 1, F.concat(F.lit("\n  \n"), head, F.lit("\n"), other)).when(k == 2, F.concat(F.lit("no json\n"), head)).when(k == 3, F.concat(other, F.lit("\n"), head)).otherwise('{"type":"session","cwd":"/w"}')
    rows = t.documents.select(F.concat(F.lit("f"), "doc_id").alias("file"), F.encode(body, "UTF-8").alias("content"), F.lit(0).cast("long").alias("start"))
    return S.headers(S.parsed(S.lines(rows))).drop("header_hash")


def logged(t):
    """Conversations as log records: plain messages, blocks with a call and an image, results, shell runs, summaries, labels."""
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    json = lambda **c: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in c.items()]))
    block = lambda **c: F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in c.items()])
    when = "2026-01-01T00:00:00Z"
    id_ = F.concat_ws(":", "conv_id", "turn")
    message = lambda m: json(type="message", id=id_, timestamp=when, message=m)
    blocks = F.array(block(type="text", text=text, name=F.lit(None).cast("string"), arguments=F.lit(None).cast("string")), block(type="toolCall", text=F.lit(None).cast("string"), name="grep", arguments=F.lit("{}")), block(type="image", text=F.lit(None).cast("string"), name=F.lit(None).cast("string"), arguments=F.lit(None).cast("string")))
    raw = (
        F.when(turn % 6 == 0, message(block(role=F.col("role"), content=text)))
        .when(turn % 6 == 1, message(block(role="assistant", content=blocks)))
        .when(turn % 6 == 2, message(block(role="toolResult", toolName=F.when(turn % 4 == 2, "history_search").otherwise("grep"), toolCallId="c", content=F.array(block(type="text", text=text), block(type="text", text="b")))))
        .when(turn % 6 == 3, message(block(role="bashExecution", command="ls", output=text)))
        .when(turn % 6 == 4, json(type="branch_summary", id=id_, timestamp=when, fromId="x", summary=text))
        .otherwise(json(type="label", id=id_, timestamp=when, targetId="y", label=text))
    )
    rows = t.conversations.select(F.col("conv_id").cast("string").alias("file"), turn.alias("start"), (turn + 1).alias("end"), raw.alias("raw"), F.lit("h").alias("raw_hash"), F.lit(True).alias("terminated"))
    return S.parsed(rows)


NL = "chr(10)"


@query(
    "with c as (select conv_id || ':' || turn entry_id, turn, role, coalesce(text, '') t from conversations), p as (select *, case turn % 6 when 0 then 'message' when 1 then 'message' when 2 then 'message' when 3 then 'message' when 4 then 'branch_summary' else 'label' end as type, "
    "case turn % 6 when 0 then t when 1 then case when t = '' then '' else t || chr(10) end || 'grep' || chr(10) || '{}' when 2 then case when turn % 4 = 2 then '' else 'grep' || chr(10) || t || chr(10) || 'b' end when 3 then 'Command: ls' || case when t = '' then '' else chr(10) || t end when 4 then 'x' || case when t = '' then '' else chr(10) || t end "
    "else 'y' || case when t = '' then '' else chr(10) || t end end body from c) select entry_id, type, case turn % 6 when 0 then role when 1 then 'assistant' when 2 then 'toolResult' when 3 then 'bashExecution' when 4 then 'summary' end role, sha256(body) text, "
    f"cast(case turn % 6 when 0 then 8 + {TOK.format('role')} + {TOK.format('t')} when 1 then 8 + 3 + ({TOK.format('t')} + 4) + (ceil(length('grep{{}}') / 4.0) + 4) + 1028 when 2 then case when turn % 4 = 2 then 0 else 8 + 3 + 1 + ({TOK.format('t')} + 4) + (1 + 4) end when 3 then 8 + 4 + 1 + {TOK.format('t')} else {TOK.format('body')} end as bigint) tokens from p"
)
def log_entries(t):
    """What each kind of record is searched by, and its tokens."""
    return S.entries(logged(t)).select("entry_id", "type", "role", F.sha2("text", 256).alias("text"), F.col("tokens").cast("long").alias("tokens"))


@query(
    "with c as (select conv_id || ':' || turn entry_id, turn, role, coalesce(text, '') t from conversations where turn % 6 < 4) select entry_id, case turn % 6 when 0 then case when role in ('system', 'user', 'assistant') then role else 'custom' end when 1 then 'assistant' else 'tool' end role, "
    "case turn % 6 when 0 then 'text' when 1 then 'text,toolCall,image' when 2 then 'toolResult' else 'text,text' end kinds, sha256(case turn % 6 when 2 then t || chr(10) || 'b' when 3 then 'Command: ls' else t end) first_text from c"
)
def canonical_messages(t):
    m = F.col("r.message")
    rows = logged(t).where("r.type = 'message'").select("r.id", S.canonical_role(m["role"]).alias("role"), S.canonical_blocks(m).alias("b"))
    return rows.select(F.col("id").alias("entry_id"), "role", F.array_join(F.transform("b", lambda b: b["type"]), ",").alias("kinds"), F.sha2(F.get("b", F.lit(0))["text"], 256).alias("first_text"))


# --- project files -----------------------------------------------------------------------------------------

PLACES = ("src/app.ts", "lib/Deep/Index.py", "node_modules/x.js", "a/.env.local", "img/logo.PNG", "yarn.lock", "app.min.js", "keys/server.pem", "docs/readme.md", "dist/out.js", "b.map", "Credentials.json", ".gitignore", "x.tar")
WHY = ("-", "-", "ignored", "sensitive", "binary", "binary", "binary", "sensitive", "-", "ignored", "binary", "sensitive", "-", "binary")


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"select doc_id, source || '/' || {listed(PLACES)}[doc_id % {len(PLACES)} + 1] path, nullif({listed(WHY)}[doc_id % {len(WHY)} + 1], '-') why from documents where source is not null")
def project_discovery(t):
    """Which files are project knowledge, and why others are not."""
    path = F.concat_ws("/", "source", F.element_at(F.array(*map(F.lit, PLACES)), (F.col("doc_id") % len(PLACES) + 1).cast("int")))
    return t.documents.where("source is not null").select("doc_id", path.alias("path")).withColumn("why", K.skipped(F.col("path")))


SNIPPETS = (
    "fi as (select source project, lang || '/d' || doc_id || '.py' path, doc_id % 3 = 0 modified, doc_id % 4 <> 0 tracked, n_chars bytes, case when doc_id % 11 = 0 then 'deleted' else 'current' end status, lang as language from documents where source is not null and lang is not null and text is not null), "
    "sn as (select source project, lang || '/d' || doc_id || '.py' path, doc_id || ':' || k snippet_id, cast(k * 400 + 1 as int) start_line, cast(k * 400 + 400 as int) end_line, substr(text, k * 400 + 1, 400) content, doc_id % 13 = k stale, 'Run' || doc_id % 9 symbol_name, 'Mod.Run' || doc_id % 9 qualified_name, "
    "cast(ceil(length(substr(text, k * 400 + 1, 400)) / 4.0) as bigint) tokens from documents, unnest(range(0, cast(ceil(length(text) / 400.0) as bigint))) u(k) where source is not null and lang is not null and text is not null)"
)


def project_files(t):
    d = t.documents.where("source is not null and lang is not null and text is not null")
    k, path = F.col("doc_id"), F.concat("lang", F.lit("/d"), "doc_id", F.lit(".py"))
    found = d.select(F.col("source").alias("project"), path.alias("path"), (k % 3 == 0).alias("modified"), (k % 4 != 0).alias("tracked"), F.col("n_chars").alias("bytes"), F.when(k % 11 == 0, "deleted").otherwise("current").alias("status"), F.col("lang").alias("language"))
    parts = d.where("length(text) > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 400).cast("int"))))
    body = F.substring(F.col("text"), F.col("k") * 400 + 1, F.lit(400))
    name = F.concat(F.lit("Run"), k % 9)
    snippets = parts.select(
        F.col("source").alias("project"), path.alias("path"), F.concat_ws(":", "doc_id", "k").alias("snippet_id"), (F.col("k") * 400 + 1).alias("start_line"), (F.col("k") * 400 + 400).alias("end_line"), body.alias("content"), (k % 13 == F.col("k")).alias("stale"), name.alias("symbol_name"),
        F.concat(F.lit("Mod."), name).alias("qualified_name"), F.array(name).alias("declared"), T.text_tokens(body).alias("tokens"),
    )
    return found, snippets


LIVE = f"{SNIPPETS}, li as (select sn.*, modified, tracked, language from sn join fi using (project, path) where not stale and status = 'current')"
NAMED = ("en/D12.py", "d7.py", "EN/d3.py", "nothing.py")
SYMBOLS = ("run3", "Mod.Run5", "MOD.RUN5", "none")
TERMS = ("the ", "de/d", "zqx")
REQUESTS = "rq as (select source project, row_number() over (order by source) request from (select distinct source from documents where source is not null))"


def project_requests(t):
    from pyspark.sql import Window

    names = t.documents.where("source is not null").select(F.col("source").alias("project")).distinct()
    rows = names.withColumn("request", F.row_number().over(Window.orderBy("project")).cast("long"))
    return rows.withColumns({"files": F.array(*map(F.lit, NAMED)), "symbols": F.array(*map(F.lit, SYMBOLS)), "phrases": F.array().cast("array<string>"), "exact": F.array(*map(F.lit, TERMS))})


@query(f"with {LIVE} select project, path, snippet_id, modified, tracked, language, tokens from li")
def project_snippets(t):
    """Snippets that are not stale, with their file, where that is there."""
    found, snippets = project_files(t)
    return K.current(snippets, found).select("project", "path", "snippet_id", "modified", "tracked", "language", "tokens")


@query(
    f"with {LIVE}, {REQUESTS}, h as (select request, term, snippet_id, row_number() over (partition by request, term order by case when lower(path) = lower(term) then 0 else 1 end, cast(modified as int) desc, start_line, snippet_id) - 1 as rank from li join rq using (project), unnest({listed(NAMED)}) u(term) where lower(path) = lower(term) or ends_with(lower(path), '/' || lower(term))) "
    "select * from h where rank < 3"
)
def project_paths(t):
    found, snippets = project_files(t)
    return K.path_hits(K.current(snippets, found), project_requests(t), 3).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"with {LIVE}, {REQUESTS}, h as (select request, term, snippet_id, row_number() over (partition by request, term order by case when lower(qualified_name) = lower(term) then 0 else 1 end, cast(modified as int) desc, start_line, snippet_id) - 1 as rank from li join rq using (project), unnest({listed(SYMBOLS)}) u(term) where lower(qualified_name) = lower(term) or lower(symbol_name) = lower(term)) "
    "select * from h where rank < 3"
)
def project_symbols(t):
    found, snippets = project_files(t)
    return K.symbol_hits(K.current(snippets, found), project_requests(t), 3).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"with {LIVE}, {REQUESTS}, h as (select request, term, snippet_id, row_number() over (partition by request, term order by cast(modified as int) desc, start_line, snippet_id) - 1 as rank from li join rq using (project), unnest({listed(TERMS)}) u(term) where contains(path, term) or contains(content, term)) select * from h where rank < 3"
)
def project_terms(t):
    found, snippets = project_files(t)
    return K.text_hits(K.current(snippets, found), project_requests(t), 3).withColumn("rank", F.col("rank").cast("long"))


@query(
    f"with {LIVE}, {REQUESTS}, x as (select request, snippet_id, term from li join rq using (project), unnest({listed(NAMED)}) u(term) where lower(path) = lower(term) or ends_with(lower(path), '/' || lower(term)) union select request, snippet_id, term from li join rq using (project), unnest({listed(SYMBOLS)}) u(term) where lower(qualified_name) = lower(term) or lower(symbol_name) = lower(term)), "
    "a as (select distinct request, snippet_id from x), p as (select request, li.*, (select cast(sum(case when lower(path) = lower(f) or ends_with(lower(path), '/' || lower(f)) then 180 when regexp_extract(lower(path), '[^/]*$') = regexp_extract(lower(f), '[^/]*$') then 150 else 0 end) as int) from unnest(" + listed(NAMED) + ") u(f)) sf, "
    "(select cast(sum(case when lower(qualified_name) = lower(s) then 190 when lower(symbol_name) = lower(s) then 170 when contains(lower(content), lower(s)) then 65 else 0 end) as int) from unnest(" + listed(SYMBOLS) + ") u(s)) ss from a join rq using (request) join li using (project, snippet_id)) "
    "select request, snippet_id, floor((sf + ss + case when modified then 10 else 0 end + case when tracked then 3 else 0 end - least(15.0, tokens / 800e0)) * 1000000 + 0.5) / 1000000 score from p"
)
def project_scores(t):
    """What snippets that a request names by path or symbol score."""
    found, snippets = project_files(t)
    rows, asked = K.current(snippets, found), project_requests(t).withColumn("exact", F.array().cast("array<string>"))
    hits = K.path_hits(rows, asked, 10**6).unionByName(K.symbol_hits(rows, asked, 10**6)).groupBy("request", "snippet_id").agg(F.collect_set("term").alias("matched"))
    none = F.lit(None).cast("int")
    merged = hits.join(asked, "request").join(rows, ["project", "snippet_id"]).withColumns({"fts_order": none, "vector_order": none, "lexical_order": none, "similarity": F.lit(None).cast("double")})
    return merged.withColumn("score", K.score(merged)).select("request", "snippet_id", "score")


@query(
    f"with {SNIPPETS}, f as (select project, count(*) files, count(*) filter (where status = 'current') as current, count(*) filter (where status = 'current' and modified) modified, count(*) filter (where status = 'current' and tracked) tracked, cast(coalesce(sum(bytes) filter (where status = 'current'), 0) as bigint) bytes from fi group by 1), "
    "s as (select project, count(*) snippets, cast(sum(tokens) as bigint) tokens from sn where not stale group by 1) select f.*, coalesce(snippets, 0) snippets, coalesce(tokens, 0) tokens from f left join s using (project)"
)
def project_stats(t):
    found, snippets = project_files(t)
    return K.stats(found, snippets)


@query(f"with {LIVE} select (select count(*) from li where length(trim(content)) > 0) total, snippet_id from li where length(trim(content)) > 0 and snippet_id > '2' order by snippet_id limit 30")
def embedding_sources(t):
    found, snippets = project_files(t)
    total, page = K.embedding_sources(K.current(snippets, found), "2", 30)
    return page.select(F.lit(total).cast("long").alias("total"), "snippet_id")


@query(
    f"with {SNIPPETS}, g as (select distinct path from fi where modified), n as (select path, snippet_id from sn where path in (select path from g) and start_line = 1) select sn.path, sn.snippet_id, case when n.path is not null then false else stale or sn.path in (select path from g) end stale from sn left join n on n.path = sn.path and n.snippet_id = sn.snippet_id"
)
def file_replacement(t):
    """Modified files are indexed anew: their first snippet comes again, the others are stale."""
    found, snippets = project_files(t)
    changed = found.where("modified")
    rows = snippets.select("path", "snippet_id", "stale")
    fresh = snippets.where("start_line = 1").join(changed.select("path"), "path", "left_semi").select("path", "snippet_id")
    return K.replaced(rows, changed, fresh).select("path", "snippet_id", "stale")


VECTORS = (
    "sv as (select 'v' || vec_id % 200 source_key, 'h' || vec_id % 3 source_hash, case when vec_id % 11 = 0 then [1.0::float] when vec_id % 13 = 0 then list_transform(embedding, lambda x: 0::float) else embedding end vector, vec_id \"at\" from embeddings), "
    "so as (select distinct 'v' || doc_id % 250 source_key, 'h' || doc_id % 3 source_hash, case when doc_id % 250 % 17 = 0 then ' ' else 'text' end text from documents)"
)


def vectors(t):
    from mnemospark.sources import sinks

    k, e = F.col("vec_id"), F.col("embedding")
    vector = F.when(k % 11 == 0, F.array(F.lit(1.0).cast("float"))).when(k % 13 == 0, F.transform(e, lambda x: F.lit(0.0).cast("float"))).otherwise(e)
    stored = t.embeddings.select(F.concat(F.lit("v"), (k % 200).cast("string")).alias("source_key"), F.concat(F.lit("h"), (k % 3).cast("string")).alias("source_hash"), vector.alias("vector"), k.alias("at"))
    d = F.col("doc_id")
    sources = t.documents.select(F.concat(F.lit("v"), (d % 250).cast("string")).alias("source_key"), F.concat(F.lit("h"), (d % 3).cast("string")).alias("source_hash"), F.when(d % 250 % 17 == 0, " ").otherwise("text").alias("text")).distinct()
    return sinks, stored, sources


@query(
    f"with {VECTORS}, so2 as (select * from so where length(trim(text)) > 0), kn as (select distinct source_key, source_hash from sv where len(vector) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0), fi as (select source_key, source_hash from so2 order by 1, 2 limit 150) "
    "select source_key, source_hash, case when fi.source_key is null then 'beyond' when kn.source_key is not null then 'cached' when ends_with(source_key, '7') then 'private' else 'embed' end \"action\" from so2 left join fi using (source_key, source_hash) left join kn using (source_key, source_hash)"
)
def semantic_sync(t):
    """What an index run does with each source: keep its vector, hold it back, embed it, or leave it beyond the limit."""
    sinks, stored, sources = vectors(t)
    return sinks.sync_plan(sources, stored, ~F.endswith("source_key", F.lit("7")), 150, 64).select("source_key", "source_hash", "action")


@query(
    f"with {VECTORS}, nw as (select * from sv where \"at\" % 2 = 0 and len(vector) = 64 and len(list_filter(vector, lambda x: x <> 0)) > 0), al as (select source_key, source_hash, \"at\" from sv where \"at\" % 2 = 1 union all select source_key, source_hash, \"at\" from nw) select source_key, source_hash, max(\"at\") newest from al group by 1, 2"
)
def vector_upsert(t):
    """Vectors after a write of sound ones; unsound ones are left out."""
    sinks, stored, _ = vectors(t)
    kept, _ = sinks.saved_vectors(stored.where("at % 2 = 1"), stored.where("at % 2 = 0"), 64)
    return kept.groupBy("source_key", "source_hash").agg(F.max("at").alias("newest"))


@query(f"with {VECTORS} select source_key, source_hash, count(*) n from sv where exists (select 1 from so where so.source_key = sv.source_key and so.source_hash = sv.source_hash) group by 1, 2")
def vector_prune(t):
    """Vectors whose source is still there with the same content."""
    sinks, stored, sources = vectors(t)
    return sinks.pruned(stored, sources).groupBy("source_key", "source_hash").agg(F.count("*").alias("n"))
