"""Queries over nested payloads, patches, tool results and stored models; documents give the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions.text import likely_binary
from mnemospark.operators import evaluation as E
from mnemospark.operators import policies as P
from mnemospark.operators import privacy as X
from mnemospark.operators import summaries as S
from mnemospark.plans.registry import query
from mnemospark.storage import new_path


@query(
    "with d as (select doc_id, doc_id % 50 + 1 as a, doc_id % 4 as gone, doc_id % 3 as come, doc_id % 5 as more, doc_id % 9 as hunks from documents) "
    "select doc_id, cast(come - gone + more + hunks as int) as line_delta, cast((gone + come > 0)::int + (more > 0)::int + hunks as int) as regions, (gone + come > 0)::int + (more > 0)::int + hunks > 6 as truncated, "
    "case when gone + come > 0 then a + 1 when more > 0 then a + 29 when hunks > 0 then 200 end as first_old from d"
)
def edit_reports(t):
    """What patches change, from the patches alone: a change in the first hunk, one of lines added in the second, and up to eight more hunks of one line."""
    k = F.col("doc_id")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\n\r]", " ")
    many = lambda mark, n: F.array_join(F.transform(F.slice(F.array(*[F.lit(x) for x in range(5)]), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit("\n" + mark), line)), "")
    at = (k % 50 + 1).cast("string")
    first = F.concat(F.lit("--- a\n+++ b\n@@ -"), at, F.lit(",9 +"), at, F.lit(",9 @@\n kept"), many("-", k % 4), many("+", k % 3), F.lit("\n after"))
    second = F.concat(F.lit("\n@@ -"), (k % 50 + 29).cast("string"), F.lit(",1 +"), (k % 50 + 30).cast("string"), F.lit(",6 @@\n kept"), many("+", k % 5))
    others = F.array_join(F.transform(F.slice(F.array(*[F.lit(x) for x in range(8)]), F.lit(1), (k % 9).cast("int")), lambda i: F.concat(F.lit("\n@@ -"), (199 + 10 * i).cast("string"), F.lit(",0 +"), (200 + 10 * i).cast("string"), F.lit(" @@\n+one"))), "")
    rows = t.documents.select("doc_id", P.edit_report(F.concat(first, second, others)).alias("r"))
    return rows.select("doc_id", "r.line_delta", "r.regions", "r.truncated", F.get_json_object("r.shown", "$[0].old_start").cast("long").alias("first_old"))


@query(
    "with d as (select doc_id, coalesce(text, '') || chr(10) || '  ERROR in src/part' || doc_id || '.ts:  ' || chr(10) || 'a Warning twice' || chr(10) || 'a Warning twice' || chr(10) || 'errors and failing are none' as t from documents), "
    "l as (select doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: regexp_matches(x, '(?i)\\b(?:error|failed|failure|exception|fatal|panic|warn(?:ing)?|traceback)\\b')) as e from d), "
    "u as (select doc_id, t, list_filter(e, lambda x, i: list_position(e, x) = i)[1:16] as errors from l), "
    "w as (select doc_id, errors, list_filter(list_transform(list_filter(regexp_extract_all(t || chr(10) || t || chr(10) || array_to_string(errors, chr(10)), '[^\\s\"''<>]{1,500}'), lambda x: contains(x, '/') or contains(x, '\\')), lambda x: trim(regexp_replace(x, '^[(\\[{,;]+|[\\])},;]+$', '', 'g'))), lambda x: x <> '') as p from u) "
    "select doc_id, len(errors) as errors, sha256(array_to_string(errors, chr(10))) as lines, sha256(array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i)[1:24], chr(10))) as paths from w"
)
def relevant_lines(t):
    """Lines of whole texts that speak of failure, and paths, as results of tools are shown by. (No line is longer than what is shown of one.)"""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n  ERROR in src/part"), "doc_id", F.lit(".ts:  \na Warning twice\na Warning twice\nerrors and failing are none"))
    rows = t.documents.select("doc_id", P.relevant(text).alias("r"))
    return rows.select("doc_id", F.size("r.errors").cast("long").alias("errors"), F.sha2(F.array_join("r.errors", "\n"), 256).alias("lines"), F.sha2(F.array_join("r.paths", "\n"), 256).alias("paths"))


@query("select doc_id, case doc_id % 6 when 1 then 'internal' when 2 then 'sensitive' when 3 then 'local-only' when 4 then 'internal' when 5 then 'sensitive' end as klass from documents")
def nested_class(t):
    """The most closed class within a payload: fields, marks in strings, and marks in JSON that is a string of a history result."""
    k, text = F.col("doc_id") % 6, F.coalesce("text", F.lit(""))
    json_ = lambda **c: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in c.items()]))
    inner = json_(schema=X.RESULT_SCHEMA, quotedData=F.lit(True), text=F.concat(F.lit("[ctx:sensitive]x[/ctx:sensitive]"), text))
    value = (
        F.when(k == 0, json_(a=F.struct(text.alias("text"), F.lit("odd").alias("classification")))).when(k == 1, json_(a=F.array(F.struct(F.lit("internal").alias("classification"))), t=text))
        .when(k == 2, json_(t=F.concat(F.lit("[ctx:internal]a[/ctx:internal][CTX:Sensitive]x[/ctx:sensitive]"), text))).when(k == 3, json_(classification="internal", t=text, b=F.struct(F.lit("local-only").alias("classification"))))
        .when(k == 4, F.concat(F.lit("no json [ctx:internal]x[/ctx:internal] "), text)).otherwise(json_(content=F.array(F.struct(inner.alias("text")))))
    )
    return t.documents.select("doc_id", X.history_class(value).alias("klass"))


@query(
    "with d as (select doc_id, regexp_replace(coalesce(text, ''), '[^a-z ]', '', 'g') as t from documents) "
    "select doc_id, sha256(case doc_id % 3 when 0 then '{\"id\":\"[x]\",\"content\":\"' || t || ' [internal ok] [sensitive content excluded by privacy policy]\"}' when 1 then '{\"role\":\"user\",\"content\":[{\"text\":\"' || t || '\",\"name\":\"' || t || '\"}]}' "
    "else '{\"meta\":\"password=hunter22\",\"content\":{\"text\":\"' || t || ' password=[REDACTED SECRET]\"}}' end) as value, "
    "case when doc_id % 3 = 0 then 'sensitive' else 'normal' end as classification, cast(case when doc_id % 3 = 0 then 1 else 0 end as int) as blocked, cast(case when doc_id % 3 = 2 then 1 else 0 end as int) as redactions from d"
)
def nested_sanitized(t):
    """Payloads for a remote provider: content is sanitised at any depth, what is no content stays."""
    k, text = F.col("doc_id") % 3, F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z ]", "")
    json_ = lambda **c: F.to_json(F.struct(*[(v if not isinstance(v, str) else F.lit(v)).alias(n) for n, v in c.items()]))
    value = (
        F.when(k == 0, json_(id="[x]", content=F.concat(text, F.lit(" [ctx:internal][internal ok][/ctx:internal] [ctx:sensitive]hidden[/ctx:sensitive]"))))
        .when(k == 1, json_(role="user", content=F.array(F.struct(text.alias("text"), text.alias("name"))))).otherwise(json_(meta="password=hunter22", content=F.struct(F.concat(text, F.lit(" password=hunter22")).alias("text"))))
    )
    rows = t.documents.select("doc_id", X.sanitized_json(value, ["normal", "internal"], True).alias("s"))
    return rows.select("doc_id", F.sha2("s.value", 256).alias("value"), "s.classification", "s.blocked", "s.redactions")


@query("select c_mktsegment as feature, round(avg(c_acctbal), 4) as weight from customer group by 1 union all select 'bias', round(sum(c_acctbal) / 1000, 4) from customer")
def model_saved(t):
    """A model as it is read back by its checksum."""
    spark = t.customer.sparkSession
    model = t.customer.groupBy(F.col("c_mktsegment").alias("feature")).agg(F.round(F.avg("c_acctbal"), 4).alias("weight"))
    model = model.unionByName(t.customer.agg(F.round(F.sum("c_acctbal") / 1000, 4).alias("weight")).withColumn("feature", F.lit("bias")))
    path = new_path(spark, "model")
    return E.load_model(spark, path, E.save_model(spark, model, path))


@query(
    "with d as (select doc_id, coalesce(text, '') as t from documents), e as (select doc_id, t, strlen(t) as n from d) select doc_id, case doc_id % 6 when 1 then n < 8192 when 2 then n > 0 and n // 12 > 0 and least(n // 12, 8192) > least(8192, n + n // 12) * 0.05e0 "
    "when 3 then doc_id % 40 > greatest(2, (length(t) + doc_id % 40) / 200e0) when 5 then (3 * (1 + doc_id % 5) > greatest(2, (length(t) + 3 * (1 + doc_id % 5)) / 200e0)) else false end as binary from e"
)
def file_sniff(t):
    """Files that are no text by their first 8 KiB or by bytes that are no UTF-8: a NUL at the end, control bytes at the head, replacement characters, control bytes beyond the head, and broken bytes."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    body = (
        F.when(k % 6 == 1, F.concat(text, F.lit("\0"))).when(k % 6 == 2, F.concat(F.expr("repeat('\\u0001', cast(octet_length(coalesce(text, '')) div 12 as int))"), text)).when(k % 6 == 3, F.concat(text, F.expr("repeat('\\uFFFD', cast(doc_id % 40 as int))")))
        .when(k % 6 == 4, F.concat(F.expr("repeat('a', 9000)"), F.expr("repeat('\\u0001', 5000)"), text)).otherwise(text)
    )
    # each of these bytes alone is no character
    broken = F.concat(F.encode(text, "UTF-8"), F.unhex(F.expr("repeat('C0FFFE', cast(1 + doc_id % 5 as int))")))
    content = F.when(k % 6 == 5, broken).otherwise(F.encode(body, "UTF-8"))
    return t.documents.select("doc_id", likely_binary(content).alias("binary"))


@query(
    "with l as (select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn) as body, list(conv_id || ':' || turn order by turn) as ids, arg_max(coalesce(text, ''), turn) as last from conversations group by 1), "
    "h as (select conv_id, last, sha256(cast(json_object('conversationText', body, 'modifiedFiles', ['m' || conv_id], 'previousSummary', case when conv_id % 2 = 0 then last else '' end, 'readFiles', cast([] as varchar[]), 'sourceEntryIds', ids) as varchar)) as own from l), "
    "a as (select conv_id // 10 as family, sha256('[' || string_agg(cast(json_object('graphLevel', conv_id % 3, 'id', 's' || conv_id, 'kind', 'history', 'sourceHash', own) as varchar), ',' order by conv_id) || ']') as together from h group by 1) "
    "select conv_id, own, sha256(cast(json_object('previous', json_object('content', last, 'graphLevel', conv_id % 3, 'id', 's' || conv_id, 'sourceHash', own), 'sourceHash', own) as varchar)) as updated, together from h join a on a.family = conv_id // 10"
)
def summary_hashes(t):
    """The three hashes of summaries: of a conversation, of one that carries on, and of a summary of ten."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    rows = t.conversations.groupBy("conv_id").agg(lines.alias("l"))
    body, ids = F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.transform("l", lambda x: F.concat_ws(":", "conv_id", x["turn"]))
    last, k = F.element_at("l", -1)["text"], F.col("conv_id")
    rows = rows.select("conv_id", last.alias("last"), S.summary_hash(body, F.when(k % 2 == 0, last), ids, F.lit(None).cast("array<string>"), F.array(F.concat(F.lit("m"), k))).alias("own"))
    name = F.concat(F.lit("s"), k)
    previous = F.struct(name.alias("id"), F.col("own").alias("source_hash"), F.col("last").alias("content"), (k % 3).alias("level"))
    children = F.array_sort(F.collect_list(F.struct("conv_id", (k % 3).alias("level"), name.alias("id"), F.lit("history").alias("kind"), F.col("own").alias("source_hash"))))
    family = rows.groupBy(F.floor(k / 10).alias("family")).agg(S.aggregate_hash(children).alias("together"))
    return rows.withColumn("family", F.floor(k / 10)).join(family, "family").select("conv_id", "own", S.update_hash(F.col("own"), previous).alias("updated"), "together")
