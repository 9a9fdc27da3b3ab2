"""Queries over session logs in files: Spark writes them from the given tables to the shared folder, and the seeking source reads them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.plans.registry import query
from mnemospark.sources import logs as L
from mnemospark.storage import materialize, new_path
from mnemospark.streaming import ingest as I

SOME = "floor(doc_id / 100)"
BODIES = f"bodies as (select 'f' || cast({SOME} as bigint) file, string_agg(coalesce(text, '') || chr(10), '' order by doc_id, text) body from documents group by 1)"
CUT = (
    f"{BODIES}, u as (select file, string_split(body, chr(10)) a, unnest(range(1, len(a) + 1)) i from bodies), "
    "s as (select file, i, a[i] line, len(a) total, cast(sum(strlen(a[i]) + 1) over (partition by file order by i) as bigint) e from u)"
)


def document_logs(t):
    """A file for each hundred documents, on disk: (file, size)."""
    folder = new_path(t.documents.sparkSession, "logs")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda d: F.concat(F.coalesce(d["text"], F.lit("")), F.lit("\n")))
    rows = t.documents.groupBy(F.expr(SOME).cast("long").alias("k")).agg(lines.alias("lines"))
    return materialize(L.write_logs(rows.select(F.concat(F.lit(f"{folder}/f"), "k", F.lit(".jsonl")).alias("file"), "lines")), "files")


def short(file):
    return F.regexp_extract(file, r"(\w+)\.jsonl$", 1)


@query(f"with {CUT} select file, e - strlen(line) - 1 as start, e as \"end\", sha256(line) raw_hash from s where i < total and length(trim(line, ' ')) > 0")
def seek_lines(t):
    """Lines of files on disk, each file read by several tasks that meet at line feeds."""
    files = document_logs(t).withColumn("start", F.lit(0).cast("long"))
    return L.lines(files, 20_000).select(short("file").alias("file"), "start", "end", "raw_hash")


@query(
    f"with {CUT}, ends as (select file, max(e) filter (where i < total) as at_end from s group by file), l as (select s.file, at_end, line from s join ends on s.file = ends.file and s.e = ends.at_end and i < total) "
    "select file, at_end as \"offset\", at_end - strlen(line) - 1 as hash_start, sha256(line || chr(10)) hash from l where strlen(line) < 65536"
)
def seek_checkpoints(t):
    """Where the last whole line of each file begins and ends, and its hash, read from the file's end. (No line is longer than the hash may be.)"""
    return L.checkpoints(document_logs(t)).select(short("file").alias("file"), "offset", "hash_start", "hash")


def session_logs(t, folder, phase):
    """Writes each conversation's log: its first three turns, and then, by conv_id % 4: no change, more turns (a file without any is written again), a changed last turn and more, a changed header."""
    k, changed = F.col("conv_id") % 4, F.lit(phase == 2)
    last = F.col("turn") == F.max(F.when(F.col("turn") < 3, F.col("turn"))).over(Window.partitionBy("conv_id"))
    written = lambda text: F.to_json(F.struct(F.lit("message").alias("type"), F.col("turn").cast("string").alias("id"), F.lit("2026-01-01T00:00:00Z").alias("timestamp"), F.struct("role", text.alias("content")).alias("message")))
    rows = t.conversations.withColumns({"_edited": (k == 2) & last, "_was": written(F.col("text")), "_is": written(F.concat(F.substring("text", 1, 3), F.lit("#"), F.substring("text", 5, 1 << 30)))})
    rows = rows.where(k != 0) if phase == 2 else rows.where("turn < 3")
    # a turn that is changed in place has as many bytes before and after, whatever letter goes, and not the same ones
    size = F.greatest(F.octet_length("_was"), F.octet_length("_is"))
    filled = lambda line: F.concat(line, F.repeat(F.lit(" "), size - F.octet_length(line)))
    line = F.when(~F.col("_edited"), F.col("_was")).when(changed, F.concat(F.lit(" "), filled(F.col("_is")))).otherwise(F.concat(filled(F.col("_was")), F.lit(" ")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n")))
    cwd = F.when(changed & (F.col("conv_id") % 4 == 3), "/b").otherwise("/a")
    header = F.to_json(F.struct(F.lit("session").alias("type"), F.col("conv_id").cast("string").alias("id"), F.lit(3).alias("version"), cwd.alias("cwd")))
    files = rows.groupBy("conv_id").agg(lines.alias("lines")).withColumn("lines", F.concat(F.array(F.concat(header, F.lit("\n"))), "lines"))
    return materialize(L.write_logs(files.select(F.concat(F.lit(f"{folder}/"), "conv_id", F.lit(".jsonl")).alias("file"), "lines")), "files")


@query("""
with c as (select conv_id, turn, text, conv_id % 4 k, max(case when turn < 3 then turn end) over (partition by conv_id) as upto from conversations),
now as (select conv_id, k, turn, upto, case when k = 2 and turn = upto then substring(text, 1, 3) || '#' || substring(text, 5) else text end as text from c where k <> 0 or turn < 3),
n as (select conv_id, k, count(*) n, count(*) filter (turn < 3) as n1, sha256(string_agg(text, '|' order by turn)) as texts from now group by 1, 2),
a as (select *, case when k = 0 then 'noop' when k = 1 and n > n1 then 'append' else 'rebuild' end as action from n)
select cast(conv_id as varchar) as session_id, action, case when k = 0 then null when k in (1, 2) and n = n1 then 'changed-in-place' when k = 2 then 'hash-mismatch' when k = 3 then 'header-changed' end as reason,
  case action when 'rebuild' then 2 else 1 end as generation, n as entries, texts, true as to_its_end, cast(case when k = 2 then n1 - 1 else n1 end as bigint) as ok, cast(case when k = 2 then 1 else 0 end as bigint) as changed, 'noop' as after
from a""")
def log_states(t):
    """Logs are ingested, changed in four ways, ingested and ingested again: what was done with each, what the index holds, and which of the lines that were indexed first are still there as they were."""
    spark = t.conversations.sparkSession
    folder, target = new_path(spark, "logs"), new_path(spark, "index")
    session_logs(t, folder, 1)
    I.ingest(spark, folder, target)
    first = materialize(I.indexed(spark, target).select("session_id", "file", "start", "end", "raw_hash"), "first")
    session_logs(t, folder, 2)
    second = materialize(I.ingest(spark, folder, target), "second")
    third = I.ingest(spark, folder, target).select("session_id", F.col("action").alias("after"))
    checked = L.originals(first).groupBy("session_id").agg(F.count(F.when(F.col("status") == "ok", 1)).alias("ok"), F.count(F.when(F.col("status") == "changed", 1)).alias("changed"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("entry_id").cast("long").alias("turn"), "text"))), lambda x: x["text"]), "|")
    found = I.indexed(spark, target).groupBy("session_id").agg(F.sha2(texts, 256).alias("texts"))
    rows = second.select("session_id", "action", "reason", "generation", "entries", (F.col("offset") == F.col("size")).alias("to_its_end"))
    return rows.join(found, "session_id").join(checked, "session_id").join(third, "session_id")
