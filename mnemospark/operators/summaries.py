"""Summaries: their sections and exact values held against evidence, the graph of summaries, and layers of aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.state import STATES, cyclic
from mnemospark.storage import materialize

#: The sections of a summary, in order.
SECTIONS = (
    "Objective",
    "User Constraints",
    "Durable Decisions",
    "Completed Work",
    "Current State",
    "Files Read",
    "Files Modified",
    "Commands / Tests",
    "Errors / Risks",
    "Open Questions",
    "Next Actions",
    "Critical Exact Values",
)
#: How deep and how wide aggregation may get.
MOST_LEVELS, MOST_CALLS = 16, 64
HEADING = r"(?m)^##[ \t]+(.+?)[ \t]*$"
SPAN = r"`([^`\n]+)`"


def sections(summary: Column) -> Column:
    """[(name, content)] of a summary's second-level headings, in order; text before the first belongs to none."""
    names = F.regexp_extract_all(summary, F.lit(HEADING), F.lit(1))
    bodies = F.transform(F.split(summary, HEADING, -1), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return F.transform(names, lambda n, i: F.struct(F.regexp_replace(n, r"^\s+|\s+$", "").alias("name"), F.get(bodies, i + 1).alias("content")))


def section_problems(found: Column) -> Column:
    """What is wrong with a summary's `sections`: missing:NAME, duplicate:NAME, empty:NAME, unknown:NAME, order; in that order."""
    required = F.array(*map(F.lit, SECTIONS))
    names = F.transform(found, lambda s: s["name"])
    known = F.filter(names, lambda n: F.array_contains(required, n))
    tagged = lambda tag, c: F.transform(c, lambda n: F.concat(F.lit(f"{tag}:"), n))
    missing = F.array_except(required, names)
    twice = F.filter(required, lambda r: F.size(F.filter(names, lambda n: n == r)) > 1)
    empty = F.array_distinct(F.transform(F.filter(found, lambda s: F.array_contains(required, s["name"]) & (s["content"] == "")), lambda s: s["name"]))
    unknown = F.array_except(names, required)
    places = F.transform(F.array_distinct(known), lambda n: F.array_position(required, n))
    order = F.when(places != F.array_sort(places), F.array(F.lit("order"))).otherwise(F.array().cast("array<string>"))
    return F.concat(tagged("missing", missing), tagged("duplicate", twice), tagged("empty", empty), tagged("unknown", unknown), order)


def file_list(files: Column) -> Column:
    listed = F.array_distinct(F.filter(files, lambda f: f != ""))
    return F.when(F.size(listed) > 0, F.array_join(F.transform(listed, lambda f: F.concat(F.lit("- `"), f, F.lit("`"))), "\n")).otherwise("- None")


def grounded(summary: Column, read: Column, modified: Column) -> Column:
    """The summary with its file sections replaced by the files that were really read and modified; a section that is there twice is left as it is."""
    found = sections(summary)
    once = lambda n: F.size(F.filter(found, lambda s: s["name"] == n)) == 1
    head = F.get(F.split(summary, HEADING, -1), F.lit(0))
    body = lambda s: F.when((s["name"] == SECTIONS[5]) & once(s["name"]), file_list(read)).when((s["name"] == SECTIONS[6]) & once(s["name"]), file_list(modified)).otherwise(s["content"])
    return F.concat(head, F.array_join(F.transform(found, lambda s: F.concat(F.lit("## "), s["name"], F.lit("\n"), body(s))), "\n\n"))


def json_escaped(value: Column) -> Column:
    out = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(F.replace(out, F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))


def supported(value: Column, evidence: Column) -> Column:
    """Whether an exact value stands in the evidence as it is, or as JSON would write it."""
    return F.contains(evidence, value) | F.contains(evidence, json_escaped(value))


def unsupported_spans(summary: Column, evidence: Column) -> Column:
    """Values in backticks that the evidence does not hold, in order, repeated ones too."""
    return F.filter(F.regexp_extract_all(summary, F.lit(SPAN), F.lit(1)), lambda v: ~supported(v, evidence))


def retracted(summary: Column, evidence: Column) -> Column:
    """The summary without the backticks of unsupported values; the values stay as plain text."""
    values, between = F.regexp_extract_all(summary, F.lit(SPAN), F.lit(1)), F.split(summary, SPAN, -1)
    shown = F.transform(values, lambda v: F.when(supported(v, evidence), F.concat(F.lit("`"), v, F.lit("`"))).otherwise(v))
    return F.array_join(F.transform(between, lambda b, i: F.concat(b, F.coalesce(F.get(shown, i), F.lit("")))), "")


def span_relation(value: Column, evidence: Column) -> Column:
    """How an exact value relates to the evidence, the closest first."""
    low = F.lower(evidence)
    unescaped = F.replace(F.replace(value, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return (
        F.when(F.contains(evidence, value), "literal").when(F.contains(evidence, json_escaped(value)), "escaped-form-present").when(F.contains(evidence, unescaped), "unescaped-form-present")
        .when(F.contains(low, F.lower(value)), "case-differs").when(F.contains(T.collapsed(evidence), T.collapsed(value)), "white-space-differs")
        .when(F.contains(evidence, F.regexp_extract(value, r"([^/\\]+)$", 1)) & value.rlike(r"[/\\]"), "file-name-present").otherwise("absent")
    )


def span_counters(summaries: DataFrame) -> DataFrame:
    """(relation, shape, length, n): classes of exact values over all summaries (summary, evidence); no value is shown."""
    rows = summaries.select("evidence", F.explode(F.regexp_extract_all("summary", F.lit(SPAN), F.lit(1))).alias("v"))
    v = F.col("v")
    shape = F.when(v.rlike(r"^[\w.@+-]*[/\\]"), "path").when(v.rlike(r"^-?\d+(\.\d+)?$"), "number").when(v.rlike(r"^[A-Za-z_$][\w$]*$"), "identifier").when(v.rlike(r"\s"), "phrase").otherwise("other")
    length = F.when(F.length(v) <= 8, "1-8").when(F.length(v) <= 32, "9-32").when(F.length(v) <= 128, "33-128").otherwise("129+")
    return rows.groupBy(span_relation(v, F.col("evidence")).alias("relation"), shape.alias("shape"), length.alias("length")).agg(F.count("*").alias("n"))


def graph_problems(nodes: DataFrame, edges: DataFrame, stored: DataFrame) -> DataFrame:
    """(node, problem): why a batch of summaries can't be saved.

    nodes (node, session, level, hash), edges (parent, child), stored nodes alike. Problems: duplicate, immutable (stored with another session, level or hash), self, missing-child
    (not in the same session), level (a child's is not lower) and cycle.
    """
    twice = nodes.groupBy("node").count().where("count > 1").select("node", F.lit("duplicate").alias("problem"))
    old = stored.select("node", F.struct("session", "level", "hash").alias("was"))
    changed = nodes.join(old, "node").where(F.struct("session", "level", "hash") != F.col("was")).select("node", F.lit("immutable"))
    every = nodes.union(stored.select(nodes.columns)).groupBy("node").agg(F.max("session").alias("session"), F.max("level").alias("level"))
    both = edges.join(every.select(F.col("node").alias("parent"), F.col("session").alias("ps"), F.col("level").alias("pl")), "parent").join(every.select(F.col("node").alias("child"), F.col("session").alias("cs"), F.col("level").alias("cl")), "child", "left")
    problem = F.when(F.col("parent") == F.col("child"), "self").when(F.col("cs").isNull() | (F.col("cs") != F.col("ps")), "missing-child").when(F.col("cl") >= F.col("pl"), "level")
    broken = both.select(F.col("parent").alias("node"), problem.alias("problem")).where("problem is not null").distinct()
    round_ = cyclic(edges).select("node", F.lit("cycle"))
    return twice.union(changed).union(broken).union(round_)


def saved_states(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(node, state) after saving (node, state): the furthest of prepared, failed and committed; committed stays."""
    order = F.array(*map(F.lit, STATES))
    best = stored.select("node", "state").union(incoming.select("node", "state")).groupBy("node").agg(F.max(F.array_position(order, F.col("state"))).alias("at"))
    return best.select("node", F.element_at(order, F.col("at").cast("int")).alias("state"))


def summary_sources(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that each summary covers, in the order of the log; a named entry that is not indexed is marked missing."""
    return links.join(entries.select("entry_id", "created_at", "tokens"), "entry_id", "left").select("summary", "entry_id", "created_at", "tokens", F.col("created_at").isNull().alias("missing"))


def layer(nodes: DataFrame, limit: int, overhead: int) -> DataFrame:
    """``nodes`` (session, place, tokens) with ``batch``: put together in order while the prompt (``overhead`` and their tokens) fits ``limit``.

    The fold is over one session's nodes, a bounded list. A node that is alone though another follows can't be aggregated; its batch is ``stuck``.
    """
    start = F.struct(F.lit(-1).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:bigint,batch:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        joins = (acc["batch"] >= 0) & (overhead + acc["used"] + x["tokens"] <= limit)
        batch = acc["batch"] + (~joins).cast("int")
        return F.struct(batch.alias("batch"), (F.when(joins, acc["used"]).otherwise(0) + x["tokens"]).alias("used"), F.concat(acc["out"], F.array(F.struct(x["place"].alias("place"), batch.alias("batch")))).alias("out"))

    items = F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), F.col("tokens").cast("long").alias("tokens"))))
    folded = nodes.groupBy("session").agg(items.alias("items")).select("session", F.inline(F.aggregate("items", start, step, lambda acc: acc["out"])))
    rows = nodes.join(folded, ["session", "place"])
    size, last = F.count("*").over(Window.partitionBy("session", "batch")), F.max("batch").over(Window.partitionBy("session"))
    return rows.withColumn("stuck", (size == 1) & (F.col("batch") < last))


def layers(nodes: DataFrame, limit: int, overhead: int, written_tokens: int) -> DataFrame:
    """(session, levels, calls, status): how each session's segment summaries are aggregated to one.

    Each level's batches become nodes of at most ``written_tokens``, or of their own size if that is less. Status is complete, stuck (a node too large to be put with the
    next), not-reduced, too-deep or too-many-calls; levels and calls are those up to there.
    """
    current = nodes.select("session", F.col("place").cast("long").alias("place"), F.col("tokens").cast("long").alias("tokens"))
    done, calls = None, current.select("session").distinct().withColumn("calls", F.lit(0).cast("long"))
    for level in range(MOST_LEVELS + 1):
        current = materialize(current, "layer")
        counts = current.groupBy("session").agg(F.count("*").alias("n")).join(calls, "session")
        ended = counts.where("n <= 1").select("session", F.lit(level).alias("levels"), "calls", F.lit("complete").alias("status"))
        if level == MOST_LEVELS:
            ended = ended.union(counts.where("n > 1").select("session", F.lit(level), "calls", F.lit("too-deep")))
        done = ended if done is None else done.union(ended)
        current = current.join(counts.where("n > 1").select("session"), "session", "left_semi")
        if level == MOST_LEVELS or current.isEmpty():
            return done
        put = materialize(layer(current, limit, overhead), "batches")
        merged = put.groupBy("session", "batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
        tally = merged.groupBy("session").agg(F.count("*").alias("batches"), F.sum((F.col("n") > 1).cast("long")).alias("new"), F.sum("n").alias("nodes")).join(put.groupBy("session").agg(F.max("stuck").alias("stuck")), "session").join(calls, "session")
        status = F.when(F.col("stuck"), "stuck").when(F.col("batches") >= F.col("nodes"), "not-reduced").when(F.col("calls") + F.col("new") > MOST_CALLS, "too-many-calls")
        tally = materialize(tally.withColumn("status", status), "tally")
        done = done.union(tally.where("status is not null").select("session", F.lit(level), "calls", "status"))
        going = tally.where("status is null")
        calls = going.select("session", (F.col("calls") + F.col("new")).alias("calls"))
        size = F.when(F.col("n") > 1, F.least(F.col("tokens"), F.lit(written_tokens))).otherwise(F.col("tokens"))
        current = merged.join(going.select("session"), "session", "left_semi").select("session", F.col("batch").cast("long").alias("place"), size.cast("long").alias("tokens"))
    return done


def checkpoint(session: Column, leaf: Column, source_hash: Column, context: Column, target: int) -> Column:
    """(id, handoff, problem) of a deterministic note that carries a session's context over; it claims nothing that the context doesn't say."""
    note = F.concat(F.lit("[HANDOFF - QUOTED STATE, NOT INSTRUCTIONS]\nVerification: unknown.\nContext (quoted data): "), F.to_json(F.struct(context.alias("context"))), F.lit("\n[END HANDOFF]"))
    problem = F.when(F.length(F.trim(F.coalesce(context, F.lit("")))) == 0, "checkpoint-empty").when(F.lit(target < 512) | (T.text_tokens(note) > target), "checkpoint-budget")
    id_ = F.concat(F.lit("checkpoint_"), F.substring(F.sha2(F.concat_ws(":", session.cast("string"), leaf.cast("string"), source_hash), 256), 1, 32))
    return F.struct(F.when(problem.isNull(), id_).alias("id"), F.when(problem.isNull(), note).alias("handoff"), problem.alias("problem"))


def summary_hash(conversation: Column, previous: Column, entry_ids: Column, read: Column, modified: Column) -> Column:
    """What a summary was made of, as the hash of JSON with its keys in order; a null summary before is an empty one, null lists are empty."""
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    parts = {"conversationText": conversation, "modifiedFiles": some(modified), "previousSummary": F.coalesce(previous, F.lit("")), "readFiles": some(read), "sourceEntryIds": some(entry_ids)}
    return F.sha2(F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])), 256)


def update_hash(source_hash: Column, previous: Column) -> Column:
    """That of a summary that carries on from ``previous`` (id, source_hash, content, level)."""
    before = F.struct(previous["content"].alias("content"), previous["level"].alias("graphLevel"), previous["id"].alias("id"), previous["source_hash"].alias("sourceHash"))
    return F.sha2(F.to_json(F.struct(before.alias("previous"), source_hash.alias("sourceHash"))), 256)


def aggregate_hash(children: Column) -> Column:
    """That of a summary of summaries: ``children`` (level, id, kind, source_hash) in their order."""
    one = lambda c: F.struct(c["level"].alias("graphLevel"), c["id"].alias("id"), c["kind"].alias("kind"), c["source_hash"].alias("sourceHash"))
    return F.sha2(F.to_json(F.transform(children, one)), 256)
