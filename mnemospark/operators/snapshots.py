"""Whether a runtime's history is what it says: identities, provenance, and its atomic groups against those that calls and results make.

Declared groups and made ones are compared by a few numbers of each - how many messages, and sums of their hashes - that meet where
they share a call, so no group's members are ever brought together or compared pair by pair.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.planning import components
from mnemospark.storage import materialize

SCHEMA_VERSION = 1


def blank(c: str) -> Column:
    return ~F.coalesce(F.col(c), F.lit("")).rlike(r"\S")


def digest(c: str) -> list[Column]:
    """Numbers that are the same for the same members, in whatever order they come."""
    wide = lambda *x: F.sum(F.xxhash64(*x).cast("decimal(20,0)"))
    return [F.count("*").alias("members"), wide(F.col(c)).alias("sum_one"), wide(F.lit("other"), F.col(c)).alias("sum_two")]


def found(rows: DataFrame, code: str | Column, message: str | None = None, call: str | None = None, n: Column | None = None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    name = code if isinstance(code, Column) else F.lit(code)
    return rows.select("session", name.alias("code"), (F.col(message) if message else nothing).alias("message_id"), (F.col(call) if call else nothing).alias("call_id"), (n if n is not None else F.lit(1)).cast("long").alias("n"))


def tool_uses(messages: DataFrame) -> DataFrame:
    """(session, position, message_id, call_id, called): each call and each result of a message."""
    use = lambda c, called: messages.select("session", "position", "message_id", F.explode(c).alias("call_id"), F.lit(called).alias("called"))
    return use("calls", True).unionByName(use("results", False))


def tool_groups(uses: DataFrame) -> DataFrame:
    """(session, position, root): messages that calls and their results join, named by their first one; results without a call join nothing."""
    first = uses.where("called").groupBy("session", "call_id").agg(F.min("position").alias("a"))
    links = uses.join(first, ["session", "call_id"]).where("position != a").select("session", "a", F.col("position").alias("b")).distinct()
    names = components(links, "session").withColumnRenamed("node", "position")
    places = uses.select("session", "position").distinct().join(names, ["session", "position"], "left")
    return places.withColumn("root", F.coalesce("root", "position"))


def issues(snapshots: DataFrame, messages: DataFrame, declared: DataFrame) -> DataFrame:
    """(session, code, message_id, call_id, n): what is wrong with each snapshot, and how often.

    snapshots: session, schema_version, runtime_id, session_id, revision, project_root. messages: session, position, message_id, source_entry, origin,
    origin_runtime, origin_session, origin_entry, calls, results (arrays of call ids). declared: session, place, group_id, complete, message_ids, call_ids.
    """
    out = [
        found(snapshots.where(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION)), "history-schema-incompatible"),
        found(snapshots.where(blank("runtime_id") | blank("session_id") | blank("revision")), "history-identity-invalid"),
        found(snapshots.where(blank("project_root")), "trusted-project-root-missing"),
    ]
    ids = messages.groupBy("session", "message_id").agg(F.count("*").alias("n"))
    out.append(found(ids.where("n > 1"), "history-message-id-duplicate", "message_id", n=F.col("n") - 1))
    out.append(found(ids.where(blank("message_id")), "history-message-id-missing", "message_id"))
    own = messages.join(snapshots.select("session", "runtime_id", "session_id"), "session")
    elsewhere = (F.col("origin") == "runtime-session") & ~F.col("origin_runtime").eqNullSafe(F.col("runtime_id"))
    odd = ~F.col("origin_session").eqNullSafe(F.col("session_id")) | blank("origin_entry") | ~F.col("source_entry").eqNullSafe(F.col("origin_entry")) | elsewhere
    out.append(found(own.where(odd), "history-provenance-invalid", "message_id"))

    uses = materialize(tool_uses(messages), "uses")
    by_call = uses.groupBy("session", "call_id").agg(F.count_if("called").alias("n_calls"), F.count_if(~F.col("called")).alias("n_results"))
    by_call = materialize(by_call, "calls")
    out.append(found(by_call.where((F.col("n_calls") > 0) & (blank("call_id") | (F.col("n_calls") != 1))), "tool-call-identity-invalid", call="call_id"))
    out.append(found(by_call.where((F.col("n_results") > 0) & (blank("call_id") | (F.col("n_calls") == 0))), "tool-result-orphaned", call="call_id"))

    roots = materialize(tool_groups(uses), "roots")
    held = roots.join(messages.select("session", "position", "message_id"), ["session", "position"]).groupBy("session", "root").agg(*digest("message_id"))
    in_group = uses.join(roots, ["session", "position"]).select("session", "root", "call_id").distinct().join(by_call, ["session", "call_id"])
    whole = in_group.groupBy("session", "root").agg(F.min((F.col("n_calls") == 1) & (F.col("n_results") > 0)).alias("complete"))
    expected = in_group.select("session", "root", "call_id").join(held, ["session", "root"]).join(whole, ["session", "root"])

    out.append(found(declared.where(blank("group_id") | (F.size("message_ids") == 0) | (F.size("call_ids") == 0)), "tool-atomic-group-invalid"))
    named = declared.select("session", "place", F.explode("message_ids").alias("message_id"))
    claims = named.groupBy("session", "message_id").agg(F.count("*").alias("n")).join(ids.select("session", "message_id", F.lit(True).alias("there")), ["session", "message_id"], "left")
    out.append(found(claims.where("there is null"), "tool-atomic-message-missing", "message_id", n=F.col("n")))
    out.append(found(claims.where("there and n > 1"), "tool-atomic-message-overlap", "message_id", n=F.col("n") - 1))
    calls = declared.select("session", "place", F.explode("call_ids").alias("call_id"))
    taken = calls.groupBy("session", "call_id").agg(F.count("*").alias("n"), F.max("place").alias("place"))  # of several groups the last counts
    out.append(found(taken.where("n > 1"), "tool-atomic-call-overlap", call="call_id", n=F.col("n") - 1))
    said = declared.select("session", "place", F.col("complete").alias("said_complete")).join(
        named.groupBy("session", "place").agg(*digest("message_id")).select("session", "place", *[F.col(c).alias(f"said_{c}") for c in ("members", "sum_one", "sum_two")]), ["session", "place"], "left"
    )
    actual = taken.select("session", "call_id", "place").join(said, ["session", "place"])
    both = expected.join(actual, ["session", "call_id"], "left")
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"said_{c}")) for c in ("members", "sum_one", "sum_two", "complete")])
    out.append(found(both.where("place is null"), "tool-atomic-group-missing", call="call_id"))
    out.append(found(both.where(F.col("place").isNotNull() & ~same), "tool-atomic-group-mismatch", call="call_id"))
    out.append(found(taken.join(by_call, ["session", "call_id"], "left_anti"), "tool-atomic-call-unknown", call="call_id"))
    each = functools.reduce(DataFrame.unionByName, out)
    return each.groupBy("session", "code", "message_id", "call_id").agg(F.sum("n").alias("n"))
