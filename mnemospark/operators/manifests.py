"""Manifests: what a request was made of, what it cost, and how little of it is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.text import half_up

#: Tokens besides a system prompt's and a tool's own.
SYSTEM_FRAME, TOOL_FRAME = 8, 12


def observed(systems: DataFrame, tools: DataFrame, messages: DataFrame) -> DataFrame:
    """(session, place, kind, source, role, tokens): a manifest's items, the system prompt first, then tools by name, then messages in order.

    systems (session, prompt), tools (session, name, definition), messages (session, index, role, tokens). The last user message is the current one; summaries and tool results have kinds of their own.
    """
    last = Window.partitionBy("session")
    current = F.max(F.when(F.col("role") == "user", F.col("index"))).over(last)
    kind = F.when(F.col("index") == current, "current").when(F.col("role").isin("compactionSummary", "branchSummary"), "summary").when(F.col("role").isin("toolResult", "bashExecution"), "tool-result").otherwise("message")
    null = F.lit(None).cast("string")
    own = systems.where("length(prompt) > 0").select("session", F.lit(0).alias("part"), F.lit("").alias("by"), F.lit(0).cast("long").alias("nth"), F.lit("system").alias("kind"), F.lit("system-prompt").alias("source"), null.alias("role"), (T.text_tokens(F.col("prompt")) + SYSTEM_FRAME).alias("tokens"))
    of_tools = tools.select("session", F.lit(1).alias("part"), F.col("name").alias("by"), F.lit(0).cast("long").alias("nth"), F.lit("tool").alias("kind"), F.concat(F.lit("tool:"), "name").alias("source"), null.alias("role"), (T.text_tokens(F.col("definition")) + TOOL_FRAME).alias("tokens"))
    of_messages = messages.select("session", F.lit(2).alias("part"), F.lit("").alias("by"), F.col("index").cast("long").alias("nth"), kind.alias("kind"), F.concat(F.lit("message:"), "index").alias("source"), "role", "tokens")
    rows = own.unionByName(of_tools).unionByName(of_messages)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session").orderBy("part", "by", "nth")) - 1).drop("part", "by", "nth")


def composition(items: DataFrame) -> DataFrame:
    """(session, system_tokens, tool_tokens, message_tokens, messages, tools, estimated) of `observed` items."""
    of = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("tokens"))), F.lit(0))
    others = ~F.col("kind").isin("system", "tool")
    return items.groupBy("session").agg(
        of("system").alias("system_tokens"), of("tool").alias("tool_tokens"), F.coalesce(F.sum(F.when(others, F.col("tokens"))), F.lit(0)).alias("message_tokens"), F.count_if(others).alias("messages"), F.count_if(F.col("kind") == "tool").alias("tools"),
        F.sum("tokens").alias("estimated"),
    )


def shown(items: DataFrame, filter: str) -> DataFrame:
    """Items that a display asks for: included, excluded or all."""
    if filter not in ("included", "excluded", "all"):
        raise ValueError("filter has to be included, excluded or all")
    return items if filter == "all" else items.where(F.col("included") == F.lit(filter == "included"))


def projected(items: DataFrame, whole_bytes: int = 256 * 1024, most_bytes: int = 1024 * 1024, ends: int = 128) -> DataFrame:
    """(manifest, mode, kept): how each manifest is stored, and how many of its items.

    A small one whole; of a larger one the first and last ``ends`` items that were excluded, and all that were included; one that is larger still is skipped. items (manifest, place, included, bytes).
    """
    first, last = Window.partitionBy("manifest", "included").orderBy("place"), Window.partitionBy("manifest", "included").orderBy(F.desc("place"))
    rows = items.withColumns({"_a": F.row_number().over(first), "_z": F.row_number().over(last)})
    sums = rows.groupBy("manifest").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"), F.count_if(F.col("included") | (F.col("_a") <= ends) | (F.col("_z") <= ends)).alias("ends"))
    mode = F.when(F.col("bytes") <= whole_bytes, "whole").when(F.col("bytes") <= most_bytes, "projected").otherwise("skipped")
    return sums.select("manifest", mode.alias("mode"), F.when(mode == "whole", F.col("items")).when(mode == "projected", F.col("ends")).otherwise(0).alias("kept"))


def classified(items: DataFrame, key: str) -> DataFrame:
    """A manifest's items by classification: key, classification, items, tokens; none stated is normal."""
    return items.groupBy(key, F.coalesce("classification", F.lit("normal")).alias("classification")).agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


def recorded_usage(manifests: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests (id, estimated, actual) with the first report (id, at, actual) of each that had none, and the calibration samples that come of it.

    A manifest's usage is recorded once: later reports and reports for one that has it already change nothing and give no sample.
    """
    first = reports.where("actual > 0").groupBy("id").agg(F.min(F.struct("at", "actual")).alias("_first"))
    rows = manifests.join(first, "id", "left")
    fresh = F.col("actual").isNull() & F.col("_first").isNotNull()
    rows = rows.withColumn("_fresh", fresh)
    samples = rows.where("_fresh and estimated > 0").select("id", F.col("_first.at").alias("at"), "estimated", F.col("_first.actual").alias("actual"), half_up(F.col("_first.actual") / F.col("estimated")).alias("ratio"))
    return rows.withColumn("actual", F.when(F.col("_fresh"), F.col("_first.actual")).otherwise(F.col("actual"))).drop("_first", "_fresh"), samples


def saved(stored: DataFrame, new: DataFrame, keep: int = 128, most_rows: int = 32, most_bytes: int = 8 * 1024 * 1024) -> DataFrame:
    """``stored`` and ``new`` manifests (session, id, created_at, bytes) after a write, which also removes a bounded number of old ones."""
    from mnemospark.operators.state import bounded_prune

    rows = stored.join(new.select("id"), "id", "left_anti").unionByName(new)
    gone = bounded_prune(rows, keep, most_rows, most_bytes).select("session", "id")
    return rows.join(gone, ["session", "id"], "left_anti")


def put(stored: DataFrame, contents: DataFrame) -> DataFrame:
    """Objects (sha, content, status) after ``contents`` (content) were put: a new one is added, a corrupt one repaired, one that is there stays.

    An object is corrupt if its content no longer has its address; a corrupt one that nothing repairs is set aside, not given out.
    """
    fresh = contents.select(F.sha2("content", 256).alias("sha"), "content").groupBy("sha").agg(F.first("content").alias("fresh"))
    rows = stored.join(fresh, "sha", "full")
    sound = F.coalesce(F.sha2("content", 256) == F.col("sha"), F.lit(False))
    status = F.when(F.col("content").isNull(), "added").when(sound, "available").when(F.col("fresh").isNotNull(), "repaired").otherwise("quarantined")
    return rows.select("sha", F.when(sound, F.col("content")).otherwise(F.col("fresh")).alias("content"), status.alias("status"))


def offloaded(results: DataFrame, inline: Column | int) -> DataFrame:
    """Tool results (call, text, ...) whose text is too long, with a reference in its place; copies share one object.

    Adds ``sha`` and ``offloaded``; a result that fits stays as it is.
    """
    limit = F.lit(inline) if isinstance(inline, int) else inline
    large = F.length("text") > limit
    sha = F.sha2("text", 256)
    note = F.concat(F.lit("[large output stored as artifact://sha256/"), sha, F.lit(", "), F.length("text").cast("string"), F.lit(" characters]"))
    return results.select(*[c for c in results.columns if c != "text"], F.when(large, note).otherwise(F.col("text")).alias("text"), F.when(large, sha).alias("sha"), large.alias("offloaded"))
