"""Which durable memories and pins go into a request, and finding them by what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.history import greedy_whole, top

#: What a memory scores from the start, for its scope, for its key and for each matched term.
BASE, OF_SESSION, OF_PROJECT, FOR_KEY, FOR_TERM, MOST_FOR_TERMS = 30, 8, 4, 45, 12, 60
#: Memories that stand in where none matches.
FALLBACK = 3
#: Scores of the kinds of match, the best first.
MATCHES = (("exact-key", 100), ("exact-phrase", 80), ("all-terms", 60), ("partial-terms", 30))


def scored(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """``memories`` (session, id, scope, key, claim, created_at, tokens) of each asking session with score and ``matched``.

    ``asked`` has (session, terms): a request's terms as `described` gives them. A term matches a claim that holds it, regardless of case, and a key that holds its slug.
    """
    low, terms = F.lower(F.coalesce("claim", F.lit(""))), F.transform("terms", F.lower)
    n = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    by_key = F.coalesce((F.col("key") != "") & F.exists(terms, lambda t: F.contains(F.col("key"), T.memory_key(t))), F.lit(False))
    rows = memories.join(asked.select("session", "terms"), "session").withColumns({"_n": n, "_by_key": by_key})
    score = BASE + F.when(F.col("scope") == "session", OF_SESSION).otherwise(OF_PROJECT) + F.when(F.col("_by_key"), FOR_KEY).otherwise(0) + F.least(F.lit(MOST_FOR_TERMS), FOR_TERM * F.col("_n"))
    return rows.withColumns({"score": score, "matched": F.col("_by_key") | (F.col("_n") > 0)}).drop("_n", "_by_key", "terms")


def select(memories: DataFrame, asked: DataFrame, most: int = 6, budget: int = 200) -> DataFrame:
    """The memories that go into each session's request, with ``place`` from 0 in order of score, then the newest, then id.

    Only matched ones, or the first three where none matches; at most ``most`` that fit ``budget`` tokens, passing over those that don't, however many those are.
    """
    order = [F.desc("score"), F.desc("created_at"), F.asc("id")]
    rows = scored(memories, asked)
    hits = rows.where("matched")
    none = rows.join(hits.select("session").distinct(), "session", "left_anti")
    return greedy_whole(hits.unionByName(top(none, ["session"], order, FALLBACK).drop("rank")), ["session"], order, "tokens", budget, most)


def applicable_pins(pins: DataFrame, branch: DataFrame) -> DataFrame:
    """``pins`` (session, id, scope, leaf, inherited) that apply: those of a branch only if its leaf is on the active ``branch`` (session, entry_id), inherited ones always."""
    on = branch.select("session", F.col("entry_id").alias("leaf")).distinct().withColumn("_on", F.lit(True))
    rows = pins.join(on, ["session", "leaf"], "left")
    return rows.where(F.coalesce("inherited", F.lit(False)) | (F.col("scope") != "branch") | F.coalesce("_on", F.lit(False))).drop("_on")


def find(items: DataFrame, queries: DataFrame) -> DataFrame:
    """Items (id, key, body, status, applicable, updated_at) that match each of a few ``queries`` (query), with match, score and rank.

    Exact key, then exact phrase, then all of the query's words, then some of them; white space and case don't count. Equal scores are ordered active first,
    applicable first, newest, then by id. The queries are a stated set: every item is looked at once for each.
    """
    said = lambda c: F.lower(T.collapsed(F.coalesce(c, F.lit(""))))
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    asked = [r.query for r in queries.select("query").distinct().collect()]
    list_ = F.array(*map(F.lit, asked)) if asked else F.array().cast("array<string>")
    rows = items.withColumn("query", F.explode(list_)).withColumns({"_q": said(F.col("query")), "_b": said(F.col("body"))})
    rows = rows.withColumns({"_w": words(F.col("_q")), "_hit": F.array_intersect(words(F.col("_q")), words(F.col("_b")))})
    match = (
        F.when(F.col("key").isNotNull() & (F.col("key") != "") & (said(F.col("key")) == F.col("_q")), MATCHES[0][0])
        .when(F.contains("_b", F.col("_q")), MATCHES[1][0])
        .when((F.size("_w") > 0) & (F.size("_hit") == F.size("_w")), MATCHES[2][0])
        .when(F.size("_hit") > 0, MATCHES[3][0])
    )
    rows = rows.withColumn("match", match).where("match is not null").drop("_q", "_b", "_w", "_hit")
    rows = rows.withColumn("score", F.element_at(F.create_map(*[F.lit(x) for m in MATCHES for x in m]), F.col("match")))
    order = [F.desc("score"), F.asc(F.when(F.col("status") == "active", 0).otherwise(1)), F.desc(F.col("applicable").cast("int")), F.desc("updated_at"), F.asc("id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)) - 1)


def project_mutations(mutations: DataFrame, sessions: DataFrame, sources: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Mutations of each project in order, with whether they count: their source is ready and neither it nor its session is excluded.

    mutations (session, seq, ...) meet sessions (session, project), then, where there are any, sources (session, status) and exclusions (session).
    """
    out = exclusions.select("session").distinct().withColumn("_out", F.lit(True))
    rows = mutations.join(sessions.select("session", "project"), "session").join(sources.select("session", "status"), "session", "left").join(out, "session", "left")
    enabled = F.when(F.col("_out"), False).when(F.col("status").isNull(), True).otherwise(F.col("status") == "ready")
    return rows.withColumn("enabled", enabled).drop("_out")


def memory_sources(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that each memory is drawn from, in the order in which it names them: links (memory, place, entry_id)."""
    return links.join(entries, "entry_id").select("memory", "place", "entry_id", "session_id", "created_at", "tokens")


def pages(rows: DataFrame, order: list[tuple[str, bool]], after: tuple | None, limit: int) -> DataFrame:
    """The ``limit`` rows after the cursor, and one more if there are any, in ``order`` (column, descending); the last column has to be unique.

    Keyset pagination: the cursor is a row's values, so a page costs the same wherever it is.
    """
    if after is not None:
        beyond, same = F.lit(False), F.lit(True)
        for (column, down), value in zip(order, after):
            c, v = F.col(column), F.lit(value)
            beyond = beyond | (same & ((c < v) if down else (c > v)))
            same = same & (c == v)
        rows = rows.where(beyond)
    return rows.orderBy(*[F.desc(c) if down else F.asc(c) for c, down in order]).limit(limit + 1)


def bounded_scan(rows: DataFrame, order: list[tuple[str, bool]], keep, cap: int, limit: int) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows that ``keep`` lets through among the first ``cap`` in ``order``, and whether the cap cut the scan short."""
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    seen = rows.orderBy(*by).limit(cap)
    return seen.where(keep).orderBy(*by).limit(limit), rows.orderBy(*by).limit(cap + 1).count() > cap
