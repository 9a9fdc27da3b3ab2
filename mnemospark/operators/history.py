"""Entries of conversations: projection, scopes, search channels, and hybrid retrieval packed into token budgets.

Every function takes many sessions and requests at once; a request meets the entries of its own session by an
equi-join on the session, so work spreads over sessions and no pair of foreign ones is made.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from mnemospark.functions import text as T
from mnemospark.storage import materialize


def entries(conversations: DataFrame) -> DataFrame:
    """One row an entry: session_id, entry_id, parent_id, created_at, role, text, tokens. Turns are the clock."""
    entry = lambda turn: F.concat_ws(":", "conv_id", turn)
    parent = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return conversations.select(
        F.col("conv_id").alias("session_id"),
        entry(F.col("turn")).alias("entry_id"),
        F.when(parent.isNotNull(), entry(parent)).alias("parent_id"),
        F.col("turn").alias("created_at"),
        "role",
        "text",
        T.message_tokens(F.col("role"), F.col("text")).alias("tokens"),
    )


@dataclass(frozen=True)
class Scope:
    """What a search may see; None leaves a part open, an empty set authorises nothing."""

    sessions: frozenset | None = None
    excluded: frozenset | None = None
    roles: frozenset | None = None
    after: int | None = None
    before: int | None = None

    def condition(self) -> Column:
        parts = [F.lit(True)]
        if self.sessions is not None:
            parts.append(F.col("session_id").isin(*self.sessions) if self.sessions else F.lit(False))
        if self.excluded:
            parts.append(~F.col("entry_id").isin(*self.excluded))
        if self.roles is not None:
            parts.append(F.col("role").isin(*self.roles) if self.roles else F.lit(False))
        if self.after is not None:
            parts.append(F.col("created_at") > self.after)
        if self.before is not None:
            parts.append(F.col("created_at") < self.before)
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out


def top(rows: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each key with their rank from 0; Spark cuts partitions before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w) - 1).where(F.col(rank) < limit)


def exact_search(found: DataFrame, phrase: str, limit: int) -> DataFrame:
    """Entries of each session that hold ``phrase`` as written, newest first."""
    hits = found.where(F.contains("text", F.lit(phrase)))
    return top(hits, ["session_id"], [F.desc("created_at"), F.desc("entry_id")], limit)


def requests(found: DataFrame) -> DataFrame:
    """The last user entry of each session: session_id, asked_at, request."""
    users = found.where("role = 'user'").groupBy("session_id").agg(F.max(F.struct("created_at", "text")).alias("last"))
    return users.select("session_id", F.col("last.created_at").alias("asked_at"), F.trim(F.coalesce("last.text", F.lit(""))).alias("request"))


def postings(rows: DataFrame, keys: list[str], fields: dict[str, tuple[Column, float]]) -> DataFrame:
    """(keys, dl, term, tf): the inverted index of ``fields`` (text, weight) as a table; dl is a row's weighted length.

    A row's terms are counted where the row is, so nothing is shuffled.
    """
    names, weights = list(fields), [w for _, w in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                yield counted(batch.slice(first, 2000))

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [batch.column(len(keys) + k) for k in range(len(names))]
        ends = [c.offsets.to_numpy().astype(np.int64) for c in lists]
        coded = pc.dictionary_encode(pa.concat_arrays([c.values.slice(e[0], e[-1] - e[0]) for c, e in zip(lists, ends)]))
        at, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        doc = np.concatenate([np.repeat(np.arange(batch.num_rows), np.diff(e)) for e in ends])
        weight = np.concatenate([np.full(e[-1] - e[0], w) for e, w in zip(ends, weights)])
        cell, back = np.unique(doc * n + at, return_inverse=True)
        length = np.bincount(doc, weight, batch.num_rows)
        own = pa.array(cell // n)
        columns = [batch.column(k).take(own) for k in range(len(keys))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(length[cell // n]), coded.dictionary.take(pa.array(cell % n)), pa.array(np.bincount(back, weight, len(cell)))], [*keys, "dl", "term", "tf"])

    words = rows.select(*keys, *[T.terms(text).alias(f"field{k}") for k, (text, _) in enumerate(fields.values())])
    schema = StructType([*[rows.schema[k] for k in keys], StructField("dl", DoubleType()), StructField("term", StringType()), StructField("tf", DoubleType())])
    return words.mapInArrow(run, schema)


def part(tf: Column, dl: Column, df: Column, n: Column, avg_dl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """What a term adds to a document's BM25. idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return F.ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def bm25(index: DataFrame, sizes: DataFrame, wanted: DataFrame, scope: str, doc: str) -> DataFrame:
    """(scope, doc, bm25) of documents with a wanted term; higher is better.

    ``sizes`` has (scope, n_docs, avg_dl), ``wanted`` (scope, term). Of the index only wanted terms are kept, once.
    """
    matched = materialize(index.join(wanted.select(scope, "term").distinct(), [scope, "term"]), "matched")
    df = matched.groupBy(scope, "term").agg(F.count("*").alias("df"))
    scored = matched.join(df, [scope, "term"]).join(sizes, scope)
    return scored.groupBy(scope, doc).agg(F.sum(part(*map(F.col, ("tf", "dl", "df", "n_docs", "avg_dl")))).alias("bm25"))


def sizes(found: DataFrame, scope: str) -> DataFrame:
    words = F.regexp_count(T.lexical(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"))
    return found.groupBy(scope).agg(F.count("*").alias("n_docs"), F.avg(words).alias("avg_dl"))


#: Documents of a request's rarest terms that are scored first, about, to learn what a result has to score.
SEED_ROWS = 4000


def weighted_search(docs: DataFrame, key: str, fields: dict[str, tuple[Column, float]], wanted: DataFrame, request: str, limit: int) -> DataFrame:
    """The ``limit`` best documents of each request by weighted BM25: request, ``key``, score, rank. ``wanted`` has (request, term).

    Not every document that shares a common word with a request is scored for it. The rarest terms alone give scores that the results have at least;
    terms whose greatest possible parts together stay below that can't bring a document in by themselves, so only documents with another
    term are candidates. Their scores are then summed over all terms; the result is exact.
    """
    # written, so that it is known how small requests are, and what they join need not be shuffled
    wanted = materialize(wanted.select(request, "term").distinct(), "wanted")
    words = materialize(wanted.select("term").distinct(), "words")
    length = sum((w * F.regexp_count(T.lexical(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+")) for text, w in fields.values()), F.lit(0.0))
    stats = docs.agg(F.count("*").alias("n"), F.avg(length).alias("a")).first()
    matched = materialize(postings(docs, [key], fields).join(words, "term"), "matched")
    df = materialize(matched.groupBy("term").agg(F.count("*").alias("df")), "df")
    adds = part(F.col("tf"), F.col("dl"), F.col("df"), F.lit(stats.n), F.lit(stats.a))
    parts = matched.join(df, "term").select(key, "term", adds.alias("part"))
    terms = materialize(parts.groupBy("term").agg(F.count("*").alias("df"), F.max("part").alias("most")), "terms")
    asked = materialize(wanted.join(terms, "term"), "asked")
    rarest = Window.partitionBy(request).orderBy("df", "term")
    seeds = asked.withColumn("upto", F.sum("df").over(rarest)).withColumn("nth", F.row_number().over(rarest)).where((F.col("nth") == 1) | (F.col("upto") <= SEED_ROWS))
    seeds = materialize(seeds.select(request, "term"), "seeds")
    seen = parts.join(seeds, "term").groupBy(request, key).agg(F.sum("part").alias("score"))
    least = top(seen, [request], [F.desc("score"), F.asc(key)], limit).groupBy(request).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    weakest = Window.partitionBy(request).orderBy("most", "term")
    needed = asked.withColumn("together", F.sum("most").over(weakest)).join(least, request, "left")
    needed = needed.where(F.coalesce(F.col("n") < limit, F.lit(True)) | (F.col("together") >= F.col("least") - 1e-5))
    needed = materialize(needed.select(request, "term"), "needed")
    chosen = matched.select(key, "term").join(needed, "term").select(request, key).distinct()
    # a candidate meets the terms that its document has, and not each that its request asks for
    scored = chosen.join(parts, key).join(asked.select(request, "term"), [request, "term"]).groupBy(request, key).agg(F.round(F.sum("part"), 6).alias("score"))
    return top(scored, [request], [F.desc("score"), F.asc(key)], limit)


@dataclass(frozen=True)
class Retrieval:
    """Limits and weights of retrieval."""

    max_results: int = 6
    max_tokens: int = 600
    channel_limit: int = 36


def hybrid(found: DataFrame, how: Retrieval = Retrieval()) -> DataFrame:
    """Evidence for each session's current request from its earlier entries.

    Channels: the request's first three words of six letters or more as exact words, their sequence as a phrase, and
    full text by BM25. Candidates of all channels merge by entry; scores add exact 100, phrase 85, or
    60 + max(0, 10 - order) for full text, then role authority, 8 for recency within the candidates, and less a
    thousandth of the tokens. Literal matches go first, then score, time and id; of equal texts the first stays; what
    fits the token budget in that order is packed, later smaller ones too.
    """
    asked = requests(found)
    long_words = F.slice(F.array_distinct(F.filter(T.terms(F.col("request")), lambda t: F.length(t) >= 6)), 1, 3)
    asked = asked.withColumn("exact_terms", long_words).withColumn("phrase", F.array_join(F.slice("exact_terms", 1, 2), " "))
    earlier = found.join(asked, "session_id").where("created_at < asked_at").where("length(trim(text)) > 0")
    plain = F.concat(F.lit(" "), F.array_join(T.terms(F.col("text")), " "), F.lit(" "))
    marked = earlier.withColumn("plain", plain)
    n_exact = F.size(F.filter("exact_terms", lambda t: F.contains(F.col("plain"), F.concat(F.lit(" "), t, F.lit(" ")))))
    has_phrase = (F.size("exact_terms") > 1) & F.contains(F.col("plain"), F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    marked = marked.withColumn("n_exact", n_exact).withColumn("has_phrase", has_phrase).drop("plain")
    wanted = asked.select("session_id", F.explode(F.array_distinct(T.terms(F.col("request")))).alias("term"))
    scored = bm25(postings(earlier, ["session_id", "entry_id"], {"text": (F.col("text"), 1.0)}), sizes(earlier, "session_id"), wanted, "session_id", "entry_id")
    fts = top(scored.withColumn("bm25", F.round("bm25", 6)), ["session_id"], [F.desc("bm25"), F.asc("entry_id")], how.channel_limit, "fts_order").drop("bm25")
    candidates = marked.join(fts, ["session_id", "entry_id"], "left").where("n_exact > 0 or has_phrase or fts_order is not null")
    every = Window.partitionBy("session_id")
    newest, oldest = F.max("created_at").over(every), F.min("created_at").over(every)
    recency = F.when(newest > oldest, (F.col("created_at") - oldest) / (newest - oldest)).otherwise(1.0)
    literal = F.when(F.col("n_exact") > 0, 2).when(F.col("has_phrase"), 1).otherwise(0)
    score = (
        F.when(F.col("n_exact") > 0, 100 + F.least(F.lit(12), 3 * (F.col("n_exact") - 1))).otherwise(0)
        + F.when(F.col("has_phrase"), 85).otherwise(0)
        + F.coalesce(60 + F.greatest(F.lit(0), 10 - F.col("fts_order")), F.lit(0))
        + 15
        + T.role_authority(F.col("role"))
        + 8 * recency
        - F.least(F.lit(12.0), F.col("tokens") / 1000)
    )
    ranked = candidates.withColumn("literal", literal).withColumn("score", T.half_up(score))
    order = [F.desc("literal"), F.desc("score"), F.desc("created_at"), F.asc("entry_id")]
    same = Window.partitionBy("session_id", T.lexical(T.collapsed(F.col("text")))).orderBy(*order)
    kept = ranked.withColumn("copy", F.row_number().over(same)).where("copy = 1")
    kept = top(kept, ["session_id"], order, 4 * how.max_results, "place")
    return greedy(kept, ["session_id"], "place", "tokens", how.max_tokens, how.max_results).select("session_id", "entry_id", "score", "literal", "tokens", "place")


def greedy(rows: DataFrame, keys: list[str], order: str, tokens: str, budget: Column | int, most: int) -> DataFrame:
    """Rows taken in order while they fit; what does not fit is passed over and later ones are tried.

    A fold over each key's candidates, which callers have bounded by a top-k; the rest is a join-free filter.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["tokens"] <= x["budget"]) & (F.size(acc["taken"]) < most)
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["at"]))).otherwise(acc["taken"]).alias("taken"))

    item = F.struct(F.col(order).cast("long").alias("at"), F.col(tokens).cast("long").alias("tokens"), budget.cast("long").alias("budget"))
    every = Window.partitionBy(*keys)
    items = F.array_sort(F.collect_list(item).over(every))
    taken = F.aggregate(items, empty, step, lambda acc: acc["taken"])
    return rows.withColumn("_taken", taken).where(F.array_contains("_taken", F.col(order).cast("long"))).drop("_taken")


#: Candidates of a key that are folded at a time.
FOLD = 200


def greedy_whole(rows: DataFrame, keys: list[str], order: list[Column], tokens: str, budget: int, most: int, rank: str = "place", fold: int = FOLD) -> DataFrame:
    """As `greedy`, over all candidates of a key, with their ``rank`` from 0: ``fold`` of them at a time, the next ones only of keys that still have room.

    A list of ``fold`` candidates is all that a key ever holds together, and most keys need one.
    """
    every = Window.partitionBy(*keys)
    ranked = materialize(rows.withColumn(rank, F.row_number().over(every.orderBy(*order)) - 1).withColumn("_least", F.min(F.col(tokens)).over(every)), "ranked")
    item = F.struct(F.col(rank).cast("long").alias("at"), F.col(tokens).cast("long").alias("tokens"))
    state = "struct<used:bigint,n:int,taken:array<bigint>>"

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["used"] + x["tokens"] <= budget) & (acc["n"] < most)
        used, n = acc["used"] + F.when(fits, x["tokens"]).otherwise(0), acc["n"] + fits.cast("int")
        return F.struct(used.alias("used"), n.alias("n"), F.when(fits, F.concat(acc["taken"], F.array(x["at"]))).otherwise(acc["taken"]).alias("taken")).cast(state)

    taken, open_, k = [], None, 0
    while True:
        part = ranked.where((F.col(rank) >= k) & (F.col(rank) < k + fold))
        if open_ is None:
            part = part.withColumn("_used", F.lit(0).cast("long")).withColumn("_n", F.lit(0))
        else:
            part = part.join(open_, keys)
        lists = part.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("_used").alias("_used"), F.first("_n").alias("_n"), F.min("_least").alias("_least"))
        start = F.struct(F.col("_used").alias("used"), F.col("_n").alias("n"), F.array().cast("array<bigint>").alias("taken")).cast(state)
        done = materialize(lists.select(*keys, F.size("items").alias("_size"), "_least", F.aggregate("items", start, step).alias("s")), "folded")
        taken.append(done.select(*keys, F.explode(F.col("s.taken").cast("array<int>")).alias(rank)))
        open_ = done.where((F.col("_size") == fold) & (F.col("s.n") < most) & (F.col("s.used") + F.col("_least") <= budget)).select(*keys, F.col("s.used").alias("_used"), F.col("s.n").alias("_n"))
        k += fold
        if open_.isEmpty():
            break
    return ranked.drop("_least").join(functools.reduce(DataFrame.union, taken), [*keys, rank])


def turns(found: DataFrame) -> DataFrame:
    """Atomic groups: a user entry and what follows it; entries before the first user are turn 0."""
    upto = Window.partitionBy("session_id").orderBy("created_at")
    return found.withColumn("turn", F.count(F.when(F.col("role") == "user", 1)).over(upto))


def recent_tail(found: DataFrame, limit: int) -> DataFrame:
    """Whole turns from the newest back until the first that no longer fits ``limit`` tokens; later ones stay out."""
    whole = turns(found).groupBy("session_id", "turn").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("entries"))
    newest = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    return whole.withColumn("used", F.sum("tokens").over(newest)).where(F.col("used") <= limit)


def unique_texts(found: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each normalised text (white space collapsed, lower case, no marks) within ``keys``."""
    w = Window.partitionBy(*keys, T.lexical(T.collapsed(F.col("text")))).orderBy(*order)
    return found.withColumn("copy", F.row_number().over(w)).where("copy = 1").drop("copy")


def merge_channels(channels: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of channels (keys, rank) by key, with one rank column for each channel."""
    rows = None
    for name, df in channels.items():
        own = df.select(*keys, F.lit(name).alias("channel"), "rank")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*keys).agg(*[F.min(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in channels])


def calls_and_results(messages: DataFrame) -> DataFrame:
    """Each tool result with the latest call of its id before it (as of its index), null without one."""
    before = Window.partitionBy("session_id", "call_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("kind") == "call", F.col("index")), ignorenulls=True).over(before)
    return messages.withColumn("call_index", call).where("kind = 'result'")
