"""Historical retrieval: exact, phrase, full-text and vector channels over many sessions' entries, fused, ranked and packed as excerpts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.vectors import reciprocal_rank_fusion
from mnemospark.operators import history as H
from mnemospark.operators.content import hashed_features
from mnemospark.operators.context import described
from mnemospark.operators.semantic import Index
from mnemospark.storage import dealt, materialize

#: Parts of a candidate's score.
EXACT, PHRASE, FULL_TEXT, ON_BRANCH = 100, 85, 60, 15
#: An excerpt's least and greatest size in characters, what of the budget it leaves out, and how it shrinks.
LEAST_CHARS, MOST_CHARS, HEADER_CHARS, SHRINK, LEAST_REST = 256, 6000, 800, 0.7, 48
#: Characters of an evidence's frame round its excerpt, about, and tokens of its message besides.
FRAME_CHARS, FRAME_TOKENS = 160, 9


@dataclass(frozen=True)
class Request:
    """Limits of a retrieval; a channel that is off finds nothing."""

    exact: bool = True
    fts: bool = True
    semantic: bool = True
    max_results: int = 6
    max_tokens: int = 1200
    similar: int = 80
    least_similarity: float = 0.1


def whole_term(text: Column, term: Column) -> Column:
    """Whether ``term`` stands in ``text`` (both as `lexical` makes them) with no letter, digit or mark right before or after it."""
    edge = r"[^\p{L}\p{N}\p{M}\p{Co}]"
    return F.rlike(text, F.concat(F.lit(rf"(?:^|{edge})\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(rf"\E(?=$|{edge})")))


def vector_hits(sources: DataFrame, requests: DataFrame, scope: str, key: str, limit: int, least: float) -> DataFrame:
    """(scope, key, vector_order, similarity): the sources most like their scope's request, by cosine of hashed features.

    sources (scope, key, text), requests (scope, text). Vectors are sparse and of length 1, so a product is a join on the bucket; request and sources meet within their scope.
    """
    asked = hashed_features(requests.select(scope, "text"), scope).select(scope, "bucket", F.col("value").alias("asked"))
    pairs = sources.select(F.struct(scope, key).alias("id"), "text")
    own = hashed_features(pairs, "id").select(f"id.{scope}", f"id.{key}", "bucket", "value")
    near = own.join(asked, [scope, "bucket"]).groupBy(scope, key).agg(F.sum(F.col("value") * F.col("asked")).alias("similarity")).where(F.col("similarity") >= least)
    return H.top(near, [scope], [F.desc("similarity"), F.asc(key)], limit, "vector_order")


def literal_hits(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """(session_id, entry_id, n, first): how many of a request's literals each entry holds as written, and the place of the first among all hits.

    Of each literal the newest ``limit`` entries count.
    """
    each = rows.select("session_id", "entry_id", "created_at", "text", F.posexplode(column).alias("nth", "literal")).where(F.contains("text", F.col("literal")))
    newest = H.top(each.drop("text"), ["session_id", "literal"], [F.desc("created_at"), F.desc("entry_id")], limit)
    return newest.groupBy("session_id", "entry_id").agg(F.count("*").alias("n"), F.min(F.struct("nth", "rank")).alias("first"))


def entry_sources(rows: DataFrame) -> DataFrame:
    """Entries as sources of a semantic index: scope, source_key, source_hash, text."""
    return rows.select(F.col("session_id").cast("string").alias("scope"), F.col("entry_id").alias("source_key"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("source_hash"), "text")


def indexed_hits(index: Index, rows: DataFrame, requests: DataFrame, how: Request) -> DataFrame:
    """As `vector_hits`, from a stored index: nothing but the requests is embedded, and a vector counts only for the very text it was made of."""
    now = rows.select("session_id", F.col("session_id").cast("string").alias("scope"), F.col("entry_id").alias("source_key")).distinct()
    hits = index.search("entry", requests.select(F.col("session_id").alias("scope"), "text"), entry_sources(rows), how.similar, how.least_similarity)
    hits = hits.join(now, ["scope", "source_key"])
    return hits.select("session_id", F.col("source_key").alias("entry_id"), "similarity", "vector_order")


def candidates(found: DataFrame, asked: DataFrame, how: Request = Request(), index: Index | None = None) -> DataFrame:
    """Scored candidates of each session's request: session_id, entry_id, text, tokens, role, created_at, score, literal, matched, place.

    found (session_id, entry_id, created_at, role, text, tokens) are the entries on the active branch that may be quoted, asked (session_id, request, asked_at): only
    entries before the request, with any text, are eligible, and only those that an exact identifier, a phrase, a whole word of the request or their vector brings in. Vectors come from ``index`` where one is given, else entries are embedded here.
    """
    limit = max(how.max_results, min(100, 6 * how.max_results))
    # what a request holds is a long expression, and is asked for often; few requests would else be one task's
    wanted = described(dealt(asked.withColumnRenamed("request", "text"), "session_id"), "text").where("size(terms) > 0").withColumnRenamed("text", "request")
    wanted = materialize(wanted, "asked")
    rows = found.join(wanted, "session_id").where((F.col("created_at") < F.col("asked_at")) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    rows = materialize(rows.withColumn("lexical", T.lexical(F.col("text"))), "eligible")
    key = ["session_id", "entry_id"]
    exact = literal_hits(rows, "identifiers", limit).select(*key, F.col("n").alias("n_exact"), F.col("first").alias("first_exact")) if how.exact else rows.select(*key, F.lit(0).cast("long").alias("n_exact"), F.lit(None).cast("struct<nth:int,rank:int>").alias("first_exact")).limit(0)
    phrase = literal_hits(rows, "phrases", limit).select(*key, F.col("n").alias("n_phrase"), F.col("first").alias("first_phrase")) if how.exact else rows.select(*key, F.lit(0).cast("long").alias("n_phrase"), F.lit(None).cast("struct<nth:int,rank:int>").alias("first_phrase")).limit(0)
    terms = wanted.select("session_id", F.explode(F.array_distinct(F.flatten(F.transform(F.slice("terms", 1, 16), lambda t: T.terms(t))))).alias("term"))
    scored = H.bm25(H.postings(rows, key, {"text": (F.col("text"), 1.0)}), H.sizes(rows, "session_id"), terms, *key).withColumn("bm25", F.round("bm25", 6))
    fts = H.top(scored.join(rows.select(*key, "created_at"), key), ["session_id"], [F.desc("bm25"), F.desc("created_at"), F.asc("entry_id")], limit, "fts_order").select(*key, "fts_order")
    fts = fts if how.fts else fts.limit(0)
    lexical = exact.join(phrase, key, "full").join(fts, key, "full")
    # candidates in the order in which the channels bring them
    brought = lambda channel, first: F.array(F.lit(channel), F.col(f"{first}.nth"), F.col(f"{first}.rank"))
    arrival = F.when(F.col("first_exact").isNotNull(), brought(0, "first_exact")).when(F.col("first_phrase").isNotNull(), brought(1, "first_phrase")).otherwise(F.array(F.lit(2), F.lit(0), F.col("fts_order")))
    lexical = lexical.withColumn("lexical_order", F.row_number().over(Window.partitionBy("session_id").orderBy(arrival, "entry_id")) - 1).drop("first_exact", "first_phrase")
    if how.semantic and index is not None:
        near = indexed_hits(index, rows, wanted.select("session_id", F.col("request").alias("text")), how)
    elif how.semantic:
        near = vector_hits(rows, wanted.select("session_id", F.col("request").alias("text")), *key, how.similar, how.least_similarity)
    else:
        near = rows.select(*key, F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("vector_order")).limit(0)
    both = lexical.join(near, key, "full").join(rows, key)
    verified = F.filter("terms", lambda t: whole_term(F.col("lexical"), T.lexical(t)))
    both = both.withColumns({"words": F.when(F.col("fts_order").isNotNull(), verified).otherwise(F.array().cast("array<string>")), "n_exact": F.coalesce("n_exact", F.lit(0)), "n_phrase": F.coalesce("n_phrase", F.lit(0))})
    both = materialize(both.where((F.col("n_exact") > 0) | (F.col("n_phrase") > 0) | (F.size("words") > 0) | F.col("vector_order").isNotNull()), "candidates")
    every = Window.partitionBy("session_id")
    newest, oldest = F.max("created_at").over(every), F.min("created_at").over(every)
    held = lambda c: F.size(F.filter(c, lambda t: F.contains(F.col("text"), t)))
    n_words = F.size("words")
    score = (
        F.when(F.col("n_exact") > 0, EXACT + F.least(F.lit(12), 3 * (F.col("n_exact") - 1))).otherwise(0)
        + F.when(F.col("n_phrase") > 0, PHRASE + F.least(F.lit(8), 2 * (F.col("n_phrase") - 1))).otherwise(0)
        + F.when(n_words > 0, FULL_TEXT + F.greatest(F.lit(0), 10 - F.col("fts_order")) + 40 * F.least(F.lit(2), n_words - 1)).otherwise(0)
        + F.when(F.col("vector_order").isNotNull(), F.greatest(F.lit(0.0), F.col("similarity")) * 80 + reciprocal_rank_fusion((F.col("lexical_order"), 1.0), (F.col("vector_order"), 1.0)) * 1500).otherwise(0.0)
        + 12 * held("files") + 10 * held("symbols") + 12 * held("errors") + ON_BRANCH + T.role_authority(F.col("role"))
        + F.when(newest > oldest, 8 * (F.col("created_at") - oldest) / (newest - oldest)).otherwise(0.0)
        - F.least(F.lit(12.0), F.greatest(F.lit(0), F.col("tokens")) / 1000)
    )
    literal = F.when(F.col("n_exact") > 0, 2).when(F.col("n_phrase") > 0, 1).otherwise(0)
    said = lambda c: F.filter(c, lambda t: F.contains(F.col("text"), t))
    out = both.withColumns({"score": T.half_up(score), "literal": literal})
    out = out.withColumn("matched", F.array_distinct(F.concat(said("identifiers"), said("phrases"), F.col("words"))))
    order = Window.partitionBy("session_id").orderBy(F.desc("literal"), F.desc("score"), F.desc("created_at"), F.asc("entry_id"))
    return out.withColumn("place", F.row_number().over(order) - 1).select(*key, "created_at", "role", "text", "tokens", "score", "literal", "matched", "place")


def excerpt_at(text: Column, terms: Column, most: Column) -> Column:
    """Up to ``most`` characters of ``text`` round the first place of any of ``terms``, regardless of case; dots where text is left out."""
    low = F.lower(text)
    at = F.coalesce(F.array_min(F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t))), lambda p: p > 0)), F.lit(1)) - 1
    start = F.greatest(F.lit(0), F.least(F.length(text) - most, at - F.floor(most / 3).cast("int"))).cast("int")
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, most), F.when(start + most < F.length(text), "…").otherwise(""))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def packed(ranked: DataFrame, how: Request = Request()) -> DataFrame:
    """(session_id, entry_id, score, place, excerpt, cost): what goes into each request, in order of place.

    Of equal texts (white space and case aside) the first counts. An excerpt takes what the budget leaves, and shrinks until it fits; what doesn't fit at its smallest is passed over. Nothing is
    added once ``max_results`` are there or fewer than 48 tokens are left. The fold is over a session's candidates, which the channels bound.
    """
    same = Window.partitionBy("session_id", F.lower(T.collapsed(F.col("text")))).orderBy("place")
    rows = ranked.withColumn("_copy", F.row_number().over(same)).where("_copy = 1").drop("_copy")
    items = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", F.length("text").alias("n")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("closed"), F.array().cast("array<struct<place:int,chars:int,cost:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        rest = how.max_tokens - acc["used"]
        closed = acc["closed"] | (F.size(acc["taken"]) >= how.max_results) | (rest < LEAST_REST)
        first = F.least(F.lit(MOST_CHARS), F.greatest(F.lit(LEAST_CHARS), 4 * rest - HEADER_CHARS)).cast("int")
        cost = lambda chars: (FRAME_TOKENS + F.ceil((FRAME_CHARS + F.when(x["n"] <= chars, x["n"]).otherwise(chars + 2)) / 4)).cast("long")
        # 10 steps of 0.7 take the greatest size below the least
        sizes = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.array(first), lambda s, _: F.concat(s, F.array(F.greatest(F.lit(LEAST_CHARS), F.floor(F.element_at(s, -1) * SHRINK)).cast("int"))))
        chars = F.get(F.filter(sizes, lambda c: cost(c) <= rest), F.lit(0))
        takes = ~closed & chars.isNotNull()
        one = F.struct(x["place"].alias("place"), chars.alias("chars"), cost(chars).alias("cost"))
        return F.struct((acc["used"] + F.when(takes, cost(chars)).otherwise(0)).alias("used"), closed.alias("closed"), F.when(takes, F.concat(acc["taken"], F.array(one))).otherwise(acc["taken"]).alias("taken"))

    taken = items.select("session_id", F.explode(F.aggregate("items", start, step, lambda acc: acc["taken"])).alias("x")).select("session_id", "x.*")
    out = rows.join(taken, ["session_id", "place"])
    return out.select("session_id", "entry_id", "score", "place", excerpt_at(F.col("text"), F.col("matched"), F.col("chars")).alias("excerpt"), "cost")


def retrieve(found: DataFrame, asked: DataFrame, how: Request = Request(), index: Index | None = None) -> DataFrame:
    """Evidence for each session's request; see `candidates` and `packed`."""
    return packed(candidates(found, asked, how, index), how)


def recall(found: DataFrame, asked: DataFrame, relation: DataFrame, allowed: tuple[str, ...] = ("normal", "internal"), limit: int = 12, budget: int = 1500, how: Request = Request(semantic=False)) -> DataFrame:
    """(asker, session_id, entry_id, relation, score, excerpt, place): what an asker recalls of the sessions it may look into.

    found as for `candidates`, with the ``classification`` of the whole entry; asked (asker, request, asked_at), relation (asker, session_id, relation) names each session in scope and what it is to the asker. Entries whose class is not
    allowed are left out before they are searched, so no excerpt shows a part of one. A recalled entry comes once for an asker; the best ``limit`` that fit the budget of output tokens stay.
    """
    open_ = found.where(F.coalesce("classification", F.lit("normal")).isin(*allowed))
    each = relation.join(asked, "asker").withColumn("scope", F.concat_ws("\1", F.col("asker").cast("string"), F.col("session_id").cast("string")))
    rows = open_.join(each.select("scope", "session_id", "asker"), "session_id").withColumn("session_id", F.col("scope"))
    hits = candidates(rows.drop("scope", "asker", "classification"), each.select(F.col("scope").alias("session_id"), "request", "asked_at"), how)
    best = hits.join(each.select(F.col("scope").alias("session_id"), "asker", "relation", F.col("session_id").alias("origin")), "session_id")
    best = best.withColumn("_once", F.row_number().over(Window.partitionBy("asker", "origin", "entry_id").orderBy(F.desc("score")))).where("_once = 1")
    order = [F.desc("score"), F.desc("created_at"), F.asc("entry_id")]
    rows = best.withColumn("excerpt", excerpt_at(F.col("text"), F.col("matched"), F.lit(1800))).withColumn("cost", T.text_tokens(F.col("excerpt")) + 24)
    return H.greedy_whole(rows, ["asker"], order, "cost", budget, limit, "at").select("asker", F.col("origin").alias("session_id"), "entry_id", "relation", "score", "excerpt", F.col("at").alias("place"))
