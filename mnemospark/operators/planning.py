"""Atomic groups of messages and the managed context plan of many sessions at once.

Messages are rows (session, index, role, tokens, calls, result_of): ``calls`` are the ids of the tool calls that a message makes, ``result_of`` the id that it
answers. A session's groups, and the choice among them, are windows and one fold over a session's supplements, which callers bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import half_up
from mnemospark.operators.history import calls_and_results
from mnemospark.storage import drop_path, written

SUMMARY_ROLES = ("compactionSummary", "branchSummary")


def components(links: DataFrame, scope: str) -> DataFrame:
    """(scope, node, root): the least node that links (scope, a, b) join a node with. Rounds grow with the logarithm of a chain's length."""
    spark = links.sparkSession
    both, path = written(links.select(scope, "a", "b").union(links.select(scope, "b", "a")).where("a != b").distinct(), "links")
    names, old = written(both.groupBy(scope, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "names")
    while True:
        near = both.join(names.withColumnRenamed("node", "b"), [scope, "b"]).groupBy(scope, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = names.join(near, [scope, "node"]).select(scope, "node", F.col("root").alias("before"), F.least("root", "near").alias("root"))
        up = names.select(scope, F.col("node").alias("root"), F.col("root").alias("top"))
        rows, new = written(step.join(up, [scope, "root"], "left").select(scope, "node", "before", F.least("root", "top").alias("root")), "names")
        same = rows.where("before != root").isEmpty()
        drop_path(spark, old)
        names, old = rows.select(scope, "node", "root"), new
        if same:
            drop_path(spark, path)
            return names


def relations(messages: DataFrame) -> DataFrame:
    """(session, call_id, call_index, index): each result with the latest call of its id before it; no call_index for an orphan."""
    calls = messages.select(F.col("session").alias("session_id"), F.explode("calls").alias("call_id"), "index", F.lit("call").alias("kind")).distinct()
    results = messages.where("result_of is not null").select(F.col("session").alias("session_id"), F.col("result_of").alias("call_id"), "index", F.lit("result").alias("kind"))
    return calls_and_results(calls.unionByName(results)).select(F.col("session_id").alias("session"), "call_id", "call_index", "index")


def drafts(messages: DataFrame) -> DataFrame:
    """``messages`` with ``draft`` and its ``kind``: a user's turn, a summary by itself, or a prefix before any turn.

    ``isolated`` messages, where the column is there, are turns of their own that no message joins.
    """
    alone = F.coalesce(F.col("isolated"), F.lit(False)) if "isolated" in messages.columns else F.lit(False)
    order = Window.partitionBy("session").orderBy("index")
    summary = F.coalesce(F.col("role").isin(*SUMMARY_ROLES), F.lit(False)) & ~alone
    opens = alone | summary | (F.col("role") == "user")
    rows = messages.withColumns({"_single": alone | summary, "_opens": F.coalesce(opens, F.lit(False)), "_kind": F.when(alone, "turn").when(summary, "summary").when(F.col("role") == "user", "turn").otherwise("prefix")})
    begins = F.col("_opens") | F.coalesce(F.lag("_single").over(order), F.lit(True))
    rows = rows.withColumn("_begins", begins).withColumn("draft", F.sum(F.col("_begins").cast("int")).over(order))
    first = Window.partitionBy("session", "draft").orderBy("index")
    return rows.withColumn("kind", F.first("_kind").over(first)).drop("_single", "_opens", "_kind", "_begins")


def grouped(messages: DataFrame) -> DataFrame:
    """``messages`` with the ``root`` of their atomic group: drafts that a call and its result join are one group."""
    rows = drafts(messages)
    place = rows.select("session", "index", "draft")
    pairs = relations(messages).where("call_index is not null")
    links = pairs.join(place.select("session", F.col("index").alias("call_index"), F.col("draft").alias("a")), ["session", "call_index"]).join(place.withColumnRenamed("draft", "b"), ["session", "index"])
    names = components(links.select("session", "a", "b"), "session").withColumnRenamed("node", "draft")
    done = pairs.select("session", F.col("call_index").alias("index")).distinct().withColumn("exchange", F.lit(True))
    rows = rows.join(names, ["session", "draft"], "left").withColumn("root", F.coalesce("root", "draft"))
    return rows.join(done, ["session", "index"], "left").withColumn("exchange", F.coalesce("exchange", F.lit(False)))


def groups(rows: DataFrame) -> DataFrame:
    """(session, root, kind, first, last, messages, tokens, exchange) of each atomic group of `grouped` rows."""
    turn, summary = F.max((F.col("kind") == "turn").cast("int")), F.min((F.col("kind") == "summary").cast("int"))
    return rows.groupBy("session", "root").agg(
        F.when(turn == 1, "turn").when(summary == 1, "summary").otherwise("prefix").alias("kind"), F.min("index").alias("first"), F.max("index").alias("last"), F.count("*").alias("messages"), F.sum("tokens").alias("tokens"), F.max("exchange").alias("exchange"),
    )


def broken_exchanges(messages: DataFrame) -> DataFrame:
    """(session, call_id, problem) of a selection (column ``selected``) that parts a call from its results, each once.

    Problems: no-result, missing-result, no-call. A call without any result can't be selected by itself.
    """
    pairs = relations(messages)
    picked = messages.select("session", "index", "selected")
    results = pairs.join(picked, ["session", "index"])
    calls = messages.select("session", F.col("index").alias("call_index"), F.explode("calls").alias("call_id"), F.col("selected").alias("called")).distinct()
    answers = results.groupBy("session", "call_id", "call_index").agg(F.count("*").alias("n"), F.sum(F.col("selected").cast("int")).alias("kept"))
    both = calls.join(answers.where("call_index is not null"), ["session", "call_id", "call_index"], "left")
    problem = F.when(F.col("called") & F.col("n").isNull(), "no-result").when(F.col("called") & (F.col("kept") < F.col("n")), "missing-result").when(~F.col("called") & (F.col("kept") > 0), "no-call")
    orphan = answers.where("call_index is null and kept > 0").select("session", "call_id", F.lit("no-call").alias("problem"))
    return both.select("session", "call_id", problem.alias("problem")).where("problem is not null").unionByName(orphan).distinct()


@dataclass(frozen=True)
class Limits:
    """Tokens that a plan may hold, by what they are for."""

    hard: int = 1600
    target: int = 1200
    fixed: int = 100
    tail: int = 500
    pinned: int = 400
    memory: int = 200
    retrieval: int = 400
    project: int = 300
    summary: int = 300
    rescue: bool = True
    placement: str = "latest-user"


#: What a group's score starts from, by why it is there.
PRIORITY = {"current": 1000, "pin": 900, "recent": 100, "summary": 75, "history": 40}
CATEGORIES = ("memory", "retrieval", "project", "summary")
#: Where supplements stand.
PLACEMENTS = ("latest-user", "stable-prefix", "hybrid")


def prefix_place(messages: DataFrame) -> DataFrame:
    """(session, last_user): the index of each session's last user message, null without one."""
    return messages.groupBy("session").agg(F.max(F.when(F.col("role") == "user", F.col("index"))).alias("last_user"))


def managed_plan(messages: DataFrame, supplements: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Which messages and supplements of each session go into its request: (session, index, position, supplement, group, kind, tokens, score, selected, mode, why).

    ``messages`` have ``pinned`` too; ``supplements`` are (session, id, category, score, tokens), where category is pin, memory, retrieval or project, each a group of its own. They stand right
    before the last user message, or by ``limits.placement`` after the leading instructions (stable-prefix), or there but for retrieval (hybrid), so that requests have their beginnings in common; ``position`` is a part's place among all.
    Supplements with a ``promoted`` rank (optional) are tried first in its order, whatever their category. The current turn and pins are in whatever they cost. Recent turns follow from the newest back while they fit the tail
    and the window; the first that doesn't closes the tail, but the turn right before the current one is kept if only the tail is too short for it. Then supplements by category, score and place, and
    summaries from the newest, are taken while they fit their category and the window, passing over what doesn't. If mandatory parts alone are too large, or a call
    would be parted from its result, the plan falls back: all messages stay and no supplement. Sessions without a user message take no supplements.
    """
    hard, target = max(0, limits.hard - limits.fixed), max(0, limits.target - limits.fixed)
    marks = prefix_place(messages)
    if limits.placement not in PLACEMENTS:
        raise ValueError(f"placement has to be one of {PLACEMENTS}")
    # leading instructions, supplements of the prefix, what else is before the last user, supplements of the turn, the turn
    leads = messages.groupBy("session").agg(F.min(F.when(~F.col("role").isin("system", "developer"), F.col("index"))).alias("lead"))
    before = F.col("last_user").isNull() | (F.col("index") < F.col("last_user"))
    own = messages.join(marks, "session").join(leads, "session").withColumn("_at", F.when(before & (F.col("index") < F.coalesce("lead", F.lit(2**31 - 1))), 0).when(before, 2).otherwise(4)).drop("lead")
    extra = supplements.join(marks.where("last_user is not null"), "session")
    nth = F.row_number().over(Window.partitionBy("session").orderBy("id"))
    in_prefix = F.lit(limits.placement == "stable-prefix") | (F.lit(limits.placement == "hybrid") & (F.col("category") != "retrieval"))
    place = F.when(in_prefix, 1).otherwise(3)
    if "promoted" not in extra.columns:
        extra = extra.withColumn("promoted", F.lit(None).cast("int"))
    columns = {"role": F.lit("user"), "calls": F.array().cast("array<string>"), "result_of": F.lit(None).cast("string"), "pinned": F.lit(False), "_at": place, "index": nth}
    extra = extra.withColumns(columns).withColumn("isolated", F.lit(True))
    own = own.withColumns({"isolated": F.lit(False), "id": F.lit(None).cast(supplements.schema["id"].dataType), "category": F.lit(None).cast("string"), "score": F.lit(None).cast("double"), "promoted": F.lit(None).cast("int")})
    names = ["session", "index", "_at", "role", "tokens", "calls", "result_of", "pinned", "isolated", "id", "category", "score", "promoted", "last_user"]
    both = own.select(*names).unionByName(extra.select(*names)).withColumnRenamed("index", "native")
    both = both.withColumn("index", F.row_number().over(Window.partitionBy("session").orderBy("_at", "native")) - 1)
    both = both.withColumn("last_user", F.max(F.when((F.col("_at") == 4) & (F.col("native") == F.col("last_user")), F.col("index"))).over(Window.partitionBy("session")))
    rows, path = written(grouped(both), "grouped")

    whole = groups(rows).join(
        rows.groupBy("session", "root").agg(F.max("pinned").alias("pinned"), F.max("category").alias("category"), F.max("id").alias("id"), F.max("score").alias("given"), F.max("promoted").alias("promoted"), F.max("last_user").alias("last_user"), F.count("native").alias("n")), ["session", "root"]
    )
    session = Window.partitionBy("session")
    size = F.sum("messages").over(session)
    is_last = F.col("last") == F.max("last").over(session)
    current = F.when(F.col("last_user").isNotNull(), F.col("last") >= F.col("last_user")).otherwise(is_last)
    must = current | (F.col("pinned") & F.col("category").isNull()) | F.coalesce(F.col("category") == "pin", F.lit(False))
    whole = whole.withColumns({"current": current, "must": must, "size": size})
    base = F.sum(F.when(F.col("must"), F.col("tokens")).otherwise(0)).over(session)
    pins = F.sum(F.when(F.col("must") & ~F.col("current"), F.col("tokens")).otherwise(0)).over(session)
    now = F.sum(F.when(F.col("current"), F.col("tokens")).otherwise(0)).over(session)
    refusal = F.when(F.lit(limits.fixed > limits.hard), "fixed-too-large").when(pins > limits.pinned, "pins-too-large").when(base > hard, "mandatory-too-large")
    whole = whole.withColumns({"base": base, "now": now, "refusal": refusal})

    turn = (F.col("kind") == "turn") & ~F.col("must") & F.col("category").isNull()
    newest = Window.partitionBy("session", "turn").orderBy(F.desc("last"))
    whole = whole.withColumn("turn", turn).withColumns({"back": F.row_number().over(newest), "upto": F.sum("tokens").over(newest)})
    in_window = (F.col("base") + F.col("upto") <= target) & (F.col("base") + F.col("upto") <= hard)
    fits = in_window & (F.col("now") + F.col("upto") <= limits.tail)
    rescued = (F.col("back") == 1) & in_window & ~fits & F.lit(limits.rescue and limits.tail > 0)
    # sums only grow, so those that fit are the newest ones without a gap
    whole = whole.withColumns({"recent": F.col("turn") & (fits | rescued), "rescued": F.col("turn") & rescued})
    used = F.col("base") + F.sum(F.when(F.col("recent"), F.col("tokens")).otherwise(0)).over(session)
    whole, path2 = written(whole.withColumn("used", used), "groups")

    kinds = {c: i for i, c in enumerate(CATEGORIES)}
    slot = F.when(~F.col("must"), F.coalesce("category", F.when(F.col("kind") == "summary", F.lit("summary"))))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), slot)
    # promoted supplements come first whatever their kind, in their order; summaries last
    first = (F.col("slot") == "summary").cast("int").alias("late"), F.coalesce("promoted", F.lit(2**31 - 1)).alias("promoted")
    item = F.struct(*first, order.alias("slot"), (-F.coalesce("given", F.lit(0.0))).alias("minus"), (-F.col("last")).alias("back"), F.col("root"), F.col("tokens"))
    lists = whole.withColumn("slot", slot).where("slot is not null").groupBy("session").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first("used").alias("used"))
    most = F.array(*[F.lit(getattr(limits, c)) for c in CATEGORIES])
    start = F.struct(F.col("used").alias("used"), F.array_repeat(F.lit(0).cast("long"), len(CATEGORIES)).alias("spent"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        here = F.get(acc["spent"], x["slot"]) + x["tokens"]
        fits = (here <= F.get(most, x["slot"])) & (acc["used"] + x["tokens"] <= target) & (acc["used"] + x["tokens"] <= hard)
        spent = F.transform(acc["spent"], lambda v, i: F.when(fits & (i == x["slot"]), here).otherwise(v))
        return F.struct((acc["used"] + F.when(fits, x["tokens"]).otherwise(0)).alias("used"), spent.alias("spent"), F.when(fits, F.concat(acc["taken"], F.array(x["root"].cast("int")))).otherwise(acc["taken"]).alias("taken"))

    taken = lists.select("session", F.explode(F.aggregate("items", start, step, lambda acc: acc["taken"])).alias("root")).withColumn("taken", F.lit(True))
    chosen = whole.join(taken, ["session", "root"], "left").withColumn("selected", F.col("must") | F.col("recent") | F.coalesce("taken", F.lit(False)))
    kind = F.when(F.col("current"), "current").when(F.col("must"), "pin").when(F.col("category").isNotNull(), F.col("category")).when(F.col("kind") == "summary", "summary").when(F.col("kind") == "turn", "recent").otherwise("history")
    chosen = chosen.withColumn("reason", kind)
    priority = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("reason"))
    score = F.when(F.col("category").isNotNull() & ~F.col("current"), F.col("given")).otherwise(half_up(priority + (F.col("last") + 1) / (F.col("size") + 1)))
    chosen = chosen.withColumn("plan_score", score)
    marked = rows.join(chosen.select("session", "root", "selected"), ["session", "root"])
    parted = broken_exchanges(marked).select("session").distinct().withColumn("parted", F.lit("parted-exchange"))
    verdict = chosen.join(parted, "session", "left").withColumn("why", F.coalesce("refusal", "parted"))
    final = rows.select("session", "root", "index", "native", "id", "tokens", "isolated").join(verdict.select("session", "root", "first", "last", "reason", "plan_score", "selected", "why", "rescued"), ["session", "root"])
    back = F.col("why").isNotNull()
    return final.select(
        "session", F.when(~F.col("isolated"), F.col("native")).alias("index"), F.col("index").alias("position"), F.col("id").alias("supplement"), F.concat(F.lit("group:"), "first", F.lit("-"), "last").alias("group"), F.col("reason").alias("kind"), "tokens", F.col("plan_score").alias("score"),
        F.when(back, ~F.col("isolated")).otherwise(F.col("selected")).alias("selected"), F.when(back, "fallback").otherwise("managed").alias("mode"), "why", "rescued",
    )
