"""Replay of a ranking strategy: whole groups of candidates, mandatory ones first, within a total budget and one for each category."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators.history import FOLD
from mnemospark.storage import materialize

STATE = "struct<total:bigint,kinds:map<string,bigint>,failed:boolean,taken:array<int>>"


def planned(candidates: DataFrame, budgets: DataFrame, strategy: str, fold: int = FOLD) -> DataFrame:
    """(fixture, id, selected, reason, fallback, overflow) of each candidate.

    candidates: fixture, id, group, kind, tokens, score, current; budgets: fixture, total, kinds (map of a category's tokens; one that is absent has no limit).
    Groups come by whether they hold the current request, then by their best score, then by name. One that does not fit the total or a category is passed over; if
    it is mandatory, all candidates are kept instead. Groups are folded ``fold`` at a time, with what is used carried on.
    """
    by_kind = candidates.groupBy("fixture", "group", "kind").agg(F.sum("tokens").alias("tokens"), F.max("score").alias("score"), F.max("current").alias("current"))
    groups = by_kind.groupBy("fixture", "group").agg(
        F.max("current").alias("mandatory"), F.max("score").alias("score"), F.sum("tokens").alias("tokens"), F.map_from_entries(F.collect_list(F.struct("kind", "tokens"))).alias("adds")
    )
    order = Window.partitionBy("fixture").orderBy(F.desc("mandatory"), F.desc("score"), F.asc("group"))
    groups = materialize(groups.withColumn("place", F.row_number().over(order) - 1), "groups")
    plus = lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        known = lambda kind: F.coalesce(acc["kinds"][kind], F.lit(0))
        within = F.forall(F.map_entries(x["adds"]), lambda e: F.coalesce(known(e["key"]) + e["value"] <= F.col("limits")[e["key"]], F.lit(True)))
        fits = (acc["total"] + x["tokens"] <= F.col("budget")) & within
        return F.struct(
            (acc["total"] + F.when(fits, x["tokens"]).otherwise(0)).alias("total"), F.when(fits, F.map_zip_with(acc["kinds"], x["adds"], plus)).otherwise(acc["kinds"]).alias("kinds"),
            (acc["failed"] | (x["mandatory"] & ~fits)).alias("failed"), F.when(fits, F.concat(acc["taken"], F.array(x["place"]))).otherwise(acc["taken"]).alias("taken"),
        ).cast(STATE)

    carried = budgets.select("fixture", F.col("total").cast("bigint").alias("budget"), F.col("kinds").alias("limits"), F.lit(0).cast("bigint").alias("total"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>")).alias("kinds"), F.lit(False).alias("failed"))
    taken, k = [], 0
    while True:
        lists = groups.where((F.col("place") >= k) & (F.col("place") < k + fold)).groupBy("fixture").agg(F.array_sort(F.collect_list(F.struct("place", "mandatory", "tokens", F.map_entries("adds").alias("adds")))).alias("items"))
        lists = lists.withColumn("items", F.transform("items", lambda x: F.struct(x["place"].alias("place"), x["mandatory"].alias("mandatory"), x["tokens"].alias("tokens"), F.map_from_entries(x["adds"]).alias("adds"))))
        start = F.struct("total", "kinds", "failed", F.array().cast("array<int>").alias("taken")).cast(STATE)
        done = carried.join(lists, "fixture", "left").withColumn("s", F.when(F.col("items").isNull(), start).otherwise(F.aggregate("items", start, step)))
        done = materialize(done.select("fixture", "budget", "limits", "s", (F.coalesce(F.size("items"), F.lit(0)) == fold).alias("more")), "folded")
        taken.append(done.select("fixture", F.explode("s.taken").alias("place")))
        carried = done.select("fixture", "budget", "limits", "s.total", "s.kinds", "s.failed")
        k += fold
        if done.where("more").isEmpty():
            break
    chosen = functools.reduce(DataFrame.union, taken).withColumn("taken", F.lit(True))
    picked = groups.select("fixture", "group", "place").join(chosen, ["fixture", "place"], "left").select("fixture", "group", F.coalesce("taken", F.lit(False)).alias("taken"))
    whole = candidates.groupBy("fixture").agg(F.sum("tokens").alias("all"))
    ends = carried.join(whole, "fixture").select("fixture", F.col("failed").alias("fallback"), (F.when(F.col("failed"), F.col("all")).otherwise(F.col("total")) > F.col("budget")).alias("overflow"))
    rows = candidates.join(picked, ["fixture", "group"]).join(ends, "fixture")
    selected = F.col("taken") | F.col("fallback")
    reason = F.when(~selected, "strategy-or-budget-drop").when(F.col("fallback"), "fail-open-retained").when(F.col("current"), "mandatory-current-request").otherwise(f"{strategy}-selected")
    return rows.select("fixture", "id", selected.alias("selected"), reason.alias("reason"), "fallback", "overflow")
