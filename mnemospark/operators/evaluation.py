"""Quality of plans, promotion of learned rankings, and re-ranking under a gate."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import half_up
from mnemospark.operators.ranking import clamped, inversions, quality_score
from mnemospark.storage import exists

#: The numeric features of a candidate.
FEATURES = ("static_score", "exact_score", "fts_score", "vector_score", "recency", "branch_relation", "symbol_relation", "classification_eligible", "token_cost", "prior_selected")
#: Why a learned model may not replace static ranking, in this order.
REASONS = (
    "primary quality score did not improve", "exact-identifier recall regressed", "privacy violations increased", "atomicity failures increased", "overflow increased", "planner latency budget exceeded",
    "inference ordering was not deterministic", "too few held-out repositories",
)
MODEL_BYTES = 1_000_000


def features(rows: DataFrame, **given: Column) -> DataFrame:
    """``rows`` with all ten features, each within 0 and 1 and rounded to nine digits; what is not given, null or not finite is 0."""
    return rows.withColumns({f: clamped(given[f].cast("double")) if f in given else F.lit(0.0) for f in FEATURES})


def plan_metrics(candidates: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One row a fixture: numerators and denominators of each rate, tokens, duplicates, overflow, and the quality score.

    candidates (fixture, id, group, kind, tokens, sources, current, provenance_required, selected), fixtures (fixture, expected, budget, fallback). Evidence counts by
    its sources; tokens are irrelevant if no source is expected or of the current request; groups of one can't be parted.
    """
    one = candidates.join(fixtures.select("fixture", "expected"), "fixture")
    some = lambda c: F.coalesce(c, F.lit(False))
    current, picked = some(F.col("current")), some(F.col("selected"))
    of_current = one.where(current).groupBy("fixture").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("own"))
    one = one.join(of_current, "fixture", "left")
    relevant = F.arrays_overlap("sources", F.concat("expected", F.coalesce("own", F.array().cast("array<string>"))))
    tokens = F.col("tokens").cast("long")
    size = one.groupBy("fixture", "group").agg(F.count("*").alias("n"), F.sum(picked.cast("int")).alias("k"))
    atomic = size.where("n > 1").groupBy("fixture").agg(F.count("*").alias("atomic_d"), F.count_if((F.col("k") == 0) | (F.col("k") == F.col("n"))).alias("atomic_n"))
    sources = F.flatten(F.collect_list(F.when(picked, F.col("sources"))))
    sums = one.groupBy("fixture").agg(
        F.sum(F.when(picked, tokens).otherwise(0)).alias("selected_tokens"), F.sum(F.when(picked, 0).otherwise(tokens)).alias("dropped_tokens"), F.sum(F.when(picked & ~(current | some(relevant)), tokens).otherwise(0)).alias("irrelevant"),
        F.count_if(picked & F.coalesce("provenance_required", F.lit(True))).alias("provenance_d"), F.count_if(picked & F.coalesce("provenance_required", F.lit(True)) & (F.size("sources") > 0)).alias("provenance_n"),
        F.count_if(current).alias("retention_d"), F.count_if(current & picked).alias("retention_n"), sources.alias("_sources"),
    )
    rows = fixtures.join(sums, "fixture").join(atomic, "fixture", "left").fillna(0, ["atomic_d", "atomic_n"])
    expected = F.size(F.array_distinct("expected"))
    rows = rows.withColumns({
        "recall_d": expected.cast("long"), "recall_n": F.size(F.array_intersect("expected", "_sources")).cast("long"), "irrelevant_n": F.when(expected > 0, F.col("irrelevant")).otherwise(0), "irrelevant_d": F.when(expected > 0, F.col("selected_tokens")).otherwise(0),
        "duplicates": (F.size("_sources") - F.size(F.array_distinct("_sources"))).cast("long"), "references": F.size("_sources").cast("long"), "overflow": F.col("selected_tokens") > F.col("budget"), "fallback": some(F.col("fallback")),
    })
    rate = lambda p: half_up(F.try_divide(F.col(f"{p}_n"), F.col(f"{p}_d")))
    total = quality_score(*[rate(p) for p in ("recall", "irrelevant", "provenance", "retention", "atomic")], F.col("overflow").cast("double"), F.col("fallback").cast("double"))
    parts = [f"{p}_{x}" for p in ("recall", "irrelevant", "provenance", "retention", "atomic") for x in "nd"]
    return rows.select("fixture", *parts, "duplicates", "references", "selected_tokens", "dropped_tokens", "overflow", "fallback", total.alias("quality"))


def kind_counts(candidates: DataFrame, budgets: DataFrame | None = None) -> DataFrame:
    """(fixture, kind, available, selected, dropped, selected_tokens, utilization): how each kind of candidate fared against its budget (fixture, kind, budget)."""
    picked = F.coalesce("selected", F.lit(False))
    rows = candidates.groupBy("fixture", "kind").agg(F.count("*").alias("available"), F.count_if(picked).alias("selected"), F.count_if(~picked).alias("dropped"), F.sum(F.when(picked, F.col("tokens")).otherwise(0)).cast("long").alias("selected_tokens"))
    if budgets is None:
        return rows
    used = F.when(F.col("budget") > 0, half_up(F.col("selected_tokens") / F.col("budget"))).when(F.col("selected_tokens") > 0, 1.0).otherwise(0.0)
    return rows.join(budgets, ["fixture", "kind"], "left").withColumn("utilization", F.when(F.col("budget").isNotNull(), used)).drop("budget")


def group_plan(candidates: DataFrame, order: list[Column], most: int, budget: int) -> DataFrame:
    """(fixture, id): candidates in whole groups, a group where its first candidate stands in ``order``, as long as count and tokens last; passing over what doesn't fit.

    The fold is over a fixture's groups, a bounded list.
    """
    place = F.row_number().over(Window.partitionBy("fixture").orderBy(*order))
    rows = candidates.withColumn("_place", place)
    sizes = rows.groupBy("fixture", "group").agg(F.min("_place").alias("at"), F.count("*").cast("int").alias("n"), F.sum("tokens").cast("long").alias("tokens"))
    lists = sizes.groupBy("fixture").agg(F.array_sort(F.collect_list(F.struct("at", "group", "n", "tokens"))).alias("items"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("tokens"), F.slice(F.transform("items", lambda x: x["group"]), F.lit(1), F.lit(0)).alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] + x["n"] <= most) & (acc["tokens"] + x["tokens"] <= budget)
        return F.struct((acc["n"] + F.when(fits, x["n"]).otherwise(0)).alias("n"), (acc["tokens"] + F.when(fits, x["tokens"]).otherwise(0)).alias("tokens"), F.when(fits, F.concat(acc["taken"], F.array(x["group"]))).otherwise(acc["taken"]).alias("taken"))

    taken = lists.select("fixture", F.explode(F.aggregate("items", start, step, lambda acc: acc["taken"])).alias("group"))
    return rows.join(taken, ["fixture", "group"], "left_semi").drop("_place")


def promotion_metrics(candidates: DataFrame, order: list[Column], most: int, budget: int) -> DataFrame:
    """One row over all fixtures: quality, exact_recall, privacy, atomicity and overflow of plans in ``order``.

    candidates (fixture, id, group, tokens, relevant, exact, eligible). Quality is 0.6 recall + 0.2 share of relevant tokens + 0.1 for whole groups + 0.1 for no overflow.
    """
    picked = group_plan(candidates, order, most, budget).select("fixture", "id", F.lit(True).alias("_in"))
    rows = candidates.join(picked, ["fixture", "id"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    sel, rel = F.col("_in"), F.col("relevant")
    sums = rows.agg(
        F.count_if(rel).alias("rel_d"), F.count_if(rel & sel).alias("rel_n"), F.count_if(rel & F.col("exact")).alias("ex_d"), F.count_if(rel & F.col("exact") & sel).alias("ex_n"),
        F.coalesce(F.sum(F.when(sel, F.col("tokens"))), F.lit(0)).alias("tok_d"), F.coalesce(F.sum(F.when(sel & ~rel, F.col("tokens"))), F.lit(0)).alias("tok_n"), F.count_if(sel & ~F.col("eligible")).alias("privacy"),
    )
    parted = rows.groupBy("fixture", "group").agg(F.count("*").alias("n"), F.count_if(sel).alias("k")).agg(F.count_if((F.col("k") > 0) & (F.col("k") < F.col("n"))).alias("atomicity"))
    over = rows.where(sel).groupBy("fixture").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).agg(F.count_if((F.col("n") > most) | (F.col("t") > budget)).alias("overflow"))
    # three tables of one row each
    one = sums.crossJoin(parted).crossJoin(over)
    quality = F.coalesce(F.try_divide("rel_n", "rel_d"), F.lit(1.0)) * 0.6 + (1 - F.coalesce(F.try_divide("tok_n", "tok_d"), F.lit(0.0))) * 0.2 + F.when(F.col("atomicity") == 0, 0.1).otherwise(0.0) + F.when(F.col("overflow") == 0, 0.1).otherwise(0.0)
    return one.select(half_up(quality, 9).alias("quality"), F.coalesce(half_up(F.try_divide("ex_n", "ex_d"), 9), F.lit(1.0)).alias("exact_recall"), "privacy", "atomicity", "overflow")


def promotion_report(static: DataFrame, learned: DataFrame, repeated: DataFrame, latency: float, latency_budget: float, repositories: DataFrame, least_repositories: int = 2) -> DataFrame:
    """(quality_delta, recall_delta, privacy_delta, atomicity_delta, overflow_delta, deterministic, repositories, reasons, eligible): whether a learned model may replace static ranking.

    ``static`` and ``learned`` are `promotion_metrics` of one row, ``repeated`` those of a second run of the learned one, ``repositories`` the held-out ones.
    """
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    held = repositories.agg(F.count_distinct("repository").alias("repositories"))
    # tables of one row each
    rows = named(static, "s").crossJoin(named(learned, "l")).crossJoin(named(repeated, "r")).crossJoin(held)
    same = F.lit(True)
    for c in learned.columns:
        same = same & F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    rows = rows.withColumns({
        "quality_delta": half_up(F.col("l_quality") - F.col("s_quality"), 9), "recall_delta": half_up(F.col("l_exact_recall") - F.col("s_exact_recall"), 9), "privacy_delta": F.col("l_privacy") - F.col("s_privacy"),
        "atomicity_delta": F.col("l_atomicity") - F.col("s_atomicity"), "overflow_delta": F.col("l_overflow") - F.col("s_overflow"), "deterministic": same,
    })
    fails = [
        F.col("quality_delta") <= 0, F.col("recall_delta") < 0, F.col("privacy_delta") > 0, F.col("atomicity_delta") > 0, F.col("overflow_delta") > 0, F.lit(latency > latency_budget), ~F.col("deterministic"),
        F.col("repositories") < least_repositories,
    ]
    reasons = F.array_compact(F.array(*[F.when(fail, F.lit(why)) for fail, why in zip(fails, REASONS)]))
    rows = rows.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)
    return rows.select("quality_delta", "recall_delta", "privacy_delta", "atomicity_delta", "overflow_delta", "deterministic", "repositories", "reasons", "eligible")


def reranked(candidates: DataFrame, mode: Column, model_ok: Column, promoted: Column, quick: Column, key: str) -> DataFrame:
    """``candidates`` (key, id, static_score, learned_score) with status, static_rank, learned_rank, rank and effective_score.

    Mode off keeps static order; shadow ranks both ways and keeps static order; active takes the learned order, if the model is sound, promoted and ``quick`` enough.
    Otherwise, or where a key's ids repeat or a score is no number, static order stands in (fallback).
    """
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    same = Window.partitionBy(key)
    rows = candidates.withColumn("_copies", F.count("*").over(Window.partitionBy(key, "id")))
    sound = F.min(((F.col("_copies") == 1) & number("static_score") & number("learned_score")).cast("int")).over(same) == 1
    status = F.when(mode == "off", "off").when(~model_ok | ~sound, "fallback").when((mode == "active") & ~(promoted & quick), "fallback").otherwise(mode)
    rows = rows.withColumn("status", status).drop("_copies")
    static = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("static_score"), "id")) - 1
    rows = rows.withColumn("static_rank", static)
    learned = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("learned_score"), F.desc("static_score"), "id")) - 1
    ranks = F.col("status").isin("shadow", "active")
    rows = rows.withColumn("learned_rank", F.when(ranks, learned).otherwise(F.col("static_rank")))
    active = F.col("status") == "active"
    return rows.withColumns({"rank": F.when(active, F.col("learned_rank")).otherwise(F.col("static_rank")), "effective_score": F.when(active, F.col("learned_score")).otherwise(F.col("static_score"))})


def rerank_diagnostics(ranked: DataFrame, key: str) -> DataFrame:
    """(key, status, candidates, top_changed, inversions, mean_shift) of `reranked` rows."""
    shift = ranked.groupBy(key).agg(F.first("status").alias("status"), F.count("*").alias("candidates"), (F.min_by("id", "static_rank") != F.min_by("id", "learned_rank")).alias("top_changed"), half_up(F.avg(F.abs(F.col("static_rank") - F.col("learned_rank"))), 9).alias("mean_shift"))
    return shift.join(inversions(ranked, key), key, "left").withColumn("inversions", F.coalesce("inversions", F.lit(0)))


def retrieval_report(rows: DataFrame) -> DataFrame:
    """Macro averages over fixtures (strategy, fixture, expected, recalled, selected_tokens, irrelevant_tokens): the mean of each fixture's own rates."""
    recall = F.when(F.col("expected") > 0, half_up(F.col("recalled") / F.col("expected"))).otherwise(1.0)
    irrelevant = F.when(F.col("selected_tokens") > 0, half_up(F.col("irrelevant_tokens") / F.col("selected_tokens"))).otherwise(0.0)
    return rows.groupBy("strategy").agg(F.count("*").alias("fixtures"), half_up(F.avg(recall)).alias("recall"), half_up(F.avg(irrelevant)).alias("irrelevant"))


def save_model(spark: SparkSession, model: DataFrame, path: str) -> str:
    """Write a model (feature, weight), a few rows, with a checksum; a new version stands beside the old until it is whole. Its checksum is returned."""
    rows = sorted((r.feature, float(r.weight)) for r in model.collect())
    body = json.dumps(rows)
    if len(body) > MODEL_BYTES:
        raise ValueError("a model has to be smaller than a megabyte")
    digest = hashlib.sha256(body.encode()).hexdigest()
    spark.createDataFrame([(digest, body)], "checksum string, body string").coalesce(1).write.mode("overwrite").parquet(f"{path}/checksum={digest}")
    return digest


def load_model(spark: SparkSession, path: str, digest: str) -> DataFrame | None:
    """The model with that checksum; None where it is missing or its body no longer has the checksum."""
    if not exists(spark, f"{path}/checksum={digest}"):
        return None
    row = spark.read.parquet(f"{path}/checksum={digest}").select("body").first()
    if row is None or hashlib.sha256(row.body.encode()).hexdigest() != digest:
        return None
    return spark.createDataFrame([tuple(r) for r in json.loads(row.body)], "feature string, weight double")


def sound_samples(samples: DataFrame, rates: list[str]) -> DataFrame:
    """``samples`` with ``sound``: an id, and each rate's numerator within 0 and its denominator. Others are counted and left out of aggregates."""
    good = F.col("sample_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:/-]{0,159}$")
    for r in rates:
        good = good & (F.col(f"{r}_n") >= 0) & (F.col(f"{r}_n") <= F.col(f"{r}_d"))
    return samples.withColumn("sound", F.coalesce(good, F.lit(False)))
