"""Queries over ranking and quality. Rated documents stand for candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import history as H
from mnemospark.operators import ranking as R
from mnemospark.plans.registry import query

FEATURES = ["static_score", "exact_score", "recency"]
ROUND = "floor(({0}) * 1000000000 + 0.5) / 1000000000"
CANDIDATES = (
    "l as (select doc_id, min(quality) quality, min(toxic) toxic from labels group by 1), "
    f"c as (select doc_id id, source, lang source_kind, quality = 1 useful, {ROUND.format('least(1.0, n_chars / 5000e0)')} static_score, {ROUND.format('doc_id % 7 / 7e0')} exact_score, {ROUND.format('least(1.0, doc_id / 1000e0)')} recency, toxic from documents join l using (doc_id))"
)


def candidates(t):
    rated = t.labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    rows = t.documents.join(rated, "doc_id")
    return rows.select(
        F.col("doc_id").alias("id"), "source", F.col("lang").alias("source_kind"), (F.col("quality") == 1).alias("useful"), R.clamped(F.col("n_chars") / 5000.0).alias("static_score"),
        R.clamped(F.col("doc_id") % 7 / 7.0).alias("exact_score"), R.clamped(F.col("doc_id") / 1000.0).alias("recency"), "toxic",
    )


BOUND = "floor(greatest(-16.0, least(16.0, {0})) * 1000000000 + 0.5) / 1000000000"
MODEL = (
    f"{CANDIDATES}, tot as (select count(*) n, count(*) filter (where useful) pos, count(*) filter (where not useful) neg from c), "
    + "md as (select 'bias' feature, "
    + BOUND.format("(avg(cast(useful as double)) - 0.5) * 2")
    + " weight from c"
    + "".join(f" union all select '{f}', {BOUND.format(f'(avg({f}) filter (where useful) - avg({f}) filter (where not useful)) * 4')} from c" for f in FEATURES)
    + " union all select 'source:' || source_kind, "
    + BOUND.format("(count(*) filter (where useful) / cast(any_value(pos) as double) - count(*) filter (where not useful) / cast(any_value(neg) as double)) * 2")
    + " from c, tot group by source_kind)"
)
SCORED = (
    f"{MODEL}, sc as (select c.*, "
    + ROUND.format("(select weight from md where feature = 'bias') + coalesce(k.weight, 0) + " + " + ".join(f"(select weight from md where feature = '{f}') * {f}" for f in FEATURES))
    + " learned_score from c left join md k on k.feature = 'source:' || source_kind)"
)


@query(f"with {MODEL} select feature, round(weight, 7) weight from md")
def ranking_train(t):
    return R.train(candidates(t), FEATURES).withColumn("weight", F.round("weight", 7))


@query(f"with {SCORED} select id, round(learned_score, 6) learned_score from sc")
def ranking_score(t):
    rows = candidates(t)
    return R.score(rows, R.train(rows, FEATURES), FEATURES).select("id", F.round("learned_score", 6).alias("learned_score"))


@query(
    f"with {SCORED}, r as (select source, row_number() over (partition by source order by static_score desc, id) - 1 sr, row_number() over (partition by source order by round(learned_score, 6) desc, id) - 1 lr from sc), "
    "p as (select a.source, count(*) n from r a join r b on a.source = b.source and a.sr < b.sr and a.lr > b.lr group by 1) "
    "select r.source, floor(avg(abs(sr - lr)) * 1000000 + 0.5) / 1000000 mean_shift, count(*) candidates, coalesce(any_value(n), 0) inversions from r left join p using (source) group by 1"
)
def rank_inversions(t):
    rows = candidates(t)
    scored = R.score(rows, R.train(rows, FEATURES), FEATURES).withColumn("learned_score", F.round("learned_score", 6))
    return R.disagreement(R.ranks(R.ranks(scored, "source", "static_score", "static_rank"), "source", "learned_score", "learned_rank"), "source")


PARTS = ["recall", "irrelevant", "provenance"]
QUALITY = (
    f"{CANDIDATES}, q as (select source strategy, cast(useful and exact_score > 0.3 as bigint) recall_n, cast(useful as bigint) recall_d, case when useful then 0 else 100 end irrelevant_n, 100 irrelevant_d, "
    "cast(toxic = 0 as bigint) provenance_n, cast(source_kind = 'en' as bigint) provenance_d from c)"
)


def quality(t):
    useful = F.col("useful")
    return candidates(t).select(
        F.col("source").alias("strategy"), (useful & (F.col("exact_score") > 0.3)).cast("long").alias("recall_n"), useful.cast("long").alias("recall_d"), F.when(useful, 0).otherwise(100).alias("irrelevant_n"), F.lit(100).alias("irrelevant_d"),
        (F.col("toxic") == 0).cast("long").alias("provenance_n"), (F.col("source_kind") == "en").cast("long").alias("provenance_d"),
    )


RATE = "floor(sum({0}_n) / cast(nullif(sum({0}_d), 0) as double) * 1000000 + 0.5) / 1000000 {0}"
MICRO = f"{QUALITY}, m as (select strategy, count(*) samples, {', '.join(RATE.format(p) for p in PARTS)} from q group by 1)"
SCORE = "floor((coalesce(recall, 1) * 0.35e0 + (1 - coalesce(irrelevant, 0)) * 0.2e0 + coalesce(provenance, 1) * 0.15e0 + 0.15e0 + 0.1e0 + greatest(0, 1 - greatest(0.1e0, 0.05e0)) * 0.05e0) * 1000000 + 0.5) / 1000000"


@query(f"with {MICRO} select * from m")
def quality_micro_avg(t):
    return R.micro_average(quality(t), ["strategy"], PARTS)


@query(f"with {MICRO}, s as (select strategy, round({SCORE}, 5) score from m) select strategy, score, round(score - (select score from s where strategy = 'src0'), 5) delta from s")
def strategy_comparison(t):
    """Quality of each strategy and its distance from the baseline's."""
    one = F.lit(None).cast("double")
    total = R.quality_score(F.col("recall"), F.col("irrelevant"), F.col("provenance"), one, one, F.lit(0.1), F.lit(0.05))
    scored = R.micro_average(quality(t), ["strategy"], PARTS).select("strategy", F.round(total, 5).alias("score"))
    base = scored.where("strategy = 'src0'").select(F.col("score").alias("base"))
    return scored.join(F.broadcast(base)).select("strategy", "score", F.round(F.col("score") - F.col("base"), 5).alias("delta"))


@query("select event_type, count(*) samples, floor(avg(value) * 1000000 + 0.5) / 1000000 mean, quantile_disc(value, 0.95) p95, arg_max(value, event_id) latest from events group by 1")
def p95_timing(t):
    return R.timing(t.events, ["event_type"], "value", "event_id")


@query(
    f"with {MICRO}, p as (select strategy, samples, 0.5e0 static_score, recall learned_score, 0.6e0 static_recall, recall learned_recall, cast(substr(strategy, 4) as int) % 5 forbidden from m), "
    "g as (select *, floor((learned_score - static_score) * 1000000000 + 0.5) / 1000000000 gain from p), r as (select strategy, round(gain, 6) gain, list_filter([case when samples < 20 then 'too-few-samples' end, case when gain <= 0 then 'no-gain' end, "
    "case when learned_recall < static_recall then 'recall-loss' end, case when forbidden > 0 then 'forbidden-evidence' end], lambda x: x is not null) reasons from g) select strategy, gain, array_to_string(reasons, ',') reasons, len(reasons) = 0 promoted from r"
)
def promotion_gate(t):
    m = R.micro_average(quality(t), ["strategy"], PARTS)
    rows = m.select("strategy", "samples", F.lit(0.5).alias("static_score"), F.col("recall").alias("learned_score"), F.lit(0.6).alias("static_recall"), F.col("recall").alias("learned_recall"), (F.substring("strategy", 4, 9).cast("int") % 5).alias("forbidden"))
    return R.promotion(rows).select("strategy", F.round("gain", 6).alias("gain"), F.array_join("reasons", ",").alias("reasons"), "promoted")


@query(
    "with f as (select user_id session, event_id % 60 feedback_id, ts created_at, event_id entry_id, event_type from events), k as (select *, row_number() over (partition by session, feedback_id order by created_at, entry_id) n from f), "
    "a as (select *, row_number() over (partition by session order by created_at desc, entry_id desc) age from k where n = 1) select session, feedback_id, entry_id, event_type from a where age <= 10"
)
def ranking_labels(t):
    rows = t.events.select(F.col("user_id").alias("session"), (F.col("event_id") % 60).alias("feedback_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("entry_id"), "event_type")
    return R.last_labels(rows, 10).select("session", "feedback_id", "entry_id", "event_type")


@query(
    "with i as (select conv_id, role as kind, turn as position, conv_id || ':' || turn id, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) tokens from conversations), k as (select conv_id, kind, count(*) items, sum(tokens) tokens from i group by all), "
    "b as (select conv_id, string_agg(kind || ':' || items || ':' || tokens, ',' order by kind) kinds from k group by 1), d as (select conv_id, sha256(string_agg(id, ',' order by position)) digest from i group by 1) select conv_id, kinds, digest from b join d using (conv_id)"
)
def manifest_rollup(t):
    items = t.conversations.select("conv_id", F.col("role").alias("kind"), F.col("turn").alias("position"), F.concat_ws(":", "conv_id", "turn").alias("id"), H.T.text_tokens(F.col("text")).alias("tokens"))
    return R.inventory(items, "conv_id")


@query(
    f"with recursive {CANDIDATES}, p as (select source, id, static_score, cast(100 + id % 300 as bigint) tokens, row_number() over (partition by source order by static_score desc, id) - 1 place from c), "
    "g as (select source, id, place, tokens <= 1500 ok, case when tokens <= 1500 then tokens else 0 end used, cast(tokens <= 1500 as int) n from p where place = 0 union all select p.source, p.id, p.place, used + p.tokens <= 1500 and n < 8, "
    "used + case when used + p.tokens <= 1500 and n < 8 then p.tokens else 0 end, n + cast(used + p.tokens <= 1500 and n < 8 as int) from g join p on p.source = g.source and p.place = g.place + 1) select source, id, place from g where ok"
)
def planner_greedy(t):
    """Supplements in order of score that fit the budget; one that does not is passed over and smaller ones are tried."""
    rows = candidates(t).select("source", "id", "static_score", (100 + F.col("id") % 300).alias("tokens"))
    return H.greedy_whole(rows, ["source"], [F.desc("static_score"), F.asc("id")], "tokens", 1500, 8).select("source", "id", F.col("place").cast("long").alias("place"))
