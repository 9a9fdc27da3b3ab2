"""Queries over the quality of plans and the promotion of rankings. Rated documents, by source, stand for fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import evaluation as V
from mnemospark.plans.ranking import CANDIDATES, FEATURES, SCORED, candidates
from mnemospark.plans.registry import query
from mnemospark.operators import ranking as R

PLANS = (
    f"{CANDIDATES}, pc as (select source fixture, id, 'g' || id // 3 as grp, source_kind as kind, cast(50 + id % 100 as bigint) tokens, case when id % 6 = 0 then [] when id % 6 = 1 then ['s' || id % 20, 's' || id % 7] else ['s' || id % 20] end sources, id % 17 = 0 as current, id % 5 <> 0 needs, useful and exact_score < 0.7 selected from c), "
    "fx as (select fixture, case when length(fixture) % 2 = 0 then ['s1', 's3', 's3', 's99'] else [] end expected, 900 budget, fixture = 'src2' fallback from (select distinct fixture from pc))"
)


def plans(t):
    k = F.col("id")
    s = lambda n: F.concat(F.lit("s"), (k % n).cast("string"))
    sources = F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 6 == 1, F.array(s(20), s(7))).otherwise(F.array(s(20)))
    rows = candidates(t).select(
        F.col("source").alias("fixture"), "id", F.concat(F.lit("g"), F.floor(k / 3).cast("string")).alias("group"), F.col("source_kind").alias("kind"), (50 + k % 100).alias("tokens"), sources.alias("sources"), (k % 17 == 0).alias("current"), (k % 5 != 0).alias("provenance_required"),
        (F.col("useful") & (F.col("exact_score") < 0.7)).alias("selected"),
    )
    names = F.when(F.length("fixture") % 2 == 0, F.array(*map(F.lit, ("s1", "s3", "s3", "s99")))).otherwise(F.array().cast("array<string>"))
    return rows, rows.select("fixture").distinct().select("fixture", names.alias("expected"), F.lit(900).alias("budget"), (F.col("fixture") == "src2").alias("fallback"))


RATE = "floor({0}_n / cast({0}_d as double) * 1000000 + 0.5) / 1000000"


@query(
    f"with {PLANS}, ow as (select fixture, list_distinct(flatten(list(sources))) own from pc where current group by 1), j as (select pc.*, expected, coalesce(own, []) own from pc join fx using (fixture) left join ow using (fixture)), "
    "sz as (select fixture, grp, count(*) n, count(*) filter (where selected) k from pc group by all), ac as (select fixture, count(*) atomic_d, count(*) filter (where k = 0 or k = n) atomic_n from sz where n > 1 group by 1), "
    "su as (select fixture, any_value(expected) expected, cast(sum(case when selected then tokens else 0 end) as bigint) selected_tokens, cast(sum(case when selected then 0 else tokens end) as bigint) dropped_tokens, cast(sum(case when selected and not current and not list_has_any(sources, list_concat(expected, own)) then tokens else 0 end) as bigint) irr, "
    "count(*) filter (where selected and needs) provenance_d, count(*) filter (where selected and needs and len(sources) > 0) provenance_n, count(*) filter (where current) retention_d, count(*) filter (where current and selected) retention_n, coalesce(flatten(list(sources) filter (where selected)), []) ss from j group by 1), "
    "m as (select su.fixture, len(list_distinct(su.expected)) recall_d, len(list_intersect(list_distinct(su.expected), ss)) recall_n, case when len(su.expected) > 0 then irr else 0 end irrelevant_n, case when len(su.expected) > 0 then selected_tokens else 0 end irrelevant_d, provenance_n, provenance_d, retention_n, retention_d, coalesce(atomic_n, 0) atomic_n, coalesce(atomic_d, 0) atomic_d, "
    "len(ss) - len(list_distinct(ss)) duplicates, len(ss) \"references\", selected_tokens, dropped_tokens, selected_tokens > budget \"overflow\", fallback from su join fx on fx.fixture = su.fixture left join ac on ac.fixture = su.fixture) "
    f"select *, floor((case when recall_d = 0 then 1 else {RATE.format('recall')} end * 0.35e0 + (1 - case when irrelevant_d = 0 then 0 else {RATE.format('irrelevant')} end) * 0.2e0 + case when provenance_d = 0 then 1 else {RATE.format('provenance')} end * 0.15e0 + case when retention_d = 0 then 1 else {RATE.format('retention')} end * 0.15e0 "
    f"+ case when atomic_d = 0 then 1 else {RATE.format('atomic')} end * 0.1e0 + case when \"overflow\" or fallback then 0 else 1 end * 0.05e0) * 1000000 + 0.5) / 1000000 quality from m"
)
def quality_plan(t):
    rows, fixtures = plans(t)
    return V.plan_metrics(rows, fixtures)


@query(
    f"with {PLANS}, k as (select fixture, kind, count(*) available, count(*) filter (where selected) selected, count(*) filter (where not selected) dropped, cast(sum(case when selected then tokens else 0 end) as bigint) selected_tokens from pc group by all) "
    "select *, case kind when 'en' then floor(selected_tokens / 700e0 * 1000000 + 0.5) / 1000000 when 'de' then case when selected_tokens > 0 then 1.0 else 0.0 end end utilization from k"
)
def quality_kinds(t):
    rows, fixtures = plans(t)
    budgets = fixtures.select("fixture", F.explode(F.array(F.struct(F.lit("en").alias("kind"), F.lit(700).alias("budget")), F.struct(F.lit("de").alias("kind"), F.lit(0).alias("budget")))).alias("b")).select("fixture", "b.*")
    return V.kind_counts(rows, budgets)


@query(
    "with s as (select event_id, case when event_id % 7 = 0 then '-x' when event_id % 7 = 1 then '' else 's' || event_id end id, event_id % 5 n, event_id % 4 d from events) select event_id, regexp_matches(id, '^[A-Za-z0-9][A-Za-z0-9._:/-]{0,159}$') and n <= d sound from s"
)
def quality_validity(t):
    k = F.col("event_id")
    name = F.when(k % 7 == 0, "-x").when(k % 7 == 1, "").otherwise(F.concat(F.lit("s"), k))
    return V.sound_samples(t.events.select("event_id", name.alias("sample_id"), (k % 5).alias("recall_n"), (k % 4).alias("recall_d")), ["recall"]).select("event_id", "sound")


PROMOTION = (
    f"{SCORED}, pr as (select source fixture, id, source || ':' || id // 2 as grp, cast(40 + id % 90 as bigint) tokens, useful relevant, exact_score > 0.5 exact, toxic = 0 eligible, static_score, round(learned_score, 6) learned_score from sc), "
    "pl as (select fixture, id, grp, tokens, row_number() over (partition by fixture order by static_score desc, id) st, row_number() over (partition by fixture order by learned_score desc, id) le from pr)"
)
TAKEN = (
    "g{k} as (select fixture, grp, min({o}) pos, count(*) n, sum(tokens) tokens from pl group by all), o{k} as (select *, row_number() over (partition by fixture order by pos) nth from g{k}), "
    "f{k} as (select fixture, grp, nth, n <= 8 and tokens <= 600 ok, case when n <= 8 and tokens <= 600 then n else 0 end un, case when n <= 8 and tokens <= 600 then tokens else 0 end ut from o{k} where nth = 1 union all "
    "select o{k}.fixture, o{k}.grp, o{k}.nth, un + o{k}.n <= 8 and ut + o{k}.tokens <= 600, un + case when un + o{k}.n <= 8 and ut + o{k}.tokens <= 600 then o{k}.n else 0 end, ut + case when un + o{k}.n <= 8 and ut + o{k}.tokens <= 600 then o{k}.tokens else 0 end "
    "from f{k} join o{k} on o{k}.fixture = f{k}.fixture and o{k}.nth = f{k}.nth + 1), t{k} as (select pr.*, coalesce(ok, false) sel from pr left join f{k} on f{k}.fixture = pr.fixture and f{k}.grp = pr.grp)"
)
MEASURED = (
    "m{k} as (select floor((coalesce(count(*) filter (where relevant and sel) / cast(nullif(count(*) filter (where relevant), 0) as double), 1) * 0.6e0 + (1 - coalesce(sum(case when sel and not relevant then tokens else 0 end) / cast(nullif(sum(case when sel then tokens else 0 end), 0) as double), 0)) * 0.2e0 + 0.2e0) * 1000000000 + 0.5) / 1000000000 quality, "
    "coalesce(floor(count(*) filter (where relevant and exact and sel) / cast(nullif(count(*) filter (where relevant and exact), 0) as double) * 1000000000 + 0.5) / 1000000000, 1.0) exact_recall, count(*) filter (where sel and not eligible) privacy from t{k})"
)


def promoted(t):
    rows = candidates(t)
    scored = R.score(rows, R.train(rows, FEATURES), FEATURES).withColumn("learned_score", F.round("learned_score", 6))
    k = F.col("id")
    return scored.select(
        F.col("source").alias("fixture"), "id", F.concat_ws(":", "source", F.floor(k / 2).cast("string")).alias("group"), (40 + k % 90).alias("tokens"), F.col("useful").alias("relevant"), (F.col("exact_score") > 0.5).alias("exact"), (F.col("toxic") == 0).alias("eligible"), "static_score", "learned_score",
    )


@query(f"with recursive {PROMOTION}, {TAKEN.format(k=0, o='st')} select fixture, id from t0 where sel")
def promotion_plan(t):
    return V.group_plan(promoted(t), [F.desc("static_score"), F.asc("id")], 8, 600).select("fixture", "id")


@query(
    f"with recursive {PROMOTION}, {TAKEN.format(k=0, o='st')}, {TAKEN.format(k=1, o='le')}, {MEASURED.format(k=0)}, {MEASURED.format(k=1)}, d as (select round(m1.quality - m0.quality, 6) quality_delta, round(m1.exact_recall - m0.exact_recall, 6) recall_delta, m1.privacy - m0.privacy privacy_delta from m0, m1) "
    "select *, 0 atomicity_delta, 0 overflow_delta, true deterministic, (select count(distinct fixture) from pr) repositories, array_to_string(list_filter([case when quality_delta <= 0 then 'primary quality score did not improve' end, case when recall_delta < 0 then 'exact-identifier recall regressed' end, "
    "case when privacy_delta > 0 then 'privacy violations increased' end, 'planner latency budget exceeded'], lambda x: x is not null), '; ') reasons, false eligible from d"
)
def promotion_report(t):
    """Learned against static ranking over all fixtures; its latency is over its budget here, so that one reason holds whatever the data."""
    rows = promoted(t)
    static = V.promotion_metrics(rows, [F.desc("static_score"), F.asc("id")], 8, 600)
    learned = V.promotion_metrics(rows, [F.desc("learned_score"), F.asc("id")], 8, 600)
    report = V.promotion_report(static, learned, learned, 12.0, 10.0, rows.select(F.col("fixture").alias("repository")))
    return report.withColumns({"reasons": F.array_join("reasons", "; "), "quality_delta": F.round("quality_delta", 6), "recall_delta": F.round("recall_delta", 6)})


RERANK = (
    f"{PROMOTION}, mk2 as (select *, case length(fixture) + cast(substr(fixture, 4) as int) when 4 then 'off' when 5 then 'shadow' else 'active' end as mode, cast(substr(fixture, 4) as int) % 5 <> 4 promoted, cast(substr(fixture, 4) as int) % 7 <> 6 quick, cast(substr(fixture, 4) as int) <> 3 model from pr), "
    "st as (select *, case when mode = 'off' then 'off' when not model then 'fallback' when mode = 'active' and not (promoted and quick) then 'fallback' else mode end status, row_number() over (partition by fixture order by static_score desc, id) - 1 static_rank, row_number() over (partition by fixture order by learned_score desc, static_score desc, id) - 1 lr from mk2), "
    "rr as (select *, case when status in ('shadow', 'active') then lr else static_rank end learned_rank from st)"
)


def reranked(t):
    n = F.substring("fixture", 4, 9).cast("int")
    mode = F.when(F.length("fixture") + n == 4, "off").when(F.length("fixture") + n == 5, "shadow").otherwise("active")
    return V.reranked(promoted(t), mode, n != 3, n % 5 != 4, n % 7 != 6, "fixture")


@query(f"with {RERANK} select fixture, id, status, static_rank, learned_rank, case when status = 'active' then learned_rank else static_rank end as rank, round(case when status = 'active' then learned_score else static_score end, 6) effective_score from rr")
def learned_rerank(t):
    long = lambda c: F.col(c).cast("long").alias(c)
    return reranked(t).select("fixture", "id", "status", long("static_rank"), long("learned_rank"), long("rank"), F.round("effective_score", 6).alias("effective_score"))


@query(
    f"with {RERANK}, p as (select a.fixture, count(*) n from rr a join rr b on a.fixture = b.fixture and a.static_rank < b.static_rank and a.learned_rank > b.learned_rank group by 1) "
    "select rr.fixture, any_value(status) status, count(*) candidates, arg_min(id, static_rank) <> arg_min(id, learned_rank) top_changed, floor(avg(abs(static_rank - learned_rank)) * 1000000000 + 0.5) / 1000000000 mean_shift, cast(coalesce(any_value(n), 0) as bigint) inversions from rr left join p on p.fixture = rr.fixture group by rr.fixture"
)
def rerank_diagnostics(t):
    return V.rerank_diagnostics(reranked(t), "fixture").withColumn("inversions", F.col("inversions").cast("long"))


@query(
    f"with {PLANS}, f as (select fixture, kind strategy, count(*) filter (where current) expected, count(*) filter (where current and selected) recalled, cast(sum(case when selected then tokens else 0 end) as bigint) st, cast(sum(case when selected and not current then tokens else 0 end) as bigint) it from pc group by all) "
    "select strategy, count(*) fixtures, floor(avg(case when expected > 0 then floor(recalled / cast(expected as double) * 1000000 + 0.5) / 1000000 else 1.0 end) * 1000000 + 0.5) / 1000000 recall, floor(avg(case when st > 0 then floor(it / cast(st as double) * 1000000 + 0.5) / 1000000 else 0.0 end) * 1000000 + 0.5) / 1000000 irrelevant from f group by 1"
)
def retrieval_report(t):
    rows, _ = plans(t)
    sums = rows.groupBy("fixture", F.col("kind").alias("strategy")).agg(
        F.count_if("current").alias("expected"), F.count_if(F.col("current") & F.col("selected")).alias("recalled"), F.sum(F.when(F.col("selected"), F.col("tokens")).otherwise(0)).alias("selected_tokens"), F.sum(F.when(F.col("selected") & ~F.col("current"), F.col("tokens")).otherwise(0)).alias("irrelevant_tokens")
    )
    return V.retrieval_report(sums)
