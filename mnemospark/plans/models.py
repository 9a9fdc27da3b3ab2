"""Queries over series: calibration, budgets, retention, caches. Events stand for usage samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import calibration as C
from mnemospark.operators import history as H
from mnemospark.plans.registry import query

SAMPLES = (
    "s as (select event_type profile, event_id id, epoch_ms(ts) created_at, 100 + event_id * 7 % 400 estimated, "
    "cast(floor((100 + event_id * 7 % 400) * (0.7 + user_id % 13 / 10.0)) as bigint) actual, user_id from events)"
)
RECENT = "n as (select *, row_number() over (partition by profile order by created_at desc, id desc) age from s)"
CAL = (
    f"{SAMPLES}, {RECENT}, r as (select * from n where age <= 24), b as (select *, actual / cast(estimated as double) ratio from r where estimated > 0 and actual > 0 and actual / cast(estimated as double) between 0.5 and 2.0), "
    "m as (select profile, median(ratio) center from b group by 1), d as (select b.*, center, abs(ratio - center) \"off\" from b join m using (profile)), md as (select profile, median(\"off\") mad from d group by 1), "
    "a as (select d.* from d join md using (profile) where \"off\" <= greatest(0.05, center * 0.1, mad * 3 * 1.4826)), "
    "k as (select profile, count(*) accepted, median(ratio) mr from a group by 1), "
    "c as (select o.profile, observed, coalesce(bounded, 0) bounded, coalesce(accepted, 0) accepted, floor(mr * 1000000 + 0.5) / 1000000 median_ratio, coalesce(accepted, 0) >= 3 calibrated from (select profile, count(*) observed from r group by 1) o "
    "left join (select profile, count(*) bounded from b group by 1) i using (profile) left join k using (profile))"
)


def samples(t):
    estimated = 100 + F.col("event_id") * 7 % 400
    return t.events.select(
        F.col("event_type").alias("profile"), F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"), estimated.alias("estimated"),
        F.floor(estimated * (F.lit(0.7) + F.col("user_id") % 13 / 10.0)).alias("actual"), "user_id",
    )


@query(f"with {CAL} select *, case when calibrated then greatest(0.5, least(2.0, median_ratio)) else 1.0 end applied from c")
def calibration_mad(t):
    return C.calibrate(samples(t))


@query(
    f"with {CAL}, x as (select profile, median_ratio r, case when calibrated and median_ratio >= 1.25 then 'persistent-underestimate' when calibrated and median_ratio <= 0.8 then 'persistent-overestimate' "
    "when observed - accepted >= 3 then 'calibration-outliers' end code from c) select profile, code, case when code is null then null when (code = 'persistent-underestimate' and r >= 1.6) or (code = 'persistent-overestimate' and r <= 0.625) "
    "then 'critical' else 'warning' end severity from x"
)
def token_drift(t):
    return C.drift(C.calibrate(samples(t)))


@query(
    f"with {CAL}, w as (select profile, max(actual) hw from r group by 1), x as (select c.*, hw / 1500.0 share from c join w using (profile)), y as (select *, case when not calibrated or accepted < 8 then 'insufficient-samples' when share <= 0.6 then 'expanded' else 'no-headroom' end status from x) "
    "select profile, status, floor(share * 1000000 + 0.5) / 1000000 high_watermark_ratio, cast(case when status = 'expanded' then 1.125 else 1.0 end as double) boost from y"
)
def auto_tune(t):
    rows = samples(t)
    high = C.newest(rows, ["profile"], 24).groupBy("profile").agg(F.max("actual").alias("high"))
    return C.auto_tune(C.calibrate(rows).join(high, "profile"), F.col("high"), F.lit(1500.0))


@query(f"with {SAMPLES}, {RECENT} select profile, id, age from n where age <= 200")
def retention_newest(t):
    return C.newest(samples(t), ["profile"], 200).select("profile", "id", F.col("age").cast("long").alias("age"))


@query(f"with {SAMPLES}, {RECENT} select profile, count(*) removed, cast(sum(estimated) as bigint) bytes, min(id) oldest from n where age > 200 group by 1")
def retention_prune(t):
    return C.outside_newest(samples(t), ["profile"], 200).groupBy("profile").agg(F.count("*").alias("removed"), F.sum("estimated").alias("bytes"), F.min("id").alias("oldest"))


@query("with p as (select event_type, user_id, count(*) n from events group by all) select cast(sum(n) as bigint) as rows, count(*) profiles, cast(sum(greatest(0, n - 20)) as bigint) excess, max(n) largest from p")
def storage_two_level_agg(t):
    rows = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return rows.agg(F.sum("n").alias("rows"), F.count("*").alias("profiles"), F.sum(F.greatest(F.lit(0), F.col("n") - 20)).alias("excess"), F.max("n").alias("largest"))


@query(
    "with n as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) age from events) select event_type, cast(sum(length(props)) as bigint) bytes, "
    "cast(sum(case when cast(json_extract(props, '$.k') as bigint) > 50 then 1 else 0 end) as bigint) large, count(*) newest from n where age <= 100 group by 1"
)
def storage_diagnostics(t):
    rows = C.newest(t.events.withColumn("created_at", F.col("ts")).withColumn("id", F.col("event_id")), ["event_type"], 100)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return rows.groupBy("event_type").agg(F.sum(F.length("props")).cast("long").alias("bytes"), F.sum(F.when(k > 50, 1).otherwise(0)).alias("large"), F.count("*").alias("newest"))


@query(
    "with s as (select event_type, cast(sum(event_id % 100) as bigint) input, cast(sum(user_id % 50) as bigint) cache_read, cast(sum(event_id % 7) as bigint) cache_write from events group by 1) "
    "select *, floor(cache_read / cast(nullif(input + cache_read + cache_write, 0) as double) * 1000000 + 0.5) / 1000000 read_share, floor(cache_write / cast(nullif(input + cache_read + cache_write, 0) as double) * 1000000 + 0.5) / 1000000 write_share from s"
)
def cache_shares(t):
    rows = t.events.groupBy("event_type").agg(F.sum(F.col("event_id") % 100).alias("input"), F.sum(F.col("user_id") % 50).alias("cache_read"), F.sum(F.col("event_id") % 7).alias("cache_write"))
    total = F.col("input") + F.col("cache_read") + F.col("cache_write")
    return rows.select("*", C.half_up(F.try_divide(F.col("cache_read"), total)).alias("read_share"), C.half_up(F.try_divide(F.col("cache_write"), total)).alias("write_share"))


MODELS = "m as (select p_partkey id, 4096 * (1 + p_size % 50) win, case when p_size % 3 = 0 then null else 256 * p_size end outp, 0.8e0 + p_size % 7 / 10e0 ratio from part)"


def models(t):
    size = F.col("p_size")
    return t.part.select(F.col("p_partkey").alias("id"), (4096 * (1 + size % 50)).cast("long").alias("win"), F.when(size % 3 != 0, 256 * size).cast("long").alias("outp"), (F.lit(0.8) + size % 7 / 10.0).alias("ratio"))


@query(
    f"with {MODELS}, a as (select *, greatest(least(2048, coalesce(outp, 8192)), least(8192, coalesce(outp, 8192))) reserve from m), b as (select *, least(2048, greatest(0, win - reserve)) safety from a), "
    "c as (select *, least(greatest(0, win - reserve - safety), floor(win * 0.9e0)) nh, greatest(1.0, ratio) br from b), d as (select *, floor(nh / br) hard_limit, floor(floor(win * 0.7e0) / br) target from c) "
    "select id, cast(reserve as bigint) reserve, cast(safety as bigint) safety, cast(hard_limit as bigint) hard_limit, cast(least(hard_limit, floor(least(nh, floor(win * 0.8e0)) / br)) as bigint) soft_limit, cast(target as bigint) target, cast(least(hard_limit, target) as bigint) active, "
    "case when win <= 40000 then 12000 when win <= 131072 then 24000 when win <= 262144 then 32000 else 64000 end tail, case when win <= 40000 then 4000 when win <= 131072 then 8000 when win <= 262144 then 16000 else 32000 end history, "
    "case when win <= 40000 then 4000 when win <= 131072 then 12000 when win <= 262144 then 20000 else 32000 end project, cast(greatest(0, least(least(hard_limit, target), hard_limit, floor((win - safety - 1024) / br))) as bigint) compaction from d"
)
def budget_calc(t):
    rows = models(t)
    limits = C.budget(F.col("win"), F.col("outp"), F.col("ratio"))
    rows = rows.select("id", "win", "ratio", *[c.cast("long").alias(n) for n, c in limits.items()], *[c.alias(n) for n, c in C.ceilings(F.col("win")).items()])
    compaction = C.compaction_input(F.col("active"), F.col("hard_limit"), F.col("win"), F.col("safety"), F.lit(1024), F.greatest(F.lit(1.0), F.col("ratio")))
    return rows.select("*", compaction.cast("long").alias("compaction")).drop("win", "ratio")


@query(
    f"with {MODELS}, c as (select id, win, (win - least(win // 2, win)) * 3.0 / 1000000 + least(win // 2, win) * 0.3 / 1000000 + coalesce(outp, 0) * 15.0 / 1000000 cold, win * 0.3 / 1000000 warm from m) "
    "select id, round(cold, 9) cold, round(case when win > 100000 then 4 * (cold + 2 * warm) else cold + 11 * warm end, 9) epoch from c"
)
def cache_costs(t):
    rows = models(t).withColumn("cold", C.request_cost(F.col("win"), F.floor(F.col("win") / 2), F.coalesce("outp", F.lit(0)), (3.0, 0.3, 15.0))).withColumn("warm", F.col("win") * 0.3 / 1_000_000)
    epoch = C.epoch_cost(F.col("win"), F.lit(100_000), F.col("cold"), F.col("warm"), 4, 3)
    return rows.select("id", F.round("cold", 9).alias("cold"), F.round(epoch, 9).alias("epoch"))


@query(
    "with p as (select s_suppkey id, 'p' || s_nationkey % 5 provider, 'm' || s_suppkey % 4 model from supplier), o(pattern, lim, fill) as (values ('*', 10, 0.5), ('p1/*', 20, null), ('p2/*', null, 0.6), ('p1/m2', 30, 0.9)) "
    "select id, provider, model, coalesce(a.lim, b.lim, c.lim) lim, cast(coalesce(a.fill, b.fill, c.fill) as double) fill from p left join o a on a.pattern = provider || '/' || model left join o b on b.pattern = provider || '/*' left join o c on c.pattern = '*'"
)
def override_merge(t):
    rules = t.spark.createDataFrame([("*", 10, 0.5), ("p1/*", 20, None), ("p2/*", None, 0.6), ("p1/m2", 30, 0.9)], "pattern string, lim int, fill double")
    rows = t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("p"), F.col("s_nationkey") % 5).alias("provider"), F.concat(F.lit("m"), F.col("s_suppkey") % 4).alias("model"))
    return C.merge_overrides(rows, rules, ["lim", "fill"])


@query(
    "with e as (select conv_id, turn as position, sha256(coalesce(text, '')) hash, cast(ceil(length(coalesce(text, '')) / 4.0) as bigint) tokens from conversations), "
    "c as (select e.*, coalesce(e.hash = p.hash, false) same from e left join (select conv_id, position, case when position % 5 = 4 then 'edited' else hash end hash from e) p using (conv_id, position)), "
    "k as (select *, min(cast(same as int)) over (partition by conv_id order by position) ok from c) select conv_id, cast(sum(ok) as bigint) prefix, cast(sum(ok * tokens) as bigint) reusable from k group by 1"
)
def prefix_reuse(t):
    """Leading messages that a previous request shares; here every fifth message was edited since."""
    rows = t.conversations.select("conv_id", F.col("turn").alias("position"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), H.T.text_tokens(F.col("text")).alias("tokens"))
    before = rows.withColumn("hash", F.when(F.col("position") % 5 == 4, "edited").otherwise(F.col("hash")))
    return C.common_prefix(rows, before, ["conv_id"])


@query(
    "select date_trunc('hour', ts) as hour, event_type, count(*) n, round(sum(value), 6) total from events group by all"
)
def hourly_usage(t):
    """Extension: tumbling windows over event time."""
    rows = t.events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.withColumn("hour", F.col("hour").cast("timestamp_ntz"))
