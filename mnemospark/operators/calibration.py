"""Token calibration, budgets, cache costs and retention over keyed series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import half_up


def newest(samples: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key (created_at, then id, both descending); a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    return samples.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def outside_newest(samples: DataFrame, keys: list[str], n: int) -> DataFrame:
    """What retention of the newest ``n`` removes."""
    w = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    return samples.withColumn("age", F.row_number().over(w)).where(F.col("age") > n)


def calibrate(samples: DataFrame, window: int = 24, lower: float = 0.5, upper: float = 2.0, minimum: int = 3) -> DataFrame:
    """Each profile's robust ratio of actual to estimated tokens over its newest samples.

    Ratios beyond the bounds are left out, then those further from the median than the largest of 0.05, a tenth of the
    median, and three normalised median absolute deviations. Windows are bounded, so each profile is one row of work.
    """
    recent = newest(samples, ["profile"], window)
    valid = recent.where("estimated > 0 and actual > 0").withColumn("ratio", F.col("actual") / F.col("estimated"))
    bounded = valid.where(F.col("ratio").between(lower, upper))
    every = Window.partitionBy("profile")
    centred = bounded.withColumn("center", F.median("ratio").over(every))
    off = centred.withColumn("off", F.abs(F.col("ratio") - F.col("center"))).withColumn("mad", F.median("off").over(every))
    accepted = off.where(F.col("off") <= F.greatest(F.lit(0.05), F.col("center") * 0.1, F.col("mad") * 3 * 1.4826))
    counts = recent.groupBy("profile").agg(F.count("*").alias("observed"))
    inside = bounded.groupBy("profile").agg(F.count("*").alias("bounded"))
    kept = accepted.groupBy("profile").agg(F.count("*").alias("accepted"), F.median("ratio").alias("median_ratio"))
    rows = counts.join(inside, "profile", "left").join(kept, "profile", "left")
    rows = rows.select("profile", "observed", F.coalesce("bounded", F.lit(0)).alias("bounded"), F.coalesce("accepted", F.lit(0)).alias("accepted"), half_up(F.col("median_ratio")).alias("median_ratio"))
    calibrated = F.col("accepted") >= minimum
    return rows.withColumn("calibrated", calibrated).withColumn("applied", F.when(calibrated, F.greatest(F.lit(lower), F.least(F.lit(upper), F.col("median_ratio")))).otherwise(1.0))


def drift(calibration: DataFrame, minimum: int = 3) -> DataFrame:
    """code and severity of a lasting mis-estimate, or of many outliers; null without either."""
    ratio, outliers = F.col("median_ratio"), F.col("observed") - F.col("accepted")
    under, over = F.col("calibrated") & (ratio >= 1.25), F.col("calibrated") & (ratio <= 0.8)
    code = F.when(under, "persistent-underestimate").when(over, "persistent-overestimate").when(outliers >= minimum, "calibration-outliers")
    critical = (under & (ratio >= 1.6)) | (over & (ratio <= 0.625))
    return calibration.select("profile", code.alias("code"), F.when(code.isNotNull(), F.when(critical, "critical").otherwise("warning")).alias("severity"))


def auto_tune(calibration: DataFrame, high_watermark: Column, target: Column, least: int = 8) -> DataFrame:
    """Whether a profile's limits may grow: eight accepted samples and at most 0.6 of the target ever used."""
    share = F.when(target > 0, high_watermark / target)
    status = F.when(~F.col("calibrated") | (F.col("accepted") < least), "insufficient-samples").when(share <= 0.6, "expanded").otherwise("no-headroom")
    return calibration.select("profile", status.alias("status"), half_up(share).alias("high_watermark_ratio"), F.when(status == "expanded", 1.125).otherwise(1.0).alias("boost"))


def budget(window: Column, output: Column, ratio: Column, preferred: int = 8192, minimum: int = 2048, margin: int = 2048, hard: float = 0.9, soft: float = 0.8, fill: float = 0.7) -> dict[str, Column]:
    """Input limits of a model by its context window, output ceiling and calibration ratio."""
    ceiling = F.coalesce(output, F.lit(preferred))
    reserve = F.greatest(F.least(F.lit(minimum), ceiling), F.least(F.lit(preferred), ceiling))
    safety = F.least(F.lit(margin), F.greatest(F.lit(0), window - reserve))
    nominal_hard = F.least(F.greatest(F.lit(0), window - reserve - safety), F.floor(window * hard))
    nominal_soft = F.least(nominal_hard, F.floor(window * soft))
    by = F.greatest(F.lit(1.0), ratio)
    limit = lambda x: F.floor(x / by)
    hard_limit, target = limit(nominal_hard), limit(F.floor(window * fill))
    return {"reserve": reserve, "safety": safety, "hard_limit": hard_limit, "soft_limit": F.least(hard_limit, limit(nominal_soft)), "target": target, "active": F.least(hard_limit, target)}


def ceilings(window: Column) -> dict[str, Column]:
    """Automatic ceilings by context window: recent tail, history retrieval, project retrieval."""
    step = lambda a, b, c, d: F.when(window <= 40_000, a).when(window <= 131_072, b).when(window <= 262_144, c).otherwise(d)
    return {"tail": step(12_000, 24_000, 32_000, 64_000), "history": step(4_000, 8_000, 16_000, 32_000), "project": step(4_000, 12_000, 20_000, 32_000)}


def request_cost(total: Column, reusable: Column, output: Column, rates: tuple[float, float, float]) -> Column:
    """Cost of a request by rates a million: fresh input, cached input, output."""
    cached = F.least(reusable, total)
    return ((total - cached) * rates[0] + cached * rates[1] + output * rates[2]) / 1_000_000


def epoch_cost(tokens: Column, tail_limit: Column, cold: Column, warm: Column, turns: int, requests: int) -> Column:
    """Cost of an epoch: a sliding prefix is cold each turn, a stable one only once; null where unpriced."""
    return F.when(tokens > tail_limit, turns * (cold + (requests - 1) * warm)).otherwise(cold + (requests * turns - 1) * warm)


def compaction_input(active: Column, hard: Column, window: Column, safety: Column, most_output: Column, ratio: Column) -> Column:
    safe = F.floor((window - safety - most_output) / ratio)
    return F.greatest(F.lit(0), F.least(active, hard, safe))


def merge_overrides(profiles: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Settings by pattern: an exact provider/model beats provider/*, and that beats *. Patterns are unique."""
    out = profiles
    for k, pattern in enumerate((F.concat_ws("/", "provider", "model"), F.concat(F.col("provider"), F.lit("/*")), F.lit("*"))):
        own = overrides.select(F.col("pattern").alias(f"_p{k}"), *[F.col(c).alias(f"_{c}{k}") for c in columns])
        out = out.join(own, pattern == F.col(f"_p{k}"), "left")
    return out.select(*profiles.columns, *[F.coalesce(*[F.col(f"_{c}{k}") for k in range(3)]).alias(c) for c in columns])


def common_prefix(current: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """How many leading positions (position from 0, hash, tokens) agree, and their tokens."""
    old = previous.select(*keys, "position", F.col("hash").alias("old_hash"))
    both = current.join(old, [*keys, "position"], "left").withColumn("same", F.coalesce(F.col("hash") == F.col("old_hash"), F.lit(False)))
    upto = Window.partitionBy(*keys).orderBy("position")
    agreeing = both.withColumn("ok", F.min(F.col("same").cast("int")).over(upto))
    return agreeing.groupBy(*keys).agg(F.sum("ok").alias("prefix"), F.sum(F.col("ok") * F.col("tokens")).alias("reusable"))
