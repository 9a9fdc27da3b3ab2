"""Learned ranking and context quality: training, scoring, disagreement, promotion, aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.text import half_up


def clamped(x: Column) -> Column:
    """Within 0 and 1, rounded to nine digits; null and non-finite values are 0."""
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(half_up(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 9))


def bounded(x: Column, most: float = 16.0) -> Column:
    return half_up(F.greatest(F.lit(-most), F.least(F.lit(most), x)), 9)


def train(samples: DataFrame, features: list[str], source: str = "source_kind", minimum: int = 20) -> DataFrame:
    """(feature, weight) of a centroid model from samples (useful boolean, source, features).

    A numeric feature weighs four times the difference of its class means, a source twice that of its rates, the bias
    twice the share of useful samples less a half. Empty with fewer samples than ``minimum`` or only one label.
    """
    good, bad = F.col("useful"), ~F.col("useful")
    means = [bounded((F.avg(F.when(good, F.col(f))) - F.avg(F.when(bad, F.col(f)))) * 4).alias(f) for f in features]
    totals = samples.agg(F.count("*").alias("n"), F.count_if(good).alias("pos"), F.count_if(bad).alias("neg"), bounded((F.avg(F.col("useful").cast("double")) - 0.5) * 2).alias("bias"), *means)
    usable = totals.where((F.col("n") >= minimum) & (F.col("pos") > 0) & (F.col("neg") > 0))
    numeric = usable.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("weight")) for f in ("bias", *features)])))
    kinds = samples.groupBy(source).agg(F.count_if(good).alias("p"), F.count_if(bad).alias("q")).join(F.broadcast(usable.select("pos", "neg")))
    rates = kinds.select(F.concat(F.lit("source:"), F.col(source)).alias("feature"), bounded((F.col("p") / F.col("pos") - F.col("q") / F.col("neg")) * 2).alias("weight"))
    return numeric.union(rates)


def score(candidates: DataFrame, model: DataFrame, features: list[str], source: str = "source_kind") -> DataFrame:
    """``candidates`` with learned_score: bias, source weight and the weighted features. The model is a few rows, one a feature or source."""
    numeric = model.where(F.col("feature").isin("bias", *features)).groupBy().pivot("feature", ["bias", *features]).agg(F.first("weight"))
    numeric = numeric.select(*[F.col(f).alias(f"_w_{f}") for f in ("bias", *features)])
    kinds = model.where(F.startswith("feature", F.lit("source:"))).select(F.substring("feature", 8, 1000).alias(source), F.col("weight").alias("_w_source"))
    rows = candidates.join(F.broadcast(numeric)).join(F.broadcast(kinds), source, "left")
    total = F.col("_w_bias") + F.coalesce("_w_source", F.lit(0.0))
    for f in features:
        total = total + F.col(f"_w_{f}") * F.col(f)
    return rows.select(*candidates.columns, half_up(total, 9).alias("learned_score"))


def ranks(scored: DataFrame, key: str, by: str, name: str) -> DataFrame:
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), F.asc("id"))) - 1)


def inversions(ranked: DataFrame, key: str) -> DataFrame:
    """(key, inversions): pairs of a key's candidates that two rankings order differently, counted without making pairs.

    The learned ranks of such a pair agree down to one bit, which the earlier by static rank has set and the later has not.
    So at each bit each row without it counts the rows with it before it among those of equal higher bits.
    """
    bits = F.length(F.bin(F.max("learned_rank").over(Window.partitionBy(key))))
    rows = ranked.select(key, "static_rank", "learned_rank", bits.alias("_bits")).withColumn("_bit", F.explode(F.sequence(F.lit(1), F.col("_bits"))))
    rows = rows.select(key, "static_rank", "_bit", F.expr("shiftright(learned_rank, _bit)").alias("_high"), F.expr("shiftright(learned_rank, _bit - 1) & 1").alias("_set"))
    before = F.sum("_set").over(Window.partitionBy(key, "_bit", "_high").orderBy("static_rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_before", before).groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("_set") == 0, F.col("_before"))), F.lit(0)).alias("inversions"))


def disagreement(ranked: DataFrame, key: str) -> DataFrame:
    """Pairs of a key's candidates that two rankings order differently, and the mean shift."""
    shift = ranked.groupBy(key).agg(half_up(F.avg(F.abs(F.col("static_rank") - F.col("learned_rank")))).alias("mean_shift"), F.count("*").alias("candidates"))
    return shift.join(inversions(ranked, key), key, "left").withColumn("inversions", F.coalesce("inversions", F.lit(0)))


def quality_score(recall: Column, irrelevant: Column, provenance: Column, retention: Column, atomic: Column, overflow: Column, fallback: Column) -> Column:
    """Weighted quality of a plan; a null rate counts as perfect."""
    rate = lambda x, default=1.0: F.coalesce(x, F.lit(default))
    reliable = F.greatest(F.lit(0.0), 1 - F.greatest(overflow, fallback))
    return half_up(rate(recall) * 0.35 + (1 - rate(irrelevant, 0.0)) * 0.2 + rate(provenance) * 0.15 + rate(retention) * 0.15 + rate(atomic) * 0.1 + reliable * 0.05)


def micro_average(samples: DataFrame, by: list[str], parts: list[str]) -> DataFrame:
    """Rates whose numerators and denominators (part_n, part_d) are summed before they are divided; null without any."""
    sums = samples.groupBy(*by).agg(F.count("*").alias("samples"), *[F.sum(f"{p}_{x}").alias(f"{p}_{x}") for p in parts for x in "nd"])
    return sums.select(*by, "samples", *[half_up(F.try_divide(F.col(f"{p}_n"), F.col(f"{p}_d"))).alias(p) for p in parts])


def timing(samples: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """Mean, nearest-rank 95th percentile and latest value."""
    return samples.groupBy(*by).agg(F.count("*").alias("samples"), half_up(F.avg(value)).alias("mean"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.max_by(value, at).alias("latest"))


def promotion(metrics: DataFrame) -> DataFrame:
    """Whether a learned model may replace static ranking: score gain, and no loss of recall or of forbidden evidence."""
    gain = half_up(F.col("learned_score") - F.col("static_score"), 9)
    reasons = F.array_compact(F.array(
        F.when(F.col("samples") < 20, "too-few-samples"), F.when(gain <= 0, "no-gain"), F.when(F.col("learned_recall") < F.col("static_recall"), "recall-loss"), F.when(F.col("forbidden") > 0, "forbidden-evidence")
    ))
    return metrics.withColumn("gain", gain).withColumn("reasons", reasons).withColumn("promoted", F.size("reasons") == 0)


def last_labels(feedback: DataFrame, most: int) -> DataFrame:
    """The first label of each feedback id; of those the last ``most`` accepted of each session, by time and id."""
    first = Window.partitionBy("session", "feedback_id").orderBy("created_at", "entry_id")
    kept = feedback.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    newest = Window.partitionBy("session").orderBy(F.desc("created_at"), F.desc("entry_id"))
    return kept.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= most)


def inventory(items: DataFrame, key: str) -> DataFrame:
    """A manifest's items and tokens by kind, and a digest of its items in order."""
    kinds = items.groupBy(key, "kind").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    by_kind = kinds.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "items", "tokens"))).alias("kinds"))
    # digests of each item in order; a manifest holds a bounded number of items
    ordered = items.groupBy(key).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "id"))), lambda x: x["id"]), ","), 256).alias("digest"))
    return by_kind.select(key, F.array_join("kinds", ",").alias("kinds")).join(ordered, key)
