"""Writes: latest-wins upserts and pruning, as new tables in place of old ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one of highest ``order``, incoming before stored where equal."""
    rows = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def pruned(embeddings: DataFrame, sources: DataFrame) -> DataFrame:
    """Embeddings whose source is still there with the same hash (source_key, source_hash)."""
    return embeddings.join(sources.select("source_key", "source_hash"), ["source_key", "source_hash"], "left_semi")


def missing_embeddings(embeddings: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources that have no embedding of their present content: what an incremental run has to embed."""
    return sources.join(embeddings.select("source_key", "source_hash"), ["source_key", "source_hash"], "left_anti")


def sound_vector(vector: Column, dimensions: int) -> Column:
    """Whether a vector has its dimensions, no null or non-finite component, and is not all zeros."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def saved_vectors(stored: DataFrame, incoming: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Embeddings (source_key, source_hash, vector, at) after a write, and the incoming ones that were left out as unsound."""
    marked = incoming.withColumn("_sound", sound_vector(F.col("vector"), dimensions))
    return upserted(stored, marked.where("_sound").drop("_sound"), ["source_key", "source_hash"], "at"), marked.where("not _sound").drop("_sound")


def sync_plan(sources: DataFrame, stored: DataFrame, allowed: Column, most: int, dimensions: int) -> DataFrame:
    """``sources`` (source_key, source_hash, text, ...) with what an index run does with each: cached, private, embed, or beyond.

    Blank texts are no sources, and one that is repeated is one. The first ``most`` by key and hash are indexed, the others are beyond the limit. A sound stored vector of
    the present content is kept; what the privacy gate (``allowed``) holds back is never embedded.
    """
    some = sources.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).dropDuplicates(["source_key", "source_hash"])
    known = stored.where(sound_vector(F.col("vector"), dimensions)).select("source_key", "source_hash").distinct().withColumn("_known", F.lit(True))
    # the first of all by key: a global limit, taken by Spark's top-k without a sort of everything
    first = some.select("source_key", "source_hash").orderBy("source_key", "source_hash").limit(most).withColumn("_first", F.lit(True))
    rows = some.join(first, ["source_key", "source_hash"], "left").join(known, ["source_key", "source_hash"], "left")
    action = F.when(F.col("_first").isNull(), "beyond").when(F.col("_known"), "cached").when(~F.coalesce(allowed, F.lit(False)), "private").otherwise("embed")
    return rows.withColumn("action", action).drop("_first", "_known")
