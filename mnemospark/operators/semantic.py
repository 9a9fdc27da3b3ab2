"""A stored semantic index: sparse unit vectors, each in one row with its source.

A run embeds what is new or changed and nothing else. Its vectors are written first and what is live last, under the run's number, so
a run that failed counts for nothing. In a search each vector meets its scope's request once, and only what is like enough goes on: the result is
that of comparing all of the scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators import history as H
from mnemospark.operators.content import hashed_vectors
from mnemospark.storage import dealt, exists, materialize

SCOPE = ["kind", "scope"]
SOURCE = [*SCOPE, "source_key", "source_hash"]


@dataclass(frozen=True)
class Model:
    """What made the vectors; those of another model, provider or chunking are never compared."""

    provider: str = "local"
    name: str = "feature-hash"
    dimensions: int = 256
    chunking: str = "v1"

    @property
    def profile(self) -> str:
        return f"{self.provider}/{self.name}/{self.dimensions}/{self.chunking}"


def embedded(texts: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, buckets, values) without zeros; the port behind which another embedding would stand."""
    return hashed_vectors(texts.select(key, "text"), key, model.dimensions)


def runs(spark: SparkSession, path: str) -> list[int]:
    """Finished runs, in order."""
    folder = f"{path}/live"
    if not exists(spark, folder):
        return []
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(int(f.getPath().getName().split("=")[1]) for f in found if exists(spark, f"{f.getPath()}/_SUCCESS"))


def text_gate(text: Column) -> Column:
    """The gate that lets every text through. A gate gives the text that may be embedded, or null."""
    return text


class Index:
    """The index at ``path`` in a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, path: str, model: Model = Model()):
        self.spark, self.path, self.model = spark, path, model

    def live(self) -> DataFrame:
        """(kind, scope, source_key, source_hash) that have a vector of this model."""
        done = runs(self.spark, self.path)
        schema = "kind string, scope string, source_key string, source_hash string, profile string"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/live/run={done[-1]}") if done else self.spark.createDataFrame([], schema)
        return rows

    def stored(self, name: str, schema: str) -> DataFrame:
        """A table of finished runs that are of this model."""
        done = runs(self.spark, self.path)
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema + ", run int").parquet(f"{self.path}/{name}").where(F.col("run").isin(done) & (F.col("profile") == self.model.profile))

    def sync(self, sources: DataFrame, kind: str, gate=text_gate, most: int | None = None, complete: bool = True) -> DataFrame:
        """Bring the vectors of ``kind`` up to ``sources`` (scope, source_key, source_hash, text); a row of counts for each scope.

        Blank texts are no sources and one that is repeated is one. What is stored with the same hash is kept, what ``gate`` holds
        back is not embedded. Of a scope the first ``most`` by key and hash are taken, where that is given. If ``complete``, vectors of a scope whose source is gone or changed are dropped, unless it
        has more sources than are taken.
        """
        spark, run = self.spark, max(runs(self.spark, self.path), default=0) + 1
        rows = sources.where(F.coalesce("text", F.lit("")).rlike(r"\S")).select(F.lit(kind).alias("kind"), F.col("scope").cast("string").alias("scope"), "source_key", "source_hash", "text").dropDuplicates(SOURCE)
        if most is not None:
            first = Window.partitionBy(*SCOPE).orderBy("source_key", "source_hash")
            rows = rows.withColumn("beyond", F.row_number().over(first) > most)
        else:
            rows = rows.withColumn("beyond", F.lit(False))
        had = self.live()
        mine = had.where((F.col("kind") == kind) & (F.col("profile") == self.model.profile))
        known = mine.select(*SOURCE, F.lit(True).alias("known"))
        rows = materialize(rows.join(known, SOURCE, "left").withColumn("prepared", gate(F.col("text"))), "sources")
        action = F.when(F.col("beyond"), "beyond").when(F.col("known"), "cached").when(F.col("prepared").isNull(), "private").otherwise("indexed")
        rows = rows.withColumn("action", action)
        new = rows.where("action = 'indexed'").select(F.struct(*SOURCE).alias("id"), F.col("prepared").alias("text"))
        vectors = embedded(new, "id", self.model).select("id.*", "buckets", "values", F.lit(self.model.profile).alias("profile"))
        vectors.write.mode("overwrite").parquet(f"{self.path}/vectors/run={run}")
        counts = rows.groupBy(*SCOPE).agg(
            F.count_if(F.col("action") != "beyond").alias("sources"), *[F.count_if(F.col("action") == a).alias(a) for a in ("cached", "indexed", "private", "beyond")]
        )
        kept = rows.where("action in ('cached', 'indexed')").select(*SOURCE)
        if complete:
            over = counts.where("beyond > 0").select(*SCOPE)
            kept = kept.unionByName(mine.select(*SOURCE).join(over, SCOPE, "left_semi")).distinct()
        else:
            kept = kept.unionByName(mine.select(*SOURCE)).distinct()
        kept = kept.withColumn("profile", F.lit(self.model.profile))
        kept.unionByName(had.where((F.col("kind") != kind) | (F.col("profile") != self.model.profile))).write.mode("overwrite").parquet(f"{self.path}/live/run={run}")
        return counts.withColumn("fresh", F.lit(complete) & (F.col("beyond") == 0))

    def search(self, kind: str, requests: DataFrame, within: DataFrame | None = None, limit: int = 80, least: float = 0.1, gate=text_gate) -> DataFrame:
        """(scope, source_key, source_hash, similarity, vector_order): the sources of each request's scope most like it, ``least`` or more.

        requests (scope, text), one a scope. ``within`` (scope, source_key, source_hash) are those that count, each as it is now: a vector of other content is
        no hit. Similarities are rounded to nine places; ties go to the lesser key. ``least`` is above 0, as texts without a common bucket are never met.
        """
        if least <= 0:
            raise ValueError("the least similarity has to be above 0")
        wanted = requests.select(F.col("scope").cast("string").alias("scope"), gate(F.col("text")).alias("text")).where("text is not null")
        # a text that many ask is embedded once; a request's vector has a place for each bucket, so that a value is found by its number
        places = F.sequence(F.lit(0), F.lit(self.model.dimensions - 1))
        dense = F.transform(places, lambda k: F.coalesce(F.try_element_at(F.map_from_arrays("buckets", "values"), k), F.lit(0.0)))
        asked = embedded(dealt(wanted.select("text").distinct(), "text").select(F.struct("text").alias("id"), "text"), "id", self.model).select("id.text", dense.alias("asked"))
        asked = materialize(wanted.join(asked, "text").select("scope", "asked"), "asked")
        vectors = self.stored("vectors", "kind string, scope string, source_key string, source_hash string, buckets array<int>, values array<double>, profile string").where(F.col("kind") == kind)
        alive = self.live().where((F.col("kind") == kind) & (F.col("profile") == self.model.profile)).select("scope", "source_key", "source_hash")
        if within is not None:
            alive = alive.join(within.select(F.col("scope").cast("string").alias("scope"), "source_key", "source_hash").distinct(), ["scope", "source_key", "source_hash"], "left_semi")
        key = ["scope", "source_key", "source_hash"]
        product = F.aggregate(F.zip_with("buckets", "values", lambda b, v: v * F.get("asked", b)), F.lit(0.0), lambda total, x: total + x)
        near = vectors.select(*key, "buckets", "values").join(asked, "scope").select(*key, F.round(product, 9).alias("similarity")).where(F.col("similarity") >= least)
        # a source that was gone and came back has been embedded twice, the same each time
        scored = near.dropDuplicates(key).join(alive, key, "left_semi")
        return H.top(scored, ["scope"], [F.desc("similarity"), F.asc("source_key"), F.asc("source_hash")], limit, "vector_order")
