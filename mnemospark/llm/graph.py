"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.shared import drop_path, materialize, spread_join, written

#: Rows that one task may have of one key; where no key can have more, rows need no dealing.
FEW = 50_000


def met(left: DataFrame, right: DataFrame, key: str, by: str, counts: DataFrame, spread: bool) -> DataFrame:
    """``left`` joined with ``right`` (one row a key); rows of a hot key are dealt over tasks where one may have many."""
    return spread_join(left, right, key, [by], counts) if spread else left.join(right, key, "left")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node in ``links`` (a, b); the component's name is its smallest node.

    Each round takes the smallest name among neighbours and then the name of that name, so rounds grow with the
    logarithm of a chain's length. Each round is written to the shared folder in place of the one before. Links at a hub, and the nodes of a large component,
    are dealt over tasks by their share of all.
    """
    spark = links.sparkSession
    both, path = written(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    degrees = materialize(both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("rows_of_key"), F.min("b").alias("least")), "degrees")
    most, nodes = degrees.agg(F.max("rows_of_key"), F.count("*")).first()
    hubs, large = (most or 0) > FEW, nodes > FEW
    names, old = written(degrees.select(F.col("b").alias("node"), F.least("least", "b").alias("component")), "names")
    degrees = degrees.drop("least")
    while True:
        near = met(both, names.select(F.col("node").alias("b"), "component"), "b", "a", degrees, hubs)
        seen = near.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = names.join(seen, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = names.select(F.col("node").alias("component"), F.col("component").alias("top"))
        sizes = None
        if large:
            step, stepped = written(step, "step")
            sizes = materialize(step.groupBy("component").agg(F.count("*").alias("rows_of_key")), "sizes")
        new, place = written(met(step, up, "component", "node", sizes, large).select("node", "old", F.least("component", "top").alias("component")), "names")
        drop_path(spark, old)
        if large:
            drop_path(spark, stepped)
        if new.where("old != component").isEmpty():
            drop_path(spark, path)
            return new.select("node", "component")
        names, old = new.select("node", "component"), place
