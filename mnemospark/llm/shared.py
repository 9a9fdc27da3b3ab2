"""What long jobs of this subpackage share: tables in the shared folder, joins on hot keys, and shuffles let go."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.storage import drop_path, exists, materialize, new_path, shared_dir, written

__all__ = ["drop_path", "exists", "materialize", "new_path", "settled", "shared_dir", "spread_join", "written"]


def settled(df: DataFrame, name: str) -> DataFrame:
    """As `materialize`, and the shuffles that made the table are let go.

    Shuffle files stay until the driver collects its garbage, which on a large job may be hours; once the table is written nothing needs them.
    """
    result = materialize(df, name)
    for _ in range(4):  # Python's own references go first, a moment later Spark's, then the executors' files
        gc.collect()
        time.sleep(0.75)
        df.sparkSession._jvm.System.gc()
    return result


def spread_join(left: DataFrame, right: DataFrame, key: str, by: list[str], counts: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """``left`` left-joined with ``right`` (one row a ``key``), without a task that gets all rows of a hot key.

    A key with more than one in ``most`` of the left rows is hot, so there are fewer than ``most`` of them, whatever the size:
    the list of hot keys is broadcast. Rows of a hot key are dealt by a hash of ``by`` over as many salts as its
    share needs, and its right row is copied to each; all copies together are fewer than 2 * ``most``. Null keys join nothing.
    ``counts`` (key, rows_of_key) may be given where it is known.
    """
    if counts is None:
        counts = materialize(left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows_of_key")), "counts")
    total = counts.agg(F.sum("rows_of_key")).first()[0] or 0
    hot = counts.where(F.col("rows_of_key") * most > total).select(key, F.ceil(F.col("rows_of_key") * most / max(1, total)).cast("int").alias("salts_of_key"))
    hot = F.broadcast(hot)
    salt = F.when(F.col("salts_of_key").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("salts_of_key")).cast("int"))
    dealt = left.join(hot, key, "left").withColumn("salt_of_key", salt).drop("salts_of_key")
    copies = right.join(hot, key, "left").withColumn("salt_of_key", F.explode(F.sequence(F.lit(0), F.coalesce("salts_of_key", F.lit(1)) - 1))).drop("salts_of_key")
    return dealt.join(copies, [key, "salt_of_key"], "left").drop("salt_of_key")
