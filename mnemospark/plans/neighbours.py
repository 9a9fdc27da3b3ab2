"""Queries over all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import neighbours as N
from mnemospark.plans.registry import query


@query(
    "with e as (select vec_id, cast(embedding as double[]) as v, len(embedding) as dims from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "u as (select vec_id, dims, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from e), "
    "p as (select q.vec_id as query_id, x.vec_id as neighbour_id, round(list_inner_product(q.v, x.v) / (q.norm * x.norm), 9) as s from u q join u x on q.dims = x.dims and q.vec_id <> x.vec_id where q.vec_id % 100 = 0) "
    "select query_id, cast(row_number() over (partition by query_id order by s desc, neighbour_id) as int) as rank, neighbour_id, round(s, 6) as similarity from p qualify rank <= 10"
)
def cosine_neighbours(t):
    """The ten vectors most like each hundredth one, of all, whatever their label."""
    found = N.top_k(t.embeddings, "vec_id", "embedding", F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "neighbour_id", F.round("similarity", 6).alias("similarity"))
