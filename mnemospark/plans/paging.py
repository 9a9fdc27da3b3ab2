"""Queries that page through merged sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import paging as P
from mnemospark.plans.registry import query


@query(
    "with n as (select c_custkey as key, c_mktsegment as item from customer where c_custkey % 3 <> 0), i as (select o_custkey as key, min(o_orderpriority) as item from orders group by 1), "
    "m as (select key, item, 'native' as origin from n union all select key, item, 'inherited' from i where key not in (select key from n)) select cast((row_number() over (order by key) - 1) // 400 as int) as page, * from m"
)
def merged_pages(t):
    """All pages of customers' own items and those that their orders bring, four hundred at a time."""
    native = t.customer.where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("item"))
    inherited = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.min("o_orderpriority").alias("item"))
    return P.numbered_pages(native, inherited, "key", 400)
