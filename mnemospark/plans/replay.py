"""Queries that replay a strategy over candidates; lines of orders stand for candidates, suppliers for fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import replay as R
from mnemospark.plans.registry import query


@query("""
with recursive c as (select l_suppkey as fixture, l_orderkey * 10 + l_linenumber as id, 'g' || (l_orderkey % 50) as grp, l_returnflag as kind, cast(l_quantity as bigint) as tokens, l_extendedprice as score, l_linenumber = 1 and l_partkey % 97 = 0 as current from lineitem),
b as (select distinct fixture, case when fixture % 7 = 0 then 100 else 2000 + fixture % 5 * 1500 end as total from c),
g as (select fixture, grp, bool_or(current) as mandatory, max(score) as score, sum(tokens) as tokens, coalesce(sum(tokens) filter (where kind = 'A'), 0) as a, coalesce(sum(tokens) filter (where kind = 'R'), 0) as r from c group by 1, 2),
o as (select g.*, total, row_number() over (partition by g.fixture order by mandatory desc, score desc, grp) as place from g join b on b.fixture = g.fixture),
w as (select fixture, cast(0 as bigint) as place, cast(0 as hugeint) as used, cast(0 as hugeint) as ua, cast(0 as hugeint) as ur, false as failed, false as took from b union all
  select o.fixture, o.place, used + case when fit then tokens else 0 end, ua + case when fit then a else 0 end, ur + case when fit then r else 0 end, failed or (mandatory and not fit), fit
  from (select w.used, w.ua, w.ur, w.failed, o.*, w.used + o.tokens <= o.total and (o.a = 0 or w.ua + o.a <= 1200) and (o.r = 0 or w.ur + o.r <= 900) as fit from w join o on o.fixture = w.fixture and o.place = w.place + 1) o),
e as (select fixture, bool_or(failed) as fallback, max(used) as used from w group by 1), al as (select fixture, sum(tokens) as total_tokens from c group by 1)
select c.fixture, id, took or fallback as selected, case when fallback then 'fail-open-retained' when not took then 'strategy-or-budget-drop' when current then 'mandatory-current-request' else 'static-v1-selected' end as reason, fallback, case when fallback then total_tokens else e.used end > b.total as overflow
from c join o on o.fixture = c.fixture and o.grp = c.grp join w on w.fixture = o.fixture and w.place = o.place join e on e.fixture = c.fixture join al on al.fixture = c.fixture join b on b.fixture = c.fixture""")
def replay_planner(t):
    """Which candidates a strategy keeps: mandatory groups first, a total budget, budgets for two of three categories."""
    fixture = F.col("l_suppkey")
    rows = t.lineitem.select(
        fixture.alias("fixture"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("g"), F.col("l_orderkey") % 50).alias("group"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").cast("long").alias("tokens"),
        F.col("l_extendedprice").alias("score"), ((F.col("l_linenumber") == 1) & (F.col("l_partkey") % 97 == 0)).alias("current"),
    )
    total = F.when(fixture % 7 == 0, 100).otherwise(2000 + fixture % 5 * 1500)
    kinds = F.create_map(F.lit("A"), F.lit(1200).cast("long"), F.lit("R"), F.lit(900).cast("long"))
    budgets = t.lineitem.select("l_suppkey").distinct().select(fixture.alias("fixture"), total.alias("total"), kinds.alias("kinds"))
    return R.planned(rows, budgets, "static-v1", fold=20)
