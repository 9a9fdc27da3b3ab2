"""Queries over a stored semantic index of conversations; it is synchronised twice, as entries change between."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import history as H
from mnemospark.operators import retrieval as R
from mnemospark.operators.semantic import Index
from mnemospark.plans.content import FEATURES
from mnemospark.plans.registry import query
from mnemospark.storage import materialize, new_path

ASKED = "rq as (select conv_id, max(turn) as asked_at, arg_max(trim(coalesce(text, '')), turn) as request from conversations where role = 'user' group by 1)"


def synced(t):
    """Entries, the index, and what its second run did: before it, one of five entries had other words and one of seven was not there; private ones are held back."""
    found = materialize(H.entries(t.conversations), "entries")
    now = R.entry_sources(found)
    index = Index(found.sparkSession, new_path(found.sparkSession, "semantic"))
    k = F.substring_index("source_key", ":", -1).cast("int") + F.col("scope").cast("int")
    was = R.entry_sources(found.withColumn("text", F.when((F.col("session_id") + F.col("created_at")) % 5 == 0, F.concat(F.lit("before "), "text")).otherwise(F.col("text")))).where(k % 7 != 0)
    gate = lambda text: F.when(~F.contains(text, F.lit("password")), text)
    index.sync(was, "entry", gate)
    return found, index, index.sync(now, "entry", gate)


@query(
    "with e as (select conv_id, turn, coalesce(text, '') as text, (conv_id + turn) % 5 = 0 or (conv_id + turn) % 7 = 0 as fresh, contains(coalesce(text, ''), 'password') as private from conversations where length(trim(coalesce(text, ''))) > 0) "
    "select cast(conv_id as varchar) as scope, count(*) as sources, count(*) filter (where not fresh and not private) as cached, count(*) filter (where fresh and not private) as indexed, count(*) filter (where private) as private, cast(0 as bigint) as beyond, true as fresh from e group by 1"
)
def semantic_runs(t):
    """What a second run embeds of each session: only entries that are new or have other words, and none that are private."""
    return synced(t)[2].drop("kind")


@query(
    f"with {ASKED}, documents as (select conv_id || ':' || turn as doc_id, text from conversations join rq using (conv_id) where turn < asked_at and length(trim(coalesce(text, ''))) > 0 and not contains(text, 'password') "
    f"union all select 'q' || conv_id, request from rq), {FEATURES}, "
    "f as (select doc_id, 'token:' || t f, 1 + ln(count(*)) v from (select doc_id, unnest(w) t from st) group by doc_id, t union all select doc_id, 'pair:' || w[i] || ':' || w[i + 1], 0.35 from st, unnest(range(1, len(w))) u(i) "
    "union all select doc_id, 'empty', 1.0 from st where len(w) = 0), g as (select doc_id, f, sum(v) v, sha256(f) h from f group by all), "
    "b as (select doc_id, cast('0x' || substr(h, 1, 8) as bigint) % 256 bucket, sum(v * case when cast('0x' || substr(h, 9, 2) as bigint) % 2 = 0 then 1.0 else -1.0 end) v from g group by all), "
    "n as (select doc_id, bucket, v / sqrt(sum(v * v) over (partition by doc_id)) v from b), "
    "s as (select rq.conv_id, x.doc_id, round(sum(x.v * q.v), 9) sim from rq join n q on q.doc_id = 'q' || rq.conv_id join n x on x.bucket = q.bucket and split_part(x.doc_id, ':', 1) = cast(rq.conv_id as varchar) where contains(x.doc_id, ':') group by 1, 2) "
    "select cast(conv_id as varchar) as scope, doc_id as source_key, round(sim, 6) as similarity, cast(row_number() over (partition by conv_id order by sim desc, doc_id) - 1 as int) as vector_order from s where sim >= 0.1 qualify vector_order < 80"
)
def semantic_hits(t):
    """The entries before each session's request that are most like it; nothing but requests is embedded for it."""
    found, index, _ = synced(t)
    asked = H.requests(found)
    eligible = found.join(asked, "session_id").where((F.col("created_at") < F.col("asked_at")) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    hits = index.search("entry", asked.select(F.col("session_id").alias("scope"), F.col("request").alias("text")), R.entry_sources(eligible))
    return hits.select("scope", "source_key", F.round("similarity", 6).alias("similarity"), "vector_order")
