"""Queries of composite operators that SQL can't say with reason; tests hold them against versions in plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import history as H
from mnemospark.operators import planning as G
from mnemospark.operators import policies as P
from mnemospark.operators import project as K
from mnemospark.operators import retrieval as R
from mnemospark.plans.files import project_files, project_requests
from mnemospark.plans.memory import messages
from mnemospark.operators.semantic import Index
from mnemospark.plans.registry import query
from mnemospark.storage import materialize, new_path


@query()
def history_retrieval(t):
    """Evidence of all channels for each session's current request; vectors from a stored index."""
    found = materialize(H.entries(t.conversations), "entries")
    index = Index(found.sparkSession, new_path(found.sparkSession, "semantic"))
    index.sync(R.entry_sources(found), "entry")
    return R.retrieve(found, H.requests(found), index=index)


@query()
def history_recall(t):
    """What each session's request recalls of its own session and the next one; a third of all entries is closed."""
    found = H.entries(t.conversations).withColumn("classification", F.when(F.col("created_at") % 3 == 2, "sensitive"))
    asked = H.requests(found).select(F.col("session_id").alias("asker"), "request", F.lit(10**9).alias("asked_at"))
    sessions = found.select("session_id").distinct()
    own = sessions.select(F.col("session_id").alias("asker"), "session_id", F.lit("own").alias("relation"))
    other = sessions.select((F.col("session_id") - 1).alias("asker"), "session_id", F.lit("project").alias("relation"))
    return R.recall(found, asked, own.union(other))


@query()
def managed_plan(t):
    """The managed plan of each conversation, with supplements from its own long entries."""
    rows = messages(t)
    extra = rows.where("tokens > 20").select(
        "session", F.concat(F.lit("x"), "index").alias("id"), F.element_at(F.array(*map(F.lit, ("pin", "memory", "retrieval", "project"))), (F.col("index") % 4 + 1).cast("int")).alias("category"), F.col("tokens").cast("double").alias("score"), F.least(F.lit(60), F.col("tokens")).alias("tokens"),
    )
    return G.managed_plan(rows.withColumn("pinned", F.col("index") % 9 == 8), extra)


@query()
def project_evidence(t):
    """Snippets for each project's request, by path, symbol, text and full text."""
    found, snippets = project_files(t)
    rows, asked = materialize(K.current(snippets, found), "snippets"), project_requests(t)
    wanted = asked.select("request", F.explode(F.array(F.lit("the"), F.lit("run"))).alias("term"))
    fields = {"content": (F.col("content"), 1.0), "path": (F.col("path"), 3.0), "symbols": (F.concat_ws(" ", "symbol_name", "qualified_name"), 4.0)}
    fts = H.weighted_search(rows, "snippet_id", fields, wanted, "request", 40).select("request", "snippet_id", F.col("rank").alias("fts_order"))
    return K.evidence(rows, asked, fts)


@query()
def artifact_report(t):
    """A page's text as a tool's large result in few words."""
    rows = t.pages.select("page_id", P.condensed_output(F.lit("fetch"), F.concat(F.lit("call"), "page_id"), F.col("html"), F.col("page_id") % 7 == 0, F.sha2("html", 256), 3000, 900).alias("report"))
    return rows
