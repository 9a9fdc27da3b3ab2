"""Forests by intervals, and recall over branch, session, lineage and project.

Each node of a forest gets the places at which a walk round it enters and leaves the node, so that "is an ancestor of" is a comparison
of numbers. The walk is a list of two events a node, each of which knows the next; pointer doubling numbers it in as many rounds as the
logarithm of its length, however deep the forest is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators import history as H
from mnemospark.storage import drop_path, materialize, written


def labels(nodes: DataFrame) -> DataFrame:
    """(node, enter, exit) of ``nodes`` (node, parent): a node's interval holds those of its descendants. A null or unknown parent makes a root.

    Numbers rise along the walk and are unique within a tree; nodes on a circle get none.
    """
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    rows = nodes.select("node", "parent").dropDuplicates(["node"]).join(known.distinct(), "parent", "left")
    rows = rows.select("node", F.when(F.col("there"), F.col("parent")).alias("parent"))
    beside = Window.partitionBy("parent").orderBy("node")
    roots = rows.where("parent is null").withColumn("next", F.lit(None).cast(rows.schema["node"].dataType))
    rows = rows.where("parent is not null").withColumn("next", F.lead("node").over(beside)).unionByName(roots)
    first = rows.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    rows = materialize(rows.join(first, "node", "left"), "forest")
    event = lambda node, leaves: F.struct(node.alias("node"), F.lit(leaves).alias("leaves"))
    enters = rows.select(event(F.col("node"), False).alias("at"), F.when(F.col("child").isNotNull(), event(F.col("child"), False)).otherwise(event(F.col("node"), True)).alias("to"))
    leaves = rows.select(event(F.col("node"), True).alias("at"), F.when(F.col("next").isNotNull(), event(F.col("next"), False)).when(F.col("parent").isNotNull(), event(F.col("parent"), True)).alias("to"))
    walk, old = written(enters.unionByName(leaves).withColumn("steps", F.col("to").isNotNull().cast("long")), "walk")
    left, before = walk.where("to is not null").count(), None
    while left and left != before:
        ahead = walk.select(F.col("at").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        moved = walk.where("to is not null").join(ahead, "to").select("at", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"))
        walk, new = written(walk.where("to is null").unionByName(moved), "walk")
        drop_path(walk.sparkSession, old)
        old, before, left = new, left, walk.where("to is not null").count()
    ended = walk.where("to is null").select("at.node", "at.leaves", "steps")
    return ended.groupBy("node").agg((-F.max(F.when(~F.col("leaves"), F.col("steps")))).alias("enter"), (-F.max(F.when(F.col("leaves"), F.col("steps")))).alias("exit")).where("enter is not null and exit is not null")


def scopes(askers: DataFrame, sessions: DataFrame) -> DataFrame:
    """(asker, session, relation): the sessions that each asker may look into by its scope.

    askers (asker, session, scope), sessions (session, parent, project). Branch and session are the asker's own session, lineage is that and those
    it descends from, project all of its project.
    """
    own = askers.where("scope in ('branch', 'session')").select("asker", "session", F.lit("own").alias("relation"))
    tree = materialize(labels(sessions.select(F.col("session").alias("node"), F.col("parent"))), "sessions")
    # a tree's root tells it from others, as numbers are unique within a tree only
    rooted = materialize(with_root(tree, sessions.select(F.col("session").alias("node"), "parent")), "rooted")
    asked = askers.where("scope = 'lineage'").join(rooted.withColumnRenamed("node", "session"), "session").select("asker", F.col("session").alias("mine"), "root", F.col("enter").alias("at"))
    above = rooted.join(asked, "root").where((F.col("enter") <= F.col("at")) & (F.col("at") <= F.col("exit")))
    lineage = above.select("asker", F.col("node").alias("session"), F.when(F.col("node") == F.col("mine"), "own").otherwise("lineage").alias("relation"))
    mine = askers.where("scope = 'project'").join(sessions.select("session", "project"), "session").select("asker", F.col("session").alias("mine"), "project")
    project = sessions.join(mine, "project").select("asker", "session", F.when(F.col("session") == F.col("mine"), "own").otherwise("project").alias("relation"))
    return own.unionByName(lineage).unionByName(project)


def with_root(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree`` (node, enter, exit) with the root of each node, by doubling the way up."""
    known = tree.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    up = nodes.join(known, "parent", "left").where("there").select("node", "parent")
    ways, old = written(tree.join(up, "node", "left").select("node", "enter", "exit", F.coalesce("parent", "node").alias("root")), "roots")
    while True:
        top = ways.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved, new = written(ways.join(top, "root").select("node", "enter", "exit", F.col("above").alias("root"), (F.col("root") != F.col("above")).alias("moved")), "roots")
        done = moved.where("moved").isEmpty()
        ways = moved.drop("moved")
        drop_path(ways.sparkSession, old)
        old = new
        if done:
            return ways


def recall(entries: DataFrame, sessions: DataFrame, askers: DataFrame, limit: int = 5) -> DataFrame:
    """(asker, session, entry_id, relation, score, rank): the entries that best match each asker's words, within its scope, by BM25 over that scope.

    entries (session, entry_id, parent_id, text), sessions (session, parent, project), askers (asker, session, leaf, scope, terms array). Entries are
    searched once: postings of asked words meet askers by (session, word), and no text goes with them. On a branch are the entries from the session's root to
    the leaf. Scores are rounded to six places; ties go to the lesser entry_id.
    """
    key = ["session", "entry_id"]
    words = materialize(askers.select("asker", "session", "leaf", "scope", F.explode(F.array_distinct("terms")).alias("term")), "words")
    reach = materialize(scopes(askers.select("asker", "session", "scope"), sessions), "reach")
    postings = H.postings(entries, key, {"text": (F.col("text"), 1.0)})
    found = materialize(postings.join(words.select("term").distinct(), "term", "left_semi"), "postings")
    sizes = entries.select(*key, F.regexp_count(H.T.lexical(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+")).alias("dl"))
    places = materialize(labels(entries.select(F.col("entry_id").alias("node"), F.col("parent_id").alias("parent"))), "places")
    at = places.select(F.col("node").alias("entry_id"), "enter", "exit")
    leaf = askers.where("scope = 'branch'").select("asker", "session", F.col("leaf").alias("entry_id")).join(at, "entry_id").select("asker", "session", F.col("enter").alias("leaf_enter"))
    on_branch: Column = (F.col("enter") <= F.col("leaf_enter")) & (F.col("leaf_enter") <= F.col("exit"))
    # what a scope holds: whole sessions by their sums, branches by their entries' numbers
    sums = sizes.groupBy("session").agg(F.count("*").alias("n"), F.sum("dl").alias("dl"))
    whole = reach.join(askers.where("scope != 'branch'").select("asker"), "asker", "left_semi").join(sums, "session").groupBy("asker").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl"))
    branch = materialize(sizes.join(leaf.select("session").distinct(), "session", "left_semi").join(at, "entry_id").join(leaf, "session").where(on_branch).select("asker", *key, "dl"), "branch")
    held = whole.unionByName(branch.groupBy("asker").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")))
    hits = reach.join(words.select("asker", "scope", "term"), "asker").join(found, ["session", "term"])
    hits = hits.join(branch.select("asker", *key, F.lit(True).alias("on")), ["asker", *key], "left").where((F.col("scope") != "branch") | F.col("on"))
    hits = materialize(hits.select("asker", *key, "relation", "term", "tf", F.col("dl").alias("own_dl")), "hits")
    df = hits.groupBy("asker", "term").agg(F.count("*").alias("df"))
    added = H.part(F.col("tf"), F.col("own_dl"), F.col("df"), F.col("n"), F.col("dl") / F.col("n"))
    scored = hits.join(df, ["asker", "term"]).join(held, "asker").groupBy("asker", *key, "relation").agg(F.round(F.sum(added), 6).alias("score"))
    return H.top(scored, ["asker"], [F.desc("score"), F.asc("entry_id")], limit)
