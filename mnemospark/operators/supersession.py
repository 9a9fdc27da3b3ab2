"""Memory whose mutations come from many sessions of a project: what each item is now, and what replaced it.

Nothing hangs on the order in which sources arrive: mutations have a total order of their own, creations are looked at before
statuses, and the last event that is in force decides. Chains of replacements are followed by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.storage import drop_path, materialize, written

#: A mutation's place among all, whatever file it was read from.
PLACE = ("created_at", "session", "nth", "mutation_id")
MADE = ["item_id", "scope", "session", "project", "key", "claim"]


def candidates(files: DataFrame, known: DataFrame, project: str, active: str, most: int) -> DataFrame:
    """Session files of one ``project`` to be synchronised, with what is to be done about each: (session, file, state, reason).

    ``files``: file, session, cwd, version, header_ok; ``known`` are the project's sources so far (session, file); ``active`` is the
    session that asks. Besides its file the newest ``most`` by name are taken, and known ones in what room is left. Of two files with one session the
    newer counts. A state is ready, corrupt (a header that can't be read, another project's, a newer format), or missing.
    """
    newest = Window.orderBy(F.desc("file"))
    others = files.where(~F.col("session").eqNullSafe(active)).withColumn("rank", F.row_number().over(newest))
    known_files = known.select(F.col("file").alias("known_file"), F.col("session").alias("known_session"))
    listed = others.join(known_files, F.col("file") == F.col("known_file"), "left")
    taken = listed.where(F.col("rank") <= most).unionByName(files.where(F.col("session").eqNullSafe(active)).join(known_files, F.col("file") == F.col("known_file"), "left").withColumn("rank", F.lit(0)))
    reason = (
        F.when(~F.col("header_ok"), "invalid-header").when(~F.col("cwd").eqNullSafe(F.lit(project)), "other-project").when(F.coalesce("version", F.lit(0)) > 3, "unsupported-version")
    )
    # a file that is bad counts only where it was a source before
    rows = taken.withColumn("reason", reason).withColumn("session", F.when(F.col("reason").isNull(), F.col("session")).otherwise(F.col("known_session"))).where("session is not null")
    first = Window.partitionBy("session").orderBy("rank")
    rows = rows.withColumn("copy", F.row_number().over(first)).where("copy = 1")
    rows = rows.select("session", "file", F.when(F.col("reason").isNull(), "ready").otherwise("corrupt").alias("state"), "reason")
    gone = known.join(rows.select("session"), "session", "left_anti").join(files.select("file", F.lit(True).alias("there")), "file", "left")
    return rows.unionByName(gone.select("session", "file", F.when(F.col("there"), "corrupt").otherwise("missing").alias("state"), F.when(F.col("there"), "beyond-most-sessions").otherwise("file-missing").alias("reason")))


def enabled(mutations: DataFrame, sources: DataFrame) -> DataFrame:
    """``mutations`` with ``enabled``: their session is not excluded, and ready where it is known. ``sources``: session, status, excluded."""
    state = sources.select("session", (~F.coalesce("excluded", F.lit(False)) & (F.coalesce("status", F.lit("ready")) == "ready")).alias("enabled"))
    return mutations.join(state, "session", "left").withColumn("enabled", F.coalesce("enabled", F.lit(True)))


def created(rows: DataFrame) -> DataFrame:
    """The creation that counts for each item: the first that is enabled and whose project is its session's own."""
    tried = rows.where(F.col("op").isin("add", "supersede") & ((F.col("scope") != "project") | F.col("enabled")))
    fits = (F.col("scope") != "project") | F.coalesce(F.col("item_project") == F.col("project"), F.lit(False))
    value = F.struct(*PLACE, "scope", "item_project", "key", "claim")
    first = tried.where(fits).groupBy("item_id").agg(F.min(value).alias("m"))
    return first.select("item_id", "m.scope", F.col("m.session").alias("session"), F.col("m.item_project").alias("project"), "m.key", "m.claim", "m.mutation_id", F.struct(*[F.col(f"m.{c}") for c in PLACE]).alias("made"))


def about(items: DataFrame, name: str) -> DataFrame:
    return items.select(*[F.col(c).alias(f"{name}_{c}") for c in ("item_id", "scope", "session", "project", "mutation_id")])


def own(name: str) -> Column:
    """Whether a mutation's session may change an item: the session's own, or one of its project."""
    return F.when(F.col(f"{name}_scope") == "session", F.col(f"{name}_session") == F.col("session")).otherwise(F.coalesce(F.col(f"{name}_project") == F.col("project"), F.lit(False)))


def chained(links: DataFrame) -> DataFrame:
    """(item_id, current, cyclic) of ``links`` (item_id, next): the end of each chain, null where it leads into a circle.

    Each round a pointer becomes the pointer of what it points to. On the way to an end there are items at every distance, so once a round
    ends none of the open ones they all go round for ever.
    """
    spark = links.sparkSession
    ends = links.select(F.col("item_id").alias("end"))
    # an item without a link of its own ends a chain
    pointers = links.join(ends, F.col("next") == F.col("end"), "left").select("item_id", F.col("next").alias("to"), F.col("end").isNull().alias("done"))
    pointers, old = written(pointers, "pointers")
    left, before = pointers.where("not done").count(), None
    while left and left != before:
        there = pointers.select(F.col("item_id").alias("to"), F.col("to").alias("further"), F.col("done").alias("over"))
        moved = pointers.where("not done").join(there, "to").select("item_id", F.col("further").alias("to"), F.col("over").alias("done"))
        pointers, new = written(pointers.where("done").unionByName(moved), "pointers")
        drop_path(spark, old)
        old, before, left = new, left, pointers.where("not done").count()
    return pointers.select("item_id", F.when(F.col("done"), F.col("to")).alias("current"), (~F.col("done")).alias("cyclic"))


def materialized(mutations: DataFrame, sources: DataFrame, inherited: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The items that ``mutations`` make, and warnings about those that are not in force.

    ``mutations``: mutation_id, session, project (the session's own), created_at, nth (its place in the session), op (add, supersede, status),
    and of the item made item_id, scope (session, project), item_project, key, claim; previous_id of what it replaces; target_id and status of
    a change. ``sources``: session, status, excluded. ``inherited`` (session, item_id) are items that a session sees by its lineage and can't change.

    Items: item_id, scope, session, project, key, claim, status, superseded_by, current (the end of its chain; itself where nothing replaced
    it; null in a circle), cyclic, updated_at. Of active items with one key in a scope the first made stays, others are invalid. Warnings: (kind, mutation_id, item_id).
    """
    rows = materialize(enabled(mutations, sources).withColumn("place", F.struct(*PLACE)), "mutations")
    items = materialize(created(rows), "items")
    off = (F.col("scope") == "project") & ~F.col("enabled")
    making = rows.where(F.col("op").isin("add", "supersede") & ~off)
    by_id = making.join(items.select("item_id", "made", F.col("claim").alias("first_claim"), F.col("scope").alias("first_scope")), "item_id", "left")
    late = F.col("made").isNotNull() & (F.col("place") > F.col("made"))
    early = F.col("made").isNull() | (F.col("place") < F.col("made"))
    kind = (
        F.when(late & (~F.col("claim").eqNullSafe(F.col("first_claim")) | (F.col("scope") != F.col("first_scope"))), "id-collision")
        .when(early & (F.col("scope") == "project") & F.col("item_project").isNull(), "no-project")
        .when(early & (F.col("scope") == "project") & (F.col("item_project") != F.col("project")), "other-project")
    )
    warnings = by_id.select(kind.alias("kind"), "mutation_id", "item_id").where("kind is not null")

    keys = inherited if inherited is not None else rows.select("session", "item_id").limit(0)
    shielded = keys.select("session", F.col("item_id").alias("target_id"), F.lit(True).alias("shielded")).distinct()
    events = rows.where("op = 'status'").select("*").unionByName(rows.where((F.col("op") == "supersede") & ~off).withColumn("target_id", F.col("previous_id")))
    events = events.join(shielded, ["session", "target_id"], "left").where("shielded is null")
    events = events.join(about(items, "t"), F.col("target_id") == F.col("t_item_id"), "left").join(about(items, "r"), (F.col("op") == "supersede") & (F.col("item_id") == F.col("r_item_id")), "left")
    replaces = F.col("op") == "supersede"
    valid_replacement = F.coalesce(F.col("r_mutation_id") == F.col("mutation_id"), F.lit(False))
    silent = ~replaces & ~F.col("enabled") & (F.col("t_item_id").isNull() | (F.col("t_scope") == "project"))
    fault = (
        F.when(F.col("t_item_id").isNull(), "missing-target").when(replaces & ~valid_replacement, "no-replacement")
        .when((replaces & (F.col("t_scope") != F.col("r_scope"))) | ~own("t"), "crosses-scope")
    )
    judged = events.where(~silent).withColumn("fault", fault)
    warnings = warnings.unionByName(judged.where("fault is not null").select(F.col("fault").alias("kind"), "mutation_id", F.col("target_id").alias("item_id")))
    change = F.struct("place", F.when(replaces, "superseded").otherwise(F.col("status")).alias("status"), F.when(replaces, F.col("item_id")).alias("by"), "created_at")
    last = judged.where("fault is null").groupBy(F.col("target_id").alias("item_id")).agg(F.max(change).alias("last"))
    found = items.join(last, "item_id", "left").select(*MADE, "made", F.coalesce("last.status", F.lit("active")).alias("status"), F.col("last.by").alias("superseded_by"), F.coalesce("last.created_at", "made.created_at").alias("updated_at"))
    # of active items with one key the first made stays
    identity = [F.col("scope"), F.when(F.col("scope") == "session", F.col("session")), F.col("project"), F.col("key")]
    open_ = (F.col("status") == "active") & (F.coalesce("key", F.lit("")) != "")
    firsts = found.where(open_).groupBy(*[c.alias(f"i{k}") for k, c in enumerate(identity)]).agg(F.min("made").alias("first_made"))
    same = [F.col(f"i{k}").eqNullSafe(c) for k, c in enumerate(identity)]
    found = found.join(firsts, [open_, *same], "left").withColumn("clash", F.col("first_made").isNotNull() & (F.col("first_made") != F.col("made")))
    found = found.withColumn("status", F.when(F.col("clash"), "invalid").otherwise(F.col("status"))).drop(*[f"i{k}" for k in range(4)])
    found = materialize(found, "found")
    warnings = warnings.unionByName(found.where("clash").select(F.lit("key-conflict").alias("kind"), F.col("made.mutation_id").alias("mutation_id"), "item_id"))
    chains = chained(found.where("superseded_by is not null").select("item_id", F.col("superseded_by").alias("next")))
    items = found.join(chains, "item_id", "left").select(
        *MADE, "status", "superseded_by", F.when(F.col("superseded_by").isNull(), F.col("item_id")).otherwise(F.col("current")).alias("current"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"), "updated_at"
    )
    return items, warnings
