"""Event-sourced memory, graphs, index states and object references."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.storage import drop_path, written

#: The order in which a lifecycle can only move on.
STATES = ("prepared", "failed", "committed")


def replay(log: DataFrame) -> DataFrame:
    """Current items of a mutation log (session, item, seq, op, key, claim, status): creations first, then statuses.

    The first creation of an item counts; then its last status after that, 'active' without one. Of active items with
    one key in a session the first stays, later ones are invalid. An event of an item that was never created has no effect.
    """
    first = Window.partitionBy("session", "item").orderBy("seq")
    made = log.where("op = 'add'").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("session", "item", F.col("seq").alias("created"), "key", "claim")
    moved = log.where("op = 'status'").groupBy("session", "item").agg(F.max(F.struct("seq", "status")).alias("last"))
    items = made.join(moved, ["session", "item"], "left")
    status = F.when(F.col("last.seq") > F.col("created"), F.col("last.status")).otherwise("active")
    items = items.withColumn("status", status).drop("last")
    same = Window.partitionBy("session", "key", "status").orderBy("created", "item")
    clash = (F.col("status") == "active") & F.col("key").isNotNull() & (F.row_number().over(same) > 1)
    return items.withColumn("status", F.when(clash, "invalid").otherwise(F.col("status")))


def visible(items: DataFrame, session: Column, project: Column, cross_session: bool = True) -> DataFrame:
    """Items that a session sees: its own, and its project's where those of other sessions are let in."""
    own = F.col("session") == session
    return items.where(own | ((F.col("scope") == "project") & (F.col("project") == project) & F.lit(cross_session)))


def contradictions(claims: DataFrame) -> DataFrame:
    """Pairs (left_id < right_id) of a session that share a key, or say the opposite of the same; two equi-joins, united."""
    rows = claims.select("session", "id", T.derived_key(F.col("claim")).alias("key"), T.polarity(F.col("claim")).alias("polarity"), T.contradiction_base(F.col("claim")).alias("base"))
    left = rows.select("session", *[F.col(c).alias(f"left_{c}") for c in ("id", "key", "polarity", "base")])
    right = rows.select("session", *[F.col(c).alias(f"right_{c}") for c in ("id", "key", "polarity", "base")])
    by_key = left.join(right.withColumn("left_key", F.col("right_key")), ["session", "left_key"]).where("left_id < right_id")
    opposite = left.where("left_polarity != 0").join(right.withColumn("left_base", F.col("right_base")).withColumn("left_polarity", -F.col("right_polarity")), ["session", "left_base", "left_polarity"]).where("left_id < right_id")
    columns = ["session", "left_id", "right_id"]
    return by_key.select(*columns, F.lit(1).alias("same_key"), F.lit(0).alias("opposite")).union(opposite.select(*columns, F.lit(0), F.lit(1))).groupBy(*columns).agg(F.max("same_key").alias("same_key"), F.max("opposite").alias("opposite"))


def contradiction_classes(claims: DataFrame) -> DataFrame:
    """(session, part, left_id, right_id, same_key, opposite): contradictions without their copies.

    Claims of a session with the same key, polarity and base contradict the same others: they are a class, whose smallest id stands for it. Part `member` has
    each claim (right) with its class (left), and whether the class has a key, which all its members then share; part `pair` has the pairs of `contradictions` between
    those that stand for classes. Rows grow with claims and with pairs of different claims, not with pairs of copies.
    """
    alike = ["session", "key", "polarity", "base"]
    rows = claims.select("session", "id", "claim", T.derived_key(F.col("claim")).alias("key"), T.polarity(F.col("claim")).alias("polarity"), T.contradiction_base(F.col("claim")).alias("base"))
    classes = rows.groupBy(*alike).agg(F.min(F.struct("id", "claim")).alias("first"))
    pairs = contradictions(classes.select("session", "first.id", "first.claim"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in alike]
    members = rows.drop("claim").alias("r").join(classes.alias("c"), same).select("r.session", F.lit("member").alias("part"), F.col("c.first.id").alias("left_id"), F.col("r.id").alias("right_id"), F.col("r.key").isNotNull().cast("int").alias("same_key"), F.lit(0).alias("opposite"))
    return members.unionByName(pairs.withColumn("part", F.lit("pair")))


def reachable(edges: DataFrame) -> DataFrame:
    """(ancestor, node, depth) for every pair that edges (parent, child) join, by doubling: rounds are the logarithm of the depth.

    The depth is the least. A cycle ends the doubling like any other repeat, and shows as a node that reaches itself. The result has as
    many rows as there are pairs; where only some nodes are asked for, `upwards` makes none for the others.
    """
    spark = edges.sparkSession
    reach, path = written(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("depth")).distinct(), "reach")
    n = reach.count()
    while True:
        further = reach.alias("a").join(reach.alias("b"), F.col("a.node") == F.col("b.ancestor"))
        further = further.select(F.col("a.ancestor"), F.col("b.node"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        grown, new = written(reach.union(further).groupBy("ancestor", "node").agg(F.min("depth").alias("depth")), "reach")
        drop_path(spark, path)
        reach, path, before, n = grown, new, n, grown.count()
        if n == before:
            return reach


#: Edges of a component that one task looks at; larger components go by `reachable`.
TOGETHER = 100_000


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (parent, child), directions aside; a component's name is its smallest node. Names of names halve the rounds."""
    spark = edges.sparkSession
    both, path = written(edges.select("parent", "child").union(edges.select("child", "parent")).distinct(), "links")
    names, old = written(both.groupBy(F.col("parent").alias("node")).agg(F.min("child").alias("least")).select("node", F.least("node", "least").alias("component")), "names")
    while True:
        near = both.join(names.withColumnRenamed("node", "child"), "child").groupBy(F.col("parent").alias("node")).agg(F.min("component").alias("near"))
        step = names.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        top = names.select(F.col("node").alias("component"), F.col("component").alias("top"))
        new, place = written(step.join(top, "component").select("node", "before", F.least("component", "top").alias("component")), "names")
        drop_path(spark, old)
        if new.where("before != component").isEmpty():
            drop_path(spark, path)
            return new.select("node", "component")
        names, old = new.select("node", "component"), place


def on_cycles(parents: list, children: list) -> list:
    """Nodes of a graph that reach themselves: those of strong components of several nodes (no edge joins a node to itself)."""
    below: dict = {}
    for a, b in zip(parents, children):
        below.setdefault(a, []).append(b)
    at, low, stack, held, out = {}, {}, [], set(), []
    for root in below:
        if root in at:
            continue
        work = [(root, iter(below[root]))]
        at[root] = low[root] = len(at)
        stack.append(root), held.add(root)
        while work:
            node, rest = work[-1]
            following = next(rest, None)
            if following is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == at[node]:
                    group = [stack.pop()]
                    while group[-1] != node:
                        group.append(stack.pop())
                    held.difference_update(group)
                    out += group if len(group) > 1 else []
            elif following not in at:
                at[following] = low[following] = len(at)
                stack.append(following), held.add(following)
                work.append((following, iter(below.get(following, ()))))
            elif following in held:
                low[node] = min(low[node], at[following])
    return out


def cyclic(edges: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(node): every node that edges (parent, child) lead back to itself; edges of a node to itself don't count.

    Components come together whole and are looked at in time linear in their edges, no pairs are made; those of more than ``together`` edges go by all pairs that they reach.
    """
    edges = written(edges.where("parent != child").select("parent", "child").distinct(), "edges")[0]
    named = written(edges.join(connected(edges).withColumnRenamed("node", "parent"), "parent"), "named")[0]
    large = named.groupBy("component").count().where(F.col("count") > together).select("component")
    groups = named.count() // together + 1  # of components, each of them whole
    few = named.join(large, "component", "left_anti").withColumn("_group", F.pmod(F.xxhash64("component"), F.lit(groups)))
    kind = edges.schema["parent"].dataType.simpleString()

    def look(table: pa.Table) -> pa.Table:
        return pa.table({"node": pa.array(on_cycles(table["parent"].to_pylist(), table["child"].to_pylist()), table["parent"].type)})

    out = few.groupBy("_group").applyInArrow(look, f"node {kind}")
    if large.isEmpty():
        return out
    return out.union(reachable(named.join(large, "component", "left_semi")).where("ancestor = node").select("node"))


#: Edges of a block within which `upwards` follows paths, about.
BLOCK = 100_000


def coded(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Places of the values of ``columns`` in one list of them, and the list."""
    both = pa.chunked_array([chunk for c in columns for chunk in c.chunks], columns[0].type).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    at = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum([0, *map(len, columns)])
    return [at[x:y] for x, y in zip(ends, ends[1:])], both.dictionary


def shortened(table: pa.Table) -> pa.Table:
    """A block's edges (node, up, kept) with the paths through nodes of one parent that are not kept put together to one edge."""
    (node, up), names = coded(table["node"], table["up"])
    kept, n = table["kept"].to_numpy(zero_copy_only=False), len(names)
    parents = np.bincount(node, minlength=n)
    inner = np.zeros(n, bool)
    inner[node] = (parents[node] == 1) & ~kept
    to = np.arange(n)  # where a path goes on from an inner node
    one = inner[node]
    to[node[one]] = up[one]
    for _ in range(max(1, n).bit_length()):
        to = to[to]
    some = ~inner[node]
    end = to[up[some]]
    ends = ~inner[end]  # what never leaves inner nodes goes in a circle
    return pa.table({"node": names.take(pa.array(node[some][ends])), "up": names.take(pa.array(end[ends]))})


def followed(edges: pa.Table, found: pa.Table) -> pa.Table:
    """All nodes that a block's edges (node, up) lead to from those ``found`` (node)."""
    (node, up, first), names = coded(edges["node"], edges["up"], found["node"])
    order = np.argsort(node, kind="stable")
    node, up = node[order], up[order]
    low, high = np.searchsorted(node, np.arange(len(names))), np.searchsorted(node, np.arange(len(names)), "right")
    seen, stack = np.zeros(len(names), bool), list(np.unique(first))
    seen[first] = True
    while stack:
        x = stack.pop()
        for y in up[low[x] : high[x]]:
            if not seen[y]:
                seen[y] = True
                stack.append(y)
    return pa.table({"node": names.take(pa.array(np.flatnonzero(seen)))})


def upwards(edges: DataFrame, start: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node): the nodes of ``start`` and all their ancestors over edges (parent, child).

    Edges lie in blocks by ranges of the child. Within a block, paths of nodes with one parent that nothing outside leads to become one edge, `doubled` finds which of the
    others are reached, and blocks follow their own edges from those. Where keys lie along the paths, nearly all is done within blocks; where they don't, edges stay as they are.
    """
    spark = edges.sparkSession
    kind = edges.schema["child"].dataType.simpleString()
    start = written(start.select("node").distinct(), "start")[0]
    rows = edges.select(F.col("child").alias("node"), F.col("parent").alias("up")).where("node is not null and up is not null").distinct()
    rows, plain = written(rows, "edges")
    blocks = rows.count() // block + 1
    rows, path = written((rows.repartitionByRange(blocks, "node") if blocks > 1 else rows.coalesce(1)).withColumn("block", F.spark_partition_id()), "blocks")
    drop_path(spark, plain)
    nodes = rows.select("node", "block").distinct()
    # nodes that an edge of another block leads to, and those to start from, stay
    into = rows.select(F.col("up").alias("node"), F.col("block").alias("of")).distinct().join(nodes, "node").where("of != block").select("node")
    stay, path_of_stay = written(into.union(start).distinct().withColumn("kept", F.lit(True)), "stay")
    marked = rows.join(stay, "node", "left").select("block", "node", "up", F.coalesce("kept", F.lit(False)).alias("kept"))
    few, path_of_few = written(marked.groupBy("block").applyInArrow(shortened, f"node {kind}, up {kind}").distinct(), "short")
    found = doubled(few, start)
    own, path_of_own = written(found.join(nodes, "node"), "own")
    led = rows.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(lambda e, f: followed(e, f) if f.num_rows else f.select(["node"]), f"node {kind}")
    result = written(led.union(found).distinct(), "found")[0]
    for p in (path, path_of_stay, path_of_few, path_of_own):
        drop_path(spark, p)
    return result


def doubled(jumps: DataFrame, start: DataFrame) -> DataFrame:
    """(node): as `upwards`, over jumps (node, up).

    After round k the result holds all within 2**k steps: those found so far, and what jumps of 2**k steps reach from them. Jumps are then
    put together to twice their length. A chain needs rounds as the logarithm of its length, with a jump a node; cycles end when nothing is new.
    """
    spark = jumps.sparkSession
    found, path = written(start.select("node").distinct(), "found")
    jumps, old = written(jumps.distinct(), "jumps")
    n = found.count()
    while True:
        grown, new = written(found.union(jumps.join(found, "node", "left_semi").select("up")).distinct(), "found")
        drop_path(spark, path)
        found, path, before, n = grown, new, n, grown.count()
        if n == before:
            drop_path(spark, old)
            return found
        second = jumps.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumps, newer = written(jumps.join(second, "up").select("node", F.col("top").alias("up")).distinct(), "jumps")
        drop_path(spark, old)
        old = newer


def invalidated(edges: DataFrame, missing: DataFrame) -> DataFrame:
    """(node): all that is missing and every ancestor of it."""
    return upwards(edges, missing)


def lifecycle(events: DataFrame) -> DataFrame:
    """State of each operation: the furthest of prepared, failed, committed; committed stays, whatever comes later."""
    order = F.array(*map(F.lit, STATES))
    return events.groupBy("operation").agg(F.max(F.array_position(order, F.col("state"))).alias("rank")).select("operation", F.element_at(order, F.col("rank").cast("int")).alias("state"))


def append_decision(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """What an append-only index does with each incoming entry: insert it, leave it as it is, or rebuild as its hash changed."""
    old = stored.select(*keys, F.col("hash").alias("old_hash"))
    action = F.when(F.col("old_hash").isNull(), "insert").when(F.col("old_hash") == F.col("hash"), "unchanged").otherwise("rebuild")
    return incoming.join(old, keys, "left").withColumn("action", action).drop("old_hash")


#: Why an index is built anew, in the order in which it is asked.
REBUILD_REASONS = (
    "forced", "initial", "locations-missing", "path-changed", "header-changed", "truncated", "changed-in-place", "unterminated-tail", "hash-missing", "hash-mismatch", "entry-changed",
)


def sync_decision(files: DataFrame, states: DataFrame, force: bool = False) -> DataFrame:
    """noop, append or rebuild for each session's file, with the reason for a rebuild.

    ``files``: session, path, header_hash, size, mtime, and prefix_hash, the hash of the bytes from the stored hash_start to the stored
    offset. ``states``: session and path, header_hash, size, mtime, offset (after the last whole line), hash, located (whether entries have their places),
    each with ``old_`` before it. A file that grew after a last line without an end is read anew, as that line may have changed.
    """
    both = files.join(states, "session", "left")
    reason = (
        F.when(F.lit(force), "forced")
        .when(F.col("old_size").isNull(), "initial")
        .when(~F.coalesce("old_located", F.lit(False)), "locations-missing")
        .when(~F.col("path").eqNullSafe(F.col("old_path")), "path-changed")
        .when(~F.col("header_hash").eqNullSafe(F.col("old_header_hash")), "header-changed")
        .when(F.col("size") < F.col("old_size"), "truncated")
        .when((F.col("size") == F.col("old_size")) & ~F.col("mtime").eqNullSafe(F.col("old_mtime")), "changed-in-place")
        .when((F.col("size") > F.col("old_size")) & (F.col("old_offset") < F.col("old_size")), "unterminated-tail")
        .when((F.col("old_offset") > 0) & F.col("old_hash").isNull(), "hash-missing")
        .when((F.col("old_offset") > 0) & ~F.col("prefix_hash").eqNullSafe(F.col("old_hash")), "hash-mismatch")
    )
    action = F.when(reason.isNotNull(), "rebuild").when(F.col("size") == F.col("old_size"), "noop").otherwise("append")
    return both.select("session", action.alias("action"), reason.alias("reason"))


def orphans(objects: DataFrame, references: DataFrame, key: str) -> DataFrame:
    return objects.join(references.select(key), key, "left_anti")


def mark_deleted(stored: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``stored`` with deleted set where the key is no longer there."""
    here = present.select(key).distinct().withColumn("_here", F.lit(True))
    return stored.join(here, key, "left").withColumn("deleted", F.col("_here").isNull()).drop("_here")


def inherit(native: DataFrame, inherited: DataFrame, key: str) -> DataFrame:
    """Native and inherited items by key; native ones win."""
    rows = native.withColumn("_order", F.lit(0)).unionByName(inherited.withColumn("_order", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_order")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumn("origin", F.when(F.col("_order") == 0, "native").otherwise("inherited")).drop("_n", "_order")


def bounded_prune(rows: DataFrame, keep: int, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows of each session that one write removes: oldest first beyond the newest ``keep``, within both bounds, at least one."""
    newest = Window.partitionBy("session").orderBy(F.desc("created_at"), F.desc("id"))
    extra = rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") > keep)
    oldest = Window.partitionBy("session").orderBy("created_at", "id")
    extra = extra.withColumn("nth", F.row_number().over(oldest)).withColumn("upto", F.sum("bytes").over(oldest))
    return extra.where((F.col("nth") == 1) | ((F.col("nth") <= most_rows) & (F.col("upto") <= most_bytes)))


def negotiate(declared: DataFrame, requested: DataFrame) -> DataFrame:
    """Declared against requested capabilities by name: granted, missing, optional-missing, unused or duplicate."""
    has = declared.groupBy("capability").agg(F.count("*").alias("times"), F.max("version").alias("version"))
    want = requested.groupBy("capability").agg(F.max("least").alias("least"), F.max(F.col("required").cast("int")).alias("required"))
    status = (
        F.when(F.col("times") > 1, "duplicate").when(F.col("required").isNull(), "unused")
        .when(F.col("times").isNotNull() & (F.col("version") >= F.col("least")), "granted").when(F.col("required") == 1, "missing").otherwise("optional-missing")
    )
    return has.join(want, "capability", "full").select("capability", status.alias("status"))


#: Ranges of one part of `overlap_groups`, about.
RANGES = 100_000


def overlap_groups(ranges: DataFrame, part: int = RANGES) -> DataFrame:
    """Islands of overlapping or touching ranges (session, first, last), each with its number within the session.

    Ranges lie in parts by their order, so a part holds a bounded number of them, however many a session has. How far all ranges before a part reach, and how many
    islands begin before it, are sums over parts.
    """
    parts = ranges.count() // part + 1
    rows, path = written(ranges.select("session", "first", "last").repartitionByRange(parts, "session", "first", "last").withColumn("part", F.spark_partition_id()), "parts")
    earlier = Window.partitionBy("session").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("session", "part").orderBy("first", "last")

    def told(rows: DataFrame, before: DataFrame, name: str) -> DataFrame:
        """``rows`` with what comes before their part; only a session that goes over a border of parts has anything, so these are fewer than parts."""
        some = F.broadcast(before.where(F.col(name).isNotNull()).select(F.col("session").alias("_session"), F.col("part").alias("_part"), name))
        return rows.join(some, (F.col("part") == F.col("_part")) & F.col("session").eqNullSafe(F.col("_session")), "left").drop("_session", "_part")

    reach = rows.groupBy("session", "part").agg(F.max("last").alias("last")).select("session", "part", F.max("last").over(earlier).alias("reach"))
    upto = F.greatest(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))
    # as many tasks as parts: what a task holds does not grow with the input
    marked = told(rows, reach, "reach").repartition(parts, "session", "part").withColumn("new", F.coalesce(F.col("first") > upto, F.lit(True)).cast("int"))
    local = marked.withColumn("nth", F.sum("new").over(order)).groupBy("session", "part", "nth").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("ranges"))
    local = written(local, "local")[0]
    drop_path(rows.sparkSession, path)
    begun = local.groupBy("session", "part").agg(F.max("nth").alias("n")).select("session", "part", F.sum("n").over(earlier).alias("begun"))
    numbered = told(local, begun, "begun").withColumn("island", F.coalesce("begun", F.lit(0)) + F.col("nth"))
    return numbered.repartition(parts, "session", "island").groupBy("session", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("ranges").alias("ranges"))
