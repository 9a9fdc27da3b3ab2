"""Near-duplicate documents by circulant MinHash (operator 8).

Two permutations make all signature coordinates: the first scatters a shingle over ``SLOTS`` places, the second is
read at that place and at the next ``COORDINATES - 1`` places round the circle, and each coordinate is the least
value over the document's shingles. Bands of coordinates propose pairs; a pair is linked only by the exact
overlap of its whole shingle sets.

Documents with equal shingle sets are one node from the start. In a bucket, members are not paired with each
other: all are compared with a hub, the member that meets most others in all its buckets. Members that are linked
with their hub are one component. A further link (a, b) of an unlinked member a must have

    |a & b| = |a & b & hub| + |(a - hub) & (b - hub)| >= r(a, b), the overlap that the similarity needs,

while |a & b & hub| <= |a & hub| and |b & hub|. So either a and b share shingles that the hub lacks - at least one of
each side's rarest, by prefixes whose length follows from what is missing - or both overlaps with the hub reach
r(a, b), which only members smaller than the hub can do. Pairs are made for these two cases only, and
confirmed; not for members that links with hubs have brought into one class already. So no class that the bands propose falls apart, and
a group of n copies costs about n comparisons.

With 32 bands of 4 a pair of similarity 0.8 is missed with probability (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.bulk import slices, string_column
from mnemospark.llm.graph import components
from mnemospark.llm.shared import materialize, spread_join
from mnemospark.llm.shingles import mix, shingles, words

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
SLOTS = 1 << 20


@functools.cache
def permutations(seed: int = 20240501) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and windows of the second one (a view; row p starts at place p)."""
    random = np.random.default_rng(seed)
    first, second = random.permutation(SLOTS), random.permutation(SLOTS).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: COORDINATES - 1]]), COORDINATES)


def signature(own: np.ndarray) -> np.ndarray:
    first, windows = permutations()
    out = np.full(COORDINATES, SLOTS, np.uint32)
    for k in range(0, len(own), 4096):
        places = first[(own[k : k + 4096] & np.uint64(SLOTS - 1)).astype(np.int64)]
        np.minimum(out, windows[places].min(axis=0), out=out)
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = signature(own).reshape(BANDS, ROWS).astype(np.uint64)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def node_of(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def sets_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, int, int, list[np.ndarray]]]:
    for batch in batches:
        texts = string_column(batch, "text")
        for a, b in slices(texts):
            hashes, offsets = words(texts.slice(a, b - a))
            yield batch.slice(a, b - a), a, b, [shingles(hashes[i:j], n) for i, j in zip(offsets, offsets[1:])]


def row_key() -> Column:
    """128 bits of the SHA-256 of a row's doc_id and text; a null text is an empty one."""
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\0"), F.coalesce(F.col("text"), F.lit("")))
    return F.substring(F.unhex(F.sha2(content, 256)), 1, 16)


def signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, key (of the row's content), n_shingles, node (null without words) and the node's band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # band keys of the last sets, for copies
        for batch, _, _, sets in sets_of(batches, n):
            nodes, keys = [], []
            for own in sets:
                node = node_of(own) if len(own) else None
                if node is not None and node not in known:
                    if len(known) >= 5000:
                        known.clear()
                    known[node] = band_keys(own)
                nodes.append(node)
                keys.append(None if node is None else known[node])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "key", "n_shingles", "node", "bands"],
            )

    rows = docs.select("doc_id", "text", row_key().alias("key"))
    return rows.mapInArrow(run, "doc_id long, key binary, n_shingles long, node binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, own) of the nodes in ``wanted`` (node, key): their whole shingle sets, made again from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, sets in sets_of(batches, n):
            right = [node_of(s) == node for s, node in zip(sets, batch.column("node").to_pylist())]
            out = pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "own"])
            yield out.filter(pa.array(right, pa.bool_()))

    rows = docs.select("text", row_key().alias("key")).join(wanted, "key").select("node", "text")
    return rows.mapInArrow(run, "node binary, own array<long>").dropDuplicates(["node"])


def needed(total: Column, percent: int) -> Column:
    """The least intersection of two sets that have ``total`` elements together."""
    return F.ceil(total * percent / (100 + percent))


def beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with both sets, their sizes, and the size of their intersection. Pairs of one hub ``b`` spread."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    right = right.join(pairs.select("b").distinct(), "b", "left_semi")
    rows = spread_join(pairs, right, "b", ["a"]).join(left, "a")
    return rows.select("*", F.size("own_a").alias("n_a"), F.size("own_b").alias("n_b"), F.size(F.array_intersect("own_a", "own_b")).alias("both"))


def similar(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def further_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may be linked though one of them is not linked with their common hub, with the classes (class_a, class_b) they have so far.

    ``stars`` have each node's class by links with hubs. Pairs within a class are not made, as a link would join nothing.
    """
    group = stars.groupBy("hub").agg(F.min("n").alias("least"), F.max(~F.col("linked")).alias("open"), F.min("class").alias("one"), F.max("class").alias("other")).where("open and one != other").drop("open", "one", "other")
    rows = spread_join(stars, group, "hub", ["node"]).where("least is not null")
    # shingles that the hub lacks, rarest first; so many of them may be without a partner
    rest = rows.select("hub", "node", "class", "linked", "n", "both", F.size("rest").alias("size"), F.greatest(F.lit(1), needed(F.col("n") + F.col("least"), percent) - F.col("both")).alias("share"), F.explode("rest").alias("shingle"))
    rest = materialize(rest.where("share <= size"), "rest")
    rest = rest.withColumn("place", F.struct("hub", "shingle"))
    common = materialize(rest.groupBy("place").agg(F.count("*").alias("rows_of_key")), "common")
    rarest = Window.partitionBy("hub", "node").orderBy("df", "shingle")
    prefix = spread_join(rest, common.withColumnRenamed("rows_of_key", "df"), "place", ["node"], common).withColumn("at", F.row_number().over(rarest)).where("at <= size - share + 1 and df > 1")
    prefix = materialize(prefix.select("hub", "shingle", "node", "class", "linked", "n", "both", (F.col("size") - F.col("at") + 1).alias("left")), "prefix")
    other = prefix.select("hub", "shingle", *[F.col(c).alias(f"{c}_other") for c in ("node", "class", "n", "both", "left")])
    # a pair's first common shingle leaves room for all that it still has to share. Both joins below are of two shuffled sides, of which Spark splits
    # what is large of one key
    room = F.least("left", "left_other") >= needed(F.col("n") + F.col("n_other"), percent) - F.least("both", "both_other")
    sharing = prefix.where("not linked").join(other, ["hub", "shingle"]).where((F.col("class") != F.col("class_other")) & room).select("node", "class", "node_other", "class_other")
    # overlaps with the hub that are enough by themselves
    enough = rows.where(F.col("both") >= needed(F.col("n") + F.col("least"), percent))
    small = enough.where("n < n_hub").select("hub", *[F.col(c).alias(f"{c}_other") for c in ("node", "class", "n", "both")])
    within = enough.where("not linked").join(small, "hub").where("class != class_other")
    within = within.where(F.least("both", "both_other") >= needed(F.col("n") + F.col("n_other"), percent)).select("node", "class", "node_other", "class_other")
    one, two = (F.struct(F.col(f"node{x}").alias("node"), F.col(f"class{x}").alias("class")) for x in ("", "_other"))
    pairs = sharing.union(within).select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).distinct()
    return pairs.select("a.node", "a.class", F.col("b.node").alias("b"), F.col("b.class").alias("class_b")).toDF("a", "class_a", "b", "class_b")


def classified(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The rows of `classes` with the key of each row's content and its component's node (null without words)."""
    rows = materialize(signed(docs, n), "signed")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    placed = nodes.select("node", F.explode("bands").alias("band"))
    buckets = materialize(placed.groupBy("band").agg(F.count("*").alias("rows_of_key")), "buckets")
    shared = buckets.where("rows_of_key > 1")
    members = materialize(spread_join(placed, shared.withColumnRenamed("rows_of_key", "members"), "band", ["node"], shared).where("members is not null"), "members")
    weight = members.groupBy("node").agg(F.sum("members").alias("weight"))
    members = materialize(members.drop("members").join(weight, "node"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    sets = materialize(full_sets(docs, wanted, n), "sets")

    hubs = members.groupBy("band").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))
    pairs = spread_join(members, hubs, "band", ["node"], shared).where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    pairs = materialize(pairs.distinct(), "stars")
    stars = beside(pairs, sets).select(
        F.col("a").alias("node"), F.col("b").alias("hub"), F.col("n_a").alias("n"), F.col("n_b").alias("n_hub"), "both", similar(percent).alias("linked"), F.array_except("own_a", "own_b").alias("rest")
    )
    stars = materialize(stars, "stars")
    # classes by links with hubs; then links between those classes
    first = components(stars.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    stars = stars.join(first.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    more = beside(materialize(further_pairs(stars, percent), "pairs"), sets).where(similar(percent)).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
    second = components(more).select(F.col("node").alias("class"), "component")
    named_nodes = nodes.select("node", "doc_id").join(first.select("node", F.col("component").alias("class")), "node", "left").withColumn("class", F.coalesce("class", "node"))
    named_nodes = materialize(spread_join(named_nodes, second, "class", ["node"]).select("node", "doc_id", F.coalesce("component", "class").alias("component")), "named")
    least = named_nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = spread_join(named_nodes, least, "component", ["node"]).select("node", "component", "component_id")
    return spread_join(rows, final, "node", ["doc_id", "key"]).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.expr("if(node is null, true, doc_id <=> component_id)").alias("kept"),
        "key",
        "component",
    )


def classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text; other columns ignored).

    ``n`` words make a shingle; documents whose sets overlap by ``percent`` or more of their union are linked.
    component_id is the least doc_id that links reach. Documents without words are linked with nothing. A row
    whose doc_id is null can be linked but never names a class, unless its class has no other name.
    Repeated rows are in one class; all rows that bear the class's doc_id are ``kept``.
    """
    return classified(docs, n, percent).drop("key", "component")


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class, with all its columns, whatever they are called.

    The row with the least doc_id stays (a null one last, then by content); of rows equal in doc_id and text any one, with
    its other columns. Rows without words all stay.
    """
    found = classified(docs, n, percent)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key"))
    stays = found.where("component is not null").groupBy("component").agg(best.alias("best")).select("best.key")
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.select(row_key().alias("key"), words.alias("words"), F.struct(*docs.columns).alias("row"))
    one = marked.where("words").join(stays, "key", "left_semi").dropDuplicates(["key"])
    return one.unionByName(marked.where("not words")).select("row.*")
