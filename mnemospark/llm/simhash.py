"""SimHash near-dedup over BK-trees (operator 12).

Distinct fingerprints are the nodes. Fingerprints that differ in at most ``RADIUS`` bits agree in one of ``RADIUS + 1`` runs of
bits, whatever bits the runs are cut from; a shard is all fingerprints that agree in a run. A shard of more than ``SHARD`` of them is cut again by runs of
its other bits, so every shard is bounded and no link is lost. Each shard has its BK-tree: a child hangs on the edge of its
Hamming distance from its parent, and a search follows only edges within the radius. Shards of a task make one forest that is built and
searched level by level as arrays. A forest gives only as many links as hold its classes together.

A tree goes to the task that holds its shard's fingerprints: a broadcast of all shards' trees would grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.bulk import hand_back, slices, string_column
from mnemospark.llm.graph import components
from mnemospark.llm.shared import materialize, spread_join

WIDTH, RADIUS, SEED = 64, 2, 42
#: Most fingerprints of a shard. All that agree in all but 12 bits are fewer, so cutting comes to an end.
SHARD = 4096
#: Fingerprints of a forest, queries that are searched together, hashes whose bits are counted together.
FOREST, QUERIES, HASHES = 32_768, 1024, 65_536
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of a text's n-word shingles, repeats included; a shorter text is one shingle, one without words none."""
    found = text.encode().translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    line, k = b" ".join(found), min(n, len(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(found) - k + 1)


def fingerprint(own: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    ones = np.zeros(WIDTH, np.int64)
    for k in range(0, len(own), HASHES):
        bits = np.unpackbits(own[k : k + HASHES].view(np.uint8), bitorder="little").reshape(-1, WIDTH)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id and fingerprint (64 bits as a signed long) of each row's whole text; one without words has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in slices(texts):
                own = np.array([fingerprint(hashes(x or "", n)) for x in texts.slice(a, b - a).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(a, b - a), pa.array(own.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def forest(shard: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The root of each node's BK-tree, and the child of each node on the edge of each distance (-1: none). Level by level, the first of each branch becomes its node."""
    child = np.full((len(own), WIDTH + 1), -1, np.int32)
    order = np.argsort(shard, kind="stable")
    branch = shard[order]
    root_of_all = None
    while len(order):
        first = np.concatenate([[True], branch[1:] != branch[:-1]])
        root = order[first][np.cumsum(first) - 1]
        if root_of_all is None:
            root_of_all = np.empty(len(own), np.int64)
            root_of_all[order] = root
        else:
            heads = order[first]
            child[branch[first] // (WIDTH + 1), branch[first] % (WIDTH + 1)] = heads
        order, root = order[~first], root[~first]
        branch = root * (WIDTH + 1) + distance(own[order], own[root])
        again = np.argsort(branch, kind="stable")
        order, branch = order[again], branch[again]
    return root_of_all if root_of_all is not None else np.zeros(0, np.int64), child


def linked(own: np.ndarray, root: np.ndarray, child: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pairs (query, node) of one shard within the radius, each once, and the number of distances computed."""
    for k in range(0, len(own), QUERIES):
        query = np.arange(k, min(len(own), k + QUERIES))
        node, seen = root[query], 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            far = distance(own[query], own[node])
            seen += len(query)
            near = (far <= radius) & (node < query)
            found.append((query[near], node[near]))
            edges = far[:, None] + np.arange(-radius, radius + 1)
            below = np.where((edges >= 0) & (edges <= WIDTH), child[node[:, None], np.clip(edges, 0, WIDTH)], -1)
            at, column = np.nonzero(below >= 0)
            query, node = query[at], below[at, column].astype(np.int64)
        yield np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), seen


def spanning(shard: np.ndarray, own: np.ndarray) -> np.ndarray:
    """For each node the least node of its class within its shard."""
    label = np.arange(len(own))
    pairs = [(a, b) for a, b, _ in linked(own, *forest(shard, own))]
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    while len(a):
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, label[end], least)
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            break
    return label


def links(shards: DataFrame) -> DataFrame:
    """Links (a, b) that hold together what is within the radius in each shard of ``shards`` (shard, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(shard: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            label = spanning(shard, own)
            joined = own != own[label]
            signed = own.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[joined]), pa.array(signed[label[joined]])], ["a", "b"])

        for batch in batches:
            held.append((batch.column("shard").to_numpy(), batch.column("fingerprint").to_numpy().view(np.uint64)))
            if sum(len(x[0]) for x in held) >= FOREST:
                shard, own = (np.concatenate(x) for x in zip(*held))
                last = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on in the next batch
                held = [(shard[last:], own[last:])]
                if last:
                    yield out(shard[:last], own[:last])
                    hand_back()
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    dealt = shards.select("shard", "fingerprint").repartition("shard").sortWithinPartitions("shard", "fingerprint")
    return dealt.mapInArrow(run, "a long, b long")


def runs(mask: int) -> list[int]:
    """The bits that ``mask`` lacks in RADIUS + 1 runs, each added to it."""
    free = [i for i in range(WIDTH) if not mask >> i & 1]
    return [mask | sum(1 << i for i in map(int, part)) for part in np.array_split(np.array(free), RADIUS + 1)]


def signed(x: int) -> int:
    return x - (1 << WIDTH) if x >> (WIDTH - 1) else x


def sharded(nodes: DataFrame, most: int = SHARD) -> list[DataFrame]:
    """Shards (shard, fingerprint) of two to ``most`` of the ``nodes`` (fingerprint) each; every two within the radius share one.

    A shard is named by a hash of its bits; two that have one name are one larger shard, which loses nothing.
    """
    out, masks = [], {0}
    left = nodes.select("fingerprint", F.lit(0).cast("long").alias("mask"))
    while True:
        following = {m: runs(m) for m in masks}
        masks = {m for ms in following.values() for m in ms}
        to = F.create_map(*[x for m, ms in sorted(following.items()) for x in (F.lit(signed(m)), F.array(*[F.lit(signed(x)) for x in ms]))])
        # different cuts may end with the same bits
        placed = left.select("fingerprint", F.explode(to[F.col("mask")]).alias("mask")).distinct() if out else left.select("fingerprint", F.explode(to[F.col("mask")]).alias("mask"))
        placed = placed.withColumn("shard", F.xxhash64("mask", F.col("fingerprint").bitwiseAND(F.col("mask"))))
        counts = materialize(placed.groupBy("shard").agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1"), "shards")
        sized = spread_join(placed, counts.withColumnRenamed("rows_of_key", "members"), "shard", ["fingerprint"], counts).where("members is not null")
        sized = materialize(sized, "sharded")
        out.append(sized.where(F.col("members") <= most).select("shard", "fingerprint"))
        left = sized.where(F.col("members") > most).select("fingerprint", "mask")
        # a full mask has one distinct fingerprint a shard
        if all(m == (1 << WIDTH) - 1 for m in masks) or left.isEmpty():
            return out


def classes(docs: DataFrame, n: int = 3, most: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs`` (doc_id, text; other columns ignored).

    component_id is the least doc_id that links reach, links being fingerprints that differ in at most two bits. Null and
    empty texts have fingerprint 0 and link by it as others do. Repeated rows are in one class; a row whose doc_id is null
    links, but names its class only where that has no other name.
    """
    rows = materialize(fingerprints(docs, n).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    degree = materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows_of_key")), "nodes")
    joined = None
    for part in sharded(degree, most):
        joined = links(part) if joined is None else joined.union(links(part))
    found = components(joined.distinct())
    named = degree.select("fingerprint", "doc_id").join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "fingerprint")), "named")
    sizes = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows_of_key"))
    sizes = materialize(sizes, "components")
    nodes = spread_join(named.select("fingerprint", "component"), sizes.drop("rows_of_key"), "component", ["fingerprint"], sizes.select("component", "rows_of_key"))
    final = spread_join(rows, nodes.drop("component"), "fingerprint", ["row"], degree.select("fingerprint", "rows_of_key"))
    return final.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
