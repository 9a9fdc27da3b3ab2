"""Exact nearest neighbours by cosine over all vectors: cells round pivots, a first bound from near by, then only cells within it.

Unit vectors' cosines order as their distances do, and distances keep the triangle inequality. Each vector lies in the cell of its nearest
pivot. A query first meets one block of its own cell, which bounds the distance of its k-th neighbour; then it goes to
those blocks whose ring of distances from their pivot may hold anything nearer. Blocks and packs of queries are bounded, so
neither a large cell nor a vector that many have copied comes to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.storage import materialize

#: Most pivots (they are broadcast), vectors of a block about, queries of a pack about.
PIVOTS, BLOCK, PACK = 256, 2048, 256
#: What rounding may do to a distance.
SLACK = 1e-6
NEAR = "query_id long, neighbour_id long, similarity double, compared long"


def units(vectors: DataFrame, key: str, column: str, *also: str) -> DataFrame:
    """(id, dims, unit) and the columns ``also`` of vectors of length 1; those that are null, empty, zero, or hold nulls or no finite numbers are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, units, at = [], [], [], []
            for n, (i, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy().astype(np.float64)
                norm = np.sqrt(x @ x)
                if np.isfinite(norm) and norm > 0:
                    ids.append(i), dims.append(len(x)), units.append((x / norm).tobytes()), at.append(n)
            others = [batch.column(2 + k).take(pa.array(at, pa.int64())) for k in range(len(also))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary()), *others], ["id", "dims", "unit", *also])

    kinds = "".join(f", `{c}` {vectors.schema[c].dataType.simpleString()}" for c in also)
    return vectors.select(F.col(key).cast("long"), F.col(column), *also).mapInArrow(run, "id long, dims int, unit binary" + kinds)


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    raw = [x.as_py() for x in column]
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1) if raw else np.zeros((0, 0))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


class Pivots:
    """Pivots of each number of dimensions; cells are numbered through."""

    def __init__(self, rows: list):
        self.of: dict[int, tuple[int, np.ndarray]] = {}
        first = 0
        for dims in sorted({r.dims for r in rows}):
            own = np.stack([np.frombuffer(r.unit, np.float64) for r in rows if r.dims == dims])
            self.of[dims] = (first, own)
            first += len(own)


def by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, stacked(batch.column("unit").take(pa.array(at)))


def celled(rows: DataFrame, pivots: Pivots) -> DataFrame:
    """``rows`` with the cell and the distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d, at, own in by_dims(batch):
                first, centres = pivots.of[d]
                distance = apart(own, centres)
                nearest = distance.argmin(axis=1)
                cell[at], far[at] = first + nearest, distance[np.arange(len(at)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])

    return rows.mapInArrow(run, "id long, dims int, unit binary, cell int, far double")


def best(similarity: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best, ties to the lesser id."""
    if len(ids) > 4 * k:
        cut = np.partition(similarity, len(ids) - k)[len(ids) - k]
        some = np.flatnonzero(similarity >= cut)
        return some[np.lexsort((ids[some], -similarity[some]))[:k]]
    return np.lexsort((ids, -similarity))[:k]


def compared(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of a block for each query of a pack that may be within its bound; the first row has how many vectors it was compared with."""
    for batch in batches:
        for r in range(batch.num_rows):
            cells = {c: batch.column(c)[r] for c in batch.schema.names}
            ids, far = cells["ids"].values.to_numpy(), cells["fars"].values.to_numpy()
            own = stacked(cells["units"].values)
            asked, rows = cells["asked"].values.to_numpy(), cells["rows"].values.to_numpy()
            query, bound, to_pivot = stacked(cells["query_units"].values), cells["bounds"].values.to_numpy(), cells["to_pivot"].values.to_numpy()
            members = cells["members"].values.to_numpy()
            out = []
            for j in range(len(asked)):
                may = np.flatnonzero((np.abs(far - to_pivot[j]) <= bound[j] + SLACK) & (members != rows[j]))
                near = np.round(own[may] @ query[j], 9)
                some = best(near, ids[may], k)
                out.append((np.full(len(some), rows[j]), np.full(len(some), asked[j]), ids[may][some], near[some], np.where(np.arange(len(some)) == 0, len(may), 0)))
            row, one, two, near, seen = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(near, pa.float64()), pa.array(seen, pa.int64())], ["row", "query_id", "neighbour_id", "similarity", "compared"])


def top_k(vectors: DataFrame, key: str, column: str, queries: Column, k: int = 10, block: int = BLOCK, pack: int = PACK, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), neighbour_id, similarity, compared: the ``k`` vectors most like each row for which ``queries`` holds, itself aside.

    Similarities are cosines rounded to nine places; ties go to the lesser id. Vectors of other dimensions are never compared. A repeated row is a vector
    and a query of its own. ``compared`` is the number of vectors that the query was compared with, of all rows.
    """
    rows = units(vectors.where(F.col(key).isNotNull()), key, column)
    rows = materialize(rows, "units")
    # a bounded sample, the same whatever the partitioning: those of least hash
    least = Window.partitionBy("dims").orderBy(F.xxhash64("unit"), "id")
    chosen = rows.select("id", "dims", "unit").dropDuplicates(["dims", "unit"]).withColumn("n", F.row_number().over(least)).where(F.col("n") <= pivots).collect()
    if not chosen:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, neighbour_id long, similarity double, compared long")
    centres = Pivots(chosen)
    placed = materialize(celled(rows.select("id", "dims", "unit"), centres).withColumn("row", F.monotonically_increasing_id()), "cells")
    size = placed.groupBy("cell").agg(F.count("*").alias("n"))  # a row a pivot
    dealt = placed.join(F.broadcast(size), "cell").withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / block)).cast("int"))
    lists = [F.collect_list(c).alias(name) for c, name in (("id", "ids"), ("row", "members"), ("far", "fars"), ("unit", "units"))]
    blocks = dealt.groupBy("cell", "block").agg(*lists, F.min("far").alias("low"), F.max("far").alias("high"))
    blocks = materialize(blocks, "blocks")
    rings = blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("blocks")).collect()  # a row a pivot

    asked = materialize(dealt.join(vectors.where(queries).select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi").select("id", "row", "dims", "unit", "cell", "far", "block"), "asked")

    def meet(wanted: DataFrame) -> DataFrame:
        """Packs of ``wanted`` (id, row, unit, cell, block, bound, to_pivot) with their blocks."""
        counts = wanted.groupBy("cell", "block").agg(F.ceil(F.count("*") / pack).alias("packs"))
        packs = wanted.join(counts, ["cell", "block"]).withColumn("pack", F.pmod(F.xxhash64("row"), F.col("packs")))
        cells = [F.collect_list(c).alias(name) for c, name in (("id", "asked"), ("row", "rows"), ("unit", "query_units"), ("bound", "bounds"), ("to_pivot", "to_pivot"))]
        packs = packs.groupBy("cell", "block", "pack").agg(*cells)
        # the packs' size is not known beforehand: never a broadcast, which would pass them through the driver
        return packs.hint("merge").join(blocks, ["cell", "block"]).mapInArrow(lambda b: compared(b, k), "row long, " + NEAR)

    first = meet(asked.select("id", "row", "unit", "cell", "block", F.lit(4.0).alias("bound"), F.col("far").alias("to_pivot")))
    first = materialize(first, "first")
    kth = first.groupBy("row").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    bounds = asked.join(kth, "row", "left").withColumn("bound", F.when(F.col("n") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * (F.col("least") - 1e-9)))).otherwise(4.0))
    ring = {r.cell: (r.low, r.high, r.blocks) for r in rings}

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound, own_cell, own_block = (batch.column(c).to_numpy() for c in ("bound", "cell", "block"))
            out: list[list] = [[], [], [], []]
            for d, at, units_ in by_dims(batch):
                start, centres_ = centres.of[d]
                distance = apart(units_, centres_)
                for c in range(len(centres_)):
                    if start + c not in ring:
                        continue
                    low, high, n = ring[start + c]
                    hit = np.flatnonzero((distance[:, c] - bound[at] <= high + SLACK) & (distance[:, c] + bound[at] >= low - SLACK))
                    for b in range(n):
                        go = hit[(own_cell[at[hit]] != start + c) | (own_block[at[hit]] != b)]  # the first block is done
                        for list_, x in zip(out, (at[go], np.full(len(go), start + c), np.full(len(go), b), distance[go, c])):
                            list_.append(x)
            where, cell, block_, to_pivot = (np.concatenate(x) if x else np.zeros(0, int) for x in out)
            some = pa.array(where.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("id", "row", "unit", "bound")), pa.array(cell.astype(np.int32)), pa.array(block_.astype(np.int32)), pa.array(to_pivot.astype(np.float64))], ["id", "row", "unit", "bound", "cell", "block", "to_pivot"])

    more = meet(bounds.select("id", "row", "dims", "unit", "bound", "cell", "block").mapInArrow(within, "id long, row long, unit binary, bound double, cell int, block int, to_pivot double"))
    found = materialize(first.unionByName(more), "near")
    seen = found.groupBy("row").agg(F.sum("compared").alias("compared"))
    ranked = found.drop("compared").withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("similarity"), "neighbour_id"))).where(F.col("rank") <= k)
    return ranked.join(seen, "row").select("query_id", "rank", "neighbour_id", "similarity", "compared")


#: Vectors and queries of one product of matrices of `of_kind`, about, and the queries of it that are multiplied at a time.
VECTORS, QUERIES, AT_ONCE = 8192, 4096, 256


def nearest(k: int, least: float, places: int):
    """The ``k`` best of a block of vectors (left) for each query of a pack (right)."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and asked.num_rows:
            ids, own = vectors["id"].to_numpy(), stacked(vectors["unit"])
            for first in range(0, asked.num_rows, AT_ONCE):
                part = asked.slice(first, AT_ONCE)
                query = part["id"].to_numpy()
                near = stacked(part["unit"]) @ own.T
                near[query[:, None] == ids] = -2
                # what rounds to the k-th best or more
                kth = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(query), -2.0)
                row, at = np.nonzero(near >= np.maximum(kth, least)[:, None] - 2 * 10.0**-places)
                value, found = np.round(near[row, at], places), ids[at]
                order = np.lexsort((found, -value, row))
                row, value, found = row[order], value[order], found[order]
                nth = np.arange(len(row)) - np.searchsorted(row, row)
                some = (nth < k) & (value >= least)
                out.append(pa.table({"query_id": query[row[some]], "id": found[some], "similarity": value[some]}, HITS))
        return pa.concat_tables(out) if out else HITS.empty_table()

    return run


HITS = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])


def of_kind(vectors: DataFrame, key: str, column: str, kind: str, queries: Column, k: int, least: float, places: int = 6, block: int = VECTORS, pack: int = QUERIES) -> DataFrame:
    """(query_id, ``key``, similarity, rank from 0): the ``k`` vectors of its own ``kind`` most like each row for which ``queries`` holds, ``least`` or more; rows of its own key are left out.

    Similarities are cosines rounded to ``places``; ties go to the lesser key. A kind's vectors are dealt over blocks and its queries over packs, and each block meets each pack
    as one product of matrices. All pairs of a kind are compared, so the work grows with their number, but memory and what is shuffled do not.
    """
    rows = units(vectors.where(F.col(key).isNotNull() & F.col(kind).isNotNull()).withColumn("asks", F.coalesce(queries, F.lit(False))), key, column, kind, "asks")
    rows = materialize(rows, "units")
    most = rows.groupBy(kind, "dims").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).agg(F.max("n").alias("n"), F.max("asks").alias("asks")).first()
    blocks, packs = -(-(most.n or 1) // block), max(1, -(-(most.asks or 1) // pack))
    cell, place = [kind, "dims", "block", "pack"], lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = rows.select(kind, "dims", "id", "unit", place(1, blocks).alias("block"), each(packs).alias("pack"))
    asked = rows.where("asks").select(kind, "dims", "id", "unit", place(2, packs).alias("pack"), each(blocks).alias("block"))
    hits = own.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(nearest(k, least, places), "query_id long, id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < k)
    return ranked.select("query_id", F.col("id").alias(key), "similarity", "rank")
