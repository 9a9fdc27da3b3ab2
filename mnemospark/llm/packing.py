"""Best-fit packing of documents into sequences (operator 7).

Bulk-synchronous rounds over two tables: documents that wait for a place, and gaps of open sequences. In a round both
are range-sorted together, largest first, and swept: a gap opens a level, a document takes the last gap that is still
open, which is its successor (the smallest gap left that holds it). The sweep is a running count, made for each range
by itself and shifted by the ranges before it. Where several documents want one gap, their rank decides: what
meets on a level is one gap and one document at a time, the other documents find the level below. Then gaps shrink by
what they took, and the rest goes into the next round. When no gap holds any document, the longest class of documents
opens as many sequences as it needs.

A gap that holds several of the longest waiting documents is split for a round, so rounds stay few.
Nothing but sums, extremes and one count for each range reaches the driver.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm import vocab
from mnemospark.llm.bulk import slices, string_column
from mnemospark.llm.shared import exists, materialize, new_path

#: Rows of a range, about; a task sorts one.
RANGE_ROWS = 200_000
#: Documents of which fewer fit into a sequence open sequences by their own number, shorter ones by the sum of their lengths.
MOST_FIT = 8
MATCHED = "kind int, owner long, size long, partner long, taken long"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Each document's ids and an end id, cut where they exceed ``capacity``: doc_id, piece, start, length, ids_crc32.

    Of a cut document the first piece takes what does not fill a whole piece. A null or empty text is the end
    id alone.
    """
    path = tokenizer or vocab.default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocab.json_encoder(path, False)
        for batch in batches:
            texts, doc_ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in slices(texts):
                flat, at = encoder.encode(texts.slice(a, b - a))
                flat, at = np.insert(flat, at[1:], end_id).astype("<u4"), at + np.arange(len(at))
                total = np.diff(at)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = (total - 1) % capacity + 1
                start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first[doc])
                begin = at[doc] + start
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(begin.tolist(), (begin + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def ranges(df: DataFrame, n: int) -> int:
    """Ranges for ``n`` rows: as many as a shuffle has, or fewer for few rows."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS)))


def counted(rows: DataFrame, order: list[Column], step: Column, n: int, name: str) -> DataFrame:
    """``rows`` (written once) with ``at``, ascending in ``order``, and ``level``, the sum of ``step`` up to and with the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, level = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            upto = np.cumsum(batch.column(batch.schema.get_field_index("step")).to_numpy(zero_copy_only=False)) + level
            own = batch.drop_columns(["step"])
            where = (part << 40) + at + np.arange(len(upto))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(where, pa.int64()), pa.array(upto.astype(np.int64))], [*own.schema.names, "at", "own"])
            at, level = at + len(upto), int(upto[-1]) if len(upto) else level

    schema = T.StructType([*rows.schema.fields, T.StructField("at", T.LongType()), T.StructField("own", T.LongType())])
    parts = rows.withColumn("step", step.cast("long")).repartitionByRange(ranges(rows, n), *order).sortWithinPartitions(*order)
    found = materialize(parts.mapInArrow(run, schema), name)
    part = F.shiftright("at", 40)
    ends = sorted(tuple(r) for r in found.groupBy(part.alias("part")).agg(F.max_by("own", "at")).collect())
    if len(ends) < 2:
        return found.withColumnRenamed("own", "level")
    before = np.cumsum([0, *(e[1] for e in ends)]).tolist()
    shift = found.sparkSession.createDataFrame([(e[0], b) for e, b in zip(ends, before)], "part long, before long")
    return found.withColumn("part", part).join(F.broadcast(shift), "part").withColumn("level", F.col("own") + F.col("before")).drop("part", "own", "before")


def sweep(docs: DataFrame, gaps: DataFrame, n: int, longest: int, share: int, path: str) -> DataFrame:
    """One round, written to ``path``: kind (0 gap, 1 document), owner, size, partner, taken.

    A document's partner is the sequence whose gap it takes (null without one); ``taken`` is what a gap gave away. Gaps are split
    into parts for up to ``share`` documents of length ``longest``.
    """
    times = F.greatest(F.lit(1), F.least(F.lit(share), F.floor(F.col("size") / longest))).cast("long")
    cut = gaps.select("owner", "size", times.alias("times"), F.explode(F.sequence(F.lit(0), times.cast("int") - 1)).alias("nth"))
    part = F.floor(F.col("size") / F.col("times")) + F.when(F.col("nth") == 0, F.col("size") % F.col("times")).otherwise(0)
    events = cut.select(F.lit(0).alias("kind"), "owner", "nth", part.cast("long").alias("size"))
    events = events.unionByName(docs.select(F.lit(1).alias("kind"), "owner", F.lit(0).alias("nth"), "size"))
    step = F.when(F.col("kind") == 0, 1).otherwise(-1)
    rows = counted(events, [F.desc("size"), F.col("kind"), F.col("owner"), F.col("nth")], step, n, "sweep")
    # a level is crossed upwards by gaps and downwards by documents, in turn; one size crosses it once each way at most
    rows = rows.withColumn("level", F.col("level") + F.col("kind"))
    level = Window.partitionBy("level").orderBy("at")
    before, after = F.lag(F.struct("kind", "owner")).over(level), F.lead(F.struct("kind", "size")).over(level)
    rows = rows.select(
        "kind", "owner", "size",
        F.when((F.col("kind") == 1) & (before["kind"] == 0), before["owner"]).alias("partner"),
        F.when((F.col("kind") == 0) & (after["kind"] == 1), after["size"]).otherwise(0).cast("long").alias("taken"),
    )
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(MATCHED).parquet(path)


def best_fit(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to ``pieces``: any columns, ``length`` from 1 to ``capacity``, repeated rows too.

    Columns named like the two new ones are replaced; no other name clashes, as the columns travel as one. Rows of no length or
    one out of range raise an error, since a packer that drops documents is of no use. An empty table has no sequences.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select(F.col("length").cast("long").alias("size"), F.struct(*own).alias("row"))
    some = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("size").between(1, capacity) & F.col("size").isNotNull()).cast("long")), F.lit(0)).alias("good")).first()
    if some.n != some.good:
        raise ValueError(f"every length has to be from 1 to {capacity}")
    # longest first; a document's number names the sequence that it opens
    rows = counted(rows, [F.desc("size"), F.xxhash64("row")], F.lit(1), some.n, "numbered").select("row", "size", (F.col("level") - 1).alias("owner"))
    docs, gaps, placed, nth = rows.where(F.col("size") < capacity).select("owner", "size"), None, [], 0
    whole = rows.where(F.col("size") == capacity).select("owner", F.col("owner").alias("sequence_id"), F.lit(0).alias("nth"))
    spark, folder = pieces.sparkSession, new_path(pieces.sparkSession, "matched")
    while True:
        state = docs.select(F.lit(1).alias("kind"), "owner", "size")
        state = state if gaps is None else state.unionByName(gaps.select(F.lit(0).alias("kind"), "owner", "size"))
        is_doc = F.col("kind") == 1
        of_docs = lambda c: F.when(is_doc, F.col(c))
        waiting = state.agg(
            F.count_if(is_doc).alias("n"), F.min(of_docs("size")).alias("least"), F.max(of_docs("size")).alias("most"), F.sum(of_docs("size")).alias("all"), F.min(of_docs("owner")).alias("first"), F.count_if(~is_doc).alias("gaps"),
            F.max(F.when(~is_doc, F.col("size"))).alias("room"),
        ).first()
        if not waiting.n:
            break
        if (waiting.room or 0) >= waiting.least:
            swept = sweep(docs, gaps.where(F.col("size") >= waiting.least), waiting.n + waiting.gaps, waiting.most, -(-2 * waiting.n // waiting.gaps), f"{folder}/nth={nth}")
            docs = swept.where("kind = 1 and partner is null").select("owner", "size")
            gaps = swept.where("kind = 0").groupBy("owner").agg(F.sum(F.col("size") - F.col("taken")).alias("size"))
        else:
            ranked = docs.select("owner", "size", (F.col("owner") - waiting.first + 1).alias("level")) if nth == 0 else counted(docs, [F.col("owner")], F.lit(1), waiting.n, "opening").drop("at")
            opens = F.col("level") <= -(-waiting.all // capacity)
            if (fit := capacity // waiting.most) < MOST_FIT:
                # of those that fit as often as the longest every fit-th opens, so that its like can join it
                opens = (F.col("size") > capacity // (fit + 1)) & ((F.col("level") - 1) % fit == 0)
            placed.append(ranked.where(opens).select("owner", F.col("owner").alias("sequence_id"), F.lit(nth).alias("nth")))
            gaps = ranked.where(opens).select("owner", (capacity - F.col("size")).alias("size"))
            docs = ranked.where(~opens).select("owner", "size")
        nth += 1
    if exists(spark, folder):
        # all rounds are one table
        matched = spark.read.schema(f"{MATCHED}, nth int").option("basePath", folder).parquet(folder).where("kind = 1 and partner is not null")
        placed.append(matched.select("owner", F.col("partner").alias("sequence_id"), "nth"))
    places = functools.reduce(DataFrame.unionByName, placed, whole)
    before = Window.partitionBy("sequence_id").orderBy("nth", "owner").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(places, "owner").withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    return found.select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack every document; the pieces are written once, as every pass over their lengths reads them."""
    return best_fit(materialize(token_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
