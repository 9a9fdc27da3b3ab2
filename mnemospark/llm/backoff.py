"""Stupid-backoff language-model scores from the corpus's own n-grams (operator 2).

The relations, with n-grams as 64-bit hashes:

* documents fall into blocks by a hash of their text; a block's distinct n-grams with their counts are exploded to rows (part, block, n, gram, count), where ``part`` is a range of
  the hash. They travel as arrays, one row for a block's n-grams of a part, and are exploded where they arrive;
* the count tables, partitioned by that range, sum the counts of each n-gram over all blocks;
* the exploded n-grams are joined with the count tables on the n-gram, within a part, and the totals go back to their blocks, where each document sums the scores of
  its positions.

A position's score is count(n-gram) / count(context) of the highest order whose n-gram was counted ``least`` times or more, times ``alpha`` for each order given up; single words
need no least count and are divided by the number of words. From order 3 on only n-grams whose two shorter ones turned out common enough are counted, as no other can be. The
tables are those of the whole corpus and grow with it; blocks and parts are sized so that a task holds a fixed amount, and a common n-gram arrives at most once from a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.bulk import hand_back, slices, string_column
from mnemospark.llm.shared import settled
from mnemospark.llm.shingles import STEP, mix, words

ORDER, ALPHA, LEAST = 3, 0.4, 2
#: Bits of an n-gram's hash, its only identity: all there are. Among 10**9 different n-grams 0.03 pairs are expected to be
#: taken for one, among 3 * 10**9 0.24.
HASH_BITS = 64
#: Bytes of text in a block and n-grams in a partition of the tables, about.
BLOCK_BYTES, PARTITION_GRAMS = 8_000_000, 1_000_000


def grams(hashes: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at each word of place ``n - 1`` or later in its document, and those words' positions."""
    at = np.flatnonzero(place >= n - 1)
    rolled = np.full(len(at), n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            rolled = rolled * STEP + hashes[at - k]
    return mix(rolled), at


def block_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block's texts, each one's place in its document, and the documents' offsets."""
    texts = table.column("text").cast(pa.large_string())
    hashes, offsets = words(pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string()))
    return hashes, np.arange(len(hashes)) - np.repeat(offsets[:-1], np.diff(offsets)), offsets


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in an order that does not hang on how they came."""
    return table.sort_by([("row", "ascending"), ("doc_id", "ascending")])


def as_signed(hashes: np.ndarray) -> np.ndarray:
    """The hashes as the 64-bit integers that Spark has, in the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def exploded(block: int, n: int, every: np.ndarray, parts: int) -> Iterator[dict]:
    """A block's distinct n-grams with their counts, one row for each part that they fall into."""
    found, counts = np.unique(every, return_counts=True)
    cuts = np.searchsorted(part_of(found, parts), np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        a, b = cuts[p], cuts[p + 1]
        yield {"part": int(p), "block": block, "n": n, "grams": as_signed(found[a:b]), "counts": counts[a:b].astype(np.int32)}


def count_first(orders: range, parts: int):
    """Rows of the count tables of these orders, from all positions of a block."""

    def run(docs: pa.Table) -> pa.Table:
        hashes, place, _ = block_words(ordered(docs))
        block = docs["block"][0].as_py()
        rows = pa.Table.from_pylist([r for n in orders for r in exploded(block, n, grams(hashes, place, n)[0], parts)], COUNTED)
        hand_back()
        return rows

    return run


def count_next(n: int, parts: int, least: int):
    """Rows of the count table of order n, from the positions whose two shorter n-grams were counted often enough."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        hashes, place, _ = block_words(ordered(docs))
        counts = known_counts(hashes, place, replies, n - 1, least, range(2, n))
        found, at = grams(hashes, place, n)
        rows = pa.Table.from_pylist(list(exploded(docs["block"][0].as_py(), n, found[worth(counts, at, n, least)], parts)), COUNTED)
        hand_back()
        return rows

    return run


def worth(counts: np.ndarray, at: np.ndarray, n: int, least: int) -> np.ndarray:
    """An n-gram can't be more common than the two shorter ones in it, so most need not be counted at all."""
    return (counts[n - 1, at] >= least) & (counts[n - 1, at - 1] >= least) if n > 2 else np.ones(len(at), bool)


def known_counts(hashes: np.ndarray, place: np.ndarray, replies: pa.Table, order: int, least: int, orders: range | None = None) -> np.ndarray:
    """Row n: the corpus's count of the n-gram that ends at each word; 0 where it was not worth counting."""
    replies = replies.sort_by([("n", "ascending"), ("part", "ascending")])
    kind = np.array(replies["n"].to_pylist())
    counts = np.zeros((order + 1, len(hashes)), np.int64)
    for n in orders or range(1, order + 1):
        found, at = grams(hashes, place, n)
        keep = worth(counts, at, n, least)
        found, at = found[keep], at[keep]
        if len(at):
            _, inverse = np.unique(found, return_inverse=True)
            totals = replies["totals"].take(pa.array(np.flatnonzero(kind == n))).combine_chunks()
            counts[n, at] = (pa.concat_arrays(totals.chunks) if isinstance(totals, pa.ChunkedArray) else totals).flatten().to_numpy()[inverse]
    return counts


COUNTED = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("grams", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])


def part_of(found: np.ndarray, parts: int) -> np.ndarray:
    """Partitions are ranges of the hash, so that a block's sorted n-grams are its partitions' in turn."""
    return ((found >> np.uint64(HASH_BITS - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def joined(counted: DataFrame, parts: int) -> DataFrame:
    """(part, block, n, at, gram, total) of each of a block's n-grams; ``counted`` has a block's n-grams of a part in a row, ``at`` is the place in their order.

    The n-grams are exploded where they arrive. The count tables are partitioned by ``part``, as the n-grams are, so summing and joining are one sort within
    a part: rows of one n-gram stand together, and each gets their sum (by the n-gram first, as its bits order most rows at once). A join of two plans would shuffle the n-grams, and make them, twice.
    """
    rows = F.arrays_zip(F.col("grams").alias("gram"), F.col("counts").alias("count"))
    rows = F.when(F.col("grams") == F.sort_array("grams"), rows).otherwise(F.sort_array(rows))  # those of `exploded` are in order
    rows = counted.repartition(parts, "part").select("part", "block", "n", F.posexplode(rows).alias("at", "row"))
    return rows.select("part", "block", "n", "at", "row.gram", F.sum("row.count").over(Window.partitionBy("row.gram", "n", "part")).alias("total"))


def totals(counted: DataFrame, parts: int, most: int = 1 << 40) -> DataFrame:
    """(block, n, part, totals): the corpus's counts of each block's n-grams in the order of the n-grams. No count is over ``most``.

    Place and count travel as one number: numbers are collected and sorted at a fraction of the cost of rows.
    """
    bits = most.bit_length()
    number = F.shiftleft(F.col("at").cast("long"), bits).bitwiseOR(F.col("total"))
    found = joined(counted, parts).groupBy("part", "block", "n").agg(F.sort_array(F.collect_list(number)).alias("found"))
    return found.select("block", "n", "part", F.transform("found", lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))).alias("totals"))


def score_block(order: int, alpha: float, least: int, total: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        docs = ordered(docs)
        hashes, place, offsets = block_words(docs)
        counts = known_counts(hashes, place, replies, order, least)
        score, level = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
        for n in range(order, 0, -1):
            use = (level == 0) & (place >= n - 1) & ((counts[n] >= least) if n > 1 else True)
            below = np.full(use.sum(), total) if n == 1 else counts[n - 1, np.flatnonzero(use) - 1]
            given_up = np.minimum(place[use] + 1, order) - n
            score[use] = np.log10(counts[n, use] / below) + given_up * np.log10(alpha)
            level[use] = n
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        # summed document by document, so that a score does not hang on its block's other documents
        own = [float(score[a:b].sum()) for a, b in zip(offsets, offsets[1:])]
        length = np.diff(offsets)
        mean = pa.array([None if not k else round(s / k, 6) for s, k in zip(own, length.tolist())], pa.float64())
        levels = {f"n_order{n}": pa.array(sums(level == n)) for n in range(1, order + 1)}
        hand_back()
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(length), "log10_score": pa.array(np.round(own, 4)), "mean_log10": mean, **levels})

    return run


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Bytes and words of all texts; a pass that returns two numbers a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = n = 0
            texts = string_column(batch, "text").fill_null("")
            for a, b in slices(texts):
                part = texts.slice(a, b - a)
                ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
                inside = (raw != 32) & ((raw < 9) | (raw > 13))
                first = np.zeros(len(raw) + 1, bool)
                first[ends - ends[0]] = True
                n += int((inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]]))).sum())
                size += len(raw)
            yield pa.RecordBatch.from_pydict({"size": [size], "n": [n]})

    got = docs.select("text").mapInArrow(run, "size long, n long").agg(F.sum("size"), F.sum("n")).first()
    return got[0] or 0, got[1] or 0


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, block_bytes: int = BLOCK_BYTES, partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """doc_id, n_words, log10_score (sum), mean_log10 and the positions scored at each order, of every row.

    Words are runs of other characters than white space, A-Z lower-cased. A text without words scores 0 and has no
    mean. Repeated rows count as often as they are there.
    """
    size, total = sizes(docs)
    blocks, parts = max(1, -(-size // block_bytes)), max(1, -(-order * total // partition_grams))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    rows = rows.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int"))
    table = "part int, block int, n int, grams array<long>, counts array<int>"
    replies = totals(rows.groupBy("block").applyInArrow(count_first(range(1, min(order, 2) + 1), parts), table), parts, total)
    # several steps need the totals, so they are written, and the shuffles that made them go
    replies = settled(replies, "totals") if order > 2 else replies
    for n in range(3, order + 1):
        more = totals(rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(count_next(n, parts, least), table), parts, total)
        replies = replies.union(settled(more, "totals"))
    schema = "doc_id long, n_words long, log10_score double, mean_log10 double" + "".join(f", n_order{n} long" for n in range(1, order + 1))
    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score_block(order, alpha, least, total), schema)


def oracle(order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> str:
    """The same rows in DuckDB."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    gram = lambda n: " || ' ' || ".join(f"w{k}" for k in range(n - 1, -1, -1))
    lags = ", ".join(f"lag(w, {k}) over (partition by rid order by i) w{k}" for k in range(1, order))
    tables = ", ".join(f"c{n} as (select {gram(n)} g, count(*) c from p where i >= {n} group by 1)" for n in range(1, order + 1))
    joins = " ".join(f"left join c{n} on p.i >= {n} and c{n}.g = {gram(n)}" for n in range(1, order + 1))
    context = lambda n: " || ' ' || ".join(f"w{k}" for k in range(n - 1, 0, -1))
    contexts = " ".join(f"left join c{n - 1} x{n} on p.i >= {n} and x{n}.g = {context(n)}" for n in range(2, order + 1))
    level = "case " + " ".join(f"when i >= {n} and c{n}.c >= {least} then {n}" for n in range(order, 1, -1)) + " else 1 end"
    ratio = "case level " + " ".join(f"when {n} then log10(c_{n} / x_{n})" for n in range(order, 1, -1)) + " else log10(c_1 / (select count(*) from p)) end"
    columns = ", ".join(f"cast(c{n}.c as double) c_{n}" for n in range(1, order + 1)) + "".join(f", x{n}.c x_{n}" for n in range(2, order + 1))
    return (
        f"with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') ws from documents), "
        f"t as (select rid, i, ws[i] w from d, unnest(range(1, len(ws) + 1)) as u(i)), p as (select rid, i, w w0, {lags} from t), {tables}, "
        f"j as (select p.rid, p.i, {level} as level, {columns} from p {joins} {contexts}), "
        f"s as (select rid, level, {ratio} + (least(i, {order}) - level) * log10({alpha}) s from j), "
        f"r as (select rid, sum(s) s, {', '.join(f'count(*) filter (where level = {n}) n{n}' for n in range(1, order + 1))} from s group by rid) "
        "select doc_id, len(ws) n_words, round(coalesce(s, 0), 4) log10_score, round(s / len(ws), 6) mean_log10, "
        f"{', '.join(f'coalesce(n{n}, 0) n_order{n}' for n in range(1, order + 1))} from d left join r on d.rid = r.rid"
    )
