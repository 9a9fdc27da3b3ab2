"""How far the sources of a language are from one another and from the language as a whole (operator 13).

Each (lang, source) group is a vector of smoothed shares of the language's kept terms. Kept terms are dealt by hash into
chunks, and the groups of a language into seats; a resident row is one seat's groups in one chunk, their counts compressed. Peers are
the same rows in travel: in round r the rows of seat i + r stand at seat i, so after half a turn of the ring each two seats
have met once, and a meeting gives both directions. Distances are sums over terms, so a chunk's part is added to the others'
and no task holds more than two seats' counts of one chunk, however many documents a group has.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.bulk import hand_back, slices, string_column
from mnemospark.llm.shared import materialize

#: Shares are in billionths; each kept term has this many occurrences more than were counted.
SCALE_STEPS, SMOOTH = 3, 5
#: Terms a chunk has on average, groups a seat has, rounds a job has.
CHUNK, SEAT, ROUNDS = 16_384, 16, 8
#: Every byte of a term stands for itself, capital letters A-Z for small ones, all other ASCII for a blank.
FOLD = bytes(b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Text number and word number of each word, and the distinct words. ``texts`` have 64-bit offsets and no nulls."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = b"" if data is None else data.slice(bounds[0], bounds[-1] - bounds[0]).to_pybytes().translate(FOLD)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(raw))
    parts = pc.ascii_split_whitespace(folded)
    found = pc.dictionary_encode(parts.values)
    of = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    codes = found.indices.to_numpy()
    real = pc.not_equal(found.dictionary, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
    return of[real], codes[real].astype(np.int64), found.dictionary


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, its occurrences ``n`` and the number of texts ``docs`` that have it, summed over a slice of rows."""
    for batch in batches:
        texts = pc.fill_null(string_column(batch, "text"), "")
        for a, b in slices(texts, 8_000_000):
            of, code, terms = words(texts.slice(a, b - a))
            k = max(1, len(terms))
            lang, source = (pc.dictionary_encode(batch.column(c).slice(a, b - a)) for c in ("lang", "source"))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            each, times = np.unique(of * k + code, return_counts=True)
            key, place = np.unique(group[each // k] * k + each % k, return_inverse=True)
            n, docs = np.bincount(place, times, len(key)).astype(np.int64), np.bincount(place, minlength=len(key))
            at = key // k
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(at // len(source.dictionary))),
                    source.dictionary.take(pa.array(at % len(source.dictionary))),
                    terms.take(pa.array(key % k)).cast(pa.string()),
                    pa.array(n),
                    pa.array(docs.astype(np.int64)),
                ],
                ["lang", "source", "term", "n", "docs"],
            )


def shares(x: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(10**9 * x / whole), exactly, by long division in thousands; ``whole`` is below 2**63 / 1000."""
    out, rest = np.divmod(x, whole)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return 1 + out


def pack(entries: list[dict]) -> bytes:
    """Counts (number, id, n) of one seat's groups in one chunk, compressed."""
    rows = np.array([(e["number"], e["id"], e["n"]) for e in entries], np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    rows[1:, :2] -= rows[:-1, :2].copy()
    return zlib.compress(rows.T.tobytes(), 1)


def unpack(payload: bytes | None) -> np.ndarray:
    if payload is None:
        return np.zeros((0, 3), np.int64)
    rows = np.frombuffer(zlib.decompress(payload), np.int64).reshape(3, -1).T.copy()
    rows[:, :2] = np.cumsum(rows[:, :2], axis=0)
    return rows


def dense(groups: list[dict], payload: bytes | None, terms: int) -> np.ndarray:
    """Shares of every term of a chunk in each group of a seat."""
    counts = np.zeros((len(groups), terms), np.int64)
    line = {g["number"]: k for k, g in enumerate(groups)}
    rows = unpack(payload)
    counts[np.array([line[x] for x in rows[:, 0].tolist()], np.int64), rows[:, 1]] = rows[:, 2]
    return np.stack([shares(c + SMOOTH, g["whole"]) for c, g in zip(counts, groups)]) if terms else counts


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of each meeting: (lang, a, b, value) of one chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            own = dense(row["groups"], row["counts"], row["terms"])
            other = own if row["seat"] == row["peer"] else dense(row["peer_groups"], row["peer_counts"], row["terms"])
            at, to = [g["number"] for g in row["groups"]], [g["number"] for g in row["peer_groups"]]
            a, b, value = [], [], []
            for k, line in enumerate(own):
                far = np.abs(line - other).sum(axis=1).tolist()
                for j, f in zip(to, far):
                    if j != at[k]:
                        a.append(at[k]), b.append(j), value.append(f)
                        if row["seat"] != row["peer"]:
                            a.append(j), b.append(at[k]), value.append(f)
            yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())], ["lang", "a", "b", "value"])
        hand_back()


def topped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For each group of a seat the terms of one chunk that it has most above the language, by a heap of ``most``."""
    for batch in batches:
        for row in batch.to_pylist():
            whole = np.array([x["total"] for x in row["totals"]], np.int64)  # in the order of ids
            rows = unpack(row["counts"])
            out = []
            for g in row["groups"]:
                own = rows[rows[:, 0] == g["number"]]
                if len(own):
                    above = shares(own[:, 2] + SMOOTH, g["whole"]) - shares(whole[own[:, 1]] + SMOOTH, row["lang_whole"])
                    best = heapq.nsmallest(most, ((-f, i) for f, i in zip(above.tolist(), own[:, 1].tolist()) if f > 0))
                    out += [(g["number"], i, -f) for f, i in best]
            number, ids, value = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * len(out), pa.string()), pa.array([row["chunk"]] * len(out), pa.int32()), pa.array(number, pa.int32()), pa.array(ids, pa.int32()), pa.array(value, pa.int64())],
                ["lang", "chunk", "number", "id", "value"],
            )
        hand_back()


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payload = [pack(x) for x in batch.column("entries").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", "seat", "chunk")), pa.array(payload, pa.binary())], ["lang", "seat", "chunk", "counts"])


def meetings(residents: DataFrame) -> DataFrame:
    """Distances (lang, a, b, value) of all groups of a language, summed over chunks.

    A round's travelling rows are those of the round before, one seat on. Some rounds make one job, whose result is written.
    """
    most = residents.agg(F.max("seats")).first()[0] or 0
    there = ["groups", "counts"]
    peers = residents.select("lang", "chunk", "seats", F.col("seat").alias("peer"), F.col("seat").alias("at"), *[F.col(c).alias(f"peer_{c}") for c in there])
    jobs, rounds = [], []
    for r in range(most // 2 + 1):
        # in an even ring the last round would have each meeting twice
        once = F.lit(2 * r) < F.col("seats") if r else F.lit(True)
        here = residents.where(once | ((F.col("seats") == 2 * r) & (F.col("seat") < r)))
        rounds.append(here.join(peers.drop("seats").withColumnRenamed("at", "seat"), ["lang", "chunk", "seat"]).mapInArrow(met, "lang string, a int, b int, value long"))
        peers = peers.withColumn("at", F.pmod(F.col("at") - 1, F.col("seats")).cast("int"))
        if len(rounds) == ROUNDS or r == most // 2:
            jobs.append(materialize(functools.reduce(DataFrame.union, rounds).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "meetings"))
            rounds = []
    return functools.reduce(DataFrame.union, jobs)


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, chunk: int = CHUNK, seat: int = SEAT) -> DataFrame:
    """lang, source, part, item, value, rank: each source's distance from each other one, and the terms it has most above its language.

    A null text, lang or source is an empty one; a repeated row is a document of its own; other columns are ignored. A term
    is a run of letters A-Z, small for capital, and of characters beyond ASCII, in whole texts; kept are those in ``min_docs`` documents of
    a language. Without kept terms all distances are 0. Ties go to the item that is less in UTF-8. Part `pair` has all ranks, part `term` ``top``.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    counts = materialize(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs)
    kept = materialize(kept.drop("docs"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("total"))
    chunks = -(-(langs.agg(F.max("size")).first()[0] or 1) // chunk)
    in_chunk = Window.partitionBy("lang", "chunk").orderBy("term")
    kept = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)).cast("int")).withColumn("id", (F.row_number().over(in_chunk) - 1).cast("int"))
    kept = materialize(kept, "terms")
    held = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "chunk", "id", "n"), "held")

    groups = rows.select("lang", "source").distinct().join(held.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    whole = lambda n: F.coalesce(n, F.lit(0)) + SMOOTH * F.coalesce("size", F.lit(0))
    groups = groups.select("lang", "source", number.cast("int").alias("number"), whole("n").alias("whole"), whole("total").alias("lang_whole"))
    groups = materialize(groups.withColumn("seat", F.floor(F.col("number") / seat).cast("int")), "groups")
    seats = groups.groupBy("lang", "seat").agg(F.sort_array(F.collect_list(F.struct("number", "whole"))).alias("groups"), F.first("lang_whole").alias("lang_whole"))
    seats = seats.join(groups.groupBy("lang").agg((F.max("seat") + 1).alias("seats")), "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    entries = held.join(groups.select("lang", "source", "number", "seat"), ["lang", "source"]).groupBy("lang", "seat", "chunk").agg(F.collect_list(F.struct("number", "id", "n")).alias("entries"))
    totals = kept.groupBy("lang", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "total"))).alias("totals"))
    residents = seats.join(entries.mapInArrow(packed, "lang string, seat int, chunk int, counts binary"), ["lang", "seat", "chunk"], "left")
    residents = residents.join(totals.select("lang", "chunk", F.size("totals").alias("terms")), ["lang", "chunk"], "left")
    residents = materialize(residents.withColumn("terms", F.coalesce("terms", F.lit(0))), "residents")

    name = lambda c, x: groups.select("lang", F.col("number").alias(c), F.col("source").alias(x))
    pairs = meetings(residents.drop("lang_whole")).join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    best = residents.where("counts is not null").join(totals, ["lang", "chunk"]).mapInArrow(functools.partial(topped, most=top), "lang string, chunk int, number int, id int, value long")
    best = best.join(kept.select("lang", "chunk", "id", F.col("term").alias("item")), ["lang", "chunk", "id"]).join(name("number", "source"), ["lang", "number"])
    parts = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value") for part, x in (("pair", pairs), ("term", best))]
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in parts]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top))


def oracle(min_docs: int = 30, top: int = 50) -> str:
    """DuckDB SQL for `divergence`."""
    share = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM t GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS total FROM counts GROUP BY ALL HAVING sum(docs) >= {min_docs}),
sized AS (SELECT *, count(*) OVER (PARTITION BY lang) AS v, sum(total) OVER (PARTITION BY lang) AS lang_total FROM kept),
groups AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, v, total, lang_total FROM groups g JOIN sized USING (lang) LEFT JOIN counts USING (lang, source, term)),
p AS (SELECT lang, source, term, n, {share("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p, {share("total", "lang_total")} AS q FROM held),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.term = y.term
            WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= {top}"""
