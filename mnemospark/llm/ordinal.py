"""Ordinal quality classifier (operator 1).

A cumulative-link model: grade y of a document with features x satisfies
P(y <= k) = sigmoid(threshold_k - weights . x), with one weight vector for all grades and ordered thresholds. Its
results are the expected grade and the tail probability P(y >= selected grade), by which documents are kept.

Features are hashed text: each word, its shape (runs of letters, digits and signs) and whether it repeats the word
before it. A feature's value is the root of its share among the document's words, so that length does not matter and
every document has the same norm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.bulk import hand_back, slices, string_column

BUCKETS = 1 << 20
#: Labelled documents that the model is fitted on, at most; the ones of least hash, so any number of workers picks the same.
SAMPLE = 12_000
#: Characters of the texts that the model is fitted on, about; bounds what reaches the driver, however long texts are.
SAMPLE_CHARS = 100_000_000
#: Features that the fit sums up at a time, about.
RUN = 400_000
#: A document stays where P(good) is at least this.
LEAST = 0.6
RUNS = [(re.compile(p), s) for p, s in ((r"[^\W\d_]+", lambda m: "a" if m[0].islower() else "A" if m[0].isupper() else "Aa"), (r"\d+", "0"), (r"([^\w])\1+", r"\1"))]


def shape(word: str) -> str:
    for pattern, by in RUNS:
        word = pattern.sub(by, word)
    return word


def bucket(kind: str, name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{kind} {name}") % BUCKETS


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and values of all texts one after another, and where each text's begin."""
    parts = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    found = pc.dictionary_encode(parts.values)
    distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    names = np.empty((len(distinct), 2), np.int64)
    for i, w in enumerate(distinct):
        names[i] = bucket("word", w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()), bucket("shape", shape(w))
    blank = np.array([not w for w in distinct], bool)
    codes, offsets = found.indices.to_numpy(), parts.offsets.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if blank.any():
        real = ~blank[codes]
        codes, doc = codes[real], doc[real]
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.where(again, bucket("repeat", "yes"), bucket("repeat", "no"))
    cells, counts = np.unique(np.concatenate([(doc << 20) | names[codes, 0], (doc << 20) | names[codes, 1], (doc << 20) | repeats]), return_counts=True)
    of, number = cells >> 20, cells & (BUCKETS - 1)
    words = np.bincount(doc, minlength=len(texts))
    return number, np.sqrt(counts / words[of]), np.searchsorted(of, np.arange(len(texts) + 1))


@dataclass
class Ordinal:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    #: Empty without labels: then every document has the highest grade.
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, number: np.ndarray, value: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[number].astype(np.float64) * value)])
        return total[offsets[1:]] - total[offsets[:-1]]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(y >= k) for k = 1, 2, ... in the columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))

    @classmethod
    def fit(cls, number, value, offsets, grade, steps: int = 200, rate: float = 0.5, ridge: float = 4e-6) -> Ordinal:
        """Maximum likelihood with a ridge, by Adam over all rows. Thresholds are a first one and positive steps.

        Sums over features go through runs of rows, so that besides the features themselves little memory is used.
        """
        if not len(grade):
            return cls()
        levels = int(grade.max())
        if levels == 0:
            return cls(thresholds=np.array([np.inf]))
        used = np.unique(number)
        at = np.searchsorted(used, number).astype(np.int32)
        cuts_of = np.unique(np.concatenate([[0], np.searchsorted(offsets, np.arange(0, offsets[-1], RUN), side="right"), [len(grade)]]))
        runs = [(i, j, slice(offsets[i], offsets[j])) for i, j in zip(cuts_of.tolist(), cuts_of[1:].tolist())]
        of = lambda i, j: np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        share = np.array([(grade >= k).mean() for k in range(1, levels + 1)])
        first = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
        w, t = np.zeros(len(used)), np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
        moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(t), np.zeros_like(t)]]
        above = np.where(grade > 0, grade - 1, 0)
        below = np.where(grade < levels, grade, 0)
        for step in range(1, steps + 1):
            cuts = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
            score = np.concatenate([np.bincount(of(i, j), w[at[c]] * value[c], j - i) for i, j, c in runs])
            low = np.where(grade > 0, 1 / (1 + np.exp(np.clip(score - cuts[above], -50, 50))), 0.0)  # P(y < grade)
            high = np.where(grade < levels, 1 / (1 + np.exp(np.clip(score - cuts[below], -50, 50))), 1.0)  # P(y <= grade)
            p = np.maximum(high - low, 1e-12)
            d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
            slope = (d_high - d_low) / len(grade)  # of the loss by the score
            g_w = ridge * w
            for i, j, c in runs:
                g_w += np.bincount(at[c], value[c] * slope[i:j][of(i, j)], len(used))
            g_cut = np.bincount(above, np.where(grade > 0, d_low, 0), levels) - np.bincount(below, np.where(grade < levels, d_high, 0), levels)
            g_cut /= len(grade)
            g_t = np.cumsum(g_cut[::-1])[::-1] * np.concatenate([[1.0], np.exp(t[1:])])
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for x, g, m, scale in ((w, g_w, moments[0], 10.0), (t, g_t, moments[1], 0.2)):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.01 * (g * g - m[1])
                x -= now * scale * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
        weights = np.zeros(BUCKETS, np.float32)
        weights[used] = w
        return cls(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 of low quality, 2 good. Rows with nulls are no ratings; of several the worst counts."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rated = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return rated.select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Ordinal:
    """Fit on the ``sample`` rated documents (doc_id, text; ratings doc_id, grade) whose ids hash lowest.

    The sample's ratings are that many rows and are broadcast; its features are collected. Each rated document counts once: of several rows with its id the
    one of least hash. Texts are taken in the order of the hash as long as they hold ``chars`` characters together, so the sample is bounded in both ways.
    """
    # only ratings of documents that are there count towards the sample
    chosen = ratings.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    order = F.xxhash64("doc_id", "text")
    sizes = docs.select("doc_id", order.alias("order"), F.length(F.coalesce("text", F.lit(""))).alias("n")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    picked = sorted(tuple(r.one) for r in sizes.groupBy("doc_id").agg(F.min(F.struct("order", "n")).alias("one")).select("one").collect())
    fitting = np.searchsorted(np.cumsum([n for _, n in picked]), chars, side="right") if picked else 0
    taken = F.broadcast(docs.sparkSession.createDataFrame([(o,) for o, _ in picked[: max(1, int(fitting))]], "order long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = string_column(batch, "text")
            for a, b in slices(texts):
                number, value, offsets = features(texts.slice(a, b - a))
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grade").slice(a, b - a), batch.column("order").slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))],
                    ["grade", "order", "number", "value"],
                )

    rows = docs.select("doc_id", "text", order.alias("order")).join(F.broadcast(chosen), "doc_id").join(taken, "order", "left_semi").dropDuplicates(["order"]).select("text", "grade", "order")
    got = rows.mapInArrow(run, "grade int, order long, number array<int>, value array<float>").toArrow().sort_by("order")
    grades, lists = got.column("grade").to_numpy(), [got.column(c).combine_chunks() for c in ("number", "value")]
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())]) if len(got) else np.zeros(1, np.int64)
    del got
    number, value = (x.flatten().to_numpy() for x in lists)
    model = Ordinal.fit(number, value, offsets, grades)
    del number, value, lists
    hand_back()
    return model


def classify(docs: DataFrame, model: Ordinal, least: float = LEAST, grade: int = 2) -> DataFrame:
    """doc_id, expected_grade, tail and kept of each row: kept where P(y >= ``grade``) is at least ``least``.

    A text without words has a score of zero; null texts are such. The model's size is fixed, so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for batch in batches:
            texts, doc_ids = string_column(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in slices(texts):
                tails = own.tails(own.score(*features(texts.slice(a, b - a))))
                tail = tails[:, grade - 1] if tails.shape[1] >= grade else np.ones(len(tails)) if not tails.shape[1] else np.zeros(len(tails))
                expected = tails.sum(axis=1) if tails.shape[1] else np.full(len(tails), float(grade))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(np.round(expected, 6)), pa.array(np.round(tail, 6)), pa.array(tail >= least)],
                    ["doc_id", "expected_grade", "tail", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail double, kept boolean")


def selected(docs: DataFrame, model: Ordinal, least: float = LEAST, grade: int = 2) -> DataFrame:
    """The rows of ``docs`` that `classify` keeps, with all their columns (rows are tested where they lie, without a join)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for batch in batches:
            texts = batch.column(place).cast(pa.large_string())
            for a, b in slices(texts):
                tails = own.tails(own.score(*features(texts.slice(a, b - a))))
                good = tails[:, grade - 1] >= least if tails.shape[1] >= grade else np.full(b - a, not tails.shape[1])
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
