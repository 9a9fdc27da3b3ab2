import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import near_dedup
from mnemospark.llm.graph import components
from mnemospark.llm.shingles import words
from tests.llm.helpers import documents, empty_frame, odd_frame


def brute(rows, n, percent):
    def shingle_set(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple((x is not None, x or 0) for x in r)


def got(frame, **how):
    rows = near_dedup.classes(frame, **how).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=key)


def near_copies():
    """A base with many copies that are like it but less like each other, a chain, and unrelated texts."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(120)], []
    for _ in range(40):
        own = list(base)
        for at in r.sample(range(4, 116), 3):
            own[at] = word()
        rows.append(" ".join(own))
    rows.append(" ".join(base))
    chain = [word() for _ in range(100)]
    for _ in range(12):
        rows.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    rows += [" ".join(word() for _ in range(50)) for _ in range(10)]
    r.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("n", [4, 5])
def test_near_copies_against_brute_force(spark, n):
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, n, 80)
    assert len({c for _, _, c in want}) < len(rows) - 10
    assert got(frame, n=n, percent=80) == sorted(want, key=key)


def test_documents_and_odd_texts_against_brute_force(spark):
    rows = documents()
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), n=4) == sorted(brute(rows, 4, 80), key=key)
    frame, rows = odd_frame(spark)
    left = near_dedup.classes(frame, n=4).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in left), key=key) == sorted(brute(rows, 4, 80), key=key)
    assert near_dedup.classes(empty_frame(spark)).count() == 0


def test_one_of_each_class_stays_with_its_columns(spark):
    rows = [(5, "one two three four five six"), (3, "One two three four five six"), (9, None), (9, None), (8, ""), (None, "lonely words of no id at all"), (7, "x"), (7, "x"), (7, "y")]
    frame = spark.createDataFrame([(d, t, str(d)) for d, t in rows], "doc_id long, text string, band string")
    kept = near_dedup.deduplicated(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=lambda r: (r[0] or 0, r[1] or "")) == [
        (None, "lonely words of no id at all"), (3, "One two three four five six"), (7, "x"), (7, "y"), (8, ""), (9, None), (9, None)]


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    a = r.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], r.integers(0, 2**63, 200).astype(np.uint64)])
    same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.15
    first, windows = near_dedup.permutations()
    assert (windows[-1][1:] == windows[0][: near_dedup.COORDINATES - 1]).all() and len(set(first.tolist())) == near_dedup.SLOTS


def test_words_split_as_written():
    hashes, offsets = words(pa.array(["A b\tc\x0b\x0cd ", None, "  ", "nb\xa0sp É", "a B c d"], pa.large_string()))
    assert np.diff(offsets).tolist() == [4, 0, 0, 2, 4]
    assert (hashes[:4] == hashes[6:]).all()


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    names = {r.node: r.component for r in components(links).collect()}
    assert names == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100}


def test_columns_of_any_name_stay_and_hot_groups_spread(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(i, same if i % 3 else f"{same} and number {i} comes here too", "k", "r", 1) for i in range(1, 1500)] + [(None, None, "k", "r", 1), (None, "", "k", "r", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, key string, row string, _key int")
    got = near_dedup.deduplicated(frame)
    assert got.columns == frame.columns
    kept = [(r.doc_id, r.key, r.row, r._key) for r in got.collect()]
    want = {d: c for (d, *_), (_, _, c) in zip(rows, brute([r[:2] for r in rows], 5, 80))}
    assert all(r[1:] == ("k", "r", 1) for r in kept)
    assert sorted(d for d, *_ in kept if d is not None) == sorted(d for d, c in want.items() if d is not None and d == c) and sum(d is None for d, *_ in kept) == 2
