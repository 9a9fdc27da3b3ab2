import math
import re
from collections import Counter

import numpy as np
import pytest

from mnemospark.llm import backoff
from tests.llm.helpers import documents, empty_frame, odd_frame


def brute(rows, order, alpha, least):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    counts = Counter(tuple(w[i : i + n]) for w in texts for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total, out = sum(map(len, texts)), []
    for (doc, _), w in zip(rows, texts):
        score, levels = 0.0, [0] * order
        for i in range(len(w)):
            most = min(i + 1, order)
            n = next(n for n in range(most, 0, -1) if n == 1 or counts[tuple(w[i - n + 1 : i + 1])] >= least)
            below = total if n == 1 else counts[tuple(w[i - n + 1 : i])]
            score += math.log10(counts[tuple(w[i - n + 1 : i + 1])] / below) + (most - n) * math.log10(alpha)
            levels[n - 1] += 1
        out.append((doc, len(w), score, *levels))
    return out


def sort(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


@pytest.mark.parametrize("order,block,grams", [(3, 20_000, 5_000), (2, 10**7, 10**7), (1, 3_000, 200)])
def test_scores_against_brute_force(spark, order, block, grams):
    odd, odd_rows = odd_frame(spark)
    for rows, frame in ((documents(60), spark.createDataFrame(documents(60), "doc_id long, text string")), (odd_rows, odd)):
        got = backoff.scores(frame, order=order, block_bytes=block, partition_grams=grams).collect()
        for g, w in zip(sort(tuple(r) for r in got), sort(brute(rows, order, 0.4, 2))):
            assert (g[0], g[1], *g[4:]) == (w[0], w[1], *w[3:])
            assert g[2] == pytest.approx(w[2], abs=1e-3)
            assert (g[3] is None) == (w[1] == 0) and (not w[1] or g[3] == pytest.approx(w[2] / w[1], abs=1e-4))
        assert len(got) == len(rows)


def test_empty_table_and_unseen_context(spark):
    assert backoff.scores(empty_frame(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b a b a")], "doc_id long, text string")
    r = backoff.scores(one, order=2).first()
    want = math.log10(3 / 5) + 2 * math.log10(2 / 3) + 2 * math.log10(2 / 2)
    assert r.log10_score == pytest.approx(want, abs=1e-4) and (r.n_order1, r.n_order2) == (1, 4)


def test_parts_are_ranges_in_spark_s_order():
    found = np.sort(np.frombuffer(np.random.default_rng(2).bytes(8000), np.uint64))
    parts, signed = backoff.part_of(found, 7), backoff.as_signed(found)
    assert (np.diff(parts) >= 0).all() and parts.min() == 0 and parts.max() == 6
    assert (np.diff(signed) > 0).all() and len(np.unique(signed)) == 1000


def test_counts_are_those_of_all_blocks(spark):
    """The count tables are joined with the exploded n-grams without another shuffle of them."""
    rows = [(0, 1, 1, [5, -3], [2, 1]), (0, 2, 1, [5], [4]), (1, 1, 1, [9], [1]), (0, 1, 2, [5], [7])]
    frame = spark.createDataFrame(rows, "part int, block int, n int, grams array<long>, counts array<int>")
    got = {(r.block, r.n, r.part): r.totals for r in backoff.totals(frame, 3).collect()}
    assert got == {(1, 1, 0): [1, 6], (2, 1, 0): [6], (1, 1, 1): [1], (1, 2, 0): [7]}
    plan = backoff.joined(frame, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(part") == plan.count("Exchange ") == 1, plan


def test_totals_are_collected_as_numbers(spark):
    """A place and a count share 64 bits: rows of two fields cost more to collect and to sort than all else of the step."""
    grams = sorted(np.random.default_rng(3).integers(-(2**63), 2**63, 300).tolist())
    rows = [(0, b, 1, grams[b::2], [2**30 + k for k in range(150)]) for b in (0, 1)] + [(0, 2, 1, grams, [1] * 300)]
    frame = spark.createDataFrame(rows, "part int, block int, n int, grams array<long>, counts array<int>")
    for most in (2**33, 2**50, 1 << 40):
        got = {r.block: r.totals for r in backoff.totals(frame, 3, most).collect()}
        assert got[0] == got[1] == [2**30 + k + 1 for k in range(150)] and got[2] == [t for t in got[0] for _ in range(2)]
    plan = backoff.totals(frame, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and "collect_list(struct" not in plan, plan


def test_all_bits_of_a_hash_are_kept():
    hashes = np.arange(1, 1001, dtype=np.uint64)
    for n in (1, 2, 3):
        found, _ = backoff.grams(hashes, np.arange(1000), n)
        assert np.bitwise_or.reduce(found) == np.uint64(2**64 - 1)
    parts = backoff.part_of(np.array([0, 2**63, 2**64 - 1], np.uint64), 7)
    assert parts.tolist() == [0, 3, 6]
