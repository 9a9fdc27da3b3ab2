import random

import pytest

from mnemospark.operators import state as S


def above(edges, start):
    up, seen, stack = {}, set(start), list(start)
    for parent, child in edges:
        up.setdefault(child, []).append(parent)
    while stack:
        for p in up.get(stack.pop(), ()):
            if p is not None and p not in seen:
                seen.add(p), stack.append(p)
    return seen


@pytest.mark.parametrize("block", [7, 100_000])
def test_upwards_in_blocks(spark, block):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(60)] + [(r.randrange(k), k) for k in range(100, 140)] + [(300 + (k + 1) % 5, 300 + k) for k in range(5)] + [(300, 290), (None, 0), (7, 301), (3, 9)]
    for start in ([60], [139, 120], [290], [5, 5, 1000], [303, 30]):
        got = S.upwards(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame([(x,) for x in start], "node long"), block)
        assert sorted(x.node for x in got.collect()) == sorted(above(edges, start))


def test_a_chain_is_shortened_before_it_is_doubled(spark, monkeypatch):
    seen, real = [], S.doubled
    monkeypatch.setattr(S, "doubled", lambda jumps, start: seen.append(jumps.count()) or real(jumps, start))
    edges = [(f"n{k:05}", f"n{k + 1:05}") for k in range(2000)]
    got = S.upwards(spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("n02000",)], "node string"), 200)
    assert got.count() == 2001 and seen[0] < 50
