import random

from mnemospark.operators import state as S


def test_nodes_on_cycles_are_found_without_pairs_of_all_they_reach(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {(b * 100 + rng.randrange(20), b * 100 + rng.randrange(20)) for b in range(20) for _ in range(4 + 2 * b)}
    pairs |= {(5000 + k, 5001 + k) for k in range(40)} | {(7, 7)}
    edges = spark.createDataFrame(sorted(pairs), "parent long, child long")
    reach = {(a, b) for a, b in pairs if a != b}
    while (more := reach | {(a, d) for a, b in reach for c, d in reach if b == c}) != reach:
        reach = more
    want = sorted(a for a, b in reach if a == b)
    assert sorted(r.node for r in S.cyclic(edges, together=30).collect()) == want
    monkeypatch.setattr(S, "reachable", None)  # what made the pairs
    assert sorted(r.node for r in S.cyclic(edges).collect()) == want
