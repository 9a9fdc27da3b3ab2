import random

from mnemospark.operators import forest as R


def test_intervals_of_deep_and_wide_forests(spark):
    r = random.Random(4)
    parent = {k: k - 1 if k else None for k in range(400)}  # a chain
    parent |= {1000 + k: r.choice([None, 9999, *range(1000, 1000 + k)]) if k else None for k in range(300)}
    parent |= {5000: 5001, 5001: 5000, 5002: 5001}  # a circle and what hangs on it
    rows = [(k, p) for k, p in parent.items()] + [(7, 6)]
    got = {x.node: (x.enter, x.exit) for x in R.labels(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert set(got) == set(parent) - {5000, 5001, 5002}

    def above(k):
        out = {k}
        while parent.get(k) in parent:
            k = parent[k]
            out.add(k)
        return out

    size = dict.fromkeys(got, 0)
    for k in got:
        for a in above(k):
            size[a] += 1
            assert got[a][0] <= got[k][0] <= got[k][1] <= got[a][1]
    assert all((b - a + 1) == 2 * size[k] for k, (a, b) in got.items())
    assert R.labels(spark.createDataFrame([], "node long, parent long")).count() == 0
