import random

import pytest

from mnemospark.operators import state as S


@pytest.mark.parametrize("part", [3, 17, 100_000])
def test_islands_over_parts(spark, part):
    r = random.Random(2)
    rows = [(s, f, f + r.choice([0, 2, 9, 60])) for s in range(3) for f in (r.randrange(400 * (s + 1)) for _ in range(60))]
    rows += [(1, 0, 500), (1, 0, 500), (2, 10, 2000), (7, 5, 5)]  # ranges that reach over many parts
    want = []
    for s in {x[0] for x in rows}:
        islands = []
        for f, l in sorted((f, l) for k, f, l in rows if k == s):
            if islands and f <= islands[-1][1]:
                islands[-1] = [islands[-1][0], max(l, islands[-1][1]), islands[-1][2] + 1]
            else:
                islands.append([f, l, 1])
        want += [(s, n, *x) for n, x in enumerate(islands, 1)]
    got = S.overlap_groups(spark.createDataFrame(rows, "session long, first long, last long"), part).select("session", "island", "first", "last", "ranges")
    assert sorted(map(tuple, got.collect())) == sorted(want)
