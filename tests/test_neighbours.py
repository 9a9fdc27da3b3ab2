import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import neighbours as N

SCHEMA = "id long, v array<float>, cell int, row long"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q % 10:
            continue
        near = sorted((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 9), i) for b, (i, y) in enumerate(good) if a != b and len(x) == len(y))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def clustered(seed, n, centres, dims=16, spread=0.1):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(centres, dims))
    return [(i, (middle[r.integers(centres)] + spread * r.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [dict(), dict(block=40, pack=3, pivots=12), dict(block=7, pack=1, pivots=1)])
def test_equal_to_comparing_all(spark, sizes):
    rows = clustered(1, 500, 9) + [(1000 + i, [1.0] + [0.0] * 15) for i in range(120)]
    rows += [(2000, None), (2010, []), (2020, [0.0] * 16), (2030, [float("nan")] * 16), (2040, [None] + [1.0] * 15), (None, [1.0] * 16), (2050, [1.0, 2.0]), (2060, [2.0, 1.0]), (500, rows[3][1]), (500, rows[3][1])]
    got = N.top_k(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA), "id", "v", F.col("id") % 10 == 0, 6, **sizes)
    found = sorted((r.query_id, r["rank"], r.neighbour_id, r.similarity) for r in got.collect())
    want = brute(rows, 6)
    assert [x[:3] for x in found] == [x[:3] for x in want] and np.allclose([x[3] for x in found], [x[3] for x in want], atol=2e-9)


def test_few_are_compared(spark):
    rows = clustered(2, 4000, 60, 8, 0.03)
    got = N.top_k(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA), "id", "v", F.col("id") % 100 == 0, 5, block=500).collect()
    seen = {r.query_id: r.compared for r in got}
    assert len(seen) == 40 and np.mean(list(seen.values())) < len(rows) / 5
    assert N.top_k(spark.createDataFrame([], SCHEMA), "id", "v", F.lit(True)).count() == 0


@pytest.mark.parametrize("sizes", [dict(), dict(block=30, pack=7)])
def test_of_kind_in_blocks_and_packs(spark, sizes):
    rows = [(i, v, i % 3) for i, v in clustered(3, 400, 5)] + [(1000 + i, [1.0] + [0.0] * 15, 1) for i in range(90)]  # copies: ties
    rows += [(2000, None, 1), (2010, [0.0] * 16, 1), (2020, [float("nan")] * 16, 1), (2030, [1.0] * 16, None), (None, [1.0] * 16, 1), (2040, [1.0, 2.0], 1), (2050, [2.0, 1.0], 1)]
    got = N.of_kind(spark.createDataFrame(rows, "vec_id long, v array<float>, kind int"), "vec_id", "v", "kind", F.col("vec_id") % 10 == 0, 5, 0.1, **sizes).collect()
    good = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows if i is not None and c is not None and v and np.isfinite(v).all() and any(v)]
    want = []
    for q, x, c in good:
        if q % 10 == 0:
            near = sorted((-round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 6), i) for i, y, d in good if d == c and i != q and len(x) == len(y))
            want += [(q, i, -s, r) for r, (s, i) in enumerate([n for n in near if -n[0] >= 0.1][:5])]
    assert sorted((r.query_id, r.vec_id, r.similarity, r["rank"]) for r in got) == sorted(want)


def test_packs_are_not_broadcast(spark, monkeypatch):
    plans, real = [], N.materialize
    monkeypatch.setattr(N, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or real(df, name))
    N.top_k(spark.createDataFrame([(i, v, 1, 1) for i, v in clustered(4, 300, 5)], SCHEMA), "id", "v", F.col("id") % 100 == 0, 5)
    met = [text for name, text in plans if name in ("first", "near")]
    assert len(met) == 2 and all("SortMergeJoin [cell" in text for text in met)
