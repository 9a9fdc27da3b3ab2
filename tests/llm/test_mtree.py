import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import mtree


def brute(rows, k, every):
    good = [(i, np.floor(np.array(v, np.float64) * 256).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for r, (q, v) in enumerate(good):
        if q % every:
            continue
        found = sorted((-int(v @ w), i) for s, (i, w) in enumerate(good) if s != r and len(w) == len(v))[:k]
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(found, 1)]
    return sorted(out)


def test_against_brute_force_in_many_trees_and_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), (r.normal(size=8) * r.choice([0.1, 1, 3])).astype(np.float32).tolist()) for i in r.permutation(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)]  # a vector that is there very often: ties
    rows += [(2010, rows[5][1]), (None, [1.0] * 8), (3000, None), (3010, [float("nan")] * 8), (3020, [float("inf")] + [0.0] * 7), (3030, [None] + [0.0] * 7), (3040, []), (3050, [1.0, 2.0]), (3060, [1.0, 2.0]), (3061, [0.5, 0.5]), (2000, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, dim string, part int")
    for sizes in ((25_000, 2_000), (300, 17)):
        got = mtree.top_k(frame, F.col("vec_id") % 10 == 0, 5, tree_vectors=sizes[0], query_block=sizes[1])
        assert sorted(tuple(x) for x in got.collect()) == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert mtree.top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], schema), F.lit(True)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], schema)
    assert [tuple(x) for x in mtree.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, -65536)]


def test_bounds_spare_distances():
    r = np.random.default_rng(4)
    centres = r.integers(-2000, 2000, (40, 6))
    vectors = (centres[r.integers(0, 40, 6000)] + r.integers(-20, 20, (6000, 6))).astype(np.int64)
    b = mtree.Builder(np.arange(6000), vectors)
    b.build(np.arange(6000))
    tree = mtree.Tree.__new__(mtree.Tree)
    tree.norm, tree.computed = b.norm, 0
    tree.pages = {i: (p["leaf"], p["ids"], p["vectors"], p["radii"], p["to_parent"]) for i, p in enumerate(b.pages)}
    for q in vectors[:50]:
        scores = vectors @ q
        best = np.lexsort((np.arange(6000), -scores))[:5]
        assert tree.nearest(q, 5) == [(int(scores[i]), int(i)) for i in best]
    assert tree.computed < 50 * 6000 / 3
    assert max(len(p["ids"]) for p in b.pages if p["leaf"]) <= mtree.PAGE


def test_large_components_are_right_or_refused(spark):
    schema = "vec_id long, embedding array<double>"
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=4) * 1e6).tolist()) for i in range(300)]
    got = mtree.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 10 == 0, tree_vectors=100).collect()
    assert sorted(tuple(x) for x in got) == brute(rows, 5, 10) and max(x.score for x in got) > 2**56
    for huge in (9e8, 1e30):
        with pytest.raises(ValueError):
            mtree.top_k(spark.createDataFrame([*rows, (300, [huge] * 4)], schema), F.col("vec_id") == 0)


def test_queries_go_down_together():
    r = np.random.default_rng(6)
    vectors = r.integers(-256, 256, (3000, 16)).astype(np.int64)
    vectors[2900:] = vectors[0]  # copies: ties go to the smaller id
    b = mtree.Builder(np.arange(3000), vectors)
    b.build(np.arange(3000))
    tree = mtree.Tree.__new__(mtree.Tree)
    tree.norm, tree.computed = b.norm, 0
    tree.pages = {i: (p["leaf"], p["ids"], p["vectors"], p["radii"], p["to_parent"]) for i, p in enumerate(b.pages)}
    for scale in (1, 2**20):  # products as floats, and where they would not be exact as integers
        queries = vectors[::100] * scale
        scores, ids = tree.nearest_of_all(queries, 7)
        for q, s, i in zip(queries, scores, ids):
            all_ = vectors @ q
            best = np.lexsort((np.arange(3000), -all_))[:7]
            assert i.tolist() == best.tolist() and s.tolist() == all_[best].tolist()
