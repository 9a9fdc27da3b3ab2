import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import content as C
from mnemospark.operators import semantic as V

SCHEMA = "scope string, source_key string, source_hash string, text string"
WORDS = "index token shard merge query cache scan retry lease plan graph layer prune vector bucket stream file parse width depth".split()


def texts(n, scopes, seed=1):
    r = random.Random(seed)
    return [(f"s{k % scopes}", f"k{k}", f"h{k}", " ".join(r.choices(WORDS, k=r.choice([1, 3, 8, 40])))) for k in range(n)]


def brute(spark, rows, asked, limit, least):
    def vectors(pairs):
        out = {}
        for r in C.hashed_features(spark.createDataFrame(pairs, "id string, text string"), "id").collect():
            out.setdefault(r.id, {})[r.bucket] = r.value
        return out

    own, wanted = vectors([(f"{s}|{k}|{h}", t) for s, k, h, t in rows]), vectors(asked)
    found = set()
    for scope, _ in asked:
        hits = []
        for s, k, h, _ in rows:
            if s == scope:
                hits.append((-round(sum(v * wanted[scope].get(b, 0) for b, v in own[f"{s}|{k}|{h}"].items()), 9), k, h))
        found |= {(scope, k, h, n) for n, (x, k, h) in enumerate(sorted(x for x in hits if -x[0] >= least)[:limit])}
    return found


def answer(frame):
    return {(r.scope, r.source_key, r.source_hash, r.vector_order) for r in frame.collect()}


@pytest.mark.parametrize("limit, least", [(80, 0.1), (5, 0.1), (7, 0.6), (200, 0.001)])
def test_search_is_that_of_comparing_all(spark, tmp_path, limit, least):
    rows = texts(400, 4)
    index = V.Index(spark, str(tmp_path / "i"))
    index.sync(spark.createDataFrame(rows, SCHEMA), "entry")
    asked = [("s0", "prune the vector index"), ("s1", "lease retry"), ("s2", "nothing here"), ("s9", "no scope")]
    got = answer(index.search("entry", spark.createDataFrame(asked, "scope string, text string"), limit=limit, least=least))
    assert got == brute(spark, rows, asked, limit, least)
    with pytest.raises(ValueError):
        index.search("entry", spark.createDataFrame(asked, "scope string, text string"), least=0.0)


def test_runs_embed_only_what_is_new_or_changed(spark, tmp_path, monkeypatch):
    embedded = []
    real = V.embedded

    def counted(texts, key, model):
        embedded.append(texts.count())
        return real(texts, key, model)

    monkeypatch.setattr(V, "embedded", counted)
    index = V.Index(spark, str(tmp_path / "i"))
    rows = texts(60, 2)
    gate = lambda text: F.when(~F.contains(text, F.lit("secret")), text)
    run = lambda r, **kw: {x.scope: x for x in index.sync(spark.createDataFrame(r, SCHEMA), "entry", gate, **kw).collect()}
    first = run([*rows, rows[0], ("s0", "blank", "b", " \n"), ("s1", "p", "p", "a secret")])
    assert (first["s0"].indexed, first["s1"].indexed, first["s1"].private) == (30, 30, 1) and embedded == [60]
    changed = [(s, k, h + "x", t + " more") if k in ("k2", "k3") else (s, k, h, t) for s, k, h, t in rows if k != "k4"] + [("s2", "new", "n", "a new scope")]
    second = run(changed)
    assert (second["s0"].cached, second["s0"].indexed, second["s1"].indexed, second["s2"].indexed) == (28, 1, 1, 1) and embedded == [60, 3]
    assert index.live().count() == 60 and not any(second[s].beyond for s in second)
    asked = spark.createDataFrame([("s0", rows[2][3]), ("s1", "a secret")], "scope string, text string")
    keys = {(k, h) for _, k, h, _ in answer(index.search("entry", asked, gate=gate, least=0.01, limit=500))}
    assert ("k2", "h2x") in keys and ("k2", "h2") not in keys and not {k for k, _ in keys} & {"k4"}
    # a vector of another text is no hit
    stale = spark.createDataFrame([("s0", "k2", "elsewhere"), ("s0", "k6", "h6")], "scope string, source_key string, source_hash string")
    assert {k for _, k, _, _ in answer(index.search("entry", asked, stale, least=0.001))} <= {"k6"}
    # a scope with more sources than are taken keeps what it has; a part of the sources drops nothing
    third = run(changed, most=10)
    assert third["s0"].beyond == 19 and not third["s0"].fresh and index.live().count() == 60
    assert run(changed[:5], complete=False) and index.live().count() == 60
    assert V.Index(spark, str(tmp_path / "i"), V.Model(name="other")).search("entry", asked).count() == 0
    # a run that failed before its end counts for nothing
    spark.createDataFrame([("entry", "s0", "zz", "zz", 1, 1.0, index.model.profile, 0)], "kind string, scope string, source_key string, source_hash string, bucket long, value double, profile string, part int").write.partitionBy("part").parquet(str(tmp_path / "i" / "postings" / "run=99"))
    assert "zz" not in {k for _, k, _, _ in answer(index.search("entry", asked, least=0.001))}


def test_a_vector_is_a_row_and_counts_once(spark, tmp_path):
    rows, path = texts(40, 2), str(tmp_path / "i")
    index = V.Index(spark, path)
    asked = [("s0", rows[4][3]), ("s1", rows[5][3])]
    for some in (rows, rows[10:], rows):  # the first ten go and come back
        index.sync(spark.createDataFrame(some, SCHEMA), "entry")
    assert spark.read.parquet(f"{path}/vectors").count() == 50
    hits = index.search("entry", spark.createDataFrame(asked, "scope string, text string"))
    assert answer(hits) == brute(spark, rows, asked, 80, 0.1) and hits.agg(F.max("similarity")).first()[0] <= 1


def test_long_and_many_texts_are_hashed_in_parts(spark, monkeypatch):
    rows = [(k, " ".join(WORDS[(k * j) % 20] for j in range(k % 7 * 50))) for k in range(60)] + [(60, None), (61, "word " * 3000)]
    frame = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    monkeypatch.setattr(C, "WORDS", 100)
    vectors = {r.id: dict(zip(r.buckets, r["values"])) for r in C.hashed_vectors(frame, "id").collect()}
    cells = {}
    for r in C.hashed_features(frame, "id").where("value != 0").collect():
        cells.setdefault(r.id, {})[r.bucket] = r.value
    assert vectors.keys() == cells.keys() and all(vectors[k] == pytest.approx(cells[k]) for k in cells)
