import corpus_pipeline
from mnemospark.llm import ordinal
from tests.llm.helpers import SF
from tests.llm.test_near_dedup import brute
from tests.llm.test_secrets import spans_of
from tests.llm.test_tokens import check_sequences, crc, library


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = ordinal.train(docs, ordinal.graded(spark.read.parquet(f"{SF}/labels.parquet")))
    marks = {r.doc_id: r.kept for r in ordinal.classify(docs, model).collect()}
    first = corpus_pipeline.quality(spark, docs, SF)
    assert first.columns == docs.columns
    rows = [r for r in rows if marks[r["doc_id"]]]
    assert sorted(r.doc_id for r in first.collect()) == sorted(r["doc_id"] for r in rows)

    second = corpus_pipeline.near_duplicates(spark, first, SF)
    assert second.columns == docs.columns
    stays, seen = [], set()
    for r, (doc, n, component) in zip(rows, brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)):
        if not n or (doc == component and component not in seen):
            stays.append(r)
            seen.add(component)
    assert sorted(r.doc_id for r in second.collect()) == sorted(r["doc_id"] for r in stays) and len(stays) < len(rows)

    third = corpus_pipeline.secret_scan(spark, second, SF)
    assert third.columns == docs.columns
    for r in stays:
        out, at = [], 0
        for a, _, b in spans_of(r["text"])[1]:
            if a >= at:
                out += [r["text"][at:a], "[SECRET]"]
            at = max(at, b)
        r["text"] = "".join(out) + r["text"][at:]
    masked = {r.doc_id: r.text for r in third.collect()}
    assert masked == {r["doc_id"]: r["text"] for r in stays}

    encode = library("byte_bpe_50k.json")
    want = []
    for r in stays:
        ids = [*encode(r["text"]), 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(r["doc_id"], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    packed = corpus_pipeline.best_fit(spark, third, SF).collect()
    assert sorted(tuple(r)[:5] for r in packed) == sorted(want)
    check_sequences(packed, 1024)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(tuple(r)[:5] for r in whole.collect()) == sorted(want)


def test_stages_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secret_scan", "best_fit"]
