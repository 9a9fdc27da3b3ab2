"""Queries on tables that are longer than what the given ones hold."""

from mnemospark import catalogue
from mnemospark.operators import content


def run(spark, folder, name, **tables):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return catalogue.queries()[name](spark, str(folder)).collect()


def test_weighted_bm25_takes_the_whole_passage(spark, tmp_path):
    passage = " ".join(f"early{k}" for k in range(12)) + " later words alone"
    docs = [(1, "nothing of it", "s", "en"), (2, "later words", "s", "en"), (3, "words here and there", "s", "en")]
    got = run(spark, tmp_path, "weighted_bm25", benchmark=([(7, passage)], "item_id long, text string"), documents=(docs, "doc_id long, text string, source string, lang string"))
    assert [(r.item_id, r.doc_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(7, 2, 0), (7, 3, 1)]


def test_line_chunks_reach_the_end_of_long_documents(spark, tmp_path):
    n = 5003
    long, gap = "\n".join(f"line {k}" for k in range(n)), "first" + "\n" * 3000 + "last"
    got = run(spark, tmp_path, "line_chunks", documents=([(1, long), (2, gap), (3, " \n")], "doc_id long, text string"))
    spans = sorted((r.start_line, r.end_line) for r in got if r.doc_id == 1)
    assert spans == [(k * 6 + 1, min(n, k * 6 + 8)) for k in range(-(-(n - 8) // 6) + 1)] and spans[-1][1] == n
    assert sorted(r.end_line for r in got if r.doc_id == 2) == [8, 3001] and not any(r.doc_id == 3 for r in got)
    capped = content.line_chunks(spark.createDataFrame([(1, long), (2, gap)], "doc_id long, text string"), ["doc_id"], 8, 2, most=2).collect()
    assert sorted((r.doc_id, r.end_line) for r in capped) == [(1, 8), (1, 14), (2, 8), (2, 3001)]
