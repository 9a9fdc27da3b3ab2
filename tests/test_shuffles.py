"""How much is shuffled, where that has a bound."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import history as H
from mnemospark.operators import project as K
from mnemospark.storage import materialize


def written(spark) -> tuple[int, int]:
    """Rows and bytes that were written to shuffles so far."""
    sc, jvm = spark.sparkContext, spark._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    found = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteRecords() for s in found), sum(s.shuffleWriteBytes() for s in found)


@pytest.fixture
def narrow(spark):
    """Broadcasts of 16 KB at most."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_candidate_meets_the_terms_that_it_has(spark, narrow):
    draw = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(draw.sample([f"w{j}" for j in range(80)], 3))) for k in range(4000)], "doc_id long, text string")
    wanted = spark.createDataFrame([(r, f"w{j}") for r in range(8) for j in range(r, r + 60)], "item_id long, term string")
    rows, _ = written(spark)
    got = H.weighted_search(docs, "doc_id", {"text": (F.col("text"), 1.0)}, wanted, "item_id", 3).collect()
    assert len(got) == 24
    # 8 requests x 4,000 candidates x 60 terms are 1,920,000
    assert written(spark)[0] - rows < 200_000


def test_snippets_are_not_shuffled_to_meet_what_was_found(spark, narrow):
    draw = random.Random(5)
    rows = [("pq"[k % 2], f"en/d{k}.py", str(k), 1, 10, f"needle{k % 300} {draw.randbytes(700).hex()}", ["Run"], "Run", "m.Run", 100, k % 3 == 0, True) for k in range(4500)]
    rows = materialize(spark.createDataFrame(rows, "project string, path string, snippet_id string, start_line int, end_line int, content string, declared array<string>, symbol_name string, qualified_name string, tokens long, modified boolean, tracked boolean"), "rows")
    asked = spark.createDataFrame([(k + 1, p, ["D7.py"], ["run"], [], ["needle5 ", "needle7 "]) for k, p in enumerate("pq")], "request long, project string, files array<string>, symbols array<string>, phrases array<string>, exact array<string>")
    fts = spark.createDataFrame([(1, "2", 0), (2, "3", 0)], "request long, snippet_id string, fts_order int")
    _, size = written(spark)
    assert {r.request for r in K.evidence(rows, asked, fts).collect()} == {1, 2}
    # the snippets are 6 MB; what the channels bring of them, at most 48 a term, is shuffled some times
    assert written(spark)[1] - size < 3_000_000
