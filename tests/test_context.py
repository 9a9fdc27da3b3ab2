import json

from pyspark.sql import functions as F

from mnemospark.operators import context as X
from mnemospark.operators import history as H
from mnemospark.operators import privacy as P
from tests.conftest import SF


def brute_plan(entries, evidence, window, tail):
    """One session's plan: entries in order, retrieved (entry_id, tokens) in order."""
    turns, n = {}, 0
    for e in entries:
        n += e.role == "user"
        turns.setdefault(n, []).append(e)
    current, out = max(turns), {}
    spent = sum(e.tokens for e in turns[current])
    out |= {e.entry_id: "current" for e in turns[current]}
    older, taken = 0, spent
    for k in sorted((k for k in turns if k < current), reverse=True):
        cost = sum(e.tokens for e in turns[k])
        older, spent = older + cost, spent + cost
        if older > tail or spent > window:
            break
        out |= {e.entry_id: "recent" for e in turns[k]}
        taken = spent
    rest, used = max(0, window - taken), 0
    for entry_id, tokens in [x for x in evidence if x[0] not in out][:24]:
        if used + tokens <= rest:
            out[entry_id], used = "retrieved", used + tokens
    return out


def test_plans_against_brute_force(spark):
    found = H.entries(spark.read.parquet(f"{SF}/conversations.parquet"))
    evidence, sessions = {}, {}
    for r in H.hybrid(found, H.Retrieval(max_tokens=400)).orderBy("session_id", "place").collect():
        evidence.setdefault(r.session_id, []).append((r.entry_id, r.tokens))
    for r in found.orderBy("session_id", "created_at").collect():
        sessions.setdefault(r.session_id, []).append(r)
    for window, tail in ((1200, 500), (300, 100), (5000, 0)):
        got = {}
        for r in X.plan(found, window, tail).collect():
            got.setdefault(r.session_id, {})[r.entry_id] = r.reason
        assert got == {s: brute_plan(e, evidence.get(s, []), window, tail) for s, e in sessions.items()}


def test_segments_open_where_a_group_no_longer_fits(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 5, 5, 20, 1, 1])] + [(2, 0, 3)], "s int, turn long, tokens long")
    got = {(r.s, r.turn): r.segment for r in X.segments(rows, "s", "turn", 10).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (1, 5): 3, (2, 0): 0}


def test_marks_and_policy(spark):
    rows = spark.createDataFrame([("[ctx:internal]a[/ctx:internal] [CTX:local-only]",), ("[ctx:what] \\\\[ctx:sensitive]".replace("\\\\", "\\"),), (None,)], "t string").select(P.marked_class(F.col("t")).alias("c"))
    assert [r.c for r in rows.collect()] == ["local-only", None, None]
    seen = spark.createDataFrame([("sensitive", True), ("sensitive", False), (None, True)], "c string, remote boolean").select(X.may_see(F.col("c"), F.col("remote")).alias("ok"))
    assert [r.ok for r in seen.collect()] == [False, True, True]


def test_classes_of_nested_values(spark):
    deep = "x"
    for _ in range(70):
        deep = [deep]
    quoted = json.dumps({"schema": P.RESULT_SCHEMA, "quotedData": True, "text": "[ctx:sensitive]a[/ctx:sensitive]"})
    cases = [
        ({"a": ["[ctx:internal] b"]}, "internal"), ({"classification": "sensitive", "b": "[ctx:internal]"}, "sensitive"), (deep, "local-only"), ([quoted], "sensitive"), ({"schema": P.RESULT_SCHEMA}, "local-only"), ({"a": 1}, None),
        (["y"] * 10_001, "local-only"),
    ]
    frame = spark.createDataFrame([(json.dumps(v), c) for v, c in cases] + [("no json [ctx:internal]", "internal"), (None, None)], "v string, c string")
    assert [(r.got, r.c) for r in frame.select(P.history_class(F.col("v")).alias("got"), "c").collect() if r.got != r.c] == []


def test_payloads_are_cleaned_below_content_keys(spark):
    payload = {"model": "[x]", "messages": [{"role": "user", "content": "a [ctx:sensitive]hidden[/ctx:sensitive] password=hunter22"}, {"role": "[ctx:sensitive]r[/ctx:sensitive]", "text": "[ctx:local-only] all"}], "other": "password=hunter22"}
    frame = spark.createDataFrame([(json.dumps(payload),), (None,)], "v string")
    r, none = [x.s for x in frame.select(P.sanitized_json(F.col("v"), ["normal", "internal"], True).alias("s")).collect()]
    got = json.loads(r.value)
    assert got["model"] == "[x]" and got["other"] == "password=hunter22" and none.value is None
    assert got["messages"][0] == {"role": "user", "content": "a [sensitive content excluded by privacy policy] password=[REDACTED SECRET]"}
    assert got["messages"][1] == {"role": "[sensitive content excluded by privacy policy]", "text": "[local-only content excluded by privacy policy]"}
    assert (r.classification, r.blocked, r.redactions) == ("local-only", 3, 1)


def test_values_of_a_request_are_looked_for_once(spark):
    from mnemospark.operators.context import unique_first

    out = spark.createDataFrame([("a, B,b ,,A,c",), (None,)], "v string").select(unique_first(F.split("v", ","), 2).alias("x"))
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert [r.x for r in out.collect()] == [["a", "B"], None]
