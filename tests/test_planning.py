"""The planner and project evidence against versions in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import planning as G
from mnemospark.operators import policies as P
from mnemospark.operators import project as K


def brute_groups(rows):
    """Message index -> group, kind of each group, and complete calls; rows of one session in order."""
    drafts, kinds, state = [], [], None
    for r in rows:
        if r["isolated"] or r["role"] in G.SUMMARY_ROLES:
            kinds.append("turn" if r["isolated"] else "summary")
            state = None
        elif r["role"] == "user":
            kinds.append("turn")
            state = "open"
        elif state is None:
            kinds.append("prefix")
            state = "open"
        drafts.append(len(kinds) - 1)
    parent = list(range(len(kinds)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    last, pairs = {}, []
    for i, r in enumerate(rows):
        if r["result_of"] is not None:
            pairs.append((r["result_of"], last.get(r["result_of"]), i))
        for c in r["calls"]:
            last[c] = i
    for _, c, i in pairs:
        if c is not None:
            a, b = find(drafts[c]), find(drafts[i])
            parent[max(a, b)] = min(a, b)
    group = [find(d) for d in drafts]
    kind = {}
    for g in set(group):
        own = {kinds[d] for d in set(drafts) if find(d) == g}
        kind[g] = "turn" if "turn" in own else "summary" if own == {"summary"} else "prefix"
    return group, kind, pairs


def brute_plan(messages, supplements, limits):
    users = [i for i, m in enumerate(messages) if m["role"] == "user"]
    extra = sorted(supplements, key=lambda s: s["id"]) if users else []
    rows = [dict(m, isolated=False, id=None) for m in messages]
    if users:
        prefix = [s for s in extra if limits.placement == "stable-prefix" or (limits.placement == "hybrid" and s["category"] != "retrieval")]
        lead = next(i for i, m in enumerate(messages) if m["role"] not in ("system", "developer"))
        put = lambda own: [dict(s, role="user", calls=[], result_of=None, pinned=False, isolated=True) for s in own]
        rows[users[-1] : users[-1]] = put([s for s in extra if s not in prefix])
        rows[min(lead, users[-1]) : min(lead, users[-1])] = put(prefix)
    last_user = max((i for i, r in enumerate(rows) if r["role"] == "user" and not r["isolated"]), default=None)
    group, kind, pairs = brute_groups(rows)
    members = {g: [i for i, x in enumerate(group) if x == g] for g in set(group)}
    tokens = {g: sum(rows[i]["tokens"] for i in m) for g, m in members.items()}
    supplement = {g: rows[m[0]] for g, m in members.items() if rows[m[0]]["isolated"]}
    ends = {g: max(m) for g, m in members.items()}
    current = {g for g in members if (ends[g] >= last_user if last_user is not None else ends[g] == max(ends.values()))}
    must = current | {g for g, m in members.items() if g not in supplement and any(rows[i]["pinned"] for i in m)} | {g for g, s in supplement.items() if s["category"] == "pin"}
    hard, target = max(0, limits.hard - limits.fixed), max(0, limits.target - limits.fixed)
    used = sum(tokens[g] for g in must)
    why = "fixed-too-large" if limits.fixed > limits.hard else "pins-too-large" if sum(tokens[g] for g in must - current) > limits.pinned else "mandatory-too-large" if used > hard else None
    chosen, tail = set(must), sum(tokens[g] for g in current)
    turns = sorted((g for g in members if kind[g] == "turn" and g not in must and g not in supplement), key=lambda g: -ends[g])
    for k, g in enumerate(turns):
        in_window = used + tokens[g] <= target and used + tokens[g] <= hard
        if in_window and tail + tokens[g] <= limits.tail:
            chosen.add(g)
            used, tail = used + tokens[g], tail + tokens[g]
            continue
        if k == 0 and in_window and limits.rescue and limits.tail > 0:
            chosen.add(g)
            used += tokens[g]
        break
    spent = dict.fromkeys(G.CATEGORIES, 0)
    rank = lambda s: s["promoted"] if s.get("promoted") is not None else 2**31
    rest = [(0, rank(s), G.CATEGORIES.index(s["category"]), -s["score"], -ends[g], g) for g, s in supplement.items() if s["category"] != "pin" and g not in must]
    rest += [(1, 0, 3, 0, -ends[g], g) for g in members if kind[g] == "summary" and g not in must]
    for _, _, c, _, _, g in sorted(rest):
        name = G.CATEGORIES[c]
        if spent[name] + tokens[g] <= getattr(limits, name) and used + tokens[g] <= target and used + tokens[g] <= hard:
            chosen.add(g)
            used += tokens[g]
            spent[name] += tokens[g]
    picked = {i for g in chosen for i in members[g]}
    results = {}
    for c, at, i in pairs:
        results.setdefault((c, at), []).append(i)
    for i, r in enumerate(rows):
        for c in r["calls"]:
            own = results.get((c, i), [])
            if (i in picked and (not own or any(x not in picked for x in own))) or (i not in picked and any(x in picked for x in own)):
                why = why or "parted-exchange"
    if any(at is None and any(i in picked for i in own) for (_, at), own in results.items()):
        why = why or "parted-exchange"
    return {((None if r["isolated"] else sum(not x["isolated"] for x in rows[:i])), r["id"]): (not r["isolated"]) if why else i in picked for i, r in enumerate(rows)}, why


@pytest.mark.parametrize("limits", [G.Limits(), G.Limits(placement="stable-prefix", target=300), G.Limits(placement="hybrid", target=250, project=120), G.Limits(hard=500, target=400, fixed=20, tail=90, pinned=80), G.Limits(tail=40, rescue=True), G.Limits(tail=40, rescue=False, summary=20), G.Limits(fixed=2000)])
def test_plans_against_plain_python(spark, limits):
    r = random.Random(5)
    messages, supplements = [], []
    for s in range(40):
        n = r.randint(1, 14)
        for i in range(n):
            calls = [f"c{r.randint(0, 2)}"] if r.random() < 0.25 else []
            messages.append({"session": s, "index": i, "role": r.choice(["user", "user", "assistant", "assistant", "toolResult", "branchSummary", "system"]) if s != 3 else "assistant", "tokens": r.choice([5, 20, 60, 150]), "calls": calls, "result_of": None if calls or r.random() < 0.75 else f"c{r.randint(0, 2)}", "pinned": r.random() < 0.06})
        supplements += [{"session": s, "id": f"x{k}", "category": r.choice(["pin", "memory", "retrieval", "project", "project"]), "score": float(r.choice([1, 2, 2, 3])), "promoted": r.choice([None, None, None, 1, 2]) if s % 3 else None, "tokens": r.choice([10, 40, 120])} for k in range(r.randint(0, 6))]
    m = spark.createDataFrame([tuple(x.values()) for x in messages], "session int, index int, role string, tokens long, calls array<string>, result_of string, pinned boolean")
    x = spark.createDataFrame([tuple(x.values()) for x in supplements], "session int, id string, category string, score double, promoted int, tokens long")
    got, reasons = {}, {}
    for row in G.managed_plan(m, x, limits).collect():
        got.setdefault(row.session, {})[row["index"], row.supplement] = row.selected
        reasons[row.session] = row.why
    for s in range(40):
        want, why = brute_plan([y for y in messages if y["session"] == s], [y for y in supplements if y["session"] == s], limits)
        assert (reasons[s] is None) == (why is None) and got[s] == want, s


def test_evidence_leaves_out_what_is_said_already(spark):
    snippets = [
        ("p", "a.py", "1", 1, 80, "alpha beta needle", ["Run"], "Run", "m.Run", 100, False, True), ("p", "a.py", "2", 60, 120, "needle again", ["Go"], "Go", None, 100, False, True), ("p", "b.py", "3", 1, 10, "Alpha  beta NEEDLE", ["Run"], "Run", None, 100, True, True),
        ("p", "c.py", "4", 1, 10, "needle in c", [], None, None, 900, False, False), ("p", "d.py", "5", 1, 10, "other", [], None, None, 10, False, True), ("q", "a.py", "6", 1, 10, "needle", [], None, None, 10, False, True),
    ]
    rows = spark.createDataFrame(snippets, "project string, path string, snippet_id string, start_line int, end_line int, content string, declared array<string>, symbol_name string, qualified_name string, tokens long, modified boolean, tracked boolean")
    asked = spark.createDataFrame([(1, "p", ["A.py"], ["run"], ["alpha beta"], ["A.py", "run", "needle", "alpha beta"])], "request long, project string, files array<string>, symbols array<string>, phrases array<string>, exact array<string>")
    fts = spark.createDataFrame([(1, "5", 0), (1, "1", 1)], "request long, snippet_id string, fts_order int")
    got = K.evidence(rows, asked, fts, most=4, budget=500).orderBy("place").collect()
    # 2 overlaps 1 over lines with a common exact term, 3 says what 1 says, 4 is too large
    assert [r.snippet_id for r in got] == ["1", "5"]
    assert got[0].score == pytest.approx(180 + 170 + 90 + 45 + 59.5 + 3 - 100 / 800) and got[1].score == pytest.approx(60 + 3 - 10 / 800)
    vectors = spark.createDataFrame([(1, "2", 0, 0.9)], "request long, snippet_id string, vector_order int, similarity double")
    fused = K.evidence(rows, asked, fts, vectors, most=4, budget=500).collect()
    assert {r.snippet_id for r in fused} <= {"1", "2", "5"}


def test_relevant_lines_and_edit_reports(spark):
    text = "fine\nERROR: one failed in src/a.ts\nmore\nWarning: x\nwarnings are no match\n" + "y" * 400 + " fatal " + "z" * 900 + "\nERROR: one failed in src/a.ts\n(/etc/passwd), C:\\dir\\f"
    r = spark.createDataFrame([(text,), (None,)], "t string").select(P.relevant(F.col("t")).alias("r")).collect()
    assert r[0].r.errors[:2] == ["ERROR: one failed in src/a.ts", "Warning: x"] and len(r[0].r.errors) == 3 and r[0].r.errors[2].startswith("y" * 200) and len(r[0].r.errors[2]) == 800
    assert r[0].r.paths == ["src/a.ts", "/etc/passwd", "C:\\dir\\f"] and r[1].r.errors == []
    patch = "--- a\n+++ b\n@@ -1,3 +1,4 @@\n x\n-old\n+new\n+more\n y\n@@ -10,0 +12,1 @@\n+tail\n"
    report = spark.createDataFrame([(patch,), ("",)], "t string").select(P.edit_report(F.col("t")).alias("r")).collect()
    assert (report[0].r.line_delta, report[0].r.regions, report[0].r.truncated) == (2, 2, False) and report[1].r.regions == 0
    assert '"old_start": 2, "old_count": 1, "new_start": 2, "new_count": 2, "delta": 1, "shift": 1' in report[0].r.shown and '"old_start": 11, "old_count": 0, "new_start": 12' in report[0].r.shown


def test_models_are_checked_when_loaded(spark, tmp_path):
    from mnemospark.operators import evaluation as V

    model = spark.createDataFrame([("bias", 0.5), ("recency", -1.25)], "feature string, weight double")
    digest = V.save_model(spark, model, str(tmp_path))
    assert sorted(map(tuple, V.load_model(spark, str(tmp_path), digest).collect())) == [("bias", 0.5), ("recency", -1.25)]
    assert V.load_model(spark, str(tmp_path), "0" * 64) is None


def test_large_results_in_few_words(spark):
    text = "start " + "x" * 5000 + "\nError: disk full at /var/log/a.txt\n" + "y" * 5000 + ' password = "hunter2222" end'
    rows = spark.createDataFrame([(text,), ("ok\0" * 9000,), ("short",)], "t string")
    got = [r.r for r in rows.select(P.condensed_output(F.lit('a"b'), F.lit("c1"), F.col("t"), F.lit(True), F.lit("s" * 64), 3000, 900).alias("r")).collect()]
    assert 'Tool: "a\\"b"' in got[0] and "Status: error" in got[0] and 'Paths: "/var/log/a.txt"' in got[0] and 'Errors/warnings: "Error: disk full at /var/log/a.txt"' in got[0]
    assert 'Head: "start xxx' in got[0] and "hunter2222" not in got[0] and "[REDACTED]" in got[0] and len(got[0]) <= 3000 and got[0].endswith("[END LARGE TOOL OUTPUT]")
    assert "Binary output" in got[1] and "Head" not in got[1] and 'Head: "short"' in got[2] and "Tail" not in got[2]


def test_a_request_is_a_beginning_of_the_next_one(spark):
    def plan(n, evidence, **kw):
        roles = ["system", "user", "assistant", "user", "assistant", "user"][:n]
        messages = spark.createDataFrame([(1, i, role, 10, [], None, False) for i, role in enumerate(roles)], "session int, index int, role string, tokens long, calls array<string>, result_of string, pinned boolean")
        extra = [("a", "pin", 1.0, 5), ("b", "memory", 1.0, 5), ("c", "project", 1.0, 5), (evidence, "retrieval", 1.0, 5)]
        rows = G.managed_plan(messages, spark.createDataFrame([(1, *x) for x in extra], "session int, id string, category string, score double, tokens long"), G.Limits(**kw)).where("selected").orderBy("position").collect()
        return [r.supplement or r["index"] for r in rows]

    assert plan(4, "e1", placement="stable-prefix") == ["a", "b", "c", "e1", 1, 2, 3]
    assert plan(4, "e1", placement="hybrid") == ["a", "b", "c", 1, 2, "e1", 3] and plan(6, "e2", placement="hybrid")[:5] == ["a", "b", "c", 1, 2]
    assert plan(4, "e1") == [1, 2, "a", "b", "c", "e1", 3]
    with pytest.raises(ValueError):
        plan(4, "e1", placement="elsewhere")


def test_of_a_patch_only_headers_and_marks_go_to_python(spark):
    patch = "--- a\n+++ b\n@@ -1,3 +1,4 @@ def f(): " + "c" * 500 + "\n x\n\n-" + "o" * 5000 + "\n+\U0001f600n\r\n\u2028y\n+@@ -1 +1 @@\n@@ -\u0669,0 +2 @@\n+z"
    rows = spark.createDataFrame([(patch,), (None,)], "t string")
    assert [r.m for r in rows.select(P.patch_marks(F.col("t")).alias("m")).collect()] == ["-\n+\n@@ -1,3 +1,4 @@\n \n\n-\n+\n\u2028\n+\n@@ -\u0669,0 +2 @@\n+", None]
    r = rows.select(P.edit_report(F.col("t")).alias("r")).first().r
    assert (r.line_delta, r.regions) == (2, 2) and '"old_start": 10, "old_count": 0, "new_start": 2' in r.shown


def test_texts_become_strings_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(P, "TEXT_BYTES", 40)
    texts = [None, "", "a fatal é src/a.ts", "x" * 100 + "\nerror in /b/c", *[f"line {k}\nwarning {k}: /p/{k}" for k in range(7)], None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = {r.k: (r.r.errors, r.r.paths) for r in rows.select("k", P.relevant(F.col("t")).alias("r")).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == got[11] == ([], [])
    assert got[2] == (["a fatal é src/a.ts"], ["src/a.ts"]) and got[3] == (["error in /b/c"], ["/b/c"])
    assert all(got[4 + k] == ([f"warning {k}: /p/{k}"], [f"/p/{k}"]) for k in range(7))
