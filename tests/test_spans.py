import pytest
from pyspark.sql import functions as F

from mnemospark.operators import spans as S


def run(spark, values, sources, budget=S.BUDGET):
    frame = spark.createDataFrame([(1, " ".join(f"`{v}`" for v in values), sources)], "id int, summary string, sources array<string>")
    return S.reports(frame, ["id"], budget).first()


CASES = {
    'a\\"b\\"c': "unescaped-form-present", "two  spaces here": "whitespace-collapsed-present", "CAMEL case": "case-variant-present", "it’s typographic": "typographic-variant-present",
    "single-deXletion": "single-deletion-present", "first part--last part": "composed-two-present-parts", "near part//here": "composed-adjacent-present", "nothing of this": "no-near-miss",
    "x" * 97: "not-classified-length", "short": "no-near-miss",
}
EVIDENCE = ['a"b"c two spaces here camel case it\'s typographic', "single-deletion and first part, then the last part; near part: here", ""]


def test_each_relation(spark):
    got = run(spark, [*CASES, "camel case", "short"], EVIDENCE)
    assert {v.value: list(v.relations) for v in got["values"]} == {k: [v] for k, v in CASES.items()}
    assert len(got.spans) == len(CASES) + 1 and got.complete and 0 < got.used < S.BUDGET


def slow(values, sources, budget):
    """Lookup by lookup, as a shared budget is spent."""
    sources = [s for s in sources if s]
    left, out = budget, False

    def has(x):
        nonlocal left, out
        if out or not sources:
            out = True
            return False
        left -= len(sources)
        if left < 0:
            out = True
            return False
        return any(x in s for s in sources)

    found = {}
    for v in values:
        seen = []
        if not out:
            for name, form in (("whitespace-collapsed-present", " ".join(v.split())), ("case-variant-present", v.lower()), ("case-variant-present", v.upper()), ("typographic-variant-present", v.replace("’", "'"))):
                if form != v and name not in seen and has(form):
                    seen.append(name)
        if out:
            seen.append("not-classified-budget")
        found[v] = seen
    pending = sum(not x for x in found.values())
    for v in values:
        if found[v]:
            continue
        rest = 0 if out else max(0, left) // len(sources)
        share = min(rest, max(32, rest // pending))
        pending -= 1
        if len(v) > 96:
            found[v] = ["not-classified-length"]
            continue
        if out or share <= 0:
            found[v] = ["not-classified-budget"]
            continue
        spent, hit = 0, None
        steps = [v[:i] + v[i + 1 :] for i in range(len(v))] if len(v) >= 8 else []
        for s in steps:
            if spent == share:
                break
            spent += 1
            if has(s):
                hit = "single-deletion-present"
                break
        if hit is None and spent < share and len(v) >= 8:
            ends = []
            for cut in (lambda k: v[:k], lambda k: v[len(v) - k :]):
                lengths = set()
                for k in range(4, len(v) - 3):
                    if spent == share:
                        break
                    spent += 1
                    if has(cut(k)):
                        lengths.add(k)
                ends.append(lengths)
                if not lengths:
                    break
        found[v] = [hit or ("not-classified-partial" if spent >= share else "no-near-miss")]
    return found, left


@pytest.mark.parametrize("budget", [1, 7, 20, 60, 75, 130, 400, 24_000])
def test_the_budget_ends_the_analysis_where_lookups_end(spark, budget):
    values = ["CAMEL case", "completely other", "single-deXletion", "also not there at all", "it’s typographic", "qqqq wwww"]
    got = run(spark, values, ["camel case it's typographic", "single-deletion"], budget)
    want, left = slow(values, ["camel case it's typographic", "single-deletion"], budget)
    assert {v.value: list(v.relations) for v in got["values"]} == want
    assert got.used == min(budget, budget - max(0, left)) and got.complete == (not any(x[0][:14] == "not-classified" and x != ["not-classified-length"] for x in want.values()))


def test_shapes_and_lengths(spark):
    frame = spark.createDataFrame([("C:\\a b=1,000 --x/“q”", ), ('{"k":1}',), ("plain",)], "v string")
    got = [list(r.s) for r in frame.select(S.shapes(F.col("v")).alias("s")).collect()]
    assert got[0] == ["space", "backslash", "colon", "equals", "double-dash", "slash", "typographic-char", "digit-group-separator"]
    assert got[1] == ["colon", "quote", "json-punctuation"] and got[2] == []
