import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from mnemospark.llm import divergence
from tests.llm.helpers import ODD, SF

SCHEMA = "doc_id long, text string, lang string, source string, value string, number string, seat string"


def brute(rows, min_docs=30, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s], "term": [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def answer(frame):
    return sorted(tuple(x[c] for c in ("lang", "source", "part", "item", "value", "rank")) for x in frame.collect())


def test_odd_rows_in_many_chunks_seats_and_rounds(spark):
    r = np.random.default_rng(2)
    stock = [f"{a}{b}" for a in ("ab", "Été", "ß", "日本", "x'y", "Zz9q", "é", "ﬀ") for b in "abcdefghij"]
    rows = [(t, lang, source) for t in ODD for lang, source in (("en", "s1"), (None, "s2"), ("en", None))]
    rows += [(" ".join(r.choice(stock, r.integers(0, 60))), str(r.choice(["en", "de", ""])), f"s{min(int(r.integers(0, 14)), int(r.integers(0, 14)))}") for _ in range(1500)]
    rows += [("only few words here", "xx", f"s{i}") for i in range(5)] + [("word " * 500_000, "en", "s1")]
    frame = spark.createDataFrame([(i, *x, "x", "y", "z") for i, x in enumerate(rows)], SCHEMA)
    want = brute(rows)
    assert {x[0] for x in want} == {"", "en", "de", "xx"} and max(x[5] for x in want if x[2] == "term") == 50
    for sizes in ((16_384, 16), (9, 1), (20, 4)):
        assert answer(divergence.divergence(frame, chunk=sizes[0], seat=sizes[1])) == want
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None, None, None, "", "", ""), (2, "a", "", "s", "", "", "")], SCHEMA)
    assert answer(divergence.divergence(nothing)) == [("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)]


def test_sql_says_the_same():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rows = con.execute("select text, lang, source from documents").fetchall()
    assert sorted(con.execute(divergence.oracle()).fetchall()) == brute(rows)


def test_shares_are_exact():
    for whole in (7, 10**9 + 7, 9 * 10**15):
        x = np.array([0, 1, 2, whole // 3, whole - 1, whole], np.int64)
        assert divergence.shares(x, whole).tolist() == [1 + 10**9 * int(v) // whole for v in x]
