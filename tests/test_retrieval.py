"""Historical retrieval against a version in plain Python."""

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import content as C
from mnemospark.operators import context as X
from mnemospark.operators import history as H
from mnemospark.operators import retrieval as R
from mnemospark.operators import semantic
from mnemospark.operators.semantic import Index

TEXTS = [
    ("user", "Please look at src/app.ts and the parseConfig function"), ("assistant", "parseConfig lives in src/app.ts; it throws ERR_FOO on empty input " * 12), ("user", "what about the cache of sessions"),
    ("assistant", "The session cache is rebuilt when the index changes"), ("toolResult", "ERR_FOO: parseConfig failed in src/app.ts"), ("assistant", "the session  cache is rebuilt when the index changes"), ("user", "entirely different words about weather"),
    ("assistant", "naïve Índex of the caché"), ("user", "caching of sessions in parseConfig ERR_FOO 'session cache is rebuilt' in `src/app.ts`"),
]


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower()


def words(text):
    return re.findall("[a-z0-9]+", plain(text))


def brute(entries, d, vectors, how):
    """entries: dicts before the request; d: its description; vectors: {entry: similarity}."""
    limit = max(how.max_results, min(100, 6 * how.max_results))
    newest = sorted(entries, key=lambda e: (e["at"], e["id"]), reverse=True)
    exact, phrase, order = {}, {}, []
    for literals, into in ((d["identifiers"], exact), (d["phrases"], phrase)):
        for t in literals:
            for e in [e for e in newest if t in e["text"]][:limit]:
                into.setdefault(e["id"], []).append(t)
                order.append(e["id"])
    terms = {w for t in d["terms"][:16] for w in words(t)}
    n, avg = len(entries), sum(len(words(e["text"])) for e in entries) / len(entries)
    df = {w: sum(w in words(e["text"]) for e in entries) for w in terms}
    bm = {}
    for e in entries:
        own = words(e["text"])
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / avg)) for w in terms if w in own)
        if any(w in own for w in terms):
            bm[e["id"]] = round(s, 6)
    by = {e["id"]: e for e in entries}
    fts = {i: k for k, i in enumerate(sorted(bm, key=lambda i: (-bm[i], -by[i]["at"], i))[:limit])}
    order = list(dict.fromkeys([*order, *fts]))
    lexical = {i: k for k, i in enumerate(order)}
    near = {i: k for k, i in enumerate(sorted((i for i in vectors if vectors[i] >= 0.1), key=lambda i: (-vectors[i], i))[: how.similar])}
    out = []
    pool = [i for i in dict.fromkeys([*order, *near])]
    hit = {i: [t for t in d["terms"] if re.search(r"(?:^|[^\w])" + re.escape(plain(t)) + r"(?=$|[^\w])", plain(by[i]["text"]))] if i in fts else [] for i in pool}
    pool = [i for i in pool if i in exact or i in phrase or hit[i] or i in near]
    times = [by[i]["at"] for i in pool]
    for i in pool:
        e, s = by[i], 15 + {"user": 8, "assistant": 5, "toolResult": 4}.get(by[i]["role"], 1)
        s += 100 + min(12, 3 * (len(exact[i]) - 1)) if i in exact else 0
        s += 85 + min(8, 2 * (len(phrase[i]) - 1)) if i in phrase else 0
        s += 60 + max(0, 10 - fts[i]) + 40 * min(2, len(hit[i]) - 1) if hit[i] else 0
        if i in near:
            fused = math.floor((1 / (61 + near[i]) + (1 / (61 + lexical[i]) if i in lexical else 0)) * 1e9 + 0.5) / 1e9
            s += max(0, vectors[i]) * 80 + fused * 1500
        s += 12 * sum(t in e["text"] for t in d["files"]) + 10 * sum(t in e["text"] for t in d["symbols"]) + 12 * sum(t in e["text"] for t in d["errors"])
        s += 8 * (e["at"] - min(times)) / (max(times) - min(times)) if max(times) > min(times) else 0
        s -= min(12, e["tokens"] / 1000)
        out.append((2 if i in exact else 1 if i in phrase else 0, s, e["at"], i))
    return sorted(out, key=lambda r: (-r[0], -round(r[1], 6), -r[2], r[3]))


@pytest.mark.parametrize("how, stored", [(R.Request(), False), (R.Request(), True), (R.Request(semantic=False, max_results=2), False), (R.Request(max_tokens=180), True)])
def test_retrieval_against_plain_python(spark, tmp_path, how, stored):
    rows = [(s, f"{s}:{k}", k, role, text, 9 + len(text) // 4) for s in (1, 2) for k, (role, text) in enumerate(TEXTS) if not (s == 2 and k in (1, 4))]
    found = spark.createDataFrame(rows, "session_id long, entry_id string, created_at long, role string, text string, tokens long")
    asked = H.requests(found)
    index = None
    if stored:
        index = Index(spark, str(tmp_path / "index"))
        index.sync(R.entry_sources(found), "entry")
    got = R.candidates(found, asked, how, index).orderBy("session_id", "place").collect()
    parts = {r.session_id: r.asDict() for r in X.described(asked, "request").collect()}
    cells = {}
    for r in C.hashed_features(found.select("entry_id", "text"), "entry_id").collect():
        cells.setdefault(r.entry_id, {})[r.bucket] = r.value
    asks = {}
    for r in C.hashed_features(asked.select("session_id", F.col("request").alias("text")), "session_id").collect():
        asks.setdefault(r.session_id, {})[r.bucket] = r.value
    picked = {}
    for r in R.retrieve(found, asked, how, index).orderBy("session_id", "place").collect():
        picked.setdefault(r.session_id, []).append(r)
    for s in (1, 2):
        entries = [dict(id=i, at=a, role=ro, text=t, tokens=n) for x, i, a, ro, t, n in rows if x == s and a < parts[s]["asked_at"]]
        vectors = {e["id"]: sum(v * asks[s].get(b, 0) for b, v in cells[e["id"]].items()) for e in entries} if how.semantic else {}
        want = brute(entries, parts[s], vectors, how)
        own = [r for r in got if r.session_id == s]
        assert [r.entry_id for r in own] == [w[3] for w in want]
        assert [r.score for r in own] == pytest.approx([w[1] for w in want], abs=2e-6)
        seen, used, keep = set(), 0, []
        for r in own:
            key = " ".join(r.text.split()).lower()
            if key in seen:
                continue
            seen.add(key)
            rest = how.max_tokens - used
            if len(keep) >= how.max_results or rest < 48:
                break
            chars = min(6000, max(256, 4 * rest - 800))
            cost = lambda c: 9 + math.ceil((160 + (len(r.text) if len(r.text) <= c else c + 2)) / 4)  # noqa: B023, E731
            while cost(chars) > rest and chars > 256:
                chars = max(256, int(chars * 0.7))
            if cost(chars) <= rest:
                used += cost(chars)
                keep.append((r.entry_id, len(r.text) <= chars))
        assert [(r.entry_id, "…" not in r.excerpt) for r in picked[s]] == keep


def test_recall_across_sessions_hides_closed_entries(spark):
    rows = [(1, "1:0", 0, "user", "the deploy token rotates weekly", 9, "normal"), (2, "2:0", 0, "assistant", "deploy token rotation is done by a job", 9, "sensitive"), (3, "3:0", 0, "assistant", "a job rotates the deploy token", 9, None), (3, "3:1", 1, "user", "unrelated", 9, None)]
    found = spark.createDataFrame(rows, "session_id long, entry_id string, created_at long, role string, text string, tokens long, classification string")
    asked = spark.createDataFrame([("a", "how does the deploy token rotate", 99)], "asker string, request string, asked_at long")
    scope = spark.createDataFrame([("a", 1, "own"), ("a", 2, "project"), ("a", 3, "project")], "asker string, session_id long, relation string")
    got = R.recall(found, asked, scope).orderBy("place").collect()
    assert sorted((r.session_id, r.entry_id, r.relation) for r in got) == [(1, "1:0", "own"), (3, "3:0", "project")]
    assert R.recall(found, asked, scope, limit=1).count() == 1


def test_a_candidate_past_many_that_do_not_fit_is_taken(spark):
    rows = [("a", k, 1000 - k, 60 if k < 700 else 7) for k in range(720)] + [("b", k, k, 5) for k in range(3)] + [("c", 1, 1, 999)]
    frame = spark.createDataFrame(rows, "key string, id int, score int, tokens int")
    got = sorted((r.key, r.id, r.place) for r in H.greedy_whole(frame, ["key"], [F.desc("score"), F.asc("id")], "tokens", 50, 4, fold=100).collect())
    assert got == [("a", 700 + k, 700 + k) for k in range(4)] + [("b", k, 2 - k) for k in range(3)]


def test_requests_are_described_and_embedded_in_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(s, f"{s}:{k}", k, "user", f"session {s} asks about parseConfig{s} and its cache", 9) for s in range(40) for k in range(2)]
    found = spark.createDataFrame(rows, "session_id long, entry_id string, created_at long, role string, text string, tokens long")
    index = Index(spark, str(tmp_path / "index"))
    index.sync(R.entry_sources(found), "entry")
    tasks, written, embedded = {}, R.materialize, semantic.embedded

    def seen(df, name):
        tasks.setdefault(name, df.rdd.getNumPartitions())
        return written(df, name)

    def vectors(texts, key, model):
        tasks["embedded"] = texts.rdd.getNumPartitions()
        return embedded(texts, key, model)

    monkeypatch.setattr(R, "materialize", seen)
    monkeypatch.setattr(semantic, "embedded", vectors)
    R.candidates(found, H.requests(found), R.Request(), index).count()
    # few bytes that take long: they stay as many tasks as a shuffle has
    assert tasks["asked"] == tasks["embedded"] == 4
