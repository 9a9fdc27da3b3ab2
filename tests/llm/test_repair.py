import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from mnemospark.llm import repair
from tests.llm.helpers import SF

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if fault == 3 else 1)
    return out


def brute(rows):
    """One conversation's (gaps, blank, duplicate, truncated, illegal, cost, audit, digest), by all states of all rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
    seen, marks = set(), []
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        marks.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def insert(best):
        for _ in range(3):
            for q, (c, a, o) in list(best.items()):
                for role in ("user", "assistant"):
                    if to := step.get((q, role[0])):
                        best[to] = min(best.get(to, (9**9,)), (c + 3, a + "I", o + [f"{role}:"]))
        return best

    best = insert({0: (0, "", [])})
    for (_, role, text), mark in zip(rows, marks):
        new = {}

        def offer(q, cost, letter, line):
            c, a, o = best[q]
            to = q if line is None else step.get((q, line[:1]))
            if to is not None:
                new[to] = min(new.get(to, (9**9,)), (c + cost, a + letter, o + ([] if line is None else [line])))

        for q in best:
            offer(q, 4, "D", None)
            if mark not in ("b", "d"):
                extra = 3 * (mark == "t")
                if role:
                    offer(q, extra, "K", f"{role}:{text}")
                for other in ("user", "assistant"):
                    offer(q, 3 + extra, "R", f"{other}:{text}")
        best = insert(new)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    wrong = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, marks.count("b"), marks.count("d"), marks.count("t"), wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def odd_rows():
    r = random.Random(5)
    texts = ["Yes.", "No!", "Well", "So?", "", " \n", None, "same", "same.", "ünïcode…", "x.\t ", "end.  ", "sure"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sys"]
    rows = []
    for conv in range(300):
        for turn in range(r.randint(1, 14)):
            role = r.choice(roles) if r.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, r.choice([turn, turn, turn, turn // 2, None, turn * 3]), role, r.choice(texts)))
    for conv, n in ((1000, 700), (1001, 150), (None, 90)):
        rows += [(conv, t, r.choice(roles[: r.choice([2, 8])]), f"{r.choice(texts)}{r.choice(['', t])}") for t in range(n)]
    rows += [(1000, 5, "user", "often.")] * 200 + [(2000 + i, 0, "user", "Hi.") for i in range(60)] + [(3, None, None, None)]
    rows += [(1000, t, "user", "often.") for t in range(100, 160)]
    r.shuffle(rows)
    return rows


def answer(frame):
    return sorted((tuple(x[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for x in frame.collect()), key=str)


@pytest.mark.parametrize("block", [3, 64])
def test_against_brute_force(spark, tmp_path, block):
    rows = odd_rows()
    path = str(tmp_path / "conversations")
    spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA + ", code string, part string").write.parquet(path)
    got = answer(repair.digests(repair.damaged(spark.read.parquet(path)), block))
    assert got == sorted(((conv, *brute(x)) for conv, x in damage(rows).items()), key=str)


def test_sql_says_the_same(spark, tmp_path):
    rows = [x for x in odd_rows() if x[0] is None or x[0] < 60]
    path = str(tmp_path / "conversations")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/*.parquet'")
    assert sorted(con.execute(repair.oracle()).fetchall(), key=str) == sorted(((conv, *brute(x)) for conv, x in damage(rows).items()), key=str)


def test_table_whole_texts_and_none(spark, tmp_path):
    rows = [tuple(x) for x in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    long = "word and word. " * 150_000
    rows += [(7000, 1, "user", long), (7000, 2, "user", long), (7000, 3, "assistant", long + "cut"), (7001, 0, "user", "Left out")]
    path = str(tmp_path / "conversations")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    assert answer(repair.digests(repair.damaged(spark.read.parquet(path)))) == sorted(((conv, *brute(x)) for conv, x in damage(rows).items()), key=str)
    assert repair.digests(repair.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_messages_are_a_legal_conversation(spark, tmp_path):
    path = str(tmp_path / "conversations")
    spark.createDataFrame([x for x in odd_rows() if x[0] == 1000], SCHEMA).write.parquet(path)
    parts = sorted(repair.repaired(spark.read.parquet(path)).collect(), key=lambda x: (x.part, x.seq))
    assert len(parts) > 10 and not any(x.whole for x in parts)
    roles = [m.role[0] for x in parts for m in x.messages]
    assert roles[0] in "su" and roles[-1] == "a" and all("".join(p) in repair.LEGAL for p in itertools.pairwise(roles))
    assert all(x.audit.count("D") >= x.blank + x.duplicate for x in parts)


def test_layers_grow_and_end():
    codes = np.array([[0, 1], [2, 4], [1, 16]], np.uint8)
    made, cost = repair.layers(codes, np.tile(repair.START_END, (2, 1)), np.full(2, 15, np.uint8))
    assert (made[:-1] & ~made[1:] == 0).all()
    assert cost[:, 0].tolist() == [6, 7] and cost[:, 3].tolist() == [6, 7]
