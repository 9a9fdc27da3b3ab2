import functools
from collections import Counter

import numpy as np
import xxhash

from mnemospark.llm import simhash
from tests.llm.helpers import documents, empty_frame, odd_frame


def slow_fingerprint(text, n=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.translate({i: " " for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    n = min(n, len(words))
    times = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    values = [(xxhash.xxh64_intdigest(x, 42), k) for x, k in times.items()]
    return sum(1 << b for b in range(64) if 2 * sum(k for v, k in values if v >> b & 1) > len(words) - n + 1)


def groups(prints):
    """Index of the class of each fingerprint, by comparing all with all."""
    distinct = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(distinct)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(distinct[:i] ^ x) <= 2):
            a, b = sorted((top(i), top(int(j))))
            parent[b] = a
    at = {int(x): top(i) for i, x in enumerate(distinct)}
    return [at[p] for p in prints]


def brute(rows, n=3):
    prints = [slow_fingerprint(t, n) for _, t in rows]
    of = groups(prints)
    least = {}
    for (d, _), g in zip(rows, of):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, of)), key=str)


def test_classes_of_documents_and_odd_texts(spark):
    frame, rows = odd_frame(spark)
    long = "Alpha beta gamma delta " * 120_000  # more than a slice
    rows = rows + [(900 + d, t) for d, t in documents(150)] + [(5000, long), (5001, long + "x")]
    frame = frame.select("doc_id", "text", *frame.columns[2:]).unionByName(spark.createDataFrame(rows[len(rows) - 152 :], "doc_id long, text string"), allowMissingColumns=True)
    assert sorted(map(tuple, simhash.classes(frame).collect()), key=str) == brute(rows)
    assert simhash.classes(empty_frame(spark)).count() == 0


def near(r, count):
    """Random fingerprints, balls of near ones, chains of two bits a step, and zero."""
    centres = r.integers(0, 1 << 63, count // 4, dtype=np.uint64) * np.uint64(2)
    out = [*centres.tolist(), 0, 1, 7, 31]
    for c in centres[:20].tolist():
        for _ in range(12):
            out.append(c ^ functools.reduce(lambda x, b: x | 1 << int(b), r.integers(0, 64, r.integers(1, 5)), 0))
        for k in range(0, 24, 2):
            c ^= 3 << k
            out.append(c)
    # many that agree in a third or two thirds of their bits
    out += [(5 << 50) | int(x) for x in r.integers(0, 1 << 40, count // 2)]
    out += [(5 << 50) | int(x) for x in r.integers(0, 1 << 14, count // 4)]
    return sorted(set(out))


def test_shards_of_every_size_lose_no_link(spark):
    prints = near(np.random.default_rng(7), 800)
    nodes = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fingerprint long")
    want = groups(prints)
    for most in (4096, 40):
        found = []
        for part in simhash.sharded(nodes, most):
            assert part.groupBy("shard").count().where(f"count > {most}").isEmpty()
            found += [(a % 2**64, b % 2**64) for a, b in simhash.links(part).collect()]
        parent = {p: p for p in prints}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in found:
            assert (a ^ b) != 0
            parent[top(a)] = top(b)
        classes = {}
        for p, g in zip(prints, want):
            classes.setdefault(g, set()).add(top(p))
        assert all(len(x) == 1 for x in classes.values()) and len(classes) == len({top(p) for p in prints})


def test_trees_follow_few_edges():
    r = np.random.default_rng(8)
    own = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    own[2000:] = own[:2000] ^ (np.uint64(1) << r.integers(0, 63, 2000).astype(np.uint64))
    shard = np.zeros(len(own), np.int64)
    root, child = simhash.forest(shard, own)
    assert (root == 0).all() and np.count_nonzero(child >= 0) == len(own) - 1
    parent, edge = np.nonzero(child >= 0)
    assert (simhash.distance(own[parent], own[child[parent, edge]]) == edge).all()
    got, seen = set(), 0
    for a, b, n in simhash.linked(own, root, child):
        got |= set(zip(b.tolist(), a.tolist()))
        seen += n
    far = np.bitwise_count(own[:, None] ^ own[None, :])
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(far <= 2, 1)))))
    assert seen < len(own) ** 2 / 2
