from mnemospark.operators import state as S


def test_classes_of_claims_say_all_pairs_without_making_those_of_copies(spark):
    kinds = ["the cache is enabled", "The cache is disabled", "limit: 1", "limit: 2", "never the cache", "the cache enabled", "plain words", None]
    rows = [(k % 2, k, kinds[k // 2 % len(kinds)]) for k in range(96)]
    claims = spark.createDataFrame(rows, "session int, id int, claim string")
    want = {tuple(r) for r in S.contradictions(claims).collect()}
    got = S.contradiction_classes(claims).collect()
    of = {r.right_id: (r.left_id, r.same_key) for r in got if r.part == "member"}
    pairs = {(r.left_id, r.right_id): (r.same_key, r.opposite) for r in got if r.part == "pair"}
    assert sorted(of) == list(range(96)) and len(of) + len(pairs) == len(got) < len(want) / 3
    found = set()
    for session, a, _ in rows:
        for other, b, _ in rows:
            if session == other and a < b:
                x, y = sorted((of[a][0], of[b][0]))
                link = (of[a][1], 0) if x == y else pairs.get((x, y), (0, 0))
                if any(link):
                    found.add((session, a, b, *link))
    assert found == want
