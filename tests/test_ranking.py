import random

from mnemospark.operators import ranking


def test_inversions_of_all_candidates(spark):
    rng, rows, want = random.Random(3), [], {}
    for source, n in (("hot", 700), ("long", 130), ("short", 5), ("one", 1), (None, 90)):
        learned = rng.sample(range(n), n)
        rows += [(source, s, x) for s, x in enumerate(learned)]
        want[source] = (n, sum(learned[a] > learned[b] for a in range(n) for b in range(a + 1, n)))
    want[None] = (90, 0)  # as before, a null key pairs with nothing
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "source string, static_rank int, learned_rank int")
    got = {r.source: (r.candidates, r.inversions) for r in ranking.disagreement(frame, "source").collect()}
    assert got == want
