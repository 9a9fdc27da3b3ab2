import pytest

from mnemospark.llm import graph


@pytest.mark.parametrize("few", [3, 50_000])
def test_hubs_chains_and_dealt_rows(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    links = [(1, 1000 + i) for i in range(300)] + [(5000 + i, 5001 + i) for i in range(120)] + [(7, 7), (9, 8), (8, 9), (1300 - 1, 20)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {1000 + i: 1 for i in range(300)} | {5000 + i: 5000 for i in range(121)} | {1: 1, 8: 8, 9: 8, 20: 1}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
