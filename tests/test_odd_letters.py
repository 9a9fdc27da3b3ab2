"""Queries against their SQL on letters and places that the given small tables don't hold."""

import duckdb
from pyspark.sql import functions as F

from mnemospark import catalogue
from mnemospark.functions import text as T
from mnemospark.operators import context
from tests.test_queries import plain


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL on the same tables."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    got = con.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    want = [dict(zip(columns, r)) for r in got.fetchall()]
    return plain([r.asDict() for r in df.collect()], sorted(columns)), plain(want, sorted(columns))


def test_a_turn_changed_in_place_keeps_its_bytes_whatever_its_fourth_letter(spark, tmp_path):
    said = {2: "abcüber", 6: "abc#def", 10: 'abc"def', 14: "abc", 18: "abc日x", 22: "abcdef"}
    rows = [(c, k, "user", text) for c, text in said.items() for k in range(2)] + [(26, k, "user", "abcü and more") for k in range(5)] + [(27, 0, "user", "abcü")]
    got, want = both(spark, tmp_path, "log_states", conversations=(rows, "conv_id long, turn int, role string, text string"))
    assert got == want and len(got) == len(said) + 2


def test_other_cases_of_a_value_go_letter_by_letter(spark, tmp_path):
    texts = ["CHSSKEIT | Straße ß ende", "weiß", "ΑΣ ΟΔΟΣ ως ΣΑΣ", "İstanbul ışık ﬁn", "ŉ ᾳ ᾼ ǰ und ß"]
    got, want = both(spark, tmp_path, "summary_span_classes", documents=([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    assert got == want
    cased = spark.createDataFrame([("Straße ﬁ ᾳ",), ("ΟΔΟΣ İ",), ("plain Ä",)], "v string").select(T.upper_letters(F.col("v")).alias("u"), T.lower_letters(F.col("v")).alias("l")).collect()
    assert [tuple(r) for r in cased] == [("STRAẞE ﬁ ᾼ", "straße ﬁ ᾳ"), ("ΟΔΟΣ İ", "οδοσ i"), ("PLAIN Ä", "plain ä")]


def test_every_technology_of_the_reference_is_named(spark):
    said = spark.createDataFrame([("a pi adapter on Redis",), ("pip and pirates",)], "text string")
    assert [r.technologies for r in context.described(said).collect()] == [["redis", "pi"], []]
