import random

from mnemospark.operators import supersession as S

SCHEMA = "mutation_id long, session long, project string, created_at long, nth int, op string, item_id string, scope string, item_project string, key string, claim string, previous_id string, target_id string, status string"


def row(k, session, op, item=None, previous=None, target=None, status=None, scope="project", project="p", key=None, at=None):
    return (k, session, project, at if at is not None else k, 0, op, item, scope, project if scope == "project" else None, key, f"claim {item}", previous, target, status)


def run(spark, rows, sources=(), inherited=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    given = spark.createDataFrame(inherited, "session long, item_id string") if inherited else None
    items, warnings = S.materialized(frame, spark.createDataFrame(list(sources), "session long, status string, excluded boolean"), given)
    return {r.item_id: r for r in items.collect()}, sorted((r.kind, r.mutation_id) for r in warnings.collect())


def test_long_chains_circles_and_forks_in_any_order(spark):
    rows = [row(0, 0, "add", "c0")] + [row(k, k % 7, "supersede", f"c{k}", f"c{k - 1}") for k in range(1, 300)]
    rows += [row(1000 + k, k % 3, "supersede", f"r{k}", f"r{(k + 1) % 40}") for k in range(40)]  # a circle of forty
    rows += [row(2000, 1, "supersede", "fork", "c5"), row(2001, 1, "supersede", "self", "self"), row(2002, 1, "supersede", "late", "nothing")]
    random.Random(3).shuffle(rows)
    items, warnings = run(spark, rows)
    assert items["c0"].superseded_by == "c1" and items["c0"].current == "c4" or items["c0"].current == "fork"
    assert items["c5"].superseded_by == "fork" and items["c0"].current == "fork"  # the later of two replacements counts
    assert items["c6"].current == "c299" and items["c299"].status == "active"
    assert all(items[f"r{k}"].cyclic and items[f"r{k}"].current is None for k in range(40)) and items["self"].cyclic
    assert warnings == [("missing-target", 2002)]


def test_sources_scopes_and_inherited_items(spark):
    rows = [
        row(1, 1, "add", "a", key="k"), row(2, 2, "supersede", "b", "a", key="k"), row(3, 3, "status", target="b", status="expired"), row(4, 4, "add", "d", key="k"),
        row(5, 1, "add", "s", scope="session"), row(6, 2, "status", target="s", status="invalid"), row(7, 5, "status", target="d", status="invalid", project="q"), row(8, 1, "status", target="d", status="invalid"),
        row(9, 6, "add", "a", key="k"), (10, 1, "p", 10, 0, "add", "a", "project", "p", None, "another claim", None, None, None),
    ]
    items, warnings = run(spark, rows, [(2, "ready", True), (3, "corrupt", False)], [(1, "d")])
    assert {k: (r.status, r.superseded_by) for k, r in items.items()} == {"a": ("active", None), "d": ("invalid", None), "s": ("active", None)}
    assert warnings == [("crosses-scope", 6), ("crosses-scope", 7), ("id-collision", 10), ("key-conflict", 4)]
    items, warnings = run(spark, rows)
    assert {k: (r.status, r.superseded_by) for k, r in items.items()} == {"a": ("superseded", "b"), "b": ("expired", None), "d": ("invalid", None), "s": ("active", None)}
    assert run(spark, [])[0] == {}


def test_candidates(spark):
    files = [(f"f{k}", k, "/w" if k != 3 else "/x", 3 if k != 4 else 9, k != 5) for k in range(10)] + [("f99", 9, "/w", 3, True)]
    known = [(3, "f3"), (5, "f5"), (0, "f0"), (77, "gone"), (1, "f1")]
    frame = spark.createDataFrame(files, "file string, session long, cwd string, version int, header_ok boolean")
    got = S.candidates(frame, spark.createDataFrame(known, "session long, file string"), "/w", 2, 8)
    assert sorted((r.session, r.file, r.state, r.reason) for r in got.collect()) == [
        (0, "f0", "corrupt", "beyond-most-sessions"), (1, "f1", "corrupt", "beyond-most-sessions"), (2, "f2", "ready", None), (3, "f3", "corrupt", "other-project"), (5, "f5", "corrupt", "invalid-header"),
        (6, "f6", "ready", None), (7, "f7", "ready", None), (8, "f8", "ready", None), (9, "f99", "ready", None), (77, "gone", "missing", "file-missing"),
    ]
