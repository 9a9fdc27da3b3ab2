"""Exact top-k inner products by best-first search in M-trees (operator 9).

Vectors are spread over partitions of bounded size, and each partition is an M-tree: pages of at most ``PAGE``
entries, each entry with its distance to the page's own routing object, and routing entries with a covering
radius. For a metric, a tree's vectors get one more component that brings all to the same norm; then the nearest
vector is the one of largest inner product.

Pages are rows of a table. A block of queries meets every tree (a stated query set against all rows); blocks are large,
since the pages are sent once for each; in a tree queries go down together and take pages by their least possible distance, each until that exceeds its own k-th best. Stored distances rule entries
out before their own distance is computed: |d(query, routing object) - d(entry, routing object)| is a lower bound.
Scores are 64-bit integers, and bounds are widened by more than rounding can take from a distance, so the result is exact,
ties included. Vectors whose scores might not fit 64 bits are refused.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.shared import materialize

PAGE, FANOUT = 192, 12
TREE_VECTORS, QUERY_BLOCK = 25_000, 100_000
#: Vectors that a tree of its own is worth.
LEAST_TREE = 4_000
#: What bounds are widened by: a constant and a share of the norm. A squared distance is off by less than 2**-50 of the norm's square.
SLACK, SLACK_SHARE = 1e-6, 2.0**-22
#: Least bound on dim * component**2 that is refused.
TOO_LARGE = 2.0**62
#: Below this, products of components and squared distances are whole numbers that a float holds.
EXACT = 2**51
#: No score; queries that go down a tree together.
NONE, TOGETHER = -(2**63) + 1, 1024

PAGES = "dim int, part int, page int, leaf boolean, norm double, ids binary, vectors binary, radii binary, to_parent binary"
_BINARY = pa.binary()
PAGE_SCHEMA = pa.schema(
    [("dim", pa.int32()), ("part", pa.int32()), ("page", pa.int32()), ("leaf", pa.bool_()), ("norm", pa.float64()), *((c, _BINARY) for c in ("ids", "vectors", "radii", "to_parent"))]
)
HIT_SCHEMA = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Builder:
    """Pages of one tree, from the root (page 0) down."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 1):
        self.ids, self.vectors, self.random = ids, vectors, np.random.default_rng(seed)
        self.squares = (vectors * vectors).sum(1)
        self.norm = float(self.squares.max())
        self.points = np.concatenate([vectors, np.sqrt(self.norm - self.squares)[:, None]], 1).astype(np.float64)
        self.pages: list[dict] = []

    def distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[to]) ** 2).sum(1))

    def build(self, rows: np.ndarray, routing: int | None = None) -> int:
        number = len(self.pages)
        self.pages.append({})
        parent = lambda r: self.distances(r, routing) if routing is not None else np.zeros(len(r))
        if len(rows) <= PAGE:
            self.pages[number] = {"leaf": True, "ids": self.ids[rows], "vectors": self.vectors[rows], "radii": np.zeros(0), "to_parent": parent(rows)}
            return number
        chosen = [int(self.random.choice(rows))]
        nearest = self.distances(rows, chosen[0])
        owner = np.zeros(len(rows), np.int64)
        while len(chosen) < FANOUT and nearest.max() > 0:
            # far, but not the farthest of all, which would be a stray
            far = rows[np.argsort(nearest)[int(0.9 * (len(rows) - 1))]] if nearest[np.argsort(nearest)[int(0.9 * (len(rows) - 1))]] > 0 else rows[nearest.argmax()]
            chosen.append(int(far))
            d = self.distances(rows, chosen[-1])
            owner[d < nearest] = len(chosen) - 1
            nearest = np.minimum(nearest, d)
        groups = [rows[owner == k] for k in range(len(chosen))]
        if max(map(len, groups)) == len(rows):  # equal vectors: pages by number
            groups, chosen = np.array_split(rows, -(-len(rows) // PAGE)), []
            chosen = [int(g[0]) for g in groups]
        kept = [(c, g) for c, g in zip(chosen, groups) if len(g)]
        children = [self.build(g, c) for c, g in kept]
        at = np.array([c for c, _ in kept])
        self.pages[number] = {
            "leaf": False, "ids": np.array(children, np.int64), "vectors": self.vectors[at],
            "radii": np.array([self.distances(g, c).max() for c, g in kept]), "to_parent": parent(at),
        }
        return number


def build_tree(table: pa.Table) -> pa.Table:
    table = table.sort_by("vec_id")
    dim, part = table["dim"][0].as_py(), table["part"][0].as_py()
    vectors = table["v"].combine_chunks()
    vectors = (pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors).flatten().to_numpy().reshape(-1, dim).astype(np.int64)
    b = Builder(table["vec_id"].to_numpy(), vectors)
    b.build(np.arange(len(vectors)))
    columns = {c: [np.ascontiguousarray(p[c]).tobytes() for p in b.pages] for c in ("ids", "vectors", "radii", "to_parent")}
    n = len(b.pages)
    return pa.table({"dim": [dim] * n, "part": [part] * n, "page": range(n), "leaf": [p["leaf"] for p in b.pages], "norm": [b.norm] * n, **columns}, PAGE_SCHEMA)


class Tree:
    def __init__(self, table: pa.Table):
        dim = table["dim"][0].as_py()
        self.norm, self.pages, self.computed = table["norm"][0].as_py(), {}, 0
        for r in table.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            self.pages[r["page"]] = (
                r["leaf"], ids, np.frombuffer(r["vectors"], np.int64).reshape(len(ids), dim), np.frombuffer(r["radii"]), np.frombuffer(r["to_parent"]),
            )

    def nearest(self, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k largest (score, vec_id), ties to the smaller id."""
        scores, ids = self.nearest_of_all(query[None], k)
        return [(int(s), int(i)) for s, i in zip(scores[0], ids[0]) if s != NONE]

    def nearest_of_all(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k largest of each query, ties to the smaller id; where there are fewer, scores end with NONE.

        Queries go down together, so a page is one product of matrices for all that ask for it. Each first takes the leaf that its nearest routing objects lead to; then
        pages come by their least possible distance to any of their queries, and a query takes part in a page only while that distance is within its own k-th best.
        """
        m, dim = queries.shape
        largest = max((int(np.abs(v).max()) for _, _, v, _, _ in self.pages.values() if v.size), default=0)
        lift = (queries * queries).sum(1) + int(self.norm)
        exact = max(dim * largest * int(np.abs(queries).max(initial=0)), int(lift.max(initial=0))) < EXACT
        kind = np.float64 if exact else np.int64  # below 2**52 floats are exact in any order, and far faster
        asked, slack = queries.astype(kind), SLACK + SLACK_SHARE * np.sqrt(lift.astype(float))
        scores, ids, bound = np.full((m, k), NONE), np.zeros((m, k), np.int64), np.full(m, np.inf)
        first = np.zeros(m, np.int64)

        def leaf(page: int, who: np.ndarray, d_page: np.ndarray | None) -> None:
            _, own, vectors, _, to_parent = self.pages[page]
            if d_page is not None:
                near = np.abs(d_page[:, None] - to_parent) <= bound[who, None]
                some = near.any(0)
                own, vectors, near = own[some], vectors[some], near[:, some]
            else:
                near = np.ones((len(who), len(own)), bool)
            self.computed += int(near.sum())
            products = asked[who] @ vectors.astype(kind).T
            better = np.flatnonzero((near & (products >= scores[who, -1:])).any(1))
            if not len(better):
                return
            at = who[better]
            mine = np.where(near[better], products[better].astype(np.int64), NONE)
            all_scores, all_ids = np.concatenate([scores[at], mine], 1), np.concatenate([ids[at], np.broadcast_to(own, mine.shape)], 1)
            best = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[at], ids[at] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
            full = at[scores[at, -1] != NONE]
            bound[full] = np.sqrt(np.maximum(0, lift[full] - 2 * scores[full, -1]).astype(float)) + slack[full]

        def distances(page: int, who: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0.0, lift[who, None] - 2.0 * (asked[who] @ self.pages[page][2].astype(kind).T)))

        down = [(0, np.arange(m))]
        while down:
            page, who = down.pop()
            if self.pages[page][0]:
                first[who] = page
                leaf(page, who, None)
                continue
            nearest = distances(page, who).argmin(1)
            self.computed += len(who) * len(self.pages[page][1])
            down += [(int(self.pages[page][1][j]), who[nearest == j]) for j in np.unique(nearest)]
        queue = [(0.0, 0, np.arange(m), np.zeros(m), None)]
        while queue:
            _, page, who, low, d_page = heapq.heappop(queue)
            still = low <= bound[who]
            is_leaf, own, _, radii, to_parent = self.pages[page]
            if is_leaf:
                still &= first[who] != page
            who, d_page = who[still], d_page if d_page is None else d_page[still]
            if not len(who):
                continue
            if is_leaf:
                for part in range(0, len(who), TOGETHER):
                    leaf(page, who[part : part + TOGETHER], None if d_page is None else d_page[part : part + TOGETHER])
                continue
            d = distances(page, who)
            low = np.maximum(0.0, d - radii)
            go = low <= bound[who, None]
            if d_page is not None:
                go &= np.abs(d_page[:, None] - to_parent) <= bound[who, None] + radii
            self.computed += d.size
            for j in np.flatnonzero(go.any(0)):
                its = go[:, j]
                heapq.heappush(queue, (float(low[its, j].min()), int(own[j]), who[its], low[its, j], d[its, j]))
        return scores, ids


def search_block(k: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        if not pages.num_rows or not queries.num_rows:
            return HIT_SCHEMA.empty_table()
        tree, out = Tree(pages), []
        for batch in queries.to_batches(max_chunksize=TOGETHER):
            number, query_id = batch.column("query").to_numpy(), batch.column("vec_id").to_numpy()
            query = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            scores, ids = tree.nearest_of_all(query, k + 1)
            own = (scores == (query * query).sum(1)[:, None]) & (ids == query_id[:, None]) & (scores != NONE)
            left_out = np.where(own.any(1), own.argmax(1), k)  # the query's row itself, once
            row, place = np.nonzero((scores != NONE) & (np.arange(k + 1) != left_out[:, None]))
            out.append(pa.RecordBatch.from_arrays([pa.array(number[row]), pa.array(query_id[row]), pa.array(ids[row, place]), pa.array(scores[row, place])], schema=HIT_SCHEMA))
        return pa.Table.from_batches(out, HIT_SCHEMA)

    return run


def taking_part() -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    some = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return some & F.forall("embedding", finite)


def usable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dim, v) of the rows that take part; v holds floor(scale * x) of each component."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(taking_part()).select("vec_id", F.size("embedding").alias("dim"), v.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, tree_vectors: int = TREE_VECTORS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best rows for each row that ``is_query`` tells, by integer inner product.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id.
    Vectors of different length are never compared. Each query row has a list of its own, also where rows share a vec_id or are
    equal; a repeated row is another candidate. Only one row, the query itself, is left out. Components so large
    that a score might exceed 64 bits raise an error.
    """
    rows = usable(vectors, scale)
    size = F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double"))))
    bound = vectors.where(taking_part()).agg(F.count("*").alias("n"), F.max(size * size * F.size("embedding")).alias("bound")).first()
    if (bound.bound or 0) >= TOO_LARGE:
        raise ValueError("components are too large for 64-bit scores")
    # as many trees as vectors ask for, or as there are tasks to run side by side where that gives trees of some size
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, -(-bound.n // tree_vectors), min(tasks, bound.n // LEAST_TREE))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    pages = materialize(placed.groupBy("dim", "part").applyInArrow(build_tree, PAGES), "mtree")
    queries = rows.where(is_query).groupBy("vec_id", "dim", "v").agg(F.count("*").alias("times"))
    queries = materialize(queries.withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-queries.count() // query_block))
    asked = queries.select("query", "vec_id", "dim", "v", F.pmod(F.hash("query"), F.lit(blocks)).cast("int").alias("block"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    spread = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = ["dim", "part", "block"]
    hits = spread.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search_block(k), "query long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    repeated = queries.where("times > 1").select("query", "times")
    ranked = ranked.join(repeated, "query", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)).cast("int"))))
    return ranked.select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 5, every: int = 50) -> str:
    good = "vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    dot = "cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint)"
    return (
        f"with e as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) v from embeddings where {good}), "
        f"s as (select a.r q, a.vec_id query_id, b.vec_id, {dot} score from e a join e b on a.r <> b.r and len(a.v) = len(b.v) where a.vec_id % {every} = 0), "
        "w as (select *, row_number() over (partition by q order by score desc, vec_id) as rank from s) "
        f"select query_id, cast(rank as integer) as rank, vec_id, score from w where rank <= {k}"
    )
