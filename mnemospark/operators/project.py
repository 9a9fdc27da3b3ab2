"""Project knowledge: files and their snippets, exact and full-text search, scores, and evidence packed for a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.vectors import reciprocal_rank_fusion
from mnemospark.operators.history import greedy, top
from mnemospark.storage import materialize

#: Folders that hold no project knowledge.
IGNORED_DIRECTORIES = (
    ".git", ".hg", ".svn", ".cache", ".idea", ".vscode",
    "node_modules", "vendor", "dist", "build", "coverage", "target",
    "bin", "obj", ".next", ".nuxt", ".venv", "venv", "__pycache__",
)
#: Endings of binary files.
BINARY_EXTENSIONS = (
    ".7z", ".a", ".avi", ".bmp", ".class", ".db", ".dll", ".dylib",
    ".eot", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpeg", ".jpg",
    ".mov", ".mp3", ".mp4", ".o", ".otf", ".pdf", ".png", ".pyc",
    ".so", ".sqlite", ".tar", ".tgz", ".ttf", ".wav", ".webm",
    ".webp", ".woff", ".woff2", ".xz", ".zip",
)
#: Lock files by name.
LOCK_FILES = (
    "bun.lock", "bun.lockb", "cargo.lock", "composer.lock", "flake.lock",
    "package-lock.json", "packages.lock.json", "pnpm-lock.yaml", "poetry.lock",
    "yarn.lock",
)
#: Files that hold credentials, by name.
SECRET_FILE_NAMES = (
    ".env", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json",
    "credentials.yaml", "credentials.yml", "id_dsa", "id_ed25519", "id_rsa",
    "secrets.json", "secrets.yaml", "secrets.yml",
)
SECRET_ENDING, GENERATED = r"\.(?:key|pem|p12|pfx|jks|keystore)$", r"\.min\.(?:css|js)$|\.map$"
#: Parts of a snippet's score.
PATH, NAME, QUALIFIED, SYMBOL, DECLARED, SYMBOL_TEXT, PHRASE, TERM, MODIFIED, TRACKED = 180, 150, 190, 170, 115, 65, 90, 45, 10, 3


def skipped(path: Column) -> Column:
    """Why a file is no project knowledge: ignored, sensitive or binary; null if it is."""
    name = F.lower(F.regexp_extract(path, "[^/]*$", 0))
    ending = F.regexp_extract(name, r"[^.](\.[^.]*)$", 1)
    return (
        F.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRECTORIES))), "ignored")
        .when(name.isin(*SECRET_FILE_NAMES) | F.startswith(name, F.lit(".env.")) | name.rlike(SECRET_ENDING), "sensitive")
        .when(ending.isin(*BINARY_EXTENSIONS) | name.isin(*LOCK_FILES) | name.rlike(GENERATED), "binary")
    )


def knowledge_files(files: DataFrame, most: int | None = None) -> DataFrame:
    """``files`` (path, tracked) that are project knowledge, tracked ones first, then by path; at most ``most`` where that is asked for."""
    rows = files.where(skipped(F.col("path")).isNull())
    return rows if most is None else rows.orderBy(F.desc(F.col("tracked").cast("int")), "path").limit(most)


def replaced(snippets: DataFrame, files: DataFrame, fresh: DataFrame) -> DataFrame:
    """``snippets`` after ``files`` (path, hash) were indexed anew: their old snippets are stale but for those that ``fresh`` brings again."""
    new = fresh.select("path", "snippet_id").withColumn("_new", F.lit(True))
    rows = snippets.join(files.select("path").distinct().withColumn("_seen", F.lit(True)), "path", "left").join(new, ["path", "snippet_id"], "left")
    kept = rows.where("_new is null").withColumn("stale", F.col("stale") | F.coalesce("_seen", F.lit(False))).drop("_new", "_seen")
    return kept.unionByName(fresh.withColumn("stale", F.lit(False)), allowMissingColumns=True)


def current(snippets: DataFrame, files: DataFrame) -> DataFrame:
    """Snippets that are not stale, of files that are there, with what the file says: its language, and whether it is modified or tracked."""
    return snippets.where("not stale").join(files.where("status = 'current'").select("project", "path", "language", "modified", "tracked"), ["project", "path"])


def asked_for(requests: DataFrame, column: str) -> DataFrame:
    return requests.select("request", "project", F.explode(F.array_distinct(column)).alias("term"))


def path_hits(rows: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Snippets whose path is a file that the request names, or ends with it after a slash, regardless of case; whole paths first.

    A path meets a name by one of its own endings, so this is an equi-join.
    """
    low = F.lower("path")
    ends = rows.withColumn("_parts", F.split(low, "/")).withColumn("_key", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda k: F.array_join(F.slice("_parts", k, F.size("_parts") - k + 1), "/"))))
    hits = asked_for(requests, "files").withColumn("_key", F.lower("term")).join(ends, ["project", "_key"]).withColumn("whole", F.lower("path") == F.col("_key"))
    order = [F.desc(F.col("whole").cast("int")), F.desc(F.col("modified").cast("int")), F.asc("start_line"), F.asc("snippet_id")]
    return top(hits, ["request", "term"], order, limit).select("request", "term", "snippet_id", "rank")


def symbol_hits(rows: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Snippets whose symbol or qualified symbol is one that the request names, regardless of case; qualified ones first."""
    names = F.array_distinct(F.array_compact(F.array(F.lower("qualified_name"), F.lower("symbol_name"))))
    each = rows.withColumn("_key", F.explode(names))
    hits = asked_for(requests, "symbols").withColumn("_key", F.lower("term")).join(each, ["project", "_key"])
    whole = F.coalesce(F.lower("qualified_name") == F.col("_key"), F.lit(False))
    order = [F.desc(whole.cast("int")), F.desc(F.col("modified").cast("int")), F.asc("start_line"), F.asc("snippet_id")]
    return top(hits, ["request", "term"], order, limit).select("request", "term", "snippet_id", "rank")


#: Terms of a project that a snippet is looked through for at a time.
TERMS = 200


def text_hits(rows: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """Snippets whose path or content holds a term as it is written. A snippet meets its own project's terms, in packs, each term once however many ask for it."""
    wanted = asked_for(requests, "exact").distinct()
    nth = F.row_number().over(Window.partitionBy("project").orderBy("term")) - 1
    packs = wanted.select("project", "term").distinct().withColumn("pack", F.floor(nth / TERMS)).groupBy("project", "pack").agg(F.collect_list("term").alias("_terms"))
    packs = materialize(packs, "packs")
    held = rows.join(packs.drop("pack"), "project").withColumn("term", F.explode(F.filter("_terms", lambda t: F.contains(F.col("path"), t) | F.contains(F.col("content"), t)))).drop("_terms")
    order = [F.desc(F.col("modified").cast("int")), F.asc("start_line"), F.asc("snippet_id")]
    return top(held.join(wanted, ["project", "term"]), ["request", "term"], order, limit).select("request", "term", "snippet_id", "rank")


def score(row: DataFrame) -> Column:
    """A candidate's score from what the request names (files, symbols, phrases, exact), its full-text and vector ranks, and its file's state."""
    path, content = F.lower("path"), F.lower("content")
    base = F.regexp_extract(path, "[^/]*$", 0)
    declared = F.transform("declared", F.lower)
    of_file = lambda f: F.when((path == F.lower(f)) | F.endswith(path, F.concat(F.lit("/"), F.lower(f))), PATH).when(base == F.regexp_extract(F.lower(f), "[^/]*$", 0), NAME).otherwise(0)
    of_symbol = lambda s: F.when(F.lower("qualified_name") == F.lower(s), QUALIFIED).when(F.lower("symbol_name") == F.lower(s), SYMBOL).when(F.array_contains(declared, F.lower(s)), DECLARED).when(F.contains(content, F.lower(s)), SYMBOL_TEXT).otherwise(0)
    of_phrase = lambda p: F.when(F.contains(content, F.lower(p)), PHRASE).otherwise(0)
    others = F.array_except(F.array_except(F.array_except("matched", "files"), "symbols"), "phrases")
    of_term = lambda t: F.when(F.contains(content, F.lower(t)) | F.contains(path, F.lower(t)), TERM).otherwise(0)
    total = lambda c, f: F.aggregate(F.transform(c, f), F.lit(0), lambda a, x: a + x)
    vector = F.when(F.col("vector_order").isNotNull(), F.greatest(F.lit(0.0), F.col("similarity")) * 80 + reciprocal_rank_fusion((F.col("lexical_order"), 1.0), (F.col("vector_order"), 1.0)) * 1500).otherwise(0.0)
    return T.half_up(
        total("files", of_file) + total("symbols", of_symbol) + total("phrases", of_phrase) + total(others, of_term)
        + F.when(F.col("fts_order").isNotNull(), F.greatest(F.lit(20.0), 60 - F.col("fts_order") * 0.5)).otherwise(0.0)
        + vector + F.when(F.col("modified"), MODIFIED).otherwise(0) + F.when(F.col("tracked"), TRACKED).otherwise(0) - F.least(F.lit(15.0), F.col("tokens") / 800)
    )


def evidence(rows: DataFrame, requests: DataFrame, fts: DataFrame, vectors: DataFrame | None = None, most: int = 6, budget: int = 900) -> DataFrame:
    """(request, snippet_id, score, place): the snippets that go into each request.

    ``rows`` are `current` snippets (project, path, snippet_id, start_line, end_line, content, declared, symbol_name, qualified_name, tokens, ...), ``requests`` (request, project, files, symbols, phrases, exact),
    ``fts`` (request, snippet_id, fts_order) and ``vectors`` (request, snippet_id, vector_order, similarity) the other channels. Candidates of all channels are merged and scored; exact ones go first, then score,
    modified files, path, line and id. A snippet that says what an earlier one says, or shares half its lines or an exact term with one of the same file over common lines, is left out. What fits the budget is
    taken in that order, passing over what doesn't.
    """
    limit = min(500, max(8 * most, 40))
    # requests and what the channels find for them are few and written, so that it is known how small they are, and snippets with their texts need not be shuffled to meet them
    requests = materialize(requests, "requests")
    exact = path_hits(rows, requests, limit).unionByName(symbol_hits(rows, requests, limit)).unionByName(text_hits(rows, requests, limit))
    found = exact.groupBy("request", "snippet_id").agg(F.collect_set("term").alias("matched")).join(fts, ["request", "snippet_id"], "full").withColumn("_words", F.lit(True))
    empty = F.array().cast("array<string>")
    none = {"vector_order": F.lit(None).cast("int"), "similarity": F.lit(None).cast("double"), "lexical_order": F.lit(None).cast("int")}
    if vectors is not None:
        found = found.join(vectors, ["request", "snippet_id"], "full")
    else:
        found = found.withColumns({k: none[k] for k in ("vector_order", "similarity")})
    pool = materialize(found.withColumn("matched", F.coalesce("matched", empty)).join(requests, "request"), "pool")
    known = materialize(pool.join(rows, ["project", "snippet_id"]), "known")
    by_words = known.where("_words").withColumns(none)
    by_words = by_words.withColumn("first_score", score(by_words))
    order = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("first_score"), "snippet_id")) - 1
    merged = known.join(by_words.select("request", "snippet_id", order.alias("lexical_order")), ["request", "snippet_id"], "left")
    merged = merged.withColumn("score", score(merged)).withColumn("is_exact", (F.size("matched") > 0).cast("int"))
    best = [F.desc("is_exact"), F.desc("score"), F.desc(F.col("modified").cast("int")), F.asc("path"), F.asc("start_line"), F.asc("snippet_id")]
    same = Window.partitionBy("request", F.lower(T.collapsed(F.col("content")))).orderBy(*best)
    kept = top(merged.withColumn("_copy", F.row_number().over(same)).where("_copy = 1"), ["request"], best, limit, "at")
    # a fold in order: each candidate is held against those that were kept, of its file
    item = F.struct("at", "path", "start_line", "end_line", "matched", F.col("tokens").cast("long").alias("tokens"))
    lists = kept.groupBy("request").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def redundant(a: Column, b: Column) -> Column:
        overlap = F.least(a["end_line"], b["end_line"]) - F.greatest(a["start_line"], b["start_line"]) + 1
        smaller = F.least(a["end_line"] - a["start_line"], b["end_line"] - b["start_line"]) + 1
        return (a["path"] == b["path"]) & (overlap > 0) & (F.arrays_overlap(a["matched"], b["matched"]) | (2 * overlap >= smaller))

    none_yet = F.slice("items", F.lit(1), F.lit(0))
    apart = F.aggregate("items", none_yet, lambda acc, x: F.when(F.exists(acc, lambda k: F.coalesce(redundant(k, x), F.lit(False))), acc).otherwise(F.concat(acc, F.array(x))))
    places = lists.select("request", F.explode(apart).alias("x")).select("request", F.col("x.at").alias("at"))
    packed = greedy(kept.join(places, ["request", "at"]), ["request"], "at", "tokens", budget, most)
    return packed.select("request", "snippet_id", "score", F.col("at").alias("place"))


def stats(files: DataFrame, snippets: DataFrame) -> DataFrame:
    """Seven measures a project: files, current, modified, tracked ones, bytes of current ones, live snippets, their tokens."""
    here = F.col("status") == "current"
    of_files = files.groupBy("project").agg(
        F.count("*").alias("files"), F.count_if(here).alias("current"), F.count_if(here & F.col("modified")).alias("modified"), F.count_if(here & F.col("tracked")).alias("tracked"), F.coalesce(F.sum(F.when(here, F.col("bytes"))), F.lit(0)).alias("bytes")
    )
    of_snippets = snippets.where("not stale").groupBy("project").agg(F.count("*").alias("snippets"), F.sum("tokens").alias("tokens"))
    return of_files.join(of_snippets, "project", "left").fillna(0, ["snippets", "tokens"])


def embedding_sources(rows: DataFrame, after: str | None, limit: int) -> tuple[int, DataFrame]:
    """How many current snippets have any text, and the page of (snippet_id, content) after a cursor."""
    some = rows.where("length(trim(content)) > 0")
    page = some if after is None else some.where(F.col("snippet_id") > after)
    return some.count(), page.orderBy("snippet_id").limit(limit).select("snippet_id", "content")
