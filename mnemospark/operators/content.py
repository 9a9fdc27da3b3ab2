"""Artifacts, snippets, symbols, and feature-hash embeddings of text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from mnemospark.functions import text as T

#: Languages by file extension.
LANGUAGES = {
    ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "csharp", ".css": "css",
    ".go": "go", ".h": "c", ".hpp": "cpp", ".html": "html", ".java": "java",
    ".js": "javascript", ".json": "json", ".jsx": "javascript", ".kt": "kotlin",
    ".md": "markdown", ".php": "php", ".proto": "protobuf", ".py": "python",
    ".rb": "ruby", ".rs": "rust", ".sh": "shell", ".sql": "sql", ".swift": "swift",
    ".toml": "toml", ".ts": "typescript", ".tsx": "typescript", ".xml": "xml",
    ".yaml": "yaml", ".yml": "yaml", ".vue": "vue", ".svelte": "svelte",
}
#: Words that count as one concept in embeddings.
CONCEPTS = {
    "auth": "auth",
    "authentication": "auth",
    "authorize": "auth",
    "authorization": "auth",
    "credential": "credential",
    "credentials": "credential",
    "password": "credential",
    "secret": "credential",
    "token": "credential",
    "cache": "cache",
    "cached": "cache",
    "caching": "cache",
    "reuse": "cache",
    "memoize": "cache",
    "database": "database",
    "datastore": "database",
    "persistence": "database",
    "sqlite": "database",
    "storage": "database",
    "crash": "failure",
    "error": "failure",
    "errors": "failure",
    "fail": "failure",
    "failed": "failure",
    "failure": "failure",
    "exception": "failure",
    "delete": "remove",
    "deleted": "remove",
    "deletion": "remove",
    "purge": "remove",
    "remove": "remove",
    "refresh": "renew",
    "renew": "renew",
    "renewal": "renew",
    "rotate": "renew",
    "expiry": "expire",
    "expired": "expire",
    "expiration": "expire",
    "timeout": "timeout",
    "timedout": "timeout",
    "latency": "performance",
    "performance": "performance",
    "slow": "performance",
    "optimize": "performance",
    "optimization": "performance",
    "validate": "validate",
    "validation": "validate",
    "verify": "validate",
    "verification": "validate",
    "check": "validate",
    "config": "configuration",
    "configuration": "configuration",
    "setting": "configuration",
    "settings": "configuration",
    "index": "index",
    "indexing": "index",
    "search": "retrieval",
    "retrieve": "retrieval",
    "retrieval": "retrieval",
    "lookup": "retrieval",
}


def language(path: Column) -> Column:
    """The language that a path's extension tells; null for others and for names that are an extension only."""
    table = F.create_map(*[F.lit(x) for item in LANGUAGES.items() for x in item])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1)))


def objects(contents: DataFrame) -> DataFrame:
    """Content-addressed objects: sha, its place (two characters, then the rest), bytes, references. Copies are one object."""
    rows = contents.select(F.sha2("content", 256).alias("sha"), F.octet_length("content").alias("bytes"))
    kept = rows.groupBy("sha").agg(F.first("bytes").alias("bytes"), F.count("*").alias("references"))
    return kept.select("sha", F.concat_ws("/", F.substring("sha", 1, 2), "sha").alias("place"), "bytes", "references")


def object_status(expected: DataFrame, found: DataFrame) -> DataFrame:
    """available, corrupt or missing for each expected sha; ``found`` has (sha, actual)."""
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha"), "corrupt").otherwise("available")
    return expected.join(found, "sha", "left").select("sha", status.alias("status"))


def condensed(text: Column, most: int = 400) -> Column:
    """Text longer than ``most``: its head and tail (two thirds and one third) round a note of what was left out."""
    head, tail = most * 2 // 3, most - most * 2 // 3
    note = F.concat(F.lit("\n[... "), (F.length(text) - most).cast("string"), F.lit(" characters left out ...]\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), note, F.right(text, F.lit(tail))))


def literal_search(contents: DataFrame, key: str, needle: str, most: int, around: int = 300) -> DataFrame:
    """Matches of ``needle`` (either case, not overlapping) in each text: nth from 1, start from 0, and the text round it."""
    low, n = F.translate(F.col("text"), T.UPPER, T.LOWER), len(needle)
    parts = F.split(low, "\\Q" + needle.lower() + "\\E", -1)
    lengths = contents.select(key, "text", F.transform(parts, F.length).alias("skips")).where("size(skips) > 1")
    hits = lengths.select(key, "text", F.posexplode(F.slice("skips", F.lit(1), F.least(F.lit(most), F.size("skips") - 1))).alias("nth", "skip"))
    upto = Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum("skip").over(upto) + F.col("nth") * n).cast("int")
    hits = hits.withColumn("start", start)
    begin = F.greatest(F.lit(0), F.col("start") - around)
    return hits.select(key, (F.col("nth") + 1).alias("nth"), "start", F.substring(F.col("text"), begin + 1, F.col("start") - begin + n + around).alias("excerpt"))


def line_chunks(files: DataFrame, keys: list[str], lines: int = 80, overlap: int = 12, most: int | None = 200) -> DataFrame:
    """Windows of lines that overlap, blank ones left out: keys, start_line, end_line, content, tokens, snippet_id.

    Of the others a text's first ``most`` are kept, or all.
    """
    step = lines - overlap
    split = files.select(*keys, F.split("text", r"\r?\n").alias("all"))
    last = F.greatest(F.lit(0), F.ceil((F.size("all") - lines) / step)).cast("int")
    window = lambda k: F.struct((k * step + 1).alias("start_line"), F.least(F.size("all"), k * step + lines).alias("end_line"), F.array_join(F.slice("all", k * step + 1, F.lit(lines)), "\n").alias("content"))
    windows = F.filter(F.transform(F.sequence(F.lit(0), last), window), lambda w: F.length(F.trim(F.regexp_replace(w["content"], r"[\s]+", ""))) > 0)
    rows = split.select(*keys, F.inline(windows if most is None else F.slice(windows, 1, most)))
    return rows.select("*", (T.text_tokens(F.col("content")) + 48).alias("tokens"), F.sha2(F.concat_ws("\0", *keys, "start_line", "end_line"), 256).alias("snippet_id"))


def stem(word: Column) -> Column:
    n, cut = F.length(word), lambda k: F.substring(word, F.lit(1), F.length(word) - k)
    return F.when((n > 6) & word.endswith("ing"), cut(3)).when((n > 5) & word.endswith("ed"), cut(2)).when((n > 5) & word.endswith("es"), cut(2)).when((n > 4) & word.endswith("s"), cut(1)).otherwise(word)


def canonical(word: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in CONCEPTS.items() for x in item])
    return F.coalesce(F.element_at(table, word), F.element_at(table, stem(word)), stem(word))


def feature_tokens(text: Column, most: int = 20_000) -> Column:
    """Words of two or more letters or digits, camel case and separators split, as stems or concepts."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), r"[_./\\:-]+", " ")
    words = F.filter(F.split(F.lower(apart), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2)
    return F.slice(F.filter(F.transform(words, canonical), lambda w: F.length(w) >= 2), 1, most)


def hashed_features(docs: DataFrame, key: str, dimensions: int = 256) -> DataFrame:
    """(key, bucket, value): a sparse L2-normalised embedding by feature hashing.

    A word counts 1 + ln(tf), each pair of neighbours 0.35; the first 32 bits of the feature's SHA-256 choose the bucket, the parity of
    the next 8 bits its sign. A text without words has the one feature 'empty'; a null text is an empty one. A text's features are added up
    where the text is, so nothing is shuffled.
    """

    def rows(keys: pa.Array, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(bucket), pa.array(value)], [key, "bucket", "value"])

    return hashed(docs, key, dimensions, rows, [StructField("bucket", LongType()), StructField("value", DoubleType())])


def hashed_vectors(docs: DataFrame, key: str, dimensions: int = 256) -> DataFrame:
    """(key, buckets, values): as `hashed_features`, each text in one row and without zeros; buckets ascend."""

    def rows(keys: pa.Array, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        some = value != 0
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[some], minlength=len(keys)))]), pa.int32())
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(ends, pa.array(bucket[some], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value[some]))], [key, "buckets", "values"])

    return hashed(docs, key, dimensions, rows, [StructField("buckets", ArrayType(IntegerType())), StructField("values", ArrayType(DoubleType()))])


#: Words of texts that are hashed together, about: what they take in memory is bounded by that, and not by a number of texts.
WORDS = 100_000


def hashed(docs: DataFrame, key: str, dimensions: int, rows: Callable, fields: list[StructField]) -> DataFrame:
    """What ``rows`` makes of the keys of texts, and of each cell's text, bucket and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, first = batch.column(1).offsets.to_numpy().astype(np.int64), 0
            while first < batch.num_rows:
                upto = min(first + 2000, max(first + 1, int(np.searchsorted(ends, ends[first] + WORDS, "right")) - 1))
                yield embedded(batch.slice(first, upto - first))
                first = upto

    def embedded(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.values.slice(ends[0], ends[-1] - ends[0]))
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        n = max(1, len(names))
        singles, times = np.unique(doc * n + at, return_counts=True)
        beside = doc[1:] == doc[:-1]
        pairs, which = np.unique(at[:-1][beside] * n + at[1:][beside], return_inverse=True)
        places, signs = places_of([f"token:{w}" for w in names] + [f"pair:{names[p // n]}:{names[p % n]}" for p in pairs.tolist()] + ["empty"], dimensions)
        none = np.flatnonzero(np.diff(ends) == 0)
        docs_of = np.concatenate([singles // n, doc[1:][beside], none])
        feature = np.concatenate([singles % n, len(names) + which, np.full(len(none), len(names) + len(pairs))])
        weight = np.concatenate([1 + np.log(times), np.full(len(which), 0.35), np.ones(len(none))])
        cell, back = np.unique(docs_of * dimensions + places[feature], return_inverse=True)
        sums = np.bincount(back, weight * signs[feature], len(cell))
        owner = cell // dimensions
        norm = np.sqrt(np.bincount(owner, sums * sums, batch.num_rows))[owner]
        value = np.divide(sums, norm, out=np.zeros(len(sums)), where=norm > 0)
        return rows(batch.column(0), owner, cell % dimensions, value)

    words = docs.select(key, feature_tokens(F.coalesce("text", F.lit(""))).alias("words"))
    return words.mapInArrow(run, StructType([docs.schema[key], *fields]))


def places_of(features: list[str], dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each feature."""
    heads = np.frombuffer(b"".join(hashlib.sha256(f.encode()).digest()[:5] for f in features), np.uint8).reshape(-1, 5).astype(np.int64)
    return (heads[:, :4] @ np.array([1 << 24, 1 << 16, 1 << 8, 1])) % dimensions, 1.0 - 2.0 * (heads[:, 4] % 2)


def strips(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (first, last) once for each strip of ``width`` lines that they touch."""
    strip = lambda c: F.floor(F.col(c) / width).cast("int")
    return rows.withColumn("strip", F.explode(F.sequence(strip("first"), strip("last"))))


def enclosing(symbols: DataFrame, width: int = 64) -> DataFrame:
    """Each symbol (file, id, first, last) with the smallest other symbol of its file that holds it; null at the top.

    A symbol meets those that touch the strip of ``width`` lines in which it begins, not all of its file.
    """
    outer = strips(symbols, width).select("file", "strip", F.col("id").alias("parent"), F.col("first").alias("f"), F.col("last").alias("l"))
    own = symbols.withColumn("strip", F.floor(F.col("first") / width).cast("int"))
    held = own.join(outer, ["file", "strip"]).where("f <= first and first <= l and last <= l and parent != id and (l - f > last - first or (l - f = last - first and parent < id))")
    best = held.groupBy("file", "id").agg(F.min(F.struct((F.col("l") - F.col("f")).alias("size"), "parent")).alias("best"))
    return symbols.join(best.select("file", "id", F.col("best.parent").alias("parent")), ["file", "id"], "left")


def overlapping(snippets: DataFrame, width: int = 64) -> DataFrame:
    """Pairs (left_id < right_id) of one file whose common lines are at least half of the shorter.

    Pairs meet in the strip of ``width`` lines in which their common lines begin, so each is made once and those apart never.
    """
    near = strips(snippets, width)
    a = near.select("file", "strip", F.col("id").alias("left_id"), F.col("first").alias("f1"), F.col("last").alias("l1"))
    b = near.select("file", "strip", F.col("id").alias("right_id"), F.col("first").alias("f2"), F.col("last").alias("l2"))
    begin = F.greatest("f1", "f2")
    common, shorter = F.least("l1", "l2") - begin + 1, F.least(F.col("l1") - F.col("f1"), F.col("l2") - F.col("f2")) + 1
    pairs = a.join(b, ["file", "strip"]).where((F.col("left_id") < F.col("right_id")) & (F.floor(begin / width) == F.col("strip")))
    return pairs.withColumn("common", common).where(F.col("common") * 2 >= shorter).select("file", "left_id", "right_id", "common")


#: What declares a symbol, for languages without a parser.
DECLARATIONS = (
    r"\b(?:class|interface|enum|namespace|record|struct|trait|type)\s+([A-Za-z_$][\w$]*)",
    r"\b(?:async\s+)?function\s+([A-Za-z_$][\w$]*)",
    r"(?m)^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*[=:]",
    r"(?m)^\s*(?:def|fn|func)\s+([A-Za-z_$][\w$]*)",
)


def declared_symbols(text: Column, most: int = 128) -> Column:
    """Names that a text declares, each once, by kind of declaration and then as they come."""
    return F.slice(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in DECLARATIONS])), 1, most)


def symbol_id(*fields: Column) -> Column:
    return F.sha2(F.array_join(F.array(*[f.cast("string") for f in fields]), "\0"), 256)


def occurrences(text: Column, needle: Column) -> Column:
    """How often ``needle`` occurs in ``text``, without overlaps."""
    return F.floor((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle))


def anchored_span(text: Column, head: Column, tail: Column) -> Column:
    """(first, last, first_line, last_line) from a head to a tail after it; null unless either occurs just once where it is sought."""
    start = F.instr(text, head) - 1
    after = F.substring(text, start + F.length(head) + 1, F.length(text))
    unique = (occurrences(text, head) == 1) & (occurrences(after, tail) == 1)
    end = start + F.length(head) + F.instr(after, tail) - 1 + F.length(tail)
    line = lambda upto: F.length(F.regexp_replace(F.substring(text, F.lit(1), upto), "[^\n]", "")) + 1
    return F.when(unique, F.struct(start.alias("first"), end.alias("last"), line(start).alias("first_line"), line(end - 1).alias("last_line")))
