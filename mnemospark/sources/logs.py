"""Append-only logs read by seeking: only the bytes that are asked for are read, and a long file is read by many tasks.

A line belongs to the range of bytes in which it begins, so ranges of one file meet at line feeds whatever their borders are. Files are opened by
pyarrow's file systems (local and mounted folders, hdfs, s3, gcs); of a store that only Spark opens, `sessions.lines` takes whole files.
"""

from __future__ import annotations

import fnmatch
import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from mnemospark.sources.sessions import HASH_BYTES, HEADER_BYTES

#: Bytes of one read, and of the range that one task reads of a file; lines and bytes of a batch; most tasks of a scan.
READ, RANGE, BATCH_LINES, BATCH_BYTES, TASKS = 1 << 16, 64 << 20, 4096, 8 << 20, 20_000
LINE = "file string, start long, end long, raw string, raw_hash string, terminated boolean"
LINES = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("raw", pa.string()), ("raw_hash", pa.string()), ("terminated", pa.bool_())])


def place(uri: str) -> tuple[fs.FileSystem, str]:
    plain = re.sub(r"^file:/+", "/", uri)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """The file, to be read at any place."""
    system, path = place(uri)
    return system.open_input_file(path)


def cut(file, start: int, end: int, size: int, begins: bool) -> Iterator[tuple[int, int, bytes, bool]]:
    """(start, end, bytes, terminated) of the lines that begin in [start, end) of a file of ``size`` bytes.

    ``begins`` says that a line begins at ``start``; else what is left of the line before is passed over. Bytes beyond ``size``, written since the
    file was listed, are left for later.
    """
    pos = at = start if begins else start - 1
    whole, held = begins, []
    file.seek(pos)
    while pos < size and (chunk := file.read(min(READ, size - pos))):
        pos += len(chunk)
        *ended, tail = chunk.split(b"\n")
        for piece in ended:
            held.append(piece)
            line = b"".join(held)
            upto = at + len(line) + 1
            if whole and at < end:
                yield at, upto, line, True
            whole, held, at = True, [], upto
            if at >= end:
                return
        held.append(tail)
        if not whole and pos >= end:  # the next line begins beyond this range
            return
    if whole and at < end and (line := b"".join(held)):
        yield at, at + len(line), line, False


def last_end(file, size: int) -> int:
    """The place after the last line feed, 0 without one; read from the end, as far as needed."""
    upto = size
    while upto > 0:
        low = max(0, upto - READ)
        file.seek(low)
        if (found := file.read(upto - low).rfind(b"\n")) >= 0:
            return low + found + 1
        upto = low
    return 0


def hashed(file, start: int, end: int) -> str | None:
    """SHA-256 of the bytes from ``start`` up to ``end``, None where there are not so many."""
    digest = hashlib.sha256()
    file.seek(start)
    while start < end:
        chunk = file.read(min(READ, end - start))
        if not chunk:
            return None
        digest.update(chunk)
        start += len(chunk)
    return digest.hexdigest()


def checkpoint(file, size: int) -> tuple[int, int, str | None]:
    """(offset, hash_start, hash): the end of the last whole line, and the hash of that line or its last 64 KiB."""
    offset = last_end(file, size)
    if not offset:
        return 0, 0, None
    low = max(0, offset - HASH_BYTES)
    file.seek(low)
    window = file.read(offset - low)
    start = low + window[:-1].rfind(b"\n") + 1  # low itself where the line is longer
    return offset, start, hashlib.sha256(window[start - low :]).hexdigest()


def head(file, size: int) -> tuple[int, int, bytes] | None:
    """The first line that is a JSON object, if it ends within the first megabyte; no more is read than up to its end."""
    for start, end, line, _ in cut(file, 0, HEADER_BYTES, min(size, HEADER_BYTES + 1), True):
        try:
            if isinstance(json.loads(line), dict):
                return start, end, line
        except ValueError:
            continue
    return None


def text(line: bytes) -> str:
    return line.decode("utf-8", "replace")


def batches_of(file: str, found: Iterator[tuple[int, int, bytes, bool]]) -> Iterator[pa.RecordBatch]:
    """Lines that are not blank as batches of bounded size."""
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        start, end, line, terminated = zip(*rows)
        cells = [[file] * len(rows), start, end, [text(x) for x in line], [hashlib.sha256(x).hexdigest() for x in line], terminated]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, LINES)], schema=LINES)

    for row in found:
        if row[2].strip(b" "):
            rows.append(row)
            held += len(row[2])
            if len(rows) == BATCH_LINES or held >= BATCH_BYTES:
                yield out()
                rows, held = [], 0
    if rows:
        yield out()


def each(rows: DataFrame, schema: str, look: Callable, columns: list[str]) -> DataFrame:
    """``look(file, *cells)`` for each of ``rows`` (file and ``columns``) that has a file there; its tuples, or nothing for None."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    with opened(row["file"]) as file:
                        got = look(file, *(row[c] for c in columns))
                except FileNotFoundError:
                    got = None
                if got is not None:
                    out.append((row["file"], *got))
            kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
            types = [kinds[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    return rows.select("file", *columns).mapInArrow(run, schema)


def heads(files: DataFrame) -> DataFrame:
    """The first record's line of each of ``files`` (file, size), in the columns of `lines`."""

    def look(file, size: int):
        found = head(file, size)
        return found and (found[0], found[1], text(found[2]), hashlib.sha256(found[2]).hexdigest(), True)

    return each(files, LINE, look, ["size"])


def range_hashes(ranges: DataFrame) -> DataFrame:
    """(file, hash) of each of ``ranges`` (file, start, end); null where the file ends before."""
    return each(ranges, "file string, hash string", lambda file, start, end: (None if start is None or not 0 <= start <= end else hashed(file, start, end),), ["start", "end"])


def checkpoints(files: DataFrame) -> DataFrame:
    """(file, offset, hash_start, hash) of each of ``files`` (file, size)."""
    return each(files, "file string, offset long, hash_start long, hash string", checkpoint, ["size"])


def lines(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """file, start, end, raw, raw_hash, terminated of each line that is not blank, from each file's ``start`` on.

    ``files`` (file, start, size): a line begins at ``start``, and ``size`` bytes are there. Ranges of ``range_bytes`` are dealt over tasks.
    """
    step = F.lit(range_bytes)
    left = F.col("size") - F.col("start")
    total = files.agg(F.sum(F.ceil(left / step)).alias("ranges"), F.sum(left).alias("bytes")).first()
    # ranges may be far smaller than what is worth a task
    tasks = min(total.ranges or 1, max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total.bytes or 0) // RANGE), TASKS)
    ranges = files.where("size > start").select("file", "start", "size", F.explode(F.sequence("start", F.col("size") - 1, step)).alias("from"))
    ranges = ranges.select("file", "from", F.least("size", F.col("from") + step).alias("to"), "size", (F.col("from") == F.col("start")).alias("begins"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["file"]) as file:
                    yield from batches_of(row["file"], cut(file, row["from"], row["to"], row["size"], row["begins"]))

    return ranges.repartition(max(1, int(tasks)), "file", "from").mapInArrow(run, LINE)


def originals(wanted: DataFrame) -> DataFrame:
    """``wanted`` (file, start, end, raw_hash, any other) with the line as it stands in its file now, and its status: ok, changed or missing.

    Only the line's own bytes are read. It is given out only if they still have the hash that was indexed.
    """
    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = functools.lru_cache(16)(opened)
        for batch in batches:
            raw, status = [], []
            for file, start, end, known in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "end", "raw_hash"))):
                try:
                    source = held(file)
                    source.seek(start)
                    line = source.read(end - start).removesuffix(b"\n")
                except FileNotFoundError:
                    raw.append(None), status.append("missing")
                    continue
                same = hashlib.sha256(line).hexdigest() == known
                raw.append(text(line) if same else None), status.append("ok" if same else "changed")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.string()), pa.array(status, pa.string())], [*names, "raw", "status"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.sortWithinPartitions("file", "start").mapInArrow(run, f"{kinds}, raw string, status string")


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch; Python has the cells of one row at a time, as a batch may hold thousands of whole files."""
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


def write_logs(rows: DataFrame) -> DataFrame:
    """Write each of ``rows`` (file, lines) as one file, in place of what is there; (file, size) once it is there.

    A task that runs again writes the same bytes to the same place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for row in one_by_one(batch):
                body = "".join(row["lines"]).encode()
                system, path = place(row["file"])
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(body)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sizes, pa.int64())], ["file", "size"])

    return rows.select("file", "lines").mapInArrow(run, "file string, size long")


class Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, size: int, begins: bool):
        self.file, self.start, self.end, self.size, self.begins = file, start, end, size, begins


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    with opened(part.file) as file:
        yield from batches_of(part.file, cut(file, part.start, part.end, part.size, part.begins))


class Listing:
    """Files below a path, and ranges of them, for both readers."""

    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.step = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def sizes(self) -> dict[str, int]:
        system, path = place(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return {prefix + i.path: i.size for i in found if i.is_file and fnmatch.fnmatch(i.base_name, self.glob)}

    def ranges(self, file: str, start: int, end: int) -> list[Range]:
        return [Range(file, k, min(end, k + self.step), end, k == start) for k in range(start, end, self.step)]


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.listing = Listing(options)

    def partitions(self) -> list[Range]:
        return [r for file, size in sorted(self.listing.sizes().items()) for r in self.listing.ranges(file, 0, size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if isinstance(partition, Range) else iter(())


class LogStreamReader(DataSourceStreamReader):
    """A stream's offset is the end of the last whole line of each file, so a line that is still being written waits for its end."""

    def __init__(self, options: dict):
        self.listing = Listing(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for name, size in self.listing.sizes().items():
            with opened(name) as file:
                out[name] = last_end(file, size)
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        # a file that became shorter is another one
        begun = {f: start.get(f, 0) if start.get(f, 0) <= upto else 0 for f, upto in end.items()}
        return [r for f, upto in sorted(end.items()) for r in self.listing.ranges(f, begun[f], upto)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if isinstance(partition, Range) else iter(())


class SessionLog(DataSource):
    """``spark.read`` and ``spark.readStream`` ``.format("session_log")``: lines of the files below ``path``; options glob and rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "session_log"

    def schema(self) -> str:
        return LINE

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionLog)
