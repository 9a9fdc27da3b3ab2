"""Session logs: one JSON record a line, appended to files; the first record of a file is its header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.state import upwards

BLOCK = "struct<type: string, text: string, thinking: string, id: string, name: string, arguments: string>"
MESSAGE = "struct<role: string, content: string, toolCallId: string, toolName: string, isError: boolean, command: string, output: string, summary: string, provider: string, model: string, timestamp: string>"
RECORD = (
    "type string, id string, parentId string, timestamp string, cwd string, version int, provider string, modelId string, targetId string, label string, customType string, summary string, name string, content string, "
    f"fromId string, thinkingLevel string, message {MESSAGE}, _malformed string"
)
HEADER_BYTES = 1 << 20
#: Bytes before the last line's end whose hash tells whether a file was only appended to.
HASH_BYTES = 1 << 16
#: The prefix of tools whose calls and results are not indexed, as they quote what is, and (fixed value) the private note of a rebase.
HISTORY_TOOLS, HANDOFF = "history_", "rebase-handoff-v1"
#: Tokens of a message's frame, of each block, and of an image.
FRAME_TOKENS, BLOCK_TOKENS, IMAGE_TOKENS = 8, 4, 1024


def session_files(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """(file, size, mtime, content) of every file below ``path`` whose name is as ``glob`` says. Columns that are not asked for are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")


def listed(files: DataFrame) -> DataFrame:
    """Files by name, the last first, as names begin with their time."""
    return files.select("file", "size", "mtime").orderBy(F.desc("file"))


def range_hash(content: Column, start: Column, end: Column) -> Column:
    """SHA-256 of the bytes from ``start`` up to ``end``; null where the content ends before."""
    return F.when((start >= 0) & (end >= start) & (end <= F.octet_length(content)), F.sha2(F.substring(content, (start + 1).cast("int"), (end - start).cast("int")), 256))


def lines(files: DataFrame) -> DataFrame:
    """file, start, end, raw, raw_hash, terminated of each line that is not blank, from each file's byte ``start`` on.

    Offsets are those of the file's bytes; ``end`` is after the line feed, and a last line without one is not ``terminated``. The hash is
    that of the line's bytes without the line feed.
    """
    # one character a byte, so that lengths are bytes
    shown = F.decode(F.substring(F.col("content"), (F.col("start") + 1).cast("int"), F.octet_length("content")), "ISO-8859-1")
    split = files.select("file", F.col("start").alias("base"), F.posexplode(F.split(shown, "\n", -1)).alias("nth", "line"))
    file = Window.partitionBy("file")
    upto = F.sum(F.length("line") + 1).over(file.orderBy("nth"))
    rows = split.withColumns({"end": F.col("base") + upto, "terminated": F.col("nth") < F.max("nth").over(file)})
    rows = rows.withColumns({"start": F.col("end") - F.length("line") - 1, "bytes": F.encode("line", "ISO-8859-1"), "end": F.when(F.col("terminated"), F.col("end")).otherwise(F.col("end") - 1)})
    rows = rows.select("file", "start", "end", F.make_valid_utf8(F.col("bytes").cast("string")).alias("raw"), F.sha2("bytes", 256).alias("raw_hash"), "terminated")
    return rows.where("length(trim(raw)) > 0")


def checkpoints(files: DataFrame) -> DataFrame:
    """(file, offset, hash_start, hash): the end of each file's last whole line, and the hash of what is right before it.

    The hash covers that line or its last 64 KiB. A file without a line feed has offset 0 and no hash.
    """
    shown = F.decode("content", "ISO-8859-1")
    offset = F.length(shown) - F.length(F.substring_index(shown, "\n", -1))
    rows = files.select("file", "content", F.when(F.contains(shown, F.lit("\n")), offset).otherwise(0).cast("long").alias("offset"))
    before = F.decode(F.substring(F.col("content"), F.lit(1), F.greatest(F.lit(0), F.col("offset") - 1).cast("int")), "ISO-8859-1")
    line_start = F.when(F.contains(before, F.lit("\n")), F.length(before) - F.length(F.substring_index(before, "\n", -1))).otherwise(0)
    rows = rows.withColumn("hash_start", F.greatest(line_start, F.col("offset") - HASH_BYTES, F.lit(0)).cast("long"))
    return rows.select("file", "offset", "hash_start", F.when(F.col("offset") > 0, range_hash(F.col("content"), F.col("hash_start"), F.col("offset"))).alias("hash"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The parsed record of each line that is not blank, with its place; ``malformed`` marks lines that are no JSON object."""
    return parsed(lines(session_files(spark, path).withColumn("start", F.lit(0).cast("long"))))


def parsed(lines: DataFrame) -> DataFrame:
    """``lines`` (raw) with the record ``r`` and ``malformed``."""
    record = F.from_json("raw", RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    rows = lines.withColumn("r", record)
    bad = F.col("r").isNull() | F.col("r._malformed").isNotNull() | ~F.startswith(F.trim("raw"), F.lit("{"))
    return rows.withColumn("malformed", bad)


def headers(records: DataFrame) -> DataFrame:
    """(file, session_id, cwd, version, header_hash) of files whose first record is a header, within the first megabyte."""
    first = records.where(~F.col("malformed")).groupBy("file").agg(F.min_by(F.struct("r", "end", "raw_hash"), "start").alias("f"))
    good = first.where((F.col("f.r.type") == "session") & F.col("f.r.id").isNotNull() & (F.col("f.end") <= HEADER_BYTES))
    return good.select("file", F.col("f.r.id").alias("session_id"), F.col("f.r.cwd").alias("cwd"), F.col("f.r.version").alias("version"), F.col("f.raw_hash").alias("header_hash"))


def is_list(content: Column) -> Column:
    return F.startswith(F.trim(content), F.lit("["))


def blocks_of(content: Column) -> Column:
    """A message's content as blocks; a string is one block of text."""
    text = F.struct(*[(F.lit("text") if k == "type" else content if k == "text" else F.lit(None).cast("string")).alias(k) for k in ("type", "text", "thinking", "id", "name", "arguments")])
    return F.when(is_list(content), F.from_json(content, f"array<{BLOCK}>")).when(content.isNotNull(), F.array(text))


def joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def block_text(content: Column, all_tools: bool = True) -> Column:
    """Text of a message's content: text as it is, of tool calls their name and arguments. Thinking, images and other blocks are not searched."""
    blocks = F.filter(blocks_of(content), lambda b: b["type"].isin("text", "toolCall"))
    if not all_tools:
        blocks = F.filter(blocks, lambda b: (b["type"] == "text") | ~F.coalesce(F.startswith(b["name"], F.lit(HISTORY_TOOLS)), F.lit(False)))
    return joined(F.flatten(F.transform(blocks, lambda b: F.when(b["type"] == "text", F.array(b["text"])).otherwise(F.array(b["name"], b["arguments"])))))


def content_tokens(content: Column) -> Column:
    """Estimated tokens of a message's content: of a string its own; of blocks those of text, thinking, calls or raw JSON, an image's, and each one's frame."""
    typed, raw = F.from_json(content, f"array<{BLOCK}>"), F.from_json(content, "array<string>")
    one = lambda b, j: BLOCK_TOKENS + F.when(b["type"] == "image", IMAGE_TOKENS).when((b["type"] == "text") & b["text"].isNotNull(), T.text_tokens(b["text"])).when((b["type"] == "thinking") & b["thinking"].isNotNull(), T.text_tokens(b["thinking"])).when(b["type"] == "toolCall", T.text_tokens(F.concat(F.coalesce(b["name"], F.lit("")), F.coalesce(b["arguments"], F.lit(""))))).otherwise(T.text_tokens(j))
    total = F.aggregate(F.zip_with(typed, raw, one), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(is_list(content), total).otherwise(T.text_tokens(content))


def message_tokens(message: Column) -> Column:
    fields = [T.text_tokens(message[f]) for f in ("role", "summary", "command", "output", "toolName")]
    return sum(fields, FRAME_TOKENS + content_tokens(message["content"]))


def canonical_role(role: Column) -> Column:
    return F.when(role.isin("system", "user", "assistant"), role).when(role.isin("toolResult", "bashExecution"), "tool").otherwise("custom")


def canonical_blocks(message: Column) -> Column:
    """A provider's message as blocks of one form: (type, text, id, name, arguments, is_error).

    A tool's result is one block of all its text with the call it answers, and its images; a shell run is its command and its output. Blocks of unknown type
    are opaque.
    """
    kind = "array<struct<type:string,text:string,id:string,name:string,arguments:string,is_error:boolean>>"
    block = lambda type_, text=None, id_=None, name=None, args=None, error=None: F.struct(
        type_.alias("type"), *[(F.lit(None).cast("string") if c is None else c).alias(n) for c, n in ((text, "text"), (id_, "id"), (name, "name"), (args, "arguments"))], (F.lit(None).cast("boolean") if error is None else error).alias("is_error")
    )
    own = blocks_of(message["content"])
    known = lambda b: F.when(b["type"].isin("text", "toolCall", "image", "thinking"), b["type"]).otherwise("opaqueProvider")
    plain = F.transform(own, lambda b: block(known(b), F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"]), F.when(b["type"] == "toolCall", F.coalesce(b["id"], F.lit(""))), F.when(b["type"] == "toolCall", F.coalesce(b["name"], F.lit(""))), F.when(b["type"] == "toolCall", b["arguments"])))
    text = F.array_join(F.transform(F.filter(own, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    result = F.array(block(F.lit("toolResult"), F.coalesce(text, F.lit("")), F.coalesce(message["toolCallId"], F.lit("")), F.coalesce(message["toolName"], F.lit("")), None, F.coalesce(message["isError"], F.lit(False))))
    shell = F.array(block(F.lit("text"), F.concat(F.lit("Command: "), F.coalesce(message["command"], F.lit("")))), block(F.lit("text"), F.coalesce(message["output"], F.lit(""))))
    none = F.array().cast(kind)
    images = F.filter(F.coalesce(plain, none), lambda b: b["type"] == "image")
    return F.when(message["role"] == "toolResult", F.concat(result, images)).when(message["role"] == "bashExecution", shell).otherwise(F.coalesce(plain, none)).cast(kind)


def search_text(message: Column) -> Column:
    """What of a message is searched; results and calls of the history tools are not, as they quote what was found before."""
    role, of_history = message["role"], F.coalesce(F.startswith(message["toolName"], F.lit(HISTORY_TOOLS)), F.lit(False))
    text_blocks = F.array_join(F.transform(F.filter(blocks_of(message["content"]), lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n")
    return (
        F.when((role == "toolResult") & of_history, "")
        .when(role == "toolResult", joined(F.array(message["toolName"], text_blocks)))
        .when(role == "bashExecution", joined(F.array(F.concat(F.lit("Command: "), F.coalesce(message["command"], F.lit(""))), message["output"])))
        .when(role == "assistant", block_text(message["content"], all_tools=False))
        .otherwise(block_text(message["content"]))
    )


def valid_entry(r: Column) -> Column:
    return (r["type"] != "session") & r["id"].isNotNull() & r["timestamp"].isNotNull()


def entries(records: DataFrame) -> DataFrame:
    """Indexed entries: file, entry_id, parent_id, created_at (ms), type, role, text, tokens, raw_hash, start, end. Private custom records have no text."""
    r, kind, m = F.col("r"), F.col("r.type"), F.col("r.message")
    text = (
        F.when(kind == "message", search_text(m)).when((kind == "custom_message") & (F.coalesce(r["customType"], F.lit("")) != HANDOFF), block_text(r["content"])).when(kind == "compaction", r["summary"])
        .when(kind == "branch_summary", joined(F.array(r["fromId"], r["summary"]))).when(kind == "model_change", joined(F.array(r["provider"], r["modelId"]))).when(kind == "thinking_level_change", r["thinkingLevel"])
        .when(kind == "label", joined(F.array(r["targetId"], r["label"]))).when(kind == "session_info", r["name"])
    )
    rows = records.where(~F.col("malformed") & valid_entry(r))
    role = F.when(kind == "message", m["role"]).when(kind == "custom_message", "custom").when(kind.isin("compaction", "branch_summary"), "summary")
    own_result = (kind == "message") & (m["role"] == "toolResult") & F.coalesce(F.startswith(m["toolName"], F.lit(HISTORY_TOOLS)), F.lit(False))
    custom = FRAME_TOKENS + T.text_tokens(F.lit("custom")) + content_tokens(r["content"])
    tokens = F.when((kind == "message") & ~own_result, message_tokens(m)).when((kind == "custom_message") & (F.coalesce(r["customType"], F.lit("")) != HANDOFF), custom).otherwise(T.text_tokens(text))
    created = F.unix_millis(F.try_to_timestamp("r.timestamp"))
    return rows.select(
        "file", r["id"].alias("entry_id"), r["parentId"].alias("parent_id"), created.alias("created_at"), kind.alias("type"), role.alias("role"), F.coalesce(text, F.lit("")).alias("text"), tokens.alias("tokens"), "raw_hash", "start", "end",
    )


def active_branch(found: DataFrame, leaf: DataFrame) -> DataFrame:
    """Entries of each file on the way from its leaf (file, entry_id) up to the root, however long."""
    name = lambda c: F.concat_ws("#", "file", c)
    edges = found.where("parent_id is not null").select(name("parent_id").alias("parent"), name("entry_id").alias("child"))
    return found.join(upwards(edges, leaf.select(name("entry_id").alias("node"))), name("entry_id") == F.col("node"), "left_semi")
