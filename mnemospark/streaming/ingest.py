"""Incremental ingestion of session logs and stateful operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark.operators.state import sync_decision
from mnemospark.sources import logs, sessions
from mnemospark.storage import drop_path, exists, materialize

STATE = (
    "session_id string, file string, cwd string, header_hash string, size long, mtime long, offset long, hash_start long, hash string, "
    "generation int, entries long, malformed long, status string, action string, reason string, base int"
)
#: Entries lie in folders by a hash of their session, so that a run reads only those of the sessions that it changes; runs between two that write all entries together.
BUCKETS, RUNS = 16, 16
ENTRY = "session_id string, generation int, file string, entry_id string, parent_id string, created_at long, type string, role string, text string, tokens long, raw_hash string, start long, end long"


def last_run(spark: SparkSession, target: str) -> int:
    """The number of the last run that was finished; 0 before the first. A run is finished once its states are written."""
    path = f"{target}/states"
    if not exists(spark, path):
        return 0
    folders = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = folders.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folders)
    return max((int(f.getPath().getName().split("=")[1]) for f in found if exists(spark, f"{f.getPath()}/_SUCCESS")), default=0)


def states(spark: SparkSession, target: str) -> DataFrame:
    """What the last finished run knew of each session."""
    run = last_run(spark, target)
    return spark.read.schema(STATE).parquet(f"{target}/states/run={run}") if run else spark.createDataFrame([], STATE)


def base(known: DataFrame) -> int:
    """The run from which on entries are to be read: the last that wrote all of them together."""
    return known.agg(F.max("base")).first()[0] or 1


def bucket(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


def indexed(spark: SparkSession, target: str, sessions_of: DataFrame | None = None) -> DataFrame:
    """The entries of each session's present generation, from finished runs only; where ``sessions_of`` (session_id) is given, only what lies with theirs."""
    run = last_run(spark, target)
    if not run:
        return spark.createDataFrame([], ENTRY)
    known = states(spark, target)
    rows = spark.read.schema(ENTRY + ", run int, bucket int").parquet(f"{target}/entries").where(F.col("run").between(base(known), run))
    if sessions_of is not None:
        rows = rows.where(F.col("bucket").isin([r[0] for r in sessions_of.select(bucket(F.col("session_id"))).distinct().collect()]))  # at most BUCKETS
    return rows.drop("run", "bucket").join(known.select("session_id", "generation"), ["session_id", "generation"], "left_semi")


def put_entries(rows: DataFrame, target: str, run: int) -> None:
    rows = rows.select(*[c.split()[0] for c in ENTRY.split(", ")]).withColumn("bucket", bucket(F.col("session_id")))
    rows.repartition("bucket", "session_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/entries/run={run}")


def compact(spark: SparkSession, target: str) -> None:
    """A run of its own that writes all present entries together; what runs before it wrote is dropped once it is finished."""
    run, known = last_run(spark, target), states(spark, target)
    first = base(known)
    put_entries(indexed(spark, target), target, run + 1)
    known.withColumn("base", F.lit(run + 1)).write.mode("overwrite").parquet(f"{target}/states/run={run + 1}")
    for old in range(first, run + 1):
        drop_path(spark, f"{target}/entries/run={old}")
        drop_path(spark, f"{target}/states/run={old}")


def ingest(spark: SparkSession, path: str, target: str, force: bool = False, glob: str = "*.jsonl") -> DataFrame:
    """Bring what is new in the session files below ``path`` into the index at ``target``; the new states.

    Of each file the head is read up to its first record, and the at most 64 KiB before the known end; of one that was only appended to what
    comes after, by ranges over many tasks. One that changed in any other way is read anew, as
    a new generation of its session. An appended entry that is known with the same bytes is left alone; one that is known with others makes its
    session be read anew. A file whose first record is no header, or that repeats an id or has an invalid entry when it is read anew, is corrupt: the session stays
    as it was. A session whose file is gone is missing and stays too. The run's entries are written first and its states last, each in place of
    what a failed run of the same number left, so every entry counts once. After ``RUNS`` runs all entries are written together.
    """
    run = last_run(spark, target) + 1
    old = states(spark, target)
    first_run = base(old)
    if run - first_run >= RUNS:
        compact(spark, target)
        run, old, first_run = run + 1, states(spark, target), run
    # sizes are those of now, whatever is appended meanwhile
    files = materialize(sessions.session_files(spark, path, glob).drop("content"), "listed")
    heads = sessions.headers(sessions.parsed(logs.heads(files)))
    # of two files with one session the last by name counts
    heads = heads.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("file")))).where("nth = 1").drop("nth")
    had = old.select("session_id", *[F.col(c).alias(f"old_{c}") for c in ("file", "header_hash", "size", "mtime", "offset", "hash_start", "hash", "generation", "entries", "malformed")], (F.col("generation").isNotNull()).alias("old_located"))
    both = materialize(heads.join(files, "file").join(had, "session_id", "left"), "heads")
    before_end = logs.range_hashes(both.where("old_offset is not null").select("file", F.col("old_hash_start").alias("start"), F.col("old_offset").alias("end")))
    asked = both.join(before_end.withColumnRenamed("hash", "prefix_hash"), "file", "left")
    asked = asked.select(F.col("session_id").alias("session"), F.col("file").alias("path"), "header_hash", "size", "mtime", "prefix_hash")
    known = had.select(F.col("session_id").alias("session"), F.col("old_file").alias("old_path"), "old_header_hash", "old_size", "old_mtime", "old_offset", "old_hash", "old_located").where("old_located")
    decided = materialize(sync_decision(asked, known, force).withColumnRenamed("session", "session_id"), "decided")

    def read(chosen: DataFrame) -> DataFrame:
        """Records of the chosen sessions (session_id, action) from where their action begins."""
        start = F.when(F.col("action") == "append", F.col("old_offset")).otherwise(0).cast("long")
        rows = chosen.where("action != 'noop'").join(both.select("session_id", "file", "size", "old_offset"), "session_id").withColumn("start", start)
        records = sessions.parsed(logs.lines(rows.select("file", "start", "size")))
        return records.join(rows.select("file", "session_id", "action"), "file")

    first = materialize(read(decided), "records")
    before = indexed(spark, target, decided.where("action = 'append'"))
    # entries appended under an id that is known
    appended = first.where("action = 'append' and not malformed").where(sessions.valid_entry(F.col("r"))).select("session_id", F.col("r.id").alias("entry_id"), "raw_hash")
    clash = appended.join(before.select("session_id", "entry_id", F.col("raw_hash").alias("known")), ["session_id", "entry_id"])
    changed = clash.where("raw_hash != known").select("session_id").distinct().withColumn("changed", F.lit(True))
    decided = decided.join(changed, "session_id", "left").select("session_id", F.when(F.col("changed"), "rebuild").otherwise(F.col("action")).alias("action"), F.when(F.col("changed"), "entry-changed").otherwise(F.col("reason")).alias("reason"))
    decided = materialize(decided, "decided")
    records = first.drop("action").join(decided.select("session_id", "action", "reason"), "session_id")
    records = records.where("not reason <=> 'entry-changed'").drop("reason").unionByName(read(decided.where("reason = 'entry-changed'").select("session_id", "action")))
    records = materialize(records, "records")
    # a session that is read anew has to be sound as a whole
    r = F.col("r")
    rebuilt = records.where("action = 'rebuild' and not malformed and r.type <=> 'session' = false")
    broken = rebuilt.where(~F.coalesce(sessions.valid_entry(r), F.lit(False))).select("session_id").union(rebuilt.groupBy("session_id", r["id"].alias("id")).count().where("count > 1").select("session_id")).distinct()
    broken = materialize(broken, "broken")
    sound = records.join(broken, "session_id", "left_anti")
    found = sessions.entries(sound).join(sound.select("file", "session_id", "action").distinct(), "file")
    generation = both.select("session_id", F.coalesce("old_generation", F.lit(0)).alias("old_generation"))
    found = found.join(generation, "session_id").withColumn("generation", F.when(F.col("action") == "rebuild", F.col("old_generation") + 1).otherwise(F.col("old_generation")))
    unchanged = before.select("session_id", "generation", "entry_id")
    new = found.join(unchanged, ["session_id", "generation", "entry_id"], "left_anti").dropDuplicates(["session_id", "generation", "entry_id"])
    put_entries(new, target, run)

    written_rows = spark.read.schema(ENTRY).parquet(f"{target}/entries/run={run}").groupBy("session_id").agg(F.count("*").alias("added"))
    bad = records.where("malformed").groupBy("session_id").agg(F.count("*").alias("bad"))
    marked = decided.join(broken.withColumn("broken", F.lit(True)), "session_id", "left").withColumn("broken", F.coalesce("broken", F.lit(False)))
    ends = logs.checkpoints(both.join(marked.where("action != 'noop' and not broken"), "session_id", "left_semi"))
    rows = both.join(marked, "session_id").join(ends, "file", "left").join(written_rows, "session_id", "left").join(bad, "session_id", "left")
    fresh, kept = F.col("action") == "rebuild", F.coalesce("old_entries", F.lit(0))
    now = lambda c: F.when(F.col("action") == "noop", F.col(f"old_{c}")).otherwise(F.col(c)).alias(c)
    state = rows.where("not broken").select(
        "session_id", "file", "cwd", "header_hash", "size", "mtime", now("offset"), now("hash_start"), now("hash"),
        (F.coalesce("old_generation", F.lit(0)) + fresh.cast("int")).alias("generation"), (F.coalesce("added", F.lit(0)) + F.when(fresh, 0).otherwise(kept)).alias("entries"),
        (F.coalesce("bad", F.lit(0)) + F.when(fresh, 0).otherwise(F.coalesce("old_malformed", F.lit(0)))).alias("malformed"), F.lit("ready").alias("status"), "action", "reason", F.lit(first_run).alias("base"),
    )
    state = materialize(state, "states")
    rest = old.join(state.select("session_id"), "session_id", "left_anti").join(rows.where("broken").select("session_id", F.lit(True).alias("broken"), F.col("reason").alias("why")), "session_id", "left")
    rest = rest.withColumns({"status": F.when(F.col("broken"), "corrupt").otherwise("missing"), "action": F.lit("kept"), "reason": F.col("why")}).drop("broken", "why")
    state.unionByName(rest).write.mode("overwrite").parquet(f"{target}/states/run={run}")
    return states(spark, target)


def follow(spark: SparkSession, path: str, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Ingest whenever the stream of session logs has new whole lines; ``trigger`` as in `DataStreamWriter.trigger`.

    A batch brings the index to what the files hold then. A run that was killed is not finished, and the batch that is tried again makes
    it anew under its number, so every entry is there once.
    """
    logs.register(spark)
    lines = spark.readStream.format("session_log").option("path", path).load()
    step = lambda batch, nth: ingest(batch.sparkSession, path, target)
    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Extension: counts by event-time window and type, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def hysteresis(decisions: DataFrame, losses: int = 2) -> DataFrame:
    """(session, at, extended): a tail that is extended by a win and given up only after ``losses`` losses in a row.

    ``decisions`` (session, at, win) may be a stream; the state of a session is its flag and its run of losses. Rows of one
    trigger are taken in order of ``at``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        extended, run = state.get if state.exists else (False, 0)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for at, win in zip(rows["at"], rows["win"]):
            run = 0 if win else run + 1
            extended = True if win else extended and run < losses
            out.append((key[0], at, extended))
        state.update((extended, run))
        yield pd.DataFrame(out, columns=["session", "at", "extended"])

    return decisions.groupBy("session").applyInPandasWithState(step, "session long, at long, extended boolean", "extended boolean, run int", "append", "NoTimeout")
