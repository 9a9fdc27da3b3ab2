import hashlib
import io
import json
import random

import pytest

from mnemospark.sources import logs
from mnemospark.streaming import ingest as I

HEADER = {"type": "session", "version": 3, "id": "s1", "timestamp": "2026-01-01T00:00:00Z", "cwd": "/w"}


def entry(k, session_text="hello"):
    return json.dumps({"type": "message", "id": str(k), "parentId": None, "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "user", "content": f"{session_text} {k} é"}}, ensure_ascii=False)


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def whole(body):
    at, out = 0, []
    for line in body.split(b"\n"):
        end = at + len(line) + 1
        if line or end <= len(body):
            out.append((at, min(end, len(body)), line, end <= len(body)))
        at = end
    return out


def test_ranges_meet_at_line_feeds_whatever_their_borders(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(logs, "READ", 7)
    for _ in range(60):
        body = b"\n".join(bytes(r.choices(b"ab {}", k=r.choice([0, 1, 3, 12, 40]))) for _ in range(r.randint(0, 12)))
        for step in (1, 3, 10, 100):
            got = [x for k in range(0, len(body), step) for x in logs.cut(io.BytesIO(body), k, min(len(body), k + step), len(body), k == 0)]
            assert got == [x for x in whole(body) if x[0] < len(body)]
        offset, start, digest = logs.checkpoint(io.BytesIO(body), len(body))
        assert offset == body.rfind(b"\n") + 1
        if offset:
            assert start == body[: offset - 1].rfind(b"\n") + 1 and digest == hashlib.sha256(body[start:offset]).hexdigest()


def test_little_is_read_of_a_long_log():
    line = b'{"type": "session"}\n'
    file = Counted(line + b"x" * 30_000_000 + b"\n" + b"y" * 200_000 + b"\n" + b"open line")
    assert logs.head(file, len(file.getvalue()))[2] == line[:-1] and file.read_bytes <= logs.READ
    file.read_bytes = 0
    offset, start, digest = logs.checkpoint(file, len(file.getvalue()))
    assert offset == len(file.getvalue()) - 9 and start == offset - logs.HASH_BYTES and file.read_bytes <= 2 * logs.READ
    file.read_bytes = 0
    assert logs.hashed(file, start, offset) == digest and file.read_bytes == logs.HASH_BYTES
    file.read_bytes = 0  # a range within a long line ends there
    assert not list(logs.cut(file, 5_000_000, 6_000_000, len(file.getvalue()), False)) and file.read_bytes < 1_200_000


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "logs"
    d.mkdir()
    (d / "a.jsonl").write_text("\n".join([json.dumps(HEADER), *map(entry, range(500))]) + "\n", encoding="utf-8")
    return d


def test_a_file_is_read_by_many_tasks(spark, folder):
    path = folder / "a.jsonl"
    size = path.stat().st_size
    files = spark.createDataFrame([(str(path), 0, size)], "file string, start long, size long")
    found = logs.lines(files, 2000)
    got = sorted((r.start, r.end, r.raw.encode(), r.terminated) for r in found.collect())
    assert got == whole(path.read_bytes()) and found.rdd.getNumPartitions() == -(-size // 2000)
    logs.register(spark)
    again = spark.read.format("session_log").option("path", str(folder)).option("rangeBytes", 3000).load()
    assert again.rdd.getNumPartitions() == -(-size // 3000)
    assert sorted((r.start, r.end, r.raw.encode(), r.terminated) for r in again.collect()) == got


def test_a_stream_gives_each_whole_line_once(spark, folder, tmp_path):
    logs.register(spark)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        stream = spark.readStream.format("session_log").option("path", str(folder)).option("rangeBytes", 5000).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.start for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 501
    with open(folder / "a.jsonl", "a") as f:
        f.write(entry(500) + "\n" + entry(501)[:20])  # a line that is still being written
    assert run() == first + [(folder / "a.jsonl").stat().st_size - 20 - len(entry(500).encode()) - 1]
    with open(folder / "a.jsonl", "a") as f:
        f.write(entry(501)[20:] + "\n")
    found = run()
    assert len(found) == len(set(found)) == 503


def test_a_killed_batch_leaves_every_entry_once(spark, folder, tmp_path, monkeypatch):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "c")
    real, left = logs.checkpoints, [1]

    def killed(files):
        if left:
            left.pop()
            raise RuntimeError("killed after the entries were written")
        return real(files)

    monkeypatch.setattr(logs, "checkpoints", killed)
    with pytest.raises(Exception, match="killed"):
        I.follow(spark, str(folder), target, checkpoint).awaitTermination()
    assert (tmp_path / "t" / "entries" / "run=1").exists() and I.indexed(spark, target).count() == 0
    with open(folder / "a.jsonl", "a") as f:
        f.write(entry(500) + "\n")
    for _ in range(2):
        I.follow(spark, str(folder), target, checkpoint).awaitTermination()
    ids = [r.entry_id for r in I.indexed(spark, target).collect()]
    assert sorted(ids, key=int) == [str(k) for k in range(501)]


def test_runs_are_written_together_after_some(spark, folder, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    monkeypatch.setattr(I, "RUNS", 2)
    for k in range(500, 504):
        I.ingest(spark, str(folder), target)
        with open(folder / "a.jsonl", "a") as f:
            f.write(entry(k) + "\n")
    state = I.ingest(spark, str(folder), target).collect()
    assert [(r.action, r.entries, r.generation) for r in state] == [("append", 504, 1)] and I.indexed(spark, target).count() == 504
    assert state[0].base > 1 and not (tmp_path / "t" / "entries" / "run=1").exists()


def test_rows_of_a_batch_are_made_one_by_one():
    import pyarrow as pa

    from mnemospark.sources import logs

    class Counted:
        made, num_rows = 0, 3

        def slice(self, k, n):
            Counted.made += n
            return pa.RecordBatch.from_pylist([{"file": f"f{j}", "lines": ["a\n"]} for j in range(k, k + n)])

    rows = logs.one_by_one(Counted())
    assert next(rows) == {"file": "f0", "lines": ["a\n"]} and Counted.made == 1
    assert [r["file"] for r in rows] == ["f1", "f2"]


def test_small_ranges_share_tasks(spark, tmp_path):
    from mnemospark.sources import logs

    (tmp_path / "a.jsonl").write_bytes(b"line\n" * 2000)
    files = spark.createDataFrame([(str(tmp_path / "a.jsonl"), 0, 10_000)], "file string, start long, size long")
    found = logs.lines(files, 20)
    assert found.rdd.getNumPartitions() <= 4 and found.count() == 2000 and found.select("start").distinct().count() == 2000
