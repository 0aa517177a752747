"""Streams against their batch twins."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from deltagrid.plans import views
from deltagrid.streaming import positions, tracks

DIR = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    fixes = views.view(spark, DIR, "g_fix")
    path = str(tmp_path / "fixes")
    fixes.repartition(1).sortWithinPartitions("ts", "event_id").write.parquet(path)
    return fixes, spark.readStream.schema(fixes.schema).parquet(path)


def run(query_name, df, mode, spark):
    q = df.writeStream.outputMode(mode).format("memory").queryName(query_name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(query_name)


def test_chunks(spark, tmp_path):
    fixes, s = stream(spark, tmp_path)
    got = run("chunks", tracks.stream_chunks(s, "user_id", 16), "append", spark)
    twin = tracks.chunks(fixes, "user_id", ["event_id"], 16).groupBy("user_id", "chunk").count().where("count = 16")
    assert got.count() == twin.count() > 0


def test_latest_table(spark, tmp_path):
    fixes, s = stream(spark, tmp_path)
    q = tracks.write_latest(s, str(tmp_path / "latest"), "user_id", ["ts", "event_id"], str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "latest/version=0"))
    twin = tracks.latest(fixes, "user_id", ["ts", "event_id"])
    assert sorted(r["event_id"] for r in got.collect()) == sorted(r["event_id"] for r in twin.collect())


def test_latest_table_rewrites_only_what_a_batch_touches(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "latest")
    write = lambda: once(tracks.write_latest(positions.positions(spark, str(log)), out, "track", ["unix_ms", "seq"], str(tmp_path / "ck"), 8))
    append(log, "a.jsonl", [fix(t, k) for t in range(40) for k in range(3)])
    write()
    append(log, "a.jsonl", [fix(7, 9)])
    write()
    append(log, "a.jsonl", [fix(7, 5), fix(7, 12)])
    write()
    got = tracks.read_latest(spark, out, StructType.fromDDL(positions.FIX))
    assert sorted((r["track"], r["seq"]) for r in got.collect()) == [(t, 12 if t == 7 else 2) for t in range(40)]
    held = {v: [p.name for p in (tmp_path / "latest" / f"version={v}").iterdir() if p.name.startswith("part=")] for v in range(3)}
    assert len(held[0]) in (7, 8) and len(held[1]) == len(held[2]) == 1 and held[1] == held[2]
    assert tracks.read_latest(spark, str(tmp_path / "none"), StructType.fromDDL(positions.FIX)).count() == 0


def test_windows_and_deduplication(spark, tmp_path):
    fixes, s = stream(spark, tmp_path)
    assert run("w", tracks.windows(s, "ts", "1 hour", "1 day"), "complete", spark).groupBy().sum("n").first()[0] == fixes.count()
    assert run("d", tracks.deduplicated(s, "event_id", "ts", "1 hour").select("event_id"), "append", spark).count() == fixes.select("event_id").distinct().count()


# ---- position logs and recorded chunks


def fix(track, seq):
    return {"track": track, "seq": seq, "unix_ms": 1000 * seq, "lat": 47.0, "lon": -122.0, "height_m": None if seq % 5 == 0 else seq + 0.125, "accuracy_m": 4.0, "v_accuracy_m": None, "speed_ms": 700.0 if seq == 3 else 1.25, "bearing_deg": -10.0}


def append(folder, name, fixes, tail=""):
    folder.mkdir(exist_ok=True)
    with open(folder / name, "a") as f:
        f.write("".join(json.dumps(x) + "\n" for x in fixes) + tail)


def once(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


@pytest.mark.parametrize("stretch", [64, 1 << 24])
def test_each_fix_comes_once_over_restarts(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(positions, "STRETCH", stretch)
    log, out = tmp_path / "log", str(tmp_path / "out")
    write = lambda: once(positions.positions(spark, str(log)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")))
    append(log, "a.jsonl", [fix(1, k) for k in range(10)], tail='{"track": 1, "se')  # a line that is still being written
    append(log, "b.jsonl", [fix(2, k) for k in range(3)])
    write()
    assert sorted((r["track"], r["seq"]) for r in spark.read.parquet(out).collect()) == [(1, k) for k in range(10)] + [(2, k) for k in range(3)]
    append(log, "a.jsonl", [], tail='q": 10}\n')
    append(log, "a.jsonl", [fix(1, 11)])
    append(log, "c.jsonl", [fix(3, 0)])
    write()
    write()
    got = spark.read.parquet(out)
    assert sorted((r["track"], r["seq"]) for r in got.collect()) == [(1, k) for k in range(12)] + [(2, k) for k in range(3)] + [(3, 0)]
    assert got.where("track = 1 AND seq = 10").first()["lat"] is None


def test_a_range_of_offsets_is_the_same_lines_again(tmp_path):
    log = tmp_path / "log"
    append(log, "a.jsonl", [fix(1, k) for k in range(50)])
    reader = positions.LogReader(str(log), StructType.fromDDL(positions.FIX))
    first = reader.latestOffset()
    append(log, "a.jsonl", [fix(1, k) for k in range(50, 80)])
    second = reader.latestOffset()
    read = lambda a, b: [r["seq"] for p in reader.partitions(a, b) for batch in reader.read(p) for r in batch.to_pylist()]
    assert read({}, first) == read({}, first) == list(range(50)) and read(first, second) == list(range(50, 80)) and reader.partitions(second, second) == []


def test_recorded_chunks_are_written_once_and_read_back(spark, tmp_path):
    log, out = tmp_path / "log", str(tmp_path / "chunks")
    write = lambda: once(positions.record(positions.stream_recorded(positions.packed(positions.positions(spark, str(log)), F.col("seq") * 7), 4), out, str(tmp_path / "ck")))
    append(log, "a.jsonl", [fix(1, k) for k in range(6)] + [fix(2, k) for k in range(9)])
    write()
    append(log, "a.jsonl", [fix(1, k) for k in range(6, 9)])
    write()
    got = tracks.recorded(positions.committed(spark, out), "track").orderBy("track", "chunk", "n").collect()
    assert [(r["track"], r["chunk"], r["n"], r["coord"], r["unix_ms"]) for r in got] == [(t, k // 4, k % 4, 7 * k, 1000 * k) for t in (1, 2) for k in range(8)]
    assert [r["height_m"] for r in got[:6]] == [None, 1.13, 2.13, 3.13, 4.13, None] and {r["v_accuracy_m"] for r in got} == {None}
    assert got[3]["speed_ms"] == 655.34 and got[0]["speed_ms"] == 1.25 and got[0]["bearing_deg"] == 350.0


def test_the_first_commit_of_an_epoch_stands(spark, tmp_path):
    path = str(tmp_path / "chunks")
    writer = positions.ChunkWriter(path)
    row = {"track": [1], "chunk": [0], **{c: [[1, 2]] for c in positions.COLUMNS}}
    batch = pa.RecordBatch.from_pydict(row)
    first, again = writer.write(iter([batch])), writer.write(iter([batch]))
    lost = writer.write(iter([batch]))
    writer.commit([first, None, writer.write(iter([]))], 7)
    writer.commit([again], 7)
    writer.abort([lost], 8)
    assert positions.committed(spark, path).count() == 1
    assert [p.name for p in (tmp_path / "chunks").iterdir() if p.name.startswith("part")] == [first.name]
    assert positions.committed(spark, str(tmp_path / "none")).count() == 0
