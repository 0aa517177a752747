"""Position fixes as a stream, and recorded tracks as a sink: two data sources.

`position_log` reads a folder of line-oriented JSON files to which receivers append. Its offset is the place after the last
whole line of each file, so a range of offsets is the same lines whenever it is read again: a query that was stopped goes on
where it ended, and a batch that is run again sees what it saw. A task reads a stretch of a file.

`track_chunks` writes rows as Parquet files of names of their own and commits them by a small file for the epoch, which names
them. The first commit of an epoch stands: what a second attempt wrote is deleted, so a batch that is run twice leaves its
chunks once. Readers take only files that a commit names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.files import File

FIX = "track bigint, seq bigint, unix_ms bigint, lat double, lon double, height_m double, accuracy_m double, v_accuracy_m double, speed_ms double, bearing_deg double"
#: Bytes of a file that one task reads.
STRETCH = 16 << 20
_TAIL = 1 << 16
COLUMNS = ("coord", "ms", "height", "accuracy", "vaccuracy", "speed", "bearing")
#: What stands for no height, and for no other number.
NO_HEIGHT, NONE16 = -(2**31), 65535


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path)


@dataclass
class Stretch(InputPartition):
    path: str
    begin: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        system, root = _system(self.path)
        out = {}
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(".jsonl"):
                with system.open_input_file(f.path) as handle:
                    end = handle.size()
                    while end > 0:  # back to the last line end
                        start = max(0, end - _TAIL)
                        k = handle.read_at(end - start, start).rfind(b"\n")
                        end = start + k + 1 if k >= 0 else start
                        if k >= 0:
                            break
                if end:
                    out[f.base_name] = end
        return out

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for name, upto in sorted(end.items()):
            for begin in range(start.get(name, 0), upto, STRETCH):
                out.append(Stretch(f"{self.path}/{name}", begin, min(begin + STRETCH, upto)))
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the stretch. Where an offset of a file was set, a line begins."""
        arrow = to_arrow_schema(self.schema)
        with File(partition.path) as f:
            begin, data = partition.begin, f.at(partition.begin, partition.end - partition.begin)
            if begin and f.at(begin - 1, 1) != b"\n":
                k = data.find(b"\n")
                data = data[k + 1 :] if k >= 0 else b""
            at = partition.end
            while data and not data.endswith(b"\n") and at < f.size:  # the last line ends in the next stretch
                more = f.at(at, min(_TAIL, f.size - at))
                k = more.find(b"\n")
                data, at = data + (more if k < 0 else more[: k + 1]), at + len(more)
                if k >= 0:
                    break
        rows = [json.loads(x) for x in data.splitlines() if x.strip()]
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    def commit(self, end: dict) -> None:
        pass


class PositionLog(DataSource):
    """Format position_log: option path."""

    @classmethod
    def name(cls) -> str:
        return "position_log"

    def schema(self) -> str:
        return FIX

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], schema)


def positions(spark: SparkSession, path: str) -> DataFrame:
    """Streaming: the fixes that receivers append to the files of a folder."""
    spark.dataSource.register(PositionLog)
    return spark.readStream.format("position_log").option("path", path).load()


# ---- chunks


def _packed(value: Column, none: int) -> Column:
    """Hundredths in 16 bits."""
    return F.when(value.isNotNull(), F.least(F.greatest(F.round(value * 100), F.lit(0)), F.lit(65534)).cast("bigint")).otherwise(none)


def packed(fixes: DataFrame, coord: Column) -> DataFrame:
    """(track, seq, coord, ms, height, accuracy, vaccuracy, speed, bearing): fixes in whole numbers, as chunks hold them."""
    bearing = F.coalesce((F.round(F.pmod(F.col("bearing_deg"), F.lit(360.0)) * 100) % 36000).cast("bigint"), F.lit(NONE16).cast("bigint"))
    height = F.coalesce(F.round(F.col("height_m") * 100).cast("bigint"), F.lit(NO_HEIGHT).cast("bigint"))
    return fixes.select("track", "seq", coord.cast("bigint").alias("coord"), F.col("unix_ms").alias("ms"), height.alias("height"), _packed(F.col("accuracy_m"), NONE16).alias("accuracy"), _packed(F.col("v_accuracy_m"), NONE16).alias("vaccuracy"), _packed(F.col("speed_ms"), NONE16).alias("speed"), bearing.alias("bearing"))


def stream_recorded(fixes: DataFrame, size: int = 64, idle: str | None = None) -> DataFrame:
    """Streaming: (track, chunk, coord, ms, height, accuracy, vaccuracy, speed, bearing) of each full chunk of packed fixes, as arrays in the order of seq. With `idle` (milliseconds as text), a track without fixes for so long ends its chunk early. State is one chunk a track."""
    lists = ", ".join(f"{c} array<bigint>" for c in COLUMNS)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chunk, *held = state.get if state.exists else (0, *([] for _ in COLUMNS))
        held, out = [list(h) for h in held], []
        if state.hasTimedOut:
            if held[0]:
                out.append((key[0], chunk, *held))
                chunk, held = chunk + 1, [[] for _ in COLUMNS]
        else:
            for b in batches:
                b = b.sort_values("seq", kind="stable")
                for h, c in zip(held, COLUMNS, strict=True):
                    h += b[c].tolist()
            while len(held[0]) >= size:
                out.append((key[0], chunk, *(h[:size] for h in held)))
                chunk, held = chunk + 1, [h[size:] for h in held]
        state.update((chunk, *held))
        if idle and held[0]:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(out, columns=["track", "chunk", *COLUMNS])

    return fixes.groupBy("track").applyInPandasWithState(step, f"track bigint, chunk bigint, {lists}", f"chunk bigint, {lists}", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ChunkWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, root = _system(self.path)
        name, out, rows, handle = f"part-{uuid.uuid4().hex}.parquet", None, 0, None
        for batch in iterator:
            if batch.num_rows:
                if out is None:
                    system.create_dir(root, recursive=True)
                    handle = system.open_output_stream(f"{root}/{name}")
                    out = pq.ParquetWriter(handle, batch.schema)
                out.write_batch(batch)
                rows += batch.num_rows
        if out is None:
            return Part("", 0)
        out.close()
        handle.close()
        return Part(name, rows)

    def _delete(self, messages: list[Part | None]) -> None:
        system, root = _system(self.path)
        for m in messages:
            if m and m.name:
                system.delete_file(f"{root}/{m.name}")

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        system, root = _system(self.path)
        epoch = f"{root}/_epochs/{batchId:012d}.json"
        if system.get_file_info(epoch).type != fs.FileType.NotFound:
            self._delete(messages)
            return
        system.create_dir(f"{root}/_epochs", recursive=True)
        aside = f"{epoch}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(json.dumps([[m.name, m.rows] for m in messages if m and m.name]).encode())
        system.move(aside, epoch)  # whole or not at all

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        self._delete(messages)


class TrackChunks(DataSource):
    """Format track_chunks, a streaming sink: option path."""

    @classmethod
    def name(cls) -> str:
        return "track_chunks"

    def schema(self) -> str:
        return "track bigint, chunk bigint, " + ", ".join(f"{c} array<bigint>" for c in COLUMNS)

    def streamWriter(self, schema: StructType, overwrite: bool) -> ChunkWriter:
        return ChunkWriter(self.options["path"])


def record(chunks: DataFrame, path: str, checkpoint: str):
    """Streaming: writes chunks to a folder, each once."""
    chunks.sparkSession.dataSource.register(TrackChunks)
    return chunks.writeStream.format("track_chunks").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that commits name, for `tracks.recorded`."""
    system, root = _system(path.rstrip("/"))
    names = []
    for f in system.get_file_info(fs.FileSelector(f"{root}/_epochs", allow_not_found=True)):
        if f.path.endswith(".json"):
            with system.open_input_stream(f.path) as s:
                names += [f"{path.rstrip('/')}/{n}" for n, _ in json.loads(s.read())]
    schema = StructType.fromDDL(TrackChunks({}).schema())
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)
