"""Fixes of a track: chunks of a count, the latest, sessions, windows. Functions marked as streaming take a streaming DataFrame; the others are batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def chunks(fixes: DataFrame, track: str, order: list[str], size: int = 64) -> DataFrame:
    """fixes with chunk: the track's fixes in order, so many a chunk."""
    n = F.row_number().over(Window.partitionBy(track).orderBy(*order)) - 1
    return fixes.withColumn("chunk", F.floor(n / size))


def latest(fixes: DataFrame, track: str, order: list[str]) -> DataFrame:
    """Each track's last fix; works on streams in update mode."""
    others = [c for c in fixes.columns if c != track]
    return fixes.groupBy(track).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_l")).select(track, "_l.*")


def sessions(fixes: DataFrame, track: str, ts: str, gap: str) -> DataFrame:
    """Fixes without a gap of so long; works on streams with a watermark."""
    g = fixes.groupBy(track, F.session_window(ts, gap).alias("_w")).agg(F.count("*").alias("fixes"))
    return g.select(track, F.col("_w.start").alias("begun"), "fixes")


def _timed(fixes: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return fixes.withColumn(ts, F.col(ts).cast("timestamp"))


def windows(fixes: DataFrame, ts: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """Streaming: fixes and tracks by time window, events up to `late` behind."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return _timed(fixes, ts).withWatermark(ts, late).groupBy(w.alias("_w"), "event_type").agg(F.count("*").alias("n"), F.avg("accuracy").alias("accuracy")).select(F.col("_w.start").alias("begun"), "event_type", "n", "accuracy")


def deduplicated(fixes: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Streaming: each key once within the watermark."""
    return _timed(fixes, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def stream_chunks(fixes: DataFrame, track: str, size: int = 64, order: str = "event_id") -> DataFrame:
    """Streaming: (track, chunk, first, last, n) of each full chunk, by an integer that orders fixes. State is one short list and a counter a track."""
    key = fixes.schema[track].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chunk, held = state.get if state.exists else (0, [])
        held, out = list(held), []
        for b in batches:
            held += b[order].sort_values().tolist()
        while len(held) >= size:
            out.append((k[0], chunk, held[0], held[size - 1], size))
            chunk, held = chunk + 1, held[size:]
        state.update((chunk, held))
        yield pd.DataFrame(out, columns=["track", "chunk", "first", "last", "n"])

    return fixes.groupBy(track).applyInPandasWithState(step, f"track {key}, chunk bigint, first bigint, last bigint, n bigint", "chunk bigint, held array<bigint>", "append", "NoTimeout")


#: Parts of a table of latest fixes, by hash of the track.
PARTS = 64


def _versions(spark, path: str) -> dict[int, list[int]]:
    """Of each part, the versions that hold it, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = lambda p: [f.getPath().getName() for f in files.listStatus(p)] if files.exists(p) else []
    out: dict[int, list[int]] = {}
    for v in sorted(int(n.removeprefix("version=")) for n in names(root) if n.startswith("version=")):
        for n in names(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")):
            if n.startswith("part="):
                out.setdefault(int(n.removeprefix("part=")), []).append(v)
    return out


def _part(track: str, parts: int):
    return F.pmod(F.xxhash64(track), F.lit(parts)).cast("int")


def read_latest(spark, path: str, schema) -> DataFrame:
    """The table that `write_latest` keeps: of each part its newest version."""
    newest = [f"{path}/version={v[-1]}/part={k}" for k, v in sorted(_versions(spark, path).items())]
    return spark.read.schema(schema).parquet(*newest) if newest else spark.createDataFrame([], schema)


def write_latest(fixes: DataFrame, path: str, track: str, order: list[str], checkpoint: str, parts: int = PARTS):
    """Streaming: keeps a table of each track's last fix in parts by hash of the track. A micro-batch writes only the parts that it touches, each from its newest version before the batch, so a batch that is run again gives the same. The version before stays for that; older ones are deleted."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, track, order)
        touched = {r[0] for r in new.select(_part(track, parts)).distinct().collect()}  # `parts` numbers at most
        before = {k: [v for v in vs if v < epoch] for k, vs in _versions(spark, path).items() if k in touched}
        known = [f"{path}/version={v[-1]}/part={k}" for k, v in before.items() if v]
        if known:
            new = latest(new.unionByName(spark.read.schema(new.schema).parquet(*known)), track, order)
        new.withColumn("part", _part(track, parts)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/version={epoch}")
        for k, vs in before.items():
            for v in vs[:-1]:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}/part={k}")
                old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return fixes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def recorded(chunks: DataFrame, track: str) -> DataFrame:
    """(track, chunk, n, coord, unix_ms, height_m, accuracy_m, v_accuracy_m, speed_ms, bearing_deg) of recorded chunks, whose columns are arrays coord, ms, height, accuracy, vaccuracy, speed, bearing in hundredths. The least 32-bit number is no height, 65535 none of the last three. A chunk without a column, or with columns of unequal lengths, gives nothing."""
    names = ["coord", "ms", "height", "accuracy", "vaccuracy", "speed", "bearing"]
    whole = F.lit(True)
    for c in names[1:]:
        whole = whole & (F.size(c) == F.size("coord")) & F.col(c).isNotNull()
    f = chunks.where(F.col("coord").isNotNull() & whole).select(track, "chunk", F.posexplode(F.arrays_zip(*names)).alias("n", "_f"))
    known = lambda c, none: F.when(F.col(f"_f.{c}") != none, F.col(f"_f.{c}") / 100.0)
    return f.select(track, "chunk", "n", "_f.coord", F.col("_f.ms").alias("unix_ms"), known("height", -(2**31)).alias("height_m"), (F.col("_f.accuracy") / 100.0).alias("accuracy_m"), *(known(c, 65535).alias(n) for c, n in (("vaccuracy", "v_accuracy_m"), ("speed", "speed_ms"), ("bearing", "bearing_deg"))))
