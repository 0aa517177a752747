"""What the training-data operators share: word rules, the shared folder, Arrow slices and labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python step works on at once.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset a local master (tests) takes one below the warehouse; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder as Parquet and reads it again: lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, what: str) -> DataFrame:
    """Like `cut`, as a table in buckets by a key: joins on the key read it without a shuffle. It is dropped with `forget_buckets`."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{what}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").saveAsTable(name)
    return spark.table(name).alias(name)


def forget_buckets(df: DataFrame) -> None:
    """Drops a table of `cut_by` and its files."""
    files = df.inputFiles()
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {files[0].rsplit('/', 2)[1]}" if files else "SELECT 1")
    forget(df)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote, once nothing reads them any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].replace(" ", "%20")).getParent()
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame, text: str) -> Column:
    """16 bytes that name a row: equal rows have equal ones (maps aside), other rows others."""
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.unhex(F.md5(F.concat(F.hex(F.xxhash64(*hashed)), F.coalesce(F.concat(F.lit("="), F.col(text)), F.lit(""))).cast("binary")))


def remainder(key: str | Column, m: int) -> Column:
    """crc32 of the key as text, mod m; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most so many bytes in a column, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def replaced(batch: pa.RecordBatch, new: dict[str, pa.Array], drop: tuple[str, ...] = ()) -> pa.RecordBatch:
    """batch with columns set or added, others dropped; names are the same whatever their case."""
    gone = {n.lower() for n in (*drop, *new)}
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n.lower() not in gone]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), *new.values()], names=[*(n for n, _ in kept), *new])


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of df that have none of these names, whatever the case."""
    gone = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in gone]


def schema_with(df: DataFrame, new: str, drop: tuple[str, ...] = ()) -> str:
    """The DDL of df without what is dropped or replaced, then the new columns ("name type, ...")."""
    names = {part.strip().split(" ", 1)[0].strip("`").lower() for part in new.split(";")} | {d.lower() for d in drop}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name.lower() not in names]
    return ", ".join([*kept, *(part.strip() for part in new.split(";"))])


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str = "text", rows: int = 1500, longest: int = 100_000) -> list[tuple[str, int]]:
    """Texts and labels to fit on: of at most `rows` labelled rows, those whose keyed hash is least, the texts of at most `longest` characters; where keys repeat, the first `rows` texts in the order of that hash, key, label and text."""
    order = lambda: F.xxhash64(F.lit(17), F.col("_key"))
    picked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label")).orderBy(order(), "_key", "_label").limit(rows)
    found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") <= longest).join(F.broadcast(picked), "_key")  # at most `rows` rows
    return [(t, y) for _, y, t in found.select("_key", "_label", "_text").orderBy(order(), "_key", "_label", "_text").limit(rows).collect()]
