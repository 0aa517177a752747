"""Passes over many parts that can be stopped and taken up again.

A pass works on a table part by part (a region, a cell of a coarse depth) and publishes each part's result as a folder of its
own. A part is claimed by creating a file that must not exist yet, so two runs never work on one part; its result is written
aside and moved into place by one rename, so a part is there whole or not at all. A run that was killed leaves claims that
are older than `stale` seconds: the next run takes those parts. What is there already is never made again.
"""

from __future__ import annotations

import time
import urllib.parse
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Log:
    """The folder of a pass: `part=<name>` for each finished part, `_claims` and `_aside` beside them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _names(self, folder) -> dict[str, float]:
        return {f.getPath().getName(): f.getModificationTime() / 1000 for f in self.files.listStatus(folder)} if self.files.exists(folder) else {}

    def done(self) -> set[str]:
        """Names of finished parts."""
        return {urllib.parse.unquote(n.removeprefix("part=")) for n in self._names(self.root) if n.startswith("part=")}

    def claim(self, part: str, stale: float) -> bool:
        """Whether the part is ours now. A claim that is too old is taken over."""
        name = self.at("_claims", urllib.parse.quote(part, safe=""))
        held = self._names(self.at("_claims")).get(name.getName())
        if held is not None and time.time() - held > stale:
            # only one of those who find it can move it away
            self.files.rename(name, self.at("_claims", f".{uuid.uuid4().hex}"))
        try:
            self.files.create(name, False).close()
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def release(self, part: str) -> None:
        self.files.delete(self.at("_claims", urllib.parse.quote(part, safe="")), False)

    def publish(self, aside: str, part: str) -> None:
        """A part's folder moved into place; where another one is there already, that stands. A part without rows leaves an empty folder, so it counts as done."""
        quoted = urllib.parse.quote(part, safe="")
        source, target = self.at("_aside", aside, f"part={quoted}"), self.at(f"part={quoted}")
        if not self.files.exists(source):
            self.files.mkdirs(source)
        if not self.files.exists(target):
            self.files.rename(source, target)


def run(table: DataFrame, part: str, work: Callable[[DataFrame], DataFrame], path: str, at_once: int = 16, stale: float = 6 * 3600.0) -> int:
    """Works through the parts that are not done, so many in one job; the number of parts made. work takes the rows of some parts and returns rows with the part's column; each row's result must depend on its own part only. Parts are few (their names are held), their rows are not."""
    spark = table.sparkSession
    log = Log(spark, path)
    known, done = sorted(str(r[0]) for r in table.where(F.col(part).isNotNull()).select(F.col(part).cast("string")).distinct().collect()), log.done()
    made, waiting = 0, [p for p in known if p not in done]
    for i in range(0, len(waiting), at_once):
        mine = [p for p in waiting[i : i + at_once] if log.claim(p, stale)]
        mine, late = [p for p in mine if p not in log.done()], [p for p in mine if p in log.done()]
        try:
            if mine:
                aside = uuid.uuid4().hex
                out = work(table.where(F.col(part).cast("string").isin(mine)))
                named = out.withColumn("_part", F.col(part).cast("string"))
                named.write.partitionBy("_part").parquet(f"{log.path}/_aside/{aside}/rows")
                for p in mine:
                    _settle(log, aside, p)
                    log.publish(aside, p)
                    made += 1
                log.files.delete(log.at("_aside", aside), True)
        finally:
            for p in [*mine, *late]:
                log.release(p)
    return made


def _settle(log: Log, aside: str, part: str) -> None:
    """The rows of a part from the job's folders to the part's own."""
    escaped = log.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(part)
    rows = log.at("_aside", aside, "rows", f"_part={escaped}")
    if log.files.exists(rows):
        log.files.rename(rows, log.at("_aside", aside, f"part={urllib.parse.quote(part, safe='')}"))


def result(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all finished parts."""
    log = Log(spark, path)
    folders = [f"{log.path}/part={urllib.parse.quote(p, safe='')}" for p in sorted(log.done())]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
