"""Cell tables in a folder: one Parquet table a layer, by depth; merge-write, and publishing what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge


def read_layer(spark: SparkSession, root: str, layer: str, depth: int | None = None) -> DataFrame:
    """A layer, of one depth if asked: the folder by depth prunes the rest."""
    t = spark.read.parquet(f"{root}/{layer}")
    return t if depth is None else t.where(F.col("depth") == depth)


def write_layer(df: DataFrame, root: str, layer: str) -> None:
    """Replaces the depths that df has; others stay. Rows are laid out by prefix, so that row groups skip by area."""
    laid = df.repartitionByRange("depth", "prefix").sortWithinPartitions("depth", "prefix", "texel" if "texel" in df.columns else "prefix")
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("depth").parquet(f"{root}/{layer}")


def merge_layer(new: DataFrame, root: str, layer: str, columns: list[str], footprint: DataFrame | None = None) -> str:
    """New data merged over a layer into its next version; the version read is left as it is, so a failed write loses nothing. Returns the new layer's name."""
    spark = new.sparkSession
    name, _, version = layer.partition("@")
    merged = merge.over(new, read_layer(spark, root, layer), columns, footprint)
    following = f"{name}@{int(version or 0) + 1}"
    write_layer(merged, root, following)
    return following


def publish(new: DataFrame, old: DataFrame, keys: list[str], out: str) -> None:
    """Writes the rows of new whose content differs from what old has under their key."""
    new.join(merge.changed(new, old, keys).select(*keys), keys, "left_semi").write.mode("overwrite").parquet(out)
