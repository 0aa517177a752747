"""Rows dealt to as many tasks as there is work for."""

from __future__ import annotations

from pyspark.sql import DataFrame


def tasks(df: DataFrame, rows: int) -> int:
    """How many tasks of some `rows` rows of df there are; no fewer than any shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt to tasks of some `rows` rows each (by the columns named), to no fewer tasks than any shuffle, for steps that make or hold much of every row: what one task holds then does not grow with the table. Costs a count."""
    return df.repartition(tasks(df, rows), *by)
