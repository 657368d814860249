"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = "spanloom.input.partitions"  # session setting: read tables are dealt out over so many partitions


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``; a file or a folder of part files.

    Spark makes a task of each row group at most, so a file written as one row
    group is read by one core. Who has such files can set ``PARTITIONS`` for the
    session, which costs a shuffle of every table read; unset, which is the
    default, files are read as they lie.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df
