"""Intermediate tables written to the folder all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder of this machine serves a local master,
    whose tasks all run here; any other master has executors that would each
    write to a disk of their own, which is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path, system = _path(spark, folder)
    return f"{system.makeQualified(path).toString().rstrip('/')}/spanloom-{spark.sparkContext.applicationId}"  # with its scheme, as tasks read it too


def _path(spark: SparkSession, folder: str) -> tuple:
    """Hadoop's file system and path of ``folder``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written_at(df: DataFrame, name: str, by: str | None = None) -> str:
    """Where ``df`` now lies as Parquet; ``by`` is a column with a folder for each of its values."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, stored as Parquet in the shared folder and read back.

    Unlike ``persist`` the copy outlives lost executors, and unlike
    ``checkpoint`` the plan runs once and its columns can be pruned on reading.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written_at(df, name))


def part_rows(path: str, by: str, value: int, columns: list[str]) -> pa.Table:
    """Rows of one folder of :func:`written_at`, read by a task itself; the caller knows that it is small."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    return pq.read_table(f"{at}/{by}={value}", columns=columns, filesystem=system, partitioning=None)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on the file system that ``path`` names, whichever that is."""
    where, system = _path(spark, path)
    out = system.create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file written by :func:`write_text` or anyone else."""
    return spark.read.text(path, wholetext=True).first()[0]


def _drop(spark: SparkSession, path: str) -> None:
    where, system = _path(spark, path)
    system.delete(where, True)


def drop_written(keep: int = 0) -> None:
    """Delete the tables made since there were ``keep``; with 0, when the driver exits, all of them.

    A driver that is killed leaves its folder ``spanloom-<application id>`` behind,
    which can be deleted whole.
    """
    while len(_MADE) > keep:
        spark, path = _MADE.pop()
        try:
            _drop(spark, path if keep or _MADE else path.rpartition("/")[0])
        except Exception:  # the session may be gone already
            return


@contextmanager
def intermediates() -> Iterator[None]:
    """Deletes on leaving what queries inside wrote; their results must have been used by then."""
    keep = len(_MADE)
    try:
        yield
    finally:
        drop_written(keep)


atexit.register(drop_written)
