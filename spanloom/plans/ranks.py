"""Global order without one task that holds it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 4096  # parts of a hash range, or of a value range, that are counted on the driver


def by_hash(df: DataFrame, key: str, h: Column, most: int | None = None) -> DataFrame:
    """``df`` with ``place``, from 1, in the order of the hexadecimal hash ``h`` and then of ``key``; the first ``most`` rows.

    The hash range is cut in equal parts, which are counted and then ranked each
    for itself; parts behind the last one needed are not looked at.
    """
    rows = df.withColumn("_h", h).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy("_b").agg(F.count(F.lit(1))).collect()}  # at most BUCKETS rows
    first, at = [], 0
    for b in sorted(counts):
        if most is None or at < most:
            first.append((b, at))
        at += counts[b]
    offsets = F.broadcast(df.sparkSession.createDataFrame(first, "_b int, _first long"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    out = rows.join(offsets, "_b").withColumn("place", F.col("_first") + rank).drop("_h", "_b", "_first")
    return out if most is None else out.filter(F.col("place") <= most)


def at_ranks(counts: DataFrame, ranks: list[tuple[float, float]], edges: list[float]) -> DataFrame:
    """``fraction, value`` of the values at ``ranks`` (fraction, rank from 0) among ``counts`` of distinct values ``v, n``.

    ``edges`` cut the range of values. The parts are summed, and only those in
    which a rank falls are put in order, each for itself.
    """
    spark, kind = counts.sparkSession, dict(counts.dtypes)["v"]
    bucket = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col("v")))
    parts = counts.withColumn("_b", bucket)
    sums = sorted((r[0], r[1]) for r in parts.groupBy("_b").agg(F.sum("n")).collect())  # one row per edge
    ends = list(accumulate(n for _, n in sums))
    wanted = [(f, r, b, end - n) for f, r in ranks for (b, n), end in zip(sums, ends) if end - n <= r < end]
    asked = F.broadcast(spark.createDataFrame(wanted, "fraction double, rank double, _b int, _first long"))
    some = parts.filter(F.col("_b").isin(*sorted({w[2] for w in wanted}))) if wanted else parts.limit(0)
    run = some.withColumn("_hi", F.sum("n").over(Window.partitionBy("_b").orderBy("v")))
    hit = run.join(asked, "_b").filter((F.col("rank") >= F.col("_first") + F.col("_hi") - F.col("n")) & (F.col("rank") < F.col("_first") + F.col("_hi")))
    return hit.select("fraction", F.col("v").cast(kind).alias("value"))
