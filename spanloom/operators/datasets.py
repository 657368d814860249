"""Statistics, samples and splits of example sets."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from ..plans.ranks import at_ranks, by_hash
from ..plans.written import written


def statistics(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """One row: counts of examples, positives, entities and characters, text lengths, and guarded ratios; zeros on an empty table."""
    n, size = F.length(text).cast("long"), F.greatest(F.coalesce(F.size(spans), F.lit(0)), F.lit(0)).cast("long")
    rows, zero = F.count(F.lit(1)), F.lit(0).cast("long")
    positive, entities, chars = F.coalesce(F.sum((size > 0).cast("long")), zero), F.coalesce(F.sum(size), zero), F.coalesce(F.sum(n), zero)
    return df.agg(
        rows.alias("examples"), positive.alias("positive"), (rows - positive).alias("negative"), entities.alias("entities"), chars.alias("characters"),
        F.coalesce(F.min(n), zero).alias("min_length"), F.coalesce(F.max(n), zero).alias("max_length"), ratio(chars, rows).alias("avg_length"),
        ratio(positive, rows).alias("positive_rate"), ratio(entities, rows).alias("entities_per_example"),
    )


def count_rows(df: DataFrame, spans: str = "spans", **columns: str) -> DataFrame:
    """``kind, name, n``: rows by each named column, and spans by type."""
    by_type = df.select(F.explode_outer(spans).alias("s")).filter("s is not null").groupBy(F.lit("entity_type").alias("kind"), F.col("s.entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for kind, c in columns.items():
        by_type = by_type.unionByName(df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return by_type


def count_maps(counts: DataFrame) -> DataFrame:
    """``kind, counts`` with each kind's counts as one map, sorted by name; for kinds with few names."""
    pairs = F.array_sort(F.collect_list(F.struct("name", "n")))
    return counts.filter("name is not null").groupBy("kind").agg(F.map_from_entries(pairs).alias("counts"))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_hand_set(df: DataFrame, key: str = "id", most: int = 200, exact: bool = False) -> None:
    """A hand-labelled set has unique ids and at most, or exactly, ``most`` rows."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("ids")).first()
    if r.n != r.ids:
        raise ValueError("ids must be unique")
    if r.n > most or (exact and r.n != most):
        raise ValueError(f"expected {'exactly' if exact else 'at most'} {most} examples, found {r.n}")


def _whole(n: int, name: str) -> None:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError(f"{name} must be an integer")
    if n < 0:
        raise ValueError(f"{name} must not be negative")


def _order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with their ``place``, by the hash order of their key; unique keys give the same rows in any partitioning.

    Rows are ranked within parts of the hash range, so ``n`` may be a share of the table.
    """
    _whole(n, "n")
    return by_hash(df, key, _order(key, seed), n)


def first_rows(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first ``n`` rows by a unique ordinal, in order; ``n`` bounds what any task keeps."""
    _whole(n, "n")
    return df.orderBy(ordinal).limit(n)


def split(df: DataFrame, key: str, validation: int, test: int, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: exactly ``test`` rows test, the next ``validation`` validation, the rest train.

    Rows go by the hash order of their unique key. Only the keys of held-out rows
    are ranked, within parts of the hash range, and joined back.
    """
    _whole(validation, "validation")
    _whole(test, "test")
    held = by_hash(df.select(key), key, _order(key, seed), test + validation)
    named = held.select(F.col(key).alias("_k"), F.when(F.col("place") <= test, "test").otherwise("validation").alias("_p"))
    return df.join(named, F.col(key) == F.col("_k"), "left").withColumn("part", F.coalesce("_p", F.lit("train"))).drop("_k", "_p")


def shuffled_places(n: int, seed: int = 42) -> list[int]:
    """The classic generator's permutation of ``range(n)``; for parity with lists that fit the driver."""
    _whole(n, "n")
    places = list(range(n))
    random.Random(seed).shuffle(places)
    return places


def sample_places(df: DataFrame, ordinal: str, n: int, seed: int = 42, most: int = 5_000_000) -> DataFrame:
    """``n`` rows in the order of the classic shuffle of the rows' ordinals 0, 1, ...; tables over ``most`` rows are refused."""
    rows = df.count()
    if rows > most:
        raise ValueError(f"{rows} rows are too many for a permutation on the driver; use sample()")
    if n > rows:
        raise ValueError(f"sample size {n} exceeds the data set's {rows}")
    order = df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(shuffled_places(rows, seed)[:n])], f"{ordinal} long, place long")
    return df.join(order, ordinal)


def split_places(df: DataFrame, ordinal: str, validation: int, test: int, seed: int = 42, most: int = 5_000_000) -> DataFrame:
    """``df`` with ``part`` and ``place`` by the classic shuffle: test first, then validation, then train."""
    rows = df.count()
    if rows > most:
        raise ValueError(f"{rows} rows are too many for a permutation on the driver; use split()")
    if validation + test > rows:
        raise ValueError("validation plus test exceeds the data set")
    part = lambda i: "test" if i < test else "validation" if i < test + validation else "train"
    order = df.sparkSession.createDataFrame([(p, i, part(i)) for i, p in enumerate(shuffled_places(rows, seed))], f"{ordinal} long, place long, part string")
    return df.join(order, ordinal)


def percentiles(df: DataFrame, value: str, fractions: list[float]) -> DataFrame:
    """``fraction, value`` by nearest rank at ``round((n - 1) f)``, halves to even; numbers only, nulls left out.

    Exact without one sorted list: values are counted, and only those near a
    wanted rank, between two approximate quantiles, are put in order.
    """
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")), "value-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    edges = counts.approxQuantile("v", [i / 256 for i in range(1, 256)], 0.001) if total else []
    return at_ranks(counts, [(float(f), float(round((total - 1) * f))) for f in fractions] if total else [], sorted(set(edges)))


def over_limits(df: DataFrame, value: str, limits: list[int]) -> DataFrame:
    """``over, n``: rows with a value above each limit."""
    each = df.select(F.explode(F.filter(F.array(*(F.lit(x) for x in limits)), lambda x: F.col(value) > x)).alias("over"))
    return each.groupBy("over").agg(F.count(F.lit(1)).alias("n"))
