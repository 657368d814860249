"""Joins that no hot key can bring to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1_000  # a key with more than this part of all rows is hot; there can't be more such keys than this


def hot_from(rows: int) -> int:
    """The least number of rows that makes a key hot, among ``rows`` of all keys."""
    return rows // HOT + 1


def attach(rows: DataFrame, classes: DataFrame, on: list[str], total: int, copies: str = "copies") -> DataFrame:
    """``rows`` with the columns of their class; ``copies`` is how many rows a class has, ``total`` of all.

    Hot classes, fewer than ``HOT`` by their definition, are broadcast, so that
    their rows stay where they are; all others meet by key, each a thousandth of
    the rows at most. Rows of no class drop out. Rows with a null key have none.
    """
    least = hot_from(total)
    hot, rest = F.broadcast(classes.filter(F.col(copies) >= least)), classes.filter(F.col(copies) < least)
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(rest, on))
