"""Guarded ratios over integer sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` as one division of doubles, 0 where ``b`` is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"))


def prf(tp: Column, fp: Column, fn: Column, prefix: str = "") -> list[Column]:
    """Precision, recall and F1 from counts."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.nullif(p + r, F.lit(0.0)))
    return [p.alias(f"{prefix}precision"), r.alias(f"{prefix}recall"), f1.alias(f"{prefix}f1")]
