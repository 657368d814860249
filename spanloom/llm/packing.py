"""Items of varying length put into containers of fixed capacity (problem 9).

Planning needs lengths and how often each occurs, never the items: the histogram
has at most ``capacity`` entries, whatever the corpus. The plan is made of
patterns, lists of lengths that share a container, each used a number of times.
Exact-complement hashing finds them: for the longest length left the gap is
looked up among the sums of one, two and three lengths under their counts; what
no sum fills goes best-fit. Items are then dealt to the slots of the plan by
their rank among items of equal length, ranked in salted groups.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.written import written

CAPACITY = 2048
SALTS, PER_SALT = 32, 100_000  # groups in which items of a length are ranked: at least, and items to each


def _fill(gap: int, left: np.ndarray, pairs: np.ndarray) -> list[int] | None:
    """Lengths that sum to ``gap`` and are left: one, else two, else three, the longest first."""
    if gap < len(left) and left[gap]:
        return [gap]
    here = np.flatnonzero(left[: gap + 1])
    here = here[here > 0]
    if not len(here):
        return None
    other = gap - here
    ok = (other > 0) & (left[other] > 0) & ((other != here) | (left[here] > 1))
    if ok.any():
        a = int(here[ok].max())
        return [a, gap - a]
    for a in here[::-1]:  # the third length through the index of pair sums
        rest = gap - int(a)
        if rest < 2 or not pairs[rest]:
            continue
        left[a] -= 1
        two = np.flatnonzero(left[: rest + 1])
        two = two[two > 0]
        o = rest - two
        ok = (o > 0) & (left[o] > 0) & ((o != two) | (left[two] > 1))
        left[a] += 1
        if ok.any():
            b = int(two[ok].max())
            return [int(a), b, rest - b]
    return None


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths, times)`` that use every item of ``histogram`` (length to count) once.

    Each pattern is applied as often as its counts allow, so the number of
    patterns is bounded by the number of lengths and not by that of items.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError("lengths must lie between 1 and the capacity")
        left[length] += n
    plan: list[tuple[list[int], int]] = []
    pairs = np.zeros(capacity + 1, bool)

    def index() -> None:
        here = np.flatnonzero(left)
        pairs[:] = False
        for a in here:
            s = here + a
            pairs[s[s <= capacity]] = True

    index()
    age = 0
    while True:
        here = np.flatnonzero(left)
        if not len(here):
            return plan
        a = int(here[-1])
        left[a] -= 1
        found = _fill(capacity - a, left, pairs) if a < capacity else []
        if found is None:  # best fit: the longest that goes in, again and again
            found, gap = [], capacity - a
            while gap > 0:
                fit = np.flatnonzero(left[: gap + 1])
                if not len(fit) or fit[-1] == 0:
                    break
                b = int(fit[-1])
                found.append(b)
                left[b] -= 1
                gap -= b
                if gap and (more := _fill(gap, left, pairs)) is not None:
                    for x in more:
                        left[x] -= 1
                    found += more
                    break
            for b in found:
                left[b] += 1
        left[a] += 1
        lengths = [a, *found]
        need = {x: lengths.count(x) for x in lengths}
        times = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * times
        plan.append((lengths, times))
        age += 1
        if age % 256 == 0:
            index()


def _slots(plan: Iterable[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, from, to, container, per)``: ranks [from, to) of a length go to containers from ``container`` on, ``per`` a container."""
    at: dict[int, int] = {}
    out, box = [], 0
    for lengths, times in plan:
        for x in dict.fromkeys(lengths):
            per = lengths.count(x)
            out.append((x, at.get(x, 0), at.get(x, 0) + per * times, box, per))
            at[x] = at.get(x, 0) + per * times
        box += times
    return out


def pack_items(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``item_id, part_no, container, used``: where each item, or part of an item, goes.

    Items up to the capacity stay whole, with part_no 0. A larger one fills
    containers of its own with parts of full capacity, numbered from 1, and its
    rest is packed like an item. Items of size 0 or null take no room and share
    container 0 with nothing else; containers are numbered from 1 otherwise, the
    shared ones first. Ties in size are broken by a hash of the id; repeated ids
    are items of their own. An empty table gives no rows.
    """
    src = items.select(F.col(item_id).cast("long").alias("item_id"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    src = src.withColumn("whole", F.floor(F.col("size") / capacity)).withColumn("rest", F.when(F.col("size") > capacity, F.col("size") % capacity).otherwise(F.col("size")).cast("int"))
    src = written(src, "pack-items")
    counted = src.filter("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows, whatever the corpus
    histogram = {r.rest: r.n for r in sorted(counted)}
    plan = plan_containers(histogram, capacity)
    salts = max(SALTS, sum(histogram.values()) // PER_SALT)
    # Ranks must not change when a task is run again, so the salt is a hash and ids are ordered.
    src = src.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(salts)).cast("int"))
    spark = items.sparkSession
    earlier = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = src.filter("rest > 0").groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    offsets = offsets.select("rest", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    slots = spark.createDataFrame(_slots(plan), "rest int, lo long, hi long, box long, per long")
    boxes = sum(t for _, t in plan)
    rank = F.row_number().over(Window.partitionBy("rest", "salt").orderBy("item_id"))
    ranked = src.filter("rest > 0").withColumn("r", rank - 1).join(offsets, ["rest", "salt"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("first"))
    # The slots of a length are few and sorted: an array per length, searched per item, keeps this an equi-join.
    arr = slots.groupBy("rest").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "box", "per"))).alias("slots"))
    hit = F.filter("slots", lambda s: (s.lo <= F.col("r")) & (F.col("r") < s.hi))[0]
    placed = ranked.join(F.broadcast(arr), "rest").select("item_id", F.when(F.col("size") > capacity, F.col("whole") + 1).otherwise(0).cast("long").alias("part_no"), hit.alias("s"), "r", F.col("rest").cast("long").alias("used"))
    placed = placed.select("item_id", "part_no", (F.col("s.box") + F.floor((F.col("r") - F.col("s.lo")) / F.col("s.per")) + 1).alias("container"), "used")
    empty = src.filter("size = 0").select("item_id", F.lit(0).cast("long").alias("part_no"), F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("used"))
    large = src.filter(F.col("size") > capacity)
    groups = large.groupBy("salt").agg(F.sum("whole").alias("n"))  # one row per salt
    start = groups.select("salt", (F.lit(boxes) + F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("at"))
    before = F.sum("whole").over(Window.partitionBy("salt").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1))
    full = large.withColumn("b", F.coalesce(before, F.lit(0))).join(start, "salt")
    full = full.select("item_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))).alias("part_no"), (F.col("at") + F.col("b")).alias("base"))
    full = full.select("item_id", "part_no", (F.col("base") + F.col("part_no")).alias("container"), F.lit(capacity).cast("long").alias("used"))
    return placed.unionByName(empty).unionByName(full)
