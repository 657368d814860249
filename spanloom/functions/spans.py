"""Column builders over arrays of half-open spans ``struct<start,end,entity_type,score>``.

Folds visit spans in a total order, so results don't depend on how rows lie in
partitions. All of them stay in the JVM and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import merged
from .chars import has_alnum, slice_text

SPAN = "struct<start:int,end:int,entity_type:string>"
SCORED = "struct<start:int,end:int,entity_type:string,score:double>"
WINDOWED = "struct<window_index:int,start:int,end:int,entity_type:string,score:double>"


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` uses it.

    An expression inside a lambda is evaluated at every step and at every place
    it is written; bound to a variable of an array of one, it is evaluated once.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def overlaps(a: Column, b: Column) -> Column:
    """Half-open overlap; touching spans don't overlap."""
    return (a.start < b.end) & (b.start < a.end)


def bare(spans: Column) -> Column:
    """``spans`` without scores."""
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type")))


def in_order(spans: Column, kind: str = SPAN) -> Column:
    """Sorted by start, end and type, other fields last."""
    names = [f.split(":")[0] for f in kind[7:-1].split(",")]
    first = ["start", "end", "entity_type"]
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(*(s[n].alias(n) for n in [*first, *(x for x in names if x not in first)]))))
    return F.transform(keyed, lambda s: F.struct(*(s[n].alias(n) for n in names)))


def resolve_greedy(spans: Column) -> Column:
    """Spans that overlap no earlier accepted one; earlier start goes first, then longer, then type."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), (s.start - s.end).alias("n"), s.entity_type.alias("entity_type"), s.end.alias("end"), s.score.alias("score"))))
    start = F.struct(F.lit(0).alias("at"), empty(SCORED).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"), s.score.alias("score"))
        return F.when(s.start >= acc["at"], F.struct(s.end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))).otherwise(acc)

    return F.aggregate(keyed, start, step, lambda acc: acc["out"])


def above(spans: Column, thresholds: dict[str, float]) -> Column:
    """Spans without score, or with at least the threshold of their type; types without one are kept."""
    if not thresholds:
        return spans
    known = F.create_map(*(F.lit(x) for k, v in sorted(thresholds.items()) for x in (k, float(v))))
    return F.filter(spans, lambda s: s.score.isNull() | (s.score >= F.coalesce(F.try_element_at(known, s.entity_type), F.lit(0.0))))


def of_types(spans: Column, types: set[str] | None) -> Column:
    """Spans of the given types; None is every type, an empty set is none."""
    if types is None:
        return spans
    return F.filter(spans, lambda s: s.entity_type.isin(*sorted(types)) if types else F.lit(False))


# ---- predictions of overlapping windows


def _rank(s: Column) -> Column:
    return F.struct(F.coalesce(s.score, F.lit(float("-inf"))).alias("p"), (s.end - s.start).alias("n"), (-s.window_index).alias("w"))


def _type_first(a: Column, b: Column) -> Column:
    """Whether type ``a`` wins a full tie: earlier in the alphabet, but the longer of a name and its prefix."""
    return F.when(a == b, False).when(a.startswith(b), True).when(b.startswith(a), False).otherwise(a < b)


def distinct_windows(spans: Column) -> Column:
    """One span per place and type: the highest score, then the lowest window."""
    def better(x: Column, y: Column) -> Column:
        rx, ry = (F.struct(F.coalesce(s.score, F.lit(float("-inf"))).alias("p"), (-s.window_index).alias("w")) for s in (x, y))
        return rx > ry

    def step(acc: Column, s: Column) -> Column:
        same = F.exists(acc, lambda x: (x.start == s.start) & (x.end == s.end) & (x.entity_type == s.entity_type))
        swap = F.transform(acc, lambda x: F.when((x.start == s.start) & (x.end == s.end) & (x.entity_type == s.entity_type) & better(s, x), s).otherwise(x))
        return F.when(same, swap).otherwise(F.concat(acc, F.array(s)))

    return in_windows_order(F.aggregate(spans, empty(WINDOWED), step))


def in_windows_order(spans: Column) -> Column:
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"), s.window_index.alias("window_index"), s.score.alias("score"))))
    return F.transform(keyed, lambda s: F.struct(s.window_index.alias("window_index"), s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"), s.score.alias("score")))


def _survivors(spans: Column, same_type: bool) -> Column:
    """Visits spans in order; one that conflicts with a survivor takes its place if it ranks higher, else drops out."""
    def clash(x: Column, s: Column) -> Column:
        kind = x.entity_type == s.entity_type
        return overlaps(x, s) & (kind if same_type else ~kind)

    def wins(s: Column, x: Column) -> Column:
        higher = _rank(s) > _rank(x)
        return higher if same_type else higher | ((_rank(s) == _rank(x)) & _type_first(s.entity_type, x.entity_type))

    def step(acc: Column, s: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda x: clash(x, s)), True)
        swap = F.transform(acc, lambda x, i: F.when((i + 1 == at) & wins(s, x), s).otherwise(x))
        return F.when(at == 0, F.concat(acc, F.array(s))).otherwise(swap)

    return in_windows_order(F.aggregate(in_windows_order(spans), empty(WINDOWED), step))


def resolve_same_type(spans: Column) -> Column:
    return _survivors(spans, True)


def resolve_cross_type(spans: Column) -> Column:
    return _survivors(spans, False)


def merge_windows(spans: Column) -> Column:
    """Duplicates out, then overlaps of one type, then of different types, in one pass over sorted spans."""
    return merged(spans)


def merge_fragments(text: Column, spans: Column, types: set[str] | None = None) -> Column:
    """Neighbours of one type with no letter or digit between them become one span.

    Its score is the running mean of pairs, taken in order.
    """
    ordered = in_order(spans, SCORED)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        chosen = F.lit(True) if types is None else (last.entity_type.isin(*sorted(types)) if types else F.lit(False))
        joins = last.isNotNull() & chosen & (last.entity_type == s.entity_type) & (s.start >= last.end) & ~has_alnum(slice_text(text, last.end, s.start))
        score = F.when(last.score.isNull(), s.score).when(s.score.isNull(), last.score).otherwise((last.score + s.score) / 2)
        one = F.struct(last.start.alias("start"), s.end.alias("end"), last.entity_type.alias("entity_type"), score.alias("score"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, empty(SCORED), step)


# ---- validity


def adjacent_overlap(spans: Column) -> Column:
    """Whether a span overlaps the one before it in order."""
    def clash(o: Column) -> Column:
        pairs = F.zip_with(o, F.slice(o, F.lit(2), F.greatest(F.size(o) - 1, F.lit(0))), lambda a, b: F.coalesce(b.start < a.end, F.lit(False)))
        return F.exists(pairs, lambda x: x)

    return let(in_order(bare(spans)), clash)


def valid_bounds(spans: Column, length: Column) -> Column:
    """Whether all spans have offsets, are not empty, have a type, and lie in the text."""
    return F.forall(spans, lambda s: F.coalesce((s.start >= 0) & (s.start < s.end) & (s.end <= length) & (F.trim(s.entity_type) != ""), F.lit(False)))


# ---- comparing gold and predicted spans


def exact_hits(gold: Column, predicted: Column) -> Column:
    """Distinct spans in both."""
    return F.size(F.array_intersect(bare(gold), bare(predicted)))


def clipped_cover(target: Column, spans: Column) -> Column:
    """Characters of ``target`` that ``spans`` cover together."""
    parts = F.array_sort(F.transform(F.filter(spans, lambda s: overlaps(s, target)), lambda s: F.struct(F.greatest(s.start, target.start).alias("a"), F.least(s.end, target.end).alias("b"))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        fresh = F.greatest(p["b"] - F.greatest(p["a"], acc["at"]), F.lit(0))
        return F.struct(F.greatest(acc["at"], p["b"]).alias("at"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(parts, start, step, lambda acc: acc["n"])


def leaked(gold: Column, predicted: Column) -> Column:
    """Gold spans not covered in full, whatever the types."""
    return F.size(F.filter(gold, lambda g: clipped_cover(g, predicted) < g.end - g.start))


def covered(spans: Column) -> Column:
    """Characters that ``spans`` cover together."""
    everything = F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("end"))
    return clipped_cover(everything, spans)


def over_redacted(gold: Column, predicted: Column) -> Column:
    """Characters covered by predictions and by no gold span."""
    both = F.concat(bare(gold), bare(predicted))
    return covered(both) - covered(gold)


def partial_hits(gold: Column, predicted: Column) -> Column:
    """Pairs of a greedy one-to-one matching of overlapping spans of one type.

    Longer overlaps go first, then closer boundaries, then order in the arrays.
    """
    pairs = F.flatten(F.transform(gold, lambda g, i: F.transform(predicted, lambda p, j: F.struct(
        (-(F.least(g.end, p.end) - F.greatest(g.start, p.start))).alias("o"),
        (F.abs(g.start - p.start) + F.abs(g.end - p.end)).alias("d"), i.alias("g"), j.alias("p"), (g.entity_type == p.entity_type).alias("same"),
    ))))
    pairs = F.array_sort(F.filter(pairs, lambda c: c["same"] & (c["o"] < 0)))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("g"), F.expr("cast(array() as array<int>)").alias("p"))

    def step(acc: Column, c: Column) -> Column:
        used = F.array_contains(acc["g"], c["g"]) | F.array_contains(acc["p"], c["p"])
        return F.when(used, acc).otherwise(F.struct(F.concat(acc["g"], F.array(c["g"])).alias("g"), F.concat(acc["p"], F.array(c["p"])).alias("p")))

    return F.aggregate(pairs, start, step, lambda acc: F.size(acc["g"]))


def error_kind(text: Column, gold: Column, predicted: Column) -> Column:
    """Why a gold span has no exact prediction; null where it has one."""
    def of_same(near: Column, same: Column) -> Column:
        exact = F.exists(same, lambda p: (p.start == gold.start) & (p.end == gold.end))
        parts = F.array_sort(F.transform(same, lambda p: F.struct(F.greatest(p.start, gold.start).alias("a"), F.least(p.end, gold.end).alias("b"))))
        first = F.struct(gold.start.alias("at"), F.lit(True).alias("ok"), F.lit(True).alias("head"))

        def step(acc: Column, p: Column) -> Column:
            gap = (p["a"] > acc["at"]) & F.when(acc["head"], True).otherwise(has_alnum(slice_text(text, acc["at"], p["a"])))
            return F.struct(F.greatest(acc["at"], p["b"]).alias("at"), (acc["ok"] & ~gap).alias("ok"), F.lit(False).alias("head"))

        whole = F.aggregate(parts, first, step, lambda acc: acc["ok"] & ~has_alnum(slice_text(text, acc["at"], gold.end)))
        ranked = F.array_sort(F.transform(same, lambda p, i: F.struct((-(F.least(p.end, gold.end) - F.greatest(p.start, gold.start))).alias("o"), i.alias("i"), p.start.alias("start"), p.end.alias("end"))))

        def place(best: Column) -> Column:
            return (
                F.when((best["start"] <= gold.start) & (best["end"] >= gold.end), "oversized")
                .when((best["start"] >= gold.start) & (best["end"] <= gold.end), "undersized").otherwise("boundary_shift")
            )

        return (
            F.when(exact, F.lit(None).cast("string")).when(F.size(near) == 0, "miss").when(F.size(same) == 0, "wrong_type")
            .when((F.size(same) > 1) & whole, "split").otherwise(let(F.get(ranked, F.lit(0)), place))
        )

    return let(F.filter(predicted, lambda p: overlaps(gold, p)), lambda near: let(F.filter(near, lambda p: p.entity_type == gold.entity_type), lambda same: of_same(near, same)))


def false_positives(gold: Column, predicted: Column) -> Column:
    """Predictions that overlap no gold span of their type."""
    return F.filter(predicted, lambda p: ~F.exists(gold, lambda g: (g.entity_type == p.entity_type) & overlaps(g, p)))
