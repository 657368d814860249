"""Calibration error, threshold sweeps and profile search."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.batches import apart
from ..functions.ratios import prf, ratio
from ..functions.spans import above, bare, let
from ..plans.written import written
from .metrics import dataset_score, document_measures, measures


def threshold_grid(step: float = 0.05) -> list[float]:
    """0, step, 2 step ... below 1, then 1."""
    if isinstance(step, bool) or not isinstance(step, (int, float)):
        raise TypeError("the step of a grid is a number")
    if not 0 < step <= 1:
        raise ValueError("the step of a grid lies above 0 and is 1 at most")
    n, out = 0, []
    while n * step < 1:
        out.append(round(n * step, 10))
        n += 1
    return [*out, 1.0]


def _bin(score: Column, bins: int) -> Column:
    """The bin ``b/n <= score < (b+1)/n``, the last closed: near an edge the product rounds the wrong way."""
    n = F.lit(float(bins))
    guess = F.least(F.floor(score * bins), F.lit(bins - 1))
    low, high = guess.cast("double") / n, (guess + 1).cast("double") / n
    return F.when(score < low, guess - 1).when((score >= high) & (guess < bins - 1), guess + 1).otherwise(guess).cast("int")


def calibration_error(rows: DataFrame, *by: str, bins: int = 10) -> DataFrame:
    """Expected calibration error of scored rows with ``score, correct``, in all or by columns.

    A missing score is an error; no rows give no groups, and 0 without columns.
    """
    if isinstance(bins, bool) or not isinstance(bins, int):
        raise TypeError("the number of bins is a whole number")
    if bins <= 0:
        raise ValueError("at least one bin is needed")
    score = F.when(F.col("score").isNull(), F.raise_error(F.lit("calibration needs a score for every prediction"))).otherwise(F.col("score"))
    binned = rows.withColumn("bin", _bin(score, bins)).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("p"), F.sum(F.col("correct").cast("long")).alias("ok"))
    return binned.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("predictions"),
        F.coalesce(F.sum(F.abs(F.col("ok").cast("double") - F.col("p"))) / F.sum("n").cast("double"), F.lit(0.0)).alias("ece"),
    )


def sweep_thresholds(df: DataFrame, thresholds: list[float], gold: str = "spans", predicted: str = "predictions", only: str | None = None, length: Column | None = None, weight: Column | None = None) -> DataFrame:
    """Scores at each threshold, applied to all types or to one; no rows give zeros.

    ``length`` is that of ``text`` unless given; a row counts ``weight`` times.

    A document's measures change only where one of its scores falls below the
    threshold. So each is measured at the few steps its own scores fall in, the
    changes are summed by step, and running sums over the steps give the scores:
    one row per step leaves a task, however many thresholds there are.
    """
    grid = sorted({float(t) for t in thresholds})
    if not grid or grid[0] < 0 or grid[-1] > 1:
        raise ValueError("a threshold lies from 0 to 1")
    top, g, p, n, times = len(grid), F.col(gold), F.col(predicted), F.length("text") if length is None else length, F.lit(1) if weight is None else weight
    steps = F.array(*(F.lit(t) for t in grid))
    moving = ["n_pred", "n_pred_distinct", "exact_tp", "leaked", "fp_chars"]
    step_of = lambda s: F.size(F.filter(steps, lambda t: t <= s.score)) - 1
    bound = lambda s: s.score.isNotNull() & (F.lit(True) if only is None else s.entity_type == only)
    own = F.transform(F.filter(p, bound), step_of)
    levels = F.array_sort(F.array_distinct(F.concat(F.filter(own, lambda i: i >= 0), F.array(F.lit(top)))))

    def at(level: Column) -> Column:
        return F.filter(p, lambda s: ~bound(s) | ((level < top) & (s.score >= F.get(steps, level))))

    def point(level: Column) -> Column:
        return let(at(level), lambda q: F.struct(level.alias("step"), *(c.alias(k) for k, c in measures(g, q, n).items() if k in moving)))

    def changes(points: Column) -> Column:  # the last point keeps what no threshold binds
        above_ = F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.array(F.lit(None)))
        return F.zip_with(points, above_, lambda x, y: F.struct(x["step"].alias("step"), *((x[k] - F.coalesce(y[k], F.lit(0))).cast("long").alias(k) for k in moving)))

    fixed = measures(g, p, n)
    docs = df.select(F.explode_outer(let(F.transform(levels, point), changes)).alias("d"), *((fixed[k].cast("long") * times).alias(k) for k in ("n_gold", "n_gold_distinct", "non_pii")), times.alias("times"))
    sums = docs.groupBy(F.col("d.step").alias("step")).agg(*(F.sum(F.col(f"d.{k}") * F.col("times")).alias(k) for k in moving), *(F.sum(F.when(F.col("d.step") == top, F.col(k))).alias(k) for k in ("n_gold", "n_gold_distinct", "non_pii")))
    every = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate([*grid, 2.0])], "step int, threshold double").join(sums, "step", "left")
    down, whole = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # one row per step
    run = lambda k: F.coalesce(F.sum(k).over(down), F.lit(0))
    total = lambda k: F.coalesce(F.max(k).over(whole), F.lit(0))
    r = every.select("step", "threshold", *(run(k).alias(k) for k in moving), *(total(k).alias(k) for k in ("n_gold", "n_gold_distinct", "non_pii"))).filter(F.col("step") < top)
    c = F.col
    scores = prf(c("exact_tp"), c("n_pred_distinct") - c("exact_tp"), c("n_gold_distinct") - c("exact_tp"))
    return r.select("threshold", ratio(c("leaked"), c("n_gold")).alias("leak_rate"), *scores, ratio(c("fp_chars"), c("non_pii")).alias("over_redaction_rate"), c("n_pred").alias("predictions"))


def score_profile(df: DataFrame, profile: dict[str, float], gold: str = "spans", predicted: str = "predictions") -> DataFrame:
    """Scores after thresholds by type."""
    return dataset_score(document_measures(df.withColumn(predicted, above(F.col(predicted), profile)), gold, predicted))


def _key(mode: str, s, threshold: float) -> tuple:
    """What the search maximises."""
    if mode == "strict":
        return (-s["leak_rate"], s["recall"], -s["over_redaction_rate"], s["precision"], s["f1"], threshold)
    return (s["f1"], -s["leak_rate"], s["precision"], s["recall"], -s["over_redaction_rate"], threshold)


ANCHORS = {"strict": 0.35, "balanced": 0.60}  # Fixed values: where the searches start, and what their finds are held against


def _pieces(df: DataFrame, cuts: list[float], gold: str, predicted: str) -> DataFrame:
    """``docs, length, spans, predictions, n``: what documents consist of, and how often.

    Every measure of a document is the sum of those of its pieces, which no span
    reaches across, whatever predictions a threshold takes away. Pieces that differ
    in their place or in scores between the same two cuts are equal, so there are
    far fewer than documents; ``docs`` counts documents, once each.
    """
    scored = F.transform(predicted, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"), s.score.cast("double").alias("score")))
    rows = df.select(F.length("text").alias("length"), bare(F.col(gold)).alias("spans"), scored.alias("predictions"))
    long = T.LongType()
    made = T.StructType([T.StructField("docs", long), *(T.StructField(f.name, f.dataType) for f in rows.schema), T.StructField("n", long)])
    return rows.mapInArrow(apart(sorted({0.0, *cuts})), made).groupBy("docs", "length", "spans", "predictions").agg(F.sum("n").alias("n"))


def optimize_profile(df: DataFrame, entities: list[str], thresholds: list[float], initial: float, mode: str, passes: int = 3, gold: str = "spans", predicted: str = "predictions") -> tuple[dict[str, float], dict]:
    """One threshold per type by coordinate search: types in order, best candidate kept, until a pass changes nothing.

    All candidates of a coordinate are scored in one job over a written table of
    the different pieces of documents, see :func:`_pieces`.
    """
    if mode not in ("balanced", "strict"):
        raise ValueError(f"no search is known by the name {mode!r}")
    if passes < 1:
        raise ValueError("a search makes one pass or more")
    values = sorted({float(t) for t in thresholds})
    if not values:
        raise ValueError("a search needs candidates")
    if any(not 0 <= t <= 1 for t in [*values, initial]):
        raise ValueError("a threshold lies from 0 to 1")
    base = written(_pieces(df, [*values, float(initial)], gold, predicted), "profile-search")
    profile = {e: float(initial) for e in sorted(set(entities))}
    for _ in range(passes):
        before = dict(profile)
        for e in sorted(profile):
            tried = sorted({*values, profile[e]})
            rest = {k: v for k, v in profile.items() if k != e}
            others = base.withColumn("predictions", above(F.col("predictions"), rest))
            scores = {r["threshold"]: r for r in sweep_thresholds(others, tried, only=e, length=F.col("length"), weight=F.col("n")).collect()}  # one row a candidate
            profile[e] = max(tried, key=lambda t: _key(mode, scores[t], t))  # noqa: B023
        if profile == before:
            break
    measured = document_measures(base.withColumn("predictions", above(F.col("predictions"), profile)), length=F.col("length"))
    counted = measured.withColumns({k: F.col(k).cast("long") * F.col("n") for k in measured.columns if k not in base.columns})
    docs = base.agg(F.coalesce(F.sum(F.col("docs") * F.col("n")), F.lit(0))).first()[0]
    return profile, dataset_score(counted).first().asDict() | {"examples": docs}


def selection_report(df: DataFrame, entities: list[str], thresholds: list[float] | None = None, gold: str = "spans", predicted: str = "predictions") -> tuple[dict, DataFrame]:
    """Both searches with the anchors they started from: the profiles found, and scores of anchors and finds.

    The scores have a row for each ``mode, choice``: the anchor as one threshold
    for every type, and the profile found.
    """
    grid, found, rows = thresholds or threshold_grid(), {}, None
    for mode, start in sorted(ANCHORS.items()):
        found[mode], _ = optimize_profile(df, entities, grid, start, mode, gold=gold, predicted=predicted)
        for choice, profile in (("anchor", {e: start for e in entities}), ("found", found[mode])):
            one = score_profile(df, profile, gold, predicted).select(F.lit(mode).alias("mode"), F.lit(choice).alias("choice"), "predicted", "exact_tp", "exact_precision", "exact_recall", "exact_f1", "leak_rate", "over_redaction_rate")
            rows = one if rows is None else rows.unionByName(one)
    return found, rows


def write_profiles(profiles: dict[str, dict[str, float]], path: str) -> None:
    """Profiles as JSON that :func:`..redact.load_thresholds` reads again."""
    for mode, profile in profiles.items():
        if mode not in ANCHORS or any(not 0 <= t <= 1 for t in profile.values()):
            raise ValueError(f"{mode!r} is no profile of thresholds from 0 to 1")
    Path(path).write_text(json.dumps(profiles, indent=2, sort_keys=True) + "\n", "utf-8")
