"""Quality of predicted spans against gold spans.

Rows carry both arrays. Per-document measures are narrow; a data set needs one
aggregate of integer sums, combined before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ratios import prf, ratio
from ..functions.spans import bare, covered, error_kind, exact_hits, false_positives, leaked, over_redacted, partial_hits, valid_bounds


def required(found: Column, message: Column) -> Column:
    """A filter that raises where ``found`` is null.

    It counts as non-deterministic, or else the optimizer would let a later filter
    on the missing side turn the outer join into one without those rows.
    """
    return F.when(found.isNull(), F.raise_error(message)).otherwise(F.monotonically_increasing_id() >= 0)


def joined(gold: DataFrame, predicted: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Gold rows with the predictions of their key; an unknown key on the right is an error if strict.

    Rows without predictions get none. Both sides must have unique keys.
    """
    g, p = gold.drop("predictions").withColumn("_g", F.lit(True)), predicted.select(F.col(key), "predictions")
    both = g.join(p, key, "full_outer" if strict else "left")
    if strict:
        both = both.filter(required(F.col("_g"), F.lit("predictions for an unknown example")))
    return both.withColumn("predictions", F.coalesce("predictions", F.expr("cast(array() as array<struct<start:int,end:int,entity_type:string,score:double>>)"))).drop("_g")


def document_measures(df: DataFrame, gold: str = "spans", predicted: str = "predictions", length: Column | None = None) -> DataFrame:
    """``df`` with integer measures of each row.

    ``n_gold, n_pred, n_gold_distinct, n_pred_distinct, exact_tp, partial_tp,
    leaked, fp_chars, non_pii``; exact counts collapse repeated spans, partial
    ones and ``n_pred`` don't. Spans outside the text are an error of the character
    measures.
    """
    found = measures(F.col(gold), F.col(predicted), F.length("text") if length is None else length)
    return df.withColumns(found)


def _within(inside: Column, value: Column) -> Column:
    return F.when(inside, value).when(~inside, F.raise_error(F.lit("a span does not lie in its text")))


def measures(g: Column, p: Column, n: Column) -> dict[str, Column]:
    """The integer measures of one document by name."""
    inside = valid_bounds(bare(g), n) & valid_bounds(bare(p), n)
    return {
        "n_gold": F.size(g), "n_pred": F.size(p), "n_gold_distinct": F.size(F.array_distinct(bare(g))), "n_pred_distinct": F.size(F.array_distinct(bare(p))),
        "exact_tp": exact_hits(g, p), "partial_tp": partial_hits(g, p), "leaked": leaked(g, p),
        "fp_chars": _within(inside, over_redacted(g, p)), "non_pii": _within(inside, n - covered(g)),
    }


def dataset_score(measured: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged scores of measured rows, in all or by columns."""
    s = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    sums = measured.groupBy(*by).agg(
        F.count(F.lit(1)).alias("examples"), s("n_gold").alias("gold"), s("n_pred").alias("predicted"), s("exact_tp").alias("exact_tp"),
        (s("n_pred_distinct") - s("exact_tp")).alias("exact_fp"), (s("n_gold_distinct") - s("exact_tp")).alias("exact_fn"),
        s("partial_tp").alias("partial_tp"), (s("n_pred") - s("partial_tp")).alias("partial_fp"), (s("n_gold") - s("partial_tp")).alias("partial_fn"),
        s("leaked").alias("leaked"), s("fp_chars").alias("fp_chars"), s("non_pii").alias("non_pii"),
    )
    c = F.col
    return sums.select(
        "*", *prf(c("exact_tp"), c("exact_fp"), c("exact_fn"), "exact_"), *prf(c("partial_tp"), c("partial_fp"), c("partial_fn"), "partial_"),
        ratio(c("leaked"), c("gold")).alias("leak_rate"), ratio(c("fp_chars"), c("non_pii")).alias("over_redaction_rate"),
    )


def entity_recall(df: DataFrame, gold: str = "spans", predicted: str = "predictions") -> DataFrame:
    """``entity_type, gold, found, recall``: exact recall by gold type, repeated spans of a row counted once."""
    hits = F.array_distinct(bare(F.col(predicted)))
    rows = df.select(F.explode_outer(F.array_distinct(bare(F.col(gold)))).alias("s"), hits.alias("p")).filter("p is not null")
    rows = rows.select(F.col("s.entity_type").alias("entity_type"), F.array_contains("p", F.col("s")).cast("long").alias("hit"))
    sums = rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("gold"), F.sum("hit").alias("found"))
    return sums.withColumn("recall", ratio(F.col("found"), F.col("gold")))


def prediction_correctness(df: DataFrame, key: str, gold: str = "spans", predicted: str = "predictions") -> DataFrame:
    """One row per prediction: ``key, start, end, entity_type, score, correct``; correct is an exact match."""
    rows = df.select(key, bare(F.col(gold)).alias("g"), F.explode_outer(predicted).alias("p")).filter("p is not null")
    here = F.struct(F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.entity_type").alias("entity_type"))
    return rows.select(key, F.col("p.start").alias("span_start"), F.col("p.end").alias("span_end"), F.col("p.entity_type").alias("entity_type"), F.col("p.score").alias("score"), F.array_contains("g", here).alias("correct"))


def gold_errors(df: DataFrame, key: str, gold: str = "spans", predicted: str = "predictions") -> DataFrame:
    """One row per gold span without an exact prediction: ``key, span_start, span_end, entity_type, kind``."""
    kinds = F.transform(gold, lambda g: F.struct(g.start.alias("span_start"), g.end.alias("span_end"), g.entity_type.alias("entity_type"), error_kind(F.col("text"), g, F.col(predicted)).alias("kind")))
    return df.select(key, F.explode_outer(kinds).alias("e")).filter("e is not null").select(key, "e.*").filter("kind is not null")


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("kind").agg(F.count(F.lit(1)).alias("errors"))


def error_samples(errors: DataFrame, key: str, k: int) -> DataFrame:
    """The first ``k`` errors of each kind by key and place."""
    w = Window.partitionBy("kind").orderBy(key, "span_start", "span_end")
    return errors.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def false_positive_rows(df: DataFrame, key: str, gold: str = "spans", predicted: str = "predictions") -> DataFrame:
    """One row per prediction that overlaps no gold span of its type."""
    return df.select(key, F.explode_outer(false_positives(F.col(gold), F.col(predicted))).alias("p")).filter("p is not null").select(key, F.col("p.start").alias("span_start"), F.col("p.end").alias("span_end"), F.col("p.entity_type").alias("entity_type"))


def lost_matches(before: DataFrame, after: DataFrame, key: str, gold: str = "spans", predicted: str = "predictions") -> DataFrame:
    """Gold spans that the first predictions hit exactly and the second don't."""
    def hits(df: DataFrame) -> DataFrame:
        return df.select(key, F.explode_outer(F.array_intersect(bare(F.col(gold)), bare(F.col(predicted)))).alias("s")).filter("s is not null").select(key, F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"))

    return hits(before).join(hits(after), [key, "span_start", "span_end", "entity_type"], "left_anti")
