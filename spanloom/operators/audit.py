"""Robustness under perturbed text, and reuse of training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import characters, normalized, slice_text
from ..functions.ratios import ratio
from ..functions.spans import bare, let
from ..plans.skew import attach
from .metrics import dataset_score, document_measures


def _each(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``f`` applied to every character by itself."""
    return lambda text: F.array_join(F.transform(characters(text), f), "")


# What changes a text without changing what it says.
PERTURBATIONS: dict[str, Callable[[Column], Column]] = {
    "lowercase": _each(F.lower),
    "uppercase": _each(F.upper),
    "double_spaces": lambda t: F.replace(t, F.lit(" "), F.lit("  ")),
    "nbsp_spaces": lambda t: F.replace(t, F.lit(" "), F.lit(" ")),
    "unicode_dashes": lambda t: F.replace(t, F.lit("-"), F.lit("–")),
    "curly_apostrophes": lambda t: F.replace(t, F.lit("'"), F.lit("’")),
}


def perturbed(text: Column, spans: Column, f: Callable[[Column], Column]) -> Column:
    """``struct<text, spans>`` after a change by character; a boundary moves to the length of its changed prefix.

    No change makes a character vanish, so where the whole keeps its length all boundaries stay.
    """
    move = lambda at: F.length(f(slice_text(text, F.lit(0), at)))
    moved = F.transform(spans, lambda s: F.struct(move(s.start).alias("start"), move(s.end).alias("end"), s.entity_type.alias("entity_type")))
    return let(f(text), lambda t: F.struct(t.alias("text"), F.when(F.length(t) == F.length(text), bare(spans)).otherwise(moved).alias("spans")))


def perturb(df: DataFrame, families: list[str] | None = None, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` once per family that changes its text, with ``family, perturbed_text, perturbed_spans``."""
    parts = []
    for name in families or list(PERTURBATIONS):
        changed = df.withColumn("family", F.lit(name)).withColumn("_r", perturbed(F.col(text), F.col(spans), PERTURBATIONS[name]))
        changed = changed.withColumns({"perturbed_text": F.col("_r.text"), "perturbed_spans": F.col("_r.spans")}).drop("_r")
        parts.append(changed.filter(F.col("perturbed_text") != F.col(text)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefixed(df: DataFrame, words: int, text: str = "text", spans: str = "spans") -> DataFrame:
    """Rows with spans behind a prefix of ``words`` filler words, spans moved."""
    fill, n = "context ", 8 * words
    moved = F.transform(spans, lambda s: F.struct((s.start + n).alias("start"), (s.end + n).alias("end"), s.entity_type.alias("entity_type")))
    return df.filter(F.size(spans) > 0).withColumn("family", F.lit(f"prefix-{words}")).withColumns({"perturbed_text": F.concat(F.repeat(F.lit(fill), F.lit(words)), F.col(text)), "perturbed_spans": moved})


def robustness(df: DataFrame, detect: Callable[[Column], Column], families: list[str] | None = None, prefixes: tuple[int, ...] = ()) -> DataFrame:
    """``family, changed`` and each family's scores before and after, on the rows it changes, with their difference."""
    rows = perturb(df, families)
    for n in prefixes:
        rows = rows.unionByName(prefixed(df, n))
    before = rows.withColumn("predictions", detect(F.col("text")))
    after = rows.withColumns({"text": F.col("perturbed_text"), "spans": F.col("perturbed_spans")}).withColumn("predictions", detect(F.col("text")))
    names = ["exact_f1", "partial_f1", "leak_rate", "over_redaction_rate"]
    b = dataset_score(document_measures(before), "family").select("family", F.col("examples").alias("changed"), *(F.col(n).alias(f"{n}_before") for n in names))
    a = dataset_score(document_measures(after), "family").select("family", *(F.col(n).alias(f"{n}_after") for n in names))
    return b.join(a, "family").select("*", *((F.col(f"{n}_after") - F.col(f"{n}_before")).alias(f"{n}_delta") for n in names))


def _signs(c: Column) -> list[Column]:
    """A text as 128 bits; texts themselves don't travel."""
    return [F.xxhash64(F.lit(k), c).alias(f"k{k}") for k in (1, 2)]


def _seen(rows: DataFrame, train: str, *by: str) -> DataFrame:
    """Keys that training holds, once each; ``rows`` has ``part`` and the keys."""
    return rows.filter(F.col("part") == train).select(*by).distinct().withColumn("_hit", F.lit(1))


def _met(rows: DataFrame, train: str, *by: str) -> DataFrame:
    """Rows of other parts counted by part and key, with ``_hit`` where training holds the key.

    They are counted before they are joined, so a hot key is one row per part.
    """
    counted = rows.filter(F.col("part") != train).groupBy("part", *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(_seen(rows, train, *by), list(by), "left")


def duplicate_stats(df: DataFrame, part: str = "split", text: str = "text", train: str = "train", folded: bool = False) -> DataFrame:
    """``part, target_examples, matching_examples, rate``: texts of other parts that training holds, as stored or normalised. Null texts match nothing."""
    c = normalized(F.col(text)) if folded else F.col(text)
    rows = df.select(F.col(part).alias("part"), c.isNull().alias("_none"), *_signs(c))
    met = _met(rows, train, "_none", "k1", "k2")
    hits = F.sum(F.when(F.col("_hit").isNotNull() & ~F.col("_none"), F.col("n")).otherwise(0))
    return met.groupBy("part").agg(F.sum("n").alias("target_examples"), hits.alias("matching_examples")).withColumn("rate", ratio(F.col("matching_examples"), F.col("target_examples")))


def duplicate_samples(df: DataFrame, key: str, part: str = "split", text: str = "text", train: str = "train", k: int = 25, folded: bool = False) -> DataFrame:
    """The first ``k`` ids by part whose text training holds."""
    from pyspark.sql.window import Window

    c = normalized(F.col(text)) if folded else F.col(text)
    rows = df.filter(c.isNotNull()).select(F.col(part).alias("part"), F.col(key), *_signs(c))
    other = rows.filter(F.col("part") != train)
    held = _met(rows, train, "k1", "k2").filter("_hit is not null").groupBy("k1", "k2").agg(F.sum("n").alias("copies"))
    met = attach(other, held, ["k1", "k2"], other.count())
    return met.select("part", key, F.row_number().over(Window.partitionBy("part").orderBy(key)).alias("rank")).filter(F.col("rank") <= k)


def value_overlap(df: DataFrame, part: str = "split", text: str = "text", spans: str = "spans", train: str = "train") -> DataFrame:
    """``part, entity_type, gold_spans, seen_in_train, rate`` of normalised span values."""
    rows = df.select(F.col(part).alias("part"), F.col(text).alias("_t"), F.explode_outer(spans).alias("s")).filter("s is not null")
    rows = rows.select("part", F.col("s.entity_type").alias("entity_type"), *_signs(normalized(slice_text(F.col("_t"), F.col("s.start"), F.col("s.end")))))
    met = _met(rows, train, "entity_type", "k1", "k2")
    sums = met.groupBy("part", "entity_type").agg(F.sum("n").alias("gold_spans"), F.sum(F.when(F.col("_hit").isNotNull(), F.col("n")).otherwise(0)).alias("seen_in_train"))
    return sums.withColumn("rate", ratio(F.col("seen_in_train"), F.col("gold_spans")))
