"""Reversible replacement of spans by typed placeholders."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import batches
from ..functions.chars import slice_text
from ..functions.spans import above, bare
from .detect import regex_spans

# The published confidence thresholds.
PROFILES = {
    "balanced": {
        "ADDRESS": 0.55, "BANK_ACCOUNT": 0.8, "COMPANY": 0.9, "CREDIT_CARD": 0.75, "DATE": 0.8, "EMAIL": 0.95,
        "ID_NUMBER": 0.6, "IP_ADDRESS": 0.95, "LOCATION": 0.95, "PASSWORD": 0.9, "PERSON": 0.6, "PHONE": 0.95,
        "POSTAL_CODE": 0.5, "SECRET": 0.6, "SOCIAL_SECURITY_NUMBER": 0.65, "SWIFT_CODE": 0.85, "TITLE": 0.9, "USERNAME": 0.6,
    },
    "strict": {
        "ADDRESS": 0.4, "BANK_ACCOUNT": 0.4, "COMPANY": 0.55, "CREDIT_CARD": 0.5, "DATE": 0.6, "EMAIL": 0.95,
        "ID_NUMBER": 0.5, "IP_ADDRESS": 0.9, "LOCATION": 0.95, "PASSWORD": 0.9, "PERSON": 0.5, "PHONE": 0.35,
        "POSTAL_CODE": 0.4, "SECRET": 0.45, "SOCIAL_SECURITY_NUMBER": 0.4, "SWIFT_CODE": 0.7, "TITLE": 0.75, "USERNAME": 0.6,
    },
}


def replace_spans(text: Column, spans: Column) -> Column:
    """``struct<text, mapping, error>``: placeholders for spans, numbered by position within their type.

    Text and mapping are null where spans overlap or leave the text. Null text or
    spans give nulls.
    """
    return batches.replaced(text, bare(spans))


def restore(text: Column, mapping: Column) -> Column:
    """``struct<text, error>``: values put back in order; each placeholder must occur exactly once in the text so far."""
    return batches.put_back(text, mapping)


def load_thresholds(mode: str = "balanced", path: str | None = None) -> dict[str, float]:
    """A threshold profile by mode, from the JSON file at ``path`` or the published one, validated."""
    if mode not in ("balanced", "strict"):
        raise ValueError("mode must be 'balanced' or 'strict'")
    profile = (json.loads(Path(path).read_text("utf-8")) if path else PROFILES).get(mode)
    if not isinstance(profile, dict):
        raise ValueError(f"profile {mode!r} must be an object")
    for k, v in profile.items():
        if not isinstance(k, str) or not k.strip():
            raise ValueError("threshold names must be non-empty strings")
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            raise TypeError(f"threshold of {k} must be numeric")
        if not 0 <= v <= 1:
            raise ValueError(f"threshold of {k} must be between 0 and 1")
    return {k: float(v) for k, v in profile.items()}


class Scrubber:
    """Detect, threshold, replace; and put back. Empty thresholds mean those of the profile."""

    def __init__(self, detect: Callable[[Column], Column] | None = None, mode: str = "balanced", thresholds: dict[str, float] | None = None):
        for k, v in (thresholds or {}).items():
            if isinstance(v, bool) or not isinstance(v, (int, float)) or not 0 <= v <= 1:
                raise ValueError(f"threshold of {k} must be between 0 and 1")
        self.detect, self.thresholds = detect, dict(thresholds or {}) or load_thresholds(mode)

    def spans(self, text: Column, entities: set[str] | None = None) -> Column:
        found = self.detect(text) if self.detect else regex_spans(text, entities)
        return above(found, self.thresholds)

    def scrub(self, df: DataFrame, text: str = "text", entities: set[str] | None = None) -> DataFrame:
        """``df`` with ``spans``, ``redacted_text``, ``mapping``; a narrow plan that also runs on streams."""
        found = df.withColumn("spans", self.spans(F.col(text), entities))
        done = found.withColumn("_r", replace_spans(F.col(text), F.col("spans")))
        return done.withColumns({"redacted_text": F.col("_r.text"), "mapping": F.col("_r.mapping")}).drop("_r")

    def restore(self, df: DataFrame, redacted: str = "redacted_text", mapping: str = "mapping") -> DataFrame:
        done = df.withColumn("_r", restore(F.col(redacted), F.col(mapping)))
        return done.withColumns({"restored_text": F.col("_r.text"), "restore_error": F.col("_r.error")}).drop("_r")


def long_mapping(df: DataFrame, doc: str, text: str, spans: str) -> DataFrame:
    """One row per span with its placeholder, numbered by a window over document and type."""
    rows = df.select(F.col(doc).alias("doc"), F.col(text).alias("t"), F.explode_outer(spans).alias("s")).filter("s is not null")
    w = Window.partitionBy("doc", "s.entity_type").orderBy("s.start", "s.end")
    n = F.row_number().over(w)
    mark = F.concat(F.lit("["), F.col("s.entity_type"), F.lit("_"), n.cast("string"), F.lit("]"))
    return rows.select(F.col("doc").alias(doc), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), mark.alias("placeholder"), slice_text(F.col("t"), F.col("s.start"), F.col("s.end")).alias("value"))
