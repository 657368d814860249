"""Adapters from published record schemas to the normalised example, with accept/reject routing.

Every adapter is one projection that yields ``example_id, text, spans, source,
language, error``: the first broken rule in ``error``, or null. Routing filters on
it; strict mode raises instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches
from ..functions.chars import slice_text, trimmed
from ..functions.spans import adjacent_overlap, in_order, valid_bounds
from .taxonomy import MASKING_IGNORED, MASKING_LABELS, lookup, normalized_label

ANNOTATION = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("type", T.StringType())]))
# Tag ids of the two published orders, and the spacing of tokenised text.
TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-MISC", "I-MISC"]
LEGACY_TAGS = ["O", "B-ORG", "B-MISC", "B-PER", "I-PER", "B-LOC", "I-ORG", "I-MISC", "I-LOC"]
ATTACH_LEFT = [".", ",", ";", ":", "!", "?", "%", ")", "]", "}", "'s", "'re", "'ve", "'ll", "'d", "'m", "n't"]
NO_SPACE_AFTER = ["(", "[", "{", "$", "#"]


def first_error(*rules: tuple[Column, str]) -> Column:
    """The message of the first rule that is broken (true or null)."""
    return F.coalesce(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(message)) for bad, message in rules), F.lit(None).cast("string"))


def example_error(example_id: Column, text: Column, spans: Column, source: Column, language: Column) -> Column:
    """Why a row is no valid normalised example; null if it is one."""
    return first_error(
        (example_id.isNull() | (trimmed(example_id) == ""), "example_id must not be blank"),
        (text.isNull() | (text == ""), "text must not be empty"),
        (source.isNull() | (trimmed(source) == ""), "source must not be blank"),
        (language.isNull() | (trimmed(language) == ""), "language must not be blank"),
        (spans.isNull() | ~valid_bounds(spans, F.length(text)), "spans must lie in the text"),
        (in_order(spans) != spans, "spans must be sorted"),
        (adjacent_overlap(spans), "spans must not overlap"),
    )


def _text(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def _finish(df: DataFrame, example_id: Column, text: Column, spans: Column, source: str, language: Column, error: Column) -> DataFrame:
    made = df.select("*", error.alias("_e")).select("*", F.when(F.col("_e").isNull(), spans).alias("_s"))
    whole = F.coalesce(F.col("_e"), example_error(example_id, text, F.col("_s"), F.lit(source), language))
    return made.select(example_id.alias("example_id"), text.alias("text"), F.when(whole.isNull(), F.col("_s")).alias("spans"), F.lit(source).alias("source"), language.alias("language"), whole.alias("error"))


def _typed(mask: Column, kind) -> Column:
    """Spans of the mask with mapped types, those without type left out, sorted."""
    rows = F.transform(mask, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), kind(m).alias("entity_type")))
    return in_order(F.filter(rows, lambda s: s.entity_type.isNotNull()))


def _mask_rules(mask: Column, text: Column, known) -> list[tuple[Column, str]]:
    return [
        (mask.isNull(), "annotations must be a list"),
        (F.exists(mask, lambda m: m["start"].isNull() | m["end"].isNull() | m["value"].isNull() | m["label"].isNull()), "an annotation lacks a field"),
        (F.exists(mask, lambda m: known(m).isNull()), "unsupported label"),
        (F.exists(mask, lambda m: (m["start"] < 0) | (m["end"] <= m["start"]) | (m["end"] > F.length(text)) | (slice_text(text, m["start"], m["end"]) != m["value"])), "an annotation does not match the text"),
    ]


def openpii(df: DataFrame) -> DataFrame:
    """``source_text, uid, language, privacy_mask`` rows; values must equal their slices of the text."""
    text, mask = F.col("source_text"), F.col("privacy_mask")
    kind = lambda m: normalized_label(m["label"])
    error = first_error((_text(text), "source_text is required"), (_text(F.col("uid").cast("string")), "uid is required"), (_text(F.col("language")), "language is required"), *_mask_rules(mask, text, kind))
    return _finish(df, F.concat(F.lit("openpii-"), trimmed(F.col("uid").cast("string"))), text, _typed(mask, kind), "openpii", F.col("language"), error)


def gretel(df: DataFrame) -> DataFrame:
    """``index, language, generated_text, pii_spans`` rows; spans are JSON and named by ``label`` or else ``type``."""
    text, raw = F.col("generated_text"), F.col("pii_spans")
    mask = F.from_json(raw, ANNOTATION)
    kind = lambda m: normalized_label(F.coalesce(m["label"], m["type"]))
    error = first_error(
        (_text(text), "generated_text is required"), (_text(F.col("index").cast("string")), "index is required"), (_text(F.col("language")), "language is required"),
        (F.try_parse_json(raw).isNull(), "pii_spans contains invalid JSON"), (mask.isNull(), "pii_spans must be a list"),
        (F.exists(mask, lambda m: m["start"].isNull() | m["end"].isNull() | F.coalesce(m["label"], m["type"]).isNull()), "an annotation lacks a field"),
        (F.exists(mask, lambda m: kind(m).isNull()), "unsupported label"),
        (F.exists(mask, lambda m: (m["start"] < 0) | (m["end"] <= m["start"]) | (m["end"] > F.length(text))), "an annotation lies outside the text"),
    )
    return _finish(df, F.concat(F.lit("gretel-finance-"), trimmed(F.col("index").cast("string"))), text, _typed(mask, kind), "gretel_finance", F.col("language"), error)


def masking(df: DataFrame) -> DataFrame:
    """``id, language, source_text, privacy_mask`` rows; ignored labels are checked and then dropped, others rejected."""
    text, mask = F.col("source_text"), F.col("privacy_mask")
    if dict(df.dtypes)["privacy_mask"] == "string":
        mask = F.from_json(mask, ANNOTATION)
    known = {**MASKING_LABELS, **{x: "" for x in MASKING_IGNORED}}
    label = lambda m: lookup(known, F.upper(m["label"]))
    error = first_error((_text(text), "source_text is required"), (_text(F.col("language")), "language is required"), (_text(F.col("id").cast("string")), "id is required"), *_mask_rules(mask, text, label))
    return _finish(df, F.concat(F.lit("ai4privacy-"), trimmed(F.col("id").cast("string"))), text, _typed(mask, lambda m: F.nullif(label(m), F.lit(""))), "ai4privacy_pii_masking_200k", F.col("language"), error)


def detokenized(tokens: Column) -> Column:
    """``struct<text, offsets>`` of a token array, spaced as text is written; nulls where the array or a token is null."""
    return batches.joined(set(ATTACH_LEFT), set(NO_SPACE_AFTER))(tokens)


def person_spans(tags: Column, offsets: Column) -> Column:
    """PERSON spans of ``B-PER``/``I-PER`` runs; an I-PER without a start opens one. Null where the lists differ in length."""
    return batches.persons(tags, offsets)


def conll(df: DataFrame) -> DataFrame:
    """``id, tokens, ner_tags`` (or legacy ``tags``) rows; PERSON spans over the rebuilt text.

    Tags are names, or ids of the order their column uses. A missing or blank id
    becomes twelve digits of the tokens' SHA-1.
    """
    kinds = dict(df.dtypes)
    column, order = ("ner_tags", TAGS) if "ner_tags" in kinds else ("tags", LEGACY_TAGS)
    if kinds[column] == "array<string>":
        tags = F.transform(column, lambda t: F.when(F.upper(trimmed(t)).isin(*TAGS), F.upper(trimmed(t))))
    else:
        tags = F.transform(column, lambda t: lookup({str(i): n for i, n in enumerate(order)}, t.cast("string")))
    key = trimmed(F.col("id").cast("string")) if "id" in kinds else F.lit(None).cast("string")
    digest = F.substring(F.sha1(F.concat_ws("\x1f", "tokens")), 1, 12)
    error = first_error(
        (F.col("tokens").isNull(), "tokens must be a list"), (F.exists("tokens", lambda t: t.isNull() | (t == "")), "tokens must be non-empty strings"),
        (F.col(column).isNull(), "tags must be a list"), (F.exists(tags, lambda t: t.isNull()), "unsupported tag"),
        (F.size("tokens") == 0, "tokens must not be empty"), (F.size("tokens") != F.size(column), "tokens and tags must have equal lengths"),
    )
    made = df.withColumns({"_d": detokenized(F.col("tokens")), "_tags": tags})
    spans = person_spans(F.col("_tags"), F.col("_d.offsets"))
    return _finish(made, F.concat(F.lit("conll2003-"), F.coalesce(F.nullif(key, F.lit("")), digest)), F.col("_d.text"), spans, "conll2003", F.lit("en"), error)


def hand_labelled(df: DataFrame, language: str = "en") -> DataFrame:
    """``id, text, spans<start,end,label>`` rows; missing spans are none, and labels stay as written."""
    spans = F.coalesce(F.col("spans"), F.expr("cast(array() as array<struct<start:int,end:int,label:string>>)"))
    made = in_order(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("entity_type"))))
    error = first_error((_text(F.col("id")), "id is required"), (_text(F.col("text")), "text is required"))
    return _finish(df, F.concat(F.lit("ood-"), trimmed(F.col("id"))), F.col("text"), made, "ood", F.lit(language), error)


def route(adapted: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``; strict raises on the first broken row instead of rejecting it."""
    if strict:
        fails = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(True))
        return adapted.filter(fails).drop("error"), adapted.limit(0).select("example_id", "error")
    return adapted.filter("error is null").drop("error"), adapted.filter("error is not null").select("example_id", "error")


def load_report(adapted: DataFrame) -> DataFrame:
    """Rows accepted, rejected and in all, and the share accepted, 0 of none."""
    n, ok = F.count(F.lit(1)), F.count(F.when(F.col("error").isNull(), 1))
    return adapted.agg(ok.alias("accepted"), (n - ok).alias("rejected"), n.alias("total"), F.when(n == 0, 0.0).otherwise(ok / F.nullif(n, F.lit(0))).alias("acceptance_rate"))


# ---- chat examples for a generating model

# Fixed value: the instruction the published models were trained with.
SYSTEM_PROMPT = """You detect personally identifiable information in text.
Return JSON only using this schema:
{"spans":[{"start":0,"end":4,"entity_type":"PERSON"}]}

Rules:
- Offsets are zero-based character offsets into the exact input text.
- Spans use half-open intervals: start is inclusive and end is exclusive.
- Return spans in ascending source order.
- Use only entity types learned from the training data.
- Do not include explanations, markdown, or copied PII values.
- If no PII exists, return {"spans":[]}."""


def chat_target(spans: Column) -> Column:
    """Gold spans as compact JSON."""
    return F.to_json(F.struct(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"))).alias("spans")))


def chat_messages(text: Column, spans: Column) -> Column:
    """System, user and assistant messages of an example."""
    rows = (("system", F.lit(SYSTEM_PROMPT)), ("user", text), ("assistant", chat_target(spans)))
    return F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in rows))
