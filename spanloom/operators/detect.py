"""Detectors: text in, typed spans with scores out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import batches
from ..functions.chars import trimmed
from ..functions.spans import SCORED, empty, in_order, let, merge_fragments, of_types, resolve_greedy
from .bio import windowed_spans
from .normalize import SYSTEM_PROMPT as INSTRUCTION

# The structured identifiers, as Python patterns.
PATTERNS = {
    "EMAIL": r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "PHONE": r"(?<!\w)(?:\+?\d[\d ().-]{6,}\d)(?!\w)",
    "IP_ADDRESS": r"(?<!\w)(?:\d{1,3}\.){3}\d{1,3}(?!\w)",
}
# Labels of an external analyzer.
ANALYZER_LABELS = {
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "IP_ADDRESS": "IP_ADDRESS", "PERSON": "PERSON",
    "LOCATION": "LOCATION", "CREDIT_CARD": "CREDIT_CARD", "US_SSN": "SOCIAL_SECURITY_NUMBER", "IBAN_CODE": "BANK_ACCOUNT",
}

Predictor = Callable[[str], Sequence[tuple]]


_TELLS = re.compile(r"[@\d]")  # without one of these no default pattern matches


def regex_spans(text: Column, entities: set[str] | None = None, patterns: dict[str, str] | None = None, resolve: bool = True) -> Column:
    """Matches of Python patterns, overlaps resolved.

    ``entities`` picks patterns while the plan is built: None is all, an empty
    set is none. Null text gives null, an empty one no spans.
    """
    chosen = {k: p for k, p in (patterns or PATTERNS).items() if entities is None or k in entities}
    if not chosen:
        return F.when(text.isNotNull(), empty(SCORED))
    return batches.matches(text, chosen, resolve, _TELLS.search if patterns is None else None)


def predicted_spans(text: Column, load: Callable[[], Predictor], entities: set[str] | None = None, labels: dict[str, str] | None = None, resolve: bool = False) -> Column:
    """Spans ``(start, end, type, score)`` of an injected model, sorted.

    ``load`` runs once per Python worker. Labels are renamed by ``labels``, others
    pass through. ``entities`` filters afterwards; overlaps stay unless asked.
    """
    state: dict[str, Predictor] = {}

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity_type", T.StringType()), T.StructField("score", T.DoubleType())])))
    def run(texts: pd.Series) -> pd.Series:
        model = state.get("model") or state.setdefault("model", load())
        names = labels or {}
        return texts.map(lambda t: None if t is None else [{"start": int(s[0]), "end": int(s[1]), "entity_type": names.get(s[2], s[2]), "score": None if len(s) < 4 or s[3] is None else float(s[3])} for s in model(t)])

    found = of_types(in_order(run(text), SCORED), entities)
    return resolve_greedy(found) if resolve else found


def cached_predictions(df: DataFrame, text: str, load: Callable[[], Predictor]) -> DataFrame:
    """``df`` with ``predictions``: the model runs once per distinct text and is joined back."""
    distinct = df.select(F.col(text).alias("_text")).distinct()
    known = distinct.withColumn("predictions", predicted_spans(F.col("_text"), load))
    return df.join(known, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def detector(name: str, merge_person: bool = False, **settings) -> Callable[[Column], Column]:
    """A detector by name: ``regex``, ``analyzer``, ``encoder``, ``windows`` or ``generator``.

    ``encoder`` has an injected model of whole texts, ``windows`` a token
    classifier with a bounded window; for these two, ``merge_person`` joins the
    fragments of names. ``generator`` has a model that writes spans as JSON; where
    it writes something else, spans are null, which :func:`failure_rate` counts.
    """
    makers: dict[str, Callable[[Column], Column]] = {
        "regex": lambda text: regex_spans(text, **settings), "analyzer": lambda text: predicted_spans(text, labels=ANALYZER_LABELS, **settings),
        "encoder": lambda text: predicted_spans(text, **settings), "windows": lambda text: windowed_spans(text, **settings),
        "generator": lambda text: generated_spans(text, **settings)["spans"],
    }
    if name not in makers:
        raise ValueError(f"unknown detector {name!r}")
    if not merge_person:
        return makers[name]
    if name not in ("encoder", "windows"):
        raise ValueError(f"names are joined for encoders only, not for {name!r}")
    return lambda text: merge_fragments(text, makers[name](text), {"PERSON"})


# ---- spans written as JSON by a generating model


def generated(text: Column, load: Callable[[], Callable[[list[dict]], str]]) -> Column:
    """What an injected model writes to the instruction and each text; ``load`` runs once per worker. Null gives null."""
    state: dict[str, Callable[[list[dict]], str]] = {}

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        write = state.get("model") or state.setdefault("model", load())
        ask = lambda t: write([{"role": "system", "content": INSTRUCTION}, {"role": "user", "content": t}])
        return pd.Series([None if t is None else ask(t) for t in texts], dtype=object)

    return run(text)


def generated_spans(text: Column, load: Callable[[], Callable[[list[dict]], str]], types: set[str] | None = None) -> Column:
    """``struct<spans, error>`` of what an injected model writes, read strictly."""
    return let(generated(text, load), lambda output: parse_object_output(text, output, types))


def _items(spans: Column) -> Column:
    """Raw items of a JSON list, each with what its rules need to know."""
    def item(x: Column) -> Column:
        def read(v: Column) -> Column:
            shape = F.coalesce(F.schema_of_variant(v), F.lit(""))
            return F.struct(
                F.try_variant_get(v, "$.start", "int").alias("start"), F.try_variant_get(v, "$.end", "int").alias("end"), F.try_variant_get(v, "$.entity_type", "string").alias("entity_type"),
                shape.alias("shape"), F.array_sort(F.json_object_keys(x)).alias("keys"),
            )

        return let(F.try_parse_json(x), read)

    return F.transform(spans, item)


def _broken(spans: Column, rule: Callable[[Column], Column]) -> Column:
    return F.exists(spans, lambda s: ~F.coalesce(rule(s), F.lit(False)))


def _before(spans: Column, wrong: Callable[[Column, Column], Column]) -> Column:
    """Whether a span and the one behind it are ``wrong``."""
    behind = F.slice(spans, F.lit(2), F.greatest(F.size(spans) - 1, F.lit(0)))
    return F.exists(F.zip_with(spans, behind, lambda a, b: F.coalesce(wrong(a, b), F.lit(False))), lambda x: x)


def parse_object_output(text: Column, output: Column, types: set[str] | None = None) -> Column:
    """``struct<spans, error>`` of a JSON object ``{"spans": [...]}``, strictly.

    The object has no other key, each span exactly start, end and entity_type,
    offsets are integers in the text, types have no outer blanks, and spans are
    sorted without overlap. The first broken rule is the error and spans are null.
    """
    whole = [rf"\b{k}: BIGINT\b" for k in ("start", "end")]
    of_span: list[tuple[str, Callable[[Column], Column]]] = [
        ("no JSON object stands for a span", lambda s: s["shape"].startswith("OBJECT<")),
        ("a span has other keys than start, end and entity_type", lambda s: s["keys"] == F.array(F.lit("end"), F.lit("entity_type"), F.lit("start"))),
        ("an offset is no integer", lambda s: s["shape"].rlike(whole[0]) & s["shape"].rlike(whole[1])),
        ("offsets lie outside the text or run backwards", lambda s: (s.start >= 0) & (s.end > s.start) & (s.end <= F.length(text))),
        ("a type is blank or no text", lambda s: s["shape"].rlike(r"\bentity_type: STRING\b") & (trimmed(s.entity_type) != "")),
        ("white space surrounds a type", lambda s: trimmed(s.entity_type) == s.entity_type),
    ]
    if types is not None:
        of_span.append(("a type is not among those asked for", lambda s: s.entity_type.isin(*sorted(types))))

    def judged(top: Column, spans: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(output), F.array(F.lit("")))
        rules = [
            ("not JSON", output.isNull() | top.isNull()), ("no JSON object", ~top.startswith("OBJECT<")), ("'spans' is not the one key", keys != F.array(F.lit("spans"))),
            ("'spans' is no JSON list", ~top.startswith("OBJECT<spans: ARRAY<") | spans.isNull()), *((m, _broken(spans, rule)) for m, rule in of_span),
            ("a span begins before its forerunner", _before(spans, lambda a, b: b.start < a.start)), ("a span begins inside its forerunner", _before(spans, lambda a, b: b.start < a.end)),
        ]
        error = F.coalesce(*(F.when(bad, F.lit(m)) for m, bad in rules), F.lit(None).cast("string"))
        plain = F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"), F.lit(None).cast("double").alias("score")))
        return let(error, lambda e: F.struct(F.when(e.isNull(), plain).alias("spans"), e.alias("error")))

    listed = F.from_json(F.get_json_object(output, "$.spans"), "array<string>")
    return let(F.schema_of_variant(F.try_parse_json(output)), lambda top: let(_items(listed), lambda spans: judged(top, spans)))


def parse_list(text: str, output: str | None, types: set[str] | None = None) -> list[tuple[int, int, str, float | None]]:
    """Spans of a JSON list with optional scores, sorted; other keys are let pass. Raises ValueError."""
    try:
        payload = json.loads(output)
    except (TypeError, json.JSONDecodeError) as e:
        raise ValueError("not JSON") from e
    if not isinstance(payload, list):
        raise ValueError("no JSON list")
    out = []
    for i, x in enumerate(payload):
        if not isinstance(x, dict):
            raise ValueError(f"item {i} is no JSON object")
        a, b, k, p = x.get("start"), x.get("end"), x.get("entity_type"), x.get("score")
        whole = all(isinstance(v, int) and not isinstance(v, bool) for v in (a, b))
        scored = p is None or (isinstance(p, (int, float)) and not isinstance(p, bool) and 0 <= p <= 1)
        if not whole or not 0 <= a < b or not isinstance(k, str) or not k.strip() or not scored:
            raise ValueError(f"item {i} has wrong offsets, type or score")
        if b > len(text):
            raise ValueError(f"item {i} ends past the text")
        if types is None or k in types:
            out.append((a, b, k, None if p is None else float(p)))
    return sorted(out, key=lambda s: s[:3])


def parse_list_output(df: DataFrame, text: str, output: str, types: set[str] | None = None) -> DataFrame:
    """``df`` with ``spans`` and ``error`` from a column of JSON lists; a broken list has null spans."""
    shape = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, errors = [], []
            for t, o in zip(b.column(text).to_pylist(), b.column(output).to_pylist()):
                try:
                    spans.append([dict(zip(("start", "end", "entity_type", "score"), s)) for s in parse_list(t or "", o, types)])
                    errors.append(None)
                except ValueError as e:
                    spans.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spans, shape), pa.array(errors, pa.string())], [*b.schema.names, "spans", "error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", spans array<{SCORED}>, error string"
    return df.mapInArrow(run, schema)


def failure_rate(df: DataFrame, error: str = "error") -> DataFrame:
    """Rows, failures, and their share."""
    n, bad = F.count(F.lit(1)), F.count(error)
    return df.agg(n.alias("examples"), bad.alias("failures"), F.when(n == 0, 0.0).otherwise(bad / F.nullif(n, F.lit(0))).alias("failure_rate"))
