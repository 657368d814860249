"""Every query of the core with its SQL.

Queries read whole tables. Arrays are taken apart by explode_outer and a filter on
the result: a plain explode lets the optimizer infer a filter that works the whole
array expression out once more. Three recipes supply gold and predicted spans:

* annotated rows of ``dataset_examples`` whose spans are usable, with
  ``window_predictions`` as predictions (A);
* spans made from ``lineitem``, an order being a document (L);
* rows of ``lineitem`` as predictions of overlapping windows (W).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import bare, in_order, merge_fragments, merge_windows, distinct_windows, valid_bounds, adjacent_overlap
from ..operators import audit, bio, calibrate, datasets, detect, metrics, normalize, redact, taxonomy
from ..sources import jsonl
from ..sources.tables import table
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: q for k, q in oracle.sql().items() if k in _QUERIES}


# ---- inputs


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _annotated(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    """Rows of dataset_examples whose spans are usable: in bounds, apart, sorted."""
    df = (table(spark, folder, "dataset_examples") if rows is None else rows).filter("spans is not null and text is not null")
    spans = in_order(bare(F.col("spans")))
    ok = valid_bounds(F.col("spans"), F.length("text")) & ~adjacent_overlap(F.col("spans"))
    return df.filter(ok).withColumn("spans", spans)


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    """``row_id, windows`` of window_predictions."""
    s = F.struct("window_index", F.col("span_start").alias("start"), F.col("span_end").alias("end"), "entity_type", "score")
    return table(spark, folder, "window_predictions").groupBy("row_id").agg(F.array_sort(F.collect_list(s)).alias("windows"))


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated rows with their merged window predictions.

    A row without windows has none. A prediction of an unknown row, and one that
    ends past its text, are errors, as they would make scores better.
    """
    merged = F.transform(merge_windows(F.col("windows")), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"), s.score.alias("score")))
    windows = _windows(spark, folder)
    last = F.array_max(F.transform("windows", lambda s: s.end))  # before the merge, which could hide it
    preds = windows.select("row_id", F.struct(merged.alias("spans"), last.alias("last")).alias("predictions"))
    rows = table(spark, folder, "dataset_examples").withColumn("_g", F.lit(True)).join(preds, "row_id", "full_outer")
    unknown = F.concat(F.lit("predictions for an unknown row "), F.col("row_id").cast("string"))
    rows = _annotated(spark, folder, rows.filter(metrics.required(F.col("_g"), unknown)).drop("_g"))
    error = F.raise_error(F.concat(F.lit("a prediction ends past the text of row "), F.col("row_id").cast("string")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,entity_type:string,score:double>>)")
    return rows.withColumn("predictions", F.when(F.col("predictions.last") > F.length("text"), error).otherwise(F.coalesce("predictions.spans", none)))


def _lineitem(spark: SparkSession, folder: str, query: str) -> DataFrame:
    return spark.sql(query.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, folder, "lineitem"))


def _long_gold(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem(spark, folder, oracle.GOLD)


def _long_pred(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem(spark, folder, f"WITH gold AS ({oracle.GOLD}), pred AS ({oracle.PRED}) SELECT * FROM pred")


def _recipe(spark: SparkSession, folder: str) -> DataFrame:
    """The L recipe with arrays: ``doc_id, text, spans, predictions``; texts are 400 blanks."""
    s = F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), F.col("ty").alias("entity_type"))
    p = F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), F.col("ty").alias("entity_type"), F.col("score"))
    gold = _long_gold(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_list(s)).alias("spans"))
    pred = _long_pred(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_list(p)).alias("predictions"))
    return metrics.joined(gold, pred, "doc_id").withColumn("text", F.lit(" " * 400))


def _w_recipe(spark: SparkSession, folder: str) -> DataFrame:
    s = F.struct("window_index", F.col("s").alias("start"), F.col("e").alias("end"), F.col("ty").alias("entity_type"), "score")
    return _lineitem(spark, folder, oracle.WINDOWS).groupBy("doc_id").agg(F.array_sort(F.collect_list(s)).alias("windows"))


def _exploded(df: DataFrame, key: str, spans: str) -> DataFrame:
    return df.select(key, F.explode_outer(spans).alias("s")).filter("s is not null").select(key, F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"))


# ---- detection and resolution


def _detect(kind: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        docs = _docs(spark, folder).select("doc_id", detect.regex_spans(F.col("text"), {kind}).alias("found"))
        return _exploded(docs, "doc_id", "found")

    return run


_QUERIES |= {"detect_email": _detect("EMAIL"), "detect_phone": _detect("PHONE"), "detect_ip": _detect("IP_ADDRESS")}


@_query
def detect_resolved(spark, folder):
    docs = _docs(spark, folder).select("doc_id", detect.regex_spans(F.col("text")).alias("found"))
    return _exploded(docs, "doc_id", "found")


@_query
def redact_documents(spark, folder):
    out = redact.Scrubber().scrub(_docs(spark, folder))
    return out.select("doc_id", "redacted_text", F.size("spans").alias("n_spans"))


@_query
def redaction_mapping(spark, folder):
    out = _docs(spark, folder).withColumn("found", detect.regex_spans(F.col("text"), {"EMAIL", "IP_ADDRESS"}))
    return redact.long_mapping(out, "doc_id", "text", "found")


@_query
def restore_roundtrip(spark, folder):
    s = redact.Scrubber()
    out = s.restore(s.scrub(_docs(spark, folder)))
    return out.select("doc_id", "restored_text", F.coalesce(F.col("restored_text") == F.col("text"), F.col("text").isNull()).alias("same"))


@_query
def redact_annotated(spark, folder):
    rows = _annotated(spark, folder)
    return rows.select("row_id", redact.replace_spans(F.col("text"), F.col("spans"))["text"].alias("redacted_text"))


@_query
def span_values(spark, folder):
    rows = _annotated(spark, folder).select("row_id", "text", F.explode_outer("spans").alias("s")).filter("s is not null")
    return rows.select("row_id", F.col("s.entity_type").alias("entity_type"), F.expr("substring(text, s.start + 1, s.end - s.start)").alias("value"), F.expr("s.end - s.start").alias("n"))


def _thresholds(mode: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        s = F.struct(F.col("span_start").alias("start"), F.col("span_end").alias("end"), "entity_type", "score")
        from ..functions.spans import above

        rows = table(spark, folder, "window_predictions").select("row_id", "window_index", F.array(s).alias("p"))
        kept = rows.select("row_id", "window_index", F.explode_outer(above(F.col("p"), redact.load_thresholds(mode))).alias("s")).filter("s is not null")
        return kept.select("row_id", "window_index", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"), F.col("s.score").alias("score"))

    return run


_QUERIES |= {"threshold_filter_balanced": _thresholds("balanced"), "threshold_filter_strict": _thresholds("strict")}


@_query
def window_dedup(spark, folder):
    kept = _w_recipe(spark, folder).select("doc_id", F.explode_outer(distinct_windows(F.col("windows"))).alias("s")).filter("s is not null")
    return kept.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"), F.col("s.window_index").alias("window_index"), F.col("s.score").alias("score"))


@_query
def window_merge(spark, folder):
    kept = _w_recipe(spark, folder).select("doc_id", F.explode_outer(merge_windows(F.col("windows"))).alias("s")).filter("s is not null")
    return kept.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"), F.col("s.score").alias("score"))


@_query
def window_predictions_merged(spark, folder):
    return _exploded(_predicted(spark, folder), "row_id", "predictions")


@_query
def fragment_merge(spark, folder):
    """PERSON spans cut at their first blank grow together again."""
    parts = F.expr("""flatten(transform(spans, x -> CASE
        WHEN x.entity_type = 'PERSON' AND locate(' ', substring(text, x.start + 1, x.end - x.start)) > 1 AND locate(' ', substring(text, x.start + 1, x.end - x.start)) < x.end - x.start
        THEN array(named_struct('start', x.start, 'end', x.start + locate(' ', substring(text, x.start + 1, x.end - x.start)) - 1, 'entity_type', x.entity_type, 'score', 0.5D),
                   named_struct('start', x.start + locate(' ', substring(text, x.start + 1, x.end - x.start)), 'end', x.end, 'entity_type', x.entity_type, 'score', 1.0D))
        ELSE array(named_struct('start', x.start, 'end', x.end, 'entity_type', x.entity_type, 'score', 0.75D)) END))""")
    rows = _annotated(spark, folder).withColumn("parts", parts).select("row_id", "text", F.explode_outer(merge_fragments(F.col("text"), F.col("parts"), {"PERSON"})).alias("s")).filter("s is not null")
    return rows.select("row_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"), F.col("s.score").alias("score"))


# ---- metrics


@_query
def exact_prf(spark, folder):
    s = metrics.dataset_score(metrics.document_measures(_recipe(spark, folder)))
    return s.select("gold", "predicted", "exact_tp", "exact_fp", "exact_fn", "exact_precision", "exact_recall", "exact_f1")


@_query
def leak_rate(spark, folder):
    return metrics.dataset_score(metrics.document_measures(_recipe(spark, folder))).select("gold", "leaked", "leak_rate")


@_query
def over_redaction(spark, folder):
    return metrics.dataset_score(metrics.document_measures(_recipe(spark, folder))).select("fp_chars", "non_pii", "over_redaction_rate")


@_query
def partial_prf(spark, folder):
    s = metrics.dataset_score(metrics.document_measures(_recipe(spark, folder)))
    return s.select("partial_tp", "partial_fp", "partial_fn", "partial_precision", "partial_recall", "partial_f1")


@_query
def document_scores(spark, folder):
    """Measures of every annotated row against its merged window predictions."""
    return metrics.document_measures(_predicted(spark, folder)).select("row_id", "n_gold", "n_pred", "exact_tp", "partial_tp", "leaked", "fp_chars", "non_pii")


@_query
def scores_by_source(spark, folder):
    s = metrics.dataset_score(metrics.document_measures(_predicted(spark, folder)), "source")
    return s.select("source", "examples", "gold", "predicted", "exact_tp", "leaked", "exact_f1", "leak_rate", "over_redaction_rate")


@_query
def per_entity_recall(spark, folder):
    return metrics.entity_recall(_recipe(spark, folder))


@_query
def prediction_correctness(spark, folder):
    rows = metrics.prediction_correctness(_recipe(spark, folder), "doc_id")
    return rows.groupBy("entity_type", "correct").agg(F.count(F.lit(1)).alias("n"))


@_query
def error_kinds(spark, folder):
    return metrics.error_counts(metrics.gold_errors(_recipe(spark, folder), "doc_id"))


@_query
def error_rows(spark, folder):
    return metrics.gold_errors(_predicted(spark, folder), "row_id")


@_query
def error_samples(spark, folder):
    return metrics.error_samples(metrics.gold_errors(_recipe(spark, folder), "doc_id"), "doc_id", 3)


@_query
def false_positives(spark, folder):
    return metrics.false_positive_rows(_recipe(spark, folder), "doc_id")


@_query
def lost_matches(spark, folder):
    """Exact hits of all predictions that those scored 0.5 or more lose."""
    rows = _recipe(spark, folder)
    return metrics.lost_matches(rows, rows.withColumn("predictions", F.filter("predictions", lambda s: s.score >= 0.5)), "doc_id")


# ---- calibration and thresholds


@_query
def ece_global(spark, folder):
    rows = metrics.prediction_correctness(_recipe(spark, folder), "doc_id")
    return calibrate.calibration_error(rows).select("predictions", F.round("ece", 6).alias("ece"))


@_query
def ece_by_entity(spark, folder):
    rows = metrics.prediction_correctness(_recipe(spark, folder), "doc_id")
    return calibrate.calibration_error(rows, "entity_type").select("entity_type", "predictions", F.round("ece", 6).alias("ece"))


@_query
def ece_hundred_bins(spark, folder):
    scored = _lineitem(spark, folder, oracle.HUNDREDTHS)
    return calibrate.calibration_error(scored, bins=100).select("predictions", F.round("ece", 6).alias("ece"))


@_query
def threshold_sweep(spark, folder):
    return calibrate.sweep_thresholds(_recipe(spark, folder), calibrate.threshold_grid())


@_query
def best_threshold(spark, folder):
    """The global threshold with the best F1, the higher one of equals."""
    sweep = calibrate.sweep_thresholds(_recipe(spark, folder), calibrate.threshold_grid())
    return sweep.orderBy(F.desc("f1"), F.desc("threshold")).limit(1).select("threshold", "f1")


@_query
def profile_scores(spark, folder):
    """Scores of the raw predictions and of both published profiles."""
    rows = _predicted(spark, folder)
    out = None
    for name, profile in (("raw", {}), ("balanced", redact.load_thresholds("balanced")), ("strict", redact.load_thresholds("strict"))):
        one = calibrate.score_profile(rows, profile).select(F.lit(name).alias("profile"), "predicted", "exact_tp", "leaked", "exact_f1", "leak_rate", "over_redaction_rate")
        out = one if out is None else out.unionByName(one)
    return out


@_query
def anchor_scores(spark, folder):
    """Scores with one anchor threshold for every type."""
    rows, out = _recipe(spark, folder), None
    for mode, start in sorted(calibrate.ANCHORS.items()):
        one = calibrate.score_profile(rows, {t: start for t in "ANR"}).select(F.lit(mode).alias("mode"), "predicted", "exact_f1", "leak_rate", "over_redaction_rate")
        out = one if out is None else out.unionByName(one)
    return out


def _search(mode: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        profile, _ = calibrate.optimize_profile(_recipe(spark, folder), ["A", "N", "R"], calibrate.threshold_grid(), calibrate.ANCHORS[mode], mode)
        return spark.createDataFrame(sorted(profile.items()), "entity_type string, threshold double")

    return run


_QUERIES |= {"profile_search_balanced": _search("balanced"), "profile_search_strict": _search("strict")}


# ---- data sets


@_query
def dataset_statistics(spark, folder):
    return datasets.statistics(table(spark, folder, "dataset_examples"))


@_query
def dataset_counts(spark, folder):
    return datasets.count_rows(table(spark, folder, "dataset_examples"), source="source", language="language")


@_query
def entity_counts_by_source_lang(spark, folder):
    found = _docs(spark, folder).select("source", "lang", F.explode_outer(detect.regex_spans(F.col("text"))).alias("s")).filter("s is not null")
    return found.groupBy("source", "lang", F.col("s.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@_query
def repeated_ids(spark, folder):
    return datasets.repeated_ids(table(spark, folder, "dataset_examples"), "example_id")


@_query
def sample_rows(spark, folder):
    return datasets.sample(table(spark, folder, "dataset_examples"), "row_id", 500).select("row_id", "place")


@_query
def split_rows(spark, folder):
    return datasets.split(table(spark, folder, "dataset_examples"), "row_id", 400, 300).select("row_id", "part")


@_query
def text_length_percentiles(spark, folder):
    rows = _docs(spark, folder).select(F.length("text").alias("n"))
    return datasets.percentiles(rows, "n", [0.0, 0.5, 0.95, 0.99, 1.0])


@_query
def texts_over_limits(spark, folder):
    rows = _docs(spark, folder).select(F.length("text").alias("n"))
    return datasets.over_limits(rows, "n", [512, 1024, 2048, 4096])


# ---- audits


@_query
def exact_duplicates(spark, folder):
    return audit.duplicate_stats(table(spark, folder, "dataset_examples"))


@_query
def normalized_duplicates(spark, folder):
    return audit.duplicate_stats(table(spark, folder, "dataset_examples"), folded=True)


@_query
def duplicate_samples(spark, folder):
    return audit.duplicate_samples(table(spark, folder, "dataset_examples"), "row_id")


@_query
def value_overlap(spark, folder):
    return audit.value_overlap(_annotated(spark, folder))


def _perturb(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = audit.perturb(_annotated(spark, folder), [name])
        return rows.select("row_id", F.length("perturbed_text").alias("n"), F.explode_outer("perturbed_spans").alias("s")).select("row_id", "n", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))

    return run


_QUERIES |= {f"perturb_{n}": _perturb(n) for n in audit.PERTURBATIONS}


@_query
def long_context(spark, folder):
    rows = audit.prefixed(_annotated(spark, folder), 480)
    return rows.select("row_id", F.length("perturbed_text").alias("n"), F.explode_outer("perturbed_spans").alias("s")).filter("s is not null").select("row_id", "n", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


@_query
def robustness_regex(spark, folder):
    """How the pattern detector fares on perturbed annotated texts."""
    rows = _annotated(spark, folder).select("row_id", "text", F.filter("spans", lambda s: s.entity_type.isin("EMAIL", "PHONE", "IP_ADDRESS")).alias("spans"))
    return audit.robustness(rows, detect.regex_spans, prefixes=(480, 560))


# ---- sequence labels


@_query
def bio_encode(spark, folder):
    rows = _annotated(spark, folder).select("row_id", F.explode_outer(bio.words_and_bio(F.col("text"), F.col("spans"))).alias("w")).filter("w is not null")
    return rows.groupBy(F.col("w.label").alias("label")).agg(F.count(F.lit(1)).alias("words"))


@_query
def bio_decode(spark, folder):
    """Labels of annotated words decoded again; spans come back but for blanks at their ends."""
    rows = _annotated(spark, folder).withColumn("w", bio.words_and_bio(F.col("text"), F.col("spans")))
    offsets = F.transform("w", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.select("row_id", bio.strict_spans(offsets, F.transform("w", lambda x: x["label"]))["spans"].alias("found"))
    return _exploded(rows, "row_id", "found")


@_query
def bio_lenient(spark, folder):
    rows = _annotated(spark, folder).withColumn("w", bio.words_and_bio(F.col("text"), F.col("spans")))
    offsets = F.transform("w", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    labels = F.transform("w", lambda x: F.replace(x["label"], F.lit("B-"), F.lit("I-")))
    found = bio.token_spans(offsets, labels, F.transform("w", lambda x: (x["end"] - x["start"]) / F.lit(64.0)))  # any score will do that differs
    rows = rows.select("row_id", F.explode_outer(found).alias("s")).filter("s is not null")
    return rows.select("row_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"), F.round("s.score", 9).alias("score"))


@_query
def label_mapping(spark, folder):
    return bio.label_mapping(table(spark, folder, "dataset_examples").filter("spans is not null"))


LABEL_IDS = {"O": 0} | {f"{p}-{t}": 2 * i + k for i, t in enumerate(taxonomy.TYPES, 1) for k, p in ((-1, "B"), (0, "I"))}


@_query
def label_ids(spark, folder):
    """Words of annotated texts by the id of their label; a blank-separated word of one letter has none."""
    rows = _annotated(spark, folder).select(bio.words_and_bio(F.col("text"), F.col("spans")).alias("w"))
    labels = F.transform("w", lambda x: F.when(F.length(x["word"]) > 1, x["label"]))
    return rows.select(F.explode(bio.label_ids(labels, LABEL_IDS)).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("words"))


def _pieces(step: int) -> Callable[[list[str]], tuple]:
    """A tokenizer of ``step`` letters a token, twenty tokens a word at most, with a special token at either end."""
    def tokenize(words):
        ids, of, local = [1], [None], [(0, 0)]
        for i, w in enumerate(words):
            n = max(step, -(-len(w) // 20))
            for k in range(0, len(w), n):
                ids.append(4 * ord(w[k]) + 2 * any(c.isdigit() and c.isascii() for c in w) + (k > 0))
                of.append(i)
                local.append((k, min(k + n, len(w))))
        return [*ids, 2], [*of, None], [*local, (0, 0)]

    return tokenize


@_query
def bio_aligned(spark, folder):
    """Labels on tokens of four letters, the first of each word only, decoded again."""
    words = bio.words_and_bio(F.col("text"), F.col("spans"))
    rows = _annotated(spark, folder).select("row_id", words.alias("w"))
    cut = F.transform("w", lambda w, i: F.transform(F.sequence(F.lit(0), F.floor((w["end"] - w["start"] - 1) / 4).cast("int")), lambda k: F.struct(
        (w["start"] + 4 * k).alias("start"), F.least(w["start"] + 4 * k + 4, w["end"]).alias("end"), i.alias("word_id"), F.when(k == 0, w["label"]).alias("label"))))
    found = rows.select("row_id", bio.aligned_spans(F.flatten(cut))["spans"].alias("found"))
    return _exploded(found, "row_id", "found")


@_query
def projected_offsets(spark, folder):
    """Offsets of tokens of four letters moved from their words to the text."""
    rows = table(spark, folder, "examples").select("id", bio.text_words(F.col("text")).alias("w"))
    parts = F.flatten(F.transform("w", lambda w, i: F.transform(F.sequence(F.lit(0), F.floor((F.length(w["word"]) - 1) / 4).cast("int")), lambda k: F.struct(i.alias("i"), (4 * k).alias("a"), F.least(4 * k + 4, F.length(w["word"])).alias("b")))))
    rows = rows.select("id", "w", parts.alias("p"))
    moved = bio.global_offsets(F.col("w"), F.transform("p", lambda p: p["i"]), F.transform("p", lambda p: F.struct(p["a"].alias("start"), p["b"].alias("end"))))
    return rows.select("id", F.explode(moved).alias("o")).select("id", F.col("o.start").alias("token_start"), F.col("o.end").alias("token_end"))


@_query
def encoder_windows(spark, folder):
    """A model that labels words with a digit, run over windows of 96 tokens with an overlap of 32."""
    def load():
        return bio.TokenModel(_pieces(8), lambda ids: [("O" if i < 3 or not i & 2 else "I-CODE" if i & 1 else "B-CODE", 1.0) for i in ids])

    rows = _docs(spark, folder).select("doc_id", detect.detector("windows", load=load, max_length=96, overlap=32)(F.col("text")).alias("s"))
    return _exploded(rows, "doc_id", "s")


@_query
def training_windows(spark, folder):
    """Annotated texts in windows of 128 tokens that overlap by 16; a word has twenty tokens at most."""
    rows = bio.window_examples(_annotated(spark, folder), lambda: _pieces(4), 128, 16, key="row_id")
    return rows.select("example_id", "window", "text", F.size("spans").alias("n_spans"))


def _fours(words):
    """Tokens of four letters, however long the word."""
    at = [(i, k) for i, w in enumerate(words) for k in range(0, len(w), 4)]
    return [1, *(ord(words[i][k]) for i, k in at), 2], [None, *(i for i, _ in at), None], [(0, 0), *((k, min(k + 4, len(words[i]))) for i, k in at), (0, 0)]


@_query
def encoder_records(spark, folder):
    """Model-ready arrays of annotated texts of up to 256 tokens, measured; longer ones are errors."""
    rows = bio.encoder_records(_annotated(spark, folder), lambda: _fours, LABEL_IDS, max_length=256, key="row_id")
    return rows.select("example_id", F.size("input_ids").alias("tokens"), F.size(F.filter("labels", lambda x: x > 0)).alias("labelled"), F.size(F.filter("labels", lambda x: x == bio.IGNORE)).alias("ignored"), F.col("error").isNotNull().alias("failed"))


def _chats(spark: SparkSession, folder: str) -> DataFrame:
    """Chats of annotated texts with a token per character and room for 1,500."""
    def load():
        return lambda text: (list(map(ord, text)), [(i, i + 1) for i in range(len(text))])

    def render(messages, prompt):
        return "".join(f"<{m['role']}>{m['content']}" for m in messages) + "<assistant>" * prompt

    rows = _annotated(spark, folder).withColumn("messages", normalize.chat_messages(F.col("text"), F.col("spans")))
    return bio.chat_records(rows, load, render, 1500, key="row_id")


@_query
def chat_records(spark, folder):
    return _chats(spark, folder).select("example_id", F.size("input_ids").alias("tokens"), F.size(F.filter("labels", lambda x: x != bio.IGNORE)).alias("trained"), F.col("error").isNotNull().alias("failed"))


@_query
def chat_overflow(spark, folder):
    return bio.overflow_report(_chats(spark, folder))


@_query
def collated(spark, folder):
    """Arrays of the lengths of each example's words, padded by source."""
    n = F.transform(bio.text_words(F.col("text")), lambda w: F.length(w["word"]))
    rows = table(spark, folder, "dataset_examples").select("row_id", "source", n.alias("input_ids")).filter("size(input_ids) > 0")
    rows = rows.withColumns({"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "labels": F.col("input_ids")})
    out = bio.collate(rows, "source", 0)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("row_id", F.size("input_ids").alias("n"), total("input_ids").alias("ids"), total("attention_mask").alias("mask"), total("labels").alias("labels"))


@_query
def located_words(spark, folder):
    words = F.transform(bio.text_words(F.col("text")), lambda w: w["word"])
    rows = table(spark, folder, "examples").select("id", F.explode_outer(bio.locate_words(F.col("text"), words)).alias("w")).filter("w is not null")
    return rows.select("id", F.col("w.word").alias("word"), F.col("w.start").alias("word_start"), F.col("w.end").alias("word_end"))


@_query
def chat_targets(spark, folder):
    return _annotated(spark, folder).select("row_id", normalize.chat_target(F.col("spans")).alias("target"))


@_query
def chat_messages(spark, folder):
    rows = _annotated(spark, folder).select("row_id", F.explode_outer(normalize.chat_messages(F.col("text"), F.col("spans"))).alias("m")).filter("m is not null")
    return rows.select("row_id", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


@_query
def parsed_outputs(spark, folder):
    """Chat targets of all annotated rows, bad ones included, parsed strictly."""
    rows = table(spark, folder, "dataset_examples").filter("spans is not null and text is not null").withColumn("output", normalize.chat_target(F.col("spans")))
    rows = rows.withColumn("r", detect.parse_object_output(F.col("text"), F.col("output")))
    return rows.select("row_id", F.when(F.col("r.error").isNull(), F.size("r.spans")).alias("n_spans"), F.col("r.error").isNull().alias("ok"))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of all annotated rows, bad ones included, written as a JSON list and read leniently."""
    rows = table(spark, folder, "dataset_examples").filter("spans is not null and text is not null")
    rows = rows.select("row_id", "text", F.to_json(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.entity_type.alias("entity_type"), F.lit(0.5).alias("score")))).alias("output"))
    return detect.parse_list_output(rows, "text", "output")


@_query
def list_outputs(spark, folder):
    return _listed(spark, folder).select("row_id", F.size("spans").alias("n_spans"), F.col("error").isNull().alias("ok"))


@_query
def output_failures(spark, folder):
    return detect.failure_rate(_listed(spark, folder))


@_query
def cached_predictions(spark, folder):
    """A model that marks every @, run once per distinct text."""
    def load():
        return lambda text: [(i, i + 1, "AT", 1.0) for i, c in enumerate(text) if c == "@"]

    rows = detect.cached_predictions(_docs(spark, folder).select("doc_id", "text"), "text", load)
    return _exploded(rows.filter("text is not null"), "doc_id", "predictions")


# ---- adapters of published corpora, fed with records made of annotated rows


def _records(spark: SparkSession, folder: str, kind) -> DataFrame:
    """``text, row_id, language, mask`` with labels by ``kind`` and the values that the offsets give."""
    rows = table(spark, folder, "dataset_examples").filter("spans is not null and text is not null")
    value = lambda s: F.substring("text", s.start + 1, s.end - s.start)
    mask = F.transform("spans", lambda s: F.struct(value(s).alias("value"), s.start.alias("start"), s.end.alias("end"), kind(s.entity_type).alias("label")))
    return rows.select("text", "row_id", "language", mask.alias("mask"))


def _adapted(df: DataFrame) -> DataFrame:
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s.end - s.start).cast("long"))
    return df.select("example_id", F.size("spans").alias("n_spans"), total.alias("characters"), F.col("error").isNull().alias("ok"))


@_query
def adapter_openpii(spark, folder):
    return _adapted(normalize.openpii(_records(spark, folder, lambda t: t).selectExpr("text as source_text", "row_id as uid", "language", "mask as privacy_mask")))


@_query
def adapter_gretel(spark, folder):
    return _adapted(normalize.gretel(_records(spark, folder, lambda t: t).selectExpr("text as generated_text", "row_id as `index`", "language", "to_json(mask) as pii_spans")))


def masking_label(kind: str) -> str:
    """A label of the masking corpus for a shared type; an ignored one where it has none."""
    return min((k for k, v in taxonomy.MASKING_LABELS.items() if v == kind), default=min(taxonomy.MASKING_IGNORED))


@_query
def adapter_masking(spark, folder):
    named = lambda t: taxonomy.lookup({k: masking_label(k) for k in taxonomy.TYPES}, t)
    return _adapted(normalize.masking(_records(spark, folder, named).selectExpr("row_id as id", "language", "text as source_text", "mask as privacy_mask")))


@_query
def adapter_conll(spark, folder):
    """Words of annotated texts with PERSON tags, put together again as text is written."""
    words = bio.words_and_bio(F.col("text"), F.col("spans"))
    rows = _annotated(spark, folder).select(F.col("row_id").alias("id"), words.alias("w"))
    tag = lambda x: F.when(x["label"] == "B-PERSON", "B-PER").when(x["label"] == "I-PERSON", "I-PER").otherwise("O")
    made, _ = normalize.route(normalize.conll(rows.select("id", F.transform("w", lambda x: x["word"]).alias("tokens"), F.transform("w", tag).alias("ner_tags"))))
    return made.select("example_id", F.length("text").alias("n"), F.explode_outer("spans").alias("s")).select("example_id", "n", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


# ---- sources


@_query
def example_lines_parsed(spark, folder):
    rows = table(spark, folder, "example_lines").select("line_id", *jsonl.parse_example(F.col("line")))
    return rows.select("line_id", "example_id", F.length("text").alias("n"), "source", "language", F.size("spans").alias("n_spans"), F.col("error").isNull().alias("ok"))


@_query
def example_validity(spark, folder):
    """Rows of dataset_examples by the first rule of a normalised example they break."""
    spans = bare(F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int,entity_type:string>>)")))
    error = normalize.example_error(F.col("example_id"), F.col("text"), spans, F.col("source"), F.col("language"))
    return table(spark, folder, "dataset_examples").select(error.alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@_query
def example_json(spark, folder):
    c = F.col
    return _annotated(spark, folder).select("row_id", jsonl.example_json(c("example_id"), c("text"), c("spans"), c("source"), c("language")).alias("line"))


@_query
def hand_labelled_summary(spark, folder):
    """Labels of the hand-labelled rows under the shared taxonomy."""
    rows = table(spark, folder, "examples").select(F.explode_outer("spans").alias("s")).filter("s is not null")
    return rows.groupBy(taxonomy.normalized_label(F.col("s.label")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))


@_query
def hand_labelled_loaded(spark, folder):
    ok, _ = normalize.route(normalize.hand_labelled(table(spark, folder, "examples")))
    return ok.select("example_id", F.size("spans").alias("n_spans"), F.length("text").alias("n"))


@_query
def label_audit(spark, folder):
    return taxonomy.audit_labels(spark, {"openpii": taxonomy.OPENPII_LABELS, "gretel": taxonomy.GRETEL_LABELS, "made_up": ["EMAIL", "SHOE_SIZE"]})


@_query
def label_totals(spark, folder):
    """Types of annotated spans outside the shared taxonomy."""
    types = table(spark, folder, "dataset_examples").select(F.explode_outer("spans").alias("s")).filter("s is not null").groupBy(F.col("s.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    return types.withColumn("known", F.col("entity_type").isin(*taxonomy.TYPES))
