"""Queries of the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import perplexity
from .canon import consistent_form, lookalike_pairs
from .language import fit, language_cases, languages
from .layout import kept_lines, layout_copies
from .overlap import covered_records, cross_split_pairs, overlap_report
from .packing import CAPACITY, pack_items
from .personal import Lexicon, detect, fit_lexicon, scrubbed
from .repeats import repetition, repetitive
from .split import checked_pieces, split_oversized
from .tokens import decoded, encode_corpus, token_counts, token_sizes

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(table(spark, folder, "dataset_examples"))


def p1_forms(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dataset_examples").select("row_id", consistent_form(F.col("text")).alias("form"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return language_cases(table(spark, folder, "dataset_examples"))


def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of every text, with its confidence."""
    df = table(spark, folder, "dataset_examples")
    rows = languages(df, fit(df)).select("row_id", F.explode("segments").alias("s"))
    return rows.select("row_id", F.col("s.seg_no").alias("seg_no"), F.col("s.language").alias("language"), F.col("s.confidence").alias("confidence"), F.col("s.start").alias("text_start"), F.col("s.end").alias("text_end"))


def p2_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the stretches of every text lie in it one after the other from its beginning to its end."""
    rows = p2_segments(spark, folder).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "text_start", "text_end"))).alias("s"))  # the stretches of one text
    ends = F.concat(F.array(F.lit(0)), F.transform("s", lambda x: x.text_end))
    apart = F.transform("s", lambda x: x.text_start) == F.slice(ends, F.lit(1), F.size("s"))
    return rows.select("row_id", apart.alias("covered"), F.element_at(ends, -1).alias("n"))


def p3_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text of both tables with its source, language, domain and token count."""
    ex = table(spark, folder, "dataset_examples").select(F.lit("dataset_examples").alias("tab"), F.col("row_id").alias("id"), "source", "language", "text")
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), "source", F.col("lang").alias("language"), "text")
    counted = token_counts(ex.unionByName(docs), ["tab", "id", "source", "language"])
    return counted.join(table(spark, folder, "sources").select("source", "domain"), "source", "left").select("tab", "id", "source", "language", "domain", "tokens")


def p3_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Texts and tokens by table, source, language as labelled, and domain."""
    return p3_texts(spark, folder).groupBy("tab", "source", "language", "domain").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))


def p3_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each table, source, language and domain, and whether their tokens are those of direct encoding."""
    by = ["tab", "source", "language", "domain"]
    made = p3_budget(spark, folder)
    ex = table(spark, folder, "dataset_examples").select(F.lit("dataset_examples").alias("tab"), "source", "language", "text")
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("tab"), "source", F.col("lang").alias("language"), "text")
    rows = ex.unionByName(docs).withColumn("n", F.monotonically_increasing_id())
    rows = rows.join(table(spark, folder, "sources").select("source", "domain"), "source", "left")
    direct = token_sizes(rows, "n", keep=by).groupBy(*by).agg(F.sum("tokens").alias("direct"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    met = made.alias("a").join(direct.alias("b"), same[0] & same[1] & same[2] & same[3], "left")
    return met.select("a.tab", "a.source", "a.language", "a.domain", "texts", F.coalesce(F.col("tokens") == F.col("direct"), F.lit(False)).alias("same"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pieces(spark, folder).filter("piece_no = 1").select("row_id")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "dataset_examples"))


def p4_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the pieces of every text give it again, keep to the limit, and where its spans begin."""
    return checked_pieces(p4_pieces(spark, folder), table(spark, folder, "dataset_examples"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return layout_copies(table(spark, folder, "example_lines"))


def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    return kept_lines(table(spark, folder, "example_lines"))


def _unannotated(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of both tables with null spans, as ``tab, rid, text``."""
    ex = table(spark, folder, "dataset_examples").filter("spans is null").select(F.lit("dataset_examples").alias("tab"), F.col("row_id").cast("string").alias("rid"), "text")
    hand = table(spark, folder, "examples").filter("spans is null").select(F.lit("examples").alias("tab"), F.col("id").cast("string").alias("rid"), "text")
    return ex.unionByName(hand)


def _lexicon(spark: SparkSession, folder: str) -> Lexicon:
    """Names and words of annotated rows of both tables."""
    span = lambda s, k: F.struct(s.start.alias("start"), s.end.alias("end"), F.upper(s[k]).alias("entity_type"))
    parts = [
        table(spark, folder, name).filter("spans is not null").select(F.col(key).cast("string").alias("row_id"), "text", F.transform("spans", lambda s: span(s, kind)).alias("spans"))  # noqa: B023
        for name, key, kind in (("dataset_examples", "row_id", "entity_type"), ("examples", "id", "label"))
    ]
    return fit_lexicon(parts[0].unionByName(parts[1]))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    lexicon = _lexicon(spark, folder)
    found = detect(_unannotated(spark, folder), lexicon, ["tab", "rid"]).select("tab", "rid", F.explode("found").alias("s"))
    return found.select("tab", "rid", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.entity_type").alias("entity_type"))


def p6_scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    """Unannotated texts with typed placeholders."""
    lexicon = _lexicon(spark, folder)
    return scrubbed(_unannotated(spark, folder), lexicon, ["tab", "rid"]).select("tab", "rid", "scrubbed")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return cross_split_pairs(table(spark, folder, "dataset_examples"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(table(spark, folder, "dataset_examples"))


def p7_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation row with a partner, and how many of its words one of them covers."""
    return covered_records(table(spark, folder, "dataset_examples")).withColumnRenamed("row", "row_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document turned back into text."""
    return decoded(p8_ids(spark, folder))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """A container for every document, by exact token counts."""
    sized = token_sizes(table(spark, folder, "documents"), "doc_id")
    packed = pack_items(sized, "doc_id", "tokens", CAPACITY)
    return packed.withColumnRenamed("item_id", "doc_id")


def p9_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every document is placed with all of its tokens, whole if it fits, in containers that hold no more than they can."""
    sized = token_sizes(table(spark, folder, "documents"), "doc_id").withColumnRenamed("doc_id", "id")
    packed = pack_items(sized, "id", "tokens", CAPACITY)
    over = packed.groupBy("container").agg(F.sum("used").alias("n")).filter(F.col("n") > CAPACITY).select("container", F.lit(True).alias("over"))
    by = packed.join(over, "container", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("used").alias("used"), F.max("over").alias("over"))
    return sized.join(by, sized["id"] == by["item_id"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce((F.col("used") == F.col("tokens")) & F.col("over").isNull() & ((F.col("parts") == 1) | (F.col("tokens") > CAPACITY)), F.lit(False)).alias("placed"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetitive(table(spark, folder, "documents"))


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    return repetition(table(spark, folder, "documents"))


def p10_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under a model of all, and whether it leaves its language's band."""
    docs = table(spark, folder, "documents")
    out = perplexity.banded(perplexity.perplexities(docs, perplexity.fit(docs)))
    return out.select("doc_id", "language", "words", "perplexity", "rejected")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


# Small letters that case folding writes out or makes equal to another.
FOLDS = {"ß": "ss", "ŉ": "ʼn", "ǰ": "ǰ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def _bare(path: str) -> str:
    """Letters and digits of a JSON field in SQL, case folded."""
    c = f"translate(lower(line ->> '$.{path}'), 'ςſ', 'σs')"
    for letter, out in FOLDS.items():
        c = f"replace({c}, '{letter}', '{out}')"
    return rf"coalesce(regexp_replace({c}, '[^\p{{L}}\p{{N}}]', '', 'g'), '')"


def oracle_sql() -> dict[str, str]:
    keys = " || chr(31) || ".join(map(_bare, ("id", "text", "source", "language")))
    classes = f"WITH k AS (SELECT line_id, line, {keys} AS key FROM example_lines), m AS (SELECT key, min(line_id) AS keep_id, count(*) AS copies FROM k GROUP BY key)"
    repeats = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS l FROM documents),
  g AS (SELECT doc_id, i, array_to_string(l[i:i+7], ' ') AS gram FROM (SELECT doc_id, l, unnest(range(1, len(l) - 6)) AS i FROM w)),
  again AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1),
  c AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM again, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
  r AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS words, coalesce(repeated, 0) AS repeated FROM w LEFT JOIN c USING (doc_id))"""
    return {
        "p2_covered": r"""SELECT row_id, true AS covered, length(text)::INTEGER AS n FROM dataset_examples WHERE regexp_matches(text, '\p{L}')""",
        "p3_checked": """SELECT tab, source, language, domain, count(*) AS texts, true AS same FROM (
            SELECT 'dataset_examples' AS tab, source, language FROM dataset_examples UNION ALL SELECT 'documents', source, lang FROM documents) LEFT JOIN sources USING (source) GROUP BY ALL""",
        "p8_decoded": "SELECT doc_id, coalesce(text, '') AS decoded FROM documents",
        "p9_checked": "SELECT doc_id, true AS placed FROM documents",
        "p10_shares": f"{repeats} SELECT doc_id, words, repeated, CASE WHEN words > 0 THEN repeated / CAST(words AS DOUBLE) ELSE 0.0 END AS share FROM r",
        "p10_found": f"{repeats} SELECT doc_id FROM r WHERE words > 0 AND repeated / CAST(words AS DOUBLE) >= 0.3",
        "p4_found": "SELECT row_id FROM dataset_examples WHERE length(text) > 2000",
        "p4_checked": """SELECT row_id, length(text)::INTEGER AS n, true AS rebuilt, true AS within,
            len(list_distinct(list_transform(list_filter(coalesce(spans, []), lambda x: x.start >= 0 AND x.start < x.end AND x.start < length(text)), lambda x: x.start)))::INTEGER AS starts
            FROM dataset_examples WHERE length(text) > 2000""",
        "p5_found": f"{classes} SELECT keep_id, line_id FROM k JOIN m USING (key) WHERE line_id > keep_id",
        "p5_kept": f"{classes} SELECT keep_id, line, copies FROM k JOIN m USING (key) WHERE line_id = keep_id",
    }
