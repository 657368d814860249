"""Normalised examples as JSON lines, split folders with a manifest, prediction caches, reports."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.chars import trimmed
from ..functions.spans import in_order
from ..operators.normalize import example_error, first_error
from ..plans.written import read_text, write_text, written

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity_type", T.StringType())]))
EXAMPLE = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("spans", SPANS), T.StructField("source", T.StringType()), T.StructField("language", T.StringType())])
PREDICTION = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("entity_type", T.StringType()), T.StructField("score", T.DoubleType())]))
CACHE = T.StructType([T.StructField("example_index", T.LongType()), T.StructField("example", EXAMPLE), T.StructField("predictions", PREDICTION)])
FORMAT = 1  # Fixed value: the version of split folders.
PARTS = ("train", "validation", "test")


def example_json(example_id: Column, text: Column, spans: Column, source: Column, language: Column) -> Column:
    """One example as compact JSON with its keys in their order."""
    s = F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.entity_type.alias("entity_type")))
    return F.to_json(F.struct(example_id.alias("id"), text.alias("text"), s.alias("spans"), source.alias("source"), language.alias("language")), {"ignoreNullFields": "false"})


def parse_example(line: Column, blank: str = "error") -> list[Column]:
    """Columns ``example_id, text, spans, source, language, error`` of a JSON line."""
    r = F.from_json(line, EXAMPLE)
    kinds = F.schema_of_variant(F.try_parse_json(line))
    whole = F.coalesce(F.forall(r["spans"], lambda s: s.start.isNotNull() & s.end.isNotNull() & s.entity_type.isNotNull()), F.lit(False))
    spans = in_order(r["spans"])
    error = F.coalesce(
        first_error(
            (line.isNull() | (trimmed(line) == ""), "line must not be empty"), (F.try_parse_json(line).isNull(), "invalid JSON"),
            (~kinds.startswith("OBJECT<"), "line must be a JSON object"), (r["spans"].isNull() | ~kinds.rlike(r"\bspans: ARRAY<"), "spans must be a list"), (~whole, "a span lacks a field"),
        ),
        example_error(r["id"], r["text"], r["spans"], r["source"], r["language"]),
    )
    return [r["id"].alias("example_id"), r["text"].alias("text"), F.when(error.isNull(), spans).alias("spans"), r["source"].alias("source"), r["language"].alias("language"), error.alias("error")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of text files of any size; numbers count from 1 in each file.

    A file is read in blocks by several tasks. A line's number is its place in its
    block and the lines of the blocks before it, which are counted first.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))  # a row a block
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(blocks.select("file", "block", "first", before.alias("before")), ["file", "block"]).select("file", (F.col("before") + F.col("i") - F.col("first") + 1).alias("line_no"), "line")


def read_examples(spark: SparkSession, path: str, numbered: bool = True, skip_blank: bool = False) -> DataFrame:
    """``file, line_no, example_id, text, spans, source, language, error`` of JSON lines.

    Line numbers cost one more pass that counts lines; ``numbered=False`` leaves
    them null. A blank line is an error unless skipped.
    """
    if numbered:
        raw = _lines(spark, path)
    else:
        raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line_no"), F.col("value").alias("line"))
    if skip_blank:
        raw = raw.filter(trimmed(F.col("line")) != "")
    return raw.select("file", "line_no", *parse_example(F.col("line")))


def require_valid(examples: DataFrame) -> DataFrame:
    """Fails on the first broken line, named by its number."""
    message = F.concat(F.lit("line "), F.coalesce(F.col("line_no").cast("string"), F.lit("?")), F.lit(": "), F.col("error"))
    return examples.filter(F.when(F.col("error").isNotNull(), F.raise_error(message)).otherwise(F.lit(True))).drop("error")


def write_examples(df: DataFrame, path: str) -> int:
    """Writes a folder of JSON lines and returns the number of examples, which are counted as they are written."""
    c, seen = F.col, Observation("written")
    lines = df.select(example_json(c("example_id"), c("text"), c("spans"), c("source"), c("language")).alias("value"))
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def read_hand_labelled(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, spans<start,end,label>`` of JSON lines; blank lines are skipped, a bad one fails with its file and number."""
    schema = "id string, text string, spans array<struct<start:int,end:int,label:string>>"
    raw = _lines(spark, path).filter(trimmed(F.col("line")) != "")
    kind = F.schema_of_variant(F.try_parse_json("line"))
    where = F.concat("file", F.lit(":"), F.col("line_no").cast("string"), F.lit(": not a JSON object"))
    good = F.when(F.coalesce(kind.startswith("OBJECT<"), F.lit(False)), F.lit(True)).otherwise(F.raise_error(where))
    return raw.filter(good).select(F.from_json("line", schema).alias("r")).select("r.*")


def save_split(df: DataFrame, folder: str, source: str, seed: int, part: str = "part") -> dict:
    """JSON lines by part, and a manifest with counts. Rows are worked out once."""
    rows = written(df.select("example_id", "text", "spans", "source", "language", F.col(part).alias("_part")), "split-rows")
    if unknown := {r[0] for r in rows.select("_part").distinct().collect()} - set(PARTS):  # three parts, if all is well
        raise ValueError(f"unknown parts {sorted(map(str, unknown))}")
    splits = {p: write_examples(rows.filter(F.col("_part") == p), f"{folder}/{p}.jsonl") for p in PARTS}
    manifest = {"format_version": FORMAT, "source": source, "seed": seed, "splits": splits, "total_count": sum(splits.values())}
    write_report(manifest, f"{folder}/manifest.json")
    return manifest


def check_manifest(m: dict) -> None:
    if m.get("format_version") != FORMAT:
        raise ValueError("unsupported format version")
    if not isinstance(m.get("source"), str) or not m["source"].strip():
        raise ValueError("the manifest needs a source")
    if isinstance(m.get("seed"), bool) or not isinstance(m.get("seed"), int):
        raise TypeError("the seed must be an integer")
    splits = m.get("splits") or {}
    if set(splits) != set(PARTS) or any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in splits.values()):
        raise ValueError("the manifest needs a count for each part")
    if m.get("total_count") != sum(splits.values()):
        raise ValueError("the total differs from the parts")


def load_split(spark: SparkSession, folder: str) -> DataFrame:
    """Examples with ``part``; the manifest's counts must agree."""
    manifest = read_report(f"{folder}/manifest.json")
    check_manifest(manifest)
    parts = [require_valid(read_examples(spark, f"{folder}/{p}.jsonl", numbered=False)).withColumn("part", F.lit(p)) for p in PARTS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = {r[0]: r[1] for r in out.groupBy("part").agg(F.count(F.lit(1))).collect()}
    if {p: counts.get(p, 0) for p in PARTS} != manifest["splits"]:
        raise ValueError("the counts differ from the manifest's")
    return out.drop("file", "line_no")


def write_cache(df: DataFrame, path: str) -> None:
    """Predictions with their examples, one row each, as JSON lines with sorted keys."""
    ex = F.struct(F.col("example_id").alias("id"), F.col("language").alias("language"), F.col("source").alias("source"), F.col("spans").alias("spans"), F.col("text").alias("text"))
    df.select(F.to_json(F.struct(ex.alias("example"), F.col("example_index").cast("long").alias("example_index"), F.col("predictions").alias("predictions")), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``example_index, example_id, text, spans, source, language, predictions``; blank lines are skipped."""
    raw = spark.read.text(path).filter(trimmed(F.col("value")) != "").select(F.from_json("value", CACHE).alias("r"))
    return raw.select("r.example_index", F.col("r.example.id").alias("example_id"), "r.example.text", "r.example.spans", "r.example.source", "r.example.language", "r.predictions")


def write_report(report: dict, path: str) -> None:
    """A small JSON report, indented, with sorted keys, on the file system that ``path`` names."""
    text = json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    if spark := SparkSession.getActiveSession():
        write_text(spark, path, text)
    else:
        p = Path(path)
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, "utf-8")


def read_report(path: str) -> dict:
    """A JSON report, which must be an object."""
    spark = SparkSession.getActiveSession()
    data = json.loads(read_text(spark, path) if spark else Path(path).read_text("utf-8"))
    if not isinstance(data, dict):
        raise ValueError("a report must be a JSON object")
    return data


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Reports side by side; numbers with four places, missing ones as a dash."""
    def cell(v) -> str:
        if v is None:
            return "—"
        return f"{v:.4f}" if isinstance(v, float) else str(v)

    head = f"| {' | '.join(columns)} |\n|{'|'.join('---' for _ in columns)}|\n"
    return head + "".join(f"| {' | '.join(cell(r.get(c)) for c in columns)} |\n" for r in rows)


def write_mapping(df: DataFrame, path: str, mapping: str = "mapping") -> None:
    """Placeholder mappings as JSON arrays, one line a row."""
    df.select(F.to_json(mapping).alias("value")).write.mode("overwrite").text(path)


def read_records(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Published corpora kept as Parquet or JSON; the schema is given, never inferred, for JSON."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        if schema is None:
            raise ValueError("JSON needs a schema")
        return spark.read.schema(schema).json(path)
    raise ValueError(f"unknown kind {kind!r}")


def read_settings(path: str) -> dict:
    """Settings as JSON, or as ``key: value`` lines nested by indentation, with ``- item`` lists of scalars; for the driver only."""
    text = Path(path).read_text("utf-8")
    if text.lstrip().startswith("{"):
        return json.loads(text)
    top: dict = {}
    path_: list[tuple[int, dict, str]] = [(-1, {"": top}, "")]  # indentation, holder, key whose value is open
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not bare.strip():
            continue
        depth, item = len(bare) - len(bare.lstrip()), bare.strip()
        while len(path_) > 1 and (path_[-1][0] > depth or path_[-1][0] == depth and not item.startswith("- ")):
            path_.pop()
        _, holder, key = path_[-1]
        if item.startswith("- "):
            if not isinstance(holder[key], list):
                holder[key] = []
            holder[key].append(_scalar(item[2:].strip()))
            continue
        if not isinstance(holder[key], dict):
            holder[key] = {}
        name, sep, value = item.partition(":")
        if not sep:
            raise ValueError(f"no setting: {item!r}")
        holder[key][name.strip()] = _scalar(value.strip()) if value.strip() else None
        if not value.strip():
            path_.append((depth, holder[key], name.strip()))
    return top


def _scalar(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return {"true": True, "false": False, "null": None, "~": None}.get(text.lower(), text.strip("'\""))
