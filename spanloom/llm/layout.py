"""Copies hidden by formatting (problem 5)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import attach
from ..plans.written import written

FIELDS = ("id", "text", "source", "language")
_BARE = re.compile(r"[\W_]+")
_SHOWN = [*range(0x30, 0x3A), *range(0x61, 0x7B)]  # digits and letters counted one by one; all other bytes together
_SPACE = " \t\r\n﻿"


def bare(text: str | None) -> str:
    """Letters and digits of ``text`` in their order, case folded (ß as ss); null is empty."""
    return _BARE.sub("", text.casefold()) if text else ""


def _value(x) -> str:
    """A JSON value as text; numbers stand as they are written."""
    return x if isinstance(x, str) else "" if x is None else json.dumps(x)


def record_of(line: str | None) -> tuple[str, ...]:
    """The bare fields of a JSON object; for a line that is none, or has no such field, one more part with its own bare text."""
    if line:
        try:
            o = json.loads(line.strip(_SPACE), parse_int=str, parse_float=str)
            if isinstance(o, dict) and any(o.get(f) is not None for f in FIELDS):
                return tuple(bare(_value(o.get(f))) for f in FIELDS)
        except (ValueError, RecursionError):
            pass
    return "", bare(line), "", "", "line"


def invariants(parts: tuple[str, ...]) -> bytes:
    """What copies share and is cheap to compare: stripped lengths and how often each letter and digit occurs."""
    count = np.bincount(np.frombuffer("".join(parts[:4]).encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return np.array([len(parts), *map(len, parts), count.sum(), *count[_SHOWN]], np.int64).tobytes()


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        records = [record_of(x) for x in b.column(1).to_pylist()]
        sig = np.frombuffer(b"".join(blake2b(invariants(r), digest_size=8).digest() for r in records), np.int64)
        key = np.frombuffer(b"".join(blake2b("\x1f".join(r).encode("utf-8", "surrogatepass"), digest_size=16).digest() for r in records), np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (sig, key[::2], key[1::2]))], ["line_id", "sig", "k1", "k2"])


def layout_classes(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """One row per line: ``line_id, keep_id, copies`` of its class of copies.

    Lines are copies when ``id``, ``text``, ``source`` and ``language`` of their
    JSON agree in their letters and digits. The partition is refined in two
    steps: cheap invariants, the stripped lengths and the counts of letters, name
    the classes, and only members of classes with several lines are told apart by
    the costly key, the whole stripped record as a 128-bit digest. Each line is
    parsed and stripped once, in the pass that takes its invariants, and 32 bytes
    of it are written; taking the digest there costs less than reading the line
    again. Lines that are null or no JSON object compare by their own stripped
    text, and never with a parsed record. Empty tables give no rows. Counts and
    minima are combined before their shuffle and hot classes are joined by
    broadcast, so a record that is most of the table stays where it lies.
    """
    src = lines.select(F.col(key).cast("long").alias("line_id"), F.col(line).cast("string").alias("_l"))
    recs = written(src.mapInArrow(_signs, "line_id long, sig long, k1 long, k2 long"), "layout-signs")
    total = recs.count()
    rough = recs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"))
    recs = attach(recs, rough, ["sig"], total, "n")
    alone = recs.filter("n = 1").select("line_id", F.col("line_id").alias("keep_id"), F.col("n").alias("copies"))
    member = recs.filter("n > 1").drop("n")
    classes = member.groupBy("sig", "k1", "k2").agg(F.min("line_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return attach(member, classes, ["sig", "k1", "k2"], total).select("line_id", "keep_id", "copies").unionByName(alone)


def layout_copies(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """``keep_id, line_id`` of every line that is not the first of its class."""
    return layout_classes(lines, key, line).filter("line_id > keep_id").select("keep_id", "line_id")


def kept_lines(lines: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """One line per record with its number of copies."""
    firsts = layout_classes(lines, key, line).filter("line_id = keep_id").select(F.col("keep_id").alias("_k"), "copies")
    return lines.join(firsts, F.col(key) == F.col("_k")).select(F.col(key).alias("keep_id"), F.col(line).alias("line"), "copies")
