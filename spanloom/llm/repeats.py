"""Repetition inside one document (problem 10)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, SHARE = 8, 0.3
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _windows(ids: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit value of each window of ``run`` word ids."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    h, n = np.zeros(len(ids) - run + 1, np.uint64), len(ids) - run + 1
    for k in range(run):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + x[k : k + n]
    return h


def repeated_words(text: str, run: int = RUN) -> tuple[int, int]:
    """Words of ``text``, and how many of them lie in a run of ``run`` words that began earlier too."""
    words = _WORD.findall(text.lower())
    n = len(words)
    if n <= run:
        return n, 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) > n - run:  # fewer than run + 1 words come again
        return n, 0
    h = _windows(ids, run)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again, before = order[1:][same], order[:-1][same]
    if not len(again):
        return n, 0
    exact = np.all(ids[again[:, None] + np.arange(run)] == ids[before[:, None] + np.arange(run)], axis=1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again[exact], 1)
    np.add.at(edge, again[exact] + run, -1)
    return n, int(np.count_nonzero(np.cumsum(edge[:n]) > 0))


def repetition(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``doc_id, words, repeated, share`` of every document.

    Words are runs of letters and digits, case ignored; a word repeats when it
    lies in a run of ``run`` or more words that began earlier in the same
    document, apart from it or overlapping it. Null, empty and word-less texts
    have 0 words and a share of 0. Work is per row; nothing is shuffled.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [repeated_words(t, run) if t else (0, 0) for t in b.column(1).to_pylist()]
            n, r = (pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), n, r], ["doc_id", "words", "repeated"])

    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t"))
    counted = src.mapInArrow(measure, "doc_id long, words long, repeated long")
    return counted.withColumn("share", F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(F.lit(0.0)))


def repetitive(df: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, share: float = SHARE) -> DataFrame:
    """Documents of which at least ``share`` of the words repeat."""
    return repetition(df, doc_id, text, run).filter(F.col("share") >= share).select("doc_id")
