"""Token counts (problem 3) and encoding (problem 8) under public byte-level tokenizers."""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.written import written

FOLDER = "/opt/tokenizers"  # where the vocabulary files lie on every executor
MODEL = "byte_bpe_50k"
# Fixed value: how the rank files split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same over ASCII, where the fast engine of the standard library can be used.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
# Letters and digits beyond ASCII of blocks where every character is a letter, assigned in any Unicode version at hand.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ԯ"
_KNOWN = re.compile(f"[\\t-\\r -~ €–¿¡«»{_LATIN}]*")
_BROAD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\t-\\r  {_LATIN}0-9]+|[\\t-\\r  ]+(?![^\\t-\\r  ])|[\\t-\\r  ]+")


class Encoder:
    """A rank file's tokenizer: pieces, their ids, and both with memory of bounded size."""

    def __init__(self, folder: str = FOLDER, model: str = MODEL, room: int = 400_000):
        import regex
        import tiktoken

        with open(os.path.join(folder, f"{model}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding(model, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.any = regex.compile(PATTERN)
        self.room, self.memo = room, {}
        self.whole = {}
        for b in self.ranks:
            try:
                self.whole[b.decode()] = np.int32(self.ranks[b]).tobytes()
            except UnicodeDecodeError:
                pass

    def pieces(self, text: str) -> list[str]:
        """The pre-split of ``text``; its pieces are encoded independently."""
        if text.isascii():
            return _ASCII.findall(text)
        if _KNOWN.fullmatch(text):
            return _BROAD.findall(text)
        return self.any.findall(text)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as 32-bit integers."""
        found = self.whole.get(piece) or self.memo.get(piece)
        if found is None:
            found = self.encode(piece)
            if len(self.memo) >= self.room:
                self.memo.clear()
            self.memo[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as 32-bit integers."""
        return array("i", self.bpe.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=4)
def encoder(folder: str = FOLDER, model: str = MODEL) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(folder, model)


# ---- problem 8

MASK = np.uint64(127)  # a cut after one position in 128 on average
_APART = bytes(8)  # between texts, as long as the rolling hash looks back


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions at which a rolling hash of the last eight bytes says to cut."""
    x = data.astype(np.uint64)
    for width, factor in ((1, 0x100000001B3), (2, 0x1000193_1000193), (4, 0x9E3779B97F4A7C15)):
        x[width:] = x[width:] + x[:-width] * np.uint64(factor)
    return np.flatnonzero((x >> np.uint64(47)) & MASK == 0) + 1


class ChunkEncoder:
    """Encodes texts by content-defined chunks, each distinct chunk once.

    A chunk's ids are kept for its core, from its first to its last place where
    the pre-split has a boundary whatever surrounds it: before a blank that a
    printable ASCII character follows. What lies between two cores is a join; it
    is encoded again over both sides until they agree on such a boundary, so the
    result is that of the whole text. A chunk without such places becomes part
    of the join. Memory is bounded; what is forgotten is encoded again.
    """

    def __init__(self, enc: Encoder, room: int = 300_000):
        self.enc, self.room = enc, room
        self.chunks: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}
        self.joins: dict[bytes, bytes] = {}
        self.asked = self.made = 0

    def _chunk(self, raw: bytes) -> tuple[bytes, bytes | None, bytes]:
        first = next((i for i in _at_blanks(raw)), -1)
        if first < 0:
            out = (raw, None, b"")
        else:
            last = next(i for i in _at_blanks_back(raw))
            out = (raw[:first], self.enc.encode(raw[first:last].decode()) if last > first else b"", raw[last:])
        if len(self.chunks) >= self.room:
            self.chunks.clear()
        self.chunks[raw] = out
        self.made += 1
        return out

    def _join(self, raw: bytes) -> bytes:
        out = self.enc.encode(raw.decode())
        if len(self.joins) >= self.room:
            self.joins.clear()
        self.joins[raw] = out
        return out

    def encode(self, raw: bytes, cuts: list[int]) -> bytes:
        """Ids of the text whose UTF-8 form is ``raw``, cut at ``cuts``."""
        out, open_, a = [], b"", 0
        chunks, joins = self.chunks, self.joins
        for b in [*cuts, len(raw)]:
            if b <= a:
                continue
            part = raw[a:b]
            a = b
            self.asked += 1
            head, core, tail = chunks.get(part) or self._chunk(part)
            if core is None:
                open_ += head
                continue
            open_ += head
            if open_:
                out.append(joins.get(open_) or self._join(open_))
            out.append(core)
            open_ = tail
        if open_:
            out.append(joins.get(open_) or self._join(open_))
        return b"".join(out)


def _at_blanks(raw: bytes) -> Iterator[int]:
    i = raw.find(b" ")
    while i >= 0:
        if i + 1 < len(raw) and 0x21 <= raw[i + 1] <= 0x7E:
            yield i
        i = raw.find(b" ", i + 1)


def _at_blanks_back(raw: bytes) -> Iterator[int]:
    i = raw.rfind(b" ")
    while i >= 0:
        if i + 1 < len(raw) and 0x21 <= raw[i + 1] <= 0x7E:
            yield i
        i = raw.rfind(b" ", 0, i)


@lru_cache(maxsize=4)
def chunk_encoder(folder: str = FOLDER, model: str = MODEL) -> ChunkEncoder:
    return ChunkEncoder(encoder(folder, model))


def encode_batch(texts: pa.Array, enc: ChunkEncoder) -> pa.Array:
    """Id lists of a string array; null and empty texts give empty lists."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    raws = [t.encode() if t else b"" for t in texts.to_pylist()]
    joined = b"".join([x for r in raws for x in (_APART, r)])  # no hash reaches into the text before
    ends = np.cumsum([len(r) + len(_APART) for r in raws]) if raws else np.zeros(0, np.int64)
    cuts = _cuts(np.frombuffer(joined, np.uint8)) if joined else np.zeros(0, np.int64)
    starts = ends - [len(r) for r in raws] if raws else ends
    low, high = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
    out = [enc.encode(r, (cuts[low[i] : high[i]] - starts[i]).tolist()) if r else b"" for i, r in enumerate(raws)]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(out), np.int32), pa.int32()))


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    """``doc_id, ids``: the ids of each text, without special tokens.

    Null and empty texts have the empty list; repeated ids give repeated rows.
    Each worker keeps the ids of the chunks it has met, so text shared across
    documents is encoded once per worker without shuffling the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(folder, model)
        for b in batches:
            step = 512  # keeps a batch of very long texts in memory bounds
            for k in range(0, b.num_rows, step):
                s = b.slice(k, step)
                yield pa.RecordBatch.from_arrays([s.column(0), encode_batch(s.column(1), enc)], ["doc_id", "ids"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t")).mapInArrow(run, "doc_id long, ids array<int>")


def token_sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, tokens`` and the columns ``keep``: the size of each text by direct encoding; null and empty texts have 0."""
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), *(keep or ()), F.col(text).cast("string").alias("_t"))
    names = ["doc_id", *(keep or ()), "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, model).bpe
        for b in batches:
            sizes = [len(bpe.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64())], names)

    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("tokens", T.LongType())]))


# ---- problem 3

LOCAL = 4  # texts of one task that hold a piece before the task works out its length itself
ROOM = 1_000_000  # pieces a task keeps in mind


def _count_task(key_cols: list[str], folder: str, model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, model)
        whole, met, length = enc.whole, Counter(), {}
        for b in batches:
            known, pieces, freqs = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                n, rest = 0, {}
                for p in enc.pieces(t) if t else ():
                    if p in whole:
                        n += 1
                    elif (k := length.get(p)) is not None:
                        n += k
                    else:
                        rest[p] = rest.get(p, 0) + 1
                for p in rest:
                    met[p] += 1
                    if met[p] >= LOCAL:
                        length[p] = len(enc.piece(p)) // 4
                        del met[p]
                if len(met) > ROOM:  # counting begins again; only where a piece is counted changes
                    met.clear()
                if len(length) > ROOM:
                    length.clear()
                known.append(n)
                pieces.append(list(rest))
                freqs.append(list(rest.values()))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(known, pa.int64()), pa.array(pieces, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int32()))], [*key_cols, "known", "pieces", "freqs"])

    return run


def token_counts(df: DataFrame, keys: list[str], text: str = "text", folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    """``keys..., tokens``: the exact number of tokens of each row's text.

    Texts are split as the tokenizer splits them. A piece that is a token of the
    vocabulary counts one. Every other distinct piece is tokenized once and its
    length joined with the frequencies of the pieces per text. A piece that one
    task meets in ``LOCAL`` texts is tokenized once more there and its length kept
    for the rest of the task: so a common piece leaves a task at most ``LOCAL``
    times, however many texts hold it, and no task of the join gets a hot piece.
    Rows are told apart by a number of their own, so equal keys stay apart; keys
    and what is known of a row meet the sum of its other pieces once. Null and
    empty texts have 0 tokens; an empty table gives no rows.
    """
    src = df.select(*keys, F.col(text).cast("string").alias("_t"))
    key_fields = src.schema.fields[:-1]
    names = [f"k{i}" for i in range(len(keys))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, key_fields)] + [
        T.StructField("known", T.LongType()), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("freqs", T.ArrayType(T.IntegerType())),
    ])
    split = src.mapInArrow(_count_task(names, folder, model), schema).withColumn("row", F.monotonically_increasing_id())
    split = written(split, "token-pieces")  # which also fixes the numbers
    rare = split.select("row", F.explode(F.arrays_zip("pieces", "freqs")).alias("p")).select("row", F.col("p.pieces").alias("piece"), F.col("p.freqs").alias("freq"))

    @F.pandas_udf(T.IntegerType())
    def length(pieces: pd.Series) -> pd.Series:
        enc = encoder(folder, model)
        return pieces.map(lambda p: len(enc.piece(p)) // 4)

    distinct = rare.groupBy("piece").agg(F.count(F.lit(1)).alias("texts")).select("piece", length("piece").alias("len"))
    rest = rare.join(distinct, "piece").groupBy("row").agg(F.sum((F.col("freq") * F.col("len")).cast("long")).alias("n"))
    total = split.select("row", *names, "known").join(rest, "row", "left")
    return total.select(*(F.col(n).alias(k) for n, k in zip(names, keys)), (F.col("known") + F.coalesce("n", F.lit(0))).alias("tokens"))


def decoded(encoded: DataFrame, folder: str = FOLDER, model: str = MODEL) -> DataFrame:
    """``doc_id, decoded``: the text that the ids of :func:`encode_corpus` stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(folder, model).bpe
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(ids) for ids in b.column(1).to_pylist()], pa.string())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")
