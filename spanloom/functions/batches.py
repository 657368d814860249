"""Row-wise text work over Arrow batches, each linear in its document.

What walks a text and cuts it at many places is written here and not as a fold of
built-in expressions: those count code points from the start of a text at each
cut and copy their array at each step, which is quadratic in a long document, and
cost several times as much on short ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"int": (T.IntegerType(), pa.int32()), "string": (T.StringType(), pa.string()), "double": (T.DoubleType(), pa.float64())}


def _spark(fields: str) -> T.StructType:
    """``name:kind,...`` as Spark's type; a DDL string would need a session where workers import this."""
    return T.StructType([T.StructField(n, _KINDS[k][0]) for n, k in (f.split(":") for f in fields.split(","))])


def _arrow(fields: str) -> pa.StructType:
    return pa.struct([(n, _KINDS[k][1]) for n, k in (f.split(":") for f in fields.split(","))])


_SPAN, _MARK = "start:int,end:int,entity_type:string,score:double", "placeholder:string,value:string"
_WORD_FIELDS = "word:string,start:int,end:int"
_LABELLED, _WINDOWED = _WORD_FIELDS + ",label:string", "window_index:int," + _SPAN
SPAN_TYPE, MARK_TYPE = _arrow(_SPAN), _arrow(_MARK)
SPANS = T.ArrayType(_spark(_SPAN))


def lists(rows: list[list[tuple] | None], kind: pa.StructType) -> pa.ListArray:
    """A list array of structs from rows of tuples; None is a null list."""
    ends, flat = [0], []
    for r in rows:
        flat += r or ()
        ends.append(len(flat))
    cols = list(zip(*flat)) or [()] * kind.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(cols)], fields=[kind.field(i) for i in range(kind.num_fields)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


def greedy(hits: list[tuple[int, int, str, float | None]]) -> list[tuple[int, int, str, float | None]]:
    """Hits that overlap no earlier accepted one; earlier start goes first, then longer, then type."""
    out, at = [], 0
    for h in sorted(hits, key=lambda h: (h[0], -h[1], h[2])):
        if h[0] >= at:
            out.append(h)
            at = h[1]
    return out


def matches(text: Column, patterns: dict[str, str], resolve: bool, needs: Callable[[str], bool] | None = None) -> Column:
    """Matches of patterns as spans scored 1, resolved or merely sorted; texts that fail ``needs`` have none."""
    compiled = [(k, re.compile(p)) for k, p in patterns.items()]

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        rows: list[list[tuple] | None] = []
        for t in texts.to_pylist():
            if t is None or (needs and not needs(t)):
                rows.append(None if t is None else [])
                continue
            hits = [(m.start(), m.end(), k, 1.0) for k, r in compiled for m in r.finditer(t)]
            rows.append(greedy(hits) if resolve else sorted(hits, key=lambda h: h[:3]))
        return lists(rows, SPAN_TYPE)

    return run(text)


def replace_one(text: str, spans: list[tuple[int, int, str]]) -> tuple[str | None, list[tuple[str, str]] | None, str | None]:
    """Text with placeholders, their values in order, and why not; numbers count the spans of a type."""
    spans = sorted(spans)
    if any(b > len(text) for _, b, _ in spans):
        return None, None, "a span ends past the text"
    if any(x[1] > y[0] for x, y in zip(spans, spans[1:])):
        return None, None, "spans overlap"
    parts, mapping, at, n = [], [], 0, Counter()
    for a, b, kind in spans:
        n[kind] += 1
        mark = f"[{kind}_{n[kind]}]"
        parts += (text[at:a], mark)
        mapping.append((mark, text[a:b]))
        at = b
    return "".join([*parts, text[at:]]), mapping, None


def _texts(*cols: list) -> list[pa.Array]:
    return [pa.array(c, pa.string()) for c in cols]


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("mapping", T.ArrayType(_spark(_MARK))), T.StructField("error", T.StringType())]))
def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = [(None, None, None) if t is None or s is None else replace_one(t, [(x["start"], x["end"], x["entity_type"]) for x in s]) for t, s in zip(texts.to_pylist(), spans.to_pylist())]
    done, errors = _texts([r[0] for r in out], [r[2] for r in out])
    return pa.StructArray.from_arrays([done, lists([r[1] for r in out], MARK_TYPE), errors], names=["text", "mapping", "error"])


def put_back_one(text: str, mapping: list[tuple[str, str]]) -> tuple[str | None, str | None]:
    """Values put back one after the other; each placeholder must then occur once. Error where one doesn't."""
    for mark, value in mapping:
        if not mark or text.count(mark) != 1:
            return None, f"{mark} is not in the text exactly once"
        text = text.replace(mark, value)
    return text, None


def put_back_all(text: str, mapping: list[tuple[str, str]]) -> tuple[str | None, str | None]:
    """The same in one pass, where no value could be taken for a placeholder: then the order does not matter."""
    marks = dict(mapping)
    plain = len(marks) == len(mapping) and not any("[" in v or "]" in v for v in marks.values()) and all(re.fullmatch(r"\[[^\[\]]+\]", k) for k in marks)
    if len(marks) < 3 or not plain or re.search(r"\[[^\]]*\[", text):
        return put_back_one(text, mapping)
    parts, at, met = [], 0, Counter()
    for m in re.finditer(r"\[[^\[\]]+\]", text):
        if (value := marks.get(m[0])) is not None:
            met[m[0]] += 1
            parts += (text[at : m.start()], value)
            at = m.end()
    if any(met[k] != 1 for k in marks):
        return put_back_one(text, mapping)  # it names the first that fails
    return "".join([*parts, text[at:]]), None


@F.arrow_udf(_spark("text:string,error:string"))
def put_back(texts: pa.Array, mappings: pa.Array) -> pa.Array:
    out = [(None, None) if t is None or m is None else put_back_all(t, [(x["placeholder"], x["value"]) for x in m]) for t, m in zip(texts.to_pylist(), mappings.to_pylist())]
    return pa.StructArray.from_arrays(_texts([r[0] for r in out], [r[1] for r in out]), names=["text", "error"])


# ---- words


WORD_TYPE, LABELLED_TYPE = _arrow(_WORD_FIELDS), _arrow(_LABELLED)
_WORD = re.compile(r"\S+")


def words_of(text: str) -> list[tuple[str, int, int]]:
    """Runs without white space, with offsets."""
    return [(m[0], *m.span()) for m in _WORD.finditer(text)]


@F.arrow_udf(T.ArrayType(_spark(_WORD_FIELDS)))
def words(texts: pa.Array) -> pa.Array:
    return lists([None if t is None else words_of(t) for t in texts.to_pylist()], WORD_TYPE)


def labelled_words(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, int, int, str | None]]:
    """Words cut where spans begin and end; one in a span is B- where both begin, else I-; of several the first in the list counts."""
    edges = sorted({x for a, b, _ in spans for x in (a, b)})
    coming = sorted(((a, i) for i, (a, _, _) in enumerate(spans)), reverse=True)
    out, near, k = [], [], 0
    for m in _WORD.finditer(text):
        a, end = m.span()
        while k < len(edges) and edges[k] <= a:
            k += 1
        while a < end:
            b = min(end, edges[k]) if k < len(edges) else end
            while coming and coming[-1][0] <= a:
                near.append(coming.pop()[1])
            near = [i for i in near if spans[i][1] > a]
            of = min((i for i in near if spans[i][1] >= b), default=None)
            kind = None if of is None else spans[of][2]
            out.append((text[a:b], a, b, "O" if of is None else None if kind is None else f"{'B' if spans[of][0] == a else 'I'}-{kind}"))
            a = b
            if k < len(edges) and edges[k] <= a:
                k += 1
    return out


@F.arrow_udf(T.ArrayType(_spark(_LABELLED)))
def labelled(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = [None if t is None or s is None else labelled_words(t, [(x["start"], x["end"], x["entity_type"]) for x in s if x and x["start"] is not None and x["end"] is not None]) for t, s in zip(texts.to_pylist(), spans.to_pylist())]
    return lists(rows, LABELLED_TYPE)


# ---- tokens put together again


OFFSET_TYPE, TYPED_TYPE = _arrow("start:int,end:int"), _arrow("start:int,end:int,entity_type:string")


def joined(left: set[str], right: set[str]) -> Callable[[Column], Column]:
    """A builder of ``struct<text, offsets>`` of token arrays: no blank before tokens of ``left`` or behind those of ``right``."""
    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(_spark("start:int,end:int")))]))
    def run(tokens: pa.Array) -> pa.Array:
        texts, offsets = [], []
        for row in tokens.to_pylist():
            if row is None or None in row:
                texts.append(None)
                offsets.append(None)
                continue
            parts, at, size, last = [], [], 0, None
            for t in row:
                if size and t not in left and last not in right:
                    parts.append(" ")
                    size += 1
                parts.append(t)
                at.append((size, size + len(t)))
                size, last = size + len(t), t
            texts.append("".join(parts))
            offsets.append(at)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), lists(offsets, OFFSET_TYPE)], names=["text", "offsets"])

    return run


@F.arrow_udf(T.ArrayType(_spark("start:int,end:int,entity_type:string")))
def persons(tags: pa.Array, offsets: pa.Array) -> pa.Array:
    """Runs of a person's tags; one that continues without a start opens a run."""
    rows: list[list[tuple] | None] = []
    for ts, os in zip(tags.to_pylist(), offsets.to_pylist()):
        if ts is None or os is None or len(ts) != len(os):
            rows.append(None)
            continue
        out, going = [], False
        for t, o in zip(ts, os):
            if going and t == "I-PER":
                out[-1] = (out[-1][0], o["end"], "PERSON")
            elif t in ("B-PER", "I-PER"):
                out.append((o["start"], o["end"], "PERSON"))
            going = t in ("B-PER", "I-PER")
        rows.append(out)
    return lists(rows, TYPED_TYPE)


# ---- predictions of overlapping windows


WINDOWED_TYPE = _arrow(_WINDOWED)
Window = tuple[int, int, int, str, "float | None"]


def _rank(s: Window) -> tuple:
    """Score, a missing one below all; then length; then the earlier window."""
    p = s[4]
    return (p is not None, p is not None and p != p, p if p is not None and p == p else 0.0, s[2] - s[1], -s[0])


def _type_first(a: str, b: str) -> bool:
    """Whether type ``a`` wins a full tie: earlier in the alphabet, but the longer of a name and its prefix."""
    return a != b and (a.startswith(b) or not b.startswith(a) and a < b)


def _in_order(s: Window) -> tuple:
    return (s[1], s[2], s[3], s[0], s[4] is not None, s[4] or 0.0)


def merged_spans(spans: list[Window]) -> list[Window]:
    """Duplicates out, then overlaps of one type, then of different types.

    Survivors of a pass are apart and in order, so of those a span can overlap
    only the last one, of its type in the first pass and of all in the second.
    """
    best: dict[tuple[int, int, str], Window] = {}
    for s in spans:
        x = best.get(s[1:4])
        if x is None or _rank(s) > _rank(x):  # same place, so score and window decide
            best[s[1:4]] = s
    last: dict[str, Window] = {}
    same: list[Window] = []
    for s in sorted(best.values(), key=_in_order):
        x = last.get(s[3])
        if x is not None and s[1] < x[2] and x[1] < s[2]:
            if _rank(s) > _rank(x):
                last[s[3]] = s
            continue
        if x is not None:
            same.append(x)
        last[s[3]] = s
    out: list[Window] = []
    for s in sorted([*same, *last.values()], key=_in_order):
        x = out[-1] if out else None
        if x is None or not (s[1] < x[2] and x[1] < s[2]) or s[3] == x[3]:
            out.append(s)
        elif _rank(s) > _rank(x) or _rank(s) == _rank(x) and _type_first(s[3], x[3]):
            out[-1] = s
    return sorted(out, key=_in_order)


@F.arrow_udf(T.ArrayType(_spark(_WINDOWED)))
def merged(windows: pa.Array) -> pa.Array:
    names = WINDOWED_TYPE.names
    return lists([None if w is None else merged_spans([tuple(x[n] for n in names) for x in w]) for w in windows.to_pylist()], WINDOWED_TYPE)


# ---- documents taken apart where no span reaches across


def _held(spans: pa.ListArray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """How many structs each list has, a null one none, and the fields of all of them."""
    flat = pc.list_flatten(spans)
    return pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False).astype(np.int64), dict(zip((f.name for f in flat.type), flat.flatten()))


def _dealt(sizes: np.ndarray, fields: dict[str, pa.Array], mask: pa.Array | None = None) -> pa.ListArray:
    """Lists of so many structs each."""
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(list(fields.values()), names=list(fields)), mask=mask)


def _whole(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def pieces_of(batch: pa.RecordBatch, cuts: list[float]) -> Iterator[pa.RecordBatch]:
    """``docs, length, spans, predictions, n`` of rows with the middle three; see :func:`apart`."""
    length, gold, predicted = (batch.column(k) for k in ("length", "spans", "predictions"))
    (sizes_g, of_g), (sizes_p, of_p) = _held(gold), _held(predicted)
    score = of_p["score"]
    at = np.searchsorted(cuts, score.to_numpy(zero_copy_only=False), "right")  # NaN is above all, as in Spark
    of_p["score"] = pa.array(np.array([-1.0, *cuts])[at], pa.float64(), mask=score.is_null().to_numpy(zero_copy_only=False))
    n, rows = _whole(length), np.arange(len(length))
    doc = np.concatenate([np.repeat(rows, sizes_g), np.repeat(rows, sizes_p)])
    a, b = (np.concatenate([_whole(of_g[k]), _whole(of_p[k])]) for k in ("start", "end"))
    named = [pc.fill_null(pc.not_equal(pc.utf8_trim(f["entity_type"], " "), ""), False).to_numpy(zero_copy_only=False) for f in (of_g, of_p)]
    good = (a >= 0) & (a < b) & (b <= n[doc]) & np.concatenate(named)
    sound = (n >= 0) & ~gold.is_null().to_numpy(zero_copy_only=False) & ~predicted.is_null().to_numpy(zero_copy_only=False)
    sound[doc[~good]] = False
    if not sound.all():
        left = pa.array(np.flatnonzero(~sound))
        one = pa.array(np.ones(len(left), np.int64))
        spans, scored = _dealt(sizes_g, of_g, gold.is_null()), _dealt(sizes_p, of_p, predicted.is_null())
        yield pa.RecordBatch.from_arrays([one, length.take(left), spans.take(left), scored.take(left), one], names=["docs", *batch.schema.names, "n"])
    # A span that starts at or behind the furthest end so far, or in another document, begins a piece.
    mine = np.flatnonzero(sound[doc])
    order = mine[np.lexsort((a[mine], doc[mine]))]
    begin, reach = (doc[order] << 32) + a[order], np.maximum.accumulate((doc[order] << 32) + b[order])
    heads = np.flatnonzero(np.concatenate([np.ones(min(len(order), 1), bool), begin[1:] >= reach[:-1]]))
    tails = np.concatenate([heads[1:], [len(order)]])[: len(heads)] - 1
    first, owner = a[order[heads]], doc[order[heads]]
    size = reach[tails] - (owner << 32) - first
    piece = np.full(len(doc), -1)
    piece[order] = np.repeat(np.arange(len(heads)), tails - heads + 1)

    def own(piece: np.ndarray, fields: dict[str, pa.Array]) -> pa.ListArray:
        """The spans of each piece, in the order they had, counted from its start."""
        held = np.flatnonzero(piece >= 0)
        held = held[np.argsort(piece[held], kind="stable")]
        moved = {k: v.take(pa.array(held)) for k, v in fields.items()}
        for k in ("start", "end"):
            moved[k] = pa.array(_whole(moved[k]) - first[piece[held]], fields[k].type)
        return _dealt(np.bincount(piece[held], minlength=len(heads)), moved)

    columns = [pa.array(np.zeros(len(heads), np.int64)), pa.array(size, length.type), own(piece[: len(of_g["start"])], of_g), own(piece[len(of_g["start"]) :], of_p), pa.array(np.ones(len(heads), np.int64))]
    yield pa.RecordBatch.from_arrays(columns, names=["docs", *batch.schema.names, "n"])
    rest = n - np.bincount(owner, weights=size, minlength=len(n)).astype(np.int64)
    bare, times = np.unique(rest[sound], return_counts=True)
    none = np.zeros(len(bare), np.int64)
    nothing = [_dealt(none, {k: v.slice(0, 0) for k, v in f.items()}) for f in (of_g, of_p)]
    yield pa.RecordBatch.from_arrays([pa.array(none + 1), pa.array(bare, length.type), *nothing, pa.array(times.astype(np.int64))], names=["docs", *batch.schema.names, "n"])


def apart(cuts: list[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``length, spans, predictions`` as pieces ``docs, length, spans, predictions, n``, for ``mapInArrow``.

    A piece is what spans that overlap one another cover together, counted from
    its start; what no span covers is one piece per document, with ``docs`` 1, and
    comes as often as ``n`` says. A score becomes the highest cut not above it, or
    -1 below all, so comparing it with any cut gives the same. A row with a null
    array or a span that breaks a rule stays whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pieces_of(batch, cuts)

    return run
