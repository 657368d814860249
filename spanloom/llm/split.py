"""Oversized texts cut at natural boundaries (problem 4).

A text is parsed into a tree by its structure: a heading owns what follows up to
the next one of its depth or above, an HTML block owns what it encloses, a list
item owns the lines that are indented more. Packing goes bottom-up: sibling
subtrees are merged while they fit the limit, and only a node that is larger
than the limit by itself is opened; what it was cut into is not merged with its
siblings, so no piece runs from inside one section into another. A heading stays
with the first piece of what it owns. Text without structure is opened into
lines, sentences, clauses and words, and where even one word is too long it is
cut between grapheme clusters.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 2000, 200
# Ranks of nodes, coarse to fine: headings have their depth, 1 to 6.
ELEMENT, BLOCK, ITEM, DEEPEST = 10, 30, 31, 60
_LINE = re.compile(r"[^\r\n\x85\u2028\u2029]*(?:\r\n|[\r\n\x85\u2028\u2029]|\Z)")
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]")
_UNDERLINE = re.compile(r" {0,3}(?:(=)={2,}|--{2,})[ \t]*$")
_BULLET = re.compile(r"([ \t]*)(?:[-*+•–][ \t]|\d{1,9}[.)][ \t])")
_FENCE = re.compile(r"[ \t]*(?:```|~~~)")
_TAG = re.compile(r"<(/?)(h[1-6]|html|body|div|section|article|blockquote|ul|ol|li|table|tr|p|pre)\b[^<>]*>", re.I)
# Ends of units within text that has no structure, coarse to fine; a unit keeps the white space after it.
LEVELS = [
    re.compile(r"\r\n|[\n\r\x85\u2028\u2029]"),
    re.compile(r"[.!?…。！？．]+[\"'»”)\]]*(?:\s+|$)|(?<=[。！？．])"),
    re.compile(r"[,;:，；：)\]]\s+| [-–—] "),
    re.compile(r"\s+"),
]


@dataclass(slots=True)
class Node:
    """A stretch of text: up to the first kid it is the node's own, a heading's line for one."""

    start: int
    end: int
    rank: int
    kids: list[Node] = field(default_factory=list)


def _bounds(text: str) -> dict[int, int]:
    """Where nodes begin, with their ranks."""
    out: dict[int, int] = {}

    def put(at: int, rank: int) -> None:
        if at < len(text):
            out[at] = min(rank, out.get(at, rank))

    lines = [(m.start(), m[0].rstrip("\r\n\x85\u2028\u2029")) for m in _LINE.finditer(text) if m[0]]
    fenced, blank, items = False, True, False
    for k, (at, line) in enumerate(lines):
        if _FENCE.match(line):
            if not fenced and blank:
                put(at, BLOCK)
            fenced, blank = not fenced, False
        elif fenced:
            pass
        elif not line.strip():
            blank = True
        else:
            under = _UNDERLINE.match(lines[k + 1][1]) if k + 1 < len(lines) else None
            indent = len(line) - len(line.lstrip(" \t"))
            if m := _ATX.match(line):
                put(at, len(m[1]))
                items = False
            elif under and blank and not _BULLET.match(line):
                put(at, 1 if under[1] else 2)
                items = False
            elif m := _BULLET.match(line):
                put(at, ITEM + min(indent, DEEPEST))
                items = True
            elif blank:
                items = items and indent > 0
                put(at, ITEM + min(indent, DEEPEST) if items else BLOCK)
            blank = False
    open_: list[str] = []
    for m in _TAG.finditer(text) if "<" in text else ():
        name, after = m[2].lower(), m.end()
        if name[0] == "h" and name[1:].isdigit():
            if not m[1]:
                put(m.start(), int(name[1:]))
        elif not m[1]:
            if open_ and open_[-1] == name and name in ("li", "p", "tr"):  # closed by the next of its kind
                open_.pop()
            put(m.start(), ELEMENT + min(len(open_), BLOCK - ELEMENT - 1))
            open_.append(name)
        elif name in open_:
            while open_.pop() != name:
                pass
            while after < len(text) and text[after].isspace():
                after += 1
            put(after, ELEMENT + min(len(open_), BLOCK - ELEMENT - 1))
    return out


def tree(text: str) -> Node:
    """The structure of ``text``; the kids of a node lie in it one after the other up to its end."""
    root = Node(0, len(text), 0)
    path = [root]
    for at, rank in sorted(_bounds(text).items()):
        while path[-1].rank >= rank:
            path.pop().end = at
        node = Node(at, len(text), rank)
        path[-1].kids.append(node)
        path.append(node)
    return root


def _pack_node(text: str, node: Node, size: int) -> list[tuple[int, int]]:
    """Pieces of at most ``size``, in order."""
    if node.end - node.start <= size:
        return [(node.start, node.end)]
    if not node.kids:
        return _pack_text(text, node.start, node.end, size, 0)
    out: list[tuple[int, int]] = []
    loose = False  # whether the last piece may grow by the next sibling
    if node.kids[0].start > node.start:
        out = _pack_text(text, node.start, node.kids[0].start, size, 0)
        loose = len(out) == 1
    for k, kid in enumerate(node.kids):
        parts = _pack_node(text, kid, size)
        if loose and (len(parts) == 1 or k == 0) and parts[0][1] - out[-1][0] <= size:
            out[-1] = (out[-1][0], parts[0][1])
            out += parts[1:]
        else:
            out += parts
        loose = len(parts) == 1
    return out


def _units(text: str, a: int, b: int, level: int) -> list[tuple[int, int]]:
    """The parts of ``text[a:b]`` at ``level``, covering it."""
    cuts = [a]
    for m in LEVELS[level].finditer(text, a, b):
        if a < m.end() < b and m.end() > cuts[-1]:
            cuts.append(m.end())
    cuts.append(b)
    return list(zip(cuts, cuts[1:]))


def _hard(text: str, a: int, b: int, size: int) -> Iterator[tuple[int, int]]:
    """Cuts of one endless word, between grapheme clusters where one is near."""
    while b - a > size:
        at = a + size
        low = max(a + 1, at - 32)
        while at > low and (ud.category(text[at])[0] == "M" or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d" or "\U0001f3fb" <= text[at] <= "\U0001f3ff"):
            at -= 1
        if at == low:
            at = a + size
        yield a, at
        a = at
    yield a, b


def _pack_text(text: str, a: int, b: int, size: int, level: int) -> list[tuple[int, int]]:
    """Pieces of text without structure: units are merged while they fit, and opened where they don't."""
    if b - a <= size:
        return [(a, b)]
    if level == len(LEVELS):
        return list(_hard(text, a, b, size))
    out: list[tuple[int, int]] = []
    for x, y in _units(text, a, b, level):
        if out and y - out[-1][0] <= size:
            out[-1] = (out[-1][0], y)
        elif y - x > size:
            out += _pack_text(text, x, y, size, level + 1)
        else:
            out.append((x, y))
    return out


def _back(text: str, start: int, at: int, overlap: int) -> int:
    """Where a piece that goes on at ``at`` begins so that it repeats up to ``overlap`` before it."""
    low = max(start, at - overlap)
    if low <= 0 or text[low - 1].isspace():
        return low
    for i in range(low, min(at, low + overlap // 2)):  # not within a word, if one ends soon
        if text[i].isspace():
            return i + 1
    while low < at and (ud.category(text[low])[0] == "M" or text[low] == "\u200d" or text[low - 1] == "\u200d"):
        low += 1
    return low


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces ``(start, end, fresh)`` of ``text``: fresh is where what no earlier piece holds begins.

    Every piece has at most ``limit`` code points, the fresh parts cover the text
    without gaps, and each piece but the first begins up to ``overlap`` earlier.
    """
    if limit <= overlap or overlap < 0:
        raise ValueError("the limit must be larger than the overlap")
    if len(text) <= limit:
        return [(0, len(text), 0)]
    out: list[tuple[int, int, int]] = []
    for a, b in _pack_node(text, tree(text), limit - overlap):
        out.append((a if not out else _back(text, out[-1][2], a, overlap), b, a))
    return out


PIECE = T.StructType([
    T.StructField("piece_no", T.IntegerType()), T.StructField("piece_start", T.IntegerType()), T.StructField("piece_end", T.IntegerType()),
    T.StructField("fresh_start", T.IntegerType()), T.StructField("piece_text", T.StringType()),
])


def split_oversized(df: DataFrame, row_id: str = "row_id", text: str = "text", spans: str = "spans", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the texts longer than ``limit`` code points, with the spans that lie in each.

    One row per piece: ``row_id, piece_no, piece_start, piece_end, fresh_start,
    piece_text, piece_spans``; offsets count code points of the text, span
    offsets those of the piece. Spans keep their order and type; one that is cut
    is carried clipped, with ``clipped`` set; spans with missing, reversed or
    outlying offsets are left out. Null spans stay null. Null, empty and short
    texts give no rows. Work is per row.
    """

    @F.pandas_udf(T.ArrayType(PIECE))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [(i, a, b, f, t[a:b]) for i, (a, b, f) in enumerate(split_text(t, limit, overlap), 1)])

    long = df.filter(F.length(text) > limit).select(F.col(row_id).alias("row_id"), F.col(text).alias("_t"), F.col(spans).alias("_s"))
    rows = long.select("row_id", "_s", F.explode(cut("_t")).alias("p")).select("row_id", "_s", "p.*")
    hit = F.filter("_s", lambda s: (s.start < s.end) & (s.start >= 0) & (s.end > F.col("piece_start")) & (s.start < F.col("piece_end")))
    moved = F.transform(hit, lambda s: F.struct(
        (F.greatest(s.start, F.col("piece_start")) - F.col("piece_start")).alias("start"),
        (F.least(s.end, F.col("piece_end")) - F.col("piece_start")).alias("end"), s.entity_type.alias("entity_type"),
        ((s.start < F.col("piece_start")) | (s.end > F.col("piece_end"))).alias("clipped"),
    ))
    return rows.withColumn("piece_spans", moved).drop("_s")


def checked_pieces(pieces: DataFrame, df: DataFrame, row_id: str = "row_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``row_id, n, rebuilt, within, starts`` of each text that was cut; ``row_id`` must be unique.

    ``rebuilt`` tells whether the fresh parts give the text again, ``within``
    whether no piece is over the limit, and ``starts`` counts the places of the
    text where spans begin, found again from the pieces' spans.
    """
    fresh = F.substring("piece_text", F.col("fresh_start") - F.col("piece_start") + 1, F.length("piece_text"))
    begin = F.transform(F.filter("piece_spans", lambda s: ~(s.clipped & (s.start == 0) & (F.col("piece_no") > 1))), lambda s: s.start + F.col("piece_start"))
    one = pieces.select("row_id", F.struct("piece_no", fresh.alias("fresh"), F.coalesce(begin, F.expr("cast(array() as array<int>)")).alias("begin")).alias("p"), F.length("piece_text").alias("k"))
    by = one.groupBy("row_id").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("k").alias("k"))  # the pieces of one text
    whole = df.select(F.col(row_id).alias("row_id"), F.col(text).alias("_t"))
    rebuilt = F.concat_ws("", F.transform("p", lambda p: p.fresh)) == F.col("_t")
    starts = F.size(F.array_distinct(F.flatten(F.transform("p", lambda p: p.begin))))
    return by.join(whole, "row_id").select("row_id", F.length("_t").alias("n"), rebuilt.alias("rebuilt"), (F.col("k") <= limit).alias("within"), starts.alias("starts"))
