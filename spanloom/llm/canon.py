"""One consistent form of text that looks the same (problem 1).

A transducer over grapheme clusters: a cluster is a base character with every
combining mark and invisible character after it. Its output is looked up in a
table compiled from rules (widths, spaces, ligatures, look-alike letters,
canonical composition) when the cluster is first met, so a text is rewritten in
one pass and each distinct cluster is worked out once per process.
"""

from __future__ import annotations

import re
import unicodedata as ud
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts drawn like a Latin letter; each pair of strings goes letter by letter.
_DRAWN_ALIKE = (
    ("АВЕЅІЈКМНОРСТУХԚԜӀ", "ABESIJKMHOPCTYXQWI"), ("аеѕіјорсухһԁԛԝѵӏ", "aesijopcyxhdqwvl"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"), ("ονϲϳ", "ovcj"),  # Greek
    ("ՕՏԼ", "OSL"), ("օսհզց", "ouhqg"),  # Armenian
    ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"),  # Cherokee
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
    ("ɑɡ", "ag"),  # Latin letters of phonetic writing
)
LOOKALIKES = {a: b for others, latin in _DRAWN_ALIKE for a, b in zip(others, latin, strict=True)}
# Controls that lay text out and so show something.
LAYOUT = "\t\n\v\f\r\x85"
ZWJ = "\u200d"


def _invisible(ch: str) -> bool:
    cp = ord(ch)
    if ud.category(ch) == "Cc":
        return ch not in LAYOUT
    if ud.category(ch) == "Cf":  # the signs that enclose Arabic or Kaithi numbers are drawn
        return not (0x600 <= cp <= 0x605 or cp in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD))
    return cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= cp <= 0x180F or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF


def _width(ch: str) -> str | None:
    return ud.normalize("NFKC", ch) if ud.decomposition(ch).startswith(("<wide>", "<narrow>")) else None


def _joined(ch: str) -> str | None:
    """Several Latin letters in one sign: ligatures, digraphs, Roman numerals."""
    kind, _, rest = ud.decomposition(ch).partition(" ")
    name = ud.name(ch, "")
    if kind == "<compat>" and ("LATIN" in name and ("LIGATURE" in name or "DIGRAPH" in name) or "ROMAN NUMERAL" in name):
        return "".join(chr(int(x, 16)) for x in rest.split())
    return None


def _styled(ch: str) -> str | None:
    """A letter or digit in one of the typefaces that have signs of their own."""
    return ud.normalize("NFKC", ch) if ud.decomposition(ch).startswith("<font>") else None


def _composed(ch: str) -> str | None:
    """A letter with marks whose base is drawn like a Latin letter."""
    d = ud.normalize("NFD", ch)
    if d == ch or ud.category(ch)[0] == "M":
        return None
    whole = ud.normalize("NFC", "".join(LOOKALIKES.get(x, x) for x in d))
    return whole if whole != ch else None


RULES = (
    lambda ch: "" if _invisible(ch) else None, lambda ch: " " if ud.category(ch) == "Zs" and ch != " " else None,
    LOOKALIKES.get, _width, _joined, _styled, _composed,
)


def _compile() -> tuple[dict[str, str], list[int], list[int]]:
    """The table of single characters, its keys, and what extends a cluster.

    A character that two rules rewrite must come out the same in the end,
    whichever goes first, and nothing that comes out may be rewritten again.
    """
    ways: dict[str, set[str]] = {}
    extend = []
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0x20000), *range(0xE0000, 0xE01F0)]:  # the rest are ideographs and syllables
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if ud.category(ch) in ("Mn", "Mc", "Me") or _invisible(ch):
            extend.append(cp)
        if outs := {out for rule in RULES if (out := rule(ch)) is not None and out != ch}:
            ways[ch] = outs

    def final(text: str) -> str:
        for _ in range(4):
            text = "".join(next(iter(ways[x])) if len(ways.get(x, ())) == 1 else x for x in text)
        return ud.normalize("NFC", text)

    table = {}
    for ch, outs in ways.items():
        ends = {final(out) for out in outs}
        if len(ends) > 1:
            raise ValueError(f"two rules rewrite {ch!r}: {sorted(ends)!r}")
        (table[ch],) = ends
    bad = [ch for ch, out in table.items() if any(table.get(x, x) != x for x in out)]
    if bad:
        raise ValueError(f"rules rewrite their own output for {bad[:5]!r}")
    return table, sorted(map(ord, table)), extend


def _class(points: list[int]) -> str:
    runs: list[list[int]] = []
    for cp in points:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs)


TABLE, _KEYS, _EXTEND = _compile()


def _pattern(top: int) -> re.Pattern[str]:
    extend, keys = _class([x for x in _EXTEND if x < top]), _class(sorted({x for x in [*_KEYS, *_EXTEND] if x < top}))
    return re.compile(f"[^{extend}][{extend}]+|[{keys}]", re.S)


_CLUSTER, _CLUSTER_ALL = _pattern(0x10000), _pattern(0x110000)  # classes with characters beyond the BMP match slowly
_RARE = {chr(x) for x in [*_KEYS, *_EXTEND] if x > 0xFFFF}
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _clusters(text: str) -> re.Pattern[str]:
    return _CLUSTER if _RARE.isdisjoint(_BEYOND.findall(text)) else _CLUSTER_ALL


_PLAIN = re.compile(r"[^\t-\r -~]")


class _Memo(dict):
    """Cluster to output, worked out when missing."""

    def __missing__(self, cluster: str) -> str:
        base = cluster[0]
        if ud.category(base) in ("So", "Sk") and cluster.endswith(ZWJ):  # joins two pictures into another one
            out = base + ZWJ
        elif len(cluster) == 1:
            out = TABLE.get(cluster, cluster)
        else:
            kept = "".join(x for x in ud.normalize("NFD", cluster) if not _invisible(x))
            out = ud.normalize("NFC", "".join(TABLE.get(x, x) for x in kept))
            out = "".join(TABLE.get(x, x) for x in out)
            if (joiner := _joiner(cluster)) and kept:  # shows in how the letters around it are drawn
                out += joiner
        if len(self) > 200_000:  # unbounded input must not grow the table for ever
            self.clear()
        self[cluster] = out
        return out


_MEMO = _Memo()
JOINERS = "\u200c\u200d"
# Blocks whose letters join with their neighbours: Arabic and its kin, Mongolian.
_JOINING = ((0x620, 0x8FF), (0x1800, 0x18AF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC))
# A joiner that nothing follows which it could part or join.
_IDLE = re.compile("[\u200c](?![\u0620-\u08ff\u0900-\u0dff\u1800-\u18af\ufb50-\ufdff\ufe70-\ufefc])")


def _joiner(cluster: str) -> str:
    """The joiner at the end of a cluster where it shows: behind a joining letter, or a sign that kills a vowel."""
    if cluster[-1] not in JOINERS:
        return ""
    before = cluster.rstrip(JOINERS)
    joins = any(a <= ord(before[0]) <= b for a, b in _JOINING) or ud.combining(before[-1]) == 9
    return cluster[-1] if joins and (cluster[-1] == "\u200c" or ud.combining(before[-1]) == 9) else ""


def canon(text: str) -> str:
    """The consistent form of ``text``."""
    if text.isascii() and not _PLAIN.search(text):
        return text
    form = _clusters(text).sub(lambda m: _MEMO[m[0]], text)
    return _IDLE.sub("", form) if "\u200c" in form else form


_TWO_CASED = re.compile("[\u0370-\u052f]")


def raised(text: str) -> str:
    """The consistent form in capitals.

    Capitals and not small letters, as a letter may look alike in one case only
    (Cyrillic н and Н): small ones are raised before the form is taken again.
    """
    up = canon(text).upper()
    return canon(up) if not up.isascii() and _TWO_CASED.search(up) else up


def raised_map(text: str) -> tuple[str, array | None]:
    """:func:`raised` with where each of its characters comes from, as in :func:`canon_map`."""
    form, at = canon_map(text)
    up = form.upper()
    if len(up) != len(form):  # capitals are made character by character
        wide = array("i", [i for i, c in enumerate(form) for _ in c.upper()] + [len(form)])
        at = wide if at is None else array("i", [at[i] for i in wide])
    if up.isascii() or not _TWO_CASED.search(up):
        return up, at
    last, back = canon_map(up)
    if back is not None:
        at = back if at is None else array("i", [at[i] for i in back])
    return last, at


def canon_map(text: str) -> tuple[str, array | None]:
    """The consistent form, and for each of its characters where its source cluster starts.

    The second value has one entry more than the form, the source's length, and
    is None where every character stays in its place.
    """
    if text.isascii() and not _PLAIN.search(text):
        return text, None
    parts, at, last, same = [], array("i"), 0, True
    for m in _clusters(text).finditer(text):
        a, b = m.span()
        out = _MEMO[m[0]]
        if b - a == 1 and len(out) == 1:
            if a > last:
                parts.append(text[last:a])
                at.extend(range(last, a))
            at.append(a)
        else:
            same = False
            parts.append(text[last:a])
            at.extend(range(last, a))
            at.extend([a] * len(out))
        parts.append(out)
        last = b
    parts.append(text[last:])
    form = "".join(parts)
    if same:
        return form, None
    at.extend(range(last, len(text) + 1))
    if "\u200c" in form:
        kept = [i for i in range(len(form)) if not _IDLE.match(form, i)]
        form, at = "".join(form[i] for i in kept), array("i", [*(at[i] for i in kept), len(text)])
    return form, at


@F.pandas_udf(T.StringType())
def _canon_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canon, na_action="ignore")


def consistent_form(text: Column) -> Column:
    """The consistent form of a text column; null stays null.

    Plain ASCII texts never leave the JVM: Python sees only what can change.
    """
    return F.coalesce(_canon_udf(F.when(text.rlike(r"[^\t-\r -~]"), text)), text)


def _key128(c: Column, name: str) -> list[Column]:
    return [F.xxhash64(F.lit(k), c).alias(f"{name}{k}") for k in (1, 2)]


def lookalike_pairs(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """Pairs of rows whose texts differ as stored but share their consistent form.

    Rows with a null text pair with nothing; equal texts are no pair; an empty
    table gives no rows. Texts travel as 128-bit keys only. Classes with one
    stored spelling, however many copies, drop out before rows are paired, so a
    hot text costs one row per copy and not one per pair of copies.
    """
    from ..plans.written import written

    keyed = df.select(F.col(row_id).alias("row"), F.col(text).alias("_t")).filter(F.col("_t").isNotNull())
    keyed = keyed.withColumn("_c", consistent_form(F.col("_t"))).select("row", *_key128(F.col("_c"), "c"), *_key128(F.col("_t"), "t"))
    keyed = written(keyed, "canon-keys")
    spellings = keyed.groupBy("c1", "c2", "t1", "t2").agg(F.count(F.lit(1)).alias("copies"))
    several = spellings.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("c1", "c2")
    members = keyed.join(several, ["c1", "c2"], "left_semi")
    shapes = spellings.join(several, ["c1", "c2"], "left_semi").select("c1", "c2", "t1", "t2")
    other = shapes.select("c1", "c2", F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    links = shapes.join(other, ["c1", "c2"]).filter("t1 < u1 or (t1 = u1 and t2 < u2)").select("t1", "t2", "u1", "u2")
    left = members.select(F.col("row").alias("a"), "t1", "t2")
    right = members.select(F.col("row").alias("b"), F.col("t1").alias("u1"), F.col("t2").alias("u2"))
    pairs = links.join(left, ["t1", "t2"]).join(right, ["u1", "u2"])
    return pairs.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))
