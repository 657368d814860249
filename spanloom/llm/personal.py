"""Personal information in free text (problem 6).

Texts are deobfuscated without losing their place, by three transducers one after
the other: the consistent form undoes look-alike letters, widths and invisible
characters; a fold of equal length undoes case, accents and dash shapes; the last
writes spoken digits as digits and at/dot disguises as @ and dot. Each keeps where
its output comes from. Detectors run on the plain text, and spans are mapped back
through both maps to the code points of the source.

Names follow a lexicon of given names and of ordinary words fitted on a bounded
sample of annotated rows; the other types follow written rules.
"""

from __future__ import annotations

import re
import unicodedata as ud
from array import array
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canon import LOOKALIKES, TABLE, _invisible, canon_map
from .sample import bounded_sample

SAMPLE = 12_000  # annotated rows the lexicon is fitted on, at most
TYPES = ["ADDRESS", "EMAIL", "ID_NUMBER", "PERSON", "PHONE"]


class _Fold(dict):
    """Character to its capital without accent, always one for one."""

    def __missing__(self, cp: int) -> str:
        ch = chr(cp)
        if ud.category(ch) == "Pd" or ch == "−":
            out = "-"
        elif ch in "’‘ʼ´`":
            out = "'"
        else:
            up = ch.upper()
            base = ud.normalize("NFD", up if len(up) == 1 else ch)[0]
            out = LOOKALIKES.get(base, TABLE.get(base, base))
            out = out if len(out) == 1 else ch
        self[cp] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """``text`` in capitals without accents, character for character."""
    return text.translate(_FOLD)


def _any(words: str) -> str:
    """Alternatives of blank-separated words, folded, the longest first; ~ is a blank and ! a literal dot."""
    out = sorted({fold(w) for w in words.split()}, key=lambda w: (-len(w), w))
    return "(?:" + "|".join(re.escape(w).replace("\\~", "~").replace("~", r"[ \t]+").replace("!", r"\.") for w in out) + ")"


_L = r"[^\W\d_]"  # a letter
_NAME = rf"{_L}+(?:['-]{_L}+)*"
_AT = r"(?:@|[ \t]?[\[({<][ \t]?(?:AT|@|ARROBA|CHIOCCIOLA|ARROBASE)[ \t]?[\])}>][ \t]?)"
_DOT = r"(?:\.|[ \t]?[\[({<][ \t]?(?:DOT|PUNKT|PUNTO|POINT|PONTO|PUNT|\.)[ \t]?[\])}>][ \t]?)"
_USER = r"[A-Z0-9](?:[A-Z0-9._%+\-]*[A-Z0-9_])?"
_HOST = r"[A-Z0-9](?:[A-Z0-9\-]*[A-Z0-9])?"
EMAIL = re.compile(rf"(?<![A-Z0-9._%+\-@]){_USER}@{_HOST}(?:\.{_HOST})*\.[A-Z]{{2,}}(?![A-Z0-9@])")
# Digits as words, each with its digit.
DIGITS = {
    "0": "zero oh null cero nul ноль", "1": "one eins un uno um een один", "2": "two zwei deux dos due dois twee два", "3": "three drei trois tres tre três три",
    "4": "four vier quatre cuatro quattro quatro четыре", "5": "five fünf cinq cinco cinque vijf пять", "6": "six sechs seis sei zes шесть", "7": "seven sieben sept siete sette sete zeven семь",
    "8": "eight acht huit ocho otto oito восемь", "9": "nine neun neuf nueve nove negen девять", "+": "plus",
}
_DIGIT = {fold(w): d for d, words in DIGITS.items() for w in words.split()}
_SPOKEN = _any(" ".join(_DIGIT))
_RUN = rf"(?<!\w)(?:{_SPOKEN}|\+?\d\d?)(?:[ \t,-]+(?:{_SPOKEN}|\d\d?))+(?!\w)"
_ITEM = re.compile(r"[^\W\d_]+|\+?\d+")
# What the last transducer rewrites: a spoken run, a spelled address, and at and dot in brackets.
_HIDDEN = re.compile(
    rf"(?P<run>{_RUN})|(?<![A-Z0-9._%+\-@])(?P<bare>{_USER}[ \t]AT[ \t]{_HOST}(?:[ \t]DOT[ \t]{_HOST})*[ \t]DOT[ \t][A-Z]{{2,}})(?![A-Z0-9@])"
    rf"|(?<=\w)(?P<at>{_AT})(?=[A-Z0-9])|(?<=\w)(?P<dot>{_DOT})(?=[A-Z0-9])"
)
_BARE_PART = re.compile(r"[ \t](AT|DOT)[ \t]")
_HINT = re.compile(rf"[\[({{<][ \t]?(?:AT|@|ARROBA|CHIOCCIOLA|ARROBASE|DOT|PUNKT|PUNTO|POINT|PONTO|PUNT|\.)[ \t]?[\])}}>]|[ \t]DOT[ \t]|(?<!\w){_SPOKEN}[ \t,-]+(?:{_SPOKEN}|\d\d?)(?!\w)")
SPOKEN_LEAST, SHORTEST, LONGEST = 3, 7, 15  # words that make a run spoken; digits of a phone number


def plain(low: str) -> tuple[str, array | None, list[tuple[int, int]]]:
    """``low`` without spoken digits and at/dot disguises, where each character comes from, and the spoken numbers.

    The map has one entry more than the text and is None where nothing was
    rewritten. A run is rewritten if ``SPOKEN_LEAST`` of its digits are words.
    """
    if not _HINT.search(low):
        return low, None, []
    parts: list[str] = []
    at, spoken, last, size = array("i"), [], 0, 0

    def put(out: str, a: int, b: int) -> None:
        """Rewrites ``low[a:b]`` as ``out``; what lies before it is kept."""
        nonlocal last, size
        parts.extend((low[last:a], out))
        at.extend(range(last, a))
        at.extend([a] * len(out))
        size += a - last + len(out)
        last = b

    for m in _HIDDEN.finditer(low):
        if m["run"]:
            items = _ITEM.findall(m["run"])
            digits = "".join(_DIGIT.get(x, x) for x in items)
            if sum(x in _DIGIT for x in items) < SPOKEN_LEAST or not digits[1:].isdigit():
                continue
            put(digits, *m.span())
            if SHORTEST <= len(digits.lstrip("+")) <= LONGEST:
                spoken.append((size - len(digits), size))
        elif m["bare"]:
            for x in _BARE_PART.finditer(low, *m.span("bare")):
                put("@" if x[1] == "AT" else ".", *x.span())
        elif m[0] not in "@.":
            put("@" if m["at"] else ".", *m.span())
    if not last:
        return low, None, []
    parts.append(low[last:])
    at.extend(range(last, len(low) + 1))
    return "".join(parts), at, spoken


PHONE = re.compile(
    r"(?<![\w+])(?<![\d)][./ -])(?:"
    r"\+\d{1,3}[ -]?(?:\(0\)[ ]?)?\d{1,4}(?:[ -]\d{2,4}){1,4}|\+\d{1,3}[ -]?\(\d{2,4}\)[ -]?\d{3}[ -]?\d{3,4}"
    r"|\+\d{10,14}|00\d{1,3} \d{2,3} \d{6,7}|00\d{10,13}"
    r"|\d{3}\.\d{3}\.\d{4}|\(0?\d{2,4}\) ?\d{3}[ -]\d{3,4}|0\d{2,3}/\d{6,8}|0\d{3} \d\d \d\d \d\d \d\d"
    r")(?![\w])(?![./-]\d)"
)
IDS = (
    r"\d{2}/\d{3}/\d{5}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|\d \d\d \d\d \d\d \d{3} \d{3}|\d{3}[ -]\d{2}[ -]\d{4}|\d{2} \d{6} [A-Z] \d{3}|\d{8}[A-Z]\d{3}"
    r"|[A-Z]{2,3}-\d{6}-[A-Z]|[A-Z]{2,3} \d{6}|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{5}\d{6}[A-Z]{2}|\d{2} \d{2} \d{6}|\d{3} \d{3} \d{3}|\d{13}|[A-Z]{2}\d{7}|[A-Z]\d{8}|\d{8}[A-Z]"
    r"|(?=[A-Z0-9-]*\d{2})[A-Z0-9](?:[A-Z0-9-]{4,18})[A-Z0-9]"
)
# The words that name an official number.
KINDS = (
    "passport ssn social~security tax~number tax~id taxpayer~id taxpayer~number driving~licence driver's~license driving~license driver~license identity~card national~id id~card "
    "steuernummer steuer-id sozialversicherungsnummer personalausweis reisepass pass-nr pass führerschein ausweis "
    "numéro~fiscal numéro~de~sécurité~sociale sécurité~sociale carte~d'identité passeport permis permis~de~conduire "
    "número~fiscal número~de~la~seguridad~social seguridad~social documento~de~identidad pasaporte carné~de~conducir dni "
    "codice~fiscale numero~previdenziale carta~d'identità passaporto patente segurança~social número~da~segurança~social cartão~de~cidadão passaporte carta~de~condução "
    "fiscaal~nummer burgernummer identiteitskaart paspoort rijbewijs налоговый~номер страховой~номер паспорт удостоверение водительские~права"
)
# Words that may stand between that word and the number.
LINKS = "is was are reads ist lautet war est était es era è e é foi luidt это"
ID_NAMED = re.compile(rf"(?<!\w){_any(KINDS)}(?:[ \t]*(?:NO|NR|NUMBER|NUM|ID)(?!\w))?(?:[ \t]*:?[ \t]+{_any(LINKS)}(?!\w)){{0,2}}[ \t.:!?;,…#№=]*(?<!\w)(?P<id>{IDS})(?![\w])(?![-/]\d)")
ID_SHAPED = re.compile(
    r"(?<![\w/-])(?:\d{2}/\d{3}/\d{5}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[12] \d\d \d\d \d\d \d{3} \d{3}|(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<dni>[XYZ\d]\d{7}[A-Z])|\d{2} \d{6} [A-Z] \d{3}"
    r"|[A-Z]{2}-\d{6}-[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]{5}\d{6}[A-Z]{2})(?![\w/-])"
)
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"  # Fixed value: the check letter of a Spanish number, by its rest


def checked(m: re.Match[str]) -> bool:
    """Whether a number without a word that names it keeps the rules of its kind: no empty group, the right check letter."""
    if x := m["ssn"]:
        return x[:3] not in ("000", "666") and x[4:6] != "00" and x[7:] != "0000"
    if x := m["dni"]:
        return DNI_LETTERS[int(x[:-1].translate({88: "0", 89: "1", 90: "2"})) % 23] == x[-1]
    return True


_NO = r"\d{1,4}[A-Z]?(?!\w)"
# Words that name a kind of street, by where the name stands.
ADDRESS = re.compile(
    "|".join([
        rf"(?<![\w.,/-]){_NO} (?:{_NAME} )?{_NAME} (?:{_any('street road avenue close lane drive court square terrace boulevard way')}(?!\w)|(?:ST|RD|AVE|LN|DR)\b\.?)",
        rf"(?<![\w.,/-]){_NO},? {_any('rue avenue impasse bd boulevard place chemin allée quai route cours')}(?:!|\.)?(?: (?:DE LA|DE|DU|DES|D'))? ?{_NAME}",
        rf"(?<!\w)(?:{_any('calle avenida plaza paseo camino ronda c/ avda! avda travesía')}|{_any('via viale corso piazza largo vicolo piazzale')}|{_any('rua travessa praça largo avenida alameda estrada r! av!')})\.? (?:(?:DE LA|DE|DEL|DA|DO|DI) )?{_NAME},? {_NO}",
        rf"(?<!\w){_any('ул! улица проспект пр-т пр! пер! переулок бульвар шоссе наб! набережная площадь пл!')} ?{_NAME},? (?:Д\. ?)?{_NO}",
        rf"(?<!\w){_L}{{3,}}(?:STRA(?:ß|SS)E|STR\.|GASSE|WEG|PLATZ|ALLEE|STRAAT|LAAN|KADE|PLEIN|GRACHT|DREEF|SINGEL|ALLEE|UFER|RING|DAMM)(?: |, ){_NO}",
        rf"(?<!\w)(?:{_NAME}[ -])?(?:STRA(?:ß|SS)E|STR\.|GASSE|WEG|PLATZ) {_NO}",
        rf"(?<!\w)(?:AM|AN DER|AUF DER|IM|ZUM|ZUR) {_NAME} {_NO}",
    ])
)
_TOKEN = re.compile(rf"{_NAME}")
_INITIALS = rf"(?: {_L}\.){{0,2}}"
_GIVEN_FIRST = re.compile(rf"(?<![\w@.+_-])(?P<g>{_NAME})(?P<i>{_INITIALS}) (?P<s>{_NAME})(?![\w@_]|\.\w)")
_INITIAL_FIRST = re.compile(rf"(?<![\w@.+_'-])(?P<i>{_L}\.(?: ?{_L}\.)?) (?P<s>{_NAME})(?![\w@_]|\.\w)")
_GIVEN_LAST = re.compile(rf"(?<![\w@.+_-])(?P<s>{_NAME}), (?P<g>{_NAME})(?![\w@_]|\.\w)(?P<i>{_INITIALS})")


class Lexicon:
    """Given names, ordinary words, and words that come before names."""

    def __init__(self, given: set[str], common: set[str], before: set[tuple[str, str]]):
        self.given, self.common, self.before = given, common, before

    def _surname(self, word: str) -> bool:
        return len(word) > 2 and any(len(p) > 3 and p not in self.common and p not in self.given for p in word.split("-")) and word not in self.common

    def persons(self, low: str, form: str) -> Iterator[tuple[int, int]]:
        """Mentions in folded text ``low`` whose letters as written are ``form``."""
        at, led = 0, set()
        while m := _GIVEN_FIRST.search(low, at):
            if m["g"] in self.given and self._surname(m["s"]) and form[m.start()].isupper() == form[m.start("s")].isupper():
                led.add(m.start())
                yield m.start(), m.end()
                at = m.end()
            else:
                at = m.end("g")
        at = 0
        while m := _GIVEN_LAST.search(low, at):
            if m["g"] in self.given and self._surname(m["s"]) and m.start("g") not in led:
                yield m.start(), m.end("g")
                at = m.end("g")
            else:
                at = m.end("s")
        at = 0
        while m := _INITIAL_FIRST.search(low, at):
            if self._surname(m["s"]) and (form[m.start()].isupper() or form[m.start("s")].islower()):
                yield m.start(), m.end()
                at = m.end()
            else:
                at = m.start() + 1
        for m in _GIVEN_FIRST.finditer(low):  # a misspelt given name after words that announce a name
            g, s = m["g"], m["s"]
            if g not in self.given and g not in self.common and self._surname(s) and form[m.start()].isupper() and form[m.start("s")].isupper():
                words = _TOKEN.findall(low[max(0, m.start() - 40) : m.start()])
                if len(words) > 1 and tuple(words[-2:]) in self.before and low[m.start() - 1] in " \t":
                    yield m.start(), m.end()


def find(text: str, lex: Lexicon) -> list[tuple[int, int, str]]:
    """Typed spans of ``text`` in code points, sorted and without overlaps."""
    form, at = canon_map(text)
    low = fold(form)
    if "\n" in low or "\r" in low:
        low = low.replace("\n", "\x1f").replace("\r", "\x1f")  # nothing runs over a line break
    bare, back, spoken = plain(low)
    shown = form if back is None else "".join(form[i] for i in back[:-1])  # the letters as written
    hits: list[tuple[int, int, int, str]] = []
    hits += [(0, *m.span(), "EMAIL") for m in EMAIL.finditer(bare)]
    hits += [(1, *m.span("id"), "ID_NUMBER") for m in ID_NAMED.finditer(bare) if sum(c.isdigit() for c in m["id"]) > 5]
    hits += [(2, *m.span(), "ID_NUMBER") for m in ID_SHAPED.finditer(bare) if checked(m)]
    hits += [(3, *m.span(), "ADDRESS") for m in ADDRESS.finditer(bare)]
    hits += [(4, *m.span(), "PHONE") for m in PHONE.finditer(bare)]
    hits += [(4, a, b, "PHONE") for a, b in spoken]
    hits += [(5, a, b, "PERSON") for a, b in lex.persons(bare, shown)]
    hits.sort(key=lambda h: (h[0], h[1], -h[2]))
    taken: list[tuple[int, int, str]] = []  # sorted and apart, so only the neighbours of a hit can overlap it
    for _, a, b, kind in hits:
        i = bisect(taken, (a, b, kind))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b, kind))
    if back is not None:
        taken = [(back[a], _source_end(low, back, b), kind) for a, b, kind in taken]
    return taken if at is None else [(at[a], _end(text, at, b), kind) for a, b, kind in taken]


def _source_end(low: str, back: array, b: int) -> int:
    """Where the source of the character before ``b`` ends, blanks at the end of a rewritten stretch left out."""
    start = back[b - 1]
    while back[b] == start:
        b += 1
    end = back[b]
    while end > start + 1 and low[end - 1] in " \t":
        end -= 1
    return end


def _end(text: str, at, b: int) -> int:
    """Where the source of the character before ``b`` ends, invisible ones after it left out."""
    end, low = at[b], at[b - 1] + 1
    while end > low and _invisible(text[end - 1]):
        end -= 1
    return end


def fit_lexicon(df: DataFrame, text: str = "text", spans: str = "spans", key: str = "row_id", sample: int = SAMPLE) -> Lexicon:
    """Lexicon from at most ``sample`` annotated rows, picked by a hash of their key."""
    rows = df.select(F.col(text).alias("t"), F.col(spans).alias("s"), F.col(key).alias("id")).filter("t is not null and s is not null")
    picked = bounded_sample(rows, "id", sample).select("t", "s").toPandas()
    return lexicon_of(zip(picked.t, picked.s))


def lexicon_of(rows) -> Lexicon:
    given, common, before, shown = Counter(), Counter(), Counter(), Counter()
    for text, spans in rows:
        outside = list(text)
        for s in spans:
            a, b = s["start"], s["end"]
            if a is None or b is None or not 0 <= a < b <= len(text):
                continue
            outside[a:b] = "\x1f" * (b - a)
            if s["entity_type"] == "PERSON":
                name = fold(canon_map(text[a:b])[0])
                if m := re.fullmatch(rf"({_NAME})(?: {_L}\.)* ({_NAME})", name):
                    given[m[1]] += 1
                elif m := re.fullmatch(rf"({_NAME}), ({_NAME})", name):
                    given[m[2]] += 1
                words = _TOKEN.findall(fold(canon_map(text[max(0, a - 60) : a])[0]))
                before.update([tuple(words[-2:])])
        rest = fold(canon_map("".join(outside))[0])
        common.update(_TOKEN.findall(rest))
        words = _TOKEN.findall(fold(canon_map(text)[0]))
        shown.update(zip(words, words[1:]))
    least = max(3, len(given) // 2000)
    names = {w for w, n in given.items() if n >= max(4, least) and 3 * n > common[w]}
    words = {w for w, n in common.items() if n >= 3 and w not in names}
    pairs = {p for p, n in before.items() if len(p) == 2 and n >= 5 and 2 * n > shown[p] and all(w in words for w in p)}
    return Lexicon(names, words, pairs)


SPANS = "array<struct<start:int,end:int,entity_type:string>>"


def detect(df: DataFrame, lexicon: Lexicon, keys: list[str], text: str = "text") -> DataFrame:
    """``keys..., text, found``: the typed spans of each text, sorted, without overlaps.

    Null texts have null, empty ones an empty list. Work is per row.
    """
    shared = df.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample it was fitted on
    src = df.select(*keys, F.col(text).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for b in batches:
            found = [None if t is None else [{"start": x, "end": y, "entity_type": k} for x, y, k in find(t, lex)] for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*keys, "text", "found"])

    types = dict(src.dtypes)
    return src.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in [*keys, "text"]) + f", found {SPANS}")


def replaced(text: str, found: list[tuple[int, int, str]]) -> str:
    """``text`` with each span as a placeholder of its type, numbered by its order within the type."""
    out, last, n = [], 0, Counter()
    for a, b, kind in found:
        n[kind] += 1
        out += [text[last:a], f"[{kind}_{n[kind]}]"]
        last = b
    return "".join([*out, text[last:]])


def scrubbed(df: DataFrame, lexicon: Lexicon, keys: list[str], text: str = "text") -> DataFrame:
    """``keys..., found, scrubbed``: spans, and the text with typed placeholders and nothing else changed."""
    found = detect(df, lexicon, keys, text)

    @F.pandas_udf("string")
    def swap(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else replaced(t, [(s["start"], s["end"], s["entity_type"]) for s in x]) for t, x in zip(texts, spans)], dtype=object)

    return found.select(*keys, "found", swap("text", "found").alias("scrubbed"))
