"""Language of texts and of stretches within them (problem 2).

Word-first backoff: a word the model knows is scored by its log frequency in
each language; an unseen word by the longest of its character n-grams that is
known, falling back to shorter ones. A text is then the cheapest path over its
words, where a change of language costs ``SWITCH``. Names, numbers and
addresses say nothing: they are masked in training by the annotated spans, and
an unseen word weighs ``UNSEEN`` of a known one. A stretch whose words are nearly
all unseen is in none of the model's languages and gets ``OTHER``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canon import raised, raised_map
from .sample import bounded_sample

LANGUAGES = ["de", "en", "es", "fr", "it", "nl", "pt", "ru"]
SAMPLE = 12_000  # annotated rows the model is fitted on, at most
SWITCH, UNSEEN, FLOOR = 9.0, 0.1, 6.0
OTHER, OTHER_WORDS, OTHER_SHARE = "und", 5, 0.2  # the code of another language: of so many words, less than this share is known
# Spellings of a language besides its two-letter code.
SPELLINGS = {
    "de": "deu ger german deutsch", "en": "eng english", "es": "spa spanish español espanol castellano", "fr": "fra fre french français francais",
    "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "pt": "por portuguese português portugues", "ru": "rus russian русский",
}
NAMES = {w: k for k, v in SPELLINGS.items() for w in [k, *v.split()]}
_CODE = re.compile(r"[\d@#/_\\]|.[.:].+\..")  # numbers, addresses, host names
_DISGUISED = re.compile(r"[\[({] ?AT ?[\])}] ?\S+(?: ?[\[({] ?DOT ?[\])}] ?\S+)*")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"\S+")
_BOUND = "\x02"


def code_of(label: Column) -> Column:
    """Two-letter code of a label in any spelling; null for none, placeholders and unknown ones."""
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([^_\-]+)", 1)
    pairs = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    return F.try_element_at(pairs, base)


def words_in(text: str) -> list[str]:
    """Words of ``text`` that may tell its language: raised, in consistent form, without codes and addresses."""
    up = raised(text)
    if "AT" in up and ("(" in up or "[" in up or "{" in up):
        up = _DISGUISED.sub(" ", up)
    out = []
    for token in up.split():
        if token.isalpha():
            out.append(token)
        elif not _CODE.search(token):
            out += _WORD.findall(token)
    return out


def places_in(text: str) -> list[int]:
    """Where the words of :func:`words_in` begin in ``text``."""
    up, at = raised_map(text)
    if "AT" in up and ("(" in up or "[" in up or "{" in up):
        up = _DISGUISED.sub(lambda m: " " * len(m[0]), up)
    out = []
    for m in _TOKEN.finditer(up):
        if m[0].isalpha():
            out.append(m.start())
        elif not _CODE.search(m[0]):
            out += [m.start() + x.start() for x in _WORD.finditer(m[0])]
    return out if at is None else [at[i] for i in out]


class Model:
    """Log frequencies by language of words, and of n-grams for the rest."""

    def __init__(self, counts: dict[str, Counter]):
        totals = {k: sum(counts[k].values()) or 1 for k in LANGUAGES}
        vocabulary = Counter()
        for c in counts.values():
            vocabulary.update(c)
        kept = [w for w, n in vocabulary.items() if n >= 3]
        self.words = {w: self._row([counts[k][w] / totals[k] for k in LANGUAGES], 1e-5) for w in kept}
        grams = [Counter() for _ in LANGUAGES]
        for i, k in enumerate(LANGUAGES):
            for w, n in counts[k].items():
                for g in self._grams(w):
                    grams[i][g] += n
        sums = [sum(g.values()) or 1 for g in grams]
        known = Counter(x for g in grams for x in g)
        self.grams = {g: self._row([grams[i][g] / sums[i] for i in range(len(LANGUAGES))], 1e-6) for g in known if sum(x[g] for x in grams) >= 5}
        self.rows = np.array([*self.words.values(), np.zeros(len(LANGUAGES))], np.float32)
        self.number = {w: i for i, w in enumerate(self.words)}
        self.fixed = len(self.rows)

    @staticmethod
    def _row(freq: list[float], least: float) -> np.ndarray:
        """Log frequencies relative to the best language, none below the floor."""
        row = np.log(np.array(freq) + least)
        return np.maximum(row - row.max(), -FLOOR).astype(np.float32)

    @staticmethod
    def _grams(word: str, longest: int = 5) -> Iterator[str]:
        w = _BOUND + word + _BOUND
        for n in range(longest, 1, -1):
            for i in range(len(w) - n + 1):
                yield w[i : i + n]

    def _unseen(self, word: str) -> np.ndarray:
        w, i, rows = _BOUND + word + _BOUND, 0, []
        while i < len(w) - 1:  # the longest known n-gram from here, then on behind it
            for n in range(5, 1, -1):
                if (row := self.grams.get(w[i : i + n])) is not None:
                    rows.append(row)
                    i += n - 1
                    break
            else:
                i += 1
        if not rows:
            return np.zeros(len(LANGUAGES), np.float32)
        mean = np.mean(rows, axis=0) * UNSEEN
        return (mean - mean.max()).astype(np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Rows of the score matrix; unseen words get one when first met."""
        number = self.number
        new = [w for w in dict.fromkeys(words) if w not in number]
        if new:
            if len(number) + len(new) > self.fixed + 200_000:  # bounded memory
                for w in list(number)[self.fixed - 1 :]:
                    del number[w]
                self.rows = self.rows[: self.fixed]
                new = [w for w in dict.fromkeys(words) if w not in number]
            at = len(self.rows)
            for i, w in enumerate(new):
                number[w] = at + i
            self.rows = np.concatenate([self.rows, np.array([self._unseen(w) for w in new], np.float32)])
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def row(self, word: str) -> np.ndarray:
        (i,) = self._numbers([word])
        return self.rows[i]

    def stretches(self, text: str) -> list[tuple[str, float, int]]:
        """``(language, confidence, words)`` of each stretch in one language; none where no word tells."""
        return self.stretches_of([text])[0]

    def stretches_of(self, texts: list[str]) -> list[list[tuple[str, float, int]]]:
        """The stretches of several texts."""
        words, ends = [], [0]
        for t in texts:
            words += words_in(t) if t else []
            ends.append(len(words))
        if not words:
            return [[] for _ in texts]
        numbers = self._numbers(words)  # may add rows
        scores = self.rows[numbers]
        seen = np.concatenate([[0], np.cumsum(numbers < self.fixed - 1)])
        run = np.concatenate([np.zeros((1, len(LANGUAGES))), np.cumsum(scores, axis=0, dtype=np.float64)])
        at = np.array(ends)
        totals = run[at[1:]] - run[at[:-1]]
        best, top = totals.argmax(axis=1), totals.max(axis=1)
        tells = (totals != 0).any(axis=1)
        sure = np.exp(np.clip(totals - top[:, None], -50, 0))
        sure = sure.max(axis=1) / sure.sum(axis=1)
        out = []
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            if a == b or not tells[i]:
                out.append([])
            elif -top[i] < SWITCH or _stays(run[a : b + 1], best[i]):  # no change can gain what it costs: every word's best is 0
                out.append([self._named(LANGUAGES[best[i]], float(sure[i]), b - a, seen[b] - seen[a])])
            else:
                path = _path(scores[a:b])
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
                out.append([self._named(LANGUAGES[path[x]], _confidence(scores[a + x : a + y].sum(axis=0, dtype=np.float64)), y - x, seen[a + y] - seen[a + x]) for x, y in zip(cuts, cuts[1:])])
        return out

    @staticmethod
    def _named(language: str, confidence: float, words: int, seen: int) -> tuple[str, float, int]:
        """The stretch, or one in another language, which is as sure as its words are unseen."""
        if words >= OTHER_WORDS and seen < OTHER_SHARE * words:
            return OTHER, 1 - int(seen) / words, words
        return language, confidence, words


def _stays(run: np.ndarray, base: int) -> bool:
    """Whether no path gains over staying in language ``base``, from running sums of scores.

    A path of m stretches pays m - 1 changes. Its first stretch gains at most what
    a prefix does, its last what a suffix does, and each between them what any
    stretch does; a stretch in ``base`` gains nothing.
    """
    ahead = run - run[:, base : base + 1]
    between = (ahead - np.minimum.accumulate(ahead, axis=0)).max()
    return bool(between <= SWITCH and ahead.max() + (ahead[-1] - ahead.min(axis=0)).max() < SWITCH)


def _confidence(total: np.ndarray) -> float:
    p = np.exp(np.clip(total - total.max(), -50, 0))
    return float(p.max() / p.sum())


def _path(scores: np.ndarray) -> np.ndarray:
    """The languages of the words on the best path."""
    n, k = scores.shape
    back = np.zeros((n, k), np.int8)
    at = scores[0].astype(np.float64)
    stay = np.arange(k)
    for i in range(1, n):
        j = int(at.argmax())
        change = at[j] - SWITCH > at
        back[i] = np.where(change, j, stay)
        at = np.where(change, at[j] - SWITCH, at) + scores[i]
    path = np.empty(n, np.int64)
    path[-1] = int(at.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _masked(text: str, spans) -> str:
    for s in spans if spans is not None else ():
        a, b = s["start"], s["end"]
        if a is not None and b is not None and 0 <= a < b <= len(text):
            text = text[:a] + " " * (b - a) + text[b:]
    return text


def fit(df: DataFrame, text: str = "text", language: str = "language", spans: str = "spans", key: str = "row_id", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` annotated rows with a usable label, picked by a hash of their key.

    Labels may be wrong and texts mixed, so the model is fitted twice: the second
    time each stretch counts for the language the first model gives it.
    """
    rows = df.select(F.col(text).alias("t"), F.col(spans).alias("s"), code_of(F.col(language)).alias("k"), F.col(key).alias("id"))
    rows = rows.filter("t is not null and s is not null and k is not null")
    picked = bounded_sample(rows, "id", sample).select("t", "s", "k").toPandas()
    texts = [(_masked(t, s), k) for t, s, k in zip(picked.t, picked.s, picked.k)]
    counts: dict[str, Counter] = defaultdict(Counter)
    for t, k in texts:
        counts[k].update(words_in(t))
    first = Model(counts)
    again: dict[str, Counter] = defaultdict(Counter)
    for t, _ in texts:
        words, at = words_in(t), 0
        for k, _, n in first.stretches(t):
            if k != OTHER:
                again[k].update(words[at : at + n])
            at += n
    return Model(again) if again else first


STRETCH = "seg_no int, language string, confidence double, words int, start int, end int"


def _bounds(text: str | None, stretches: list[tuple[str, float, int]]) -> list[tuple[int, int]]:
    """Where stretches lie in ``text``: each but the first begins with its first word, the last ends with the text."""
    if len(stretches) < 2:
        return [(0, len(text or ""))] * len(stretches)
    places, at, cuts = places_in(text), 0, [0]
    for _, _, n in stretches[:-1]:
        at += n
        cuts.append(places[at])
    return list(zip(cuts, [*cuts[1:], len(text)]))


def languages(df: DataFrame, model: Model, row_id: str = "row_id", text: str = "text", label: str | None = "language", places: bool = True) -> DataFrame:
    """``row_id, code, segments``: the label's code and the stretches of each text in order.

    A stretch has its language, a confidence, its number of words and its place
    in code points, null unless ``places``; stretches cover the text. Null, empty and wordless texts have
    no segment. Work is per row.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("seg_no", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [x for k in range(0, len(texts), 1000) for x in m.stretches_of(texts[k : k + 1000])]
            segs = [[{"seg_no": i, "language": k, "confidence": c, "words": n, "start": x, "end": y} for i, ((k, c, n), (x, y)) in enumerate(zip(s, _bounds(t, s) if places else [(None, None)] * len(s)), 1)] for t, s in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(segs, kind)], ["row_id", "code", "segments"])

    src = df.select(F.col(row_id).cast("long").alias("row_id"), (code_of(F.col(label)) if label else F.lit(None).cast("string")).alias("code"), F.col(text).cast("string").alias("_t"))
    return src.mapInArrow(run, f"row_id long, code string, segments array<struct<{STRETCH.replace(' ', ':').replace(',:', ',')}>>")


def language_cases(df: DataFrame, model: Model | None = None) -> DataFrame:
    """``row_id, seg_no, language`` of rows whose label is missing, a placeholder or not the text's language, and of mixed rows."""
    found = languages(df, model or fit(df), places=False)
    wrong = F.col("code").isNull() | (F.size("segments") > 1) | (F.col("segments")[0]["language"] != F.col("code"))
    rows = found.filter("size(segments) > 0").filter(wrong).select("row_id", F.explode("segments").alias("s"))
    return rows.select("row_id", F.col("s.seg_no").alias("seg_no").cast("long"), F.col("s.language").alias("language"))
