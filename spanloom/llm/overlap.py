"""Same or nearly same texts across splits (problem 7).

Texts are compared as sequences of words, in consistent form and without case
and punctuation. Two texts are nearly the same when the longest common
subsequence of their words has at least ``SHARE`` of the longer one's words.

The distinct evaluation texts are dealt out to shards of texts of like length
with at most ``SHARD_WORDS`` words each. A shard is one Aho-Corasick automaton
over passages of its texts: runs of words of which every admissible partner holds
at least one unchanged, see :func:`passages`. Every training text whose length
allows a partner in a shard is scanned by its automaton, in a narrow stage; the
matched intervals give the coverage of each evaluation text that was hit, and
those are compared exactly. Only links leave the stage. Which passages are rare
is judged within a shard, so nothing is counted over the corpus and no list of
texts by passage is longer than a shard.

The cost is the training text times the number of shards whose lengths suit it:
linear in the corpus for a given evaluation set, and the product of both where
both grow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import hot_from
from ..plans.written import part_rows, written, written_at
from .canon import raised

NUM, DEN = 5, 6  # SHARE
SHARD_WORDS = 1_000_000  # words of evaluation texts in one automaton, which then takes some 100 MB
STEPS = 20  # levels of length: each is a factor of exp(1 / STEPS)
SCANS = 64  # shards scanned by one job
_MARKS = re.compile(r"[^\w\s]|_")


def words_of(text: str) -> str:
    """Words of ``text`` joined by blanks: consistent form, capitals, punctuation removed."""
    return " ".join(_MARKS.sub("", raised(text)).split())


def needed(n: int) -> int:
    """Words that must be shared with a longer text of ``n`` words."""
    return -(-NUM * n // DEN)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of it held in the bits of one integer."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := at.get(w):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=100_000)
def damage(n: int) -> tuple[int, int]:
    """For any partner of a text of ``n`` words: words it may lack, and these and words it may put between at most."""
    lacking = both = 0
    for m in range(needed(n), DEN * n // NUM + 1):
        shared = needed(max(n, m))
        if shared <= min(n, m):
            lacking, both = max(lacking, n - shared), max(both, n + m - 2 * shared)
    return lacking, both


def runs(n: int) -> list[tuple[int, int]]:
    """A text of ``n`` words cut into runs, one more than changes can spoil."""
    k = min(n, damage(n)[1] + 1)
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def passages(words: list[str], held: Counter, cut: Counter) -> list[tuple[int, int]]:
    """Intervals of words, apart, of which every partner of the text holds at least one.

    A changed or missing word spoils the one passage it lies in, a word put
    between spoils one passage of several words and none of one word. So either
    the rarest words do, one more than a partner may lack, or the runs of the
    whole text; of the two the one that other texts of the shard share less.
    ``held`` counts texts by word, ``cut`` texts by run.
    """
    order = sorted(range(len(words)), key=lambda i: (held[words[i]], words[i], i))[: damage(len(words))[0] + 1]
    whole = runs(len(words))
    if sum(cut[" ".join(words[a:b])] for a, b in whole) <= sum(held[words[i]] for i in order):
        return whole
    return [(i, i + 1) for i in order]


def chosen(texts: list[str]) -> list[list[tuple[int, int]]]:
    """The passages of each of a shard's texts."""
    words = [t.split(" ") for t in texts]
    held, cut = Counter(), Counter()
    for w in words:
        held.update(set(w))
        cut.update({" ".join(w[a:b]) for a, b in runs(len(w))})
    return [passages(w, held, cut) for w in words]


class Shard:
    """The automaton over the passages of some evaluation texts, given as joined words."""

    def __init__(self, texts: list[str], spots: list[list[tuple[int, int]]] | None = None):
        import ahocorasick

        self.texts, self.sizes = texts, [t.count(" ") + 1 for t in texts]
        where: dict[str, list[tuple[int, int]]] = {}
        for i, (t, at) in enumerate(zip(texts, chosen(texts) if spots is None else spots)):
            w = t.split(" ")
            for a, b in at:
                where.setdefault(f" {' '.join(w[a:b])} ", []).append((i, b - a))
        self.where = list(where.values())
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(where):
            self.auto.add_word(p, k)
        if where:
            self.auto.make_automaton()

    def covered(self, text: str) -> dict[int, int]:
        """Words of each evaluation text that lie in its matched passages; the passages of a text are apart."""
        out: dict[int, int] = {}
        for k in {k for _, k in self.auto.iter(f" {text} ")} if self.where else ():
            for i, n in self.where[k]:
                out[i] = out.get(i, 0) + n
        return out

    def links(self, text: str) -> list[tuple[int, int]]:
        """Evaluation texts nearly the same as ``text``, with the words they share in order."""
        n = text.count(" ") + 1
        out, words = [], None
        for i in self.covered(text):
            m = self.sizes[i]
            if DEN * min(m, n) >= NUM * max(m, n):
                words = words or text.split(" ")
                if (shared := common_words(self.texts[i].split(" "), words)) >= needed(max(m, n)):
                    out.append((i, shared))
        return out


@lru_cache(maxsize=2)
def _shard(path: str, shard: int) -> tuple[Shard, list[int], list[int]]:
    """A shard and the keys of its texts, built once per worker and kept for the tasks that follow."""
    t = part_rows(path, "shard", shard, ["norm", "spots", "c1", "c2"])
    spots = [list(zip(x[::2], x[1::2])) for x in t.column("spots").to_pylist()]
    return Shard(t.column("norm").to_pylist(), spots), t.column("c1").to_pylist(), t.column("c2").to_pylist()


def _spotted(shard: pa.Table) -> pa.Table:
    """A shard's texts with their passages, chosen here once for all tasks."""
    spots = [[x for ab in at for x in ab] for at in chosen(shard.column("norm").to_pylist())]
    return shard.append_column("spots", pa.array(spots, pa.list_(pa.int32())))


def _scan(path: str, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, c1, c2 = _shard(path, shard)
            seen: dict[str, list[tuple[int, int]]] = {}
            at, hits = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if (found := seen.get(t)) is None:
                    found = seen[t] = s.links(t)
                if found:
                    at += [k] * len(found)
                    hits += found
            cols = [[c1[i] for i, _ in hits], [c2[i] for i, _ in hits], [n for _, n in hits], [s.sizes[i] for i, _ in hits]]
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types))], ["b", "e1", "e2", "shared", "words"])

    return run


def _plan(levels: list[tuple[int, int, int, int]], most: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int, int]]]:
    """Shards from ``(level, least, greatest number of words in a text, words in all)``.

    The first value gives each level its first shard and its number of shards,
    the second lists ``(shard, least, greatest)``. Small neighbouring levels
    share a shard; a level of more words has several.
    """
    of: dict[int, tuple[int, int]] = {}
    shards: list[tuple[int, int, int]] = []
    room = 0
    for level, low, high, words in sorted(levels):
        if words <= room:
            k, least, _ = shards[-1]
            shards[-1] = (k, least, high)
            of[level] = (k, 1)
            room -= words
        else:
            n = -(-words // most)
            of[level] = (len(shards), n)
            shards += [(len(shards) + i, low, high) for i in range(n)]
            room = most - words if n == 1 else 0
    return of, shards


def near_rows(df: DataFrame, row_id: str, text: str, split: str, train: tuple[str, ...] = ("train",), most: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by the class of their words, evaluation classes, and links of training rows to those.

    ``rows`` is ``row, ev, c1, c2``; ``classes`` is ``c1, c2, copies``; ``links``
    is ``b, e1, e2, shared, words``: training row, class, words shared in order,
    words of the class. Classes are distinct texts, told apart by 128-bit keys.
    """
    spark = df.sparkSession
    src = df.select(F.col(row_id).alias("row"), F.col(split).alias("_s"), F.col(text).cast("string").alias("_t")).filter("_t is not null and _s is not null")

    def norm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [words_of(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([t.count(" ") + 1 for t in texts], pa.int32())], ["row", "ev", "norm", "n"])

    kind = dict(src.dtypes)["row"]
    normed = src.select("row", (~F.col("_s").isin(*train)).alias("ev"), "_t").mapInArrow(norm, f"row {kind}, ev boolean, norm string, n int").filter("norm <> ''")
    rows = written(normed.withColumns({f"c{k}": F.xxhash64(F.lit(k), "norm") for k in (1, 2)}), "overlap-rows")
    level = F.floor(F.log("n") * STEPS).cast("int")
    ev = rows.filter("ev").groupBy("c1", "c2").agg(F.min("norm").alias("norm"), F.count(F.lit(1)).alias("copies")).withColumn("n", F.size(F.split("norm", " ")))
    ev = written(ev.withColumn("level", level), "overlap-classes")
    sizes = ev.groupBy("level").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("words")).collect()  # as many rows as levels of length
    of, shards = _plan([tuple(r) for r in sizes], most)
    links = spark.createDataFrame([], f"b {kind}, e1 long, e2 long, shared int, words int")
    if shards:
        first, count = (F.create_map(*(F.lit(x) for k, v in of.items() for x in (k, v[j]))) for j in (0, 1))
        dealt = ev.withColumn("shard", first[F.col("level")] + F.pmod("c2", count[F.col("level")]).cast("int")).select("shard", "c1", "c2", "norm")
        spotted = dealt.groupBy("shard").applyInArrow(_spotted, "shard int, c1 long, c2 long, norm string, spots array<int>")  # at most SHARD_WORDS words a group
        path = written_at(spotted, "overlap-shards", "shard")
        held = {r.shard for r in spark.read.parquet(path).select("shard").distinct().collect()}  # a shard dealt by hash may have got nothing
        shards = [x for x in shards if x[0] in held]
        train_rows = rows.filter("not ev")
        done = []
        for k in range(0, len(shards), SCANS):
            scans = [train_rows.filter(F.col("n").between(needed(low), DEN * high // NUM)).select("row", "norm").mapInArrow(_scan(path, s), links.schema) for s, low, high in shards[k : k + SCANS]]
            some = scans[0]
            for x in scans[1:]:
                some = some.unionAll(x)
            done.append(written(some, "overlap-links"))
        links = done[0]
        for x in done[1:]:
            links = links.unionAll(x)
    return rows.select("row", "ev", "c1", "c2"), ev.select("c1", "c2", "copies"), links


def cross_split_pairs(df: DataFrame, row_id: str = "row_id", text: str = "text", split: str = "split", train: tuple[str, ...] = ("train",), most: int = SHARD_WORDS) -> DataFrame:
    """``row_a, row_b`` with row_a < row_b: every pair of a training and another row with same or nearly same text.

    Rows with a null text or split, or without words, pair with nothing; two
    evaluation rows are no pair; an empty table gives no rows. Evaluation texts
    are compared once however many copies they have. Where a class of copies is
    hot, its rows are dealt out to as many parts as it holds thousandths of all,
    and each link to it is written once per part, so no task pairs them alone.
    """
    rows, classes, links = near_rows(df, row_id, text, split, train, most)
    least = hot_from(classes.agg(F.sum("copies")).first()[0] or 0)
    hot = F.broadcast(classes.filter(F.col("copies") >= least).select(F.col("c1").alias("e1"), F.col("c2").alias("e2"), F.ceil(F.col("copies") / least).cast("int").alias("parts")))  # at most a thousand rows
    ev = rows.filter("ev").select(F.col("row").alias("a"), F.col("c1").alias("e1"), F.col("c2").alias("e2")).join(hot, ["e1", "e2"], "left")
    ev = ev.select("a", "e1", "e2", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    links = links.join(hot, ["e1", "e2"], "left").select("b", "e1", "e2", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    pairs = links.join(ev, ["e1", "e2", "part"])
    return pairs.select(F.least("a", "b").alias("row_a"), F.greatest("a", "b").alias("row_b"))


def covered_records(df: DataFrame, row_id: str = "row_id", text: str = "text", split: str = "split", source: str = "source", train: tuple[str, ...] = ("train",), most: int = SHARD_WORDS) -> DataFrame:
    """``row, split, source, words, covered, train_rows`` of every evaluation row with a partner.

    ``covered`` is how many of its words one training row holds in order, at
    most; ``train_rows`` is the number of its partners. Links are summed by class
    first, so copies cost a row each.
    """
    rows, _, links = near_rows(df, row_id, text, split, train, most)
    best = links.groupBy(F.col("e1").alias("c1"), F.col("e2").alias("c2")).agg(F.max("words").alias("words"), F.max("shared").alias("covered"), F.count(F.lit(1)).alias("train_rows"))
    named = df.select(F.col(row_id).alias("row"), F.col(split).alias("split"), F.col(source).alias("source"))
    return rows.filter("ev").join(best, ["c1", "c2"]).join(named, "row").select("row", "split", "source", "words", "covered", "train_rows")


def overlap_report(df: DataFrame, row_id: str = "row_id", text: str = "text", split: str = "split", source: str = "source", train: tuple[str, ...] = ("train",), most: int = SHARD_WORDS) -> DataFrame:
    """``split, source, train_source, pairs, covered_words, words`` of the overlaps, multiplied from class counts and never expanded.

    ``words`` sums the words of the evaluation row over its pairs, and
    ``covered_words`` those that the training row holds in order.
    """
    rows, _, links = near_rows(df, row_id, text, split, train, most)
    named = df.select(F.col(row_id).alias("row"), F.col(split).alias("split"), F.col(source).alias("source"))
    ev = rows.filter("ev").join(named, "row").groupBy(F.col("c1").alias("e1"), F.col("c2").alias("e2"), "split", "source").agg(F.count(F.lit(1)).alias("ne"))
    by = links.join(named.select(F.col("row").alias("b"), F.col("source").alias("train_source")), "b")
    by = by.groupBy("e1", "e2", "train_source").agg(F.count(F.lit(1)).alias("nt"), F.sum("shared").alias("shared"), F.sum("words").alias("words"))
    met = by.join(ev, ["e1", "e2"])
    return met.groupBy("split", "source", "train_source").agg(F.sum(F.col("ne") * F.col("nt")).alias("pairs"), F.sum(F.col("ne") * F.col("shared")).alias("covered_words"), F.sum(F.col("ne") * F.col("words")).alias("words"))
