"""N-gram perplexity of documents, with bands by language (problem 10, the method named).

A trigram model with modified Kneser-Ney smoothing is counted by Spark over all
documents, and nothing of it is cut: the probability of every trigram is computed
once, by joins of the tables of the three orders. The ``ENTRIES`` most frequent
trigrams are scored from sorted arrays by whole batches, which keeps them (and any
skew) out of the shuffle; all others by a join. N-grams are told apart by 64-bit
hashes, and log probabilities are summed as integers, so that results do not depend
on the order of rows. Perplexity tells boilerplate and gibberish by the corpus; it
can't tell how much of a document repeats that same document, which ``repeats``
measures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let
from ..plans.written import written
from .language import code_of

ENTRIES = 1_000_000  # frequent trigrams scored from a broadcast, at most; the others are joined, with the same result
SCALE = 1e9  # log probabilities are integers of 1 / SCALE
LOW, HIGH = 0.01, 0.99  # shares of a language's documents below and above its band


def _grams(text: Column) -> Column:
    """``struct<u, v, w>`` hashes for each word of a text with the two before it; digits are alike."""
    words = F.transform(F.regexp_extract_all(F.regexp_replace(F.lower(text), r"\p{N}", "0"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.xxhash64(x))
    zero = F.lit(0).cast("long")

    def triples(w: Column) -> Column:
        before = lambda i, k: F.when(i >= k, F.get(w, i - k)).otherwise(zero)
        return F.transform(w, lambda x, i: F.struct(before(i, 2).alias("u"), before(i, 1).alias("v"), x.alias("w")))

    return let(words, triples)


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order, from how many n-grams occur once to four times."""
    seen = {r.c: r.n for r in counts.filter("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n2, n3, n4 = (seen.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.01), k) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1))


def _discounted(counts: DataFrame) -> tuple[Column, list[Column]]:
    """The count less its discount, and the aggregates ``total, mass`` of a context."""
    d = [F.lit(x) for x in _discounts(counts)]
    c = F.col("c")
    ones, twos, n = F.sum((c == 1).cast("long")), F.sum((c == 2).cast("long")), F.count(F.lit(1))
    less = c - F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])
    return less, [F.sum("c").alias("total"), (ones * d[0] + twos * d[1] + (n - ones - twos) * d[2]).alias("mass")]


def _level() -> Column:
    return F.floor(F.log2("c") * 8).cast("int")


def _least(scored: DataFrame) -> int | None:
    """The least level of counts that leaves at most ``ENTRIES`` trigrams; none if the highest has more."""
    total, least = 0, None
    for r in sorted(scored.groupBy(_level().alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += r.n
        if total > ENTRIES:
            break
        least = r.level
    return least


def _log(p: Column) -> Column:
    return F.round(F.log(F.greatest(p, F.lit(1e-12))) * SCALE).cast("long")


class Model:
    """Tables of all n-grams: ``trigrams`` (h, c, lp), ``bigrams`` (v, w, p), ``words`` (w, p) and the weights of contexts."""

    def __init__(self, tri: DataFrame, bi: DataFrame, uni: DataFrame):
        less, sums = _discounted(uni)
        one = uni.agg(*sums, F.count(F.lit(1)).alias("n")).first()
        self.unseen = (one.mass / one.total if one.total else 1.0) / max(one.n, 1)
        self.words = uni.select("w", (less / F.lit(float(one.total or 1)) + self.unseen).alias("p"))
        less, sums = _discounted(bi)
        ctx = bi.groupBy("v").agg(*sums)
        self.after_one = ctx.select("v", (F.col("mass") / F.col("total")).alias("weight1"))
        p = less / F.col("total") + F.col("mass") / F.col("total") * F.col("p")
        self.bigrams = written(bi.join(ctx, "v").join(self.words, "w").select("v", "w", p.alias("p")), "bigram-shares")
        less, sums = _discounted(tri)
        ctx = tri.groupBy("u", "v").agg(*sums)
        self.after_two = ctx.select("u", "v", (F.col("mass") / F.col("total")).alias("weight2"))
        p = less / F.col("total") + F.col("mass") / F.col("total") * F.col("p")
        self.trigrams = written(tri.join(ctx, ["u", "v"]).join(self.bigrams, ["v", "w"]).select(F.xxhash64("u", "v", "w").alias("h"), "c", _log(p).alias("lp")), "trigram-shares")
        self.least = _least(self.trigrams)

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order and log probabilities of the frequent trigrams."""
        if self.least is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = self.trigrams.filter(_level() >= self.least).select("h", "lp").toArrow()  # at most ENTRIES rows
        h, lp = t.column("h").to_numpy(), t.column("lp").to_numpy()
        order = np.argsort(h, kind="stable")
        return h[order], lp[order]

    def others(self) -> DataFrame:
        return (self.trigrams if self.least is None else self.trigrams.filter(_level() < self.least)).select("h", "lp")

    def backed_off(self, grams: DataFrame) -> DataFrame:
        """``grams`` (u, v, w) not in the model with ``lp`` by their shorter parts."""
        known = self.bigrams.withColumnRenamed("p", "p2")
        df = grams.join(self.after_two, ["u", "v"], "left").join(known, ["v", "w"], "left").join(self.after_one, "v", "left").join(self.words, "w", "left")
        one = lambda k: F.coalesce(F.col(k), F.lit(1.0))
        return df.withColumn("lp", _log(one("weight2") * F.coalesce("p2", one("weight1") * F.coalesce("p", F.lit(self.unseen)))))


def fit(df: DataFrame, text: str = "text") -> Model:
    """The model of all texts; null and empty ones add nothing."""
    grams = df.filter(F.col(text).isNotNull()).select(F.explode_outer(_grams(F.col(text))).alias("g")).filter("g is not null")
    tri = written(grams.select("g.u", "g.v", "g.w").groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("c")), "trigrams")
    bi = written(tri.groupBy("v", "w").agg(F.count(F.lit(1)).alias("c")), "bigrams")  # kinds of words before, not occurrences
    return Model(tri, bi, written(bi.groupBy("w").agg(F.count(F.lit(1)).alias("c")), "words"))


def _first_pass(df: DataFrame, model: Model, doc_id: str, text: str, lang: str) -> DataFrame:
    """``doc_id, language, words, lp, rest``: the sum over frequent trigrams, and the other trigrams; one row a document."""
    shared = df.sparkSession.sparkContext.broadcast(model.frequent())  # bounded by ENTRIES
    none = F.expr("cast(array() as array<struct<u:bigint,v:bigint,w:bigint>>)")
    src = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(code_of(F.col(lang)), F.lit("und")).alias("language"), F.coalesce(_grams(F.col(text)), none).alias("g"))
    hashed = let(F.col("g"), lambda g: F.transform(g, lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"), x["w"].alias("w"), F.xxhash64(x["u"], x["v"], x["w"]).alias("h"))))
    gram = pa.struct([(k, pa.int64()) for k in "uvw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lps = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                s = b.slice(k, 1000)
                sizes = s.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                u, v, w, h = (x.to_numpy(zero_copy_only=False) for x in s.column(2).flatten().flatten())
                ends = np.cumsum(sizes)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                lp = np.where(hit, lps[at], 0) if len(keys) else np.zeros(len(h), np.int64)
                run_ = np.concatenate([[0], np.cumsum(lp, dtype=np.int64)])
                left = np.concatenate([[0], np.cumsum(~hit)])[np.concatenate([[0], ends])]
                rest = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.StructArray.from_arrays([pa.array(x[~hit]) for x in (u, v, w)], fields=list(gram)))
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(sizes), pa.array(run_[ends] - run_[ends - sizes]), rest], ["doc_id", "language", "words", "lp", "rest"])

    return src.withColumn("g", hashed).mapInArrow(run, "doc_id long, language string, words long, lp long, rest array<struct<u:bigint,v:bigint,w:bigint>>")


def perplexities(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, language, words, perplexity``; texts without words have null."""
    docs = written(_first_pass(df, model, doc_id, text, lang).withColumn("rid", F.monotonically_increasing_id()), "first-pass")
    rest = docs.select("rid", F.explode_outer("rest").alias("g")).filter("g is not null").select("rid", "g.u", "g.v", "g.w", F.xxhash64("g.u", "g.v", "g.w").alias("h"))
    found = rest.select("rid", "h").join(model.others(), "h", "left")
    sums = written(found.groupBy("rid").agg(F.sum("lp").alias("lp"), F.collect_set(F.when(F.col("lp").isNull(), F.col("h"))).alias("missing")), "log-sums")
    parts = sums.select("rid", "lp")
    missing = sums.filter("size(missing) > 0").select("rid", F.explode("missing").alias("h"))
    if not missing.isEmpty():  # texts the model was not fitted on
        parts = parts.unionByName(model.backed_off(rest.join(missing, ["rid", "h"], "left_semi")).select("rid", "lp"))
    more = parts.groupBy("rid").agg(F.sum("lp").alias("more"))
    mean = (F.col("lp") + F.coalesce("more", F.lit(0))).cast("double") / SCALE / F.col("words")
    return docs.join(more, "rid", "left").select("doc_id", "language", "words", F.when(F.col("words") > 0, F.exp(-mean)).alias("perplexity"))


def banded(scored: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """``scored`` with its language's band and ``rejected``: outside it. Texts without perplexity are not rejected."""
    scored = written(scored, "perplexities")
    q = scored.groupBy("language").agg(F.percentile_approx("perplexity", F.array(F.lit(low), F.lit(high)), 10_000).alias("q"))
    bands = q.select("language", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    out = F.coalesce((F.col("perplexity") < F.col("low")) | (F.col("perplexity") > F.col("high")), F.lit(False))
    return scored.join(bands, "language").withColumn("rejected", out)
