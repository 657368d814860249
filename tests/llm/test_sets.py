"""Copies, overlaps, containers, repetition, perplexity."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from spanloom.llm import layout, overlap, packing, perplexity, queries, repeats, sample


def stripped(s):
    return "".join(c for c in (s or "").casefold() if c.isalnum())


def test_layout_copies(spark):
    r = {"id": "A-1", "text": "Groß, it is", "spans": [], "source": "s", "language": None}
    lines = [json.dumps(r), json.dumps({**r, "text": "GROSS it\tis!", "id": "a_1", "language": ""}, indent=1), json.dumps({**r, "text": "Gros, it is"}), None, "", "not json 1", "NOT-JSON 1", "﻿ " + json.dumps(r), json.dumps({**r, "id": None}), "[]", '{"x": 1}']
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(lines, 1)], "line_id long, line string, sig int")
    got = sorted(tuple(x) for x in layout.layout_copies(df).collect())
    assert got == [(1, 2), (1, 8), (4, 5), (4, 10), (6, 7)]
    kept = {x.keep_id: x.copies for x in layout.kept_lines(df).collect()}
    assert kept == {1: 3, 3: 1, 4: 3, 6: 2, 9: 1, 11: 1} and layout.layout_copies(df.limit(0)).count() == 0


def test_a_record_that_is_most_of_the_table(spark):
    hot, rows = json.dumps({"id": "h", "text": "abc"}), []
    for i in range(3000):
        rows.append((i, hot if i % 10 else json.dumps({"id": f"x{i // 20}", "text": "acb"})))
    got = layout.layout_classes(spark.createDataFrame(rows, "line_id long, line string").repartition(4)).collect()
    assert len(got) == 3000
    for r in got:
        assert (r.keep_id, r.copies) == ((1, 2700) if r.line_id % 10 else (r.line_id // 20 * 20, 2))


def test_invariants_do_not_tell_all(spark):
    a, b = (layout.record_of(json.dumps({"id": 1, "text": t})) for t in ("ab 12", "BA 12"))
    assert layout.invariants(a) == layout.invariants(b) and a != b
    assert layout.record_of('{"id": 1.50, "text": null, "source": [1]}') == ("150", "", "1", "")


def test_layout_copies_against_brute_force(spark):
    by = {}
    for r in spark.read.parquet(f"{DATA}/example_lines.parquet").collect():
        o = json.loads(r.line)
        by.setdefault(tuple(stripped(o[k]) for k in ("id", "text", "source", "language")), []).append(r.line_id)
    want = {(min(v), x) for v in by.values() for x in v if x != min(v)}
    assert {tuple(r) for r in queries.p5_found(spark, DATA).collect()} == want


WORDS = st.lists(st.sampled_from("abcdef"), max_size=14)


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert overlap.common_words(a, b) == table[-1][-1]


def near(rows):
    words = {r: overlap.words_of(t).split() for r, t, _ in rows if t}
    part = {r: s for r, _, s in rows}
    out = set()
    for a in words:
        for b in words:
            if part[a] and part[b] and part[a] != "train" and part[b] == "train" and words[a] and words[b]:
                n = max(len(words[a]), len(words[b]))
                if overlap.common_words(words[a], words[b]) >= overlap.needed(n):
                    out.add((min(a, b), max(a, b)))
    return out


def test_overlap_on_random_texts(spark):
    rng = random.Random(4)
    base = [[rng.choice("kappa lima mike nova oscar papa quebec romeo sierra tango uniform victor".split()) for _ in range(rng.randrange(1, 16))] for _ in range(25)]
    rows = []
    for i in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            k, what = rng.randrange(len(w) + 1), rng.randrange(3)
            w[k : k + (what != 0)] = [] if what == 1 else [rng.choice(["x", "Kappa!", "..."])]
        rows.append((i, " ".join(w) if i % 31 else None, rng.choice(["train", "train", "test", "validation", None])))
    df = spark.createDataFrame(rows, "row_id long, text string, split string").selectExpr("*", "1 as c1", "'x' as norm")
    got = [tuple(r) for r in overlap.cross_split_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == near(rows)
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0
    assert {tuple(r) for r in overlap.cross_split_pairs(df, most=40).collect()} == set(got)  # many shards


@given(WORDS, WORDS, WORDS)
@settings(max_examples=300, deadline=None)
def test_partners_hold_a_passage(a, b, c):
    texts = [t for t in {" ".join(a), " ".join(c)} if t]
    shard = overlap.Shard(texts)
    for t in (" ".join(b), " ".join(a[:7] + ["z"] + a[7:]), " ".join(["f", *a[1:]])):
        if t:
            n = t.count(" ") + 1
            want = {i for i, e in enumerate(texts) if (s := overlap.common_words(e.split(), t.split())) >= overlap.needed(max(n, e.count(" ") + 1)) and s}
            assert {i for i, _ in shard.links(t)} == want
    for t in texts:
        for whole in (overlap.runs(t.count(" ") + 1), overlap.passages(t.split(), overlap.Counter(t.split()), overlap.Counter())):
            assert all(x[1] <= y[0] for x, y in zip(sorted(whole), sorted(whole)[1:]))


def test_shards_are_bounded():
    of, shards = overlap._plan([(3, 20, 22, 30), (4, 23, 24, 60), (5, 25, 26, 250), (9, 40, 44, 5)], 100)
    assert of == {3: (0, 1), 4: (0, 1), 5: (1, 3), 9: (4, 1)} and shards == [(0, 20, 24), (1, 25, 26), (2, 25, 26), (3, 25, 26), (4, 40, 44)]


def test_overlap_of_hot_copies(spark):
    rows = [(i, "one two three four five six seven", "train" if i % 2 else "test") for i in range(60)] + [(100, "one two three four five six sevn", "train"), (101, None, None)]
    df = spark.createDataFrame(rows, "row_id long, text string, split string")
    assert {tuple(r) for r in overlap.cross_split_pairs(df).collect()} == near(rows)
    source = df.withColumn("source", overlap.F.lit("s"))
    (r,) = overlap.overlap_report(source).collect()
    assert (r.pairs, r.covered_words, r.words) == (30 * 31, 30 * 30 * 7 + 30 * 6, 30 * 31 * 7)
    assert {(r.covered, r.words, r.train_rows) for r in overlap.covered_records(source).collect()} == {(7, 7, 31)}


def test_overlap_on_data(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/dataset_examples.parquet").select("row_id", "text", "split").collect()]
    want = near(rows)
    assert {tuple(r) for r in queries.p7_found(spark, DATA).collect()} == want
    assert queries.p7_report(spark, DATA).agg({"pairs": "sum"}).first()[0] == len(want)


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=100, deadline=None)
def test_plan_uses_every_item_once(sizes):
    h = {s: sizes.count(s) for s in sizes}
    used = {}
    plan = packing.plan_containers(h, 40)
    for lengths, times in plan:
        assert sum(lengths) <= 40 and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == h
    assert sum(t for _, t in plan) <= max(1, 2 * -(-sum(sizes) // 40))


def test_containers(spark):
    rng = random.Random(5)
    rows = [(i, s) for i, s in enumerate([None, 0, 0, 40, 41, 80, 200, *(rng.choice([7, 13, 20, 33]) for _ in range(500))])]
    df = spark.createDataFrame(rows, "item_id long, tokens long")
    got = packing.pack_items(df, "item_id", "tokens", 40).collect()
    boxes, parts = {}, {}
    for r in got:
        boxes[r.container] = boxes.get(r.container, 0) + r.used
        parts.setdefault(r.item_id, []).append(r)
    assert set(parts) == {i for i, _ in rows} and max(boxes.values()) <= 40 and min(boxes) == 0 and boxes[0] == 0
    for i, s in rows:
        p = parts[i]
        assert sum(x.used for x in p) == (s or 0) and (len(p) == 1 and p[0].part_no == 0 or (s > 40 and sorted(x.part_no for x in p) == list(range(1, len(p) + 1))))
    assert sum(boxes.values()) / 40 / (len(boxes) - 1) > 0.97
    assert packing.pack_items(df.limit(0), "item_id", "tokens", 40).count() == 0
    with pytest.raises(ValueError):
        packing.plan_containers({41: 1}, 40)


def brute(t, run=8):
    w = repeats._WORD.findall(t.lower())
    seen, mark = set(), [0] * len(w)
    for i in range(len(w) - run + 1):
        if (k := tuple(w[i : i + run])) in seen:
            mark[i : i + run] = [1] * run
        seen.add(k)
    return len(w), sum(mark)


@given(st.lists(st.sampled_from(["ab", "c", "d-e", "F", "\n"]), max_size=80))
@settings(max_examples=200, deadline=None)
def test_repeated_words(ws):
    t = " ".join(ws)
    assert repeats.repeated_words(t, 3) == brute(t, 3) and repeats.repeated_words(t) == brute(t)


def test_repetition(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id for r in docs if r.text and (c := brute(r.text))[0] and c[1] / c[0] >= 0.3}
    assert {r.doc_id for r in queries.p10_found(spark, DATA).collect()} == want
    df = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "a " * 20)], "doc_id long, text string")
    got = {r.doc_id: (r.words, r.repeated, r.share) for r in repeats.repetition(df).collect()}
    assert got == {1: (0, 0, 0.0), 2: (0, 0, 0.0), 3: (0, 0, 0.0), 4: (20, 19, 0.95)}


def test_perplexity(spark):
    rows = [(i, f"the cat sat on the mat number {i} and the dog lay down", "en") for i in range(40)] + [(99, "zig zag zog lorem ipsum unheard of words", "EN"), (100, None, None), (101, "", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in perplexity.perplexities(df, perplexity.fit(df)).collect()}
    assert len(got) == 43 and got[99].perplexity > 1.5 * got[5].perplexity > 1.5 and got[100].perplexity is None and got[101].language == "und"
    bands = perplexity.banded(perplexity.perplexities(df, perplexity.fit(df))).filter("rejected").collect()
    assert all(r.perplexity is not None for r in bands)
    none = df.limit(0)
    assert perplexity.perplexities(df, perplexity.fit(none)).count() == 43


def test_perplexity_keeps_every_ngram(spark, monkeypatch):
    rows = [(i, f"the cat {'sat' if i % 3 else 'lay'} on mat {chr(97 + i)} and the dog {chr(97 + i // 2)} lay down", "en") for i in range(20)]
    df = spark.createDataFrame([*rows, (20, None, None), (20, "the cat flew on mat b", "de")], "doc_id long, text string, lang string")
    seen, unseen = df.filter("doc_id < 12"), df

    def scores():
        model = perplexity.fit(seen)
        return [sorted(map(str, perplexity.perplexities(x, model).collect())) for x in (seen, unseen)]

    whole = scores()
    monkeypatch.setattr(perplexity, "ENTRIES", 3)
    assert scores() == whole and len(whole[1]) == 22


def test_bounded_sample(spark):
    df = spark.range(30_000).withColumnRenamed("id", "n")
    a, b = (sorted(r.n for r in sample.bounded_sample(df.repartition(k), "n", 1000).collect()) for k in (2, 7))
    assert a == b and len(a) == 1000 and sample.bounded_sample(df.limit(10), "n", 1000).count() == 10
