"""Span folds against fixtures and against plain Python restatements on random input."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as S
from spanloom.operators import detect, redact

T = "text string, spans array<struct<start:int,end:int,entity_type:string,score:double>>"
W = "windows array<struct<window_index:int,start:int,end:int,entity_type:string,score:double>>"
GP = "text string, gold array<struct<start:int,end:int,entity_type:string>>, pred array<struct<start:int,end:int,entity_type:string,score:double>>"
gold, pred, text = F.col("gold"), F.col("pred"), F.col("text")


def found(one, t, **kw):
    return [(t[a:b], k) for a, b, k, _ in one((t,), "text string", detect.regex_spans(text, **kw))]


def test_patterns(one):
    t = "Email ana@example.com or call +44 7700 900123."
    assert found(one, t) == [("ana@example.com", "EMAIL"), ("+44 7700 900123", "PHONE")]
    assert found(one, t, entities={"PHONE"}) == [("+44 7700 900123", "PHONE")]
    assert found(one, t, entities=set()) == []
    assert found(one, "") == [] and found(one, "no digits") == []
    assert one((None,), "text string", detect.regex_spans(text)) is None


def test_offsets_are_code_points(one):
    assert one(("😀😀 a@b.cd",), "text string", detect.regex_spans(text)) == [(3, 9, "EMAIL", 1.0)]


def test_equal_extent_goes_by_type_name(one):
    assert found(one, "host 10.20.30.40 up") == [("10.20.30.40", "IP_ADDRESS")]


def test_earlier_start_beats_longer(one):
    rows = [(0, 4, "A", 1.0), (2, 20, "B", 1.0), (4, 6, "C", None)]
    assert one(("", rows), T, S.resolve_greedy(F.col("spans"))) == [(0, 4, "A", 1.0), (4, 6, "C", None)]


def test_thresholds(one):
    rows = [(0, 4, "PERSON", 0.4), (9, 13, "PERSON", 0.9), (14, 15, "X", 0.0), (16, 17, "PERSON", None)]
    assert [s[0] for s in one(("", rows), T, S.above(F.col("spans"), {"PERSON": 0.5}))] == [9, 14, 16]
    assert redact.Scrubber(thresholds={}).thresholds == redact.load_thresholds("balanced")
    with pytest.raises(ValueError):
        redact.load_thresholds("loose")


def rank(w):
    return (float("-inf") if w[4] is None else w[4], w[2] - w[1], -w[0])


def resolved(ws, same):
    out = []
    for w in sorted(ws, key=lambda x: (x[1], x[2], x[3], x[0], (x[4] is not None, x[4]))):
        at = next((i for i, c in enumerate(out) if (c[3] == w[3]) == same and w[1] < c[2] and c[1] < w[2]), None)
        if at is None:
            out.append(w)
        else:
            inv = lambda t: "".join(chr(0x10FFFF - ord(c)) for c in t)
            a, b = rank(w) + (() if same else (inv(w[3]),)), rank(out[at]) + (() if same else (inv(out[at][3]),))
            if a > b:
                out[at] = w
    return sorted(out, key=lambda x: (x[1], x[2], x[3], x[0]))


def merged(ws):
    best = {}
    for w in ws:
        k = w[1:4]
        if k not in best or (rank(w)[0], -w[0]) > (rank(best[k])[0], -best[k][0]):
            best[k] = w
    return resolved(resolved(best.values(), True), False)


def test_window_merge_on_random_input(spark):
    rng = random.Random(1)
    rows = [([(rng.randrange(4), a := rng.randrange(30), a + rng.randrange(1, 9), rng.choice(["DATE", "DATE_TIME", "PERSON"]), rng.choice([None, 0.2, 0.5, 0.9])) for _ in range(rng.randrange(9))],) for _ in range(300)]
    got = spark.createDataFrame(rows, W).select("windows", S.merge_windows(F.col("windows")).alias("m")).collect()
    for r in got:
        assert [tuple(x) for x in r.m] == merged([tuple(x) for x in r.windows])


def test_window_ties(one):
    touching = [(0, 10, 20, "A", 0.5), (1, 20, 30, "A", 0.5)]
    assert one((touching,), W, S.merge_windows(F.col("windows"))) == touching
    assert one(([(3, 0, 9, "A", 0.5), (1, 0, 9, "B", 0.5)],), W, S.merge_windows(F.col("windows"))) == [(1, 0, 9, "B", 0.5)]
    assert one(([(0, 0, 9, "DATE", 0.5), (0, 0, 9, "DATE_TIME", 0.5)],), W, S.merge_windows(F.col("windows")))[0][3] == "DATE_TIME"
    chain = [(0, 0, 10, "A", 0.1), (0, 8, 20, "A", 0.2), (0, 18, 30, "A", 0.3)]
    assert [x[1] for x in one((chain,), W, S.merge_windows(F.col("windows")))] == [18]
    assert one(([],), W, S.merge_windows(F.col("windows"))) == []


def test_fragments(one):
    rows = [(0, 5, "PERSON", 0.9), (6, 11, "PERSON", 0.8)]
    assert one(("Nadim Ladki", rows), T, S.merge_fragments(text, F.col("spans"))) == [(0, 11, "PERSON", pytest.approx(0.85))]
    assert len(one(("Nadim Ladki", rows), T, S.merge_fragments(text, F.col("spans"), {"EMAIL"}))) == 2
    assert len(one(("Nadix Ladki", [(0, 4, "PERSON", 0.9), (6, 11, "PERSON", 0.8)]), T, S.merge_fragments(text, F.col("spans")))) == 2
    three = [(0, 1, "P", 1.0), (2, 3, "P", 0.0), (4, 5, "P", 0.0)]
    assert one(("a b c", three), T, S.merge_fragments(text, F.col("spans"))) == [(0, 5, "P", 0.25)]


def test_replace_and_restore(one):
    t = "Ana called Ana."
    r = one((t, [(11, 14, "PERSON", None), (0, 3, "PERSON", None)]), T, redact.replace_spans(text, F.col("spans")))
    assert r == ("[PERSON_1] called [PERSON_2].", [("[PERSON_1]", "Ana"), ("[PERSON_2]", "Ana")], None)
    assert one((t, [(0, 4, "A", None), (3, 6, "A", None)]), T, redact.replace_spans(text, F.col("spans"))) == (None, None, "spans overlap")
    assert one((t, [(0, 99, "A", None)]), T, redact.replace_spans(text, F.col("spans")))[2] == "a span ends past the text"
    M = "text string, m array<struct<placeholder:string,value:string>>"
    assert one((r[0], r[1]), M, redact.restore(text, F.col("m"))) == (t, None)
    assert one(("gone", r[1]), M, redact.restore(text, F.col("m")))[1].endswith("exactly once")
    assert one(("[A_1] [A_1]", [("[A_1]", "x")]), M, redact.restore(text, F.col("m")))[0] is None


def test_scrub_chain(spark):
    df = spark.createDataFrame([(1, "Email ana@example.com."), (2, None), (3, "")], "id int, text string")
    s = redact.Scrubber()
    rows = {r.id: r for r in s.restore(s.scrub(df)).collect()}
    assert rows[1].redacted_text == "Email [EMAIL_1]." and rows[1].restored_text == "Email ana@example.com."
    assert rows[2].redacted_text is None and rows[3].redacted_text == ""
    assert s.scrub(df.limit(0)).count() == 0


def matched(g, p):
    c = sorted((-(min(a[1], b[1]) - max(a[0], b[0])), abs(a[0] - b[0]) + abs(a[1] - b[1]), i, j) for i, a in enumerate(g) for j, b in enumerate(p) if a[2] == b[2] and a[0] < b[1] and b[0] < a[1])
    gs, ps = set(), set()
    for _, _, i, j in c:
        if i not in gs and j not in ps:
            gs.add(i)
            ps.add(j)
    return len(gs)


def kinds(g, p):
    out = []
    for s, e, t in g:
        near = [x for x in p if s < x[1] and x[0] < e]
        same = [x for x in near if x[2] == t]
        if any(x[:2] == (s, e) for x in same):
            out.append(None)
        elif not near:
            out.append("miss")
        elif not same:
            out.append("wrong_type")
        else:
            cover = set().union(*(range(max(s, x[0]), min(e, x[1])) for x in same))
            best = max(same, key=lambda x: min(e, x[1]) - max(s, x[0]))
            if len(same) > 1 and min(x[0] for x in same) <= s and all(i in cover for i in range(s, e)):
                out.append("split")
            else:
                out.append("oversized" if best[0] <= s and best[1] >= e else "undersized" if best[0] >= s and best[1] <= e else "boundary_shift")
    return out


def test_comparison_on_random_input(spark):
    rng = random.Random(2)
    make = lambda n: [(a := rng.randrange(40), a + rng.randrange(1, 12), rng.choice("AB")) for _ in range(rng.randrange(n))]
    rows = [("x" * 60, make(5), [(*s, 0.5) for s in make(6)]) for _ in range(300)]
    df = spark.createDataFrame(rows, GP).select(
        "gold", "pred", S.partial_hits(gold, pred).alias("m"), S.leaked(gold, pred).alias("l"), S.over_redacted(gold, pred).alias("o"), S.exact_hits(gold, pred).alias("x"),
        F.transform("gold", lambda g: S.error_kind(text, g, pred)).alias("k"), F.size(S.false_positives(gold, pred)).alias("f"),
    )
    for r in df.collect():
        g, p = [tuple(x) for x in r.gold], [tuple(x)[:3] for x in r.pred]
        chars = lambda q: set().union(*(range(a, b) for a, b, _ in q)) if q else set()
        assert r.m == matched(g, p) and r.x == len(set(g) & set(p)) and r.k == kinds(g, p)
        assert r.l == sum(not set(range(a, b)) <= chars(p) for a, b, _ in g) and r.o == len(chars(p) - chars(g))
        assert r.f == sum(not any(a[2] == b[2] and a[0] < b[1] and b[0] < a[1] for a in g) for b in p)


def test_type_is_ignored_by_leaks_only(one):
    row = ("x" * 20, [(0, 10, "A")], [(0, 10, "B", 1.0)])
    assert one(row, GP, S.leaked(gold, pred), S.exact_hits(gold, pred)) == [0, 0]
    assert one(("x" * 20, [(0, 20, "A")], [(0, 14, "A", 1.0)]), GP, S.leaked(gold, pred)) == 1
