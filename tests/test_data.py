"""Adapters, JSON lines, splits, statistics, labels, audits."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import audit, bio, calibrate, datasets, metrics, normalize, taxonomy
from spanloom.sources import jsonl

MASK = "array<struct<value:string,start:int,end:int,label:string>>"
EX = "example_id string, text string, spans array<struct<start:int,end:int,entity_type:string>>, source string, language string"


def rows(df):
    return [(r.example_id, r.text, None if r.spans is None else [tuple(s) for s in r.spans], r.error) for r in df.collect()]


def test_openpii(spark):
    schema = f"uid string, language string, source_text string, privacy_mask {MASK}"
    ok = ("1", "en", "John Smith can help.", [("John", 0, 4, "GIVENNAME"), ("Smith", 5, 10, "SURNAME")])
    bad = [("2", "en", "John", [("Jon", 0, 4, "GIVENNAME")]), ("3", "en", "John", [("John", 0, 9, "GIVENNAME")]), ("4", "en", "John", [("John", 0, 4, "SHOE")]), (" ", "en", "John", []), ("5", None, "John", []), ("6", "en", "John", None)]
    got = rows(normalize.openpii(spark.createDataFrame([ok, ("abc", "en", "Hi", []), *bad], schema)))
    assert got[0] == ("openpii-1", "John Smith can help.", [(0, 4, "PERSON"), (5, 10, "PERSON")], None) and got[1][2] == [] and all(r[3] for r in got[2:])


def test_gretel(spark):
    text = "Account holder John Smith uses 12345678."
    mask = json.dumps([{"start": 31, "end": 39, "label": "account_number"}, {"start": 15, "end": 25, "type": "name"}])
    got = rows(normalize.gretel(spark.createDataFrame([("1", "en", text, mask), ("2", "en", text, "oops"), ("3", "en", text, '[{"start":0}]')], "index string, language string, generated_text string, pii_spans string")))
    assert got[0] == ("gretel-finance-1", text, [(15, 25, "PERSON"), (31, 39, "BANK_ACCOUNT")], None) and got[1][3] and got[2][3]


def test_masking(spark):
    text = "Murali paid 5 to a@b.cd"
    mask = [("a@b.cd", 17, 23, "EMAIL"), ("Murali", 0, 6, "firstname"), ("5", 12, 13, "AMOUNT")]
    got = rows(normalize.masking(spark.createDataFrame([(1, "en", text, mask), (2, "en", text, [("5", 12, 13, "WHAT")]), (3, "en", text, [("6", 12, 13, "AMOUNT")])], f"id int, language string, source_text string, privacy_mask {MASK}")))
    assert got[0] == ("ai4privacy-1", text, [(0, 6, "PERSON"), (17, 23, "EMAIL")], None) and got[1][3] == "unsupported label" and got[2][3]


def test_conll(spark):
    data = [("1", ["Peter", "Blackburn", "visited", "London", "."], [1, 2, 0, 5, 0]), (None, ["John", "'s", "team", "won", "."], [1, 0, 0, 0, 0]), (" ", ["John", "Smith"], [2, 2]), ("4", ["John"], [99]), ("5", [], []), ("6", ["a", "b"], [0])]
    got = rows(normalize.conll(spark.createDataFrame(data, "id string, tokens array<string>, ner_tags array<int>")))
    assert got[0] == ("conll2003-1", "Peter Blackburn visited London.", [(0, 15, "PERSON")], None)
    digest = hashlib.sha1("\x1f".join(data[1][1]).encode()).hexdigest()[:12]
    assert got[1] == (f"conll2003-{digest}", "John's team won.", [(0, 4, "PERSON")], None) and got[2][2] == [(0, 10, "PERSON")] and all(r[3] for r in got[3:])
    legacy = rows(normalize.conll(spark.createDataFrame([("1", ["Peter", "Blackburn"], [3, 4])], "id string, tokens array<string>, tags array<int>")))
    assert legacy[0][2] == [(0, 15, "PERSON")]


def test_routing(spark):
    adapted = normalize.hand_labelled(spark.createDataFrame([("1", "Hi Ana", [(3, 6, "NAME")]), ("2", "Hi", None), ("", "x", None), ("4", "Hi", [(0, 9, "X")])], "id string, text string, spans array<struct<start:int,end:int,label:string>>"))
    good, bad = normalize.route(adapted)
    assert good.count() == 2 and bad.count() == 2
    report = normalize.load_report(adapted).first()
    assert (report.accepted, report.rejected, report.acceptance_rate) == (2, 2, 0.5)
    assert normalize.load_report(adapted.limit(0)).first().acceptance_rate == 0.0
    with pytest.raises(Exception, match="id is required|span"):
        normalize.route(adapted, strict=True)[0].collect()


def test_labels(spark, one):
    assert [one((x,), "l string", taxonomy.normalized_label(F.col("l"))) for x in ("first-name", " email address ", "odd", None)] == ["PERSON", "EMAIL", None, None]
    audit_rows = taxonomy.audit_labels(spark, {"a": ["EMAIL", "ODD"]}, {"EMAIL": "NOT_A_TYPE"}).collect()
    assert sorted(tuple(r) for r in audit_rows) == [("a", "invalid", "NOT_A_TYPE"), ("a", "missing", "ODD")]


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([("1", "Hi Añä", [(3, 6, "PERSON")], "s", "en"), ("2", "x", [], "s", "en")], EX)
    assert jsonl.write_examples(df.coalesce(1), f"{tmp_path}/a") == 2
    back = jsonl.require_valid(jsonl.read_examples(spark, f"{tmp_path}/a/*.txt"))
    assert sorted(r.text for r in back.collect()) == ["Hi Añä", "x"]
    line = next(x for p in (tmp_path / "a").glob("*.txt") for x in p.read_text("utf-8").splitlines() if "Hi" in x)
    assert line == '{"id":"1","text":"Hi Añä","spans":[{"start":3,"end":6,"entity_type":"PERSON"}],"source":"s","language":"en"}'
    (tmp_path / "bad.jsonl").write_text(line + "\n\n{oops\n[1]\n" + json.dumps({"id": "3", "text": "x", "source": "s", "language": "en"}) + "\n", "utf-8")
    got = {r.line_no: r.error for r in jsonl.read_examples(spark, f"{tmp_path}/bad.jsonl").collect()}
    assert got == {1: None, 2: "line must not be empty", 3: "invalid JSON", 4: "line must be a JSON object", 5: "spans must be a list"}
    with pytest.raises(Exception, match="line 2"):
        jsonl.require_valid(jsonl.read_examples(spark, f"{tmp_path}/bad.jsonl")).collect()
    assert jsonl.read_examples(spark, f"{tmp_path}/bad.jsonl", skip_blank=True).count() == 4


def test_split_folder_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(str(i), f"User {i}", [(0, 4, "PERSON")], "s", "en") for i in range(10)], EX)
    parts = datasets.split(df, "example_id", 2, 3)
    assert {r[0]: r[1] for r in parts.groupBy("part").count().collect()} == {"train": 5, "validation": 2, "test": 3}
    manifest = jsonl.save_split(parts, str(tmp_path / "d"), "s", 42)
    assert manifest["total_count"] == 10 and jsonl.load_split(spark, str(tmp_path / "d")).count() == 10
    jsonl.write_report({**manifest, "splits": {"train": 6, "validation": 2, "test": 2}}, str(tmp_path / "d/manifest.json"))
    with pytest.raises(ValueError, match="counts"):
        jsonl.load_split(spark, str(tmp_path / "d"))
    with pytest.raises(ValueError, match="version"):
        jsonl.check_manifest({"format_version": 2})
    cache = df.withColumn("example_index", F.col("example_id").cast("long")).withColumn("predictions", F.expr("array(named_struct('start',0,'end',4,'entity_type','PERSON','score',cast(null as double)))"))
    jsonl.write_cache(cache, f"{tmp_path}/c")
    assert sorted(r.example_index for r in jsonl.read_cache(spark, f"{tmp_path}/c").collect()) == list(range(10))
    assert jsonl.markdown_table([{"a": 0.5, "b": None, "c": 3}], ["a", "b", "c"]).splitlines()[-1] == "| 0.5000 | — | 3 |"


def test_samples(spark):
    df = spark.range(50).withColumnRenamed("id", "n")
    a, b = (sorted((r.place, r.n) for r in datasets.sample(df.repartition(k), "n", 7).collect()) for k in (1, 5))
    assert a == b and len(a) == 7
    order = list(range(50))
    random.Random(42).shuffle(order)
    assert [r.n for r in datasets.sample_places(df, "n", 5).orderBy("place").collect()] == order[:5]
    parts = {r.n: r.part for r in datasets.split_places(df, "n", 3, 4).collect()}
    assert {n for n, p in parts.items() if p == "test"} == set(order[:4]) and {n for n, p in parts.items() if p == "validation"} == set(order[4:7])
    for bad in (-1, True):
        with pytest.raises((ValueError, TypeError)):
            datasets.sample(df, "n", bad)
    with pytest.raises(ValueError):
        datasets.sample_places(df, "n", 51)


def test_statistics(spark):
    df = spark.createDataFrame([("1", "Hi Ana", [(3, 6, "PERSON")], "s", "en"), ("2", "x", None, "s", None)], EX)
    r = datasets.statistics(df).first()
    assert (r.examples, r.positive, r.negative, r.entities, r.characters, r.min_length, r.max_length, r.avg_length) == (2, 1, 1, 1, 7, 1, 6, 3.5)
    z = datasets.statistics(df.limit(0)).first()
    assert (z.examples, z.entities, z.avg_length, z.min_length) == (0, 0, 0.0, 0)
    maps = {r.kind: r.counts for r in datasets.count_maps(datasets.count_rows(df, source="source")).collect()}
    assert maps == {"entity_type": {"PERSON": 1}, "source": {"s": 2}}
    p = {r.fraction: r.value for r in datasets.percentiles(spark.createDataFrame([(30,), (10,), (20,), (None,)], "v int"), "v", [0.0, 0.5, 1.0]).collect()}
    assert p == {0.0: 10, 0.5: 20, 1.0: 30}
    with pytest.raises(ValueError):
        datasets.check_hand_set(spark.createDataFrame([("1",), ("1",)], "id string"))


def scored(spark, gold, pred):
    return spark.createDataFrame([("x" * 20, gold, pred)], "text string, spans array<struct<start:int,end:int,entity_type:string>>, predictions array<struct<start:int,end:int,entity_type:string,score:double>>")


def test_metrics(spark):
    s = metrics.dataset_score(metrics.document_measures(scored(spark, [(0, 10, "A")], [(0, 5, "A", 0.9), (5, 10, "A", 0.8), (5, 10, "A", 0.8)]))).first()
    assert (s.exact_tp, s.exact_fp, s.exact_fn, s.partial_tp, s.partial_fp, s.predicted, s.leaked, s.fp_chars, s.non_pii) == (0, 2, 1, 1, 2, 3, 0, 0, 10)
    empty = metrics.dataset_score(metrics.document_measures(scored(spark, [], []).limit(0))).first()
    assert (empty.examples, empty.exact_f1, empty.leak_rate, empty.over_redaction_rate) == (0, 0.0, 0.0, 0.0)
    r = metrics.entity_recall(scored(spark, [(0, 4, "A"), (5, 9, "B")], [(0, 4, "A", 1.0), (0, 4, "C", 1.0)])).collect()
    assert sorted((x.entity_type, x.recall) for x in r) == [("A", 1.0), ("B", 0.0)]
    with pytest.raises(Exception, match="unknown example"):
        metrics.joined(scored(spark, [], []).withColumn("k", F.lit(1)), spark.createDataFrame([(2, None)], "k int, predictions array<struct<start:int,end:int,entity_type:string,score:double>>"), "k").collect()


def test_calibration(spark):
    assert calibrate.threshold_grid(0.25) == [0, 0.25, 0.5, 0.75, 1] and len(calibrate.threshold_grid()) == 21
    df = spark.createDataFrame([(0.9, True), (0.1, False), (1.0, True)], "score double, correct boolean")
    assert calibrate.calibration_error(df.filter("score < 1"), bins=2).first().ece == pytest.approx(0.1)
    assert calibrate.calibration_error(df.limit(0)).first().ece == 0.0
    edges = spark.createDataFrame([(i / 100, i % 3 == 0) for i in range(101)], "score double, correct boolean")
    bins = {}
    for i in range(101):
        b = next(k for k in range(100) if k / 100 <= i / 100 < (k + 1) / 100 or (k == 99 and i == 100))
        bins.setdefault(b, []).append(i)
    want = sum(abs(sum(i % 3 == 0 for i in m) - sum(i / 100 for i in m)) for m in bins.values()) / 101
    assert calibrate.calibration_error(edges, bins=100).first().ece == pytest.approx(want)
    with pytest.raises(Exception, match="score"):
        calibrate.calibration_error(spark.createDataFrame([(None, True)], "score double, correct boolean")).collect()
    strict, _ = calibrate.optimize_profile(scored(spark, [(0, 4, "PERSON")], [(0, 4, "PERSON", 0.4)]), ["PERSON"], [0, 0.5, 1], 0.5, "strict")
    balanced, s = calibrate.optimize_profile(scored(spark, [(0, 4, "PERSON")], [(0, 4, "PERSON", 0.9), (6, 9, "PERSON", 0.2)]), ["PERSON"], [0, 0.5, 1], 0.5, "balanced")
    assert strict == {"PERSON": 0.0} and balanced == {"PERSON": 0.5} and s["exact_f1"] == 1.0


def test_sweep_equals_scoring_each_threshold(spark):
    rng = random.Random(3)
    make = lambda n: [(a := rng.randrange(30), a + rng.randrange(1, 9), rng.choice("AB")) for _ in range(rng.randrange(n))]
    rows = [("x" * 40, make(4), [(*s, rng.choice([None, 0.0, 0.33, 0.5, 1.0])) for s in make(6)]) for _ in range(40)]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,entity_type:string>>, predictions array<struct<start:int,end:int,entity_type:string,score:double>>")
    got = {r.threshold: r for r in calibrate.sweep_thresholds(df, [0.25, 0.0, 0.5, 1.0]).collect()}
    assert sorted(got) == [0.0, 0.25, 0.5, 1.0]
    for t, r in got.items():
        s = calibrate.score_profile(df, {"A": t, "B": t}).first()
        assert (r.predictions, r.leak_rate, r.f1, r.over_redaction_rate) == (s.predicted, s.leak_rate, s.exact_f1, s.over_redaction_rate)
    assert calibrate.sweep_thresholds(df.limit(0), [0.5]).first().f1 == 0.0


def odd_rows(rng, n):
    """Documents of spans that touch, overlap, repeat, lack a score or have an odd one, and some rows without arrays."""
    make = lambda most: [(a := rng.randrange(30), a + rng.randrange(1, 9), rng.choice("ABC")) for _ in range(rng.randrange(most))]
    scores = [None, 0.0, -0.0, 0.3, 0.33, 0.5, 0.6, 1.0, 1.5, -0.5, float("nan")]
    rows = [("x" * rng.randrange(40, 43), make(5), [(*s, rng.choice(scores)) for s in make(7)]) for _ in range(n)]
    return [*rows, ("x" * 9, None, [(0, 4, "A", 0.7)]), ("x" * 9, [(0, 4, "A")], None), (None, [], []), ("", [], []), ("x" * 9, [(2, 5, "B")], [])]


ODD = "text string, spans array<struct<start:int,end:int,entity_type:string>>, predictions array<struct<start:int,end:int,entity_type:string,score:double>>"


def test_pieces_score_as_their_documents(spark):
    from spanloom.functions.spans import above

    df, grid, rest = spark.createDataFrame(odd_rows(random.Random(5), 150), ODD), [0.25, 0.5, 1.0], {"B": 0.6}
    pieces = calibrate._pieces(df, [*grid, 0.6], "spans", "predictions").cache()
    assert pieces.agg(F.sum(F.col("docs") * F.col("n"))).first()[0] == 155
    for only, kept in ((None, {}), ("A", rest)):
        a, b = (calibrate.sweep_thresholds(x.withColumn("predictions", above(F.col("predictions"), kept)), [*grid, 0.6], only=only, **more).collect() for x, more in ((df, {}), (pieces, {"length": F.col("length"), "weight": F.col("n")})))
        assert sorted(a) == sorted(b) and any(r.f1 for r in a)
    profile, score = calibrate.optimize_profile(df.toDF("text", "gold", "said"), ["A", "B"], grid, 0.6, "balanced", passes=1, gold="gold", predicted="said")
    assert score == calibrate.score_profile(df, profile).first().asDict()
    assert calibrate.optimize_profile(df.limit(0), ["A"], grid, 0.6, "strict", passes=1)[1]["examples"] == 0


def test_a_search_sweeps_each_different_piece_once(spark, monkeypatch):
    held, write = [], calibrate.written
    monkeypatch.setattr(calibrate, "written", lambda df, name: held.append(write(df, name)) or held[-1])
    at = lambda i: [(i % 50, i % 50 + 4, "A"), (60 + i % 30, 65 + i % 30, "B")]
    rows = [("x" * 100, at(i), [(*s, 0.71 + i % 4 / 100) for s in at(i)]) for i in range(400)]
    profile, score = calibrate.optimize_profile(spark.createDataFrame(rows, ODD), ["A", "B"], [0.0, 0.5, 0.9], 0.6, "balanced", passes=1)
    assert (profile, score["examples"], score["exact_tp"], score["exact_f1"]) == ({"A": 0.6, "B": 0.6}, 400, 800, 1.0)
    assert [x.count() for x in held] == [3]  # a span of each type, and what no span covers
    outside = spark.createDataFrame([*rows, ("x" * 9, [], [(5, 10, "A", 0.1)])], ODD)
    with pytest.raises(Exception, match="does not lie in its text"):
        calibrate.optimize_profile(outside, ["A"], [0.5], 0.6, "balanced", passes=1)


def test_audit(spark, one):
    E = "text string, spans array<struct<start:int,end:int,entity_type:string>>"
    t, s = one(("Call Alice now", [(5, 10, "PERSON")]), E, audit.perturbed(F.col("text"), F.col("spans"), audit.PERTURBATIONS["double_spaces"]))
    assert t == "Call  Alice  now" and s == [(6, 11, "PERSON")]
    t, s = one(("Groß A", [(5, 6, "X")]), E, audit.perturbed(F.col("text"), F.col("spans"), audit.PERTURBATIONS["uppercase"]))
    assert t == "GROSS A" and s == [(6, 7, "X")]
    df = spark.createDataFrame([("train", "Call Alice now", [(5, 10, "PERSON")]), ("test", "  CALL  ALICE  NOW  ", [(8, 13, "PERSON")]), ("test", "Other", [])], "split string, " + E)
    exact, folded = (audit.duplicate_stats(df, folded=f).first() for f in (False, True))
    assert (exact.target_examples, exact.matching_examples, folded.matching_examples) == (2, 0, 1)
    v = audit.value_overlap(df).first()
    assert (v.entity_type, v.gold_spans, v.seen_in_train, v.rate) == ("PERSON", 1, 1, 1.0)
    p = audit.prefixed(df, 480).first()
    assert p.perturbed_text.startswith("context context ") and p.perturbed_spans[0].start == 3845


def test_bio(spark, one):
    O = "o array<struct<start:int,end:int>>, l array<string>, s array<double>"
    offs, labs, sc = F.col("o"), F.col("l"), F.col("s")
    row = ([(0, 0), (5, 8), (8, 11), (0, 0)], ["O", "B-PERSON", "I-PERSON", "O"], [1.0, 0.8, 0.6, 1.0])
    assert one(row, O, bio.token_spans(offs, labs, sc)) == [(5, 11, "PERSON", pytest.approx(0.7))]
    assert one(([(0, 4), (5, 9)], ["B-PERSON", "I-LOCATION"], None), O, bio.token_spans(offs, labs)) == [(0, 4, "PERSON", None), (5, 9, "LOCATION", None)]
    strict = lambda o, l: one((o, l, None), O, bio.strict_spans(offs, labs))  # noqa: E731, E741
    assert strict([(0, 4), (5, 9), (10, 11)], ["B-A", "I-A", "O"]) == ([(0, 9, "A")], None)
    assert strict([(0, 4)], ["I-A"])[1] and strict([(0, 4), (5, 9)], ["B-A", "I-B"])[1] and strict([(0, 4)], ["B-"])[1] and strict([(0, 4)], [])[1] and strict([], []) == ([], None)
    tok = "t array<struct<start:int,end:int,word_id:int,label:string>>"
    assert one(([(0, 2, 0, "B-A"), (2, 4, 0, None), (5, 6, 1, None), (7, 8, 2, "O")],), tok, bio.aligned_spans(F.col("t"))) == ([(0, 4, "A")], None)
    words = one(("Hi Ana-Bo!", [(3, 6, "P"), (7, 9, "Q")]), "text string, spans array<struct<start:int,end:int,entity_type:string>>", bio.words_and_bio(F.col("text"), F.col("spans")))
    assert [(w[0], w[3]) for w in words] == [("Hi", "O"), ("Ana", "B-P"), ("-", "O"), ("Bo", "B-Q"), ("!", "O")]
    assert one(("a bb a", ["a", "bb", "a"]), "text string, w array<string>", bio.locate_words(F.col("text"), F.col("w"))) == [("a", 0, 1), ("bb", 2, 4), ("a", 5, 6)]
    assert one(("a", ["b"]), "text string, w array<string>", bio.locate_words(F.col("text"), F.col("w"))) is None
    assert one((["O", None, "B-A"],), "l array<string>", bio.label_ids(F.col("l"), {"O": 0, "B-A": 1})) == [0, -100, 1]
    with pytest.raises(ValueError):
        bio.validate_label_ids({"O": 0, "B": 0})


def toy():
    """A tokenizer of two letters a token, with special tokens around; nested so that workers need no test module."""
    def letters(words):
        ids, at, offs = [1], [None], [(0, 0)]
        for i, w in enumerate(words):
            for k in range(0, len(w), 2):
                ids.append(ord(w[k]))
                at.append(i)
                offs.append((k, min(k + 2, len(w))))
        return [*ids, 2], [*at, None], [*offs, (0, 0)]

    return letters


def windows_by_walking(labels, sizes, special, most, overlap):
    """The same windows found word by word."""
    size = lambda a, b: special + sum(sizes[a:b])
    out, a = [], 0
    while a < len(labels):
        b = a
        while b < len(labels) and size(a, b + 1) <= most:
            b += 1
        while a < b < len(labels) and labels[b].startswith("I-"):
            b -= 1
        if b == a:
            return None
        out.append((a, b))
        if b == len(labels):
            break
        c = b - 1
        while c > a and size(c, b) < overlap:
            c -= 1
        while c > 0 and labels[c].startswith("I-"):
            c -= 1
        a = c if c > a else b
    return out


def test_windows_cut_no_entity():
    rng = random.Random(7)
    for _ in range(500):
        labels = [rng.choice(["O", "O", "B-P", "I-P"]) for _ in range(rng.randrange(1, 30))]
        labels[0] = "O"
        sizes = [rng.randrange(1, 5) for _ in labels]
        most, overlap = rng.randrange(6, 20), rng.randrange(0, 5)
        want = windows_by_walking(labels, sizes, 2, most, overlap)
        try:
            got = list(bio.windows_of(labels, sizes, 2, most, overlap))
        except ValueError:
            got = None
        assert got == want


@pytest.mark.parametrize(("word_ids", "local", "ids"), [([0, 0, 1], [(0, 2), (3, 4), (0, 2)], [5, 6, 7]), ([0, 1], [(0, 3), (0, 2)], [5, 7]), ([0, 0], [(0, 2), (2, 4)], [5, 6]), ([0, 1, 2], [(0, 4), (0, 2), (0, 1)], [5, 6, 7]), ([0, 1], [(0, 5), (0, 2)], [5, 7]), ([0, 1], [(0, 4), (0, 2)], [5, 0])])
def test_bad_alignment_is_an_error(word_ids, local, ids):
    words, labels = ["abcd", "xy"], ["O", "B-P"]
    good = bio.align_words(words, labels, lambda w: ([5, 6, 7], [0, 0, 1], [(0, 2), (2, 4), (0, 2)]), unknown=0)
    assert good["labels"] == ["O", "O", "B-P"]
    with pytest.raises(ValueError):
        bio.align_words(words, labels, lambda w: (ids, word_ids, local), unknown=0)


def test_training_records(spark):
    letters = toy()
    df = spark.createDataFrame([("e", "Hi Anabel now", [(3, 9, "P")])], "example_id string, text string, spans array<struct<start:int,end:int,entity_type:string>>")
    r = bio.encoder_records(df, lambda: letters, {"O": 0, "B-P": 1, "I-P": 2}).first()
    assert r.labels == [-100, 0, 1, 2, 2, 0, 0, -100] and len(r.input_ids) == 8
    short = bio.encoder_records(df, lambda: letters, {"O": 0, "B-P": 1, "I-P": 2}, "first_subword", 4).first()
    assert "max_length" in short.error
    w = bio.window_examples(df, lambda: letters, max_length=6, overlap=1).collect()
    assert [(x.example_id, x.text, [tuple(s) for s in x.spans]) for x in w] == [("e-w0", "Hi Anabel", [(3, 9, "P")]), ("e-w1", "Anabel", [(0, 6, "P")]), ("e-w2", "now", [])]
    long = spark.createDataFrame([("e", "ab Anabel Anabel", [(3, 16, "P")])], df.schema)
    with pytest.raises(Exception, match="max_length"):
        bio.window_examples(long, lambda: letters, max_length=7, overlap=1).collect()
    chat = df.withColumn("messages", normalize.chat_messages(F.col("text"), F.col("spans")))
    render = lambda ms, prompt: "".join(f"<{m['role']}>{m['content']}" for m in ms) + ("<assistant>" if prompt else "")
    chars = lambda: lambda t: ([ord(c) for c in t], [(i, i + 1) for i in range(len(t))])
    c = bio.chat_records(chat, chars, render, 5000).first()
    answer = '{"spans":[{"start":3,"end":9,"entity_type":"P"}]}'
    assert "".join(chr(x) for x in c.labels if x != -100) == answer
    assert bio.chat_records(chat, chars, render, 10).first().error
    made = bio.chat_records(chat, chars, render, 5000)
    assert tuple(bio.overflow_report(made).first()) == (1, 0)
    recs = spark.createDataFrame([(1, [5], [1], [5]), (1, [5, 6], [1, 1], [5, -100])], "b int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    got = sorted((r.input_ids, r.labels) for r in bio.collate(recs, "b", 0).collect())
    assert got == [([5, 0], [5, -100]), ([5, 6], [5, -100])]
    bad = spark.createDataFrame([(1, [5], [1], []), (2, [], [], [])], recs.schema)
    for b in (1, 2):
        with pytest.raises(Exception, match="record needs"):
            bio.collate(bad.filter(F.col("b") == b), "b", 0).collect()


def test_profile_searches_use_the_full_grid(spark, monkeypatch):
    from conftest import DATA
    from spanloom.plans import catalogue

    asked = {}
    monkeypatch.setattr(calibrate, "optimize_profile", lambda df, entities, thresholds, initial, mode: (asked.update({mode: (thresholds, initial)}) or {"A": 0.0}, {}))
    for mode in ("strict", "balanced"):
        catalogue.queries()[f"profile_search_{mode}"](spark, DATA)
    grid = [round(0.05 * i, 10) for i in range(21)]
    assert asked == {"strict": (grid, 0.35), "balanced": (grid, 0.60)}


def test_an_unknown_key_is_an_error_under_later_filters(spark):
    gold = spark.createDataFrame([(1, "Ana")], "k long, text string")
    preds = spark.createDataFrame([(2, [])], "k long, predictions array<struct<start:int,end:int,entity_type:string,score:double>>")
    with pytest.raises(Exception, match="unknown example"):
        metrics.joined(gold, preds, "k").filter("text is not null").collect()


def test_predictions_past_the_text_are_errors(spark, monkeypatch):
    from spanloom.plans import catalogue

    gold = spark.createDataFrame([(1, "Ana was here", [(0, 3, "PERSON")])], "row_id long, text string, spans array<struct<start:int,end:int,entity_type:string>>")

    def merged(*spans, row=1):
        rows = [(row, i, a, b, "PERSON", 0.9) for i, (a, b) in enumerate(spans)]
        windows = spark.createDataFrame(rows, "row_id long, window_index int, span_start int, span_end int, entity_type string, score double")
        monkeypatch.setattr(catalogue, "table", lambda _s, _f, name: gold if name == "dataset_examples" else windows)
        return [(r.span_start, r.span_end) for r in catalogue.queries()["window_predictions_merged"](spark, "").collect()]

    assert merged((0, 3), (8, 12)) == [(0, 3), (8, 12)]
    with pytest.raises(Exception, match="ends past the text of row 1"):
        merged((0, 3), (8, 13))
    with pytest.raises(Exception, match="unknown row 2"):
        merged((0, 3), row=2)
    with pytest.raises(Exception, match="does not lie in its text"):
        outside = gold.withColumn("predictions", F.expr("array(named_struct('start', 1, 'end', 99, 'entity_type', 'PERSON', 'score', 1.0D))"))
        metrics.dataset_score(metrics.document_measures(outside)).collect()
