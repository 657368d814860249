"""Consistent form, languages, tokens, splitting, personal data."""

import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DATA
from spanloom.llm import canon, language, personal, queries, split, tokens

ODD = st.text(st.sampled_from("aAeеЕ éé́​‍👩💻ﬁｆ　 –-.ßΒν1١\n\t"), max_size=40)


@pytest.mark.parametrize(("a", "b"), [("Ｄeаr", "Dear"), ("oﬃce", "office"), ("é", "é"), ("a­​b", "ab"), ("a b", "a b"), ("ΒΕ", "BE"), ("K", "K"), ("Thĳs", "Thijs"), ("e​́", "é")])
def test_same_look(a, b):
    assert canon.canon(a) == canon.canon(b)


@pytest.mark.parametrize(("a", "b"), [("a", "á"), ("a", "A"), ("a-b", "a–b"), ("a,b", "a.b"), ("oe", "œ"), ("👩‍💻", "👩💻"), ("1", "l"), ("a  b", "a b")])
def test_different_look(a, b):
    assert canon.canon(a) != canon.canon(b)


@given(ODD)
@settings(max_examples=300, deadline=None)
def test_form_is_stable_and_mapped(t):
    form, at = canon.canon_map(t)
    assert form == canon.canon(t) == canon.canon(form) and canon.raised(t) == canon.raised(form)
    if at is not None:
        assert len(at) == len(form) + 1 and at[-1] == len(t) and list(at) == sorted(at)


@pytest.mark.parametrize(("a", "b"), [("𝐀𝒃𝟙", "Ab1"), ("Ⅳ ⅷ", "IV viii"), ("ᎪꓐԼ ɑ", "ABL a"), ("می\u200c x", "می x"), ("a\u200cb", "ab")])
def test_more_rules(a, b):
    assert canon.canon(a) == b == canon.canon(b)


@pytest.mark.parametrize("t", ["می\u200cخواهم", "क्\u200dष", "क्\u200cष"])
def test_joiners_that_show_stay(t):
    assert canon.canon(t) == t != canon.canon(t.replace("\u200c", "").replace("\u200d", ""))


def test_two_rules_for_one_sign_are_an_error(monkeypatch):
    monkeypatch.setattr(canon, "RULES", (*canon.RULES, lambda ch: "z" if ch == "ﬁ" else None))
    with pytest.raises(ValueError, match="two rules"):
        canon._compile()
    monkeypatch.setattr(canon, "RULES", (lambda ch: "b" if ch == "a" else "a" if ch == "b" else None,))
    with pytest.raises(ValueError):
        canon._compile()


@given(st.text(st.sampled_from("aßŉﬁА́ｗ\u200b\u200cم н𝐀 "), max_size=20))
@settings(max_examples=300, deadline=None)
def test_capitals_are_mapped(t):
    up, at = canon.raised_map(t)
    assert up == canon.raised(t) and (at is None and len(up) == len(t) or len(at) == len(up) + 1 and list(at) == sorted(at))
    assert len(language.places_in(t)) == len(language.words_in(t))


def test_pairs(spark):
    rows = [(1, "Dear", 0), (2, "Ｄear", 0), (3, "Dear", 0), (4, "dear", 0), (5, None, 0), (6, "", 0), (7, "​", 0)]
    df = spark.createDataFrame(rows, "row_id long, text string, c1 int")  # c1: a clashing name
    got = sorted(tuple(r) for r in canon.lookalike_pairs(df).collect())
    assert got == [(1, 2), (2, 3), (6, 7)]
    assert canon.lookalike_pairs(df.limit(0)).count() == 0
    forms = {r.row_id: r.f for r in df.select("row_id", canon.consistent_form(F.col("text")).alias("f")).collect()}
    assert forms[2] == "Dear" and forms[5] is None and forms[7] == ""


def test_pairs_against_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/dataset_examples.parquet").select("row_id", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(canon.canon(r.text), []).append(r)
    want = {(a.row_id, b.row_id) for v in by.values() for a in v for b in v if a.row_id < b.row_id and a.text != b.text}
    assert {tuple(r) for r in queries.p1_found(spark, DATA).collect()} == want


def test_language_codes(one):
    for label, code in [("en-US", "en"), (" DE ", "de"), ("português", "pt"), ("rus", "ru"), ("??", None), ("mul", None), ("", None), (None, None), ("en_GB", "en")]:
        assert one((label,), "l string", language.code_of(F.col("l"))) == code


def test_languages(spark):
    df = spark.read.parquet(f"{DATA}/dataset_examples.parquet")
    model = language.fit(df)
    mixed = "Der Vertrag endet am Montag, und die Rechnung wurde doppelt auf das Konto gebucht. El usuario entró desde la red y cambió el teléfono por otro número."
    assert [k for k, _, _ in model.stretches(mixed)] == ["de", "es"]
    assert [k for k, _, _ in model.stretches(mixed.upper())] == ["de", "es"]
    assert all(0 <= c <= 1 for _, c, _ in model.stretches(mixed)) and model.stretches("") == [] and model.stretches("123 #4") == []
    rows = [(1, mixed, "de"), (2, "We checked the number and sent the signed form last night.", "EN"), (3, "We checked the number and sent the signed form last night.", None), (4, None, None), (5, "12", None)]
    got = sorted(tuple(r) for r in language.language_cases(spark.createDataFrame(rows, "row_id long, text string, language string"), model).collect())
    assert got == [(1, 1, "de"), (1, 2, "es"), (3, 1, "en")]
    test = df.filter("row_id % 7 = 3").select("text", language.code_of(F.col("language")).alias("k")).filter("k is not null").collect()
    right = sum(len(s := model.stretches(r.text)) > 0 and r.k in {x[0] for x in s} for r in test)
    assert right > 0.9 * len(test)  # a few labels are wrong
    long = " ".join([mixed] * 200)
    assert len(model.stretches(long)) == 400


def small_model(**words):
    return language.Model({k: Counter(words.get(k, {})) for k in language.LANGUAGES})


def test_places_and_other_languages(spark):
    df = spark.createDataFrame([(i, t, "en", []) for i, t in enumerate(["the dog and the cat are in the house today", "der Hund und die Katze sind heute in dem Haus"] * 40)], "row_id long, text string, language string, spans array<struct<start:int,end:int,entity_type:string>>")
    df = df.withColumn("language", F.when(F.col("row_id") % 2 == 0, "en").otherwise("de"))
    model = language.fit(df)
    en, de = "The dog and the cat are in the house today.", "ﬁ Der Hund und die Katze sind heute in dem Haus."
    rows = [(1, f"{en} {de}", None), (2, "kukuruku zaqwe mnbv lkjhg poiuy trewq", None), (3, de, "x" * 3), (4, "", None), (5, None, None)]
    got = {r.row_id: r.segments for r in language.languages(spark.createDataFrame(rows, "row_id long, text string, language string"), model).collect()}
    (a, b) = got[1]
    assert (a.language, b.language, a.start, a.end, b.end) == ("en", "de", 0, b.start, len(rows[0][1])) and abs(b.start - len(en)) < 6
    assert [(s.language, s.start, s.end) for s in got[2]] == [("und", 0, len(rows[1][1]))] and got[2][0].confidence > 0.8
    assert [s.language for s in got[3]] == ["de"] and got[4] == got[5] == []


def test_unseen_words_are_walked_to_their_end():
    model = small_model(de={"STRASSE": 9}, en={"STREET": 9})
    assert (model.row("Q" * 60 + "STRASSE") == 0).sum() < len(language.LANGUAGES)
    assert (model.row("Q" * 60) == 0).all()


def test_a_change_between_two_gaining_languages():
    import numpy as np

    model = small_model()
    rows = np.full((3, len(language.LANGUAGES)), -6.0)
    rows[0, 0] = rows[1, 1] = 0.0  # AA is German, BB is English, and Spanish is best in total
    rows[:2, 2] = -2.5
    model.rows, model.number, model.fixed = rows.astype(np.float32), {"AA": 0, "BB": 1}, 3
    assert [(k, n) for k, _, n in model.stretches("AA AA AA BB BB BB")] == [("de", 3), ("en", 3)]
    rng = np.random.default_rng(0)
    for _ in range(300):
        scores = rng.choice([-6.0, -3, -1, 0], (rng.integers(1, 14), 3), p=[0.2, 0.3, 0.3, 0.2])
        scores -= scores.max(axis=1, keepdims=True)
        run = np.concatenate([np.zeros((1, 3)), np.cumsum(scores, axis=0)])
        base = int(run[-1].argmax())
        if language._stays(run, base):
            assert scores[np.arange(len(scores)), p := language._path(scores)].sum() - language.SWITCH * np.count_nonzero(np.diff(p)) <= run[-1, base]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


PIECES = st.text(st.sampled_from("aаé  　\n\r\t'sd.1١²_-👩ß<|endoftext|>ع本"), max_size=60)


@given(st.lists(PIECES, max_size=6))
@settings(max_examples=200, deadline=None)
def test_encoding_equals_the_library(texts):
    import pyarrow as pa

    enc = tokens.ChunkEncoder(tokens.encoder())
    want = reference(texts) if texts else []
    assert tokens.encode_batch(pa.array(texts, pa.string()), enc).to_pylist() == want
    assert [tokens.encoder().pieces(t) for t in texts] == [tokens.encoder().any.findall(t) for t in texts]


def test_corpus_encoding(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, DATA).collect()}
    want = dict(zip((r.doc_id for r in docs), reference([r.text or "" for r in docs])))
    assert got == want
    enc = tokens.ChunkEncoder(tokens.encoder(), room=3)  # forgetting must not change results
    text = (docs[0].text or "x ") * 50
    import pyarrow as pa

    assert tokens.encode_batch(pa.array([text, text]), enc).to_pylist()[1] == reference([text])[0]


def test_token_counts(spark):
    rows = [(1, "a", "Hello Merosport Merosport"), (2, "a", None), (3, "b", ""), (4, None, "Hello"), (5, "a", "Zürich " * 300)]
    df = spark.createDataFrame(rows, "id long, source string, text string")
    got = {r.id: r.tokens for r in tokens.token_counts(df, ["id", "source"]).collect()}
    assert got == dict(zip((r[0] for r in rows), map(len, reference([r[2] or "" for r in rows]))))
    assert tokens.token_counts(df.limit(0), ["id"]).count() == 0
    total = queries.p3_budget(spark, DATA).agg(F.sum("tokens"), F.sum("texts")).first()
    texts = [r.text or "" for t in ("dataset_examples", "documents") for r in spark.read.parquet(f"{DATA}/{t}.parquet").select("text").collect()]
    assert tuple(total) == (sum(map(len, reference(texts))), len(texts))


@given(st.text(st.sampled_from("ab. \n#-é́👩‍💻本。;"), max_size=600), st.integers(12, 60))
@settings(max_examples=200, deadline=None)
def test_splitting_covers(t, limit):
    parts = split.split_text(t, limit, 5)
    assert parts[0][0] == 0 and parts[-1][1] == len(t)
    if len(t) > limit:
        for (_, end, _), (start, _, fresh) in zip(parts, parts[1:]):
            assert fresh == end and fresh - 5 <= start <= fresh
        assert all(a <= f < b and b - a <= limit for a, b, f in parts)


def test_splitting_prefers_structure():
    text = "# One\n" + "Word one. " * 30 + "\n\n# Two\n" + "Word two. " * 30
    assert text[split.split_text(text, 340, 20)[0][1] :].startswith("# Two")
    assert [b - a for a, b, _ in split.split_text("x" * 5000, 2000, 200)] == [1800, 2000, 1600]
    with pytest.raises(ValueError):
        split.split_text("x", 10, 10)


def pieces(text, limit):
    return [text[f:b] for _, b, f in split.split_text(text, limit, 0)]


def test_siblings_merge_within_their_parent():
    a, a1, a2, b = "# A\n" + "a" * 20 + "\n", "## A1\n" + "b" * 50 + "\n", "## A2\n" + "c" * 60 + "\n", "# B\n" + "d" * 50 + "\n"
    assert pieces(a + a1 + a2 + b, 170) == [a + a1 + a2, b]
    assert pieces(a + a1 + a2 + b, 100) == [a + a1, a2, b]  # A2 is no sibling of B
    assert pieces(a + "x " * 60 + "\n" + a1, 100)[-1] == a1


def test_nested_lists_setext_and_markup():
    assert pieces("Intro:\n- one aaaa\n  - one b bbbb\n  - one c cccc\n- two dddd\n- three eee\n", 50) == ["Intro:\n- one aaaa\n  - one b bbbb\n  - one c cccc\n", "- two dddd\n- three eee\n"]
    title = "Title text\n==========\nbody body body body\n\n"
    assert pieces("Para one here.\n\n" + title + "Second\n------\nmore more more more", 45) == ["Para one here.\n\n", title, "Second\n------\nmore more more more"]
    assert pieces("Words words words.\n\n" + title, 30)[1] == "Title text\n==========\n"
    assert pieces("<div><p>aaaa aaaa</p><p>bbbb bbbb</p></div><div><p>cccc cccc</p></div>", 45) == ["<div><p>aaaa aaaa</p><p>bbbb bbbb</p></div>", "<div><p>cccc cccc</p></div>"]
    assert pieces("<ul><li>aaaa aaaa<li>bbbb bbbb<li>cccc</ul> tail text", 25) == ["<ul><li>aaaa aaaa", "<li>bbbb bbbb", "<li>cccc</ul> ", "tail text"]
    assert pieces("Text.\n\n```\n# no heading\n\nx\n```\n\n# One\nyy", 35) == ["Text.\n\n```\n# no heading\n\nx\n```\n\n", "# One\nyy"]


def test_pieces_are_checked(spark):
    from spanloom.llm.queries import p4_checked

    assert {(r.rebuilt, r.within) for r in p4_checked(spark, DATA).collect()} == {(True, True)}


def test_pieces_carry_spans(spark):
    text = "Sentence number one. " * 200
    spans = [(0, 8, "A"), (1700, 1900, "B"), (4190, 4300, "BAD"), (None, 3, "BAD"), (9, 3, "BAD")]
    df = spark.createDataFrame([(1, text, spans), (2, text, None), (3, "short", []), (4, None, None), (5, "", None)], "row_id long, text string, spans array<struct<start:int,end:int,entity_type:string>>")
    got = split.split_oversized(df).collect()
    assert {r.row_id for r in got} == {1, 2}
    for r in got:
        assert r.piece_text == text[r.piece_start : r.piece_end] and len(r.piece_text) <= 2000 and (r.row_id == 1) == (r.piece_spans is not None)
        for s in r.piece_spans or []:
            assert 0 <= s.start < s.end <= len(r.piece_text)
    seen = {(s.entity_type, s.start + r.piece_start, s.end + r.piece_start) for r in got for s in r.piece_spans or [] if not s.clipped}
    assert ("A", 0, 8) in seen and ("B", 1700, 1900) in seen
    assert split.split_oversized(df.limit(0)).count() == 0


LEX = personal.Lexicon({"ANA", "JOSE", "HИHA"}, {"AND", "LOST", "THE", "WITH", "CALL"}, {("CALL", "ME")})


def mentions(t):
    return [(t[a:b], k) for a, b, k in personal.find(t, LEX)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Ana Ferbelton lost the key", [("Ana Ferbelton", "PERSON")]), ("Dr Ferbelton, José and the rest", [("Ferbelton, José", "PERSON")]), ("with A. Ferbelton-Gorlan.", [("A. Ferbelton-Gorlan", "PERSON")]),
        ("ANA B. FERBELTON", [("ANA B. FERBELTON", "PERSON")]), ("Ana and José lost", []), ("mail a.b+c@x-y.example.org.", [("a.b+c@x-y.example.org", "EMAIL")]),
        ("to joe.x (at) foo (dot) example (dot) com now", [("joe.x (at) foo (dot) example (dot) com", "EMAIL")]), ("joe[at]foo.test", [("joe[at]foo.test", "EMAIL")]),
        ("on +44 (0)98 943 88 52.", [("+44 (0)98 943 88 52", "PHONE")]), ("at 043/4285299 or 472.555.2916", [("043/4285299", "PHONE"), ("472.555.2916", "PHONE")]),
        ("call zero four three, one two five five two nine", [("zero four three, one two five five two nine", "PHONE")]),
        ("lot 974-951-48, version 956.18.489, host 10.20.30.40, account 4934357272", []), ("passport no.: GL8206176", [("GL8206176", "ID_NUMBER")]), ("SSN # 960-59-1763;", [("960-59-1763", "ID_NUMBER")]),
        ("número de la seguridad social: 1 01 60 22 199 315 de", [("1 01 60 22 199 315", "ID_NUMBER")]), ("удостоверение TLJ 653852 на", [("TLJ 653852", "ID_NUMBER")]),
        ("at 23a Tanborveler Ave, x", [("23a Tanborveler Ave", "ADDRESS")]), ("Am Percas 154B, y", [("Am Percas 154B", "ADDRESS")]), ("327, rue de Bórbornov, z", [("327, rue de Bórbornov", "ADDRESS")]),
        ("calle Dördulnar 63, 09462", [("calle Dördulnar 63", "ADDRESS")]), ("ул. Борхелов, 161 в", [("ул. Борхелов, 161", "ADDRESS")]), ("Danlankirhoferstraße 351 in", [("Danlankirhoferstraße 351", "ADDRESS")]),
        ("А​nа Fеrb­elton​ lost", [("А​nа Fеrb­elton", "PERSON")]), ("ｊｏｅ＠ｆｏｏ．ｔｅｓｔ", [("ｊｏｅ＠ｆｏｏ．ｔｅｓｔ", "EMAIL")]), ("", []), ("nothing here", []),
    ],
)
def test_mentions(text, want):
    assert mentions(text) == want


FEW = personal.Lexicon({"ANNA"}, {"CALL", "MY", "IS"}, set())


@pytest.mark.parametrize(("text", "want"), [
    ("Call 5 five 5 one two three four now", [("5 five 5 one two three four", "PHONE")]),
    ("Call plus four nine, one seven zero - five five one two.", [("plus four nine, one seven zero - five five one two", "PHONE")]),
    ("Neun, one dog and two cats", []), ("1 2 3 4 5 6 7 8", []),
    ("My SSN is 123-45-6789.", [("123-45-6789", "ID_NUMBER")]), ("912-45-6789 or 000-45-6789, 123-00-6789", [("912-45-6789", "ID_NUMBER")]), ("123-45-6789", [("123-45-6789", "ID_NUMBER")]),
    ("passport number: one two three four five six seven eight nine!", [("one two three four five six seven eight nine", "ID_NUMBER")]),
    ("12345678Z but 12345678A", [("12345678Z", "ID_NUMBER")]), ("Mein Reisepass lautet C01X00T47", [("C01X00T47", "ID_NUMBER")]),
    ("to аnnа.b [at] mаil (dot) example dot", [("аnnа.b [at] mаil (dot) example", "EMAIL")]), ("ｊｉｍ AT site DOT example DOT org, bye", [("ｊｉｍ AT site DOT example DOT org", "EMAIL")]),
    ("look (at) this. dot net", []),
])
def test_disguises(text, want):
    assert [(text[a:b], k) for a, b, k in personal.find(text, FEW)] == want


@given(st.lists(st.sampled_from(["four", "5", " ", " [at] ", "b", "(dot)", ",", " DOT ", "AT", "é", "\n", "plus "]), max_size=25))
@settings(max_examples=200, deadline=None)
def test_plain_text_is_mapped(parts):
    low = personal.fold("".join(parts))
    bare, back, spoken = personal.plain(low)
    if back is not None:
        assert len(back) == len(bare) + 1 and back[-1] == len(low) and list(back) == sorted(back)
        assert all(low[back[i]] == c for i, c in enumerate(bare) if back[i + 1] - back[i] == 1 and c not in "@.0123456789+")
    assert all(bare[a:b].lstrip("+").isdigit() for a, b in spoken)


def test_long_texts_stay_linear():
    rng = random.Random(0)
    blob = "".join(rng.choice("ABCxyz019+/") for _ in range(200_000))
    assert all(k in personal.TYPES for _, _, k in personal.find(blob + " " + "a" * 100_000, LEX))


def test_held_out_recall(spark):
    df = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/dataset_examples.parquet").filter("spans is not null")
    lex = personal.fit_lexicon(df.filter("row_id % 4 <> 0"))
    group = {k: "ID_NUMBER" for k in ("SOCIAL_SECURITY_NUMBER", "PASSPORT", "TAX_ID", "DRIVER_LICENSE")}
    hit = total = extra = 0
    for r in df.filter("row_id % 4 = 0").collect():
        gold = {(s.start, s.end, group.get(s.entity_type, s.entity_type)) for s in r.spans}
        gold = {g for g in gold if g[2] in personal.TYPES}
        got = set(personal.find(r.text, lex))
        hit, total, extra = hit + len(gold & got), total + len(gold), extra + len(got - gold)
    assert hit > 0.98 * total and extra < 0.02 * total


def test_scrubbed(spark):
    df = spark.createDataFrame([(1, "Ana Ferbelton, a@b.test, Ana Ferbelton"), (2, None), (3, "")], "id long, text string")
    got = {r.id: r for r in personal.scrubbed(df, LEX, ["id"]).collect()}
    assert got[1].scrubbed == "[PERSON_1], [EMAIL_1], [PERSON_2]" and got[2].scrubbed is None and got[2].found is None and got[3].scrubbed == ""
    assert personal.detect(df.limit(0), LEX, ["id"]).count() == 0
    assert re.sub(r"\[PERSON_\d\]", "Ana Ferbelton", got[1].scrubbed).replace("[EMAIL_1]", "a@b.test") == "Ana Ferbelton, a@b.test, Ana Ferbelton"
