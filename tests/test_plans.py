"""Plans that hold at scale: ranks, hot keys, shared folders, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import batches
from spanloom.operators import audit, calibrate, datasets, redact
from spanloom.plans import written as w
from spanloom.plans.skew import HOT, attach, hot_from
from spanloom.sources import jsonl, tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_task_holds_a_whole_order(spark):
    df = spark.range(5000).withColumnRenamed("id", "row_id").repartition(3)
    for out in (datasets.sample(df, "row_id", 1500), datasets.split(df, "row_id", 900, 600), datasets.percentiles(df, "row_id", [0.5])):
        assert "SinglePartition" not in plan_of(out)
    got = {r.row_id: r.place for r in datasets.sample(df, "row_id", 1500).collect()}
    order = sorted(range(5000), key=lambda i: __import__("hashlib").md5(f"42:{i}".encode()).hexdigest())
    assert got == {i: k for k, i in enumerate(order[:1500], 1)}
    parts = {r.row_id: r.part for r in datasets.split(df, "row_id", 900, 600).collect()}
    assert [parts[i] for i in order[:1501]] == ["test"] * 600 + ["validation"] * 900 + ["train"] and len(parts) == 5000
    assert datasets.sample(df.limit(0), "row_id", 5).count() == 0 and datasets.sample(df, "row_id", 9000).count() == 5000
    assert [r.row_id for r in datasets.first_rows(df, "row_id", 3).collect()] == [0, 1, 2]


def test_percentiles_of_any_shape(spark):
    rng = random.Random(8)
    for values in ([1], [5] * 40, [rng.choice([1, 1, 1, 2, 10**6]) for _ in range(301)], [rng.gauss(0, 1) for _ in range(700)]):
        df = spark.createDataFrame([(v, ) for v in values] + [(None,)], "v double" if isinstance(values[0], float) else "v int")
        got = {r.fraction: r.value for r in datasets.percentiles(df, "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
        assert got == {f: sorted(values)[round((len(values) - 1) * f)] for f in got} and len(got) == 5
    assert datasets.percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_hot_keys_are_not_shuffled(spark):
    rows = spark.range(20000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"))
    classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    got = attach(rows, classes, ["k"], 20000)
    assert got.count() == 20000 and got.filter("k = 7").select("copies", "first").distinct().collect() == [(13333, 1)]
    assert hot_from(0) == 1 and HOT * hot_from(20000) > 20000
    assert attach(rows.limit(0), classes, ["k"], 0).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"master": "yarn", "applicationId": "a"})

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        w.shared_folder(Far)
    Far.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        w.shared_folder(Far)


def test_intermediates_are_deleted(spark):
    with w.intermediates():
        path = w.written_at(spark.range(5).withColumn("p", F.col("id") % 2), "t", "p")
        assert w.part_rows(path, "p", 1, ["id"]).column("id").to_pylist() == [1, 3]
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path).count()


def test_tables_are_dealt_out_on_request(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert tables.table(spark, tmp_path, "t").rdd.getNumPartitions() == 1
    spark.conf.set(tables.PARTITIONS, "3")
    try:
        assert tables.table(spark, tmp_path, "t").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(tables.PARTITIONS)


def test_line_numbers_over_blocks(spark, tmp_path):
    good = {"id": "a", "text": "x" * 40, "spans": [], "source": "s", "language": "en"}
    lines = [json.dumps(good) if i % 7 else "" if i % 2 else "{" for i in range(200)]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    (tmp_path / "y.jsonl").write_text("\r\n".join(lines[:9]) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = jsonl.read_examples(spark, f"{tmp_path}/*.jsonl")
        assert got.rdd.getNumPartitions() > 1
        rows = {(r.file[-7], r.line_no): r.error for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {("x", i + 1) for i in range(200)} | {("y", i + 1) for i in range(9)}
    assert set(rows) == want and {k for k, e in rows.items() if e} == {k for k in want if (k[1] - 1) % 7 == 0}


def test_bad_hand_labelled_line_is_named(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"id":"1","text":"a","spans":[{"start":0,"end":1,"label":"X"}]}\n\n{"id":"2","text":"b"}\n')
    assert [(r.id, r.spans and len(r.spans)) for r in jsonl.read_hand_labelled(spark, str(p)).orderBy("id").collect()] == [("1", 1), ("2", None)]
    p.write_text('{"id":"1"}\n\nnope\n')
    with pytest.raises(Exception, match=r"h.jsonl:3"):
        jsonl.read_hand_labelled(spark, str(p)).collect()


def test_nested_settings(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("a: 1\nb:\n  c: yes it is # note\n  d:\n    - 1\n    - x\n  e: 'q # r'\nf:\n- 0.5\n- true\ng: 1e-3\nh:\n")
    got = jsonl.read_settings(str(p))
    assert got["a"] == 1 and got["b"]["c"] == "yes it is" and got["b"]["d"] == [1, "x"] and got["f"] == [0.5, True] and got["g"] == 1e-3 and got["h"] is None
    p.write_text("only words")
    with pytest.raises(ValueError):
        jsonl.read_settings(str(p))


def test_mappings_are_written(spark, tmp_path):
    df = spark.createDataFrame([([("[A_1]", "x")],), (None,)], "mapping array<struct<placeholder:string,value:string>>")
    jsonl.write_mapping(df, f"{tmp_path}/m")
    assert [r.value for r in spark.read.text(f"{tmp_path}/m").filter("value <> ''").collect()] == ['[{"placeholder":"[A_1]","value":"x"}]']


def test_audits_of_nulls_and_hot_texts(spark):
    rows = [("train", "Hot", 1), ("train", None, 2)] + [("test", "HOT ", 10 + i) for i in range(50)] + [("test", None, 90), ("dev", "x", 91)]
    df = spark.createDataFrame(rows, "split string, text string, id int")
    got = {r.part: (r.target_examples, r.matching_examples) for r in audit.duplicate_stats(df, folded=True).collect()}
    assert got == {"test": (51, 50), "dev": (1, 0)}
    assert [r.id for r in audit.duplicate_samples(df, "id", folded=True, k=3).orderBy("rank").collect()] == [10, 11, 12]
    assert audit.duplicate_stats(df.limit(0)).count() == 0


def test_long_documents_stay_linear():
    """50,000 spans in one text; each kernel is far below what a quadratic one would take."""
    import time

    n = 50_000
    text = "ab@c.de 12 " * n
    spans = [(11 * i, 11 * i + 7, "EMAIL" if i % 2 else "X") for i in range(n)]
    began = time.time()
    out, mapping, error = batches.replace_one(text, spans)
    assert error is None and mapping[-1] == (f"[EMAIL_{n // 2}]", "ab@c.de")
    assert batches.put_back_all(out, mapping) == (text, None)
    assert len(batches.labelled_words(text, spans)) == 2 * n
    assert len(batches.merged_spans([(k, a + k, b, t, 0.5) for a, b, t in spans for k in (0, 1)])) == n
    assert len(batches.greedy([(a, b, t, 1.0) for a, b, t in spans] * 2)) == n
    assert time.time() - began < 20


def test_put_back_in_one_pass_equals_one_by_one():
    rng = random.Random(9)
    for _ in range(2000):
        marks = [f"[{rng.choice('AB')}_{rng.randrange(4)}]" for _ in range(rng.randrange(6))]
        text = "".join(rng.choice([*marks, "x", "[", "]", " "]) for _ in range(rng.randrange(12))) + "".join(marks)
        mapping = [(m, rng.choice(["v", "w [", "", "A_1"])) for m in marks]
        assert batches.put_back_all(text, mapping) == batches.put_back_one(text, mapping)


def test_selection_report_and_profiles_written(spark, tmp_path):
    rows = [("x" * 20, [(0, 4, "P")], [(0, 4, "P", 0.4), (6, 9, "P", 0.2)])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int,entity_type:string>>, predictions array<struct<start:int,end:int,entity_type:string,score:double>>")
    found, scores = calibrate.selection_report(df, ["P"], [0.0, 0.3, 0.9])
    assert found == {"balanced": {"P": 0.3}, "strict": {"P": 0.35}}
    got = {(r.mode, r.choice): (r.predicted, r.exact_f1, r.leak_rate) for r in scores.collect()}
    assert got == {("balanced", "anchor"): (0, 0.0, 1.0), ("balanced", "found"): (1, 1.0, 0.0), ("strict", "anchor"): (1, 1.0, 0.0), ("strict", "found"): (1, 1.0, 0.0)}
    calibrate.write_profiles(found, f"{tmp_path}/p.json")
    assert redact.load_thresholds("strict", f"{tmp_path}/p.json") == found["strict"]
    with pytest.raises(ValueError):
        calibrate.write_profiles({"strict": {"P": 2.0}}, f"{tmp_path}/q.json")
