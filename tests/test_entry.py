"""The driver contract, the stream and the command line."""

import json

from conftest import DATA

import __spark_entry__ as entry
from spanloom import cli
from spanloom.operators.redact import Scrubber
from spanloom.streaming.scrub import scrub_stream, write_stream


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "redacted_text", "n_spans"] and df.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_stay_narrow_and_pruned(spark):
    docs = Scrubber().scrub(spark.read.parquet(f"{DATA}/documents.parquet")).select("doc_id", "redacted_text")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "struct<doc_id:bigint,text:string>" in plan


def test_stream(spark, tmp_path):
    rows = [(1, "a@b.cd"), (2, None), (3, "none")]
    spark.createDataFrame(rows, "id int, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, text string").parquet(f"{tmp_path}/in")
    write_stream(scrub_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.id: r.redacted_text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: "[EMAIL_1]", 2: None, 3: "none"}
    assert Scrubber().scrub(spark.createDataFrame(rows, "id int, text string"), entities=set()).filter("size(spans) > 0").count() == 0


def test_cli(spark, tmp_path, capsys):
    assert cli.main(["Mail a@b.cd", "--mapping-out", str(tmp_path / "m.json")]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1] == "Mail [EMAIL_1]"
    assert json.loads((tmp_path / "m.json").read_text()) == [{"placeholder": "[EMAIL_1]", "value": "a@b.cd"}]
    for argv in ([], ["", "--file", ""], ["x", "--file", "y"]):
        try:
            cli.main(argv)
            raise AssertionError
        except SystemExit as e:
            assert "exactly one" in str(e)
