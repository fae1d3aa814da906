"""Values and tables at the edges: no cap changes a result, no null loses a row."""

import json
import types

import pytest
from pyspark.sql import functions as F

from mathloom.functions import numbers, text
from mathloom.operators import curate, keyed
from mathloom.sources import files, shared
from mathloom.sources.generate import with_retries


@pytest.mark.parametrize("value, want", [("1e19", "10000000000000000000"), ("9223372036854774784", "9223372036854774784"), ("1" + "0" * 59, "1" + "0" * 59), ("-1e19", "-10000000000000000000"), ("0.000001", "0.000001"), ("2.50", "2.5"), ("inf", None), ("nan", None)])
def test_float_text(spark, value, want):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(numbers.float_text(numbers.to_double(F.col("v")))).first()[0] == want


def test_round_match_of_many_places(spark):
    rows = [("0.123456789012345", "0.123456789012345", True), ("0.123456789012345", "0.123456789012346", False), ("1.5", "1.5000000000000001", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in numbers.with_round_match(df, "got", "a", "b").collect())


def test_perturbed(spark):
    draws = [0.0, 0.25, 0.5, 0.75, 0.999]
    df = spark.createDataFrame([(v, x) for v in ("１２", "12", "0", "0.123456789", "2.5", "7.") for x in draws], "v string, x double")
    got = df.select("v", curate.perturbed(F.col("v"), F.col("x"), 0.3).alias("new")).collect()
    for v, new in got:
        if v in ("１２", "12"):
            assert new == str(round(float(new))) and 8 <= int(new) <= 16
        elif v == "0":
            assert 1 <= int(new) <= 10
        elif v == "0.123456789":
            assert abs(float(new) - 0.123456789) <= 0.0371 and len(new.split(".")[1]) <= 9
    assert any(len(new.split(".")[1]) > 6 for v, new in got if v == "0.123456789")


def test_last_by_key_with_null_order(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", 2, 2), ("b", None, 3), (None, 5, 4)], "id string, pos int, v int")
    assert {tuple(r) for r in keyed.last_by_key(df, "id", "pos").collect()} == {("a", None, 1), ("b", 2, 2), (None, 5, 4)}


def test_nested_content(spark):
    deep = ["a", {"content": [{"text": {"content": {"text": ["b", {"text": "c"}]}}}, None]}]
    df = spark.createDataFrame([(json.dumps(deep),), (json.dumps({"text": None, "content": "x"}),), (json.dumps({"k": 1}),)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0] for r in df.select(F.expr(text.variant_text("v"))).collect()] == ["a\nb\nc\n", "", '{"k":1}']
    assert spark.range(1).select(text.sanitize_parts(F.array(F.lit('"a'), F.lit(None), F.lit("\\nb ")))).first()[0] == "a\nb"


def test_checkpoints(tmp_path):
    best = tmp_path / "run" / "best"
    best.mkdir(parents=True)
    (best / "weights.bin").write_text("x")
    assert files.latest_checkpoint(str(best)) is None
    (tmp_path / "run" / "checkpoint-9").mkdir()
    (tmp_path / "run" / "checkpoint-10").mkdir()
    assert files.latest_checkpoint(str(best)).endswith("checkpoint-10") and files.latest_checkpoint(str(tmp_path / "run")).endswith("checkpoint-10")
    (best / "adapter_config.json").write_text("{}")
    assert files.latest_checkpoint(str(best)) == str(best)
    (tmp_path / "run" / "adapter_config.json").write_text("{}")
    assert files.latest_checkpoint(str(tmp_path / "run")) == str(tmp_path / "run")


def test_shared_folder_is_asked_for_on_a_cluster():
    conf = types.SimpleNamespace(get=lambda *_: None)
    context = types.SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError):
        shared.shared_dir(types.SimpleNamespace(conf=conf, sparkContext=context))


def test_tables_are_removed(spark):
    with shared.tables(spark):
        kept = shared.materialize(spark.range(3), "x")
        assert kept.count() == 3
        path = kept.inputFiles()[0]
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_only_what_fails_is_null():
    def generate(prompts):
        if "bad" in prompts:
            raise OSError
        return [p.upper() for p in prompts]

    run = with_retries(generate, attempts=2, sleep=lambda s: None)
    assert run(["a", "bad", "c", "d", "e"]) == ["A", None, "C", "D", "E"]


def test_rank_and_split(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    ranked = curate.with_rank(df, [F.xxhash64("id"), F.col("id")])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 1001))
    hashes = [r[0] for r in ranked.orderBy("rank").select(F.xxhash64("id")).collect()]
    assert hashes == sorted(hashes)
