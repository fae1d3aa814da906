"""Joins, splits, repair, sources and streaming on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from mathloom.operators import curate, evaluate, keyed, repair
from mathloom.sources import config, files, generate
from mathloom.streaming import scoring

COT = "pos bigint, id string, question string, answer string, cot string, api_answer string, answer_match boolean, status string, wrong_cot string, wrong_answer string, wrong_status string"


def cot(spark, *rows):
    names = [c.split()[0] for c in COT.split(", ")]
    base = dict(zip(names, (0, "1", "q1 2", "5", "c", "5", True, "ok", None, None, None)))
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], COT)


def test_plan(spark):
    df = cot(
        spark,
        {"pos": 1, "cot": ""},
        {"pos": 2},
        {"pos": 3, "wrong_status": "failed"},
        {"pos": 4, "answer_match": False, "api_answer": "6"},
        {"pos": 5, "answer_match": False, "api_answer": "6", "wrong_answer": "6.0", "wrong_cot": "w"},
        {"pos": 6, "answer_match": False, "api_answer": "6", "wrong_answer": "7", "wrong_cot": "w"},
        {"pos": 7, "cot": "用\\times得"},
        {"pos": 8, "answer_match": None, "wrong_cot": "w"},
    )
    got = {r["pos"]: r for r in repair.plan(df).collect()}
    assert {k: r["repair_type"] for k, r in got.items()} == {1: "A", 2: "B-fresh", 3: "B-failed", 4: "C", 5: "ok", 7: "A", 8: "ok"}  # 6 is deleted
    assert (got[5]["answer"], got[5]["answer_match"]) == ("6", True)
    assert (got[7]["wrong_cot"], got[7]["wrong_status"], got[7]["cot"]) == ("用\\times得", "latex_demoted", "")


def test_generation_phases(spark):
    df = repair.recycle(repair.plan(cot(spark, {"id": "a", "answer_match": False, "api_answer": "6", "cot": "x" * 12}, {"id": "b", "answer_match": False, "api_answer": "6", "cot": "x" * 12}, {"id": "c", "cot": None})))
    replies = spark.createDataFrame([("a", "n", "6"), ("b", "n", "5"), ("c", "n", "")], "id string, new_cot string, new_answer string")
    got = {r["id"]: r for r in repair.apply_right(df, replies).collect()}
    assert got["a"]["wrong_status"] == "ground_truth_suspect" and got["a"]["wrong_cot"] == ""
    assert got["b"]["answer_match"] and got["b"]["wrong_status"] == "recycled"
    assert got["c"]["cot"] is None
    wrong = spark.createDataFrame([("c", "w", "9")], "id string, new_cot string, new_answer string")
    assert {r["id"]: r["wrong_answer"] for r in repair.apply_wrong(df, wrong, "hard_fallback").collect()}["c"] == "9"


def test_keyed(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), (None, 3, "z")], "id string, pos int, v string")
    last = {r["id"]: r["v"] for r in keyed.last_by_key(rows, "id", "pos").collect()}
    assert last == {"a": None, "b": "y", None: "z"}
    assert keyed.upsert(rows.where("id = 'b'"), rows.where("id = 'a'"), "id", "pos").count() == 2
    assert keyed.todo(rows, rows.where("id = 'a'")).count() == 2
    assert keyed.delete(rows, rows.where("id = 'b'")).count() == 3


def test_split_and_rank(spark):
    df = spark.range(1003).withColumnRenamed("id", "k")
    got = curate.split(df, "k")
    assert got.groupBy("split").count().rdd.collectAsMap() == {"train": 902, "val": 101}
    ranks = [r["rank"] for r in curate.with_rank(df, [F.col("k").desc()]).orderBy("rank").collect()]
    assert ranks == list(range(1, 1004))
    assert curate.split(df.limit(0), "k").count() == 0


def test_augment(spark):
    df = spark.createDataFrame([("7", "有3个和4.25元", "i"), ("10", "只有1个", None), ("2", "0和12", None)], "id string, question string, instruction string")
    got = curate.augment(df, copies=2).orderBy(F.col("id").cast("int")).collect()
    assert [r["source_id"] for r in got] == ["2", "2", "7", "7"] and [r["id"] for r in got] == ["3", "4", "5", "6"]
    assert all(r["answer"] == "" and r["augmented"] for r in got)
    assert [r["question"] for r in curate.augment(df, copies=2).orderBy("id").collect()] == [r["question"] for r in sorted(got, key=lambda r: r["id"])]


def test_accuracy(spark):
    refs = spark.createDataFrame([("1", "0.6"), ("2", "5"), ("3", "9")], "id string, answer string")
    preds = spark.createDataFrame([("1", "3/5"), ("2", "4")], "id string, ret string")
    r = evaluate.accuracy(evaluate.evaluate(preds, refs)).first()
    assert (r["correct"], r["total"], r["accuracy"]) == (1, 2, 0.5)
    assert evaluate.accuracy(evaluate.evaluate(preds.limit(0), refs)).first()["accuracy"] == 0.0
    a = spark.createDataFrame([(0, "1")], "pos int, value string")
    assert evaluate.zipped(a, a).first()["correct"]
    with pytest.raises(ValueError):
        evaluate.zipped(a, a.limit(0))


def test_files(spark, tmp_path):
    p = tmp_path / "raw.json"
    p.write_text(json.dumps([{"id": 2, "question": ["a", "b"], "answer": None}, {"id": "1", "question": {"text": "t"}, "answer": "5", "instruction": "i"}]))
    got = files.read_problems(spark, str(p)).orderBy("pos").collect()
    assert [(r["id"], r["question"], r["answer"], r["instruction"]) for r in got] == [("2", "a\nb", "", ""), ("1", "t", "5", "i")]
    s = tmp_path / "sub.csv"
    s.write_text("id,ret\n1,5\n\n2,a,b\nnocomma\n1,6\n")
    assert [(r["id"], r["ret"]) for r in files.read_submission(spark, str(s)).orderBy("pos").collect()] == [("1", "5"), ("2", "a,b"), ("1", "6")]
    df = spark.createDataFrame([("10", "a\nb"), ("9", "x,y")], "id string, ret string")
    files.write_submission(df, str(tmp_path / "out"))
    text = "".join(f.read_text() for f in (tmp_path / "out").glob("*.csv"))
    assert "a b" in text and '"x,y"' in text
    files.write_snapshot(df, str(tmp_path / "snap"))
    rest, done = files.resume(spark, df, str(tmp_path / "snap"))
    assert rest.count() == 0 and done.count() == 2
    assert files.resume(spark, df, str(tmp_path / "none"))[1] is None
    files.write_pretty_array(df, str(tmp_path / "pretty.json"))
    assert json.loads((tmp_path / "pretty.json").read_text())[0]["id"] == "10"
    for n in ("checkpoint-9", "checkpoint-10"):
        (tmp_path / "run" / n).mkdir(parents=True)
    assert files.latest_checkpoint(str(tmp_path / "run" / "best")).endswith("checkpoint-10")


def test_config(tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "base.yaml").write_text(yaml.safe_dump({"a": {"b": 1, "c": [1]}, "d": 2}))
    (tmp_path / "own.yaml").write_text(yaml.safe_dump({"inherit": "base", "a": {"c": [2]}}))
    got = config.load(str(tmp_path / "own.yaml"), config.overrides(["--a.b", "1e-3", "--x", "--d", "true"]))
    assert got.a.b == 1e-3 and got.a.c == [2] and got.x is True and got.d is True
    (tmp_path / "bad.yaml").write_text("inherit: none")
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "bad.yaml"))


def test_generator(spark):
    df = spark.createDataFrame([("1", "abc"), ("2", "de")], "id string, prompt string")
    got = {r["id"]: r["reply"] for r in generate.generate(df, "id", "prompt", lambda: generate.stub).collect()}
    assert got["1"].endswith("答案：3")
    calls = []

    def fails(prompts):
        calls.append(1)
        raise RuntimeError

    waited = []
    assert generate.with_retries(fails, sleep=waited.append)(["x"]) == [None] and waited == [1, 2, 4]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("1", "q", "答案：5", "5"), ("2", "q", None, "5")], "id string, question string, completion string, answer string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        scoring.write_scored(scoring.read_completions(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and got.where("id = '1'").first()["correctness"] == 1.0
