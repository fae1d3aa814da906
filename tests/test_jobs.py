"""Jobs around a generator that answers from a table."""

from mathloom.plans import jobs
from mathloom.sources.shared import discard, materialize


def make():
    def reply(prompts):
        out = []
        for p in prompts:
            wrong = "错误" in p
            out.append(None if "无" in p else f"推理过程：3+4\n答案：{'8' if wrong else '7'}")
        return out

    return reply


def problems(spark):
    return spark.createDataFrame([(0, "1", "3+4？", "7", "i"), (1, "2", "3+5？", "9", "i"), (2, "3", "无", "1", "i")], "pos bigint, id string, question string, answer string, instruction string")


def test_annotate(spark, tmp_path):
    got = {r["id"]: r for r in jobs.annotate(problems(spark).drop("pos"), make).collect()}
    assert (got["1"]["answer_match"], got["1"]["wrong_answer"], got["1"]["wrong_status"]) == (True, "8", "simple_try1")
    assert (got["2"]["answer_match"], got["2"]["wrong_status"], got["2"]["status"]) == (False, None, "ok")
    assert got["3"]["status"] in ("api_failed", "parse_error:no_answer_extracted")
    done = jobs.annotate(problems(spark).drop("pos").where("id = '1'"), make)
    done.write.parquet(str(tmp_path / "done"))
    assert jobs.annotate(problems(spark).drop("pos"), make, str(tmp_path / "done")).count() == 3


def test_repair_job(spark):
    rows = problems(spark).selectExpr("pos", "id", "question", "answer", "'' AS cot", "'' AS api_answer", "false AS answer_match", "'ok' AS status", "'' AS wrong_cot", "'' AS wrong_answer", "'' AS wrong_status")
    got = {r["id"]: r for r in jobs.repair_job(rows, make).collect()}
    assert got["1"]["answer_match"] and got["1"]["wrong_answer"] == "8"
    assert not got["2"]["answer_match"] and got["3"]["cot"] == ""


def test_infer_and_accuracy(spark):
    got = {r["id"]: r["answer"] for r in jobs.infer(problems(spark), make).collect()}
    assert got == {"1": "7", "2": "7", "3": ""}
    r = jobs.sampled_accuracy(problems(spark), make, 2).first()
    assert (r["correct"], r["total"]) == (1, 2)


def test_discard(spark):
    kept = materialize(spark.range(3), "x")
    assert kept.count() == 3
    assert discard(spark) >= 1 and discard(spark) == 0


def scdpo_make():
    def reply(asked):
        out = []
        for p in asked:
            if "已有的正确推理" in p:
                out.append("好。继续推理：4+4=8，\n答案：8" if "3+4" in p else "答案：9")
            else:
                out.append("3和4相加。得3+4=7。\n答案：7" if "3+4" in p else "推理过程：5+4=9\n答案：9")
        return out

    return reply


def test_continued_wrong_solutions(spark):
    rows = spark.createDataFrame([("1", "3+4？", "7", "i"), ("2", "5+4？", "9", "i")], "id string, question string, answer string, instruction string")
    got = {r["id"]: r for r in jobs.annotate(rows, scdpo_make, wrong="scdpo").collect()}
    assert (got["1"]["wrong_status"], got["1"]["wrong_answer"], got["1"]["wrong_error_step"]) == ("scdpo", "8", 1)
    assert got["1"]["wrong_cot"] == "3和4相加\n4+4=8，"
    assert got["2"]["wrong_status"] == "failed" and got["2"]["wrong_error_step"] is None
    assert {r["wrong_status"] for r in jobs.annotate(rows, scdpo_make, wrong=None).collect()} == {None}


def test_a_stop_loses_one_part(spark, tmp_path):
    """Parts written before the stop are kept and not asked for again."""
    rows = spark.createDataFrame([(str(i), f"{i}+4？", str(i + 4), "i") for i in range(40)], "id string, question string, answer string, instruction string")
    path, asked = str(tmp_path / "done"), tmp_path / "asked"
    asked.mkdir()

    def made(stop):
        def make():
            def reply(prompts):
                (asked / __import__("uuid").uuid4().hex).write_text("\n".join(p.split("\n")[-1] for p in prompts))
                if stop and len(list(asked.iterdir())) > 6:
                    raise KeyboardInterrupt
                return ["推理过程：略\n答案：0" for _ in prompts]

            return reply

        return make

    try:
        jobs.annotate(rows, made(True), path, parallel=1, wrong=None, save_every=10)
    except Exception:
        pass
    before = {r["id"] for r in spark.read.parquet(path).collect()}
    assert 0 < len(before) < 40
    for f in asked.iterdir():
        f.unlink()
    done = jobs.annotate(rows, made(False), path, parallel=1, wrong=None, save_every=10)
    assert done.count() == 40 and done.select("id").distinct().count() == 40
    again = {q for f in asked.iterdir() for q in f.read_text().split("\n")}
    assert not {f"{i}+4？" for i in before} & again


def test_counters(spark):
    from mathloom.operators import repair

    rows = problems(spark).selectExpr("pos", "id", "question", "answer", "'' AS cot", "'' AS api_answer", "false AS answer_match", "'ok' AS status", "'' AS wrong_cot", "'' AS wrong_answer", "'' AS wrong_status")
    got = repair.counters(jobs.repaired(rows, make)).first().asDict()
    assert got == {"failures": 3, "phase1": 3, "solved": 2, "recycled": 0, "suspect": 0, "simple": 1, "hard": 0, "still_failed_right": 0, "still_failed_wrong": 0, "fixed": 3}
    assert repair.counters(jobs.repaired(rows.limit(0), make)).first()["failures"] == 0


def test_metrics(spark, tmp_path):
    from mathloom.operators import evaluate
    from mathloom.sources.metrics import Metrics, latest

    m = Metrics(spark, str(tmp_path / "metrics"), "a")
    assert m.log({"loss": 2.0, "bad": float("nan")}, 1) and m.log({"loss": 1.5}, 2)
    assert m.log_row(evaluate.accuracy(spark.createDataFrame([(True,), (False,)], "correct boolean")), 2)
    got = {(r["name"], r["step"]): r["value"] for r in latest(spark, str(tmp_path / "metrics")).collect()}
    assert got == {("loss", 2): 1.5, ("correct", 2): 1.0, ("total", 2): 2.0, ("accuracy", 2): 0.5}
    assert not Metrics(spark, "nowhere://x/y", "a").log({"loss": 1.0})


def test_rewards_for_a_trainer(spark):
    from mathloom.functions.rewards import reward_functions

    by_name = {f.__name__: f for f in reward_functions(spark)}
    out = ["<think>因此</think><answer>7</answer>", [{"role": "assistant", "content": "答案是8"}], None]
    assert by_name["correctness_reward"](out, answer=["7", "7", None], prompt=["q", "q", "q"]) == [1.0, -0.5, 0.0]
    assert by_name["format_reward"](completions=out) == [0.2, 0.0, 0.0]


def test_template_of_a_tokenizer(spark):
    from pyspark.sql import functions as F

    from mathloom.functions import prompts

    df = spark.createDataFrame([(1, "问", "x")], "id int, question string, prompt string").withColumn("m", prompts.zero_shot(F.col("question")))
    make = lambda: lambda messages: "|".join(f"{m['role']}={len(m['content'])}" for m in messages)
    assert prompts.with_template(df, "m", make).first()["prompt"].endswith("|user=1")


def test_command_line(spark, tmp_path, capsys):
    from mathloom.__main__ import main
    from tests.conftest import DATA

    main([])
    assert "repair_counters" in capsys.readouterr().out
    main(["query", "sft_yield", DATA, str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1
    (tmp_path / "p.json").write_text('[{"id": "1", "question": "3+4=？共5个", "answer": "7"}, {"id": "2", "question": ["a", "b"], "answer": null}]', encoding="utf-8")
    main(["build", str(tmp_path / "p.json"), str(tmp_path / "built"), "--wrong", "scdpo"])
    built = spark.read.parquet(str(tmp_path / "built"))
    assert built.count() == 2
    built.withColumn("pos", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id()).write.parquet(str(tmp_path / "rows"))
    main(["repair", str(tmp_path / "rows"), str(tmp_path / "repaired")])
    main(["augment", str(tmp_path / "p.json"), str(tmp_path / "aug"), "--copies", "2"])
    assert spark.read.parquet(str(tmp_path / "aug")).count() == 2
    main(["preprocess", str(tmp_path / "rows"), str(tmp_path / "tables")])
    main(["infer", str(tmp_path / "p.json"), str(tmp_path / "submission"), "--limit", "1"])
    assert spark.read.option("header", True).csv(str(tmp_path / "submission")).count() == 1
