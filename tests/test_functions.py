"""Worked cases of the text, number and reward functions."""

import pytest
from pyspark.sql import functions as F

from mathloom.functions import answers, numbers, prompts, rewards, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given, answer, level",
    [
        (None, "", "空输出"),
        ("", "", "空输出"),
        ("   ", "", "兜底清理"),
        ("<answer>85千克</answer>", "85", "标签匹配"),
        ("<answer>5平方米</answer>", "5平方", "标签匹配"),  # 米 is taken out before 平方米
        ("<answer>约5</answer>", "约5", "标签匹配"),
        ("<answer>  </answer>答案为7", "7", "关键词匹配"),
        ("答案是：5", "5", "末尾数字"),  # one mark only is read
        ("答案是3/5。", "3/5", "关键词匹配"),
        ("答案：10%", "10%", "关键词匹配"),
        ("=3.5元", "3", "等号匹配"),
        ("4×5=20.", "20", "等号匹配"),
        ("5-3", "-3", "末尾数字"),
        ("答案是１２", "12", "关键词匹配"),
        ("答案是7.0", "7", "关键词匹配"),
        ("没有", "", "兜底清理"),
        ("a.-b", ".-", "兜底清理"),
    ],
)
def test_extraction(spark, given, answer, level):
    r = answers.with_extracted_answer(spark.createDataFrame([(given,)], "v string"), "v").first()
    assert (r["extracted"], r["level"]) == (answer, level)


def test_own_patterns(spark):
    df = spark.createDataFrame([("得[3]个，共9",)], "v string")
    r = answers.with_extracted_answer(df, "v", patterns=((r"\[(\d+)\]", "brackets"), (r"(\d+)", "last"))).first()
    assert (r["extracted"], r["level"]) == ("3", "brackets")


@pytest.mark.parametrize(
    "given, want",
    [("3/4", "0.75"), ("6/3", "2"), ("1/3", "0.333333"), ("3/0", None), ("1.5/2", None), ("25%", "25.0"), ("12.50", "12.5"), ("007", "7"), ("", None), (None, None), ("x", None), (" 5 ", "5"), ("9" * 400, None), ("10000000.5", "10000000.5"), ("0.00001", "0.00001")],
)
def test_normal_number(spark, given, want):
    df = numbers.with_normal(spark.createDataFrame([(given,)], "v string"), x="v")
    assert df.first()["x"] == want


@pytest.mark.parametrize("a, b, same", [("3/5", "0.6", True), ("1/5", "2/10", True), ("10%", "10", True), ("x", " x ", True), ("x", "y", False), (None, None, False), ("nan", "1", False), ("1/2/3", "1", False)])
def test_answers_match(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(numbers.answers_match(F.col("a"), F.col("b")).alias("x")).first()["x"] is same


@pytest.mark.parametrize("a, b, same", [("3.333", "3.3", True), ("72", "73", False), ("3.4", "3", True), ("x", "3", False), ("2.5", "2", True)])
def test_round_match(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert numbers.with_round_match(df, "x", "a", "b").first()["x"] is same


def test_parse_response(spark):
    df = spark.createDataFrame([("推理过程：先加。\n答案：5",), ("先加\n答案：5",), ("共5",), ("  ",), (None,), ("无",), ("答案：7",)], "v string")
    got = [(r["parsed_cot"], r["parsed_answer"], r["parse_error"]) for r in answers.with_parsed_response(df, "v").collect()]
    assert got == [("先加。", "5", None), ("先加", "5", None), ("共5", "5", None), ("", "", "empty_response"), ("", "", "empty_response"), ("无", "", "no_answer_extracted"), ("", "7", "no_cot_extracted")]


def test_rewards(spark):
    good = "<think>首先已知，所以得到" + "推" * 30 + "</think><answer>85千克</answer>"
    rows = [(good, "85", "问"), ("答案：3.4", "3", "问"), ("答案：3.4", "3", "保留一位"), (None, None, None), ("\\frac 1", "x", "")]
    df = spark.createDataFrame(rows, "c string, a string, q string")
    got = [tuple(r[p] for p in rewards.PARTS) for r in rewards.with_rewards(df, "c", "a", "q").collect()]
    assert got[0] == pytest.approx((1.0, 0.2, 0.3, 0.0, 0.0))
    assert got[1][0] == 0.3 and got[2][0] == -0.5
    assert got[3] == (0.0, 0.0, -0.3, -0.3, 0.0)
    assert got[4] == (-0.5, 0.0, -0.3, -0.3, -0.3)


def test_steps(spark):
    cases = {"第一步：a第二步：b第三步：c": 3, "a\nb\nc": 3, "a。b": 2, "ab": 1, "": 0, None: 0, " \n ": 0}
    for given, n in cases.items():
        assert len(one(spark, given, answers.split_steps)) == n


def test_prompts(spark):
    df = spark.createDataFrame([("问？", "cn_simple"), ("问？", "unknown"), ("问？", None)], "q string, t string")
    got = [r[0][0]["content"] for r in df.select(prompts.zero_shot(F.col("q"), F.col("t"))).collect()]
    assert got == [prompts.TEMPLATES["cn_simple"], prompts.TEMPLATES["cn_step_by_step"], prompts.TEMPLATES["cn_step_by_step"]]
    row = spark.createDataFrame([([1, 2], [3])], "p array<int>, r array<int>")
    token = row.select(*(c.alias(k) for k, c in prompts.token_row(F.col("p"), F.col("r"), 9, 3).items())).first()
    assert (token["input_ids"], token["attention_mask"], token["labels"]) == ([1, 2, 3], [1, 1, 1], [-100, -100, 3])
    with pytest.raises(ValueError):
        prompts.strategy("none")


def test_sanitize_and_variant(spark):
    assert one(spark, ' "a\\nb\\t\\"c" ', text.sanitize_question) == 'a\nb "c'
    df = spark.sql("""SELECT parse_json(x) AS v FROM VALUES ('"a"'), ('["a",["b"]]'), ('{"text":"t"}'), ('{"content":["c","d"]}'), ('null'), ('3') AS t(x)""")
    assert [r[0] for r in df.select(F.expr(text.variant_text("v"))).collect()] == ["a", "a\nb", "t", "c\nd", "", "3"]
