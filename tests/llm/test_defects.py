"""Kinds of defects, truncation and its models."""

import pandas as pd
import pytest

from mathloom.llm import defects as m
from mathloom.llm import language, truncation
from tests.conftest import DATA

Q = "为了筹备枫叶节，松林小学忙了起来，王小明买了12份蜡笔，每份18元，另付运费40元，一共花了多少元？"
GOOD = "先算12份蜡笔的价钱：18×12=216。加上运费40元，216+40=256元。所以答案是256元。"


@pytest.fixture(scope="module")
def judge(spark):
    return m.judge(spark.read.parquet(f"{DATA}/train_cot_raw.parquet"))


CASES = [
    (None, "empty"), ("", "empty"), (" \n", "empty"), ("N/A", "empty"), ("（空）", "empty"), ("--", "empty"), ("待补充", "empty"),
    ("抱歉，我无法回答这个问题。", "refusal"), ("Sorry, I cannot assist with homework.", "refusal"), ("Je ne peux pas répondre à cette question.", "refusal"),
    ("抱歉，刚才看漏了一个条件，现在重新算。" + GOOD, None),
    ("抱歉，我无法回答这道关于12个苹果的题目。", "refusal"), ("I cannot solve problem 7 for you, sorry.", "refusal"), ("这道题我懒得做，你问别人吧。", "refusal"), ("虽然有的数不能整除，这里有18份", "truncated"),
    (Q, "question_copy"), ("题目：" + Q.replace("，", " "), "question_copy"), (Q + Q, "question_copy"),
    ("First we look at the numbers 12 and 18. Then we multiply. So the answer is 256.", "other_language"),
    ("주어진 수는 12와 18입니다. 따라서 정답은 256입니다.", "other_language"), ("わかっている数は12と18です。したがって、答えは256です。", "other_language"),
    (GOOD, None), (GOOD[:-1], None), ("Step 1: 18\\times 12=216\nStep 2: 216+40=256\n答案：256", None),
    (GOOD[:30], "truncated"), ("先算12份蜡笔的价钱：18×12=216。加上运费40元，216+40=256元。所以答案是", "truncated"), ("先算12份蜡笔的价钱：18×…", "truncated"),
    ("先算12份蜡笔的价钱：18×12=216。加上运费40元，216+40=256。所以答案是25", "truncated"),
]


@pytest.mark.parametrize("value, kind", CASES)
def test_solutions(judge, value, kind):
    assert judge.defects("cot", pd.Series([value], dtype=object), pd.Series([Q], dtype=object))[0] == kind


@pytest.mark.parametrize("value, kind", [("256", None), ("256 元", None), ("3/5", None), ("12.5%", None), ("840 km", None), ("1\u200b2", None), ("(8+", "truncated"), ("答案是", "truncated"), ("9.", "truncated"), ("9/", "truncated"), ("\\frac{9", "truncated"), ("dua puluh empat", "other_language"), ("total: 9 apples", "other_language"), ("无法作答", "refusal"), ("null", "empty"), (None, "empty")])
def test_answers(judge, value, kind):
    assert judge.defects("api_answer", pd.Series([value], dtype=object), pd.Series([Q], dtype=object))[0] == kind


def test_null_question(judge):
    assert judge.defects("cot", pd.Series([GOOD], dtype=object), pd.Series([None], dtype=object))[0] is None


def rows(spark, *values):
    schema = "pos bigint, id string, question string, answer string, cot string, api_answer string, wrong_cot string, wrong_status string, field string"
    return spark.createDataFrame([(i, str(i), Q, "256", c, a, w, s, "clash") for i, (c, a, w, s) in enumerate(values)], schema)


def test_table(spark):
    table = rows(spark, *[(GOOD, "256", GOOD, "scdpo")] * 30, (None, "", None, "failed"), (GOOD, "256", "", " SCDPO "), ("虽然有的数不能整除，这里正好不受影响，" * 4000 + GOOD, "256", None, None))
    got = {tuple(r) for r in m.defects(table).collect()}
    assert got == {(30, "cot", "empty"), (30, "api_answer", "empty"), (31, "wrong_cot", "empty")}
    assert m.defects(table.limit(0)).count() == 0


def test_longer_copies(spark):
    values = spark.createDataFrame([(1, "f", "甲乙丙"), (2, "f", "甲乙丙丁"), (3, "g", "甲乙丙…"), (4, "f", "甲乙丁"), (5, "f", "甲乙丙丁"), (6, "f", ""), (7, "f", None)] + [(100 + i, "f", f"{i:03d}尾") for i in range(300)], "pos bigint, field string, value string")
    assert {tuple(r) for r in truncation.longer_copies(values).collect()} == {(1, "f"), (3, "g")}


def test_truncated_query(spark):
    cut = GOOD[:30]
    table = rows(spark, *[(GOOD, "256", None, None)] * 30, (cut, "256", None, None))
    assert [tuple(r) for r in m.truncated(table).collect()] == [(30, "cot", True)]


def test_longer_copies_add_rows(spark):
    """A strict prefix may end as whole values do: its longer copy shows that it breaks off, unless it has its result."""
    sound = "甲店卖12份，每份21元，一共12×21=252元"
    cut, whole = "先算总价：16×16=256元", "先算总价：16×16=256元，再加一倍，一共256×2=512元"
    done = GOOD[:-1] + "，加一倍，一共256×2=512元"
    table = rows(spark, *[(sound, "252", GOOD, "scdpo")] * 30, (cut, "64", None, None), (whole, "64", cut, "scdpo"), (GOOD[:-1], "256", None, None), (done, "256", None, None), ("无", "1", None, None), ("无论怎样，16×16=256元", "1", None, None))
    got = {(r["pos"], r["field"]): r["longer_copy"] for r in m.truncated(table).collect()}
    assert got.get((30, "cot")) and got.get((31, "wrong_cot"))
    assert not {(0, "cot"), (31, "cot"), (32, "cot"), (34, "cot"), (34, "wrong_cot")} & got.keys()


@pytest.mark.parametrize("value, longer, cut", [("16×16=256元", "16×16=256元，256÷4=64", True), ("得64", "得640元", True), ("16×4=64元", "16×4=64元。答案是64", False), ("答案是64元", "答案是64元，验算64÷4=16", False), ("得64", "得64。”", False), ("先算", "先算16×4=64", True), ("答案：1/2", "答案：1/20", True)])
def test_breaks_off(value, longer, cut):
    assert m.breaks_off(value, longer) is cut


@pytest.mark.parametrize("parts", [1, 5])
def test_prefixes_go_on_to_the_longest(spark, parts):
    """Chains of prefixes, also over the bounds of partitions."""
    words = ["甲" * k for k in range(1, 40)] + ["乙", "乙丙"]
    values = spark.createDataFrame([(i, "f", v) for i, v in enumerate(words)], "pos bigint, field string, value string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r["value"]: r["longer"] for r in truncation.prefixes(values).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert got == {w: words[38] for w in words[:38]} | {"乙": "乙丙"}


def test_hashes_of_ends_agree():
    texts = ["abcdefghij", "xy", "答案是0"]
    for order in truncation.ORDERS:
        every = truncation.all_hashes(texts, order)
        ends = [every[9], every[11], every[15]]
        assert list(truncation.tail_hashes(texts, order)) == ends


def test_bounds_of_values():
    """No length beyond which a value is read otherwise."""
    assert m.is_nothing("无" + "。" * 60) and not m.is_nothing("abcdefghijklm")
    digits = "1234567890" * 6
    assert truncation.number_cut(f"得{digits}，即{digits[:55]}") and not truncation.number_cut(f"得{digits}，即{digits}")


def test_languages_by_posterior_alone():
    """Mostly Han letters, with kana: Japanese."""
    odds = language.log_odds([Q] * 3)
    text = "一箱十二個入りのりんごを三箱、全部で三十六個です。それを四人に分けると一人九個ずつになります。"
    assert not language.surely_chinese([text])[0]
    assert language.posterior_other(pd.Series([text]), odds)[0][0] > 0


def test_language_held_out():
    """Sentences that neither the seeds nor the sample hold."""
    odds = language.log_odds([Q] * 3)
    other = ["The shop sells apples for two coins each.", "Wir haben noch sieben Äpfel übrig.", "Quedan siete manzanas en la caja.", "Il reste sept pommes dans la boîte.", "상자에 사과가 남아 있습니다.", "箱の中にりんごがのこっています。", "Còn lại bảy quả táo trong hộp."]
    score, _ = language.posterior_other(pd.Series(other), odds)
    assert (score > 0).all()
    score, letters = language.posterior_other(pd.Series(["箱子里还剩七个苹果", "Step 1: 速度为 12 km/h，路程 \\frac{1}{2}", "12 kg"]), odds)
    assert (score[:2] < 0).all() and letters[2] == 0
