"""Null keys and nulls in every other column: rows are judged as any other."""

from mathloom.llm import canonical, defects, packing, simjoin, spam, tokenize
from tests.llm.test_documents import LISTS


def test_defects(spark):
    schema = "pos bigint, id string, question string, answer string, cot string, api_answer string, wrong_cot string, wrong_status string"
    df = spark.createDataFrame([(None,) * 8, (9007199254740993, None, None, None, None, None, None, "scdpo"), (None, None, "q", None, "", "5", None, None)], schema)
    got = sorted(((r["pos"], r["field"], r["defect"]) for r in defects.defects(df).collect()), key=repr)
    big = 9007199254740993
    assert got == sorted([(None, "cot", "empty"), (None, "api_answer", "empty"), (big, "cot", "empty"), (big, "api_answer", "empty"), (big, "wrong_cot", "empty"), (None, "cot", "empty")], key=repr)
    assert defects.truncated(df).count() == 0


def test_documents(spark):
    df = spark.createDataFrame([(None, LISTS["links"]), (9007199254740993, LISTS["links"]), (None, None)], "doc_id bigint, text string")
    assert sorted((r["doc_id"] for r in spam.spam_pages(df).collect()), key=repr) == [9007199254740993, None]
    assert sorted((r["doc_id"] for r in tokenize.encode_texts(df).collect()), key=repr) == [9007199254740993, None, None]
    placed = packing.pack(tokenize.token_counts(df)).collect()
    assert sorted((r["doc_id"] for r in placed), key=repr) == [9007199254740993, None, None]


def test_questions(spark):
    df = spark.createDataFrame([(None, "一二三四五"), ("1", None), ("9007199254740993", "一二三四五"), ("9007199254740994", "一二三四五")], "id string, question string")
    assert [tuple(r) for r in simjoin.key_pairs(*simjoin.near_duplicates(df)).collect()] == [(9007199254740993, 9007199254740994)]


def test_values(spark):
    df = spark.createDataFrame([(None, None, "１"), ("f", None, None), ("f", 9007199254740993, "１")], "field string, rec_key bigint, value string")
    assert {(r["field"], r["rec_key"]) for r in canonical.canonical_values(df).collect()} == {(None, None), ("f", 9007199254740993)}
