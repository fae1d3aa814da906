"""Plain form: tables, tries and whole values."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from mathloom.llm import canonical
from mathloom.llm.plainform import fold_text, similarity_form

CASES = {
    "１２．５％": "12.5%", "𝟷2𝟼": "126", "42О个": "420个", "9З个": "93个", "З": "3", "484км": "484km", "кɡ": "kg", "⽜奶": "牛奶", "Fjörd": "Fjörd", "Mύno": "Múno",
    "1\u200b2": "12", "a\u00a0b": "a b", "привет мир": "привет мир", "，。？！：；（）、“”【】《》×÷": "，。？！：；（）、“”【】《》×÷", "스물네": "스물네", "1⁄4": "1/4", "9㎏": "9kg", "ﬁve": "five", "Ⅳ": "IV", "①": "①", "": "", "\t\n ": "\t\n ",
}


def test_tables():
    for given_, want in CASES.items():
        assert fold_text(given_) == want


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_fold_is_idempotent_and_total(s):
    once = fold_text(s)
    assert fold_text(once) == once


def test_similarity_form():
    assert similarity_form(" 共１２ Kg。") == "共12kg"
    assert similarity_form("!?") == ""


def test_trie_takes_the_frequent_reading():
    t = canonical.Trie()
    for w, n in (("420", 5), ("42O", 1), ("km", 3)):
        t.add(w, n)
    assert t.nearest("42О") == "420" and t.nearest("4\u200b2О") == "420"
    assert t.nearest("км") == "km" and t.nearest("сок") is None and t.nearest("421") is None


def found(spark, values):
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "field string, rec_key bigint, value string")
    return {r["rec_key"]: (r["plain"], r["odd"]) for r in canonical.canonical_values(df).collect()}


def test_values(spark):
    got = found(spark, ["5km", "5км", "好сок", "привет", "Múno", unicodedata.normalize("NFD", "Múno"), None, "", "普通", "1\u3000个", "①", "👩\u200d🏫", "x" * 50_000 + "\u200b"])
    assert got[1] == ("5km", True)
    assert not got[2][1] and not got[3][1]  # words wholly in another script, not known in plain letters
    assert 4 not in got and 6 not in got and 7 not in got and 8 not in got
    assert got[5] == ("Múno", True) and got[9] == ("1 个", True)
    assert not got.get(10, ("", False))[1] and not got.get(11, ("", False))[1]
    assert got[12] == ("x" * 50_000, True)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([("f", 1, "１", "z")] * 3, "field string, rec_key bigint, value string, token string")
    assert canonical.canonical_values(df).count() == 1  # an extra column of a clashing name is not looked at
    assert canonical.canonical_values(df.limit(0)).count() == 0
