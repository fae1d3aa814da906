"""Tokens, containers and spam on whole texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mathloom.llm import packing, spam, tokenize
from tests.conftest import DATA

LIBRARY = Tokenizer.from_file(f"{tokenize.TOKENIZERS}/byte_bpe_50k.json")
LIBRARY.encode_special_tokens = True


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text() | st.text("aab 'st\n01。题解һ", max_size=40))
def test_any_text_as_the_library(text):
    ids = tokenize.automaton().encode(text)
    assert ids == library(text)
    assert tokenize.automaton().decode(ids) == text


def test_documents_as_the_library(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode_texts(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    assert all(got[k] == library(t or "") for k, t in texts.items())
    assert {r["doc_id"]: r["tokens"] for r in tokenize.token_counts(docs).collect()} == {k: len(v) for k, v in got.items()}


def test_empty_null_special_and_long(spark):
    long = "习题 abc " * 20_000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|>", "x"), (4, long, "x"), (3, "<|endoftext|>", "x")], "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in tokenize.encode_texts(df).orderBy("doc_id").collect()]
    assert got[:2] == [(1, []), (2, [])] and got[2] == got[3] == (3, library("<|endoftext|>")) and got[4] == (4, library(long))
    assert tokenize.encode_texts(df.limit(0)).count() == 0


def check_packing(sizes, rows, capacity):
    room, seen = {}, {}
    for key, piece, tokens, container in rows:
        room[container] = room.get(container, 0) + tokens
        seen.setdefault(key, []).append((piece, tokens))
    assert max(room.values(), default=0) <= capacity
    for key, n in sizes.items():
        parts = sorted(seen[key])
        assert [p for p, _ in parts] == list(range(len(parts))) and sum(t for _, t in parts) == (n or 0)
        assert len(parts) == max(1, -(-(n or 0) // capacity))
    return room


@pytest.mark.parametrize("seed", range(3))
def test_packing(spark, seed):
    rng = random.Random(seed)
    sizes = {i: rng.choice([rng.randint(0, 100), rng.randint(1, 5000), 33, 33, None]) for i in range(800)}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "doc_id bigint, tokens bigint, rank int")
    rows = [tuple(r) for r in packing.pack(df, capacity=1000).collect()]
    room = check_packing(sizes, rows, 1000)
    total = sum(v or 0 for v in sizes.values())
    assert len(room) <= total / 1000 * 1.02 + 1
    assert packing.pack(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 30), max_size=12))
def test_plan_places_each_once(counts):
    plan = packing.plan(counts, 50)
    room = {}
    for n, c in counts.items():
        for r in range(c):
            k = int(plan.place(*(__import__("numpy").array([x]) for x in (n, r)))[0])
            room[k] = room.get(k, 0) + n
    assert max(room.values(), default=0) <= 50
    assert len(room) == plan.containers


SENTENCES = "批改作业的过程中，参加兴趣班的孩子会先把数字圈出来，后来大家都学着这样做。" * 6
LISTS = {
    "links": "\n".join(f"[练习册{i}](http://a{i}.example/x)" for i in range(30)),
    "tags": " ".join(f"#教案 #奥数题 ¥{i}.9 包邮 正版 #练习册" for i in range(30)),
    "words": " ".join(["练习册", "教案", "口算本", "真题"] * 30),
    "english": " | ".join(["buy now", "free printable", "best tutor"] * 30),
    "stuffed": "".join(f"买家教{x}？家教，" for x in ("哪里有", "多少钱", "怎么样")) * 15,
}
TEXTS = {
    "sentences": SENTENCES,
    "drill": "口算练习，限时5分钟。\n" + "\n".join(f"{i}+{i * 7 % 13}=____" for i in range(40)),
    "tail": SENTENCES + "\n标签：#教案 #奥数题 https://a.example/ ",
    "table": "\n".join(f"{i}×{j}={i * j}" for i in range(1, 9) for j in range(1, 9)),
    "english": "On a quiet Friday, the younger teachers circle the numbers first, and the lesson slowed down a little. Some of them asked why a drawing helps more than words do, so we tried both ways with the same task.",
    "short": "例题",
}


@pytest.fixture(scope="module")
def known(spark):
    return spam.associations(spark.read.parquet(f"{DATA}/documents.parquet"), "text")


@pytest.mark.parametrize("name", LISTS)
def test_spam(known, name):
    assert spam.spam_share(LISTS[name], known) > 0.5
    assert spam.spam_share(LISTS[name] + "\n这里有一句话，说明如何把题目读完整。", known) > 0.5


def test_unknown_pairs_are_unassociated():
    """Keywords that are rarely joined have no pair in the table."""
    none = spam.Associations(spam.Words([]).pair, spam.Words([]).pair.astype(float))
    rng = random.Random(5)
    listed = " | ".join("".join(rng.choices("柿椿栗溪银茶桥泰桃雁松铜", k=2)) + rng.choice(["期末卷", "练习册", "登录", "首页", "速算"]) for _ in range(30))
    assert spam.spam_share(listed, none) > 0.5
    assert spam.spam_share("这里有一句话，说明如何把题目读完整。\n" + listed, none) > 0.5
    assert spam.spam_share(SENTENCES, none) == 0


def test_mean_pmi_decides():
    """A line is spam only if its neighbours are not associated, function word or none."""
    line = "银桥 期末卷 泰桃 练习册 雁松 首页 铜柏 速算 鹭港 登录 苇岭 课件 和 霜梨 真题 坪荷 教案 云栗 网课 芦雪 真题"
    words = spam.Words([line])
    pairs = __import__("numpy").unique(words.pair)
    joined = lambda pmi: spam.Associations(pairs, pmi + 0.0 * pairs)
    for text in (line, line.replace("和 ", "")):
        assert spam.spam_share(text, joined(1.0)) == 1
        assert spam.spam_share(text, joined(4.0)) == 0


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    tables, pages = [], []
    for n in (1, 8, 64):
        part = df.repartition(n)
        known = spam.associations(part, "text")
        tables.append(dict(zip(known.pairs.tolist(), known.pmi.round(9).tolist())))
        pages.append({r["doc_id"] for r in spam.spam_pages(part).collect()})
    assert tables[0] and tables[0] == tables[1] == tables[2]
    assert pages[0] and pages[0] == pages[1] == pages[2]
    never = spam.Spam(low=-99.0, low_short=-99.0, low_few=-99.0)
    assert {r["doc_id"] for r in spam.spam_pages(df, p=never).collect()} < pages[0]


@pytest.mark.parametrize("name", TEXTS)
def test_no_spam(known, name):
    assert spam.spam_share(TEXTS[name], known) <= 0.5


def test_spam_table(spark):
    df = spark.createDataFrame([(1, LISTS["links"], 1), (2, None, 1), (3, "", 1), (4, " \n", 1), (5, SENTENCES * 50, 1), (6, LISTS["links"], 1)], "doc_id bigint, text string, share int")
    assert {r["doc_id"] for r in spam.spam_pages(df).collect()} == {1, 6}
    assert spam.spam_pages(df.limit(0)).count() == 0
