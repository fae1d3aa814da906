"""Similarity joins against brute force, on texts with planted edits, hot copies and edge cases."""

import random

import pytest

from mathloom.llm import shingles, simjoin
from mathloom.llm.overlap import Overlap, cross_split
from mathloom.llm.plainform import similarity_form

HAN = [chr(0x4E00 + i) for i in range(400)]


def grams(t):
    t = similarity_form(t)
    return {t[i : i + 3] for i in range(len(t) - 2)}


def similar(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) >= 0.6 if x | y else similarity_form(a) == similarity_form(b)


def corpus(n, seed):
    rng = random.Random(seed)
    frame = "为了筹备{}节，{}学校忙了起来，{}带来了{}个苹果，平均分给{}名同学，每人分到几个？"
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.4:
            t = list(rng.choice(rows))
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(HAN)
            rows.append("".join(t))
        else:
            name = lambda k: "".join(rng.choices(HAN, k=k))
            rows.append(frame.format(name(4), name(5), name(6), rng.randint(2, 900), rng.randint(2, 90)))
    return rows + [rows[0]] * 40  # a hot text


def test_trigrams_and_jaccard():
    codes, offsets = shingles.trigrams(["abcabc", "ab", "", "一二三"])
    assert list(offsets) == [0, 3, 3, 3, 4] and len(set(codes.tolist())) == 4
    assert list(shingles.jaccard(["abcd", "a", "", "ab"], ["abce", "a", "", "ac"])) == pytest.approx([1 / 3, 1, 1, 0])


@pytest.mark.parametrize("limit, depth", [(1024, 6), (8, 2)])
def test_pairs_against_brute_force(spark, limit, depth):
    """With tiny nodes the rows branch on, and what stays large is compared in blocks: no pair is lost either way."""
    rows = corpus(250, 1)
    df = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(rows)] + [("5", rows[5], "again"), ("n", rows[1], ""), (None, rows[1], ""), ("900", None, ""), ("901", "，。", "")], "id string, question string, rep string")
    p = simjoin.PathJoin(node_limit=limit, depth=depth, branch=6 if limit == 8 else 3)
    got = {(r[0], r[1]) for r in simjoin.key_pairs(*simjoin.near_duplicates(df, p=p)).collect()}
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if similar(rows[i], rows[j])}
    assert got <= want
    assert len(got) >= 0.995 * len(want)


def family(n, size=90, edits=3):
    """Near copies of one text, each with own edits of two characters: what they share is common to all."""
    rng = random.Random(7)
    base = rng.choices(HAN, k=size)
    rows = []
    for i in range(n):
        t = list(base)
        for k in rng.sample(range(0, size - 1, 5), edits):
            t[k : k + 2] = [chr(0x5200 + 6 * i + rng.randrange(6)), chr(0x7000 + rng.randrange(4000))]
        rows.append("".join(t))
    return rows


def test_family_of_near_copies(spark):
    """No pair shares a token that isn't common."""
    rows = family(150)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, question string")
    want = {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if similar(rows[i], rows[j])}
    got = {(r[0], r[1]) for r in simjoin.key_pairs(*simjoin.near_duplicates(df)).collect()}
    assert len(want) > 1000 and got <= want
    assert len(got) >= 0.995 * len(want)


def test_empty_and_long(spark):
    schema = "id string, question string"
    assert simjoin.key_pairs(*simjoin.near_duplicates(spark.createDataFrame([], schema))).count() == 0
    long = "".join(random.Random(3).choices(HAN, k=30_000))
    df = spark.createDataFrame([("1", long), ("2", long[:-5] + "好"), ("3", "ab"), ("4", "ab"), ("5", "ac")], schema)
    assert {tuple(r) for r in simjoin.key_pairs(*simjoin.near_duplicates(df)).collect()} == {(1, 2), (3, 4)}


@pytest.mark.parametrize("shard", [60_000, 40])
def test_overlap_against_brute_force(spark, shard):
    rows = corpus(300, 2)
    train, ev = rows[:200] + ["ab", None], rows[200:] + ["ab", None, "?"]
    schema = "id string, question string, plain string"
    a = spark.createDataFrame([(str(i), t, "") for i, t in enumerate(train)], schema)
    b = spark.createDataFrame([(str(1000 + i), t, "") for i, t in enumerate(ev)], schema)
    pairs, members = cross_split(a, b, p=Overlap(shard_rows=shard))
    got = {(r["train_id"], r["key"]) for r in pairs.join(members, "rep").collect()}
    want = {(i, 1000 + j) for i, x in enumerate(train) for j, y in enumerate(ev) if x and y and y != "?" and similar(x, y)}
    assert got <= want
    assert len(got) >= 0.995 * len(want)
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert cross_split(x, y)[0].count() == 0


def test_overlap_of_a_family(spark):
    """All that the near copies share is common among the evaluation texts."""
    rows = family(150)
    a = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows[:30])], "id string, question string")
    b = spark.createDataFrame([(str(1000 + i), t) for i, t in enumerate(rows[30:])], "id string, question string")
    pairs, members = cross_split(a, b)
    got = {(r["train_id"], r["key"]) for r in pairs.join(members, "rep").collect()}
    want = {(i, 1000 + j) for i, x in enumerate(rows[:30]) for j, y in enumerate(rows[30:]) if similar(x, y)}
    assert len(want) > 500 and got <= want
    assert len(got) >= 0.98 * len(want)


def test_token_hashes_are_the_trigrams():
    rng = random.Random(4)
    texts = ["".join(rng.choices(HAN[:40], k=rng.randrange(0, 60))) for _ in range(300)] + ["", "ab", "aaaa"]
    hashes, offsets = shingles.token_hashes(texts)
    for i, t in enumerate(texts):
        assert offsets[i + 1] - offsets[i] == len({t[j : j + 3] for j in range(len(t) - 2)})
    same = shingles.token_hashes(["abcd", "xabc"])[0]
    assert len(set(same.tolist())) == 3  # abc is one token in both
    assert len(hashes) == offsets[-1]


def test_sift_loses_no_pair():
    """Sketches of similar records are never too far apart, whatever their sizes; thinned ones hardly ever."""
    import numpy as np

    rng = random.Random(9)
    for size, edits in ((30, 2), (70, 5), (150, 11), (900, 60), (20_000, 1200)):
        for _ in range(20):
            a = rng.choices(HAN, k=size)
            b = list(a)
            for k in rng.sample(range(size), rng.randrange(edits + 1)):
                b[k] = rng.choice(HAN)
            pair = ["".join(a), "".join(b)]
            codes, offsets = shingles.trigrams(pair)
            sizes = np.diff(offsets)
            s = simjoin.sketches(shingles.mix(codes), np.repeat([0, 1], sizes), sizes)
            if shingles.jaccard(pair[:1], pair[1:])[0] >= 0.6:
                assert simjoin.may_be_similar(s[:1], s[1:], sizes[:1], sizes[1:], 0.6)[0]


def test_texts_never_share_a_class(spark):
    """Hashes that clash are told apart by their texts."""
    rows = spark.createDataFrame([(1, "甲甲甲", 5), (2, "乙乙乙", 5), (3, "乙乙乙", 5), (4, "丙丙丙", 6)], "key bigint, plain string, rep bigint")
    records, reps = simjoin.representatives(rows)
    by_key = {r["key"]: r["rep"] for r in records.collect()}
    assert by_key[2] == by_key[3] and len(set(by_key.values())) == 3
    assert {r["plain"]: r["rep"] for r in reps.collect()} == {"甲甲甲": by_key[1], "乙乙乙": by_key[2], "丙丙丙": by_key[4]}


def test_large_family_among_others(spark):
    """A family that is a third of all rows: what its members share is in a third of all records."""
    rows = family(300, size=80, edits=2) + corpus(600, 5)
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, question string")
    sets = [grams(t) for t in rows[:300]]
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    got = {(r[0], r[1]) for r in simjoin.key_pairs(*simjoin.near_duplicates(df)).where("id_b < 300").collect()}
    assert len(want) > 10_000 and got <= want
    assert len(got) >= 0.99 * len(want)


def test_overlap_of_long_texts_and_tags(spark):
    """Passages far beyond the first 4,096 characters count; an id in two splits keeps both."""
    rng = random.Random(8)
    long = "".join(rng.choices(HAN, k=10_000))
    cut = "".join(rng.choices(HAN, k=3_900)) + long[3_900:]
    train = spark.createDataFrame([("1", long), ("2", "甲乙丙丁戊己庚辛")], "id string, question string")
    ev = spark.createDataFrame([("7", cut, "a"), ("8", "甲乙丙丁戊己庚壬", "a"), ("8", "子丑寅卯辰巳午未", "b"), ("9", None, "b")], "id string, question string, split string")
    shingled = grams(long), grams(cut)
    assert len(shingled[0] & shingled[1]) < 0.6 * len(shingled[0] | shingled[1])
    pairs, members = cross_split(train, ev, tags=("split",))
    assert {(r["train_id"], r["key"], r["split"]) for r in pairs.join(members, "rep").collect()} == {(2, 8, "a")}
    close = "".join(rng.choices(HAN, k=1_000)) + long[1_000:]
    pairs, members = cross_split(train, spark.createDataFrame([("7", close)], "id string, question string"))
    got = pairs.collect()
    assert len(got) == 1 and got[0]["train_id"] == 1 and 0.5 < got[0]["coverage"] <= 1
    assert {tuple(r) for r in pairs.join(members, "rep").select("train_id", "key").collect()} == {(1, 7)}


def test_covered():
    from mathloom.llm.overlap import covered

    assert covered([], 6) == 0 and covered([0], 6) == 6 and covered([0, 2, 20], 6) == 14 and covered([5, 11], 6) == 12


def test_overlap_of_moved_pieces(spark):
    """Every similar pair is found, also those that have no six characters in a row in common, or hardly any."""
    rng = random.Random(12)
    train, ev = [], []
    for k in range(400):  # pieces of 5 that overlap by 2, in another order: all trigrams of the text, no window of 6
        t = "".join(rng.sample(HAN, 5 + 3 * rng.randint(9, 25)))
        pieces = [t[s : s + 5] for s in range(0, len(t) - 4, 3)]
        rng.shuffle(pieces)
        train.append("".join(pieces))
        ev.append(t)
    for k in range(400):  # pieces of 8 and 9 side by side
        t = "".join(rng.sample(HAN, 90))
        cuts = [0]
        while cuts[-1] < 90:
            cuts.append(cuts[-1] + rng.randint(8, 9))
        pieces = [t[a:b] for a, b in zip(cuts, cuts[1:])]
        rng.shuffle(pieces)
        train.append("".join(pieces))
        ev.append(t)
    a = spark.createDataFrame([(str(i), t) for i, t in enumerate(train)], "id string, question string")
    b = spark.createDataFrame([(str(1000 + i), t) for i, t in enumerate(ev)], "id string, question string")
    sets = [[grams(t) for t in side] for side in (train, ev)]
    want = {(i, 1000 + j) for i, x in enumerate(sets[0]) for j, y in enumerate(sets[1]) if len(x & y) >= 0.6 * len(x | y)}
    assert len(want) >= 600
    pairs, members = cross_split(a, b)
    assert {(r["train_id"], r["key"]) for r in pairs.join(members, "rep").collect()} == want


def test_overlap_coverage_of_all_positions(spark):
    """Two thirds of the characters stand in windows that both texts hold."""
    t = "".join(HAN[:90])
    train = spark.createDataFrame([("1", t[:60] + "".join(HAN[200:204])), ("2", t[:66] + "好" + t[67:])], "id string, question string")
    pairs, _ = cross_split(train, spark.createDataFrame([("7", t)], "id string, question string"))
    got = {r["train_id"]: r["coverage"] for r in pairs.collect()}
    assert got == {1: pytest.approx(60 / 90), 2: pytest.approx(89 / 90)}


def test_overlap_whatever_the_sketches(spark):
    """Texts beyond 192 trigrams of which the sketches keep and tell apart nearly all that differs, and hardly anything else."""
    import numpy as np

    rng = random.Random(13)
    kept = lambda t: ((h := int(shingles.token_hashes([t])[0][0])) & 1 == 0, h >> 40 & 127)
    bins = set()

    def piece(two, n):
        """n characters, each making a trigram that is kept and has a bin of its own."""
        t = two
        while len(t) < n + 2:
            c = chr(rng.randrange(0x4E00, 0x9FA0))
            keep, where = kept(t[-2:] + c)
            if keep and where not in bins:
                bins.add(where)
                t += c
        return t

    same = "".join(rng.sample([chr(c) for c in range(0x4E00, 0x9FA0)], 150))
    pair = [piece(same[-2:], 46), piece(same[-2:], 46)]
    pair = [same + t[2:] for t in pair]
    h, offsets = shingles.token_hashes(pair)
    sizes = np.diff(offsets)
    s = simjoin.sketches(h, np.repeat([0, 1], sizes), sizes)
    assert similar(*pair) and not simjoin.may_be_similar(s[:1], s[1:], sizes[:1], sizes[1:], 0.6)[0]
    train, ev = (spark.createDataFrame([(str(i), t)], "id string, question string") for i, t in enumerate(pair))
    assert [r["train_id"] for r in cross_split(train, ev)[0].collect()] == [0]


def test_trigram_codes_of_many_characters():
    """Also of so many different characters that texts and trigrams don't fit one integer."""
    rng = random.Random(14)
    letters = [chr(c) for c in (*range(0x3400, 0xD7A0), *range(0x20000, 0x30000))]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(3000)] + ["", "ab", "aaaa", chr(0x10FFFF) * 3]
    for some in (texts, texts[-4:], texts[:1], []):
        (one, a), (other, b) = shingles.trigram_codes(some), shingles.trigrams(some)
        assert a.tolist() == b.tolist()
        assert all(set(one[x:y].tolist()) == set(other[x:y].tolist()) for x, y in zip(a, a[1:]))
