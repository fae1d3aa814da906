"""Near-duplicate records: a set similarity join by chosen paths (problem 2).

Records are sets of character trigrams of their plain form.  A record walks down a tree: at each node it is sent to
one child per chosen coordinate, namely the child of its minwise token under that coordinate's hash, so two records
meet in a child with a probability that grows with their similarity.  Small nodes are compared exhaustively, larger
ones branch again, and independent trials (coordinates of the first level) bring the recall to its target.  The
frequencies of a path's tokens tell beforehand that its node will be large, so the record walks on at once; only nodes
that turn out large against expectation cost another round.

Minwise tokens are chosen by weight, as skewed tokens ask for: a token in a share f of all records weighs
min(1, (theta / f) ** skew).  Two records meet with their weighted similarity: shared templates seldom pull unrelated
records into one node, and near copies that share common tokens only still meet, as nothing is barred.  The table of
the common tokens' weights is the only thing broadcast; as records have a bounded mean length L, at most L / theta
tokens can be common at any data size.

Records that met are sifted by odd sketches (the parities of their tokens in 128 bins): they differ in at most as many
bins as the sets differ in tokens, so the sift loses no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm.plainform import similarity_form
from mathloom.llm.shingles import counted, jaccard, mix, segment_min, trigrams
from mathloom.sources.shared import materialize

_EMPTY = 2**64 - 1
_GOLD = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class PathJoin:
    """Parameters. ``trials`` first-level coordinates; paths of which more than ``expected`` records are expected walk on
    to one more child each time (a trial more is worth as much as a second child, and costs less); nodes that turn out to
    have over ``node_limit`` rows branch on to ``branch`` children, at most ``depth`` times; then they are compared in
    blocks, whatever their size."""

    threshold: float = 0.6
    trials: int = 26
    branch: int = 2
    expected: int = 512
    node_limit: int = 4096
    depth: int = 6
    theta: float = 2e-4
    least_common: int = 20
    skew: float = 0.5


def plain_records(df: DataFrame, key: str, text: str, *tags: str, extend: Callable[[list[str]], pd.DataFrame] | None = None, schema: str = "") -> DataFrame:
    """(key bigint, plain string, tags as strings, rep bigint): rep is the hash of the plain text, so equal texts share it.
    ``extend`` gives more columns (of ``schema``) from the plain texts of a batch.

    Null texts and keys that are no numbers give no row; a text without letters or digits neither.
    """
    src = df.select(F.expr(f"try_cast(`{key}` AS bigint)").alias("key"), F.col(text).alias("text"), *(F.col(t).cast("string").alias(t) for t in tags)).where("key IS NOT NULL AND text IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.drop_duplicates().copy()
            b["plain"] = [similarity_form(x) for x in b["text"]]
            b = b.loc[b["plain"] != "", ["key", "plain", *tags]].reset_index(drop=True)
            yield b if extend is None else pd.concat([b, extend(b["plain"].tolist())], axis=1)

    fields = ["key bigint, plain string", *(f"`{t}` string" for t in tags), *([schema] if schema else [])]
    return src.mapInPandas(run, ", ".join(fields)).withColumn("rep", F.xxhash64("plain"))


def representatives(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, one row a distinct text (rep, plain)), where no two texts share a rep: the class id is checked against
    the text, and of texts whose hashes clash all but one get another."""
    for seed in range(1, 9):
        reps = materialize(records.groupBy("rep").agg(F.min("plain").alias("plain"), F.max("plain").alias("last")), "representatives")
        clash = reps.where("plain <> last").select("rep", F.col("plain").alias("keep"))
        if clash.isEmpty():
            break
        other = F.when(F.col("keep") != F.col("plain"), F.xxhash64("plain", F.lit(seed))).otherwise(F.col("rep"))
        records = records.join(clash, "rep", "left").withColumn("rep", other).drop("keep")
    return records, reps.select("rep", "plain")


_RARE = np.uint64(255)


@dataclass(frozen=True)
class Common:
    """Sorted codes of the common tokens, one over each one's weight, and how rare each is in eighths of a bit; all
    others count as ``_RARE``. ``bits`` is the logarithm of the number of records."""

    codes: np.ndarray
    inverse: np.ndarray
    rarity: np.ndarray
    bits: float

    def factors(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.codes):
            return np.ones(len(codes)), np.full(len(codes), _RARE, np.uint64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        return np.where(known, self.inverse[at], 1.0), np.where(known, self.rarity[at], _RARE)


def common_tokens(reps: DataFrame, n: int, p: PathJoin) -> Common:
    """Tokens in at least max(theta * n, least_common) records: at most mean length / theta codes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for codes, counts in counted(trigrams(b["plain"].tolist())[0] for b in batches):
            yield pd.DataFrame({"code": codes.view(np.int64), "n": counts})

    least = float(max(p.theta * n, p.least_common))
    found = reps.select("plain").mapInPandas(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(least)).toPandas()
    codes = found["code"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    count = found["n"].to_numpy(float)[order]
    rarity = np.minimum(8 * np.log2(np.maximum(n / np.maximum(count, 1), 1)), 254).astype(np.uint64)
    return Common(codes[order], (count / least) ** p.skew, rarity, float(np.log2(max(n, 1))))


_SIZES = np.uint64(0xFFFF)
_BINS = 128


def _thinned(sizes: np.ndarray) -> np.ndarray:
    """How often a record's tokens are halved for its sketch, so that the bins don't fill up."""
    return np.floor(np.log2(np.maximum(sizes, 96) / 96)).astype(np.int64)


def sketches(h: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Odd sketch of each record, two integers: bit b tells whether an odd number of its tokens falls into bin b."""
    n = len(sizes)
    keep = (h & ((np.uint64(1) << _thinned(sizes).astype(np.uint64)) - np.uint64(1))[doc]) == 0
    at = doc[keep] * _BINS + ((h[keep] >> np.uint64(40)) & np.uint64(_BINS - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * _BINS) & 1).astype(np.uint8).reshape(n, _BINS)
    return np.packbits(odd, axis=1).view(np.uint64).reshape(n, 2)


def half_bound(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """A record's half of a cheap bound: two sketches of similar records are apart by no more than both halves."""
    return np.where(_thinned(sizes) > 0, 255.0, sizes * ((1 - threshold) / (1 + threshold)) + 1e-3).astype(np.float32)


def may_be_similar(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches and sizes allow the threshold. Unthinned sketches never err; thinned ones by chance, at four
    standard deviations; sketches thinned unlike each other tell nothing."""
    most = (na + nb) * ((1 - threshold) / (1 + threshold))
    ta, tb = _thinned(na), _thinned(nb)
    mean = most / 2.0**ta
    limit = np.where(ta > 0, mean + 4 * np.sqrt(mean) + 1, most)
    fits = np.minimum(na, nb) >= threshold * np.maximum(na, nb)
    apart = np.bitwise_count(sa ^ sb).sum(1, dtype=np.int64)
    return fits & ((apart <= limit + 1e-9) | (ta != tb))


def _children(rows: pd.DataFrame, common: Common, p: PathJoin, level: int) -> pd.DataFrame:
    """Rows of the next level: (node, rep, s0, s1) for each node of each row (nodes, rep, plain).

    The low 16 bits of a node hold the record's number of tokens, its high ones say which node it is."""
    codes, offsets = trigrams(rows["plain"].tolist())
    n, sizes = len(rows), np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    h = mix(codes)
    sketch = sketches(h, doc, sizes).view(np.int64)
    size = np.minimum(sizes, 0xFFFF).astype(np.uint64)
    h ^= h >> np.uint64(29)
    weight, rarity = common.factors(codes)
    reps = rows["rep"].to_numpy()
    out = []

    def lowest(values: np.ndarray, at: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least value of each segment, and the rarity of its token, which rides in the last bits."""
        bits = values.view(np.uint64)
        bits &= ~_RARE
        bits |= rare
        low = segment_min(values, at, np.inf).view(np.uint64)
        return low, low & _RARE

    def descend(who: np.ndarray, parent: np.ndarray, left: np.ndarray, below: int) -> None:
        """A node draws its own coordinates; ``left`` is how many bits of the records it is expected to hold."""
        k = sizes[who]
        at = np.repeat(offsets[who] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        bounds = np.r_[0, np.cumsum(k)]
        own_h, own_weight, own_rarity = h[at], weight[at], rarity[at]
        for i in range(p.branch if level else 1):
            seed = np.uint64((below * 64 + i + 1) * _GOLD & _EMPTY)
            own = np.repeat(mix(parent ^ seed) | np.uint64(1), k)
            low, rare = lowest((own_h * own).astype(np.float64) * own_weight, bounds, own_rarity)
            give(low, rare, parent, seed, who, left, below)

    def give(low: np.ndarray, rare: np.ndarray, parent: np.ndarray, seed: np.uint64, who: np.ndarray, left: np.ndarray, below: int) -> None:
        node = (mix(low ^ mix(parent + seed)) & ~_SIZES) | size[who]
        left = np.where(rare == _RARE, 0.0, left - rare.astype(np.int64) / 8)
        on = (left > np.log2(p.expected)) if below < p.depth else np.zeros(len(who), bool)
        if on.any():
            descend(who[on], node[on] & ~_SIZES, left[on], below + 1)
            node, who = node[~on], who[~on]
        out.append(pd.DataFrame({"node": node.view(np.int64), "rep": reps[who], "s0": sketch[who, 0], "s1": sketch[who, 1]}))

    if level:
        nodes = rows["nodes"].tolist()
        who = np.repeat(np.arange(n), np.fromiter(map(len, nodes), dtype=np.int64, count=n))
        parent = np.concatenate(nodes).astype(np.int64).view(np.uint64) if n else np.zeros(0, np.uint64)
        descend(who, parent, np.zeros(len(who)), p.depth + level)
    else:
        zero, every, all_bits = np.zeros(n, np.uint64), np.arange(n), np.full(n, common.bits)
        for i in range(p.trials):
            seed = np.uint64((2 * i + 1) * _GOLD & _EMPTY)
            low, rare = lowest((h * seed).astype(np.float64) * weight, offsets, rarity)
            give(low, rare, zero, seed, every, all_bits, 0)
    return pd.concat(out, ignore_index=True)


def _compare(p: PathJoin, last: bool):
    """Over rows sorted by node: pairs of small nodes that pass the sift (a, b), rows of large ones (node, rep)."""

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows["node"].to_numpy().view(np.uint64)
        node, rep = whole >> np.uint64(16), rows["rep"].to_numpy()
        size = (whole & _SIZES).astype(np.int64)
        s = rows[["s0", "s1"]].to_numpy().view(np.uint64)
        s0, s1 = s[:, 0].copy(), s[:, 1].copy()
        half = half_bound(size, p.threshold)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        i, d = np.arange(len(rows)), 1
        while True:
            i = i[: np.searchsorted(i, len(rows) - d)]
            i = i[node[i] == node[i + d]]
            if not len(i):
                break
            j = i + d
            keep = i[np.bitwise_count(s0[i] ^ s0[j]) + np.bitwise_count(s1[i] ^ s1[j]) <= half[i] + half[j]]
            keep = keep[may_be_similar(s[keep], s[keep + d], size[keep], size[keep + d], p.threshold) & (rep[keep] != rep[keep + d])]
            left.append(np.minimum(rep[keep], rep[keep + d]))
            right.append(np.maximum(rep[keep], rep[keep + d]))
            d += 1
        out = pd.DataFrame({"node": None, "a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()
        return out.astype({"node": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        large = None  # the node whose rows go on to the next level
        for b in batches:
            if held is not None and len(held):
                b = pd.concat([held, b], ignore_index=True)
            node = b["node"].to_numpy() >> 16
            start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[start, len(b)])
            over = (size > p.node_limit) | (node[start] == large if large is not None else False)
            if last:
                over[:] = False
            end = start[-1]  # the last node may go on in the next batch
            if over[-1]:
                large, end = node[-1], len(b)
            held = b.iloc[end:]
            out = np.repeat(over, size)[:end]
            deeper = b.iloc[:end][out]
            if len(deeper):
                yield pd.DataFrame({"node": deeper["node"], "a": deeper["rep"], "b": pd.array([None] * len(deeper), "Int64")})
            yield pairs(b.iloc[:end][~out].reset_index(drop=True))
        if held is not None and len(held):
            yield pairs(held.reset_index(drop=True))

    return run


def candidate_pairs(reps: DataFrame, p: PathJoin) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives that met in a small node and whose sketches agree."""
    n = reps.count()
    common = reps.sparkSession.sparkContext.broadcast(common_tokens(reps, n, p))
    found = None
    rows = reps.where(F.char_length("plain") >= 3).select("rep", "plain")  # shorter ones have no token and no pair
    which = F.shiftright("node", 16)
    for level in range(p.depth + 1):

        def branch(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield _children(b, common.value, p, level)

        last = level == p.depth
        nodes = rows.mapInPandas(branch, "node bigint, rep bigint, s0 bigint, s1 bigint")
        if last:  # exhaustively, in blocks: every two blocks of a node meet in one task
            return found.unionByName(_blocks(nodes, p)).distinct() if found is not None else _blocks(nodes, p).distinct()
        met = materialize(nodes.repartition(which).sortWithinPartitions("node").mapInPandas(_compare(p, False), "node bigint, a bigint, b bigint"), f"paths{level}")
        pairs = met.where("b IS NOT NULL").select("a", "b")
        found = pairs if found is None else found.unionByName(pairs)
        deeper = met.where("b IS NULL").select(F.shiftleft(which, 16).alias("node"), F.col("a").alias("rep"))
        if deeper.isEmpty():
            return found.distinct()
        # each text goes along once, with all its nodes: trials times branches at most
        rows = deeper.groupBy("rep").agg(F.collect_set("node").alias("nodes")).join(reps, "rep").select("nodes", "rep", "plain")
    return found.distinct()


def _blocks(nodes: DataFrame, p: PathJoin) -> DataFrame:
    """Exact way for nodes that no branching made small: blocks of about node_limit rows, each pair of blocks a group.

    Each row goes to as many groups as its node has blocks; records that stay together through ``depth`` levels are
    near copies, so this is less than the pairs they form by a factor of node_limit."""
    which = F.shiftright("node", 16)
    size = nodes.groupBy(which.alias("which")).agg(F.ceil(F.count("*") / p.node_limit).alias("k"))
    rows = nodes.withColumn("which", which).join(size, "which").withColumn("block", F.pmod(F.xxhash64("rep"), "k"))
    other = F.explode(F.expr("sequence(0L, k - 1)")).alias("other")
    group = F.shiftleft(F.xxhash64("which", F.least("block", "other"), F.greatest("block", "other")), 16).bitwiseOR(F.col("node").bitwiseAND(F.lit(0xFFFF)))
    rows = rows.select("*", other).select(group.alias("node"), "rep", "s0", "s1")
    return rows.repartition(which).sortWithinPartitions("node").mapInPandas(_compare(p, True), "node bigint, a bigint, b bigint").select("a", "b")


def similar_pairs(reps: DataFrame, p: PathJoin = PathJoin()) -> DataFrame:
    """(a, b, similarity): pairs of representatives of at least the threshold, each once, similarity exact."""
    pairs = materialize(candidate_pairs(reps, p), "candidates")
    side = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.lit(0).alias("side")), F.struct(F.col("b").alias("rep"), F.lit(1).alias("side")))).alias("x")
    texts = pairs.select("a", "b", side).select("a", "b", "x.rep", "x.side").join(reps, "rep")
    both = texts.groupBy("a", "b").agg(F.max(F.when(F.col("side") == 0, F.col("plain"))).alias("pa"), F.max(F.when(F.col("side") == 1, F.col("plain"))).alias("pb"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            j = jaccard(x["pa"].tolist(), x["pb"].tolist())
            yield pd.DataFrame({"a": x["a"], "b": x["b"], "similarity": j})[j >= p.threshold]

    return both.mapInPandas(verify, "a bigint, b bigint, similarity double")


def near_duplicates(df: DataFrame, key: str = "id", text: str = "question", p: PathJoin = PathJoin()) -> tuple[DataFrame, DataFrame]:
    """(pairs between representatives, membership (key, rep)) over the whole table.

    Null or blank texts take no part; repeated rows of a key count once; extra columns are not looked at; an empty
    table gives two empty tables. Texts under three letters have no trigram and are similar to equal texts only.
    """
    records, reps = representatives(plain_records(df, key, text))
    return similar_pairs(reps, p), records.select("key", "rep").distinct()


def key_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of keys (id_a < id_b): those of similar texts, and those that share a text."""
    a, b = (members.select(F.col("key").alias(f"id_{x}"), F.col("rep").alias(f"rep_{x}")) for x in "ab")
    near = pairs.join(a, F.col("a") == F.col("rep_a")).join(b, F.col("b") == F.col("rep_b")).where("id_a <> id_b").select("id_a", "id_b")
    same = a.join(b, (F.col("rep_a") == F.col("rep_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    return near.unionByName(same).select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
