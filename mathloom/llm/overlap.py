"""The same or nearly the same record across splits (problem 3).

An Aho-Corasick automaton over all trigrams of a shard of evaluation texts (in plain form) scans every training text
once, at every position. Which of them decide that two texts are compared loses no pair: texts similar at the
threshold share so many trigrams that, both sorted in one order, the first one they share stands near the beginning of
either (how near, follows from the two sizes and the threshold). The order is by frequency in the shard, rarest first,
and trigrams of no evaluation text before all others, so few unrelated texts meet. What meets is sifted by odd
sketches where these lose no pair (see ``simjoin``; up to 192 trigrams) and compared exactly; the matched windows of
``width`` characters, at all positions, are merged into the coverage of the evaluation text.

Shards hold about ``shard_rows`` texts, whatever the number of texts, which bounds an automaton's memory; blocks hold
about ``block_rows`` training texts. Both are files in the shared folder; a task scans one block with one shard's
automaton, which a worker keeps for its next task.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.llm.shingles import jaccard, mix, token_hashes, trigram_codes
from mathloom.llm.simjoin import half_bound, plain_records, representatives, sketches
from mathloom.sources.shared import expire, materialize, new_path


@dataclass(frozen=True)
class Overlap:
    threshold: float = 0.6
    width: int = 6
    shard_rows: int = 120_000
    block_rows: int = 60_000
    chunk: int = 500_000


def text_sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(two odd sketches, numbers of trigrams) of the texts."""
    h, offsets = token_hashes(texts)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), sizes)
    return np.hstack([sketches(h, doc, sizes), sketches(mix(h), doc, sizes)]), sizes


_SKETCH = ["s0", "s1", "s2", "s3"]
_SKETCHED = "s0 bigint, s1 bigint, s2 bigint, s3 bigint, size bigint"


def sketch_table(texts: list[str]) -> pd.DataFrame:
    sketch, sizes = text_sketches(texts)
    return pd.DataFrame(sketch.view(np.int64), columns=_SKETCH).assign(size=sizes)


def covered(starts: list[int], width: int) -> int:
    """Length of the union of the intervals of ``width`` characters that begin at the (sorted) starts."""
    return sum(min(b - a, width) for a, b in zip(starts, [*starts[1:], starts[-1] + width])) if starts else 0


def least_shared(sizes: np.ndarray, share: float) -> np.ndarray:
    """The least whole number that is at least this share of the sizes."""
    return np.ceil(sizes * share - 1e-9).astype(np.int64)


_FINE = 1024  # parts of one in which the rooms of postings are sorted


class Shard:
    """Automaton, postings, texts and sketches of one shard of evaluation records (rep, plain, sketches, size).

    A token is a trigram's place in the order, rarest first. A posting is a record under one of its first tokens:
    ``room`` is how many of its tokens are left from that one on, and so how many a text can share with it that shares
    none before. Postings of a token are sorted by room less the part of the shared tokens that the record's own size
    asks for, largest first, so a text's size tells how many of them it meets.
    """

    def __init__(self, rows: pd.DataFrame, p: Overlap) -> None:
        import ahocorasick

        self.p, self.reps, self.texts = p, rows["rep"].to_numpy(), rows["plain"].tolist()
        self.share = p.threshold / (1 + p.threshold)  # of the sum of two sizes that similar texts have in common at least
        self.sketch, self.sizes = rows[_SKETCH].to_numpy(np.int64).view(np.uint64), rows["size"].to_numpy(np.int64)
        self.half = half_bound(self.sizes, p.threshold)
        # texts without trigrams are similar to equal ones only
        self.short = {t: d for d, t in enumerate(self.texts) if not self.sizes[d]}
        parts = [trigram_codes(self.texts[a : a + 20_000])[0] for a in range(0, len(self.texts), 20_000)]
        codes, token, many = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        place = np.empty(len(codes), np.int64)
        place[np.argsort(many, kind="stable")] = np.arange(len(codes))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        three = np.stack([codes >> np.uint64(42), codes >> np.uint64(21), codes], axis=1) & np.uint64(0x1FFFFF)
        for w, i in zip(three.astype(np.uint32).view("<U3").ravel().tolist(), place.tolist()):
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        doc, token, room = self._first(np.repeat(np.arange(len(self.texts)), self.sizes), place[token], self.sizes)
        spare = np.floor((room - self.share * self.sizes[doc]) * _FINE + 1e-3).astype(np.int64)
        self.step = int(spare.max(initial=0)) + 2
        by = token * self.step - spare
        order = np.argsort(by)
        self.by, self.doc, self.room = by[order], doc[order].astype(np.int32), room[order].astype(np.int32)
        self.size = self.sizes[self.doc].astype(np.int32)
        self.at = np.r_[0, np.cumsum(np.bincount(token, minlength=len(codes)))]

    def _first(self, doc: np.ndarray, token: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, token, room) of the first tokens of each text, as many as a similar text can't lack all of;
        ``token`` are those in the order, all others of a text's ``sizes`` come before them."""
        key = np.sort((doc << 32) | token)
        doc, token = key >> 32, key & 0xFFFFFFFF
        room = np.searchsorted(doc, np.arange(len(sizes)), side="right")[doc] - np.arange(len(doc))
        first = room >= least_shared(sizes, self.p.threshold)[doc]
        return doc[first], token[first], room[first]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, token) of the distinct trigrams of the texts that the automaton knows."""
        docs, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts) if len(self.automaton) else 0, 4096):
            found = [{w for _, w in self.automaton.iter(t)} for t in texts[a : a + 4096]]
            many = np.fromiter(map(len, found), np.int64, len(found))
            docs.append(np.repeat(np.arange(a, a + len(found)), many))
            tokens.append(np.fromiter(chain.from_iterable(found), np.int64, many.sum()))
        return np.concatenate(docs), np.concatenate(tokens)

    def scan(self, texts: list[str], sketch: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, record number) of all that may be similar."""
        i, w, room = self._first(*self.tokens(texts), sizes)
        half = half_bound(sizes, self.p.threshold)
        most = w * self.step - np.floor(sizes[i] * (self.share * _FINE)).astype(np.int64) + 2
        order = np.argsort(most)  # postings are then read in their order
        i, room, most, begins = i[order], room[order], most[order], self.at[w[order]]
        k = np.searchsorted(self.by, most, side="right") - begins
        some = k > 0
        i, room, begins, k = i[some], room[some], begins[some], k[some]
        size = sizes[i]
        ends = np.cumsum(k)
        out = [np.array([(t << 32) | self.short[x] for t, x in enumerate(texts) if x in self.short], np.int64)]
        begin = 0
        while begin < len(k):  # a bounded number of postings at a time
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + self.p.chunk, side="right")))
            c = k[begin:end]
            at = np.repeat(begins[begin:end] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            spread = lambda x: np.repeat(x[begin:end], c)
            near = np.flatnonzero(np.minimum(spread(room), self.room[at]) >= (spread(size) + self.size[at]) * self.share - 1e-6)
            text, doc = spread(i)[near], self.doc[at[near]].astype(np.int64)
            for a in (0, 2):
                apart = sum(np.bitwise_count(sketch[text, b] ^ self.sketch[doc, b]) for b in (a, a + 1))
                keep = apart <= half[text] + self.half[doc]
                text, doc = text[keep], doc[keep]
            out.append(np.unique((text << 32) | doc))
            begin = end
        both = np.unique(np.concatenate(out))
        return both >> 32, both & 0xFFFFFFFF

    def coverage(self, d: int, text: str) -> float:
        """Share of the characters of record d that stand in windows found in the text; a text shorter than a window is
        one window."""
        t, width = self.texts[d], min(self.p.width, len(self.texts[d]))
        held = {text[s : s + width] for s in range(len(text) - width + 1)}
        return covered([s for s in range(len(t) - width + 1) if t[s : s + width] in held], width) / len(t)


_HELD: dict[str, Shard] = {}


def _stored(path: str) -> Shard:
    """The shard's automaton, loaded once for the tasks that a worker runs on it in a row."""
    if path not in _HELD:
        import pyarrow.fs as fs

        _HELD.clear()
        where, inside = fs.FileSystem.from_uri(path)
        with where.open_input_stream(inside, compression="zstd") as f:
            _HELD[path] = pickle.loads(f.read())
    return _HELD[path]


def _block(path: str) -> pd.DataFrame:
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    where, inside = fs.FileSystem.from_uri(path)
    return pq.read_table(inside, filesystem=where, columns=["key", "plain", *_SKETCH, "size"], partitioning=None).to_pandas()


def _similar(shard: Shard, rows: pd.DataFrame) -> pd.DataFrame:
    """Scan the distinct texts, then the exact similarity and the coverage of the pairs found."""
    number, distinct = pd.factorize(rows["plain"])
    texts = distinct.tolist()
    one = rows.iloc[np.unique(number, return_index=True)[1]]
    at, rec = shard.scan(texts, one[_SKETCH].to_numpy(np.int64).view(np.uint64), one["size"].to_numpy(np.int64))
    j = jaccard([texts[i] for i in at], [shard.texts[d] for d in rec])
    keep = j >= shard.p.threshold
    at, rec = at[keep], rec[keep]
    found = pd.DataFrame({"text": at, "rep": shard.reps[rec], "similarity": j[keep], "coverage": [shard.coverage(d, texts[i]) for i, d in zip(at, rec)]})
    return pd.DataFrame({"train_id": rows["key"].to_numpy(), "text": number}).merge(found, on="text")[["train_id", "rep", "similarity", "coverage"]]


def cross_split(train: DataFrame, evaluation: DataFrame, key: str = "id", text: str = "question", tags: tuple[str, ...] = (), p: Overlap = Overlap()) -> tuple[DataFrame, DataFrame]:
    """(pairs (train_id, rep, similarity, coverage) at or over the threshold, membership (key, rep, tags) of the
    evaluation records; tags are columns carried along as strings, such as the split).

    Null texts and texts without letters or digits take part in nothing; an empty side gives no pairs; repeats of a
    row count once; other columns are not looked at. Texts under three letters match equal texts only.
    """
    spark = train.sparkSession
    records, reps = representatives(materialize(plain_records(evaluation, key, text, *tags), "records"))
    members = records.select("key", "rep", *tags).distinct()
    n = reps.count()
    schema = "train_id bigint, rep bigint, similarity double, coverage double"
    if not n:
        return spark.createDataFrame([], schema), members
    where = new_path(spark, "overlap")

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.concat([b.reset_index(drop=True), sketch_table(b["plain"].tolist())], axis=1)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        import pyarrow.fs as fs

        shard = Shard(rows, p)
        path = f"{where}/shards/{uuid.uuid4().hex}"  # a task that is run again writes a file of its own
        at, inside = fs.FileSystem.from_uri(path)
        at.create_dir(inside.rsplit("/", 1)[0])
        with at.open_output_stream(inside, compression="zstd") as f:
            f.write(pickle.dumps(shard, 5))
        return pd.DataFrame({"path": [path]})

    of = F.pmod(F.xxhash64(F.col("rep"), F.lit(7)), F.lit(-(-n // p.shard_rows))).alias("shard")
    built = reps.mapInPandas(sketched, f"rep bigint, plain string, {_SKETCHED}").groupBy(of).applyInPandas(build, "path string")
    shards = [r["path"] for r in materialize(built, "shards").collect()]  # one path a shard
    trained = plain_records(train, key, text, extend=sketch_table, schema=_SKETCHED).drop("rep")  # sketched once for all shards
    blocks = max(-(-spark.sparkContext.defaultParallelism // len(shards)), -(-train.count() // p.block_rows))
    trained.repartition(blocks).write.option("compression", "zstd").parquet(f"{where}/train")  # in turn, so no key is hot
    expire(spark, where)
    files = sorted(spark.read.schema(trained.schema).parquet(f"{where}/train").inputFiles())
    if not files:
        return spark.createDataFrame([], schema), members

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in b["id"].tolist():
                rows = _block(files[i % len(files)])
                if len(rows):
                    yield _similar(_stored(shards[i // len(files)]), rows)

    tasks = len(shards) * len(files)
    found = spark.range(0, tasks, 1, tasks).mapInPandas(scan, schema)
    return found.dropDuplicates(["train_id", "rep"]), members
