"""Operator 9: language-model scores by interpolated modified Kneser-Ney bigrams.

Three jobs count: words (ids are places in the vocabulary, sorted by hash), bigrams of ids, and, of each word,
its continuations and the words that it follows. Tasks count with numpy and pass on sorted keys by range; a
reducer merges one range. The model is files of sorted hash arrays in the shared folder, which workers
memory-map; nothing of the vocabulary reaches the driver, which keeps totals of ranges.

p(w | v) = max(c(v w) - D(c), 0) / c(v) + g(v) p(w), and p(w) likewise from the number of distinct words before
w, interpolated with 1 / (V + 1); the three discounts of each order come from its counts of counts. A text
starts after a boundary and finishes with an end token. Null and empty texts are the end token alone. Unknown
words share what the uniform part gives. Repeated rows count and are scored each. With no training row the
model is uniform. Words are told apart by a 64-bit hash."""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashRanges, bucket_bits, bucket_slices, crc_remainder, map_array, map_texts, mixed, read_table, shared_folder, text_blocks, write_array
from .simhash import LOWERED

#: The end token; no word holds a line feed.
END = b"\n"
#: Distinct words and bigrams that a task gathers before it passes them on, and words that it remembers.
FLUSH_WORDS, FLUSH_BIGRAMS, MEMORY_WORDS = 600_000, 3 << 20, 800_000
#: Ids of a range of the word statistics.
ID_RANGE = 1 << 18
STATS = ("follow1", "follow2", "follow3", "before")


def unmixed(x: np.ndarray) -> np.ndarray:
    """The keys that ``mixed`` made."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
        x ^= x >> np.uint64(32)
        return x * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_keys(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return mixed(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))


def tokens(texts: list[bytes]) -> list[list[bytes]]:
    return [[*t.translate(LOWERED).split(), END] for t in texts]


def count_rows(keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of bucket, keys, counts from sorted keys."""
    at = bucket_slices(keys, bits)
    which = np.flatnonzero(np.diff(at))
    counts = counts.astype(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([keys[at[b] : at[b + 1]].tobytes() for b in which], pa.binary()), pa.array([counts[at[b] : at[b + 1]].tobytes() for b in which], pa.binary())], names=["bucket", "keys", "counts"])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def merge(pdf: pd.DataFrame, key=np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.frombuffer(b"".join(pdf["keys"]), key), np.frombuffer(b"".join(pdf["counts"]), np.uint32))


class Vocabulary:
    """Ids of words: the place of a word's key among all, range after range. Unknown: -1."""

    def __init__(self, folder: str, bits: int, offsets: np.ndarray):
        self.folder, self.bits, self.offsets, self.size = folder, bits, offsets, int(offsets[-1])
        self.parts: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"parts": {}}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts."""
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        order = np.argsort(keys)
        ranked = keys[order]
        at = bucket_slices(ranked, self.bits)
        for b in np.flatnonzero(np.diff(at)).tolist():
            if b not in self.parts:
                self.parts[b] = map_array(f"{self.folder}/{b}.keys", np.uint64), map_array(f"{self.folder}/{b}.counts", np.int64)
            known, n = self.parts[b]
            if not len(known):
                continue
            mine, where = ranked[at[b] : at[b + 1]], order[at[b] : at[b + 1]]
            pos = np.searchsorted(known, mine)
            pos[pos == len(known)] = 0
            hit = known[pos] == mine
            ids[where[hit]], counts[where[hit]] = self.offsets[b] + pos[hit], n[pos[hit]]
        return ids, counts


class Numbers(dict):
    """Word to a worker's own number; new words wait in a list."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def numbered(numbers: Numbers, lists: list[list[bytes]]) -> np.ndarray:
    flat = list(chain.from_iterable(lists))
    return np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))


def discounts(n: list[int]) -> np.ndarray:
    """D of counts 0, 1, 2, 3 and more, from the numbers of keys with counts 1 to 4."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *[min(max(x, 0.01), k) for k, x in zip((1, 2, 3), d, strict=True)]])


class Model:
    """Where the files are, and the totals."""

    def __init__(self, vocabulary: Vocabulary, bits: int, folder: str, docs: int, total: int, d: np.ndarray, d_one: np.ndarray, ones: int, hist: list[int]):
        self.vocabulary, self.bits, self.folder, self.docs, self.total, self.d, self.d_one, self.ones = vocabulary, bits, folder, docs, total, d, d_one, ones
        self.base_mass = float(d_one[1] * hist[0] + d_one[2] * hist[1] + d_one[3] * hist[2]) / ones if ones else 1.0
        self.uniform = 1.0 / (vocabulary.size + 1)

    def words(self, stats: dict[str, np.ndarray], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """p(w), and the mass g(v) that a word as context leaves to p(w); 1 for an unknown one."""
        one = np.full(len(ids), self.base_mass * self.uniform)
        back = np.ones(len(ids))
        known = np.flatnonzero(ids >= 0)
        i = ids[known]
        before = stats["before"][i].astype(np.float64)
        if self.ones:
            one[known] += np.maximum(before - self.d_one[np.minimum(before, 3).astype(int)], 0) / self.ones
        mass = sum(self.d[k] * stats[f"follow{k}"][i] for k in (1, 2, 3))
        # An end token has no word after it; as a context it is never asked for.
        back[known] = np.where(mass > 0, mass / counts[known], 1.0)
        return one, back


def fit(documents: DataFrame, text: str = "text") -> Model:
    """Count all rows and leave the model in the shared folder."""
    spark = documents.sparkSession
    df = documents.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    bits = bucket_bits(df.rdd.getNumPartitions())
    folder = shared_folder(spark, "bigrams")
    vocab_folder = f"{folder}/words"
    os.makedirs(vocab_folder, exist_ok=True)

    def count_words(batches):
        numbers, counts = Numbers(), np.zeros(0, np.int64)

        def flush():
            keys, n = summed(word_keys(list(numbers)), counts)
            return count_rows(keys, n, bits)

        for batch in batches:
            for _, texts in text_blocks(batch, "text", True):
                n = np.bincount(numbered(numbers, tokens(texts)), minlength=len(numbers))
                n[: len(counts)] += counts
                counts = n
                if len(numbers) > FLUSH_WORDS:
                    yield flush()
                    numbers, counts = Numbers(), np.zeros(0, np.int64)
        if len(numbers):
            yield flush()

    def store_words(pdf):
        keys, n = merge(pdf)
        b = int(pdf["bucket"].iloc[0])
        write_array(f"{vocab_folder}/{b}.keys", keys)
        write_array(f"{vocab_folder}/{b}.counts", n)
        return pd.DataFrame({"bucket": [b], "size": [len(keys)], "total": [int(n.sum())]})

    rows = "bucket int, keys binary, counts binary"
    ranges = df.mapInArrow(count_words, rows).groupBy("bucket").applyInPandas(store_words, "bucket int, size long, total long").collect()  # 2**bits rows at most
    sizes = np.zeros(1 << bits, np.int64)
    for b, n, _ in ranges:
        sizes[b] = n
    for b in np.flatnonzero(sizes == 0):
        for k in ("keys", "counts"):
            write_array(f"{vocab_folder}/{b}.{k}", np.empty(0, np.int64))
    vocabulary = Vocabulary(vocab_folder, bits, np.concatenate([[0], np.cumsum(sizes)]))
    size, total = vocabulary.size, sum(r[2] for r in ranges)
    end_counts = vocabulary.find(word_keys([END]))[1]
    docs = int(end_counts[0])

    def count_bigrams(batches):
        numbers, ids = Numbers(), np.zeros(0, np.int64)
        held, count = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            mix = mixed(keys.view(np.uint64))
            order = np.argsort(mix)
            return count_rows(mix[order], n[order], bits)

        for batch in batches:
            for _, texts in text_blocks(batch, "text", True):
                if len(numbers) > MEMORY_WORDS:
                    numbers, ids = Numbers(), np.zeros(0, np.int64)
                lists = tokens(texts)
                own = numbered(numbers, lists)
                if numbers.new:
                    ids = np.concatenate([ids, vocabulary.find(word_keys(numbers.new))[0]])
                    numbers.new = []
                cur = ids[own]
                starts = np.cumsum([0] + [len(x) for x in lists[:-1]])
                prev = np.concatenate([[size], cur[:-1]])
                prev[starts] = size
                held.append(prev * np.int64(size + 1) + cur)
                count += len(cur)
                if count > FLUSH_BIGRAMS:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    def store_bigrams(pdf):
        keys, n = merge(pdf)
        b = int(pdf["bucket"].iloc[0])
        write_array(f"{folder}/{b}.keys", keys)
        write_array(f"{folder}/{b}.count", n.astype(np.uint32))
        pair = unmixed(keys).view(np.int64)
        v, w = pair // (size + 1), pair % (size + 1)
        out = [[-1, -1, np.array([(n == k).sum() for k in (1, 2, 3, 4)], np.uint32).tobytes(), b""]]
        for s, (ids, mask) in enumerate([(v, n == 1), (v, n == 2), (v, n >= 3), (w, n > 0)]):
            found, m = np.unique(ids[mask], return_counts=True)
            cuts = np.searchsorted(found, np.arange(0, size + ID_RANGE, ID_RANGE))
            for r in np.flatnonzero(np.diff(cuts)):
                lo, hi = cuts[r], cuts[r + 1]
                out.append([int(r), s, m[lo:hi].astype(np.uint32).tobytes(), found[lo:hi].astype(np.int64).tobytes()])
        return pd.DataFrame(out, columns=["range", "stat", "counts", "keys"])

    for b in range(1 << bits):
        for k, t in (("keys", np.uint64), ("count", np.uint32)):
            write_array(f"{folder}/{b}.{k}", np.empty(0, t))
    for s in STATS:
        with open(f"{folder}/{s}", "wb") as f:
            f.truncate(4 * (size + 1))

    def store_stats(pdf):
        """A range of one statistic, written at its place; or sums of the counts of counts."""
        r, s = int(pdf["range"].iloc[0]), int(pdf["stat"].iloc[0])
        if r < 0:
            hist = np.sum([np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["counts"]], axis=0)
            return pd.DataFrame({"stat": [-1], "n1": [int(hist[0])], "n2": [int(hist[1])], "n3": [int(hist[2])], "n4": [int(hist[3])], "more": [0], "total": [0]})
        ids, m = merge(pdf, np.int64)
        dense = np.zeros(min(ID_RANGE, size + 1 - r * ID_RANGE), np.uint32)
        dense[ids - r * ID_RANGE] = m
        fd = os.open(f"{folder}/{STATS[s]}", os.O_WRONLY)
        try:
            os.pwrite(fd, dense.tobytes(), 4 * r * ID_RANGE)
        finally:
            os.close(fd)
        return pd.DataFrame({"stat": [s], **{f"n{k}": [int((m == k).sum())] for k in (1, 2, 3, 4)}, "more": [int((m > 4).sum())], "total": [int(m.sum())]})

    stats = df.mapInArrow(count_bigrams, rows).groupBy("bucket").applyInPandas(store_bigrams, "range int, stat int, counts binary, keys binary").groupBy("range", "stat").applyInPandas(store_stats, "stat int, n1 long, n2 long, n3 long, n4 long, more long, total long").groupBy("stat").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "more", "total")]).collect()
    by = {r[0]: list(r)[1:] for r in stats}
    pairs, before = by.get(-1, [0] * 6), by.get(3, [0] * 6)
    return Model(vocabulary, bits, folder, docs, total, discounts(pairs[:4]), discounts(before[:4]), before[5], [before[0], before[1], before[2] + before[3] + before[4]])


class Scorer:
    """A worker's view of the model, and what it has looked up of the words met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.pairs = HashRanges(model.folder, model.bits, {"count": np.uint32})
        self.stats = {s: map_array(f"{model.folder}/{s}", np.uint32) for s in STATS}
        self.clear()

    def clear(self):
        self.numbers, self.ids, self.counts, self.one, self.back = Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Of each text: n_tokens, n_known, base_score (add-one) and score, both log10."""
        m = self.model
        size = m.vocabulary.size
        if len(self.numbers) > MEMORY_WORDS:
            self.clear()
        lists = tokens(texts)
        own = numbered(self.numbers, lists)
        if self.numbers.new:
            ids, counts = m.vocabulary.find(word_keys(self.numbers.new))
            one, back = m.words(self.stats, ids, counts)
            self.ids, self.counts, self.one, self.back = (np.concatenate(x) for x in ((self.ids, ids), (self.counts, counts), (self.one, one), (self.back, back)))
            self.numbers.new = []
        lengths = np.array([len(x) for x in lists])
        starts = np.cumsum(lengths) - lengths
        cur, count = self.ids[own], self.counts[own]
        prev, ctx, back = (np.concatenate([[x], y[own[:-1]]]) for x, y in ((size, self.ids), (m.docs, self.counts), (0.0, self.back)))
        prev[starts], ctx[starts] = size, m.docs
        # The boundary's mass: its statistics stand after the last word's.
        back[starts] = sum(m.d[k] * int(self.stats[f"follow{k}"][size]) for k in (1, 2, 3)) / m.docs if m.docs else 1.0
        p = back * self.one[own]
        both = np.flatnonzero((prev >= 0) & (cur >= 0))
        keys, inverse = np.unique(mixed((prev[both] * np.int64(size + 1) + cur[both]).view(np.uint64)), return_inverse=True)
        c = self.pairs.find(keys)[1]["count"].astype(np.float64)[inverse]
        p[both] += np.maximum(c - m.d[np.minimum(c, 3).astype(int)], 0) / np.maximum(ctx[both], 1)
        base = np.log10((count + 1) / (m.total + 1 * (size + 1)))
        return {"n_tokens": lengths, "n_known": np.add.reduceat((count > 0).astype(np.int64), starts), "train_tokens": np.full(len(texts), m.total), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts)}


def scores(df: DataFrame, model: Model, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, n_tokens, n_known, train_tokens, base_score, score and perplexity of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)
        return lambda texts, _: scorer.score(texts)

    out = map_texts(df, make, "n_tokens long, n_known long, train_tokens long, base_score double, score double", text, keys)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    remainder = crc_remainder("doc_id", 7)
    out = scores(docs, fit(docs.where(remainder != 2)))
    return out.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
