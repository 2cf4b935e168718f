"""Operator 6: benchmark decontamination by BM25 with block-max WAND.

The index holds the test items; the queries are passages of the documents: runs of twice ``span`` words, one
every ``span`` words, where ``span`` is the longest item's length, so that any copy of an item lies whole in a
passage. An item's score for a passage is BM25 over the distinct words they share, divided by the item's score
for itself; every item that reaches ``THRESHOLD`` is retrieved. For all passages of a block at once, numpy
sums the block maxima of the essential words (those outside the commonest that together can't reach the
threshold); passages with no block that can reach it are dropped, exactly. The rest run block-max WAND.
A retrieved item counts if the passage holds enough of the three-word shingles of its question (the first two
thirds of its words) and of its answer (the rest); of a part with one or two words, these in a row.

Null and empty texts, and items without words, match nothing. Items whose id is null or no long are looked for like
all others; each that is found is a null at the end of ``item_ids``. Repeated rows each give a row, repeated items are
each retrieved. Words are runs of ASCII letters, digits and all other non-ASCII characters, in lower case. The
index is broadcast in slices of about ``INDEX_BYTES`` of item text; more slices mean more passes with equal results."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import map_rows, map_texts, read_table

K1, B, THRESHOLD, OVERLAP = 1.2, 0.75, 0.6, 0.5
#: Items of a block, and bytes of item text that one broadcast index may hold.
BLOCK, INDEX_BYTES = 8, 32 << 20
_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
WORDS_ONLY = bytes(b if b >= 128 or b in _KEPT else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(WORDS_ONLY).split()


def shingles(words: list[bytes], size: int) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


class Index:
    """Postings by word, sorted by item, with impacts as shares of the item's own score."""

    def __init__(self, items: list[tuple[int | None, str]], whole: tuple[int, float, int, dict[bytes, int]] | None = None):
        """``whole``: number, mean length, longest length and documents with each word, of all items if these are a slice."""
        kept = sorted(((i, w) for i, t in items if t and (w := words_of(t))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        self.ids = [i for i, _ in kept]
        self.parts = []
        for _, w in kept:
            cut = max(1, math.ceil(len(w) * 2 / 3))
            self.parts.append([(k := min(3, len(part)), shingles(part, k)) for part in (w[:cut], w[cut:])])
        n = len(kept)
        counts = [Counter(w) for _, w in kept]
        held = Counter(t for c in counts for t in c)
        all_n, mean, self.span, df = whole or (n, sum(len(w) for _, w in kept) / max(n, 1), max((len(w) for _, w in kept), default=1), held)
        self.term = {t: k for k, t in enumerate(sorted(held))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for i, c in enumerate(counts):
            size = sum(c.values())
            raw = {t: math.log(1 + (all_n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in c.items()}
            own = sum(raw.values())
            for t, x in raw.items():
                postings[self.term[t]].append((i, x / own))
        self.postings = postings
        self.top = [max(x for _, x in p) for p in postings]
        self.block_top = [{} for _ in postings]
        for t, p in enumerate(postings):
            for i, x in p:
                b = i // BLOCK
                self.block_top[t][b] = max(self.block_top[t].get(b, 0.0), x)
        # The commonest words are non-essential as long as all of them together stay below half the threshold.
        sums, self.slack = np.zeros(n), np.zeros(n)
        essential = np.ones(len(postings), bool)
        for t in sorted(range(len(postings)), key=lambda t: -len(postings[t])):
            if len(postings[t]) < 4:
                break
            for i, x in postings[t]:
                sums[i] += x
            if n and sums.max() > THRESHOLD / 2:
                for i, x in postings[t]:
                    sums[i] -= x
                continue
            essential[t] = False
        blocks = -(-n // BLOCK)
        self.block_slack = np.array([sums[b * BLOCK : (b + 1) * BLOCK].max() for b in range(blocks)]) if n else np.zeros(0)
        flat = [(b, x) for t in range(len(postings)) if essential[t] for b, x in sorted(self.block_top[t].items())]
        self.sizes = np.array([len(self.block_top[t]) if essential[t] else 0 for t in range(len(postings))] + [0], np.int64)
        self.firsts = np.cumsum(self.sizes) - self.sizes
        self.flat_block, self.flat_top = np.array([b for b, _ in flat], np.int64), np.array([x for _, x in flat])

    def named(self, found) -> list[int | None]:
        """Distinct ids in order, then a null for each item without one."""
        ids = [self.ids[i] for i in found]
        return sorted({i for i in ids if i is not None}) + [None] * ids.count(None)

    def candidates(self, terms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Passages (terms[starts:ends], -1 for none) with a block whose maxima can reach the threshold."""
        blocks = len(self.block_slack)
        hits = np.flatnonzero(self.sizes[terms] > 0)
        first, last = np.searchsorted(hits, starts), np.searchsorted(hits, ends)
        lengths = last - first
        own = np.repeat(np.arange(len(starts)), lengths)
        t = terms[hits[np.arange(len(own)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(first, lengths)]]
        if not len(t):
            return np.empty(0, np.int64)
        pairs = np.unique(own * np.int64(len(self.sizes)) + t)
        own, t = pairs // len(self.sizes), pairs % len(self.sizes)
        width = self.sizes[t]
        post = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.firsts[t], width)
        key = np.repeat(own, width) * blocks + self.flat_block[post]
        keys, inverse = np.unique(key, return_inverse=True)
        bound = np.bincount(inverse, self.flat_top[post]) + self.block_slack[keys % blocks]
        return np.unique(keys[bound >= THRESHOLD - 1e-9] // blocks)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for these distinct words reaches the threshold, by block-max WAND."""
        out, floor = [], THRESHOLD - 1e-9
        lists = [[self.postings[t], 0, t] for t in terms]
        while lists:
            lists.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.top[t]
                if bound >= floor:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.block_top[t].get(block, 0.0) for _, _, t in lists[: pivot + 1]) < floor:
                # No item of this block up to the next list's place can reach it.
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, max(lists[pivot + 1][0][lists[pivot + 1][1]][0], item + 1))
                to = max(to, item + 1)
            elif lists[0][0][lists[0][1]][0] == item:
                score = 0.0
                for c in lists[: pivot + 1]:
                    score += c[0][c[1]][1]
                if score >= floor:
                    out.append((item, score))
                to = item + 1
            else:
                to = item
            for c in lists[: pivot + 1]:
                while c[1] < len(c[0]) and c[0][c[1]][0] < to:
                    c[1] += 1
            lists = [c for c in lists if c[1] < len(c[0])]
        return out

    def search(self, texts: list[str]) -> list[tuple[int, dict[int, float]]]:
        """Of each text: its number of passages, and its verified items with their best scores."""
        words = [words_of(t) for t in texts]
        flat = list(chain.from_iterable(words))
        terms = np.fromiter(map(self.term.get, flat, repeat(-1)), np.int64, len(flat))
        begin = np.cumsum([0] + [len(w) for w in words])
        doc, starts, ends = [], [], []
        for d, w in enumerate(words):
            s = np.arange(0, max(len(w) - self.span, 1) if w else 0, self.span)
            doc.append(np.full(len(s), d))
            starts.append(begin[d] + s)
            ends.append(begin[d] + np.minimum(s + 2 * self.span, len(w)))
        doc, starts, ends = np.concatenate(doc or [[]]), np.concatenate(starts or [[]]).astype(np.int64), np.concatenate(ends or [[]]).astype(np.int64)
        found: list[dict[int, float]] = [{} for _ in texts]
        for p in self.candidates(terms, starts, ends) if self.ids and len(starts) else ():
            mine = terms[starts[p] : ends[p]]
            hits = self.wand(sorted(set(mine[mine >= 0].tolist())))
            if not hits:
                continue
            d = int(doc[p])
            passage = words[d][starts[p] - begin[d] : ends[p] - begin[d]]
            held = {k: shingles(passage, k) for k in {k for item, _ in hits for k, _ in self.parts[item]}}
            for item, score in hits:
                if all(len(part & held[k]) >= OVERLAP * len(part) for k, part in self.parts[item]):
                    found[d][item] = max(score, found[d].get(item, 0.0))
        passages = np.bincount(doc.astype(np.int64), minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        return [(int(n), f) for n, f in zip(passages, found, strict=True)]


def indexes(benchmark: DataFrame, item_id: str, item_text: str, index_bytes: int) -> Iterator[Index]:
    """An index of each slice of about ``index_bytes``, all with the word statistics of the whole benchmark."""
    items = benchmark.select(F.col(item_id).try_cast("long").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-size // index_bytes))
    if slices == 1:
        yield Index([tuple(r) for r in items.collect()])
        return
    words = F.udf(lambda t: words_of(t or ""), "array<binary>")
    items = checkpointed(items.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices))).withColumn("w", words("t")))
    n, mean, span = items.where(F.size("w") > 0).agg(F.count("*"), F.avg(F.size("w")), F.max(F.size("w"))).first()
    each = items.select("part", F.explode(F.array_distinct("w")).alias("w"))
    counts = checkpointed(each.groupBy("w").count())
    for part in range(slices):
        mine = items.where(F.col("part") == part).select("i", "t").collect()  # at most about index_bytes, as the words below
        df = counts.join(each.where(F.col("part") == part).select("w").distinct(), "w", "left_semi").collect()
        yield Index([tuple(r) for r in mine], (n or 0, mean or 0.0, span or 1, {bytes(r[0]): r[1] for r in df}))


def contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``keys``, n_passages, item_ids (array of the items found, sorted) and score (the best; 0 if none)."""

    def one(df: DataFrame, index: Index, keys: tuple[str, ...]) -> DataFrame:
        index = df.sparkSession.sparkContext.broadcast(index)

        def make():
            def f(texts, _):
                x = index.value
                found = x.search(texts)
                return {"n_passages": [n for n, _ in found], "item_ids": [x.named(y) for _, y in found], "score": [min(1.0, max(y.values(), default=0.0)) for _, y in found]}

            return f

        return map_texts(df, make, "n_passages long, item_ids array<long>, score double", text, keys, as_bytes=False, limit=1 << 20)

    slices = indexes(benchmark, item_id, item_text, index_bytes)
    first, second = next(slices), next(slices, None)
    if second is None:
        return one(df, first, keys)
    # The passes meet by a row number that stands in the checkpoint, as keys may repeat or be null.
    rows = checkpointed(df.select(*dict.fromkeys((*keys, text)), F.monotonically_increasing_id().alias("__row")))
    out = one(rows, first, ("__row", *keys))
    for index in chain([second], slices):
        out = out.unionByName(one(rows, index, ("__row", *keys)))
    ids = F.flatten(F.collect_list("item_ids"))
    met = out.groupBy("__row").agg(*[F.first(k).alias(k) for k in keys], F.max("n_passages").alias("n_passages"), ids.alias("item_ids"), F.max("score").alias("score"))
    named = F.concat(F.array_sort(F.array_distinct(F.array_compact("item_ids"))), F.filter("item_ids", lambda i: i.isNull()))
    return met.select(*keys, "n_passages", named.alias("item_ids"), "score")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_passages", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), F.array_join("item_ids", ",").alias("item_ids"), "score")


def clean_rows(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Rows, with all their columns, in whose text no item was found; a null text is clean."""
    for one in indexes(benchmark, item_id, item_text, index_bytes):
        index = df.sparkSession.sparkContext.broadcast(one)

        def make(index=index):
            return lambda texts, block: block.filter(pa.array([not found for _, found in index.value.search(texts)], pa.bool_()))

        df = map_rows(df, make, text, limit=1 << 20)
    return df
