"""Operator 1: byte-level BPE encoding and decoding.

Words of the pre-tokenizer are encoded in batches: the symbols of all words that a block brings for the first
time stand in one flat array, the lowest-ranked pair of each word is found by binary search over the sorted
pair keys, and all words merge in step, round by round. Decoding joins the bytes of the ids.

Null and empty texts have no ids and decode to the empty string. Repeated rows each give their row. A text is
never cut: words of over ``LONG_WORD`` bytes, where rounds would take quadratic time, merge by a heap instead,
with the same result. The string of an added token in a text is that token, as in the tokenizers library."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read_table

LONG_WORD = 256
#: Words that a worker remembers at most; then it forgets all.
MEMORY_WORDS = 600_000
BIG = np.int64(1) << 40

#: The byte-level pre-tokenizer's pattern, and the same for texts within Latin-1.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_LETTERS, LATIN_NUMBERS, LATIN_SPACES = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t\n\x0b\x0c\r\x85\xa0"
LATIN_PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{LATIN_SPACES}{LATIN_LETTERS}{LATIN_NUMBERS}]+|[{LATIN_SPACES}]+(?![^{LATIN_SPACES}])|[{LATIN_SPACES}]+"


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def vocabulary(path: str) -> tuple[dict, list[bytes], dict[str, int]]:
    """The file's JSON, the bytes of each id, and the added tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in byte_characters().items()}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = [b""] * (1 + max([*spec["model"]["vocab"].values(), *added.values()]))
    for token, i in [*spec["model"]["vocab"].items(), *added.items()]:
        pieces[i] = bytes(back[c] for c in token)
    return spec, pieces, added


class Bpe:
    """The tokenizer's tables and the words met so far."""

    def __init__(self, path: str):
        spec, self.pieces, self.added = vocabulary(path)
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        self.byte_ids = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.width = np.int64(len(self.pieces))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.names = [str(i) for i in range(len(self.pieces))]
        self.known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("patterns", "table")} | {"known": {}}

    def words(self, text: str) -> list[str]:
        if "patterns" not in self.__dict__:
            import regex

            self.patterns = re.compile(LATIN_PATTERN), regex.compile(PATTERN)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.patterns[1].findall(text)
        return self.patterns[0].findall(text)

    def split(self, text: str) -> list[str]:
        """Words and added tokens of a text."""
        if not any(t in text for t in self.added):
            return self.words(text)
        cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        return list(chain.from_iterable([x] if x in self.added else self.words(x) for x in cut.split(text)))

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys

    def merge_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, merging all words in step."""
        out: list[tuple[int, ...]] = [()] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        own = np.repeat(np.arange(len(words)), lengths)
        done = []
        # Of the pair that starts at each symbol: its rank, and the symbol that it becomes.
        at, hit = self.look_up(sym[:-1] * self.width + sym[1:])
        hit &= own[1:] == own[:-1]
        rank, into = np.append(np.where(hit, self.ranks[at], BIG), BIG), np.append(self.merged[at], 0)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            ready = best == BIG
            if ready.any():
                done.append((own[ready], sym[ready]))
                own, sym, rank, into, best = (x[~ready] for x in (own, sym, rank, into, best))
            pick = np.flatnonzero(rank == best)
            if not len(pick):
                break
            # Of overlapping equal pairs every other one merges, from the left.
            heads = np.where(np.concatenate([[True], np.diff(pick) != 1]), pick, 0)
            pick = pick[(pick - np.maximum.accumulate(heads)) % 2 == 0]
            sym[pick] = into[pick]
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            own, sym, rank, into = (x[keep] for x in (own, sym, rank, into))
            # Only pairs beside a new symbol have changed.
            new = pick - np.arange(len(pick))
            changed = np.zeros(len(sym), bool)
            changed[new] = changed[np.maximum(new - 1, 0)] = True
            new = np.flatnonzero(changed)
            inner = new[new < len(sym) - 1]
            inner = inner[own[inner] == own[inner + 1]]
            rank[new] = BIG
            at, hit = self.look_up(sym[inner] * self.width + sym[inner + 1])
            rank[inner], into[inner] = np.where(hit, self.ranks[at], BIG), self.merged[at]
        if done:
            own, sym = np.concatenate([o for o, _ in done]), np.concatenate([s for _, s in done])
            order = np.argsort(own, kind="stable")
            own, ids = own[order], sym[order].tolist()
            bounds = np.searchsorted(own, np.arange(len(words) + 1)).tolist()
            out = [tuple(ids[bounds[i] : bounds[i + 1]]) for i in range(len(words))]
        return out

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word, by a heap of its pairs."""
        if "table" not in self.__dict__:
            self.table = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        width, table, n = int(self.width), self.table, len(word)
        sym, after, before = self.byte_ids[np.frombuffer(word, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*table[k], i, sym[i], sym[i + 1]) for i in range(n - 1) if (k := sym[i] * width + sym[i + 1]) in table]
        heap = [(r, i, m, a, b) for r, m, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], sym[j], after[i] = m, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and (q := after[p]) < n and (x := table.get(sym[p] * width + sym[q])):
                    heapq.heappush(heap, (x[0], p, x[1], sym[p], sym[q]))
        return tuple(s for s in sym if s >= 0)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each whole text."""
        lists = [self.split(t) for t in texts]
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        # The string of an added token is never a word, for texts are cut there.
        self.known.update((t, (i,)) for t, i in self.added.items())
        fresh = set().union(*lists) - self.known.keys()
        data = {w: w.encode() for w in fresh}
        short = [w for w, b in data.items() if len(b) <= LONG_WORD]
        self.known.update(zip(short, self.merge_words([data[w] for w in short]), strict=True))
        long = {w: self.merge_long(b) for w, b in data.items() if len(b) > LONG_WORD}
        self.known.update(long)
        ids = [list(chain.from_iterable(map(self.known.__getitem__, ws))) for ws in lists]
        for w in long:
            del self.known[w]
        return ids

    def decode(self, lists: list[list[int]]) -> list[str]:
        """The text of each list of ids; special tokens are kept, broken UTF-8 is replaced."""
        pieces = self.pieces
        return [b"".join([pieces[i] for i in ids]).decode("utf-8", "replace") for ids in lists]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``ids`` array<int> of every whole text."""
    model = df.sparkSession.sparkContext.broadcast(Bpe(path))

    def make():
        return lambda texts, _: {"ids": model.value.encode(texts)}

    return map_texts(df, make, "ids array<int>", text, keys, as_bytes=False)


def decode(df: DataFrame, path: str, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``text`` of every list of ids (null: empty)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    model = df.sparkSession.sparkContext.broadcast(Bpe(path))
    df = df.select(*keys, ids)
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                lists = [x or [] for x in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(model.value.decode(lists), pa.string())], names=[*keys, "text"])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode in one pass: ``keys``, n_tokens, ids_sha256, decoded_sha256, n_bytes."""
    model = df.sparkSession.sparkContext.broadcast(Bpe(path))

    def make():
        bpe = model.value
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def f(texts, _):
            lists = bpe.encode(texts)
            decoded = [t.encode() for t in bpe.decode(lists)]
            names = bpe.names
            return {"n_tokens": [len(x) for x in lists], "ids_sha256": [sha(",".join([names[i] for i in x]).encode()) for x in lists], "decoded_sha256": [sha(b) for b in decoded], "n_bytes": [len(b) for b in decoded]}

        return f

    return map_texts(df, make, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long", text, keys, as_bytes=False, limit=1 << 20)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), default_vocabulary())


def encoded_documents(df: DataFrame, path: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, the ids of every whole text, their number and digest, and the digest of what they decode to."""
    model = df.sparkSession.sparkContext.broadcast(Bpe(path))

    def make():
        bpe = model.value

        def f(texts, _):
            lists = bpe.encode(texts)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            return {"n_tokens": [len(x) for x in lists], "ids": lists, "ids_sha256": [sha(",".join([bpe.names[i] for i in x])) for x in lists], "decoded_sha256": list(map(sha, bpe.decode(lists)))}

        return f

    return map_texts(df, make, "n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string", text, keys, as_bytes=False, limit=1 << 20)
