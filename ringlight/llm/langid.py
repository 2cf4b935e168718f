"""Operator 2: language identification by multinomial naive Bayes over hashed character n-grams.

Counts of hashed n-grams by language come from all labelled training rows, summed in Spark; the driver gets
one row for each language and bucket, at most languages x ``BUCKETS``, and broadcasts the matrix of
log-probabilities. A block of texts is scored at once: each n-gram's row of the matrix, summed by text.

A text that is null or has no letter is ``und`` with score 0. Ties go to the language that sorts first. With
no labelled row nothing is learned and every text is ``und``. Repeated rows each count and each give a row."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, map_rows, map_texts, read_table

#: Lengths of the n-grams, buckets of their hashes, and what is added to each count.
ORDERS, BUCKETS, SMOOTHING = (1, 2, 3), 1 << 14, 0.5
UNKNOWN = "und"
#: Languages of a model at most: its matrix then has 64 MB.
MOST_LANGUAGES = 1000
LETTER = re.compile(r"[^\W\d_]")


def hashed(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each text begins among the block's code points, and for each order the bucket of the n-gram
    that starts there; bucket ``BUCKETS`` stands for none."""
    joined = "\0\0".join(t.lower() for t in texts) + "\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    ends = starts + lengths
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            x = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32)
            x[ends - 1] = x[ends - 2] = BUCKETS
            out.append(x)
    return starts, out


def counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """n-gram counts of the labelled texts: lang, bucket, n; a task gives each pair once."""
    df = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def run(batches):
        from .common import text_blocks

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for block, texts in text_blocks(batch, "text", False):
                langs = block.column(0).to_pylist()
                for g in set(langs):
                    _, grams = hashed([t for t, x in zip(texts, langs, strict=True) if x == g])
                    for x in grams:
                        sums[g] = sums.get(g, 0) + np.bincount(x, minlength=BUCKETS + 1)[:BUCKETS]
        for g, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return df.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-probabilities: a row for each bucket and one of zeros, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], priors: dict[str, int]):
        self.langs = sorted(priors)
        column = {g: i for i, g in enumerate(self.langs)}
        n = np.zeros((BUCKETS, len(self.langs)))
        for g, b, c in rows:
            n[b, column[g]] = c
        n += SMOOTHING
        self.matrix = np.zeros((BUCKETS + 1, len(self.langs)), np.float32)
        self.matrix[:BUCKETS] = np.log(n / n.sum(axis=0, keepdims=True)) if self.langs else 0
        total = sum(priors.values())
        self.prior = np.log(np.array([priors[g] / total for g in self.langs])) if total else np.zeros(0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        starts, grams = hashed(texts)
        total = np.tile(self.prior, (len(texts), 1))
        for x in grams:
            for j in range(len(self.langs)):
                total[:, j] += np.add.reduceat(self.columns[j][x], starts, dtype=np.float64)
        best = total.argmax(axis=1)
        top = np.exp(total - total.max(axis=1, keepdims=True))
        score = 1 / top.sum(axis=1)
        lettered = np.array([bool(LETTER.search(t)) for t in texts])
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)

    @property
    def columns(self) -> list[np.ndarray]:
        if "_columns" not in self.__dict__:
            self._columns = [np.ascontiguousarray(self.matrix[:, j]) for j in range(len(self.langs))]
        return self._columns


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """The model of all labelled texts. Its matrix is broadcast: more than ``MOST_LANGUAGES`` languages raise ValueError."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(lang).cast("string")).count().limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    priors = {r[0]: r[1] for r in known}
    rows = counts(df, text, lang).collect()  # at most MOST_LANGUAGES x BUCKETS rows
    return LanguageModel([tuple(r) for r in rows], {g: n for g, n in priors.items() if g in {r[0] for r in rows}})


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, lang_pred and score of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(texts, _):
            langs, scores = shared.value.predict(texts)
            return {"lang_pred": langs, "score": scores}

        return f

    return map_texts(df, make, "lang_pred string, score double", text, keys, as_bytes=False, limit=1 << 20)


def training_rows(documents: DataFrame) -> DataFrame:
    """Rows whose crc32 of the id, modulo 5, is not 0."""
    return documents.where(crc_remainder("doc_id", 5) != 0)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, fit(training_rows(docs)))
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def accepted(df: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows, with all their columns, whose text has a language and is at least ``least`` sure of it."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(texts, block):
            langs, scores = shared.value.predict(texts)
            return block.filter(pa.array([g != UNKNOWN and bool(x >= least) for g, x in zip(langs, scores, strict=True)], pa.bool_()))

        return f

    return map_rows(df, make, text, limit=1 << 20)
