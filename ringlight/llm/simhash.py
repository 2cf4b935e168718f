"""Operator 7: near duplicates by SimHash, compared exactly tile by tile.

Fingerprints with equal bits are one node. Nodes stand in tiles by their count of set bits, at most about
``TILE`` nodes each; only pairs of tiles whose counts lie within the radius meet, each pair in one task. There,
sub-tiles of like counts in the four quarters are compared by exclusive-or and bit counts, all bits of all
pairs that the quarters' counts don't rule out. A task returns a spanning forest of the links that it finds,
so a group of many near copies gives as many edges as it has members. Components come from the edges.

A text with no word (null, empty, white space) has fingerprint zero and is linked like any other. Repeated
rows each give a row. A document with a null id is no node: its component is that of its fingerprint's group if
that holds an id, else null. Work grows with the square of the number of distinct fingerprints, cut by the
tiles that the counts rule out: that is the method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import checkpointed
from .common import map_texts, read_table

RADIUS, WORDS, SEED = 3, 3, 42
#: Nodes of a tile, rows of a sub-tile, and rows that a sub-tile meets at a time.
TILE, SUB, STRIP = 32_768, 256, 8_192
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
LOWERED = bytes.maketrans(UPPER, LOWER)


def shingle_hashes(data: bytes, width: int) -> list[int]:
    from xxhash import xxh64_intdigest

    words = data.translate(LOWERED).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(data: bytes, width: int = WORDS) -> int:
    """A bit is set if over half of the shingles' hashes have it."""
    h = np.array(shingle_hashes(data, width), np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), width: int = WORDS) -> DataFrame:
    """``keys`` and ``fp``, the fingerprint's bits as a long."""

    def make():
        return lambda texts, _: {"fp": np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)}

    return map_texts(df, make, "fp long", text, keys)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the links i-j."""
    p = np.arange(n)
    while True:
        a, b = p[i], p[j]
        apart = a != b
        if not apart.any():
            return p
        np.minimum.at(p, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (p != p[p]).any():
            p = p[p]
        i, j = i[apart], j[apart]


def quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def compare(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within ``left``, or between ``left`` and ``right`` (whose nodes follow)."""
    def laid(fp):
        q = quarters(fp)
        order = np.lexsort(q.T[::-1])
        at = np.arange(0, len(fp), SUB)
        return fp[order], order, np.minimum.reduceat(q[order], at), np.maximum.reduceat(q[order], at)

    a, a_at, a_lo, a_hi = laid(left)
    b, b_at, b_lo, b_hi = laid(right) if right is not None else (a, a_at, a_lo, a_hi)
    shift = len(left) if right is not None else 0
    n = shift + len(b)
    keep_i, keep_j, held = [], [], 0
    for s in range(len(a_lo)):
        gap = np.maximum(0, np.maximum(b_lo - a_hi[s], a_lo[s] - b_hi)).sum(axis=1)
        if right is None:
            gap[:s] = radius + 1
        subs = np.flatnonzero(gap <= radius)
        if not len(subs):
            continue
        rows = (subs[:, None] * SUB + np.arange(SUB)).ravel()
        rows = rows[rows < len(b)]
        mine = a[s * SUB : (s + 1) * SUB]
        for lo in range(0, len(rows), STRIP):
            part = rows[lo : lo + STRIP]
            x, y = np.nonzero(np.bitwise_count(mine[:, None] ^ b[part][None, :]) <= radius)
            if len(x):
                keep_i.append(a_at[s * SUB + x])
                keep_j.append(shift + b_at[part[y]])
                held += len(x)
        if held > 1 << 21:
            p = forest(n, np.concatenate(keep_i), np.concatenate(keep_j))
            linked = np.flatnonzero(p != np.arange(n))
            keep_i, keep_j, held = [linked], [p[linked]], len(linked)
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p = forest(n, np.concatenate(keep_i), np.concatenate(keep_j))
    linked = np.flatnonzero(p != np.arange(n))
    return linked, p[linked]


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``src``, ``dst`` that connect the nodes (``fp``, ``node``) just as all links within the radius do."""
    bits = F.bit_count("fp").cast("int")
    counted = {r[0]: r[1] for r in nodes.groupBy(bits.alias("b")).count().collect()}  # 65 rows at most
    tiles = [-(-counted.get(b, 0) // tile) for b in range(65)]
    offset = [sum(tiles[:b]) for b in range(66)]
    first = F.array(*map(F.lit, offset))
    at = lambda b: F.element_at(first, (b + 1).cast("int"))
    own = at(bits) + F.pmod(F.xxhash64("fp"), at(bits + 1) - at(bits)).cast("int")
    partners = F.sequence(at(F.greatest(bits - radius, F.lit(0))), at(F.least(bits + radius, F.lit(64)) + 1) - 1)
    spread = nodes.select("fp", "node", own.alias("tile"), F.explode(partners).alias("other")).select(F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fp", "node")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        low = (pdf["tile"] == pdf["lo"]).to_numpy()
        fp, node = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
        if pdf["lo"].iloc[0] == pdf["hi"].iloc[0]:
            i, j = compare(fp, None, radius)
        elif low.all() or not low.any():
            return pd.DataFrame({"src": [], "dst": []})
        else:
            fp, node = np.concatenate([fp[low], fp[~low]]), np.concatenate([node[low], node[~low]])
            i, j = compare(fp[: low.sum()], fp[low.sum() :], radius)
        return pd.DataFrame({"src": node[i], "dst": node[j]})

    return spread.groupBy("lo", "hi").applyInPandas(meet, "src long, dst long")


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) of every row."""
    rows = checkpointed(fingerprints(df, text, (doc_id,), width))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min(doc_id).cast("long").alias("node")).where("node is not null"))
    found = connected_components(links(nodes, radius))
    named = checkpointed(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")))
    return rows.join(named, "fp", "left").select(doc_id, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
