"""Near copies by SimHash for a pipeline: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Fingerprints of 512 bits are compared tile by tile, all pairs, with exclusive-or and bit counts. Tiles hold texts of
like numbers of shingles: a similarity of 0.8 needs sizes within that ratio, so tiles, and rows in them, whose sizes
are further apart are passed over, as are tiles whose population counts differ beyond the radius. The radius lies
5.5 standard deviations above the mean distance at the threshold; each pair within it is then checked exactly on
the sets of 32-bit shingle hashes, unless links found before connect it already. So a group of many near copies
takes about as many checks as it has members, and gives as many edges.

The sets stand in files of the shared checkpoint folder, one for each task that made them, and are memory-mapped.
A text of fewer words is one shingle; texts without a word (null, empty, white space) are copies of each other.
Rows without an id all stay. Of rows in one group the least id stays, of equals in it the least text hash. Work grows with the square of the number of
distinct texts of like size: that is the method."""

from __future__ import annotations

import math
import os
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import checkpointed
from .common import map_array, map_texts, shared_folder
from .simhash import shingle_hashes

WORDS, SIMILARITY, LANES = 5, 0.8, 8
#: Nodes of a tile, rows compared at a time with rows that they meet, and files that a task holds open.
TILE, SUB, STRIP, OPEN = 65_536, 16, 8_192, 256


def radius(similarity: float = SIMILARITY, bits: int = 64 * LANES, deviations: float = 5.5) -> int:
    """The distance that sets of the given similarity next to never exceed: sets of 6 to 30 shingles lie up to one
    deviation further apart than the mean of large ones, which leaves more than four. The cosine of two sets is
    least, for a Jaccard similarity, where their sizes are equal."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.floor(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def lanes(h: np.ndarray) -> np.ndarray:
    """Eight 64-bit hashes for each: counters mixed by a bijection."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """A bit is set if over half of the set's hashes have it."""
    ones = np.zeros(64 * LANES, np.int64)
    for lo in range(0, len(h), 1 << 11):
        ones += np.unpackbits(lanes(h[lo : lo + (1 << 11)]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def _own(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sketches(df: DataFrame, text: str, doc_id: str, width: int, folder: str) -> DataFrame:
    """doc_id, own (the text's hash, which tells rows of one id apart), fp (64 bytes), n shingles, and where their sorted hashes stand: the task's file and the offset."""

    def make():
        from pyspark import TaskContext

        task = TaskContext.get().taskAttemptId()
        out = open(os.path.join(folder, f"{task}.sets"), "ab")  # a name of this attempt's own
        at = out.tell() // 4

        def block(texts, _):
            nonlocal at
            fps, sizes, starts = [], [], []
            for t in texts:
                h = np.unique(np.array(shingle_hashes(t, width), np.uint64))
                low = np.unique((h >> np.uint64(32)).astype(np.uint32))
                fps.append(wide_fingerprint(h))
                sizes.append(len(low))
                starts.append(at)
                out.write(low.tobytes())
                at += len(low)
            out.flush()
            return {"fp": fps, "n": sizes, "task": [task] * len(texts), "at": starts}

        return block

    keyed = df.select(doc_id, text, _own(text).alias("own"))
    return map_texts(keyed, make, "fp binary, n long, task long, at long", text, (doc_id, "own"))


class Sets:
    """Sorted shingle hashes by file and offset; the files last used stay mapped."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, OrderedDict()

    def get(self, task: int, at: int, n: int) -> np.ndarray:
        if task not in self.files:
            if len(self.files) >= OPEN:
                self.files.popitem(last=False)
            self.files[task] = map_array(os.path.join(self.folder, f"{task}.sets"), np.uint32)
        self.files.move_to_end(task)
        return np.asarray(self.files[task][at : at + n])


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def linked(fp: np.ndarray, n: np.ndarray, split: int | None, same, reach: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among rows, or (``split``) between the rows before and from it. ``same(i, j)`` decides."""
    total = len(n)
    left, right = (np.arange(total), np.arange(total)) if split is None else (np.arange(split), np.arange(split, total))
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int64)
    nothing = np.empty(0, np.int64)
    if not len(left) or not len(right) or max(pop[left].min() - pop[right].max(), pop[right].min() - pop[left].max()) > reach + 30:
        return nothing, nothing
    root = np.arange(total)

    def tops(k: np.ndarray) -> np.ndarray:
        r = root[k]
        while (r != root[r]).any():
            r = root[r]
        root[k] = r
        return r

    size, first = n[right], fp[right, 0]
    # Most pairs are told apart by their first lane, most others by the first two.
    one, two = radius(similarity, 64, 5.5), radius(similarity, 128, 5.5)
    lane = [np.ascontiguousarray(fp[:, k]) for k in (0, 1)]
    for lo in range(0, len(left), SUB):
        mine = left[lo : lo + SUB]
        # Four of five shingles differ in 3 of 16 bits by their ties: further than large sets of that similarity.
        within = reach + 30 if n[mine[0]] <= 5 else reach
        extra = (within - reach) // 4
        a = np.searchsorted(size, math.ceil(similarity * n[mine[0]] - 1e-9))
        b = np.searchsorted(size, math.floor(n[mine[-1]] / similarity + 1e-9), side="right")
        if split is None:
            a = max(a, lo)  # pairs with earlier rows have been seen
        for s in range(a, b, STRIP):
            e = min(b, s + STRIP)
            bits = np.bitwise_count(lane[0][mine][:, None] ^ first[None, s:e]).ravel()
            near = np.flatnonzero(bits <= one + extra)
            x, y = mine[near // (e - s)], right[s + near % (e - s)]
            close = bits[near] + np.bitwise_count(lane[1][x] ^ lane[1][y]) <= two + extra
            x, y = x[close], y[close]
            close = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int64) <= within
            x, y, few = x[close], y[close], 1
            while True:
                top = tops(y)
                apart = tops(x) != top
                x, y, top = x[apart], y[apart], top[apart]
                if not len(x):
                    break
                # A few checks for each group among the strip's rows, then look again; more where they fail.
                order = np.argsort(top, kind="stable")
                begins = np.flatnonzero(np.diff(top[order], prepend=-1))
                rank = np.arange(len(order)) - np.repeat(begins, np.diff(begins, append=len(order)))
                now, hits = order[rank < few], 0
                for i, j in zip(x[now].tolist(), y[now].tolist(), strict=True):
                    if same(i, j):
                        u, v = tops(np.array([i, j])).tolist()
                        root[max(u, v)] = min(u, v)
                        hits += 1
                few = 1 if hits else 4 * few
                left_over = np.ones(len(x), bool)
                left_over[now] = False
                x, y = x[left_over], y[left_over]
    top = tops(np.arange(total))
    members = np.flatnonzero(top != np.arange(total))
    return members, top[members]


def similar_links(nodes: DataFrame, folder: str, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """Edges ``src``, ``dst`` that connect nodes (fp, n, task, at, node) just as all pairs of the similarity do."""
    reach = radius(similarity)
    # Two classes of size for each step of the ratio: sizes in classes over two apart are too unlike.
    step = -math.log(similarity) / 2 if similarity < 1 else 1e-3
    cls = F.when(F.col("n") < 1, 0).otherwise(F.floor(F.log(F.col("n").cast("double")) / step + 1e-9) + 3).cast("int")
    held = nodes.withColumn("cls", cls)
    counted = {r[0]: r[1] for r in held.groupBy("cls").count().collect()}  # classes grow with the logarithm of a text's length
    classes = max(counted, default=0) + 4
    tiles = [-(-counted.get(c, 0) // tile) for c in range(classes)]
    first = F.array(*[F.lit(sum(tiles[:c])) for c in range(classes + 1)])
    at = lambda c: F.element_at(first, (c + 1).cast("int"))
    own = at(F.col("cls")) + F.pmod(F.xxhash64("fp"), at(F.col("cls") + 1) - at(F.col("cls"))).cast("int")
    start, end = at(F.greatest(F.col("cls") - 2, F.lit(0))), at(F.least(F.col("cls") + 3, F.lit(classes)))
    spread = held.withColumn("tile", own).withColumn("other", F.explode(F.sequence(start, end - 1)))
    spread = spread.select(F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "fp", "n", "task", "at", "node")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        low = (pdf["tile"] == pdf["lo"]).to_numpy()
        split = None
        if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            pdf = pdf.iloc[np.argsort(~low, kind="stable")]
            split = int(low.sum())
        fp = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(-1, LANES)
        n, task, place, node = (pdf[c].to_numpy() for c in ("n", "task", "at", "node"))
        sets = Sets(folder)
        read = lambda i: sets.get(int(task[i]), int(place[i]), int(n[i]))
        i, j = linked(fp, n, split, lambda i, j: alike(read(i), read(j), similarity), reach, similarity)
        return pd.DataFrame({"src": node[i], "dst": node[j]})

    return spread.groupBy("lo", "hi").applyInPandas(meet, "src long, dst long")


def _grouped(df: DataFrame, text: str, doc_id: str, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """The least row (id, own) of each set of equal fingerprints with its group, and the least row of each group."""
    folder = shared_folder(df.sparkSession, "near-copies")
    rows = checkpointed(sketches(df, text, doc_id, width, folder)).where(F.col(doc_id).isNotNull())
    least = F.min(F.struct(F.col(doc_id).cast("long").alias("id"), "own", "task", "at", "n"))
    nodes = checkpointed(rows.groupBy("fp").agg(least.alias("x")).select("fp", "x.*").withColumn("node", F.monotonically_increasing_id()))
    found = connected_components(similar_links(nodes, folder, similarity))
    named = checkpointed(nodes.select("node", "id", "own").join(found, "node", "left").select("id", "own", F.coalesce("component", "node").alias("group")))
    return named, named.groupBy("group").agg(F.min(F.struct("id", "own")).alias("first"))


def similar_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """node (the least doc_id of a set of equal fingerprints) and component_id (the least that links reach)."""
    named, first = _grouped(df, text, doc_id, similarity, width)
    return named.join(first, "group").select(F.col("id").alias("node"), F.col("first.id").alias("component_id"))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """Rows, with all their columns, of the least doc_id of each group; rows without an id all stay.

    Rows that repeat an id are judged by their own texts: those of unlike texts stay, of one id and text (which are copies)
    one row does, by the hash of all columns."""
    _, first = _grouped(df, text, doc_id, similarity, width)
    stay = first.select(F.col("first.id").alias("__id"), F.col("first.own").alias("__own"))
    columns = df.columns
    named = df.where(F.col(doc_id).isNotNull()).withColumns({"__k": F.col(doc_id).cast("long"), "__o": _own(text)})
    named = named.join(stay, (F.col("__k") == F.col("__id")) & (F.col("__o") == F.col("__own")), "left_semi")
    at = F.row_number().over(Window.partitionBy("__k", "__o").orderBy(F.xxhash64(*[F.col(c) for c in columns])))
    return named.withColumn("__first", at).where("__first = 1").select(*columns).unionByName(df.where(F.col(doc_id).isNull()))
