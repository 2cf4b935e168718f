"""Means over the neighbourhoods of several relations, without a table of their edges.

A relation is lists of persons that are all neighbours of each other: holders of a token, two ends of a link, groups of likes. Lists lie in
files of the checkpoint folder, which must be mounted on every machine; a block of persons has references to the lists that its
persons are in, and opens them when it is asked for means. Persons are known by their place ``i`` (see ``blocks.numbered``)."""

from __future__ import annotations

import os
import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release
from .blocks import HELD_PAIRS, PACKED, _by_block, _get, _given, _put, _unpack, shared_folder

#: Persons of a block, and neighbours whose columns a task reads at once.
PLACES, PAIRS = 4096, 1 << 20
_REFERENCE = ("u4", "u4", "u4", "u1")
LISTS = "kind int, vs array<long>"


def _line_lists(batches, schemes: dict[int, tuple[str, ...]], caps: dict[int, int], by: str):
    """Lists of 2 to ``caps`` distinct holders of tokens, from lines sorted by ``by``. Holders of a token whose lines go on in the next batch are
    carried there, one more than the cap at most. Lines where a column of the token is null are left to ``token_lists``."""
    carried = {}

    def closed(lines, valid, last):
        for kind, columns in schemes.items():
            parts = [carried.pop(kind)] if kind in carried else []
            if lines:
                which = np.flatnonzero(np.logical_and.reduce([valid[c] for c in columns]))
                parts.append([lines[c][which] for c in ("i", *columns)])
            if not sum(len(p[0]) for p in parts):
                continue
            who, *keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort([who, *keys[::-1]])
            who, keys = who[order], [k[order] for k in keys]
            new, distinct = np.ones(len(who), bool), np.ones(len(who), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            distinct[1:] = new[1:] | (who[1:] != who[:-1])
            who, keys, first = who[distinct], [k[distinct] for k in keys], np.flatnonzero(new[distinct])
            n = np.diff(np.append(first, len(who)))
            open_ = keys[columns.index(by)][first] == last if last is not None else np.zeros(len(first), bool)
            if open_.any():
                some = np.flatnonzero(np.repeat(open_, n) & (np.arange(len(who)) - np.repeat(first, n) <= caps[kind]))
                carried[kind] = [x[some] for x in (who, *keys)]
            good = ~open_ & (n >= 2) & (n <= caps[kind])
            vs = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[good])).astype("i4")), pa.array(who[np.repeat(good, n)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vs), kind, "i4")), vs], names=["kind", "vs"])

    for batch in batches:
        if batch.num_rows:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            valid = {c: x.is_valid().to_numpy(zero_copy_only=False) for c, x in column.items()}
            lines = {c: x.fill_null(0).cast(pa.int64()).to_numpy() for c, x in column.items()}
            yield from closed(lines, valid, int(lines[by][-1]) if valid[by][-1] else None)
    yield from closed(None, None, None)


def token_lists(lines: DataFrame, schemes: dict[int, tuple[str, ...]], caps: dict[int, int], by: str) -> DataFrame:
    """kind, vs of the tokens that ``schemes`` (kind: columns whose values, joined by colons without nulls, are a token) make of ``lines`` (i and whole
    numbers; read once for tokens without nulls and once for those with): one shuffle for all schemes, which have the column ``by``."""
    columns = sorted({c for x in schemes.values() for c in x})
    out = lines.select("i", *columns).repartition(by).sortWithinPartitions(by).mapInArrow(partial(_line_lists, schemes=schemes, caps=caps, by=by), LISTS)
    for kind, mine in schemes.items():
        void = F.lit(False)
        for c in mine:
            void = void | F.col(c).isNull()
        odd = lines.where(void).select(F.concat_ws(":", *[F.col(c).cast("string") for c in mine]).alias("t"), "i").groupBy("t").agg(F.collect_set("i").alias("vs"))
        out = out.unionByName(odd.where(F.size("vs").between(2, caps[kind])).select(F.lit(kind).alias("kind"), "vs"))
    return out


def link_lists(links: DataFrame, a: str, b: str, nodes: DataFrame, kind: int) -> DataFrame:
    """kind, vs of links between numbered persons."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("person_id").alias(c), F.col("i").alias(f"i{c}")), c)
    return pairs.select(F.lit(kind).alias("kind"), F.array("ia", "ib").alias("vs"))


def _referred(batches, folder: str, size: int, most: int):
    """Writes the lists to a file of this run of the task alone; references to them by block: place, where the list begins, its length, its kind."""
    name, at, held = uuid.uuid4().hex, 0, []
    with open(os.path.join(folder, f"{name}.lists"), "wb") as f:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("vs"))
            flat, n = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            kind = batch.column(batch.schema.get_field_index("kind")).to_numpy()
            f.write(flat.astype("u4").tobytes())
            if at + len(flat) >= 1 << 32:
                raise ValueError("lists of one task beyond 2^32 places: use more partitions")
            held.append((flat, np.repeat(at + np.cumsum(n) - n, n).astype("u4"), np.repeat(n, n).astype("u4"), np.repeat(kind, n).astype("u1")))
            at += len(flat)
            if sum(len(x[0]) for x in held) >= most:
                yield _by_block(name, size, *(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        if sum(len(x[0]) for x in held):
            yield _by_block(name, size, *(np.concatenate(x) for x in zip(*held, strict=True)))


def _kept(table: pa.Table, folder: str) -> pa.Table:
    """Writes the references of one block beside, then renames."""
    block, beside = table["block"][0].as_py(), os.path.join(folder, f"{uuid.uuid4().hex}.part")
    with pa.OSFile(beside, "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table)
    os.replace(beside, os.path.join(folder, f"{block}.refs"))
    return pa.table([pa.array([block], pa.int32())], names=["block"])


def _placed(table: pa.Table, path: str, size: int, n: int, columns: list[str]) -> pa.Table:
    """Writes the columns of one block's persons to their places."""
    block = table["block"][0].as_py()
    lo = block * size
    x = np.zeros((min(size, n - lo), len(columns)))
    x[table["i"].to_numpy() - lo] = np.stack([table[c].to_numpy() for c in columns], 1)
    if np.isnan(x).any():
        raise ValueError("means over neighbourhoods are of columns without nulls")
    _put(path, lo * len(columns), x)
    return pa.table([pa.array([block], pa.int32())], names=["block"])


def _pairs(folder: str, block: int, size: int, n: int, kinds: int) -> np.ndarray:
    """(place in the block, kind, neighbour) of each distinct one, as a number, sorted."""
    try:
        with pa.memory_map(os.path.join(folder, f"{block}.refs")) as f:
            table = pa.ipc.open_file(f).read_all()
            rows = list(zip(table["kind"].to_pylist(), table["payload"].to_pylist(), strict=True))
    except FileNotFoundError:
        return np.empty(0, "i8")
    out = []
    for name, payload in rows:
        place, where, length, kind = _unpack(payload, *_REFERENCE)
        lists, many = np.memmap(os.path.join(folder, f"{name}.lists"), "u4", "r"), length.astype("i8")
        at = np.arange(many.sum()) + np.repeat(where - (np.cumsum(many) - many), many)
        src, to = np.repeat(place, many), lists[at]
        other = np.flatnonzero(src != to)
        out.append((np.repeat((place.astype("i8") - block * size) * kinds + kind, many) * n + to)[other])
    key = np.sort(np.concatenate(out))
    return key[np.flatnonzero(np.diff(key, prepend=-1))]


def _means(batches, folder: str, path: str, size: int, n: int, kinds: int, names: list[str], pairs: int):
    for batch in batches:
        for block in batch.column(0).to_pylist():
            lo = block * size
            x, out = _get(path, "f8").reshape(n, len(names)), np.zeros((min(size, n - lo), len(names)))
            key = _pairs(folder, block, size, n, kinds)
            group, to = key // n, key % n
            first = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(first[1:], len(key))
            at = 0
            while at < len(first):
                upto = max(at + 1, int(np.searchsorted(ends, first[at] + pairs, "right")))
                total = np.add.reduceat(x[to[first[at] : ends[upto - 1]]], first[at:upto] - first[at], 0)
                np.add.at(out, group[first[at:upto]] // kinds, total / (ends - first)[at:upto, None])
                at = upto
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(out))), *map(pa.array, np.ascontiguousarray(out.T) / kinds)], names=["i", *names])


class Neighbourhoods:
    """``models.relation_means`` of numbered persons (``nodes``: person_id, i) in relations given as ``lists`` (kind below ``kinds``, vs), one frame after the other."""

    def __init__(self, lists: list[DataFrame], nodes: DataFrame, n: int, kinds: int):
        self.nodes, self.n, self.kinds, self.size, self.folder = nodes, n, kinds, PLACES, shared_folder(nodes.sparkSession, "relations")
        packed = [x.mapInArrow(partial(_referred, folder=self.folder, size=PLACES, most=HELD_PAIRS), PACKED) for x in lists]
        for p in packed[1:]:
            packed[0] = packed[0].unionByName(p)
        packed[0].groupBy("block").applyInArrow(_given(_kept, folder=self.folder), "block int").count()
        release(nodes.sparkSession)

    def __call__(self, rows: DataFrame, columns: list[str], prefix: str = "h_") -> DataFrame:
        path, names = os.path.join(self.folder, f"{uuid.uuid4().hex}.state"), [f"{prefix}{c}" for c in columns]
        with open(path, "wb") as f:
            f.truncate(max(1, self.n * len(columns)) * 8)
        placed = rows.join(self.nodes.select("person_id", "i"), "person_id").select(F.expr(f"cast(i div {self.size} as int)").alias("block"), "i", *[F.col(c).cast("double").alias(c) for c in columns])
        placed.groupBy("block").applyInArrow(_given(_placed, path=path, size=self.size, n=self.n, columns=columns), "block int").count()
        blocks = -(-self.n // self.size)
        spark = self.nodes.sparkSession
        means = spark.range(blocks).repartition(max(1, min(blocks, 8 * spark.sparkContext.defaultParallelism)), "id").mapInArrow(partial(_means, folder=self.folder, path=path, size=self.size, n=self.n, kinds=self.kinds, names=names, pairs=PAIRS), "i long, " + ", ".join(f"`{c}` double" for c in names))
        return rows.join(self.nodes.select("person_id", "i").join(means, "i").drop("i"), "person_id", "left").na.fill(0.0, names)
