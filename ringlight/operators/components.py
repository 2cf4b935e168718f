"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, written

#: Edges of a node from which on it counts as a hub, and the most hubs that a round can have.
HUB_EDGES, HUBS = 1_000_000, 10_000
#: Pairs that a task holds before it joins them, joined persons from which on it passes them on, and tables of stars that one task merges.
HELD, JOINED, MERGED = 4_000_000, 3_000_000, 8


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """``edges`` with ``m`` of their u. Edges of one hub would meet in one task: hubs (more than ``hub`` edges, so no more than
    edges / hub of them) are broadcast instead, and their edges stay where they are."""
    if hub is None:
        return edges.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") > hub).drop("n"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hub).drop("n"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _with_least(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hub: int | None) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, hub_edges: int = HUB_EDGES) -> DataFrame:
    """``node``, ``component`` of every node that has an edge to another; a component is named by its least node.

    Each round halves the longest path, about; every round ends in a checkpoint, so that a lost executor costs
    one round. Loops, repeated edges and nulls are ignored. No table of the graph ever reaches the driver."""
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    stars, last = checkpointed(pairs.distinct()), None
    for _ in range(max_rounds):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        hub = max(hub_edges, 2 * now[0] // HUBS)
        last, stars = now, checkpointed(_small_star(_large_star(stars, hub if hub < 2 * now[0] else None), hub if hub < now[0] else None))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def component_sizes(edges: DataFrame, least: int = 1) -> DataFrame:
    """component, size of the components with ``least`` nodes or more."""
    return connected_components(edges).groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)


def holder_component_sizes(attrs: DataFrame, least: int = 1) -> DataFrame:
    """``component_sizes(graph.bipartite(attrs), least)`` for integer persons: attributes never enter the rounds. Each links
    its holders to the least of them, and is counted where that person is. A component is named by its least node."""
    held = attrs.where(F.col("person_id").isNotNull()).select("person_id", F.concat_ws(":", F.col("attr_type"), F.col("token").cast("string")).alias("t"))
    tokens = held.groupBy("t").agg(F.min("person_id").alias("lead"), F.max("person_id").alias("last"))
    # Made twice, and each time its shuffle goes before the next one: both are small beside the table.
    leads = written(tokens.groupBy("lead").agg(F.min("t").alias("t"), F.count("*").alias("n")))
    shared = written(tokens.where("lead <> last").drop("last"))
    found = connected_components(held.join(shared, "t").select("person_id", "lead"), "person_id", "lead")
    who = lambda c: found.select(F.col("node").alias(c), "component")
    one = lambda df, c, name, n: df.join(who(c), c, "left").select(F.coalesce("component", c).alias("c"), name.alias("name"), n.alias("n"))
    persons = one(held.select("person_id").distinct(), "person_id", F.concat(F.lit("Person:"), F.col("person_id").cast("string")), F.lit(1))
    both = persons.unionByName(one(leads, "lead", F.col("t"), F.col("n")))
    return both.groupBy("c").agg(F.min("name").alias("component"), F.sum("n").alias("size")).where(F.col("size") >= least).select("component", "size")


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids of the pairs, sorted, and the least id that each is connected to."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while len(a):
        la, lb = label[a], label[b]
        apart = np.flatnonzero(la != lb)
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while ((up := label[label]) != label).any():
            label = up
    return ids, ids[label]


class _Stars:
    """Pairs of persons (a >= b) and tokens counted on a person, kept as u, v, n: each person with the least it is connected to here,
    and with the tokens that were counted on the ones connected to it if it is that least."""

    def __init__(self, most: tuple[int, int]):
        self.most, self.pairs, self.held = most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray):
        """What is to be passed on, if more than ``most`` pairs were held and they join more than ``most`` persons."""
        self.pairs.append((a, b, n))
        self.held += len(a)
        if self.held >= self.most[0]:
            self.join()
            if self.held >= self.most[1]:
                yield from self.rows()

    def join(self) -> None:
        if self.pairs:
            a, b, n = (np.concatenate(x) for x in zip(*self.pairs, strict=True))
            ids, least = _least(a, b)
            some = np.flatnonzero(n)
            total = np.zeros(len(ids), "i8")
            np.add.at(total, np.searchsorted(ids, least[np.searchsorted(ids, b[some])]), n[some])
            self.pairs, self.held = [(ids, least, total)], len(ids)

    def rows(self):
        self.join()
        for x in self.pairs:
            yield from pa.Table.from_arrays([*map(pa.array, x)], names=["u", "v", "n"]).to_batches(1 << 17)
        self.pairs, self.held = [], 0


def _linked(batches, schemes: dict[str, tuple[str, ...]], by: str, most: tuple[int, int]):
    """Stars of lines that come sorted by ``by``, and the tokens of lines where a column of theirs is null, as strings. A token whose lines
    go on in the next batch is carried there with its least holder."""
    stars, carried, odd = _Stars(most), {k: None for k in schemes}, {"u": [], "t": []}
    empty = {"t": pa.string()}

    def whole(batch):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, empty["t"])], names=["u", "v", "n", "t"])

    def passed():
        if odd["u"]:
            yield pa.RecordBatch.from_arrays([pa.array(odd["u"]), pa.array(odd["u"]), pa.array([0] * len(odd["u"])), pa.array(odd["t"])], names=["u", "v", "n", "t"])
            odd["u"], odd["t"] = [], []

    def closed(lines, valid, last):
        """Links and counts of the lines and what was carried; tokens of ``last`` (none: all lines were read) are carried on."""
        for kind, columns in schemes.items():
            which = np.flatnonzero(np.logical_and.reduce([valid[c] for c in columns])) if lines else []
            parts = [[lines[c][which] for c in ("person_id", *columns)]] if len(which) else []
            if carried[kind] is not None:
                parts.append(carried[kind])
            carried[kind] = None
            if not parts:
                continue
            who, *keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort([who, *keys[::-1]])
            who, keys = who[order], [k[order] for k in keys]
            new = np.ones(len(who), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            first = np.flatnonzero(new)
            lead, of = who[first], np.cumsum(new) - 1
            open_ = keys[columns.index(by)][first] == last if last is not None else np.zeros(len(first), bool)
            if open_.any():
                carried[kind] = [x[first[open_]] for x in (who, *keys)]
            yield from stars.add(who, lead[of], (new & ~open_[of]).astype("i8"))

    for batch in batches:
        column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        valid = {c: x.is_valid().to_numpy(zero_copy_only=False) for c, x in column.items()}
        lines = {c: x.fill_null(0).cast(pa.int64()).to_numpy() for c, x in column.items()}
        if not batch.num_rows:
            continue
        for kind, columns in schemes.items():
            for i in np.flatnonzero(~np.logical_and.reduce([valid[c] for c in columns])).tolist():
                odd["u"].append(int(lines["person_id"][i]))
                odd["t"].append(":".join([kind, *(str(lines[c][i]) for c in columns if valid[c][i])]))
        last = int(lines[by][-1]) if valid[by][-1] else None
        for x in closed(lines, valid, last):
            yield whole(x)
        yield from passed()
    for x in (*closed(None, None, None), *stars.rows()):
        yield whole(x)


def _merged(batches, most: tuple[int, int]):
    stars = _Stars(most)
    for batch in batches:
        yield from stars.add(*(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "uvn"))
    yield from stars.rows()


def line_component_sizes(lines: DataFrame, schemes: dict[str, tuple[str, ...]], by: str, least: int = 1) -> DataFrame:
    """``holder_component_sizes`` of the attributes that ``schemes`` (type: the columns whose values, joined by colons without nulls, are a
    token) make of ``lines`` (person_id and whole numbers), without a table of attributes. All schemes have the column ``by``: one shuffle
    by it brings the holders of each token together, a task keeps of them the least that each person is connected to there, and the
    rounds have only that. Types sort after "Person:", so no token names a component."""
    if late := [k for k in schemes if not k > "Person:" or by not in schemes[k]]:
        raise ValueError(f"types that could name a component, or without {by}: {late}")
    columns = sorted({c for x in schemes.values() for c in x})
    sorted_ = lines.where("person_id is not null").select("person_id", *columns).sortWithinPartitions(by)
    found = written(sorted_.mapInArrow(partial(_linked, schemes=schemes, by=by, most=(HELD, JOINED)), "u long, v long, n long, t string"))
    odd = found.where("t is not null").select("u", "t")
    leads = odd.groupBy("t").agg(F.min("u").alias("v"))
    odd = odd.join(leads, "t").select("u", "v", F.lit(0).cast("long").alias("n")).unionByName(leads.select(F.col("v").alias("u"), "v", F.lit(1).cast("long").alias("n")))
    stars = found.where("t is null").select("u", "v", "n")
    stars = written(stars.coalesce(max(1, stars.rdd.getNumPartitions() // MERGED)).mapInArrow(partial(_merged, most=(HELD, JOINED)), "u long, v long, n long").unionByName(odd))
    own = stars.groupBy("u").agg(F.sum("n").alias("n")).join(connected_components(stars, "u", "v").select(F.col("node").alias("u"), "component"), "u", "left")
    name = F.concat(F.lit("Person:"), F.col("u").cast("string"))
    return own.groupBy(F.coalesce("component", "u").alias("c")).agg(F.min(name).alias("component"), (F.count("*") + F.sum("n")).alias("size")).where(F.col("size") >= least).select("component", "size")
