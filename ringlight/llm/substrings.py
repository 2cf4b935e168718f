"""Operator 10: removal of repeated byte strings, by suffixes sorted one bucket at a time.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or the same
document before). Documents that are byte for byte a later copy of another go whole without a sort. For the
rest, a content-defined cover takes the place of the fixed difference cover: every string of ``LENGTH`` bytes
has one cover position (its first gram of ``GRAM`` bytes with the least hash), and two equal strings have it at
the same place, in whatever document they stand. So suffixes need sorting only at cover positions whose gram
occurs again, and the buckets (ranges of the gram's hash) can be sorted one at a time, each in one task, with
bounded contexts in place of the whole text: the bytes of those strings that have the position as theirs. In a bucket the suffixes that start at the cover positions are
sorted, and likewise the reversed prefixes that end there; their ranks and common lengths settle every tie
between strings that hold the position: two strings are equal if and only if they have one class on the left
and one on the right. Equality is of bytes; hashes only choose positions and buckets.

Of a gram with more than ``HOT`` cover positions (a boilerplate between differing texts) no task gets all contexts: its
strings go one by one to the bucket of their own hash, if that hash occurs again. Equal strings still meet, differing
ones are dealt over all buckets, and a task passes on one of equal strings once, however often it reads them.

Null and empty texts have no bytes; texts under ``LENGTH`` bytes keep all. A string that is not UTF-8 at its
ends is judged as bytes like any other. Rows that repeat an id stand at the same place, rows with a null id all
at one place before all others: of rows at one place none is earlier than another, whatever their texts. Each
is judged by itself, as a document; rows with one id and one text get one and the same result. Other columns are
not read, whatever their names; an empty table gives an empty one."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import HashRanges, bucket_bits, bucket_slices, mixed, read_table, shared_folder, text_blocks, write_array

LENGTH, GRAM = 100, 32
#: Grams of a string; bytes kept left and right of the start of a cover position.
SPREAD = LENGTH - GRAM + 1
LEFT, RIGHT = SPREAD - 1, LENGTH
CONTEXT = LEFT + RIGHT
#: Cover positions that a task holds at most before it passes them on, and bytes of text at a time.
FLUSH_KEYS, FLUSH_CONTEXTS, TEXT_BYTES = 1 << 20, 60_000, 1 << 18
#: Cover positions of one gram up to which their contexts meet in one task, and strings that a task remembers having passed on
#: (forgotten ones are passed on again, which changes nothing but the bytes moved).
HOT, CARRY = 10_000, 60_000
NO_ID = -(1 << 63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each byte, by doubling."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        width = 1
        while width < GRAM:
            h = h[:-width] * np.uint64(0xD6E8FEB86659FD93 + 2 * width) + h[width:]
            h ^= h >> np.uint64(29)
            width *= 2
    return h


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values, by doubling."""
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return pick(x[:-rest], x[rest:]) if rest else x


def cover(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cover positions of texts that lie in ``data``, their grams' hashes, and the least hash of each string, for string_ranges."""
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    h = gram_hashes(data)
    least = sliding(h, SPREAD, np.minimum)  # of the string that starts at each byte
    valid = np.zeros(len(least) + 1, np.int64)
    long = ends - starts >= LENGTH
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, np.minimum(ends[long] - LENGTH + 1, len(least)), -1)
    least[np.cumsum(valid)[:-1] == 0] = 0
    around = np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)])
    at = np.flatnonzero((h == sliding(around, SPREAD, np.maximum)[: len(h)]) & (h > 0))
    return at, h[at], around


def string_ranges(at: np.ndarray, h: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose cover position is ``at`` (ascending, all positions of a gram or none); a
    position whose strings all have an earlier one with the same gram has its first start behind its last."""
    mine = sliding_window_view(around, SPREAD)[at] == h[:, None]
    first, last = at - SPREAD + 1 + mine.argmax(axis=1), at - mine[:, ::-1].argmax(axis=1)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    first[order[same + 1]] = np.maximum(first[order[same + 1]], at[order[same]] + 1)
    return first, last


def held_in(keys: HashRanges, wanted: np.ndarray) -> np.ndarray:
    """Whether each of the (mixed) keys, in any order, is stored."""
    order = np.argsort(wanted)
    out = np.zeros(len(wanted), bool)
    out[order] = keys.find(wanted[order])[0]
    return out


def single_strings(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all strings from ``first`` to ``last``, and their (mixed) hashes: those of grams that cover them, combined."""
    n = last - first + 1
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    h, key = gram_hashes(data), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for step in [*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM]:
            key = key * np.uint64(0xD6E8FEB86659FD93) + h[at + step]
            key ^= key >> np.uint64(29)
    return at, mixed(key)


def blocks_of(batches, gone: HashRanges | None):
    """(doc ids, row keys, start and end of each text, all bytes) of blocks, without texts too short and later copies."""
    for batch in batches:
        for block, texts in text_blocks(batch, "text", True, TEXT_BYTES):
            ids = pc.fill_null(block.column(0), NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            own = block.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = np.array([len(t) >= LENGTH for t in texts])
            if gone is not None and keep.any():
                keys = mixed(ids.view(np.uint64))
                order = np.argsort(keys)
                keep[order] &= ~gone.find(keys[order])[0]
            which = np.flatnonzero(keep)
            if len(which):
                texts = [texts[i] for i in which]
                ends = np.cumsum([len(t) for t in texts])
                yield ids[which], own[which], np.concatenate([[0], ends[:-1]]), ends, np.frombuffer(b"".join(texts), np.uint8)


def store_keys(df: DataFrame, bits: int, folders: dict[str, int]) -> list[int]:
    """Write to each folder, for each bucket, the sorted keys that occur as often as it asks for, or more, in rows of bucket,
    once, many, count (keys found once, and more often, by one task, and how often). Returns the number of keys of each folder."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(pdf["once"]), np.uint64)
        many, count = np.frombuffer(b"".join(pdf["many"]), np.uint64), np.frombuffer(b"".join(pdf["count"]), np.uint32)
        keys = np.concatenate([once, many])
        order = np.argsort(keys)
        keys, n = keys[order], np.concatenate([np.ones(len(once), np.int64), count.astype(np.int64)])[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[at], np.add.reduceat(n, at)
        b, kept = int(pdf["bucket"].iloc[0]), []
        for folder, least in folders.items():
            write_array(f"{folder}/{b}.keys", keys[n >= least])
            kept.append(int((n >= least).sum()))
        return pd.DataFrame({"bucket": [b], "n": [kept]})

    done = {r[0]: r[1] for r in df.groupBy("bucket").applyInPandas(write, "bucket int, n array<long>").collect()}  # 2**bits rows at most
    for b in set(range(1 << bits)) - set(done):
        for folder in folders:
            write_array(f"{folder}/{b}.keys", np.empty(0, np.uint64))
    return [sum(n[k] for n in done.values()) for k in range(len(folders))]


def key_rows(keys: np.ndarray, bits: int):
    """Rows of bucket, once, many, count for store_keys."""
    keys, n = np.unique(keys, return_counts=True)
    at = bucket_slices(keys, bits)
    which = np.flatnonzero(np.diff(at))
    single = n == 1
    parts = [(keys[at[b] : at[b + 1]], single[at[b] : at[b + 1]], n[at[b] : at[b + 1]].astype(np.uint32)) for b in which]
    columns = [[k[s].tobytes() for k, s, _ in parts], [k[~s].tobytes() for k, s, _ in parts], [c[~s].tobytes() for _, s, c in parts]]
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "once", "many", "count"])


def later_copies(ids: DataFrame) -> DataFrame:
    """doc_id and own of documents of ``LENGTH`` bytes or more whose bytes are those of a document with a smaller id. An id of
    several rows counts if that holds of all of them; else its rows go the long way. Rows are dealt by ranges of (digest,
    doc_id), and a digest's least id is sent to each range that holds it, so a large group of copies lies in many tasks."""
    rows = ids.groupBy("digest", "doc_id", "own").agg(F.count("*").alias("n")).drop("n")
    rows = checkpointed(rows.repartitionByRange("digest", "doc_id").withColumn("part", F.spark_partition_id()))
    here = rows.groupBy("digest", "part").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = here.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("part").alias("parts")).where("n > 1")
    first = first.select("digest", "first", F.explode("parts").alias("part"))
    marked = rows.join(first, ["digest", "part"], "left").select("doc_id", "own", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("later"))
    whole = marked.groupBy("doc_id").agg(F.min("later").alias("every")).where("every").select("doc_id")
    return marked.where("later").join(whole, "doc_id", "left_semi").select("doc_id", "own").distinct()


def not_first(doc: np.ndarray, own: np.ndarray, at: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (class, doc, own, at), ``new`` marking where a class begins: whether an earlier one is in the
    class (of a smaller document, or before in the same row), and whether the row is the first of its document row there."""
    n = np.arange(len(doc))
    first = np.maximum.accumulate(np.where(new, n, 0))
    begins = new | np.concatenate([[True], (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])])
    mine = np.maximum.accumulate(np.where(begins, n, 0))
    return (doc[first] != doc) | (at[mine] != at), begins


def sort_bucket(gram: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of (doc, own, at): those with a string that an earlier row has too, and the least and greatest
    distance from the start of such strings to the cover position."""
    n = len(gram)
    classes = []
    for side, sizes in ((context[:, :LEFT][:, ::-1], left), (context[:, LEFT:], right)):
        # The gram's hash leads, so that ranks of one gram stand together; the last byte keeps zeros from being cut off.
        wide = np.empty((n, 8 + side.shape[1] + 1), np.uint8)
        wide[:, :8] = gram.astype(">u8").view(np.uint8).reshape(n, 8)
        wide[:, 8:-1], wide[:, -1] = side, 1
        order = np.argsort(wide.view(f"S{wide.shape[1]}").ravel(), kind="stable")
        ranked = wide[order]
        differs = ranked[1:] != ranked[:-1]
        common = np.concatenate([[-1], np.where(differs.any(axis=1), differs.argmax(axis=1), wide.shape[1]) - 8])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        classes.append((place, common, sizes))
    (l_place, l_common, _), (r_place, r_common, _) = classes
    low, high = np.full(n, LENGTH), np.full(n, -1)
    for a in range(LEFT + 1):
        rows = np.flatnonzero((left >= a) & (right >= LENGTH - a))
        if len(rows) < 2:
            continue
        key = np.cumsum(l_common < a)[l_place[rows]] * np.int64(n + 1) + np.cumsum(r_common < LENGTH - a)[r_place[rows]]
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        mine = rows[order]
        again = mine[not_first(doc[mine], own[mine], at[mine], new)[0]]
        low[again] = np.minimum(low[again], a)
        high[again] = np.maximum(high[again], a)
    hit = np.flatnonzero(high >= 0)
    return hit, low[hit], high[hit]


def joined_runs(doc, own, start, end):
    """Intervals with those that overlap in one row made one."""
    if not len(doc):
        return doc, own, start, end
    order = np.lexsort((start, own, doc))
    doc, own, start, end = doc[order], own[order], start[order], end[order]
    row = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (own[1:] != own[:-1]))])
    base = row * np.int64(int(end.max()) + 1)  # far below 2**63: rows of a bucket times bytes of a text
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate([[True], (row[1:] != row[:-1]) | ((base + start)[1:] > reach[:-1])])
    final = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], own[new], start[new], (reach - base)[final]


def collapsed(gram, rows, doc, own, at, *more):
    """Rows in order of (doc, own, at). Of rows with one context those of the first document stay, one for each of its rows.
    Returns also the index of what stays, of those that start later than one with their context, and ``more`` in that order."""
    order = np.lexsort((at, own, doc))
    gram, rows, doc, own, at = gram[order], rows[order], doc[order], own[order], at[order]
    by = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    new = np.concatenate([[True], (rows[by][1:] != rows[by][:-1]).any(axis=1)])
    later, begins = not_first(doc[by], own[by], at[by], new)
    keep = np.zeros(len(doc), bool)
    keep[by[begins & ~later]] = True
    return gram, rows, doc, own, at, np.flatnonzero(keep), by[later], *[m[order] for m in more]


def intervals(df: DataFrame, bits: int, repeated: str, gone: str, hot: str | None, strings: str | None) -> DataFrame:
    """doc_id, own, start, end of covered bytes; a row's intervals may overlap. ``hot`` and ``strings`` hold the hot grams and
    the hashes of their strings that occur again."""
    width = CONTEXT + 3

    def contexts(batches):
        known, copies = HashRanges(repeated, bits, {}), HashRanges(gone, bits, {})
        crowded, again = (HashRanges(f, bits, {}) if f else None for f in (hot, strings))
        held, count, carried = [], 0, None
        GRAMS, STRING, PASSED_ON = 0, 1, 2

        def flush():
            nonlocal carried
            parts = held if carried is None else [*held, carried]
            gram, rows, doc, key, at, keep, later, kind = collapsed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            w_doc, w_key, w_start, w_end = joined_runs(doc[later], key[later], at[later] - rows[later, 0], at[later] + rows[later, 1])
            strings = keep[kind[keep] != GRAMS][:CARRY]
            carried = (gram[strings], rows[strings], doc[strings], key[strings], at[strings], np.full(len(strings), PASSED_ON, np.uint8)) if len(strings) else None
            keep = keep[kind[keep] != PASSED_ON]
            order = keep[np.argsort(gram[keep], kind="stable")]
            cuts = bucket_slices(gram[order], bits)
            empty = b""
            out = [[] for _ in range(10)]
            for b in np.flatnonzero(np.diff(cuts)):
                r = order[cuts[b] : cuts[b + 1]]
                for c, v in zip(out, (b, gram[r].tobytes(), rows[r].tobytes(), doc[r].tobytes(), key[r].tobytes(), at[r].tobytes(), empty, empty, empty, empty), strict=True):
                    c.append(v)
            if len(later):
                for c, v in zip(out, (int(w_doc[0]) % (1 << bits), empty, empty, empty, empty, empty, w_doc.tobytes(), w_key.tobytes(), w_start.tobytes(), w_end.tobytes()), strict=True):
                    c.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32())] + [pa.array(c, pa.binary()) for c in out[1:]], names=["bucket", "gram", "context", "doc", "key", "at", "m_doc", "m_key", "m_start", "m_end"])

        for ids, keys, starts, ends, data in blocks_of(batches, copies):
            at, h, least = cover(data, starts, ends)
            gram = mixed(h)
            hit = held_in(known, gram)
            if not hit.any():
                continue
            at, gram = at[hit], gram[hit]
            first, last = string_ranges(at, h[hit], least)
            some = first <= last
            at, gram, first, last = at[some], gram[some], first[some], last[some]
            kind = np.full(len(at), GRAMS, np.uint8)
            if crowded is not None and (full := held_in(crowded, gram)).any():
                start, string = single_strings(data, first[full], last[full])
                twice = held_in(again, string)
                start, string = start[twice], string[twice]
                at, gram = np.concatenate([at[~full], start]), np.concatenate([gram[~full], string])
                first, last = np.concatenate([first[~full], start]), np.concatenate([last[~full], start])
                kind = np.repeat(np.array([GRAMS, STRING], np.uint8), [(~full).sum(), len(start)])
            own = np.searchsorted(ends, at, side="right")
            padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(RIGHT, np.uint8)])
            for lo in range(0, len(at), FLUSH_CONTEXTS):
                p, o, g = at[lo : lo + FLUSH_CONTEXTS], own[lo : lo + FLUSH_CONTEXTS], gram[lo : lo + FLUSH_CONTEXTS]
                rows = np.empty((len(p), width), np.uint8)
                rows[:, 0], rows[:, 1] = p - first[lo : lo + FLUSH_CONTEXTS], last[lo : lo + FLUSH_CONTEXTS] + LENGTH - p
                body = sliding_window_view(padded, CONTEXT)[p]
                column = np.arange(CONTEXT)
                inside = (column >= LEFT - rows[:, :1].astype(int)) & (column < LEFT + rows[:, 1:2].astype(int))
                rows[:, 2:-1], rows[:, -1] = np.where(inside, body, 0), 1
                held.append((g, rows, ids[o], keys[o], p - starts[o], kind[lo : lo + FLUSH_CONTEXTS]))
                count += len(p)
                if count >= FLUSH_CONTEXTS:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        def joined(name, dtype):
            return np.frombuffer(b"".join(pdf[name]), dtype)

        doc, key, start, end = (joined(c, np.int64) for c in ("m_doc", "m_key", "m_start", "m_end"))
        gram, rows = joined("gram", np.uint64), joined("context", np.uint8).reshape(-1, width)
        own, mine, at = (joined(c, np.int64) for c in ("doc", "key", "at"))
        if len(gram):
            gram, rows, own, mine, at, keep, later = collapsed(gram, rows, own, mine, at)
            more = [(own[later], mine[later], at[later] - rows[later, 0], at[later] + rows[later, 1])]
            grams, inverse, n = np.unique(gram[keep], return_inverse=True, return_counts=True)
            keep = keep[n[inverse] > 1]
            if len(keep):
                rows, o, k, p = rows[keep], own[keep], mine[keep], at[keep]
                hit, low, high = sort_bucket(gram[keep], rows[:, 2:-1], rows[:, 0].astype(int), rows[:, 1].astype(int), o, k, p)
                more.append((o[hit], k[hit], p[hit] - high, p[hit] - low + LENGTH))
            doc, key, start, end = (np.concatenate([x, *y]) for x, y in zip((doc, key, start, end), zip(*more, strict=True), strict=True))
        return pd.DataFrame(dict(zip(("doc_id", "own", "start", "end"), joined_runs(doc, key, start, end), strict=True)))

    return df.mapInArrow(contexts, "bucket int, gram binary, context binary, doc binary, key binary, at binary, m_doc binary, m_key binary, m_start binary, m_end binary").groupBy("bucket").applyInPandas(meet, "doc_id long, own long, start long, end long")


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of intervals (start, end), in order."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])
    return np.stack([spans[new, 0], reach[last]], axis=1)


def row_key(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def repeated_spans(documents: DataFrame, text: str = "text", doc_id: str = "doc_id", crowd: int = HOT) -> DataFrame:
    """doc_id, own (the text's hash, which tells rows of one id apart), and ``spans``: the intervals of covered bytes, flat
    (start, end, start, ...); none for later copies, which have ``copied`` true. Rows without covered bytes are absent; a null id is
    ``NO_ID``. A gram with more than ``crowd`` cover positions has its strings dealt one by one, with the same result."""
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), row_key(text).alias("own"), F.col(text).alias("text"))
    bits = bucket_bits(docs.rdd.getNumPartitions())
    ids = checkpointed(docs.where(F.octet_length("text") >= LENGTH).select("doc_id", "own", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")))
    copies = checkpointed(later_copies(ids))
    gone, repeated, hot, strings = (shared_folder(spark, n) for n in ("copies", "grams", "hot", "strings"))

    def copy_keys(batches):
        for batch in batches:
            yield key_rows(mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), bits)

    def counted(keys_of):
        """Rows of store_keys for the keys that ``keys_of()`` returns for the bytes of a block."""

        def run(batches):
            keys, held, count = keys_of(), [], 0
            for _, _, starts, ends, data in blocks_of(batches, HashRanges(gone, bits, {})):
                held.append(keys(data, starts, ends))
                count += len(held[-1])
                if count > FLUSH_KEYS:
                    yield key_rows(np.concatenate(held), bits)
                    held, count = [], 0
            if count:
                yield key_rows(np.concatenate(held), bits)

        return docs.mapInArrow(run, shape)

    def grams():
        return lambda data, starts, ends: mixed(cover(data, starts, ends)[1])

    def hot_strings():
        crowded = HashRanges(hot, bits, {})

        def keys(data, starts, ends):
            at, h, least = cover(data, starts, ends)
            full = held_in(crowded, mixed(h))
            if not full.any():
                return np.empty(0, np.uint64)
            first, last = string_ranges(at[full], h[full], least)
            some = first <= last
            return single_strings(data, first[some], last[some])[1]

        return keys

    shape = "bucket int, once binary, many binary, count binary"
    store_keys(copies.select("doc_id").distinct().mapInArrow(copy_keys, shape), bits, {gone: 1})
    _, crowds = store_keys(counted(grams), bits, {repeated: 2, hot: crowd + 1})
    if crowds:
        store_keys(counted(hot_strings), bits, {strings: 2})
    found = intervals(docs, bits, repeated, gone, *((hot, strings) if crowds else (None, None))).groupBy("doc_id", "own").agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("spans"))
    return found.withColumn("copied", F.lit(False)).unionByName(copies.select("doc_id", "own", F.array().cast("array<bigint>").alias("spans"), F.lit(True).alias("copied")))


def deduplicated(documents: DataFrame, make, fields: str, text: str = "text", doc_id: str = "doc_id", crowd: int = HOT) -> DataFrame:
    """doc_id and the columns that ``make`` returns for (bytes, runs removed) of every document."""
    from pyspark.sql import types as T

    spans = repeated_spans(documents, text, doc_id, crowd)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__id"), row_key(text).alias("__own"))
    rows = rows.join(spans.withColumnsRenamed({"doc_id": "__id", "own": "__own"}), ["__id", "__own"], "left").select("doc_id", "text", "spans", "copied")
    added = T._parse_datatype_string(fields)
    schema = T.StructType([rows.schema["doc_id"], *added])
    names = [f.name for f in added]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for block, texts in text_blocks(batch, "text", True):
                out = []
                for t, s, copied in zip(texts, block.column(2), block.column(3).to_pylist(), strict=True):
                    runs = np.array([[0, len(t)]]) if copied else merged(np.array(s.as_py() or [], np.int64).reshape(-1, 2))
                    out.append(make(t, runs))
                yield pa.RecordBatch.from_arrays([block.column(0), *[pa.array([r[i] for r in out], type=target.field(n).type) for i, n in enumerate(names)]], schema=target)

    return rows.mapInArrow(run, schema)


def kept_bytes(data: bytes, runs: np.ndarray) -> bytes:
    edges = [0, *runs.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and ``text`` without its repeated bytes; characters that are cut in two become U+FFFD."""
    return deduplicated(documents, lambda t, runs: (kept_bytes(t, runs).decode("utf-8", "replace"),), "text string", text, doc_id)


def digest(data: bytes, runs: np.ndarray) -> tuple[int, int, int, str]:
    return len(data), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), hashlib.sha256(kept_bytes(data, runs)).hexdigest()


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"), digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
