"""What the text operators share: whole-text batches, the shared folder, and sorted hash arrays."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root, ship_package

#: Bytes of text that a worker holds as Python objects at a time; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder, as a path that workers can open and memory-map.

    The checkpoint folder must be mounted on every machine (``file:`` or no scheme); with another scheme
    there is nothing to map and this raises."""
    root = checkpoint_root(spark)
    url = urlparse(root)
    if url.scheme not in ("", "file"):
        raise ValueError(f"spark.checkpoint.dir must be a mounted folder to memory-map a model, not {root}")
    path = os.path.join(url.path, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def write_array(path: str, values: np.ndarray) -> None:
    """Write beside, then rename: a task that runs twice leaves one whole file."""
    beside = f"{path}.{uuid.uuid4().hex}"
    values.tofile(beside)
    os.replace(beside, path)


def map_array(path: str, dtype) -> np.ndarray:
    if not os.path.getsize(path):
        return np.empty(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r")


def text_blocks(batch: pa.RecordBatch, column: str, as_bytes: bool, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch with their texts (null: empty), about ``limit`` bytes each."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if as_bytes:
        texts = texts.cast(pa.binary())
    empty = b"" if as_bytes else ""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start), [x if x is not None else empty for x in texts.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start), [x if x is not None else empty for x in texts.slice(start).to_pylist()]


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, pa.RecordBatch], dict]], fields: str, text: str | Column = "text", keys: tuple[str, ...] = ("doc_id",), as_bytes: bool = True, extra: dict[str, Column] | None = None, limit: int = BLOCK_BYTES) -> DataFrame:
    """``keys`` and the columns that a worker's function makes from whole texts.

    ``make`` runs once in each task; its function gets the texts of a block and the block's columns, and
    returns the new columns by name. Only the named columns are read, so other columns, whatever their
    names, have no part in it."""
    extra = extra or {}
    df = df.select(*keys, *[c.alias(k) for k, c in extra.items()], (F.col(text) if isinstance(text, str) else text).alias("__text"))
    added = T._parse_datatype_string(fields)
    schema = T.StructType([df.schema[k] for k in keys] + list(added))
    names = [f.name for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, f = to_arrow_schema(schema), make()
        gc.disable()  # words and ids by the million hold no cycles; the collector would walk them again and again
        for batch in batches:
            gc.collect()
            for block, texts in text_blocks(batch, "__text", as_bytes, limit):
                made = f(texts, block)
                yield pa.RecordBatch.from_arrays([block.column(block.schema.get_field_index(k)) for k in keys] + [pa.array(made[n], type=target.field(n).type) for n in names], schema=target)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list, pa.RecordBatch], pa.RecordBatch]], text: str = "text", as_bytes: bool = False, limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows with all their columns, changed or filtered a block at a time by a worker's function of the block's
    texts (null: empty) and the block."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        gc.disable()
        for batch in batches:
            gc.collect()
            for block, texts in text_blocks(batch, text, as_bytes, limit):
                yield f(texts, block)

    return df.mapInArrow(run, schema)


def crc_remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


#: Odd multipliers of a bijective 64-bit mix; its top bits choose the bucket of a key.
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit keys that spreads them evenly over ranges."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) * MIX
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xD6E8FEB86659FD93)


def bucket_bits(partitions: int) -> int:
    """Bits of the bucket number, for about two buckets to each input partition."""
    return max(3, int(2 * max(1, partitions) - 1).bit_length())


def bucket_slices(sorted_mixed: np.ndarray, bits: int) -> np.ndarray:
    """Bounds in sorted mixed keys of each of the 2**bits ranges."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_mixed, edges), [len(sorted_mixed)]])


class HashRanges:
    """Sorted 64-bit keys in one memory-mapped file for each range of their top bits."""

    def __init__(self, folder: str, bits: int, values: dict[str, str]):
        self.bits, self.folder, self.values = bits, folder, values
        self.open: dict[int, tuple] = {}

    def part(self, b: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        if b not in self.open:
            self.open[b] = map_array(f"{self.folder}/{b}.keys", np.uint64), {k: map_array(f"{self.folder}/{b}.{k}", t) for k, t in self.values.items()}
        return self.open[b]

    def find(self, sorted_keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """For sorted mixed keys: whether each is stored, and its values (0 where it isn't)."""
        found = np.zeros(len(sorted_keys), bool)
        out = {k: np.zeros(len(sorted_keys), t) for k, t in self.values.items()}
        at = bucket_slices(sorted_keys, self.bits)
        for b in np.flatnonzero(np.diff(at)):
            lo, hi = at[b], at[b + 1]
            keys, values = self.part(int(b))
            if not len(keys):
                continue
            pos = np.searchsorted(keys, sorted_keys[lo:hi])
            pos[pos == len(keys)] = 0
            hit = keys[pos] == sorted_keys[lo:hi]
            found[lo:hi] = hit
            for k in out:
                out[k][lo:hi] = np.where(hit, values[k][pos], 0)
        return found, out
