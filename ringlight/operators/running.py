"""Running totals of an ordered table, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_totals(rows: DataFrame, by: list[Column | str], order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``rows`` and, for each named value, its sum over the rows up to and with this one in ``order`` within ``by``.

    Rows are dealt to partitions by ranges of (by, order), each partition adds up its own part, and the parts of
    the partitions before it are added: a row for each partition and group, joined back. The order must be total
    (ties in it may fall to two partitions, in either order)."""
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    named = {f"__v{i}": v.cast("double") for i, v in enumerate(totals.values())}
    group = F.struct(*keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns(named | {"__by": group}).repartitionByRange(parts, *[k.asc_nulls_first() for k in keys], *order).withColumn("__part", F.spark_partition_id())
    dealt = checkpointed(dealt)  # the partition numbers stand from here on
    own = Window.partitionBy("__part", "__by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("__by", "__part").agg(*[F.sum(v).alias(f"{v}s") for v in named])
    offsets = sums.select("__by", "__part", *[F.coalesce(F.sum(f"{v}s").over(before), F.lit(0.0)).alias(f"{v}o") for v in named])
    inner = dealt.withColumns({f"{v}r": F.sum(v).over(own) for v in named})
    same = reduce(lambda a, b: a & b, [inner["__part"] == offsets["__part"], inner["__by"].eqNullSafe(offsets["__by"])])
    joined = inner.join(offsets, same, "left").drop(offsets["__part"]).drop(offsets["__by"])
    return joined.withColumns({name: F.col(f"{v}r") + F.col(f"{v}o") for name, v in zip(totals, named, strict=True)}).drop("__part", "__by", *[f"{v}{s}" for v in named for s in ("", "r", "o")])
