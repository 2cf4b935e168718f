"""Named tables in a folder, and loaders that keep labels away from features."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The tables that features may read; labels are not among them.
BANK_TABLES = ("persons", "person_attr", "attr_meta", "paid_at", "merchant_meta", "transfers", "authorized_users", "similar", "monthly", "fraud_confirmations")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, names: tuple[str, ...] | None = None, schemas: dict[str, StructType] | None = None) -> dict[str, DataFrame]:
    """The named tables of a folder, or every ``*.parquet`` in it; with a schema where one is given, else the files' own."""
    if names is None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        names = tuple(sorted(f.getPath().getName().removesuffix(".parquet") for f in found or ()))
    read = lambda n: spark.read.schema(schemas[n]) if schemas and n in schemas else spark.read
    return {n: read(n).parquet(f"{folder}/{n}.parquet") for n in names}


def read_bank(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return read_tables(spark, folder, BANK_TABLES)


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def write_features(features: DataFrame, folder: str) -> None:
    """One table, a partition for each snapshot day T."""
    features.write.mode("overwrite").partitionBy("T").parquet(f"{folder}/features")


def stacked_features(spark: SparkSession, folder: str, days: list[int], cross_bank: bool = False) -> DataFrame:
    """Features of the given snapshots, with the cross-bank columns if asked for; other snapshots are pruned."""
    out = spark.read.parquet(f"{folder}/features").where(F.col("T").isin(days))
    if cross_bank:
        out = out.join(spark.read.parquet(f"{folder}/xbank").where(F.col("T").isin(days)), ["person_id", "T"], "left")
    return out


def write_projection(edges: DataFrame, day: int, folder: str) -> None:
    """The person-person graph of one day, beside those of other days."""
    edges.write.mode("overwrite").parquet(f"{folder}/projection/T={day}")


def read_projection(spark: SparkSession, folder: str, days: list[int]) -> DataFrame:
    """T, src, dst, w of the given days; other days are pruned."""
    return spark.read.option("basePath", f"{folder}/projection").parquet(f"{folder}/projection").where(F.col("T").isin(days))


def write_metrics(metrics: dict, path: str) -> None:
    Path(path).write_text(json.dumps(metrics, indent=1, sort_keys=True, default=float))


def read_optional(path: str) -> dict:
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def dataset_statistics(tables: dict[str, DataFrame], by: dict[str, list[str]]) -> DataFrame:
    """Row counts of tables, and counts by value of chosen columns: table, column, value, n."""
    out = None
    for name, df in tables.items():
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit("").alias("column"), F.lit("").alias("value"), "n")]
        parts += [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(c).alias("column"), "value", "n") for c in by.get(name, [])]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out
