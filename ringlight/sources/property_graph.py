"""The property graph as two tables: nodes (label, id, properties) and edges (type, src, dst, properties)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(df: DataFrame, label: str, key: str, *properties: str) -> DataFrame:
    """One node for each key; properties as JSON, without nulls and without NaN."""
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c in properties for t in [dict(df.dtypes)[c]]]
    json = F.to_json(F.struct(*plain)) if properties else F.lit("{}")
    return df.where(F.col(key).isNotNull()).select(F.lit(label).alias("label"), F.col(key).cast("string").alias("id"), json.alias("properties")).dropDuplicates(["label", "id"])


def edges(df: DataFrame, kind: str, src: str, dst: str, *properties: str) -> DataFrame:
    json = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return df.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.lit(kind).alias("type"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), json.alias("properties"))


def transfer_rollup(transfers: DataFrame, month_days: int = 30) -> DataFrame:
    """One row for each ordered pair: how often, how much, and the first and last day of the months."""
    by = transfers.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.min("month").alias("a"), F.max("month").alias("b"))
    return by.select("src", "dst", "n", "amount", (F.col("a") * month_days).alias("first_day"), (F.col("b") * month_days).alias("last_day"))


def property_graph(persons: DataFrame, attrs: DataFrame, visits: DataFrame, transfers: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes and edges. An account stands beside each person; every attribute type is a label of its own."""
    account = persons.select("person_id", F.concat(F.col("person_id").cast("string"), F.lit(":acct")).alias("account"))
    kinds = attrs.select(F.col("attr_type").alias("label"), F.col("token").cast("string").alias("id"), F.lit("{}").alias("properties")).distinct()
    every = nodes(persons, "Person", "person_id", *[c for c in persons.columns if c != "person_id"]).unionByName(nodes(account, "Account", "account")).unionByName(kinds).unionByName(nodes(visits.select("merchant_token").distinct(), "Merchant", "merchant_token"))
    held = attrs.select(F.concat(F.lit("HAS_"), F.upper("attr_type")).alias("type"), F.col("person_id").cast("string").alias("src"), F.col("token").cast("string").alias("dst"), F.to_json(F.struct("first_day")).alias("properties"))
    links = edges(account, "OWNS", "person_id", "account").unionByName(held).unionByName(edges(visits, "PAID_AT", "person_id", "merchant_token", "first_day")).unionByName(edges(transfer_rollup(transfers), "TRANSFERRED_TO", "src", "dst", "n", "amount", "first_day", "last_day")).unionByName(edges(hosts, "AUTHORIZED_USER_ON", "person_id", "host_person_id", "first_day"))
    return every, links


def repeated_keys(every: DataFrame) -> DataFrame:
    """Labels and ids that stand more than once: none, if the graph is sound."""
    return every.groupBy("label", "id").agg(F.count("*").alias("n")).where("n > 1")


def write_graph(every: DataFrame, links: DataFrame, folder: str) -> None:
    every.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    links.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")


def with_scores(persons: DataFrame, scores: DataFrame, alerted: DataFrame) -> DataFrame:
    """Persons with ``risk_score`` (null without one) and ``community_alert``."""
    s = scores.select("person_id", F.col("score").alias("risk_score")).dropDuplicates(["person_id"])
    a = alerted.select("person_id", F.lit(True).alias("community_alert")).distinct()
    return persons.join(s, "person_id", "left").join(a, "person_id", "left").withColumn("community_alert", F.coalesce("community_alert", F.lit(False)))
