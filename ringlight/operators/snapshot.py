"""What is known at day T: every table without the future."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEVER = 1_000_000


def snapshot(tables: dict[str, DataFrame], day: int) -> dict[str, DataFrame]:
    """Tables as of day T; events of the day itself count. Months count when all their 30 days are past.

    ``persons`` gets closed, known_fraud and scored: confirmed and closed persons stay in the graph, unscored."""
    confirmed = tables["fraud_confirmations"].where(F.col("confirmed_day") <= day)
    known = confirmed.select("person_id", F.lit(True).alias("known")).distinct()
    persons = tables["persons"].where(F.col("onboard_day") <= day).join(known, "person_id", "left")
    persons = persons.withColumn("known_fraud", F.coalesce("known", F.lit(False))).drop("known")
    persons = persons.withColumn("closed", F.col("known_fraud") | (F.coalesce("close_day", F.lit(NEVER)) <= day)).withColumn("scored", ~F.col("closed"))
    live = tables["persons"].where(F.col("onboard_day") <= day).select("person_id")  # without the join with what is known
    out = {"persons": persons, "fraud_confirmations": confirmed}
    within = lambda df, *ends: _within(df, live, ends)
    for name, ends in (("person_attr", ("person_id",)), ("paid_at", ("person_id",)), ("authorized_users", ("person_id", "host_person_id")), ("similar", ("a", "b"))):
        if name in tables:
            out[name] = within(tables[name].where(F.col("first_day") <= day), *ends)
    for name, ends in (("transfers", ("src", "dst")), ("monthly", ("person_id",))):
        if name in tables:
            out[name] = within(tables[name].where((F.col("month") + 1) * 30 <= day), *ends)
    return out


def _within(df: DataFrame, live: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    for e in ends:
        df = df.join(live.withColumnRenamed("person_id", e), e, "left_semi")
    return df
