"""Community alerts under an analyst's budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .running import running_totals


def community_scores(rows: DataFrame, community: str, score: str, pos: str, smallest: int = 2, largest: int = 40, weight: str = "w") -> DataFrame:
    """``size``, ``weight`` and ``top3`` (the mean of the three best scores) of communities within the size limits.

    Sizes are counted first: the window sees no community that is too large."""
    size = rows.groupBy(community).agg(F.count("*").alias("size"), F.sum(weight).alias("weight")).where(F.col("size").between(smallest, largest))
    order = Window.partitionBy(community).orderBy(F.col(score).desc_nulls_last(), F.col(pos))
    best = rows.join(size, community).withColumn("__k", F.row_number().over(order)).where("__k <= 3")
    return best.groupBy(community, "size", "weight").agg(F.avg(score).alias("top3"))


def greedy_communities(scored: DataFrame, community: str, budget: float, weight: str = "weight") -> DataFrame:
    """Communities by score, each taken if its weight still fits the budget and passed over if not; ties by name.

    All up to the first that doesn't fit are taken: running totals tell which, on any number of partitions. What is left
    of the budget is then less than that one's weight, so among the rest only the first floor(left / weight) of each
    distinct weight can ever be taken; these few go through the sequence one by one, folded in one row."""
    order = [F.col("top3").desc_nulls_last(), F.col(community)]
    ran = checkpointed(running_totals(scored.where(F.col(weight) > 0), [F.lit(0)], order, {"__run": F.col(weight)}))
    first = ran.where(F.col("__run") > budget).orderBy(*order).limit(1).select("__run", weight).first()
    taken = ran.where(F.col("__run") <= budget).drop("__run")
    if first is None:
        return taken
    left = budget - (first["__run"] - first[weight])
    within = Window.partitionBy(F.round(weight, 9)).orderBy(*order)
    some = ran.where((F.col("__run") > budget) & (F.col(weight) <= left)).withColumn("__r", F.row_number().over(within)).where(F.col("__r") <= F.lit(left) / F.col(weight) + 1).drop("__r")
    one = some.agg(F.array_sort(F.collect_list(F.struct((-F.col("top3")).alias("o"), F.col(community).alias("c"), F.col(weight).alias("w")))).alias("all"))
    empty = F.array().cast(one.schema["all"].dataType)
    folded = F.aggregate("all", F.struct(F.lit(float(left)).alias("left"), empty.alias("taken")), lambda s, x: F.when(x["w"] <= s["left"], F.struct((s["left"] - x["w"]).alias("left"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s))
    more = one.select(F.explode(folded["taken"]).alias("x")).select(F.col("x.c").alias(community))
    return taken.unionByName(some.drop("__run").join(more, community, "left_semi"))


def community_alerts(rows: DataFrame, community: str, score: str, pos: str, budget_share: float, weight: str = "w") -> DataFrame:
    """The communities alerted within ``budget_share`` of all weight: community, size, weight, top3."""
    total = rows.agg(F.sum(weight)).first()[0] or 0.0
    return greedy_communities(community_scores(rows, community, score, pos, weight=weight), community, budget_share * total)


def shared_tokens(members: DataFrame, attrs: DataFrame, community: str) -> DataFrame:
    """Tokens that two or more members of a community hold, and how many do."""
    held = members.select(community, "person_id").join(attrs.select("person_id", "attr_type", "token").distinct(), "person_id")
    return held.groupBy(community, "attr_type", "token").agg(F.count("*").alias("members")).where("members >= 2")


def community_subgraph(members: DataFrame, links: DataFrame, community: str = "community") -> DataFrame:
    """community, type, src, dst of the edges of the property graph that start at a member."""
    own = members.select(F.col(community), F.col("person_id").cast("string").alias("src")).distinct()
    return links.join(own, "src").select(community, "type", "src", "dst")
