"""Graph operators on edge tables: the person-person projection and what is computed from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def capped(edges: DataFrame, token: str, cap: int, person: str = "person_id") -> DataFrame:
    """Distinct (person, token) pairs of tokens with 2 to ``cap`` persons, and ``deg``. The cap is part of the
    meaning; it also bounds the self-joins that follow to cap x edges."""
    pairs = edges.select(person, token).distinct()
    degree = pairs.groupBy(token).agg(F.count("*").alias("deg")).where(F.col("deg").between(2, cap))
    return pairs.join(degree, token)


def co_occurrence(edges: DataFrame, token: str, cap: int, person: str = "person_id") -> DataFrame:
    """src, dst, w: the sum over shared tokens of 1 / ln(degree), both directions, no loops."""
    held = capped(edges, token, cap, person)
    a = held.select(F.col(token).alias("t"), F.col(person).alias("src"), "deg")
    b = held.select(F.col(token).alias("t"), F.col(person).alias("dst"))
    return a.join(b, "t").where("src <> dst").groupBy("src", "dst").agg(F.sum(1.0 / F.log("deg")).alias("w"))


def directed(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each distinct ordered pair with weight 1, in both directions: a pair that stands both ways weighs 2."""
    one = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src <> dst").distinct()
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.withColumn("w", F.lit(1.0))


def projection(attrs: list[tuple[DataFrame, str, int]], links: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """src, dst, w summed over co-occurrence in (edges, token, cap) and over directed links."""
    parts = [co_occurrence(e, t, cap) for e, t, cap in attrs] + [directed(df, a, b) for df, a, b in links]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))


def hop_counts(edges: DataFrame, marked: DataFrame, node: str = "person_id") -> DataFrame:
    """Marked neighbours, and paths of two steps to marked nodes (walks back to oneself included), of every node that
    has one or the other; for all others both are 0."""
    links = edges.select("src", "dst")
    one = links.join(marked.select(F.col(node).alias("dst")).distinct(), "dst", "left_semi").groupBy("src").agg(F.count("*").alias("hop1"))
    two = links.join(one.select(F.col("src").alias("dst"), "hop1"), "dst").groupBy("src").agg(F.sum("hop1").alias("hop2"))
    return one.join(two, "src", "full").select(F.col("src").alias(node), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("hop1", "hop2")])


def attribute_shares(attrs: DataFrame, known: DataFrame, kinds: tuple[str, ...], strong: tuple[str, ...]) -> DataFrame:
    """person_id, g_share_<kind> (other holders of its tokens, summed), g_max_strong_share (the most of one strong token)
    and g_attr_known_links (tokens that another confirmed person holds)."""
    held = attrs.select("person_id", "attr_type", "token").distinct()
    held = held.join(known.select("person_id", F.lit(1).alias("k")).distinct(), "person_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    by = held.groupBy("attr_type", "token").agg((F.count("*") - 1).alias("others"), F.sum("k").alias("total"))
    rows = held.join(by, ["attr_type", "token"])
    of = lambda t: F.sum(F.when(F.col("attr_type") == t, F.col("others")).otherwise(0)).alias(f"g_share_{t}")
    return rows.groupBy("person_id").agg(*map(of, kinds), F.max(F.when(F.col("attr_type").isin(*strong), F.col("others"))).alias("g_max_strong_share"), F.sum((F.col("total") - F.col("k") > 0).cast("long")).alias("g_attr_known_links"))


def identity_mismatch(nids: DataFrame, persons: DataFrame) -> DataFrame:
    """person_id and g_nid_identity_mismatch: the most other identities (id_token) on one of the person's national ids."""
    held = nids.select("person_id", "token").distinct()
    many = held.join(persons.select("person_id", "id_token"), "person_id").groupBy("token").agg((F.count_distinct("id_token") - 1).alias("m"))
    return held.join(many, "token").groupBy("person_id").agg(F.max("m").alias("g_nid_identity_mismatch"))


def counterparties(transfers: DataFrame) -> DataFrame:
    """person_id, g_transfer_out_cp and g_transfer_in_cp: distinct persons paid, and paid by."""
    pairs = transfers.select("src", "dst").distinct()
    both = pairs.select(F.col("src").alias("person_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(pairs.select(F.col("dst").alias("person_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("person_id").agg(F.sum("o").alias("g_transfer_out_cp"), F.sum("i").alias("g_transfer_in_cp"))


def host_measures(users: DataFrame) -> DataFrame:
    """person_id, g_au_hosts (distinct hosts), g_au_dependents (distinct persons hosted) and g_au_host_max_dependents (the
    most persons that one of the person's hosts has)."""
    pairs = users.select("person_id", "host_person_id").distinct()
    dependents = pairs.groupBy("host_person_id").agg(F.count("*").alias("n"))
    guest = pairs.join(dependents, "host_person_id").groupBy("person_id").agg(F.count("*").alias("g_au_hosts"), F.max("n").alias("g_au_host_max_dependents"))
    return guest.join(dependents.select(F.col("host_person_id").alias("person_id"), F.col("n").alias("g_au_dependents")), "person_id", "full")


def similar_count(similar: DataFrame) -> DataFrame:
    """person_id and g_similar_count: the pairs of near duplicates that a person is in."""
    return similar.select(F.explode(F.array("a", "b")).alias("person_id")).groupBy("person_id").agg(F.count("*").alias("g_similar_count"))


def bipartite(attrs: DataFrame) -> DataFrame:
    """src, dst of the undirected graph of persons and their attributes; ids carry their label, so that none clash."""
    return attrs.select(F.concat(F.lit("Person:"), F.col("person_id").cast("string")).alias("src"), F.concat_ws(":", F.col("attr_type"), F.col("token").cast("string")).alias("dst")).distinct()


def pagerank(edges: DataFrame, nodes: DataFrame, node: str = "person_id", damping: float = 0.85, rounds: int = 50) -> DataFrame:
    """Weighted PageRank times n after a fixed number of rounds; the rank of nodes without edges goes to all alike.

    Edges lie by source and nodes by id, each laid out once and kept; a round moves one sum for each target, and ends in
    a checkpoint: two parts of the next one read it."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = checkpointed(nodes.select(F.col(node).alias("id")).distinct())
    n = nodes.count()
    out_weight = edges.groupBy("src").agg(F.sum("w").alias("out"))
    share = edges.join(out_weight, "src").select("src", "dst", (F.col("w") / F.col("out")).alias("share")).repartition(parts, "src").persist()
    base = nodes.join(out_weight.select(F.col("src").alias("id"), F.lit(False).alias("linked")), "id", "left").select("id", F.col("linked").isNull().alias("dangling")).repartition(parts, "id").persist()
    ranks = base.withColumn("r", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds):
        loose = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("r")))).first()[0] or 0.0
        got = share.join(ranks.select(F.col("id").alias("src"), "r"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("r")).alias("got"))
        ranks = checkpointed(base.join(got, "id", "left").select("id", "dangling", (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + loose / max(n, 1))).alias("r")))
    share.unpersist()
    base.unpersist()
    return ranks.select(F.col("id").alias(node), (F.col("r") * n).alias("pagerank"))


def shared_counts(attrs: DataFrame, kinds: list[str]) -> DataFrame:
    """For each person and attribute type, the other holders of its tokens, summed: one column for each type."""
    held = attrs.select("person_id", "attr_type", "token").distinct()
    degree = held.groupBy("attr_type", "token").agg((F.count("*") - 1).alias("others"))
    return held.join(degree, ["attr_type", "token"]).groupBy("person_id").pivot("attr_type", kinds).agg(F.sum("others")).na.fill(0, kinds)


def known_links(attrs: DataFrame, known: DataFrame) -> DataFrame:
    """Tokens of each person that another confirmed person holds too."""
    held = attrs.select("person_id", "attr_type", "token").distinct()
    flagged = held.join(known.select("person_id", F.lit(1).alias("k")).distinct(), "person_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    by = flagged.groupBy("attr_type", "token").agg(F.sum("k").alias("total"))
    return flagged.join(by, ["attr_type", "token"]).groupBy("person_id").agg(F.sum((F.col("total") - F.col("k") > 0).cast("long")).alias("known_links"))


def covisitors(visits: DataFrame, merchant: str, cap: int) -> DataFrame:
    """Distinct other persons met through merchants with at most ``cap`` visitors."""
    held = capped(visits, merchant, cap)
    a, b = held.select(merchant, "person_id"), held.select(merchant, F.col("person_id").alias("other"))
    return a.join(b, merchant).where("other <> person_id").groupBy("person_id").agg(F.count_distinct("other").alias("covisitors"))


def strong_pairs(attrs: DataFrame, cap: int, kinds: int = 2) -> DataFrame:
    """Pairs that share tokens of at least ``kinds`` types, through tokens with at most ``cap`` holders."""
    held = attrs.select("person_id", "attr_type", "token").distinct()
    small = held.groupBy("attr_type", "token").agg(F.count("*").alias("deg")).where(F.col("deg").between(2, cap)).drop("deg")
    held = held.join(small, ["attr_type", "token"])
    a, b = held.withColumnRenamed("person_id", "a"), held.withColumnRenamed("person_id", "b")
    return a.join(b, ["attr_type", "token"]).where("a < b").groupBy("a", "b").agg(F.count_distinct("attr_type").alias("n_kinds"), F.count("*").alias("n_shared")).where(F.col("n_kinds") >= kinds)


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row ``nmi``: normalized mutual information of two labellings, arithmetic mean, natural logarithm."""
    joint = rows.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    total = joint.agg(F.sum("n").alias("t"))
    entropy = lambda c: joint.groupBy(c).agg(F.sum("n").alias("m")).join(F.broadcast(total)).agg((-F.sum(F.col("m") / F.col("t") * F.log(F.col("m") / F.col("t")))).alias(f"h_{c}"))
    both = joint.join(F.broadcast(total)).agg((-F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))).alias("h"))
    one = both.join(F.broadcast(entropy(a))).join(F.broadcast(entropy(b)))
    mean = (F.col(f"h_{a}") + F.col(f"h_{b}")) / 2
    return one.select(F.when(mean == 0, 1.0).otherwise((F.col(f"h_{a}") + F.col(f"h_{b}") - F.col("h")) / mean).alias("nmi"))
