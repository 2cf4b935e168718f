"""Folds, rows to train and test on, and ranking metrics at a target prevalence.

Orders within a group go through ``running_totals``: no task holds a whole snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from .running import running_totals

#: The groups of honest people that look like rings, as predicates on labels.
CONFOUNDERS = {
    "foyer_3plus": "household_size >= 3", "colocation": "is_colocation", "residence_etudiante": "is_dorm", "personne_agee_aidee": "is_elderly_assisted",
    "defaut_credit_legitime": "is_distressed", "primo_arrivant": "is_newcomer", "vendeur_tradeline": "is_tradeline_seller", "mule": "is_mule",
}


def prevalence_weights(rows: DataFrame, y: str, target: float, by: str) -> DataFrame:
    """``w``: 1 for positives; for negatives what makes the weighted share of positives the target. A group
    without positives or without negatives weighs 1 throughout."""
    counts = rows.groupBy(by).agg(F.sum(y).cast("double").alias("__p"), (F.count("*") - F.sum(y)).cast("double").alias("__n"))
    weight = F.when((F.col(y) == 1) | (F.col("__p") == 0) | (F.col("__n") == 0), 1.0).otherwise(F.col("__p") * (1 - target) / (target * F.col("__n")))
    return rows.join(counts, by).withColumn("w", weight).drop("__p", "__n")


def select_budget(rows: DataFrame, score: str, pos: str, budget: float, by: str) -> DataFrame:
    """``selected``: the best-scored prefix whose weight stays within the budget's share of all weight, one row at
    least. Rows without a score come last; ties go by position, which is unique within a group."""
    total = rows.groupBy(F.col(by).alias("__b")).agg(F.sum("w").alias("__all"))
    ran = running_totals(rows, [by], [F.col(score).desc_nulls_last(), F.col(pos)], {"__run": F.col("w"), "__k": F.lit(1)})
    joined = ran.join(total, ran[by].eqNullSafe(total["__b"]))
    return joined.withColumn("selected", (F.col("__run") <= F.col("__all") * budget) | (F.col("__k") == 1)).drop("__run", "__k", "__all", "__b")


def rank_shares(rows: DataFrame, scores: Sequence[str], by: str) -> DataFrame:
    """``rows`` and, for each score, ``__share_<score>``: average rank / n among the rows with a score (ascending), null
    without one. Ranks are counted on distinct scores and joined back."""
    for s in scores:
        steps = rows.where(F.col(s).isNotNull()).groupBy(F.col(by).alias("__b"), F.col(s).alias("__s")).agg(F.count("*").alias("__ties"))
        ran = running_totals(steps, ["__b"], [F.col("__s")], {"__upto": F.col("__ties")})
        n = steps.groupBy(F.col("__b").alias("__b2")).agg(F.sum("__ties").alias("__n"))
        share = ran.join(n, F.col("__b").eqNullSafe(F.col("__b2"))).select("__b", "__s", ((F.col("__upto") - (F.col("__ties") - 1) / 2) / F.col("__n")).alias(f"__share_{s}"))
        rows = rows.join(share, rows[by].eqNullSafe(share["__b"]) & (rows[s] == share["__s"]), "left").drop("__b", "__s")
    return rows


def rank_ensemble(rows: DataFrame, scores: list[str], by: str) -> DataFrame:
    """``ensemble``: the mean of the rank shares that a row has."""
    shares = [F.col(f"__share_{s}") for s in scores]
    total = sum((F.coalesce(s, F.lit(0.0)) for s in shares[1:]), F.coalesce(shares[0], F.lit(0.0)))
    held = sum((s.isNotNull().cast("int") for s in shares[1:]), shares[0].isNotNull().cast("int"))
    return rank_shares(rows, scores, by).withColumn("ensemble", F.try_divide(total, held)).drop(*[f"__share_{s}" for s in scores])


def _curve(rows: DataFrame, y: str, score: str, by: str, weight: str) -> DataFrame:
    """Cumulative positive and negative weight down to each distinct score."""
    steps = rows.groupBy(F.col(by), F.col(score)).agg(F.sum(F.col(y) * F.col(weight)).alias("p"), F.sum((1 - F.col(y)) * F.col(weight)).alias("n"))
    whole = steps.groupBy(F.col(by).alias("__b")).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    ran = running_totals(steps, [by], [F.col(score).desc_nulls_last()], {"tp": F.col("p"), "fp": F.col("n")})
    return ran.join(whole, ran[by].eqNullSafe(whole["__b"])).select(ran[by], ran[score], "p", "n", "tp", "fp", "all_p", "all_n")


def average_precision(rows: DataFrame, y: str, score: str, by: str, weight: str = "w") -> DataFrame:
    return _curve(rows, y, score, by, weight).groupBy(by).agg(F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def roc_auc(rows: DataFrame, y: str, score: str, by: str) -> DataFrame:
    """Mann-Whitney: ties count half."""
    c = _curve(rows.withColumn("__one", F.lit(1.0)), y, score, by, "__one")
    return c.groupBy(by).agg(F.try_divide(F.sum(F.col("p") * (F.col("all_n") - F.col("fp") + F.col("n") / 2)), F.max("all_p") * F.max("all_n")).alias("auc"))


def recall_at_fpr(rows: DataFrame, y: str, score: str, by: str, fpr: float) -> DataFrame:
    """Recall where the false-positive rate is ``fpr``, by straight lines between the points of the ROC curve.

    Only the two points next to ``fpr`` matter: the last one up to it and the first one beyond."""
    c = _curve(rows.withColumn("__one", F.lit(1.0)), y, score, by, "__one").select(by, F.try_divide(F.col("fp"), F.col("all_n")).alias("x"), F.try_divide(F.col("tp"), F.col("all_p")).alias("v"))
    at = F.struct("x", "v")
    ends = c.groupBy(by).agg(F.max(F.when(F.col("x") <= fpr, at)).alias("a"), F.min(F.when(F.col("x") > fpr, at)).alias("b"))
    x0, v0 = F.coalesce(F.col("a.x"), F.lit(0.0)), F.coalesce(F.col("a.v"), F.lit(0.0))
    return ends.select(by, F.when((x0 == fpr) | F.col("b").isNull(), F.col("a.v")).otherwise(v0 + (F.col("b.v") - v0) * (fpr - x0) / (F.col("b.x") - x0)).alias("recall"))


def budget_metrics(rows: DataFrame, y: str, by: str) -> DataFrame:
    """Alerts, weighted precision and recall of the selected rows."""
    hit = F.sum(F.when(F.col("selected"), F.col(y) * F.col("w")).otherwise(0.0))
    return rows.groupBy(by).agg(F.sum(F.col("selected").cast("long")).alias("alerts"), F.try_divide(hit, F.sum(F.when(F.col("selected"), F.col("w")))).alias("precision"), F.try_divide(hit, F.sum(F.col(y) * F.col("w"))).alias("recall"))


def ranking_metrics(rows: DataFrame, y: str, score: str, pos: str, by: str, target: float, budget: float, fpr: float = 0.01) -> DataFrame:
    """A row for each group: n, positives, prevalence, pr_auc, pr_auc_at_target, roc_auc, alerted_rows, precision_at_k,
    recall_at_k and recall_at_fpr."""
    weighted = prevalence_weights(rows, y, target, by)
    out = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("positives"), F.avg(F.col(y).cast("double")).alias("prevalence"))
    picked = budget_metrics(select_budget(weighted, score, pos, budget, by), y, by).withColumnsRenamed({"alerts": "alerted_rows", "precision": "precision_at_k", "recall": "recall_at_k"})
    plain = average_precision(weighted.withColumn("__one", F.lit(1.0)), y, score, by, "__one").withColumnRenamed("ap", "pr_auc")
    at = average_precision(weighted, y, score, by).withColumnRenamed("ap", "pr_auc_at_target")
    for part in (plain, at, roc_auc(rows, y, score, by).withColumnRenamed("auc", "roc_auc"), picked, recall_at_fpr(rows, y, score, by, fpr).withColumnRenamed("recall", "recall_at_fpr")):
        out = out.join(part, by, "left")
    return out


def recall_by(rows: DataFrame, y: str, flag: str, level: str) -> DataFrame:
    """Share of the positives of each level that are flagged."""
    return rows.where(F.col(y) == 1).groupBy(level).agg(F.count("*").alias("positives"), F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")).alias("recall"))


def predicate_rates(rows: DataFrame, flag: str, predicates: dict[str, str]) -> DataFrame:
    """For each named predicate: rows that meet it, the share of them that is flagged, and that share over the share
    of all rows (null if none is flagged); one pass."""
    sums = [x for i, p in enumerate(predicates.values()) for x in (F.sum(F.expr(p).cast("int")).alias(f"n{i}"), F.avg(F.when(F.expr(p), F.col(flag).cast("double"))).alias(f"r{i}"))]
    one = rows.agg(F.avg(F.col(flag).cast("double")).alias("base"), *sums)
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(F.col(f"n{i}"), F.lit(0)).cast("long").alias("n"), F.col(f"r{i}").alias("rate"), F.when(F.col("base") > 0, F.col(f"r{i}") / F.col("base")).alias("ratio")) for i, k in enumerate(predicates)])))


def confounder_rates(test: DataFrame, labels: DataFrame, flag: str, predicates: dict[str, str] = CONFOUNDERS) -> DataFrame:
    """``predicate_rates`` of the legitimate test rows; household_size counts the distinct identities of a household."""
    legit = labels.where("is_synthetic = 0")
    size = legit.groupBy("household_id").agg(F.count_distinct("identity_id").alias("household_size"))
    marks = [c for c in labels.columns if c.startswith("is_") and c != "is_synthetic"]
    who = legit.select("person_id", "household_id", *marks).join(size, "household_id", "left")
    rows = test.where("is_synthetic = 0").select("person_id", flag).join(who, "person_id", "left")
    return predicate_rates(rows, flag, predicates)


def confounder_mean(rates: DataFrame) -> DataFrame:
    """One row ``mean``: the rate over all groups, each by its number; 0 without any."""
    return rates.agg((F.coalesce(F.sum(F.coalesce("rate", F.lit(0.0)) * F.col("n")), F.lit(0.0)) / F.greatest(F.lit(1), F.coalesce(F.sum("n"), F.lit(0)))).alias("mean"))


def ring_persons(test: DataFrame, flag: str) -> DataFrame:
    """Synthetic persons of the test rows with the first day on which they were alerted and ``lead`` to the bust-out."""
    alerted = F.min(F.when(F.col(flag), F.col("T")))
    one = lambda c: F.min(c).alias(c)  # noqa: E731  # the same in all rows of a person
    by = test.where("is_synthetic = 1").groupBy("person_id").agg(*map(one, ("ring_id", "bust_out_day", "exposure", "sophistication", "scenario")), alerted.alias("first_alert"))
    return by.withColumns({"detected": F.col("first_alert").isNotNull(), "lead": F.col("bust_out_day") - F.col("first_alert")})


def ring_metrics(test: DataFrame, flag: str, early: int = 30) -> DataFrame:
    """One row: rings, ring_recall, ring_coverage_when_detected, person_recall, median_lead_days, share_detected_early
    (``early`` days or more before the bust-out) and exposure_avoided_share, over all test days."""
    persons = ring_persons(test, flag)
    rings = persons.groupBy("ring_id").agg(F.max("detected").alias("detected"), F.avg(F.col("detected").cast("double")).alias("coverage"))
    a = rings.agg(F.count("*").alias("rings"), F.avg(F.col("detected").cast("double")).alias("ring_recall"), F.coalesce(F.avg(F.when(F.col("detected"), F.col("coverage"))), F.lit(0.0)).alias("ring_coverage_when_detected"))
    b = persons.agg(
        F.avg(F.col("detected").cast("double")).alias("person_recall"), F.median("lead").cast("double").alias("median_lead_days"), F.avg(F.coalesce(F.col("lead") >= early, F.lit(False)).cast("double")).alias("share_detected_early"),
        (F.coalesce(F.sum(F.when(F.col("detected"), F.col("exposure"))), F.lit(0.0)) / F.greatest(F.lit(1.0), F.sum("exposure"))).alias("exposure_avoided_share"),
    )
    return a.crossJoin(b)  # one row each


def ring_recall_by(test: DataFrame, flag: str, level: str) -> DataFrame:
    """Share of the rings of each ``level`` (sophistication, scenario) with an alerted member."""
    rings = ring_persons(test, flag).groupBy("ring_id").agg(F.max("detected").alias("detected"), F.min(level).alias(level))
    return rings.groupBy(level).agg(F.count("*").alias("rings"), F.avg(F.col("detected").cast("double")).alias("recall"))


def best_model(metrics: DataFrame, model: str = "model", value: str = "pr_auc") -> DataFrame:
    """One row: the model of the greatest value; of equals the first by name."""
    return metrics.orderBy(F.col(value).desc_nulls_last(), model).limit(1).select(model, value)


def assign_folds(labels: DataFrame, seed: int, holdout: Sequence[str], cutoff: int, test_share: float, val_share: float) -> DataFrame:
    """``labels`` with ``fold``, one for each ``group``. A ring is tested on if its scenario is held out or if its first
    bust-out comes after the cutoff, else the group's uniform value makes it val or train. Other groups are tested
    on by the share of ``test_share``, and the rest is split as rings are, by what is left of the value."""
    rings = labels.groupBy("group").agg(F.min(F.when(F.col("is_synthetic") == 1, F.col("bust_out_day"))).alias("__bust"), F.min("scenario").alias("__scenario"))
    u = uniform(seed, F.col("group"))
    split = lambda v: F.when(v < val_share, "val").otherwise("train")
    late = F.col("__scenario").isin(list(holdout)) | (F.col("__bust") > cutoff)
    ring = F.when(F.coalesce(late, F.lit(False)), "test").otherwise(split(u))
    other = F.when(u < test_share, "test").otherwise(split((u - test_share) / (1 - test_share)))
    return labels.join(rings.select("group", F.when(F.col("group").startswith("r"), ring).otherwise(other).alias("fold")), "group", "left")


def build_rows(features: DataFrame, folded: DataFrame, train_days: Sequence[int], test_days: Sequence[int], cutoff: int, max_tenure: int) -> DataFrame:
    """Stacked features of all days with the labels' columns, ``eligible``, ``split`` (train, val, test or none) and
    the target ``y``: the truth on test rows, what is confirmed by the cutoff on all others."""
    label = folded.select("person_id", "fold", "is_synthetic", "label_observed", "label_day", "bust_out_day", "ring_id", "sophistication", "scenario", "exposure", "group")
    rows = features.join(label, "person_id", "left")
    rows = rows.withColumn("eligible", F.coalesce(F.col("scored") & (F.col("app_tenure_days") <= max_tenure) & (F.col("bust_out_day") > F.col("T")), F.lit(False)))
    early, late = F.col("T").isin(list(train_days)), F.col("T").isin(list(test_days))
    split = F.when(F.col("eligible") & early & F.col("fold").isin("train", "val"), F.col("fold")).when(F.col("eligible") & late & (F.col("fold") == "test"), "test").otherwise("none")
    known = (F.col("is_synthetic") == 1) & F.col("label_observed") & (F.col("label_day") <= cutoff)
    return rows.withColumn("split", split).withColumn("y", F.when(F.col("split") == "test", F.col("is_synthetic")).otherwise(F.coalesce(known, F.lit(False)).cast("int")))


def positions(rows: DataFrame, by: str, order: str) -> DataFrame:
    """``pos``: 0, 1, ... within each group, by the order of a unique column."""
    return running_totals(rows, [by], [F.col(order)], {"pos": F.lit(1)}).withColumn("pos", (F.col("pos") - 1).cast("long"))
