"""Reports: models side by side, alerts by person and by community, and go or no go."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation

COMPARE = {">": operator.gt, ">=": operator.ge, "<=": operator.le, "<": operator.lt}


def model_report(rows: DataFrame, y: str, scores: list[str], pos: str, by: str, target: float, budget: float) -> DataFrame:
    """A row for each score column: means over the groups ``by`` of average precision, AUC, and precision and recall
    within the budget. All models are measured in the same passes."""
    long = rows.select(y, pos, by, F.inline(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("__score")) for s in scores])))
    picked = evaluation.select_budget(evaluation.prevalence_weights(long.withColumn("__g", F.struct("model", by)), y, target, "__g"), "__score", pos, budget, "__g")
    found = evaluation.average_precision(picked, y, "__score", "__g").join(evaluation.roc_auc(picked, y, "__score", "__g"), "__g", "left").join(evaluation.budget_metrics(picked, y, "__g"), "__g", "left")
    return found.groupBy(F.col("__g.model").alias("model")).agg(*[F.avg(c).alias(c) for c in ("ap", "auc", "precision", "recall")])


def alert_comparison(rows: DataFrame, y: str, ring: str, flags: dict[str, str]) -> DataFrame:
    """For each named flag column: rows and weight (``w``) alerted, precision, recall, and the share of rings with an
    alerted member. Null flags count as false; rings are those of positive rows."""
    positive = F.col(y) == 1
    rings = F.count_distinct(F.when(positive, F.col(ring)))
    out = []
    for name, flag in flags.items():
        hit = F.coalesce(F.col(flag), F.lit(False))
        weight = F.sum(F.when(hit, F.col("w")))
        out.append(rows.agg(
            F.count(F.when(hit, 1)).alias("alerted_rows"), F.coalesce(weight, F.lit(0.0)).alias("alerted_weight"), F.try_divide(F.sum(F.when(hit, F.col("w") * F.col(y))), weight).alias("precision"),
            F.try_divide(F.count(F.when(hit & positive, 1)), F.count(F.when(positive, 1))).alias("recall"), F.try_divide(F.count_distinct(F.when(hit & positive, F.col(ring))), rings).alias("ring_recall"),
        ).select(F.lit(name).alias("level"), "*"))
    return reduce(DataFrame.unionByName, out)


def criteria(models: dict[str, dict], privacy: dict, limits: dict, holdout: list[str]) -> tuple[dict, list[tuple]]:
    """The metrics and the ten criteria of ``go_no_go`` from metrics by model: pr_auc, recall_at_3 (recall at the budget of
    the most sophisticated level), ring_recall, median_lead_days, confounder_mean and recall_by_scenario. Criteria of
    other banks and of encryption hold only if ``privacy`` has their figures."""
    best = max(models, key=lambda m: (models[m]["pr_auc"], m))
    base = [m for m in ("rules", "trees_tab", "trees_graph") if m in models]
    nets = [m for m in models if m.startswith("network")]
    graph = [m for m in models if m not in ("rules", "trees_tab")]
    top = lambda names, k: max((models[m].get(k) or 0.0 for m in names), default=None)
    seen = [models[best]["recall_by_scenario"].get(x) for x in holdout]
    seen = [x for x in seen if x is not None]
    gain = None if not (nets and base) else top(nets, "pr_auc") - top(base, "pr_auc")
    values = {
        "network_gain": gain, "level_3_graph": top(graph, "recall_at_3"), "level_3_tab": models.get("trees_tab", {}).get("recall_at_3"), "ring_recall": models[best].get("ring_recall"), "lead": models[best].get("median_lead_days"),
        "confounders": models[best].get("confounder_mean"), "confounders_rules": models.get("rules", {}).get("confounder_mean"), "unseen": min(seen) if seen else None,
    }
    out = [
        ("The best network beats the best baseline in PR-AUC", "network_gain", ">", limits["min_pr_auc_gain_vs_best_baseline"]), ("Level 3: the graph does better than tables alone", "level_3_graph", ">", "level_3_tab"),
        ("Rings found before the bust-out", "ring_recall", ">=", limits["min_ring_recall_before_bust_out"]), ("Median lead in days", "lead", ">=", limits["min_lead_time_days"]),
        ("Alerts on honest look-alikes, against the rules", "confounders", "<=", "confounders_rules"), ("Scenarios never trained on are found", "unseen", ">", 0),
    ]
    if gain is None:
        out = out[1:]
    if privacy and "trees_xb" in models:
        values |= {"xb_gain": models["trees_xb"]["pr_auc"] - models["trees_graph"]["pr_auc"], "raw": max(privacy["raw_values_at_hub"], privacy["unblinded_points_at_service"]), "security": privacy["security_bits"] or 0, "error": privacy["max_abs_error_logit"], "latency": privacy["total_ms_per_request"]}
        out += [
            ("Gain by columns of other banks in PR-AUC", "xb_gain", ">", 0), ("Raw values or unblinded points at hub and service", "raw", "<=", 0), ("Security of the encryption in bits", "security", ">=", 128),
            ("Largest error of the encrypted score", "error", "<=", limits["max_encrypted_score_abs_error"]), ("Milliseconds of an encrypted score", "latency", "<", 1000),
        ]
    return values, out


def go_no_go(metrics: dict[str, float | None], criteria: list[tuple[str, str, str, float | str]]) -> list[dict]:
    """Each criterion (title, metric, comparison, limit); a limit may name another metric. An unknown value fails."""
    out = []
    for title, metric, sign, limit in criteria:
        value, bound = metrics.get(metric), metrics.get(limit) if isinstance(limit, str) else limit
        passed = value is not None and bound is not None and COMPARE[sign](value, bound)
        out.append({"criterion": title, "value": value, "target": f"{sign} {'unknown' if bound is None else format(bound, 'g')}", "passed": passed})
    return out


def go_no_go_markdown(results: list[dict]) -> str:
    lines = ["| Criterion | Value | Target | Result |", "|---|---|---|---|"]
    lines += [f"| {r['criterion']} | {'unknown' if r['value'] is None else format(r['value'], 'g')} | {r['target']} | {'go' if r['passed'] else 'no go'} |" for r in results]
    return "\n".join([*lines, "", f"{sum(r['passed'] for r in results)} of {len(results)} criteria met"])
