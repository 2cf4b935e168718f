"""Reports, path attribution and propagation on a few rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from ringlight.operators import attribution, models, report


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(200).select(F.col("id").alias("person_id"), (F.col("id") % 5 == 0).cast("int").alias("y"), ((F.col("id") % 5 == 0).cast("double") + F.rand(3)).alias("a"), F.when(F.col("id") % 9 > 0, F.rand(4)).alias("b"))


def test_contributions_add_up_to_the_margin(rows):
    train = rows.where("person_id < 150")
    model, middle = models.fit_trees(train, ["a", "b"], "y", trees=5)
    trees = attribution.tree_tables(model)
    roots = sum(t["weight"] * t["value"][0] for t in trees)
    out = models.explained_trees(train, rows, ["a", "b"], "y", k=1, trees=5).collect()
    assert len(out) == 200 and len(trees) == 5
    for r in out:
        assert 1 / (1 + math.exp(-2 * (roots + sum(r.contributions)))) == pytest.approx(r.score, abs=1e-9)
        best = max(r.contributions)
        want = [] if best <= 0 else [(["a", "b"][r.contributions.index(best)], best)]
        assert [(x["feature"], pytest.approx(x["contribution"])) for x in json.loads(r.explanation)] == want


def test_propagated(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 4.0), (3, None)], "person_id long, a double")
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 1, 3.0)], "src long, dst long, w double")
    got = {r.person_id: r.a for r in models.propagated(rows, edges, ["a"], hops=1).collect()}
    assert got == pytest.approx({1: (1 + 3 * 4) / 4, 2: (4 + 3 * 1) / 4, 3: 0.0})


def test_alert_comparison(spark):
    rows = spark.createDataFrame([(1, "r", 1.0, True, None), (1, "s", 1.0, False, True), (0, "s", 2.0, True, False), (0, None, 2.0, None, None)], "y int, ring string, w double, p boolean, c boolean")
    got = {r.level: tuple(r)[1:] for r in report.alert_comparison(rows, "y", "ring", {"p": "p", "c": "c"}).collect()}
    assert got == {"p": (2, 3.0, pytest.approx(1 / 3), 0.5, 0.5), "c": (1, 1.0, 1.0, 0.5, 0.5)}
    assert tuple(report.alert_comparison(rows.limit(0), "y", "ring", {"p": "p"}).first())[1:] == (0, 0.0, None, None, None)


def test_go_no_go():
    got = report.go_no_go({"a": 0.9, "b": 0.8, "c": None}, [("better", "a", ">", "b"), ("enough", "b", ">=", 0.85), ("known", "c", "<=", 1), ("bound", "a", "<", "none")])
    assert [r["passed"] for r in got] == [True, False, False, False]
    assert report.go_no_go_markdown(got).endswith("1 of 4 criteria met") and "| better | 0.9 | > 0.8 | go |" in report.go_no_go_markdown(got)


def test_ten_criteria():
    limits = {"min_pr_auc_gain_vs_best_baseline": 0.0, "min_ring_recall_before_bust_out": 0.5, "min_lead_time_days": 30, "max_encrypted_score_abs_error": 1e-6}
    one = {"pr_auc": 0.8, "recall_at_3": 0.2, "ring_recall": 0.6, "median_lead_days": 40, "confounder_mean": 0.1, "recall_by_scenario": {"x": 0.4}}
    models_ = {"rules": one | {"pr_auc": 0.5}, "trees_tab": one, "trees_graph": one | {"pr_auc": 0.85, "recall_at_3": 0.3}, "trees_xb": one | {"pr_auc": 0.86}, "network_graph": one | {"pr_auc": 0.9}}
    privacy = {"raw_values_at_hub": 0, "unblinded_points_at_service": 0, "security_bits": 128, "max_abs_error_logit": 1e-9, "total_ms_per_request": 300}
    got = report.go_no_go(*report.criteria(models_, privacy, limits, ["x"]))
    assert len(got) == 11 and all(r["passed"] for r in got)
    assert len(report.criteria({k: v for k, v in models_.items() if "network" not in k}, {}, limits, ["y"])[1]) == 5
